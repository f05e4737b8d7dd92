import re

import pytest

from phenoframe.llm import licenses
from phenoframe.llm.queries import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
S = licenses.SENTENCES


@pytest.mark.parametrize("name", ["op1_decontamination", "op10_licenses"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_rules(spark):
    apache = ["apache-notice-defined", "apache-copy", "apache-unless", "apache-see"]
    texts = {
        1: "Intro.\n" + S["apache-notice"] + ".\nMore text",
        2: "# A file\n\n" + "\n".join(S[i] + ("." if i == "apache-copy" else "") for i in apache) + "\ncode()",
        3: S["mit-grant"] + " " + S["mit-condition"] + "\n\n" + S["mit-warranty"] + " " + S["mit-liability"],
        4: S["mit-condition"] + " " + S["mit-grant"],
        5: "Title\n" + S["cc-by-nc-notice"][:-1] + "\nby nobody",
        6: S["gpl3-notice"] + " " + S["mit-notice"],
        7: None, 8: "", 9: "The licence is licensed.", 10: "  LICENSED   under the\tMIT license!! ",
        11: S["bsd-grant"] + "\n1. " + S["bsd-source"] + "\n" + S["bsd-source"] + " " + S["bsd-binary"] + " " + S["bsd-names"],
        12: "word " * 200_000 + ". " + S["mit-notice"],
    }
    rows = [(i, t, 0) for i, t in texts.items()] + [(None, S["mit-notice"], 0), (1, texts[1], 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rules int")
    out = licenses.license_matches(df).collect()
    got = {r["doc_id"]: (r["rules"], r["licenses"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (["apache-2.0-notice"], ["apache-2.0"]) and got[2] == (["apache-2.0-header"], ["apache-2.0"])
    assert got[3] == (["mit-text"], ["mit"]) and got[4] == ([], []) and got[5] == (["cc-by-nc-4.0-notice"], ["cc-by-nc-4.0"])
    assert got[6] == (["gpl-3.0-notice", "mit-notice"], ["gpl-3.0", "mit"])
    assert got[7] == got[8] == got[9] == ([], []) and got[10] == (["mit-licensed"], ["mit"]) and got[None] == got[12] == (["mit-notice"], ["mit"])
    assert licenses.license_matches(df.where("false")).collect() == []


def test_every_rule_is_made_of_known_sentences():
    assert all(i in S for _, _, ids in licenses.RULES for i in ids)
    assert len({licenses.normal_sentence(s) for s in S.values()}) == len(S)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_wrapped_headers_and_mixed_texts(spark):
    mark = lambda text, prefix: "\n".join((prefix + line).rstrip() for line in text.splitlines())
    mit = " ".join(S[i] for i in ("mit-grant", "mit-condition", "mit-warranty", "mit-liability"))
    texts = [APACHE, mark(APACHE, "# "), "/*\n" + mark(APACHE, " * ") + "\n */", APACHE.replace("http:", "https:"), MPL, mark(MPL, "// "), GPL, mark(GPL, "# ")]
    texts += [mit + "\n\nArtwork\nLicensed under CC BY 4.0\nby us", "Artwork\nLicensed under CC BY 4.0\nby us\n\n" + mit]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["rules"], r["licenses"]) for r in licenses.license_matches(df).collect()}
    apache, mpl, gpl = (["apache-2.0-header"], ["apache-2.0"]), (["mpl-2.0-notice"], ["mpl-2.0"]), (["gpl-3.0-header"], ["gpl-3.0"])
    both = (["cc-by-4.0-notice", "mit-text"], ["cc-by-4.0", "mit"])
    assert [got[i] for i in range(len(texts))] == [apache] * 4 + [mpl] * 2 + [gpl] * 2 + [both] * 2


def test_every_known_sentence_passes_the_filter_and_is_not_cut():
    for text in map(licenses.shielded, S.values()):
        assert re.search(licenses.LIKELY, text) and not re.search(licenses.SENTENCE_END, text)


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""


def licenses_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: (r["rules"], r["licenses"]) for r in licenses.license_matches(df).collect()}
    return [out[i] for i in range(len(texts))]


def test_wrapped_texts_of_more_licences(spark):
    agpl, gpl2 = GPL.replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU\nAffero General"), GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    lgpl3 = GPL.replace("GNU General", "GNU Lesser General").replace("GNU\nGeneral", "GNU\nLesser General")
    got = licenses_of(spark, [LGPL, ISC, ZLIB, EPL, agpl, gpl2, lgpl3, "/* " + LGPL.replace("\n", "\n * ") + "*/"])
    assert got == [
        (["lgpl-2.1-header"], ["lgpl-2.1"]), (["isc-text"], ["isc"]), (["zlib-text"], ["zlib"]), (["epl-2.0-header"], ["epl-2.0"]),
        (["agpl-3.0-header"], ["agpl-3.0"]), (["gpl-2.0-header"], ["gpl-2.0"]), (["lgpl-3.0-header"], ["lgpl-3.0"]), (["lgpl-2.1-header"], ["lgpl-2.1"]),
    ]


def test_every_named_licence_by_tag_and_notice(spark):
    assert len(licenses.NAMES) >= 40
    tags = [f"#!/bin/sh\n# SPDX-License-Identifier: {tag}\nset -e" for tag in licenses.NAMES]
    notices = [f"# Title\n\n## License\n\nThis project is licensed under the {name}\n" for name in licenses.NAMES.values()]
    want = [[tag.lower()] for tag in licenses.NAMES]
    assert [found for _, found in licenses_of(spark, tags)] == want
    assert [found for _, found in licenses_of(spark, notices)] == want


def test_compound_tags(spark):
    tag = "// SPDX-License-Identifier: "
    cases = {
        "MIT OR Apache-2.0": ["apache-2.0", "mit"], "(MIT AND BSD-3-Clause) OR ISC": ["bsd-3-clause", "isc", "mit"],
        "GPL-2.0-or-later": ["gpl-2.0"], "GPL-2.0-only WITH Classpath-exception-2.0": ["gpl-2.0"],
        "GPL-2.0-only WITH Linux-syscall-note OR MIT": ["gpl-2.0", "mit"], "MIT-or-not": [], "": [], "Unheard-1.0 OR Zlib": ["zlib"],
        "MIT and so on": ["mit"], " OR ".join(["MIT", "ISC", "Zlib", "X11", "Vim", "curl"]): ["curl", "isc", "mit", "vim", "x11", "zlib"],
    }
    assert [found for _, found in licenses_of(spark, [tag + c + "\ncode" for c in cases])] == list(cases.values())
    two = tag + "MIT OR ISC\nfirst or second\n" + tag + "Zlib\n"
    assert licenses_of(spark, [two, "mit or isc", "x " + tag + "MIT"]) == [(["isc-tag", "mit-tag", "zlib-tag"], ["isc", "mit", "zlib"]), ([], []), ([], [])]
