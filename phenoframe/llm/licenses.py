"""Licence recognition by sentence rules.

Texts are cut into sentences and, where a sentence is not known as a whole, into its lines,
for headers without full stops; both are normalised to lower-case words. Marks inside known
sentences do not cut. Known licence sentences have identifiers, and the identifiers
found in a text, in order, are matched against ordered rules. Everything is column expressions
on one scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Standard sentences of licences and licence notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-defined": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-name": "The MIT License (MIT)",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-licensed": "Licensed under the GNU General Public License v3.0",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "Released under CC0 1.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "cddl-subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "wtfpl-permitted": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "perl-terms": "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
}
# Rules as (name, licence, sentence identifiers in order).
RULES = [
    ("apache-2.0-notice", "apache-2.0", ["apache-notice"]),
    ("apache-2.0-short-header", "apache-2.0", ["apache-notice-defined", "apache-copy"]),
    ("apache-2.0-header", "apache-2.0", ["apache-notice-defined", "apache-copy", "apache-unless", "apache-see"]),
    ("mit-notice", "mit", ["mit-notice"]),
    ("mit-licensed", "mit", ["mit-licensed"]),
    ("mit-grant", "mit", ["mit-grant", "mit-condition"]),
    ("mit-text", "mit", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("gpl-3.0-notice", "gpl-3.0", ["gpl3-notice"]),
    ("gpl-3.0-licensed", "gpl-3.0", ["gpl3-licensed"]),
    ("gpl-3.0-free", "gpl-3.0", ["gpl-free"]),
    ("gpl-3.0-header", "gpl-3.0", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("cc-by-nc-4.0-notice", "cc-by-nc-4.0", ["cc-by-nc-notice"]),
    ("cc-by-nc-4.0-long", "cc-by-nc-4.0", ["cc-by-nc-long"]),
    ("cc-by-4.0-notice", "cc-by-4.0", ["cc-by-notice"]),
    ("cc-by-4.0-long", "cc-by-4.0", ["cc-by-long"]),
    ("cc-by-sa-4.0-notice", "cc-by-sa-4.0", ["cc-by-sa-notice"]),
    ("cc-by-sa-4.0-long", "cc-by-sa-4.0", ["cc-by-sa-long"]),
    ("cc0-1.0-notice", "cc0-1.0", ["cc0-notice"]),
    ("bsd-2-clause-text", "bsd-2-clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-3-clause-text", "bsd-3-clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("mpl-2.0-notice", "mpl-2.0", ["mpl2-form"]),
    ("unlicense-notice", "unlicense", ["unlicense-free"]),
    ("gpl-2.0-free", "gpl-2.0", ["gpl2-free"]),
    ("gpl-2.0-only", "gpl-2.0", ["gpl2-only"]),
    ("gpl-2.0-header", "gpl-2.0", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("lgpl-2.1-free", "lgpl-2.1", ["lgpl2-free"]),
    ("lgpl-2.1-header", "lgpl-2.1", ["lgpl2-free", "lgpl2-hope", "lgpl-details"]),
    ("lgpl-3.0-free", "lgpl-3.0", ["lgpl3-free"]),
    ("lgpl-3.0-header", "lgpl-3.0", ["lgpl3-free", "gpl-hope", "lgpl-details"]),
    ("agpl-3.0-free", "agpl-3.0", ["agpl3-free"]),
    ("agpl-3.0-header", "agpl-3.0", ["agpl3-free", "gpl-hope", "agpl-details"]),
    ("isc-text", "isc", ["isc-grant"]),
    ("0bsd-text", "0bsd", ["0bsd-grant"]),
    ("zlib-text", "zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("epl-2.0-header", "epl-2.0", ["epl2-available"]),
    ("bsl-1.0-notice", "bsl-1.0", ["boost-notice"]),
    ("cddl-1.0-header", "cddl-1.0", ["cddl-subject"]),
    ("ofl-1.1-notice", "ofl-1.1", ["ofl-notice"]),
    ("postgresql-text", "postgresql", ["postgresql-grant"]),
    ("wtfpl-text", "wtfpl", ["wtfpl-permitted"]),
    ("artistic-1.0-perl-notice", "artistic-1.0-perl", ["perl-terms"]),
    ("bsd-4-clause-text", "bsd-4-clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("mit-0-text", "mit-0", ["mit0-grant"]),
]
# Public licence identifiers with the name that notices use.
NAMES = {
    "MIT": "MIT License", "MIT-0": "MIT No Attribution License", "Apache-2.0": "Apache License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-4-Clause": "BSD 4-Clause License",
    "0BSD": "BSD Zero Clause License", "ISC": "ISC License", "Zlib": "zlib License", "BSL-1.0": "Boost Software License 1.0",
    "GPL-2.0": "GNU General Public License v2.0", "GPL-3.0": "GNU General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License v2.1", "LGPL-3.0": "GNU Lesser General Public License v3.0",
    "AGPL-3.0": "GNU Affero General Public License v3.0", "MPL-1.1": "Mozilla Public License 1.1", "MPL-2.0": "Mozilla Public License 2.0",
    "EPL-1.0": "Eclipse Public License 1.0", "EPL-2.0": "Eclipse Public License 2.0", "EUPL-1.2": "European Union Public Licence 1.2",
    "CDDL-1.0": "Common Development and Distribution License 1.0", "Artistic-2.0": "Artistic License 2.0",
    "Artistic-1.0-Perl": "Artistic License 1.0 (Perl)", "PostgreSQL": "PostgreSQL License", "NCSA": "University of Illinois/NCSA Open Source License",
    "OFL-1.1": "SIL Open Font License 1.1", "MS-PL": "Microsoft Public License", "MS-RL": "Microsoft Reciprocal License",
    "Unlicense": "Unlicense", "WTFPL": "Do What The F*ck You Want To Public License", "CC0-1.0": "Creative Commons Zero v1.0 Universal license",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International license", "CC-BY-SA-4.0": "Creative Commons Attribution Share Alike 4.0 International license",
    "CC-BY-NC-4.0": "Creative Commons Attribution Non Commercial 4.0 International license", "CC-BY-ND-4.0": "Creative Commons Attribution No Derivatives 4.0 International license",
    "ODbL-1.0": "Open Data Commons Open Database License v1.0", "Python-2.0": "Python License 2.0", "PHP-3.01": "PHP License v3.01",
    "Ruby": "Ruby License", "OSL-3.0": "Open Software License 3.0", "AFL-3.0": "Academic Free License v3.0", "ECL-2.0": "Educational Community License v2.0",
    "LPPL-1.3c": "LaTeX Project Public License v1.3c", "MulanPSL-2.0": "Mulan Permissive Software License, Version 2", "BlueOak-1.0.0": "Blue Oak Model License 1.0.0",
    "CECILL-2.1": "CeCILL Free Software License Agreement v2.1", "X11": "X11 License", "curl": "curl License", "Vim": "Vim License",
}
LEADS = {"project": "This project is licensed under the", "licensed": "Licensed under the", "released": "Released under the"}
GNU = ("GPL", "LGPL", "AGPL")  # their tags say whether later versions are allowed

KEPT = "[^a-z0-9.!?:\n]+"  # what becomes a space
SENTENCE_END = "(?:[.!?:]+(?:[ \n]+|$))|\n *\n"
EDGES = "^[ .!?:\n]+|[ .!?:\n]+$"
INNER = "[ \n]+"
# marks inside known sentences that would cut them, in normalised text: the mark, what it becomes,
# and a word that texts with the mark hold
SHIELDS = [
    ("(license[ \n]+at)[ \n:]+https?:[ \n]*", "http", "http"),
    ("(license[ \n]+v)[.][ \n]+(?=2[.]0)", "", "2.0"),
    ("(program[ \n]+is[ \n]+free[ \n]+software):[ \n]+(?=you)", "", "software:"),
    ("(is[ \n]+available[ \n]+at)[ \n:]+https?:[ \n]*", "http", "http"),
    ("(spdx license identifier): *", "", "spdx license identifier:"),
]
TAG = "spdx-license-identifier:"
TERM = "[a-z0-9.+-]+"  # a licence or an exception in a tag
EXCEPT = f"(?:[ \t]+with[ \t]+{TERM})"
# each licence of a compound tag gets a tag of its own; an exception is no licence
COMPOUND = rf"({TAG}[ \t(]*|(?!\A)\G[(]*)({TERM}){EXCEPT}?[ \t)]+(?:or|and)[ \t]+"
LIKELY = "licen|softw|copy|redis|mit |cc0|name of|in the hope"  # every known sentence has one


def normal_sentence(sentence: str) -> str:
    """The normalised form of one sentence, as the expressions below make it."""
    text = re.sub(KEPT, " ", sentence.lower())
    return re.sub(INNER, " ", re.sub(EDGES, "", text))


def shielded(sentence: str) -> str:
    """The normalised form of one sentence without marks that cut."""
    text = normal_sentence(sentence)
    for mark, put, _ in SHIELDS:
        text = re.sub(mark, rf"\1 {put} ", text)
    return re.sub(INNER, " ", text)


def add_named() -> None:
    """Tags and one-line notices of every named licence, as sentences with a rule each."""
    taken = {shielded(s) for s in SENTENCES.values()}
    for tag, name in NAMES.items():
        family = tag.split("-")[0] in GNU
        texts = {f"tag{end}": f"{TAG} {tag}{end}" for end in ["", *(["-only", "-or-later"] if family else [])]}
        texts |= {lead: f"{start} {name}." for lead, start in LEADS.items()}
        for how, text in texts.items():
            if shielded(text) not in taken:
                SENTENCES[f"{tag.lower()}:{how}"] = text
                RULES.append((f"{tag.lower()}-{how}", tag.lower(), [f"{tag.lower()}:{how}"]))


add_named()


def separate_tags(text: Column) -> Column:
    """A lower-case text whose compound licence tags are cut into a tag per licence."""
    single = F.regexp_replace(text, COMPOUND, f"$1$2\n{TAG} ")
    plain = F.regexp_replace(single, rf"({TAG}[ \t(]*{TERM}){EXCEPT}", "$1")
    return F.when(F.contains(text, F.lit(TAG)), plain).otherwise(text)


def known_ids(flat: Column) -> Column:
    """Identifiers of the known sentences of a normalised text with shielded marks, in order."""
    table = {shielded(s): i for i, s in SENTENCES.items()}
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    widest = max(map(len, table)) + 200

    def named(parts: Column) -> Column:
        likely = F.filter(parts, lambda s: (F.length(s) <= widest) & s.rlike(LIKELY))
        clean = F.transform(likely, lambda s: F.regexp_replace(F.regexp_replace(s, EDGES, ""), INNER, " "))
        return F.transform(F.filter(clean, lambda s: s.isin(*table)), lambda s: names[s])

    sentences = F.filter(F.split(flat, SENTENCE_END, -1), lambda s: s.rlike(LIKELY))
    whole = lambda s: named(F.array(s))

    def of_sentence(s: Column) -> Column:
        lines = named(F.split(s, "\n", -1))
        return F.flatten(F.transform(F.array(whole(s)), lambda w: F.when(F.size(w) > 0, w).otherwise(lines)))

    return F.flatten(F.transform(sentences, of_sentence))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentences, rules, licenses)`` per row.

    ``sentences`` are identifiers of known sentences in the order of the text. A rule matches
    when its identifiers stand in a row there; a rule that is part of a longer matching rule of
    the same licence is left out. ``rules`` and ``licenses`` are sorted. Null and empty texts
    and texts without a rule have empty arrays; repeated rows and null ids stay; other columns
    are ignored. Machine-readable tags count as sentences, each licence of a compound one for itself.
    """
    lower = F.lower(F.coalesce(text_col, F.lit("")))
    flat = F.regexp_replace(separate_tags(lower), KEPT, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), flat.alias("_flat"))
    for mark, put, word in SHIELDS:
        free = F.regexp_replace("_flat", mark, f"$1 {put} ")
        rows = rows.withColumn("_flat", F.when(F.contains("_flat", F.lit(word)), free).otherwise(F.col("_flat")))
    rows = rows.select("doc_id", known_ids(F.col("_flat")).alias("sentences"))
    rows = rows.withColumn("_line", F.concat(F.lit("|"), F.array_join("sentences", "|"), F.lit("|")))
    marked = {name: f"|{'|'.join(ids)}|" for name, _, ids in RULES}
    rules = []
    for name, license_, _ in RULES:
        longer = [marked[n] for n, l, _ in RULES if l == license_ and n != name and marked[name] in marked[n]]
        longer = F.array(*map(F.lit, longer)).cast("array<string>")
        rules.append(F.struct(F.lit(marked[name]).alias("ids"), longer.alias("longer"), F.lit(name).alias("rule"), F.lit(license_).alias("license")))

    def holds(rule: Column) -> Column:
        covered = F.exists(rule["longer"], lambda ids: F.contains("_line", ids))
        return F.contains(F.col("_line"), rule["ids"]) & ~covered

    hits = F.transform(F.filter(F.array(*rules), holds), lambda rule: F.struct(rule["rule"], rule["license"]))
    none = F.array().cast("array<struct<rule:string,license:string>>")
    rows = rows.withColumn("_found", F.when(F.size("sentences") > 0, hits).otherwise(none))
    return rows.select(
        "doc_id",
        "sentences",
        F.array_sort(F.col("_found.rule")).alias("rules"),
        F.array_sort(F.array_distinct(F.col("_found.license"))).alias("licenses"),
    )


def rule_sql() -> str:
    """DuckDB SQL for the rows of the registered query.

    It takes either sentences or lines of a text and knows no marks inside sentences: texts
    with wrapped headers of the Apache, MPL and GPL licences, or with known sentences of both
    sorts, and texts with tags have more rules in ``license_matches``.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = {normal_sentence(s): i for i, s in SENTENCES.items()}
    sentences = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in table.items())
    rules = ", ".join(f"({quote(n)}, {quote(l)}, {quote('|' + '|'.join(ids) + '|')})" for n, l, ids in RULES)

    def found(cut: str, how: str) -> str:
        return f"""SELECT doc_id, '{how}' AS how, i, id FROM (
            SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part
            FROM (SELECT doc_id, string_split_regex(flat, '{cut}') AS parts FROM f)) p
            JOIN known ON norm = regexp_replace(regexp_replace(part, '{EDGES}', '', 'g'), '{INNER}', ' ', 'g')"""

    return f"""
WITH known(norm, id) AS (VALUES {sentences}), rules(rule, license, ids) AS (VALUES {rules}),
f AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '{KEPT}', ' ', 'g') AS flat FROM documents),
m AS ({found(SENTENCE_END, 'a')} UNION ALL {found(chr(10), 'b')}),
c AS (SELECT doc_id, how, count(*) AS n, string_agg(id, '|' ORDER BY i) AS line FROM m GROUP BY doc_id, how),
best AS (SELECT doc_id, arg_max(line, n * 2 + CASE WHEN how = 'a' THEN 1 ELSE 0 END) AS line FROM c GROUP BY doc_id),
hit AS (SELECT doc_id, rule, license, ids FROM best JOIN rules ON contains('|' || line || '|', ids)),
kept AS (SELECT * FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.license = h.license AND o.rule <> h.rule AND contains(o.ids, h.ids))),
r AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM kept GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT doc_id, license FROM kept) GROUP BY doc_id)
SELECT d.doc_id, coalesce(replace(line, '|', ','), '') AS sentences, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
