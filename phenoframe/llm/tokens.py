"""Token ids of texts with a public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` library for a tokenizer file. Where the file is a plain
byte-level BPE whose ids follow the order of its merges, its vocabulary is handed to the
faster ``tiktoken`` encoder, which gives the same ids (the tests compare them); texts that hold
an added token's mark, and other kinds of files, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

SLICE_BYTES = 2 << 20  # text encoded at once
LEVELS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def default_path() -> str:
    """The installed 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of all byte strings, or None when the file is not a plain byte-level BPE."""
    model, levels = spec["model"], spec.get("pre_tokenizer") or {}
    added = {token["content"] for token in spec["added_tokens"]}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and spec.get("normalizer") is None
        and LEVELS.items() <= levels.items()
    )
    if not plain:
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    back = {c: b for b, c in byte_letters().items()}
    tokens = {t: i for t, i in model["vocab"].items() if t not in added}
    if merged != sorted(merged) or any(c not in back for t in tokens for c in t):
        return None
    return {bytes(back[c] for c in t): i for t, i in tokens.items()}


class Encoder:
    """``ids(text)`` gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.marks = [token["content"] for token in spec["added_tokens"]]
        ranks, self.fast = byte_ranks(spec), None
        if ranks is not None:
            import public_tokenizers

            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not any(mark in text for mark in self.marks):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # a run of blanks is too long for its pattern
                pass
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.ids(text) for text in texts]


@cache
def encoder(path: str | None = None) -> Encoder:
    """The worker's own encoder of a file."""
    return Encoder(path)
