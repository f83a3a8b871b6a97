"""Ids of the byte-level BPE vocabularies, as the tokenizers library gives them.

Texts go through tiktoken, which holds the same merges and is several times as
fast, unless they have characters about whose class the libraries' Unicode
tables might differ; those go through the library itself.
"""

from __future__ import annotations

import os
import re

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def unstable() -> re.Pattern:
    """Finds characters that Unicode 3.2 lacks or classes otherwise than today, control characters but for white space, and all beyond the basic plane."""
    import unicodedata

    old = unicodedata.ucd_3_2_0
    steady = [c in range(9, 14) or (old.category(chr(c))[0] == unicodedata.category(chr(c))[0] != "C") for c in range(0x10000)]
    runs, at = [], 0
    while at < len(steady):
        end = at
        while end < len(steady) and steady[end] == steady[at]:
            end += 1
        if steady[at]:
            runs.append(f"\\u{at:04x}-\\u{end - 1:04x}")
        at = end
    return re.compile(f"[^{''.join(runs)}]")


class ByteBpe:
    """path: a tokenizers file of kind BPE with a byte-level pre-tokenizer and no normaliser."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"]: x["id"] for x in config["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in config["model"]["vocab"].items() if piece not in special}
        self.special = special
        self.unstable = unstable().search
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str):
        """The ids as an array of unsigned 32-bit integers; special strings in the text are their special ids."""
        import numpy as np

        if text.isascii() or not self.unstable(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
