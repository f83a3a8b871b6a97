"""Counts over whole texts that the quality operators read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.base import flat_utf8

SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    if n < 4096:
        windows: list | np.ndarray = list(zip(words, words[1:], words[2:], strict=False))
        if len(distinct := set(windows)) == n - 2:
            return 0
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)} if len(distinct) else set()
        hit = np.fromiter((w in twice for w in windows), dtype=bool, count=n - 2)
    else:  # the same by numbers in place of tuples: a few bytes a word
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, at, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        hit = count[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """\\n-split lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts; null texts have none of each."""
    data, offsets = flat_utf8(texts)
    lead = (data & 0xC0) != 0x80
    space = _table(b" \t\n\v\f\r")[data]
    out = {"word_chars": _per_text(lead & ~space, offsets), "n_symbols": _per_text(_table(SYMBOLS)[data], offsets)}
    whole = data.tobytes()
    n = len(texts)
    words, dup, rep = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for i in range(n):
        text = whole[offsets[i] : offsets[i + 1]]
        own = text.split()
        words[i], dup[i], rep[i] = len(own), repeated_lines(text), repeated_words(own)
    return out | {"n_words": words, "n_dup_lines": dup, "n_repeat_words": rep}


#: Order of the columns of features().
FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "stop_share", "exclamation_share", "foreign_share", "distinct_share", "repeat_share", "dup_line_share", "words_a_line", "longest_word", "letter_share", "common_share")


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; all are finite, also for null and empty texts."""
    data, offsets = flat_utf8(texts)
    size = np.maximum(1, np.diff(offsets))
    lead = (data & 0xC0) != 0x80
    points = np.maximum(1, _per_text(lead, offsets))
    kind = np.zeros(256, dtype=np.uint8)  # 1 a-z, 2 A-Z, 3 digits, 4 stops, 5 symbols
    for k, chars in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", SYMBOLS), 1):
        kind[list(chars)] = k
    kinds = kind[data]
    share = lambda flags: _per_text(flags, offsets) / points
    lower, upper, foreign = share(kinds == 1), share(kinds == 2), share((data >= 0xC0))
    digit, stop, symbol, loud = share(kinds == 3), share(kinds == 4), share(kinds == 5), share(data == 33)
    whole, n = data.tobytes(), len(texts)
    own = np.zeros((n, 7))
    for i in range(n):
        text = whole[offsets[i] : offsets[i + 1]]
        words = text.split()
        m = len(words)
        if m:
            seen: dict[bytes, int] = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            lines = text.count(b"\n") + 1
            own[i] = (m, len(text) / m, len(seen) / m**0.8, repeated_words(words) / m, repeated_lines(text) / lines, m / lines, max(map(len, seen)))
    common = np.where(own[:, 0] > 0, own[:, 2] / np.maximum(own[:, 0], 1) ** 0.2, 0)
    return np.column_stack([np.log1p(own[:, 0]), np.minimum(own[:, 1], 1e3), symbol, upper / np.maximum(lower + upper, 1e-9), digit, stop, loud, foreign, own[:, 2], own[:, 3], own[:, 4], np.log1p(own[:, 5]), np.log1p(own[:, 6]), lower + upper + foreign, common]) * (size > 0)[:, None]
