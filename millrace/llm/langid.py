"""Language ID by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text for each
language. A text is cut into phrases, each the longest match that the
language's sample holds; a language whose sample holds long stretches of the
text needs few phrases. Phrases are charged log2 of the sample's length each,
and the language with the lowest charge wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import flat_utf8, map_texts

UNKNOWN = "und"


#: Bytes of the transitions that tasks hold at once; more languages than fit go in several parts.
TABLE_BYTES = 256 << 20
#: Letters that are learnt of a language at least, however many there are.
LEAST_LETTERS = 4_000


@dataclass(frozen=True)
class LanguageModel:
    """Languages in alphabetical order, and parts: each a dict of plain values for some of them, in that order.

    classes: of each code point, 0 no letter, 1 a letter that no sample has; width: how many classes there are.
    table: for state and letter class, 2 * the next state + 1 if a new phrase begins there; starts: each language's state before a phrase; charge: bits for a phrase.
    """

    languages: tuple[str, ...]
    parts: list[dict]


def _normalised(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Letter classes of all texts, runs of other characters as one 0, with offsets for the texts."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = before[offsets]
    kinds = classes[points]
    keep = kinds != 0
    keep[1:] |= kinds[:-1] != 0
    keep[at[:-1][at[:-1] < len(keep)]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return kinds[keep], count[at]


def _automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of text, -1 where there is none."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out = np.full((len(go), width), -1, dtype=np.int32)
    for state, nexts in enumerate(go):
        for c, to in nexts.items():
            out[state, c] = to
    return out


def letters_each(languages: int, sample_chars: int = 64_000, most_letters: int = 256_000) -> int:
    """Letters to learn of each language: sample_chars, or its share of most_letters, LEAST_LETTERS at least."""
    return min(sample_chars, max(LEAST_LETTERS, most_letters // max(1, languages)))


def build_model(samples: dict[str, list[str]], *, sample_chars: int = 64_000, most_letters: int = 256_000, alphabet: int = 96, shared: int = 16, table_bytes: int = TABLE_BYTES) -> LanguageModel:
    """A model from texts per language: letters_each() letters of each are learnt.

    The commonest letters of all samples, alphabet of them, are told apart; rarer
    ones share so many classes by code point, and letters that no sample has are one class.
    Every language with a letter is learnt; as many make a part as table_bytes hold, one at least.
    """
    languages = tuple(sorted(k for k, v in samples.items() if any(c.isalpha() for t in v for c in t)))
    counts: dict[str, int] = {}
    for k in languages:
        for t in samples[k]:
            for c in t.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
    letters = sorted(counts, key=lambda c: (-counts[c], c))[:alphabet]
    of = {c: i + 2 for i, c in enumerate(letters)}
    spare = min(shared, len(counts) - len(letters))
    of |= {c: 2 + len(letters) + sum(map(ord, c)) % spare for c in counts if c not in of}
    most = letters_each(len(languages), sample_chars, most_letters)
    classes = np.fromiter((of.get(chr(i).lower(), 1) if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    width = len(letters) + spare + 2
    together = max(1, table_bytes // (2 * most * width * 4))  # an automaton has twice as many states as letters at most
    parts = []
    for begin in range(0, max(1, len(languages)), together):
        own = languages[begin : begin + together]
        tables, starts, charge, size = [], [], [], 0
        for k in own:
            joined = "\n".join(samples[k]).encode()
            kinds, _ = _normalised(np.frombuffer(joined, dtype=np.uint8), np.array([0, len(joined)]), classes)
            kinds = kinds[:most]
            go = _automaton(kinds[kinds != 1] if (kinds == 1).any() else kinds, width)
            # One more state stands before a phrase: whatever comes next begins one. A letter that no state knows is a phrase of its own.
            between = len(go)
            root = np.where(go[0] < 0, between, go[0])
            go = np.vstack([go, np.full(width, -1, dtype=np.int32)])
            miss = go < 0
            to = np.where(miss, root[None, :], go).astype(np.int64) + size
            tables.append((2 * to + miss).astype(np.int32))
            starts.append(size + between)
            charge.append(np.log2(max(2, len(kinds))))
            size += len(go)
        parts.append({"classes": classes, "width": width, "table": np.concatenate(tables) if tables else np.zeros((1, width), np.int32), "starts": np.array(starts, dtype=np.int32), "charge": np.array(charge)})
    return LanguageModel(languages, parts)


def phrases(model: LanguageModel, texts: pa.Array, block: int = 1024, window: int = 1 << 20):
    """(phrases needed: a row for each text, a column for each language; letters of each text)."""
    found = [part_phrases(p, texts, block, window) for p in model.parts]
    return np.hstack([counts for counts, _ in found]), found[0][1]


def part_phrases(part: dict, texts: pa.Array, block: int = 1024, window: int = 1 << 20):
    """phrases() by one part of a model.

    Blocks of a text are parsed side by side, each as if a phrase began with it.
    Then each is parsed again from where the block before it really ends, until
    both parses are in one state; mostly a word or two. So the phrases are those
    of the whole text. Texts of over window letters go by windows of that length.
    """
    data, offsets = flat_utf8(texts)
    kinds, at = _normalised(data, offsets, part["classes"])
    n, langs, starts, width = len(texts), len(part["starts"]), part["starts"], part["width"]
    total = np.zeros((n, langs), dtype=np.int64)
    size = np.diff(at)
    parts = -(-size // block)
    flat = part["table"].ravel()
    carried = np.repeat(starts.astype(np.int64)[:, None], n, axis=1)  # each text's state before its next block
    for begun in range(0, int(parts.max(initial=0)), window // block):
        own = np.clip(parts - begun, 0, window // block)
        owner = np.repeat(np.arange(n), own)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
        start = at[:-1][owner] + (begun + nth) * block
        length = np.minimum(block, size[owner] - (begun + nth) * block)
        place = np.cumsum(length) - length  # of a block's letters among all here
        symbols = kinds[np.repeat(start - place, length) + np.arange(length.sum())].astype(np.int64)
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(1, block + 1), side="right")
        last, later = place + length - 1, np.flatnonzero(nth > 0)
        for k in range(langs):
            came = np.where(nth > 0, starts[k], carried[k][owner])  # the state each block is parsed from
            states, begins = np.empty(len(symbols), dtype=np.int32), np.zeros(len(symbols), dtype=bool)
            state, to_place = came[order], place[order]
            for step, m in enumerate(live):
                if not m:
                    break
                here = to_place[:m] + step
                to = flat[state[:m] * width + symbols[here]]
                begins[here], state[:m] = to & 1, to >> 1
                states[here] = state[:m]
            while len(todo := later[states[last[later - 1]] != came[later]]):
                came[todo] = states[last[todo - 1]]
                state, here, end = came[todo], place[todo], last[todo]
                while len(here):
                    to = flat[state * width + symbols[here]]
                    state = (to >> 1).astype(np.int64)
                    apart = (states[here] != state) & (here < end)
                    begins[here], states[here] = to & 1, state
                    state, here, end = state[apart], here[apart] + 1, end[apart]
            total[:, k] += np.bincount(owner, weights=np.add.reduceat(begins.astype(np.int64), place), minlength=n).astype(np.int64)
            carried[k][owner] = states[last]  # the last of a text's blocks stands
    letters = np.add.reduceat(np.concatenate([kinds != 0, [False]]).astype(np.int64), at[:-1]) * (size > 0) if n else np.zeros(0, np.int64)
    return total, letters


def labelled_sample(docs: DataFrame, where: Column, *, id: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = 64_000, most_texts: int = 400) -> dict[str, list[str]]:
    """Texts for each language, by the order of a hash of their ids: most_texts at most, until they hold letters_each() characters.

    Of a text of over a sixteenth of those a stretch of that length is
    taken, from a place that the hash chooses, so that several texts speak for a
    language and none is left out for the length of its texts. Every language that a row names is learnt.
    """
    size = F.length("text")
    rows = docs.where(where).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(id).cast("string"), F.length(text)).alias("h"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & (size > 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not counts:
        return {}
    each = letters_each(len(counts), sample_chars)
    most = max(1, each // 16)
    # Thin each language out by the hash first, so that the sort sees about twice what it keeps.
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1 << 20, (2 * most_texts << 20) // r.n + 1)) for r in counts], "lang string, share bigint")
    begin = F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.lit(1), size - most + 1)).cast("int") + 1
    few = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share")).select("lang", "h", F.substring("text", begin, F.lit(most)).alias("text"))
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", F.crc32("text"))
    held = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = few.select("lang", "text", F.row_number().over(w).alias("nth"), held.alias("held")).where((F.col("nth") <= most_texts) & (F.col("held") < each)).orderBy("lang", "nth").collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r.lang, []).append(r.text)
    return out


def identify(docs: DataFrame, model: LanguageModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred, score and letters for each whole text.

    score is the winner's share of the languages' likelihoods, each two to the
    minus its bits a letter times 32 letters at most (0 to 1). Null and empty texts, texts without a
    letter, and any text if no language was learnt: `und` with score 0. Among
    equal languages the first in the alphabet wins. Repeated rows each count.
    """
    # Plain arrays: what is broadcast is pickled by reference, and workers may lack this package. TABLE_BYTES a part at most.
    held = [docs.sparkSession.sparkContext.broadcast(p) for p in model.parts]
    languages = model.languages

    def make():
        names = np.array([*languages, UNKNOWN], dtype=object)

        def label(texts: pa.Array) -> dict:
            every = []
            for part in held:
                counts, letters = part_phrases(part.value, texts)
                every.append(counts * part.value["charge"])
                if len(held) > 1:  # one part at a time; it is read again for the next texts
                    vars(part).pop("_value", None)
            if not languages:
                return {"lang_pred": pa.array([UNKNOWN] * len(texts), pa.string()), "score": pa.array(np.zeros(len(texts))), "letters": pa.array(letters)}
            bits = np.hstack(every)
            best = bits.argmin(axis=1)
            scale = np.minimum(1.0, 32.0 / np.maximum(letters, 1))[:, None]
            share = 1 / np.exp2((bits.min(axis=1, keepdims=True) - bits) * scale).sum(axis=1)
            none = letters == 0
            return {"lang_pred": pa.array(names[np.where(none, len(languages), best)], pa.string()), "score": pa.array(np.where(none, 0.0, share)), "letters": pa.array(letters)}

        return label

    return map_texts(docs, keep, text, make, "lang_pred string, score double, letters bigint")
