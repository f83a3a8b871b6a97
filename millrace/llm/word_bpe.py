"""BPE encoding and decoding over a table of distinct words.

Texts are split into words in Spark and counted; the corpus's distinct words,
the commonest first up to a bound, are encoded once each, and the table joins
back to the texts' words by position. A word beyond the bound is rare and is
encoded where it stands. Decoding joins ids to their pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import discard, map_texts, materialize
from millrace.llm.byte_bpe import unstable
from millrace.llm.word_tables import as_dict, commonest, valued, word_counts

#: Fixed value: the word pattern of the vocabulary, applied to normalised text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def plane(chars: str) -> str:
    """Ranges, for a set of re's, of the basic plane's characters that chars, a class of regex's, holds."""
    import regex

    return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{chars}+", "".join(map(chr, range(0x10000)))))


def word_pattern() -> re.Pattern:
    """WORDS over the basic plane, for re, which looks characters up in a bitmap and takes a fraction of regex's time. Letters come first: no other word begins with one."""
    letters, digits = plane(r"\p{L}"), plane(r"\p{N}")
    return re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^{plane(r'\s')}{letters}{digits}]+")


class WordSplitter:
    """path: a tokenizers file of kind BPE whose words end with a mark, that lower-cases, drops white space and has no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.find = word_pattern().findall
        # Left to the library: special strings, letters whose small form depends on their neighbours, and characters of unsteady class.
        self.marks, self.unstable = [*special, "İ", "Σ"], unstable().search

    def words(self, text: str) -> list[str] | None:
        """The text's words; None if the library has to see it as a whole."""
        if any(x in text for x in self.marks) or self.unstable(text):
            return None
        return self.find((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


class WordBpe:
    """table: ids of words as little-endian unsigned 32-bit integers; other words are encoded as they come, and at most most_known of those are held."""

    def __init__(self, path: str, table: dict[str, bytes] | None = None, most_known: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.splitter = WordSplitter(path)
        self.table = table or {}
        self.rare: dict[str, bytes] = {}
        self.most_known = most_known
        size = self.library.get_vocab_size(with_added_tokens=True)
        #: The id-to-piece table.
        self.pieces = np.array([self.library.id_to_token(i) or "" for i in range(size)], dtype=object)
        with open(path, encoding="utf-8") as f:
            mark = json.load(f)["model"]["end_of_word_suffix"]
        self.ends = np.array([x.endswith(mark) for x in self.pieces])

    def encode_words(self, words: list[str], block: int = 512) -> list[bytes]:
        """ids of each word. The library gets a block of words as one text, and ids are cut after each piece that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(words), block):
            own = words[at : at + block]
            ids = np.array(self.library.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(own, add_special_tokens=False)]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(texts)
        split: list = []
        of, missing = self.table.get, set()
        for i, text in enumerate(texts):
            if text:
                words = self.splitter.words(text)
                if words is None:
                    out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                else:
                    ids = list(map(of, words))
                    if None in ids:
                        missing.update(w for w, x in zip(words, ids, strict=True) if x is None)
                        split.append((i, words, ids))
                    else:
                        out[i] = b"".join(ids)
        if len(self.rare) > self.most_known:
            self.rare.clear()
        new = [w for w in missing if w not in self.rare]
        self.rare.update(zip(new, self.encode_words(new), strict=True))
        for i, words, ids in split:
            out[i] = b"".join([self.rare[w] if x is None else x for w, x in zip(words, ids, strict=True)])
        return out

    def decode(self, ids: bytes) -> str:
        """The library's text for ids, special tokens kept: pieces in order with a blank between."""
        return " ".join(self.pieces[np.frombuffer(ids, dtype="<u4")].tolist())


def word_table(docs: DataFrame, path: str, *, text: str = "text", most_words: int = 200_000, longest: int = 64) -> dict[str, bytes]:
    """ids of the commonest distinct words of all texts, each encoded once: most_words words of up to longest bytes at most, which bounds what is sent to tasks."""

    def make():
        words_of = WordSplitter(path).words
        return lambda content: words_of(content) or ()

    def run(batches):
        bpe = WordBpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.encode_words(batch.column(0).to_pylist()), pa.binary())], names=["word", "value"])

    counts = materialize(word_counts(docs, make, text=text).where((F.col("n") > 1) & (F.octet_length("word") <= longest)))
    held = as_dict(valued(counts.where(commonest(counts, most_words=most_words, longest=longest)), run, "binary"))
    discard(counts)
    return held


def encode_documents(docs: DataFrame, path: str, *, keep: list[str], text: str = "text", most_words: int = 200_000) -> DataFrame:
    """keep, and ids (array<int>) of every whole text; null and empty texts have none."""

    held = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, text=text, most_words=most_words))

    def make():
        bpe = WordBpe(path, held.value)

        def run(texts: pa.Array) -> dict:
            return {"ids": pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode(texts.to_pylist())], pa.list_(pa.int32()))}

        return run

    return map_texts(docs, keep, text, make, "ids array<int>")


def digest_documents(docs: DataFrame, path: str, *, keep: list[str], text: str = "text", most_words: int = 200_000) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding of every whole text, by digest."""

    held = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, text=text, most_words=most_words))

    def make():
        bpe = WordBpe(path, held.value)

        def run(texts: pa.Array) -> dict:
            ids = bpe.encode(texts.to_pylist())
            return {
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            }

        return run

    return map_texts(docs, keep, text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
