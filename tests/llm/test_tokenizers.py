"""Ids and counts against the tokenizers library, over the documents and over every character that is not left to it."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import queries, token_counts, word_bpe
from millrace.llm.byte_bpe import ByteBpe, unstable

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_word_digests(spark, texts):
    library = Tokenizer.from_file(WORDS)
    for r in queries.op7_word_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, SF).collect()}
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert got == {d: (len(t.encode()), sizes[d], sizes[d] > 1024) for d, t in texts.items()}


def test_every_steady_character():
    odd = unstable().search
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not odd(chr(c))]
    assert len(chars) > 45_000 and {"中", "한", "ع", "क", "ไ", "é", "я"} <= set(chars)
    asked = [f"a{c}b 1{c}  {c}{c} X{c}\n{c}" for c in chars]
    library = Tokenizer.from_file(BYTES)
    counter, fast = token_counts.PieceCounter(BYTES, {"a": 1}), ByteBpe(BYTES)
    for c, t, e in zip(chars, asked, library.encode_batch(asked, add_special_tokens=False), strict=True):
        assert not counter.pre.whole(t) and counter.count(t) == len(e.ids), hex(ord(c))
        assert fast.ids(t).tolist() == e.ids, hex(ord(c))
    library = Tokenizer.from_file(WORDS)
    for c, got, e in zip(chars, word_bpe.WordBpe(WORDS).encode(asked), library.encode_batch(asked, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == e.ids, hex(ord(c))


def test_the_table_holds_the_commonest_words(spark, texts):
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pre = token_counts.PreTokens(BYTES)
    want = Counter()
    for t in texts.values():
        want.update(pre.of(t)[0])
    for most in (0, 50, 1_000_000):
        table = token_counts.piece_table(docs, BYTES, most_words=most)
        assert len(table) <= most and all(n == len(pre.bpe.fast.encode_ordinary(w)) for w, n in table.items())
        rest = [n for w, n in want.items() if w not in table and len(w.encode()) <= 64]
        assert not table or min(want[w] for w in table) > max(rest)
        assert len(table) == sum(n > 1 for w, n in want.items() if len(w.encode()) <= 64) if most > 1000 else len(table) < most + 1


def test_words_as_regex_splits_them():
    import random

    import regex

    odd, split, rng = unstable().search, word_bpe.WordSplitter(WORDS), random.Random(3)
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    asked = [f"a{c}1{c}{c} '{c}s" for c in chars] + ["".join(rng.choices("'stredvlm abz09 .,!_-é一٣Ⅷ 　\x1c\x85", k=60)) for _ in range(5000)]
    find = word_bpe.word_pattern().findall
    assert [find(t) for t in asked] == [regex.findall(word_bpe.WORDS, t) for t in asked]
    assert all((split.words(c) is None) == bool(odd(c) or c in "İΣ") for c in chars)
    assert split.words("a<|endoftext|>b") is None


def test_words_are_encoded_in_blocks():
    class Counting:
        def __init__(self, library):
            self.library, self.asked = library, 0

        def encode_batch_fast(self, texts, **options):
            self.asked += len(texts)
            return self.library.encode_batch_fast(texts, **options)

    bpe, words = word_bpe.WordBpe(WORDS), [*(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(676)), "'s", "''", "7", "!?", "́"]
    want = [e.ids for e in bpe.library.encode_batch(words, add_special_tokens=False)]
    bpe.library = counting = Counting(bpe.library)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.encode_words(words)] == want
    assert counting.asked < 10  # each word was a text of its own before
    mixed = ["one", "two words", "three"]  # not words: each by itself
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.encode_words(mixed)] == [e.ids for e in counting.library.encode_batch(mixed, add_special_tokens=False)]
    assert bpe.encode_words([]) == []
