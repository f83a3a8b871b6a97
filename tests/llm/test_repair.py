"""Conversation repair against plain versions."""

import random

import pytest
from plain_repair import applied, cheapest, damaged, exhaustive, faults, report

from millrace.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def _want(rows):
    return _sorted((conv, *report(own)) for conv, own in damaged(rows).items())


def _made(seed, convs, most, texts=("a.", "b!", "cut", "  ", "", "so?", "x. \n")):
    rng = random.Random(seed)
    roles = ("user", "assistant", "system", "tool", None, "user", "assistant")
    return [(c, rng.choice((t, t, t, None, t + 9)), rng.choice(roles), rng.choice((*texts, None, f"{t}.", f"{t}!"))) for c in range(convs) for t in range(rng.randint(1, most))]


def test_plain_versions_agree():
    """Whole strings by states against every string of edits."""
    for seed in range(60):
        for rows in damaged(_made(seed, 1, 4)).values():
            if len(rows) <= 4:
                assert cheapest(rows, faults(rows)) == exhaustive(rows, faults(rows))


@pytest.mark.parametrize("seed", range(200))
def test_one_conversation(seed):
    for rows in damaged(_made(seed, 2, 30)).values():
        found = faults(rows)
        codes = [{"": 0, "truncated": 1, "blank": 2, "duplicate": 3}[f] for f in found]
        cost, audit, turns = repair.repaired([r for _, r, _ in rows], [t for _, _, t in rows], codes)
        assert (cost, audit) == cheapest(rows, found)
        assert [(r, t) for _, r, t in turns] == applied(rows, audit)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1024])
def test_chunks(spark, size):
    """Conversations cut into chunks of any size, with ties of cost between their paths."""
    rows = _made(11, 25, 40) + [(99, t, "user" if t % 3 else "assistant", "same." if t % 5 else "other") for t in range(300)]
    random.Random(2).shuffle(rows)
    found = repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA).repartition(5)), chunk_rows=size)
    assert _sorted(tuple(r) for r in found.reports().collect()) == _want(rows)
    turns = {}
    for r in found.turns().orderBy("conv_id", "chunk", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, own in damaged(rows).items():
        assert turns.get(conv, []) == applied(own, cheapest(own, faults(own))[1])


def test_chunks_by_bytes(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "x" * (50 * t) + ".") for t in range(40)] + [(2, 0, "user", "y" * 100_000)]
    found = repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA)), chunk_bytes=300)
    assert _sorted(tuple(r) for r in found.reports().collect()) == _want(rows)


def test_edges(spark, tmp_path):
    """Null ids, turns, roles and texts, repeated rows, conversations of dropped rows alone, very long texts, equal turns, odd roles."""
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (5, None, "user", "b"), (5, None, "user", "b"), (6, 2**62, "system", "s."), (6, -(2**61), "assistant", " "), (7, 0, "", "."), (7, 0, "USER", "!"), (8, 3, "user", "é" * 700_000 + "?"), (9, 1, "user", "a:b."), (9, 2, "user:a", "b.")]
    rows += [(c, t, "user", "same.") for c in range(20, 60) for t in (0,)] + [(70, 4, "assistant", "again.")] * 50
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert _sorted(tuple(r) for r in got.collect()) == _want(rows)
    assert any(not own for own in damaged(rows).values())


def test_empty_and_clashing(spark):
    empty = repair.repair(repair.damage(spark.createDataFrame([], SCHEMA)))
    assert empty.reports().count() == empty.turns().count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a.", 3, "x", True), (1, 1, "assistant", "b.", 4, "y", False)], "conv_id bigint, turn bigint, role string, text string, chunk int, mark string, alone boolean")
    assert [tuple(r) for r in repair.repair(repair.damage(odd)).reports().collect()] == _want([(1, 0, "user", "a."), (1, 1, "assistant", "b.")])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _sorted(tuple(r) for r in queries.op13_conversation_repair(spark, sf).collect()) == _want(rows)
