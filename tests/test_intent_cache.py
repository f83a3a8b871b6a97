"""Intents that are kept: what is parsed, and what comes back."""

from millrace.operators import intent
from millrace.operators.intent_cache import IntentCache, soft_facts


def test_each_text_is_parsed_once(spark, tmp_path):
    parsed = []

    def parse(df):
        parsed.append(sorted(r.raw_query for r in df.collect()))
        return intent.understand(df)

    cache = IntentCache(spark, str(tmp_path), parse)
    first = spark.createDataFrame([(1, "cheap flat in Zürich"), (2, " cheap flat in Zürich "), (3, None), (4, "  "), (5, "bright flat")], "query_id bigint, raw_query string")
    out = {r.query_id: r for r in cache.understand(first).collect()}
    assert parsed == [["bright flat", "cheap flat in Zürich"]]
    assert out[1].city == out[2].city == ["Zürich"] and out[1].price_intent == "cheap" and out[5].bright
    assert all(out[i].city is None and out[i].weights is None and out[i].raw_query == "" for i in (3, 4))
    again = spark.createDataFrame([(7, "bright flat"), (8, "quiet flat")], "query_id bigint, raw_query string")
    plain = {r.query_id: r for r in intent.understand(again).collect()}
    found = {r.query_id: r.asDict() for r in IntentCache(spark, str(tmp_path), parse).understand(again).collect()}
    assert parsed[1:] == [["quiet flat"]] and all(found[i][c] == plain[i][c] for i in (7, 8) for c in plain[i].asDict())
    cache.invalidate()
    cache.understand(again)
    assert parsed[2:] == [["bright flat", "quiet flat"]]


def test_nothing_asked(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "query_id bigint, raw_query string")
    cache = IntentCache(spark, str(tmp_path))
    assert cache.understand(empty).first().city is None and cache.understand(empty.where("false")).count() == 0


def test_soft_facts(spark):
    own = intent.understand(spark.createDataFrame([(1, "bright flat near a park, parking")], "query_id bigint, raw_query string"))
    r = soft_facts(own).first()
    assert (r.language, r.used_llm, r.soft.bright, r.soft.parking, r.soft.quiet) == ("unknown", False, True, True, False)
