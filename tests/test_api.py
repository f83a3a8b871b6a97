"""The caller's functions."""

import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.operators import bm25
from millrace.plans import fixture

SF = "/root/testdata/sf0.001"


def test_text_search(spark, tmp_path):
    own = fixture.listings(spark, SF)
    bm25.build_index(own.select("listing_id", bm25.corpus_text().alias("text")), id="listing_id", text="text").save(str(tmp_path))
    index = bm25.Bm25Index.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "the and thing under 2500, cheap")], "query_id bigint, raw_query string")
    out = api.search_text(own, asked, index, limit=7, offset=2).collect()
    assert [r["rank"] for r in sorted(out, key=lambda r: r["rank"])] == [3, 4, 5, 6, 7] and all(r.price <= 2500 for r in out)
    with pytest.raises(ValueError):
        api.search_text(own, asked, index, limit=0)
    assert api.search_filters(spark, own, [{"canton": "AS"}, {"max_price": 900}]).select("query_id").distinct().count() == 2
    assert api.nearby(spark, [(46.8, 8.2)], fixture.pois(spark, SF), 3, 1e6).count() == 3
    shown = api.display_rows(own, own.limit(3))
    assert shown.count() == 3 and api.map_points(shown, own).count() <= 3
    assert api.result_json(shown.withColumn("query_id", F.lit(1))).first().json.startswith("{")
