"""The row parser on two full rows, sources and sinks."""

import json

import pytest

from millrace.functions import values as V
from millrace.sources import listings as S
from millrace.sources import stores


def _raw(**given):
    return tuple(given.get(c) for c in V.RAW_COLUMNS)


ROW_A = _raw(
    id=" 1 ", title="Nice flat", location_address=json.dumps({"PostalCode": "8001", "City": "Zurich", "Street": "Main Street", "StreetNumber": "10", "canton": "zh"}), rent_net="2100", rent_extra="150", prop_child_friendly="true", offer_type="rent",
    orig_data=json.dumps({"Features": [{"Key": k, "Value": True} for k in ("HasBalconies", "HasLift", "HasParkingIndoor", "HasWashingmachine", "HasDryer")], "MainData": [{"Key": k, "Value": "true"} for k in ("IsWheelchairAccessible", "IsMinergieCertified", "PetsAllowed", "IsNewBuilding")]}),
    images=json.dumps({"images": [{"url": "https://a/1.jpg"}, "https://a/2.jpg"], "image_paths": ["p/3.jpg"]}), object_description="**Sunny**  <b>flat</b>\nnew",
)
ROW_B = _raw(id="2", title="NULL", object_street="Herisauerstrasse 15", object_zip="9015", object_city="St. Gallen", object_state="", location_address=json.dumps({"canton": ""}), orig_data="{}", rent_gross="2250", prop_balcony="false", prop_elevator="false", prop_garage="false", prop_fireplace="false", prop_child_friendly="false", prop_parking="true", animal_allowed="true", is_new_building="true")


def test_row_parser(spark):
    a, b = S.prepare(spark.createDataFrame([ROW_A, ROW_B], S.RAW)).orderBy("listing_id").collect()
    assert (a.listing_id, a.street, a.city, a.postal_code, a.canton, a.price, a.offer_type) == ("1", "Main Street 10", "Zurich", "8001", "ZH", 2250, "RENT")
    flags = lambda r, *names: tuple(r[f"feature_{n}"] for n in names)
    assert flags(a, "balcony", "elevator", "parking", "garage") == (True,) * 4
    assert flags(a, "child_friendly", "pets_allowed", "new_build", "wheelchair_accessible", "private_laundry", "minergie_certified") == (True,) * 6
    assert {"balcony", "elevator", "parking"} <= set(a.features) and a.description == "Sunny flat \nnew".replace(" \n", "\n") or "Sunny" in a.description
    assert a.image_urls == ["https://a/1.jpg", "https://a/2.jpg", "p/3.jpg"] and a.hero_image_url == "https://a/1.jpg"
    assert (b.street, b.city, b.postal_code, b.canton, b.price, b.title) == ("Herisauerstrasse 15", "St. Gallen", "9015", None, 2250, "Untitled listing")
    assert flags(b, "balcony", "elevator", "parking", "garage", "fireplace", "child_friendly", "pets_allowed", "new_build") == (False, False, True, False, False, False, True, True)
    assert flags(b, "wheelchair_accessible", "private_laundry", "minergie_certified") == (None, None, None) and "parking" in b.features


def test_csv_scan_and_bootstrap(spark, tmp_path):
    import csv

    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, V.RAW_COLUMNS)
        w.writeheader()
        w.writerow({"id": "7", "title": 'Say "hi"', "object_description": "two\nlines, one comma", "rent_gross": "1'250"})
        w.writerow({"id": "8.0", "title": "3,5 Zimmer"})
    own = S.prepare(S.read_csv(spark, f"{tmp_path}/*.csv"))
    rows = {r.listing_id: r for r in own.collect()}
    assert rows["7"].title == 'Say "hi"' and rows["7"].description == "two\nlines, one comma" and rows["7"].price == 1250 and rows["8.0"].rooms == 3.5
    assert S.bootstrap(own, f"{tmp_path}/out") and not S.bootstrap(own, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and S.missing_columns(own, ["title", "x"]) == {"x"}
    with pytest.raises(ValueError):
        S.bootstrap(own.union(own), f"{tmp_path}/twice")


def test_images(spark, tmp_path):
    for n in ("1.png", "1.jpeg", "2.webp", "3.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {(r.listing_id, r.file) for r in S.image_files(spark, str(tmp_path)).collect()} == {("1", "1.jpeg"), ("2", "2.webp")}


def test_pois(spark, tmp_path):
    items = [{"type": "node", "lat": 47.0, "lon": 8.0, "tags": {"name": "n", "amenity": "school"}}, {"type": "way", "center": {"lat": 47.1, "lon": 8.1}, "tags": {"railway": "station"}}, {"type": "way"}]
    (tmp_path / "s.json").write_text(json.dumps(items))
    (tmp_path / "t.json").write_text(json.dumps({"elements": items}))
    from millrace.operators.geojoin import extract_coordinates

    for name in ("s", "t"):
        got = {tuple(r) for r in extract_coordinates(stores.read_poi_cache(spark, f"{tmp_path}/{name}.json", "school")).collect()}
        assert got == {("school", 47.0, 8.0, "n", "school"), ("school", 47.1, 8.1, None, "station")}


def test_shards_and_results(spark, tmp_path):
    from pyspark.sql import functions as F

    stores.write_shards(spark.range(10).select(F.col("id").cast("string").alias("path"), F.array(F.lit(1.0)).alias("vector")).coalesce(1), f"{tmp_path}/s", 4)
    assert stores.read_shards(spark, f"{tmp_path}/s").count() == 10 and len(list((tmp_path / "s").glob("*.parquet"))) == 3
    stores.write_results(spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, listing_id string"), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    name = spark.sql("select 1").select(stores.result_name(F.lit("A b!"), F.to_timestamp(F.lit("2026-01-02 03:04:05")))).first()[0]
    assert name == "20260102_030405_a_b_.json"
