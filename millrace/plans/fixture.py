"""Listings made from the driver's tables, by one text of SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import values as V

_FLAG = {f: i for i, f in enumerate(V.FEATURES)}
_FLAGS = ",\n".join(f" CASE WHEN (d.doc_id + {i}) % 4 = 0 THEN NULL ELSE CAST((d.doc_id * {2 * i + 3}) % 5 < 2 AS INT) END AS feature_{f}" for f, i in _FLAG.items())

_LINE = "split_part(d.text, chr(10), 1)"
TITLE = f"""concat(CASE WHEN d.doc_id % 41 = 0 THEN 'Tauschwohnung: ' WHEN d.doc_id % 43 = 0 THEN 'Suche Wohnung ' WHEN d.doc_id % 47 = 0 THEN 'FR-Ferney-Voltaire ' WHEN d.doc_id % 37 = 0 THEN 'Wohnung befristet bis 30.06.2026 '
  WHEN d.doc_id % 31 = 0 THEN 'WG-Zimmer ' WHEN d.doc_id % 53 = 0 THEN 'Coliving ' WHEN d.doc_id % 29 = 0 THEN '3.5-Zimmer ' WHEN d.doc_id % 59 = 0 THEN 'Untermiete ' WHEN d.doc_id % 61 = 0 THEN 'apartment swap ' ELSE '' END, {_LINE})"""

LISTINGS = f"""SELECT CAST(d.doc_id AS {{STR}}) AS listing_id, CAST(100000 + d.doc_id AS {{STR}}) AS platform_id, d.source AS scrape_source, {TITLE} AS title, d.text AS description,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE concat('Weg ', CAST(d.doc_id % 80 AS {{STR}})) END AS street,
 CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN concat(n.n_name, ' GE') ELSE n.n_name END AS city,
 CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE CAST(8000 + d.doc_id % 60 AS {{STR}}) END AS postal_code,
 CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE upper(substring(r.r_name, 1, 2)) END AS canton,
 CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE CAST(800 + p.p_size * 60 AS INT) END AS price,
 CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(2 + p.p_size % 10 AS DOUBLE) / 2 END AS rooms,
 CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE CAST(20 + (d.doc_id * 37) % 130 AS DOUBLE) END AS area,
 CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(45.8 AS DOUBLE) + CAST((d.doc_id * 7919) % 2000 AS DOUBLE) / 1000 END AS latitude,
 CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(6.0 AS DOUBLE) + CAST((d.doc_id * 104729) % 4400 AS DOUBLE) / 1000 END AS longitude,
{_FLAGS},
 CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 10 = 3 THEN 'SALE' ELSE 'RENT' END AS offer_type,
 CASE WHEN d.doc_id % 2 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN 'Parkplatz' WHEN d.doc_id % 10 = 3 THEN 'Haus' WHEN d.doc_id % 10 = 5 THEN 'WG-Zimmer' ELSE 'Wohnung' END AS object_category,
 CAST(NULL AS {{STR}}) AS object_type,
 CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST((d.doc_id * 53) % 3000 AS INT) END AS distance_public_transport,
 CASE WHEN d.doc_id % 8 < 3 THEN NULL ELSE CAST((d.doc_id * 131) % 2000 AS INT) END AS geo_transit_m,
 CASE WHEN d.doc_id % 8 = 1 THEN NULL ELSE CAST((d.doc_id * 197) % 4000 AS INT) END AS geo_school_m,
 CASE WHEN d.doc_id % 8 = 2 THEN NULL ELSE CAST((d.doc_id * 251) % 9000 AS INT) END AS geo_university_m,
 CASE WHEN d.doc_id % 8 = 5 THEN NULL ELSE CAST((d.doc_id * 61) % 900 AS INT) END AS geo_supermarket_m
FROM documents d JOIN part p ON p.p_partkey = d.doc_id % 200
JOIN nation n ON n.n_nationkey = d.doc_id % 25 JOIN region r ON r.r_regionkey = n.n_regionkey"""

#: Suppliers as points of interest of four types.
POIS = """SELECT element_at({LIST}, CAST(s_suppkey % 4 + 1 AS INT)) AS poi_type, CAST(45.8 AS DOUBLE) + CAST((s_suppkey * 6151) % 2000 AS DOUBLE) / 1000 AS lat,
 CAST(6.0 AS DOUBLE) + CAST((s_suppkey * 31337) % 4400 AS DOUBLE) / 1000 AS lon, s_name AS name, CAST(s_nationkey AS {STR}) AS kind FROM supplier"""
_TYPES = "'transit', 'supermarket', 'school', 'university'"




def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ("documents", "part", "nation", "region")
    sql = LISTINGS.replace("{STR}", "STRING").replace(_LINE, f"coalesce({_LINE}, '')")  # Spark's concat is null if a part is
    for t in tables:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POIS.replace("{STR}", "STRING").replace("{LIST}", f"array({_TYPES})").replace("FROM supplier", "FROM {supplier}"), supplier=read(spark, sf_dir, "supplier"))


#: Beginnings of the oracles' statements.
L = f"L AS ({LISTINGS.replace('{STR}', 'VARCHAR')})"
P = f"P AS ({POIS.replace('{STR}', 'VARCHAR').replace('element_at({LIST}, CAST(s_suppkey % 4 + 1 AS INT))', f'([{_TYPES}])[s_suppkey % 4 + 1]')})"
