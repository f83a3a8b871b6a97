"""Queries of the scalar, intent and weight functions over rows that are derived from the given tables.

Each raw value is put together from a row's key by an expression that both engines read; the SQL
works its answer out from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars, stems, text
from millrace.functions import values as V
from millrace.operators import intent, quality, ranking, signals, weights
from millrace.operators.intent_cache import IntentCache, soft_facts
from millrace.plans.fixture import L, listings, read
from millrace.plans.schema import INTENT
from millrace.sources.stores import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(words: list[str], at: str) -> str:
    """The word at a number of any size, by CASE, which both engines read alike."""
    cases = " ".join(f"WHEN {i} THEN {_quoted(w)}" for i, w in enumerate(words))
    return f"CASE ({at}) % {len(words)} {cases} END"


def _spark(expression: str) -> Column:
    """Spark reads no doubled quotes inside quotes."""
    return F.expr(re.sub(r"(?<=\w)''(?=\w)", r"\\'", expression))


def _pairs(table: dict) -> str:
    return "(VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in table.items()) + ")"


def _intents(df: DataFrame, given: dict[str, Column | str]) -> DataFrame:
    """Rows as intents; what is not given is null."""
    own = {k: _spark(v) if isinstance(v, str) else v for k, v in given.items()}
    return df.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INTENT.fields))


# ---- Scalars ----

_RAW_TEXT = "CASE p_partkey % 7 WHEN 0 THEN concat('  ', p_name, ' ') WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN ' NULL ' WHEN 5 THEN concat('Null', p_name) WHEN 6 THEN '   ' END"


@query(f"SELECT p_partkey, CASE WHEN trim(c) <> '' AND upper(trim(c)) <> 'NULL' THEN trim(c) END AS cleaned FROM (SELECT p_partkey, {_RAW_TEXT} AS c FROM part)")
def clean_null_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.clean_text(_spark(_RAW_TEXT)).alias("cleaned"))


_TRI = [f"CASE (p_partkey // {3**i}) % 3 WHEN 0 THEN true WHEN 1 THEN false END" for i in range(3)]


@query(f"SELECT p_partkey, CASE WHEN list_contains(l, true) THEN true WHEN list_contains(l, false) THEN false END AS any_true FROM (SELECT p_partkey, [{', '.join(_TRI)}] AS l FROM part)")
def tri_state_or(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.tri_or(*(_spark(t.replace("//", "div")) for t in _TRI)).alias("any_true"))


_SPELT = ["true", "No", "0", "Ja", "y", "false", "1e3", "nan", ".5", "3d", "YES", "-0"]
_NUMBER = f"""CASE p_partkey % 8 WHEN 0 THEN concat(CAST(p_size AS {{STR}}), CASE p_partkey % 3 WHEN 0 THEN '.5' WHEN 1 THEN ',5' ELSE '' END) WHEN 1 THEN concat(CAST(p_partkey % 9 + 1 AS {{STR}}), '''', CAST(100 + p_size AS {{STR}}), '.25') WHEN 2 THEN p_type
    WHEN 3 THEN concat(' ', CAST(p_size AS {{STR}}), ' ') WHEN 4 THEN {_pick(_SPELT, 'p_partkey // 8')} WHEN 5 THEN concat('-', CAST(p_size AS {{STR}})) WHEN 6 THEN 'NULL' END"""


@query(
    f"""WITH r AS (SELECT p_partkey, CASE WHEN trim(c) <> '' AND upper(trim(c)) <> 'NULL' THEN trim(c) END AS t FROM (SELECT p_partkey, {_NUMBER.replace('{STR}', 'VARCHAR')} AS c FROM part)),
    n AS (SELECT p_partkey, t, lower(t) AS w, CASE WHEN regexp_matches(x, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN CAST(x AS DOUBLE) END AS f FROM (SELECT *, replace(replace(t, '''', ''), ',', '.') AS x FROM r))
    SELECT p_partkey, f AS as_float, round_even(f, 0)::INT AS as_int, CASE WHEN w IN ('true', '1', 'yes', 'y') THEN true WHEN w IN ('false', '0', 'no', 'n') THEN false WHEN w IS NOT NULL THEN true END AS as_bool,
    coalesce(w IN ('true', '1', 'yes', 'y', 'ja') OR (regexp_matches(w, '^-?\\d+(\\.\\d+)?(e[+-]?\\d+)?$') AND coalesce(try_cast(w AS DOUBLE), 0) > 0), false) AS truthy FROM n"""
)
def parse_float_separators(spark, sf_dir):
    c = _spark(_NUMBER.replace("{STR}", "STRING").replace("//", "div").replace("''''", "\"'\""))
    own = read(spark, sf_dir, "part").select("p_partkey", c.alias("c"))
    c = F.col("c")
    return own.select("p_partkey", scalars.parse_float(c).alias("as_float"), scalars.parse_int(c).alias("as_int"), scalars.parse_bool(c).alias("as_bool"), scalars.truthy(c).alias("truthy"))


_IMAGES = """CASE doc_id % 5 WHEN 0 THEN concat('{"images": [{"url": "u', doc_id, '"}, "v', doc_id, '", {"name": "x"}], "image_paths": ["p', doc_id, '"]}') WHEN 1 THEN concat('{"image_paths": ["p', doc_id, '", ""]}') WHEN 2 THEN source WHEN 3 THEN '{"images": []}' END"""


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat_ws(',', 'u' || doc_id, 'v' || doc_id, 'p' || doc_id) WHEN 1 THEN 'p' || doc_id ELSE '' END AS urls, CASE doc_id % 5 WHEN 0 THEN 'u' || doc_id WHEN 1 THEN 'p' || doc_id END AS hero FROM documents")
def image_url_lists(spark, sf_dir):
    urls = scalars.image_urls(F.expr(_IMAGES))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", urls).alias("urls"), F.try_element_at(urls, F.lit(1)).alias("hero"))


_SYNONYMS = {w: f for f, words in V.FEATURE_SYNONYMS.items() for w in words}
_NAMED = [f"CASE WHEN doc_id % 2 = 0 THEN upper({_pick(list(_SYNONYMS), 'doc_id')}) ELSE {_pick(list(_SYNONYMS), 'doc_id')} END", _pick([*_SYNONYMS, "sauna"], "doc_id * 5 + 1"), "CASE WHEN doc_id % 3 = 0 THEN 'Sauna' ELSE 'balkon' END"]


@query(
    f"""WITH n AS (SELECT doc_id, unnest([1, 2, 3]) AS pos, unnest([{', '.join(_NAMED)}]) AS name FROM documents), k AS (SELECT doc_id, feature, min(pos) AS pos FROM n JOIN {_pairs(_SYNONYMS)} s(word, feature) ON word = lower(name) GROUP BY 1, 2)
    SELECT d.doc_id, string_agg(feature, ',' ORDER BY pos) AS features FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1"""
)
def feature_synonyms(spark, sf_dir):
    own = scalars.canonical_features(F.array(*map(_spark, _NAMED)))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(own.isNotNull(), F.concat_ws(",", own)).alias("features"))


_PLACE = f"concat(CASE WHEN doc_id % 2 = 0 THEN upper({_pick([*V.PLACE_CITIES, 'Rüti'], 'doc_id')}) ELSE {_pick([*V.PLACE_CITIES, 'Rüti'], 'doc_id')} END, CASE doc_id % 3 WHEN 0 THEN ' (Kreis 3)' WHEN 1 THEN ' / Lindenhof' ELSE '' END)"
_CITIES = {**V.CITY_ALIASES, **{k: v[0] for k, v in V.DISTRICTS.items()}}
_ASKED_CITY = f"concat(' ', {_pick([*_CITIES, 'Thun'], 'doc_id * 3')}, ' ')"


@query(
    f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace({_PLACE}, ' \\(Kreis \\d+\\)$', ''), ' / .*$', '') AS p, trim({_ASKED_CITY}) AS c FROM documents)
    SELECT doc_id, coalesce(a.city, p) AS place, coalesce(b.city, c) AS city FROM r LEFT JOIN {_pairs(V.PLACE_CITIES)} a(name, city) ON a.name = lower(p) LEFT JOIN {_pairs(_CITIES)} b(name, city) ON b.name = lower(c)"""
)
def canonical_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalars.place_city(_spark(_PLACE)).alias("place"), scalars.canonical_city(_spark(_ASKED_CITY)).alias("city"))


_STEMMED = {"de": ("wohnungen häuser freundlichkeit ruhige", "wohnung haus freundlich ruhig"), "en": ("apartments bedrooms consistency hopping", "apart bedroom consist hop"), "fr": ("appartements continuellement majestueux", "appart continuel majestu"), "it": ("appartamenti abbassamento prontamente", "appart abbass pront")}


@query(f"SELECT doc_id, {_pick([b for _, b in _STEMMED.values()], 'doc_id')} AS stems FROM documents")
def word_stems(spark, sf_dir):
    """Words that each document is given, stemmed in the language given with them."""
    said = text.tokens(_spark(_pick([a for a, _ in _STEMMED.values()], "doc_id")), stems.by_language, _spark(_pick(list(_STEMMED), "doc_id")))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", said).alias("stems"))


# ---- Listing types ----

#: A phrase for each alternative of the patterns that say what kind of listing a text is; accents stand inside words, where both engines see the same boundaries.
_KINDS = [
    "tausch", "Tauschwohnung", "zum  Tausch", "[tauschwohnung]", "Wohnungen tauschen", "swap apartment", "coliving", "Co-Living", "WG-Zimmer", "Zimmer in einer WG", "camera in appartamento condiviso", "room in shared flat", "chambre en colocation",
    "befristet", "temporäre", "temporaire", "temporaneo", "fixed-term", "kurzfristig", "bis 01.02.2026", "tausch gegen", "wohnungstausch", "apartment swap", "echange contre", "appartement échange", "scambio di appartamenti",
    "suche wohnung", "suche 3.5-zimmer", "ich suche", "wir suchen", "cherche studio", "cherche 3 pièces", "a la recherche d'un appartement", "reprise de bail", "cerco monolocale", "wanted: x", "looking for an apartment",
    "temporary", "temporarily", "temporairement", "temporanea", "zwischenmiete", "untervermietung", "sous-location", "sublet", "abriss", "demolition", "bis zum 1.2.26", "bis Ende 2026", "jusqu'au mai 2026", "fino al 3", "a quiet flat",
]
_KIND_TEXT = f"concat(source, ': ', {_pick(_KINDS, 'doc_id')}, CASE WHEN doc_id % 3 = 0 THEN concat(' ', upper({_pick(_KINDS, 'doc_id * 7 + 5')})) ELSE '' END, '. ', text)"
_KIND_PATTERNS = {"exchange": V.EXCHANGE, "coliving": V.COLIVING, "wg_room": V.WG_ROOM, "temporary": V.TEMPORARY_LISTING, "swap": V.SWAP, "wanted": V.WANTED, "short_term": V.SHORT_TERM}


@query(f"SELECT doc_id, {', '.join(f'regexp_matches(x, {_quoted("(?i)" + p)}) AS {k}' for k, p in _KIND_PATTERNS.items())} FROM (SELECT doc_id, {_KIND_TEXT} AS x FROM documents)")
def listing_kinds(spark, sf_dir):
    """Every alternative of the listing patterns, put before whole texts, found by literal parts and patterns."""
    own = read(spark, sf_dir, "documents").select("doc_id", _spark(_KIND_TEXT).alias("x"))
    return own.select("doc_id", *(quality.in_text(F.col("x"), p).alias(k) for k, p in _KIND_PATTERNS.items()))


# ---- Queries as text ----

_PHRASES = ["Familie mit kinder", "möblierte Wohnung befristet", "for 3 months", "WG room", "", "retired couple, sublet", "wohnung auf zeit", "kids and a garden", "short-term stay", "6 Monate", "coliving space", "permanent home", "a family, furnished", "temporär", "relocating", "shared flat for a few"]
_WISH = f"concat_ws(', ', {_pick(_PHRASES, 'doc_id')}, source, {_pick(_PHRASES, 'doc_id * 5 + 3')})"


@query(
    f"""SELECT doc_id, s AS short_term, NOT s AND regexp_matches(x, {_quoted('(?i)' + V.LONG_TERM_QUERY)}) AS long_term, regexp_matches(x, {_quoted('(?i)' + V.WANTS_TEMPORARY)}) AS temporary, {' OR '.join(f"contains(lower(x), '{w}')" for w in V.SHARED_WORDS)} AS shared
    FROM (SELECT doc_id, x, regexp_matches(x, {_quoted('(?i)' + V.SHORT_TERM_QUERY)}) AS s FROM (SELECT doc_id, {_WISH} AS x FROM documents))"""
)
def query_wishes(spark, sf_dir):
    c = F.col("x")
    own = read(spark, sf_dir, "documents").select("doc_id", _spark(_WISH).alias("x"))
    return own.select("doc_id", quality.wants_short_term(c).alias("short_term"), quality.wants_long_term(c).alias("long_term"), quality.wants_temporary(c).alias("temporary"), quality.wants_shared(c).alias("shared"))


_ASKED = """concat(CASE doc_id % 3 WHEN 0 THEN 'Bright ' WHEN 1 THEN 'quiet modern ' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN concat(doc_id % 5 + 1, '.5-room flat') WHEN 1 THEN concat(doc_id % 5 + 1, ' bedroom flat') WHEN 2 THEN concat(doc_id % 5 + 1, ' Zimmer') ELSE 'flat' END,
    CASE doc_id % 5 WHEN 0 THEN ' in Zürich' WHEN 1 THEN ' in Geneva' WHEN 2 THEN ' in Lugano' WHEN 3 THEN ' in st. gallen' ELSE '' END, CASE doc_id % 2 WHEN 0 THEN concat(' under CHF ', 1000 + doc_id % 30 * 100) ELSE '' END,
    CASE doc_id % 7 WHEN 0 THEN ', with garage' WHEN 1 THEN ', ideally with garage' WHEN 2 THEN ', lift and balcony' ELSE '' END, CASE doc_id % 11 WHEN 0 THEN ', cheap' WHEN 1 THEN ', luxury' ELSE '' END,
    CASE doc_id % 6 WHEN 0 THEN ', at least 60 m2' WHEN 1 THEN ', at most 90 sqm' ELSE '' END, CASE doc_id % 13 WHEN 0 THEN ' close to ETH' WHEN 1 THEN ' near Lac Léman, please' ELSE '' END)"""


@query(
    """SELECT doc_id AS query_id, CASE doc_id % 5 WHEN 0 THEN 'Zürich' WHEN 1 THEN 'Genève' WHEN 2 THEN 'Lugano' WHEN 3 THEN 'St. Gallen' END AS city, CASE doc_id % 5 WHEN 0 THEN 'ZH' WHEN 1 THEN 'GE' END AS canton, CASE WHEN doc_id % 2 = 0 THEN 1000 + doc_id % 30 * 100 END::INT AS max_price,
    (doc_id % 5 + CASE doc_id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 2 WHEN 2 THEN 1 END)::DOUBLE AS min_rooms, CASE WHEN doc_id % 6 = 0 THEN 60 END::INT AS min_area, CASE WHEN doc_id % 6 = 1 THEN 90 END::INT AS max_area, CASE doc_id % 7 WHEN 0 THEN 'garage' WHEN 2 THEN 'balcony,elevator' END AS features,
    concat_ws(',', CASE doc_id % 3 WHEN 0 THEN 'bright' WHEN 1 THEN 'modern,quiet' END, CASE WHEN doc_id % 7 = 2 THEN 'balcony or terrace' END) AS descriptors, CASE doc_id % 11 WHEN 0 THEN 'cheap' WHEN 1 THEN 'premium' END AS price_intent, CASE doc_id % 13 WHEN 0 THEN 'ETH' WHEN 1 THEN 'Lac Léman' ELSE '' END AS anchors,
    concat_ws(',', 'bm25', CASE WHEN doc_id % 3 = 0 THEN 'brightness' END, 'dense_text', 'feature_match', CASE WHEN doc_id % 13 < 2 THEN 'geo_anchor' END, CASE WHEN doc_id % 3 = 1 THEN 'modernity' END, CASE WHEN doc_id % 11 < 2 THEN 'price_band' END) AS weights FROM documents"""
)
def heuristic_intent(spark, sf_dir):
    said = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(",", c)).alias(c)
    out = intent.understand(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.expr(_ASKED).alias("raw_query")))
    return out.select("query_id", said("city"), "canton", "max_price", "min_rooms", "min_area", "max_area", said("features"), said("descriptors"), "price_intent", said("anchors"), F.concat_ws(",", F.array_sort(F.map_keys("weights"))).alias("weights"))


_TOLD = "k % 5 = 0 AS zurich, CASE WHEN k % 2 = 0 THEN 1000 + k % 30 * 100 END::INT AS max_price, k % 3 = 0 AS bright, k % 3 = 1 AS quiet, CASE k % 11 WHEN 0 THEN 'cheap' WHEN 1 THEN 'premium' END AS price_intent"


@query(
    f"""WITH a AS (SELECT doc_id, doc_id % 40 AS k, doc_id % 13 = 5 AS nothing FROM documents), n AS (SELECT count(DISTINCT k) FILTER (NOT nothing AND doc_id % 2 = 0) AS once, count(DISTINCT k) FILTER (NOT nothing) AS every FROM a)
    SELECT doc_id AS query_id, CASE WHEN NOT nothing AND zurich THEN 'Zürich' END AS city, CASE WHEN NOT nothing THEN max_price END AS max_price, NOT nothing AND bright AS bright, NOT nothing AND quiet AS quiet, CASE WHEN NOT nothing THEN price_intent END AS price_intent, once, every FROM (SELECT *, {_TOLD} FROM a), n"""
)
def intent_cache(spark, sf_dir):
    """Texts that many documents share, asked in two batches; how many were understood after each."""
    raw = F.when(F.col("doc_id") % 13 == 5, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.expr(_ASKED.replace("doc_id", "(doc_id % 40)")), F.lit("\n")))
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), raw.alias("raw_query"))
    cache = IntentCache(spark, new_folder(spark))
    cache.understand(own.where("query_id % 2 = 0"))
    counts = []
    for name in ("once", "every"):
        out = cache.understand(own) if name == "every" else None
        known = cache._known(cache.log.read()[1])
        counts.append(known.agg(F.count("*").alias(name)))
    facts = soft_facts(out).select("query_id", F.col("soft.bright"), F.col("soft.quiet"), F.col("soft.price_intent"))
    zurich = out.select("query_id", F.when(F.array_contains("city", "Zürich"), "Zürich").alias("city"), "max_price")
    return zurich.join(facts, "query_id").join(counts[0], F.lit(True)).join(counts[1], F.lit(True)).select("query_id", "city", "max_price", "bright", "quiet", "price_intent", "once", "every")


_WANTED = [f"CASE WHEN doc_id % 4 = 0 THEN concat(' ', upper({_pick([*_CITIES, 'Thun'], 'doc_id')}), ' ') ELSE {_pick([*_CITIES, 'Thun'], 'doc_id')} END", f"CASE WHEN doc_id % 3 = 0 THEN {_pick([*_CITIES, 'Bern'], 'doc_id * 7 + 2')} ELSE ' ' END", "CASE WHEN doc_id % 6 = 0 THEN 'Seefeld' ELSE '' END"]
_CODES = "(VALUES " + ", ".join(f"({_quoted(k)}, {v[1]})" for k, v in V.DISTRICTS.items()) + ")"


@query(
    f"""WITH n AS (SELECT doc_id, unnest([1, 2, 3]) AS pos, trim(unnest([{', '.join(_WANTED)}])) AS name FROM documents), c AS (SELECT doc_id, pos, coalesce(b.city, n.name) AS city, codes FROM n LEFT JOIN {_pairs(_CITIES)} b(name, city) ON b.name = lower(n.name) LEFT JOIN {_CODES} z(name, codes) ON z.name = lower(n.name) WHERE n.name <> ''),
    g AS (SELECT doc_id, city, min(pos) AS pos FROM c GROUP BY 1, 2), cities AS (SELECT doc_id, count(*) AS n, string_agg(city, ',' ORDER BY pos) AS city FROM g GROUP BY 1),
    u AS (SELECT doc_id, code, min(pos * 10 + i) AS pos FROM (SELECT doc_id, pos, unnest(codes) AS code, unnest(range(len(codes))) AS i FROM c WHERE codes IS NOT NULL) GROUP BY 1, 2), posts AS (SELECT doc_id, string_agg(code, ',' ORDER BY pos) AS codes FROM u GROUP BY 1)
    SELECT d.doc_id AS query_id, cities.city, CASE WHEN d.doc_id % 9 = 0 THEN '2500' WHEN cities.n = 1 THEN posts.codes END AS postal_code, (d.doc_id % 4 + 1 + CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS min_rooms FROM documents d LEFT JOIN cities USING (doc_id) LEFT JOIN posts USING (doc_id)"""
)
def intent_assembly(spark, sf_dir):
    k = F.col("doc_id")
    bedrooms = F.concat((k % 4 + 1).cast("string"), F.lit(" bedrooms"))
    own = _intents(read(spark, sf_dir, "documents"), {"query_id": k, "raw_query": bedrooms, "language": F.when(k % 2 == 0, "en").otherwise("de"), "city": F.array(*map(_spark, _WANTED)), "postal_code": F.when(k % 9 == 0, F.array(F.lit("2500"))), "min_rooms": k % 4 + 1})
    said = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(",", c)).alias(c)
    return intent.assemble(own).select("query_id", said("city"), said("postal_code"), "min_rooms")


@query(
    """SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'Bern' ELSE p_brand END AS city, CASE WHEN p_partkey % 5 < 2 THEN 'ZH' ELSE 'GE' END AS canton, CASE WHEN p_partkey % 2 = 0 THEN p_size * 100 ELSE 900 END::INT AS max_price,
    (CASE WHEN p_partkey % 4 = 0 THEN 7 WHEN p_partkey % 7 = 0 THEN 3 ELSE 2.5 END)::DOUBLE AS min_rooms FROM part"""
)
def intent_reconcile(spark, sf_dir):
    """Of each part two intents; the first has gaps, and English ones name two bedrooms."""
    k, own = F.col("p_partkey"), read(spark, sf_dir, "part")
    first = _intents(own, {"query_id": k, "raw_query": F.lit("2 bedrooms"), "language": F.when(k % 7 == 0, "en").otherwise("de"), "city": F.when(k % 3 == 0, F.array(F.lit("Bern"))).when(k % 3 == 1, F.array().cast("array<string>")), "canton": F.when(k % 5 == 0, "ZH").when(k % 5 == 1, "ZH").when(k % 5 == 2, ""), "max_price": F.when(k % 2 == 0, F.col("p_size") * 100), "min_rooms": F.when(k % 4 == 0, 7.0)})
    second = _intents(own, {"query_id": k, "city": F.array("p_brand"), "canton": F.lit("GE"), "max_price": F.lit(900), "min_rooms": F.when(k % 7 == 0, 2.0).otherwise(2.5)})
    return intent.reconcile(first, second).select("query_id", F.concat_ws(",", "city").alias("city"), "canton", "max_price", "min_rooms")


# ---- Weights ----

_HINTS = {"bm25": "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END", "dense_text": "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 7 AS DOUBLE) / 10 - 0.1 END", "brightness": "CASE WHEN doc_id % 5 = 0 THEN CAST(0.2 AS DOUBLE) END", "modernity": "CASE WHEN doc_id % 5 < 2 THEN CAST(0.9 AS DOUBLE) END", "geo_anchor": "CASE WHEN doc_id % 4 = 1 THEN CAST(0.5 AS DOUBLE) END", "transit": "CASE WHEN doc_id % 6 = 0 THEN CAST(3 AS DOUBLE) END"}
_FLAGS = {"vlm_active": "doc_id % 8 < 3", "near_public_transport": "doc_id % 3 < 2", "near_schools": "doc_id % 10 = 1", "family_friendly": "doc_id % 10 = 2"}


def _hinted(spark, sf_dir) -> DataFrame:
    hints = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, _HINTS)), F.array(*map(F.expr, _HINTS.values()))), lambda k, v: v.isNotNull())
    rest = {"query_id": "doc_id", "language": F.when(F.col("doc_id") % 3 == 0, "de").otherwise("unknown"), "price_intent": F.when(F.col("doc_id") % 9 == 0, "cheap"), "anchors": F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("ETH")))}
    return _intents(read(spark, sf_dir, "documents"), {k: F.expr(v) for k, v in _FLAGS.items()} | rest | {"weights": hints})


def _weights_sql(overrides: str = "") -> str:
    """Raw weights by gates and hints, then their shares; over (name, text) are laid over them."""
    hints = ", ".join(f"{v} AS h_{k}" for k, v in _HINTS.items())
    flags = ", ".join(f"{v} AS {k}" for k, v in _FLAGS.items())
    up = lambda c: f"greatest(0, {c})"
    visual = "greatest(coalesce(h_brightness, 0), coalesce(h_modernity, 0))"
    raw = {
        "dense": f"CASE WHEN NOT vlm_active AND {visual} > 0 THEN greatest(coalesce({up('h_dense_text')}, 0), 0.35E0 + 0.5E0 * {visual}) ELSE coalesce(CASE WHEN h_dense_text IS NOT NULL THEN {up('h_dense_text')} END, 0.35E0) END",
        "bm25": f"coalesce(CASE WHEN h_bm25 IS NOT NULL THEN {up('h_bm25')} END, 0.2E0)",
        "vlm": "CASE WHEN vlm_active THEN coalesce(greatest(h_brightness, h_modernity), 0.2E0) ELSE 0 END",
        "geo_transit": "CASE WHEN near_public_transport THEN coalesce(h_transit, 0.1E0) ELSE 0 END",
        "geo_school": "CASE WHEN near_schools OR family_friendly THEN 0.05E0 ELSE 0 END",
        "geo_anchor": "CASE WHEN doc_id % 7 = 0 OR coalesce(h_geo_anchor, 0) > 0 THEN coalesce(h_geo_anchor, 0.15E0) ELSE 0 END",
        "price_band": "CASE WHEN doc_id % 9 = 0 THEN 0.1E0 ELSE 0 END",
        "lang_match": "CASE WHEN doc_id % 3 = 0 THEN 0.05E0 ELSE 0 END",
    }
    given = {"dense": "CAST(doc_id % 5 AS DOUBLE) / 4", "vlm": "0E0"} if overrides else {}
    own = ", ".join(f"({given.get(k, v)})::DOUBLE AS r_{k}" for k, v in raw.items())
    total = " + ".join(f"r_{k}" for k in raw)
    rest = sum(V.SIGNALS[k] for k in V.ALWAYS_ON)
    share = lambda k: f"CASE WHEN {total} > 0 THEN r_{k} / ({total}) ELSE {V.SIGNALS[k] / rest if k in V.ALWAYS_ON else 0.0}::DOUBLE END"
    return f"WITH h AS (SELECT doc_id, {hints}, {flags} FROM documents), r AS (SELECT doc_id, {own} FROM h) SELECT doc_id AS query_id, {', '.join(f'round({share(k)}, 6) AS {k}' for k in raw)} FROM r"


@query(_weights_sql())
def weights_resolved(spark, sf_dir):
    return weights.with_weights(_hinted(spark, sf_dir)).select("query_id", *(F.round(f"w_{k}", 6).alias(k) for k in V.SIGNALS))


@query(_weights_sql("given"))
def weight_overrides(spark, sf_dir):
    """Weights given by hand go last: a number for dense, none that counts for bm25, one below 0 for vlm."""
    said = F.concat(F.lit("dense="), (F.col("query_id") % 5 / 4).cast("string"), F.lit(", bm25=x,vlm=-3"))
    return weights.with_weights(_hinted(spark, sf_dir), weights.parse_overrides(said)).select("query_id", *(F.round(f"w_{k}", 6).alias(k) for k in V.SIGNALS))


_SOFT = {"bright": 2, "modern": 3, "new_build": 5, "nice_views": 7, "balcony_or_terrace": 11, "spacious": 13, "near_public_transport": 4, "family_friendly": 9, "near_schools": 8}


@query(
    """SELECT doc_id AS query_id, concat_ws(',', 'bm25=0.4', CASE WHEN doc_id % 2 = 0 THEN 'brightness=0.9' END, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'clip_image=0.75' WHEN doc_id % 6 = 0 THEN 'clip_image=0.6' END, 'dense_text=0.6', CASE WHEN doc_id % 9 = 0 OR doc_id % 8 = 0 THEN 'feature_match=0.6' END,
    CASE WHEN doc_id % 10 = 0 THEN 'geo_anchor=0.9' END, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'modernity=0.8' END, CASE WHEN doc_id % 14 = 0 THEN 'price_band=0.75' END, CASE WHEN doc_id % 4 = 0 THEN 'transit=0.8' END) AS weights FROM documents"""
)
def weights_derived(spark, sf_dir):
    k = F.col("doc_id")
    given = {f: k % n == 0 for f, n in _SOFT.items()} | {"query_id": k, "descriptors": F.when(k % 6 == 0, F.array(F.lit("cosy"))), "anchors": F.when(k % 10 == 0, F.array(F.lit("ETH"))), "price_intent": F.when(k % 14 == 0, "mid")}
    said = F.transform(F.array_sort(F.map_entries(weights.derived_weights())), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _intents(read(spark, sf_dir, "documents"), given).select("query_id", F.concat_ws(",", said).alias("weights"))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat_ws(' ', lang, 'airy') WHEN {' OR '.join(f"contains(lower(q), {_quoted(w)})" for w in V.VISUAL_WORDS)} THEN q END AS prompt FROM (SELECT doc_id, lang, split_part(text, chr(10), 1) AS q FROM documents)"""
)
def visual_prompt(spark, sf_dir):
    """Descriptors of every fourth document, else its first line if that has a visual word."""
    said = F.when(F.col("doc_id") % 4 == 0, F.array("lang", F.lit("airy"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "documents").select("doc_id", signals.visual_prompt(F.split_part("text", F.lit("\n"), F.lit(1)), said).alias("prompt"))


@query(
    f"""WITH {L}, q AS (SELECT n_nationkey::BIGINT AS query_id, n_name FROM nation), own AS (SELECT query_id, price FROM L JOIN q ON city = n_name), s AS (SELECT query_id, stage, count(*) FILTER (stage = 'city' OR price < 1000) AS n FROM own, (VALUES ('city'), ('price')) t(stage) GROUP BY 1, 2)
    SELECT q.query_id, t.stage, coalesce(n, 0)::BIGINT AS rows, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS state FROM q CROSS JOIN (VALUES ('city'), ('price')) t(stage) LEFT JOIN s ON s.query_id = q.query_id AND s.stage = t.stage"""
)
def stage_trace(spark, sf_dir):
    """Nations as queries: listings of that city, and of those the cheap ones."""
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), "n_name")
    own = listings(spark, sf_dir).join(asked, F.col("city") == F.col("n_name")).select("query_id", "price")
    return ranking.stage_trace({"city": own, "price": own.where("price < 1000")}, asked)
