"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import epsilon_join, langid, licenses, merkle, packing, quality_gam, quality_rules, repair, simhash, suffix_dedup, token_counts, url_filter, word_bpe
from millrace.llm.base import held_out, materialize, table

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.build_model(langid.labelled_sample(docs, ~held_out()))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.fit(*quality_gam.labelled_features(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return quality_gam.score_texts(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024)


def op4_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_join.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(quality_rules.counted(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    rules = quality_rules.fit_counted(counts, table(spark, sf_dir, "labels"), ~held_out())
    return quality_rules.judge_counted(counts, rules, keep=["doc_id"])


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]), 1024)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.shared_passages(table(spark, sf_dir, "documents"), least=50)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base, starts = F.filter("spans", lambda s: s["base"]), F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["word"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(F.col("spans")).alias("labels"), "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    leaf = lambda text: merkle.digest_of(c("doc_id"), c("source"), c("lang"), c("n_chars"), text)
    changed = (F.crc32(c("doc_id").cast("string")) % 3 == 0) & c("text").isNotNull()
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(c("text")).alias("leaf"), F.when(changed, leaf(F.translate("text", ASCII_UPPER, ASCII_UPPER.lower()))).alias("tampered"))
    found = merkle.manifest(rows, group="lang", order=["doc_id"], digest="leaf", carry=["doc_id", "leaf", "tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), c("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(c("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", c("folded_root") == c("root"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations"))).reports()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_language_id, op2_quality_gam, op3_packing, op4_epsilon_join, op5_simhash, op6_quality_rules, op7_word_bpe, op8_token_counts, op9_url_filter, op10_suffix_dedup, op11_license_scan, op12_merkle_manifest, op13_conversation_repair)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def _url_sql(rounds: int = 8, damping: float = 0.85, least: float = 0.5) -> str:
    """The rounds written out one by one."""
    rules = sorted(url_filter.RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    href = "(?i)href\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''\\s>]+)"
    ranks = "\n".join(
        f"""r{k} AS (SELECT kind, host, sum(v) AS v FROM (SELECT e.kind, e.dst AS host, {damping}::DOUBLE * e.share * r.v AS v FROM share e JOIN r{k - 1} r ON e.kind = r.kind AND e.src = r.host
          UNION ALL SELECT kind, host, {1 - damping:.2f}::DOUBLE * v FROM r0) GROUP BY 1, 2),"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH cut AS (SELECT page_id, html, coalesce(strpos(url, '://') > 0, false) AS there, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
    own AS (SELECT page_id, html, CASE WHEN there THEN {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} ELSE '' END AS host,
        CASE WHEN there THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
    ruled AS (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM own),
    links AS (SELECT host AS src, {lower.format("u")} AS dst, count(*) AS n FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS u FROM own WHERE host <> '') GROUP BY 1, 2),
    edge AS (SELECT 'trust' AS kind, src, dst, n FROM links WHERE src <> dst AND dst <> '' UNION ALL SELECT 'distrust', dst, src, n FROM links WHERE src <> dst AND dst <> ''),
    share AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM edge),
    r0 AS (SELECT kind, host, avg(v) AS v FROM (SELECT unnest(['trust', 'distrust']) AS kind, host, unnest([CASE WHEN by_rule = 'allow' THEN 1E0 ELSE 0E0 END, CASE WHEN by_rule = 'block' THEN 1E0 ELSE 0E0 END]) AS v FROM ruled WHERE host <> '') GROUP BY 1, 2 HAVING avg(v) > 0),
    {ranks}
    bad AS (SELECT host FROM r{rounds} GROUP BY host HAVING round(coalesce(sum(CASE WHEN kind = 'distrust' THEN v END), 0) - coalesce(sum(CASE WHEN kind = 'trust' THEN v END), 0), 9) >= {(1 - damping) * least:.4f})
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


def _tree_sql(name: str, leaves: str, levels: int, fan: int = 8) -> str:
    """Levels name0.. and, for each leaf (g, i), the steps name_s0..: leaves has g, i, n, h and f, the digest to fold."""
    out = [f"{name}0 AS MATERIALIZED (SELECT g, i, n, h FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}_r{k} AS MATERIALIZED (SELECT g, i // {fan} AS r, list(h ORDER BY i) AS hs, (max(n) + {fan - 1}) // {fan} AS n FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, r AS i, n, sha256(array_to_string(hs, '')) AS h FROM {name}_r{k})")
    out.append(f"{name}_top AS MATERIALIZED ({' UNION ALL '.join(f'SELECT g, h FROM {name}{k} WHERE n = 1' for k in range(levels + 1))})")
    return ",\n    ".join(out)


def _fold_sql(name: str, runs: str, start: str, levels: int, fan: int = 8) -> str:
    """Steps from start (id, g, i, f, p): f folded and p, the siblings, carried up through each level's runs."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        at = f"((i // {fan**k}) % {fan})::INT"
        left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN hs IS NULL THEN p ELSE p || {left} || {right} END AS p) FROM {name}{k} s LEFT JOIN {runs}_r{k} r ON r.g = s.g AND r.r = s.i // {fan ** (k + 1)})")
    return ",\n    ".join(out)


def _merkle_sql(levels: int = 7, over: int = 3) -> str:
    """Trees of up to 8 ** levels documents a language and 8 ** over languages."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"translate(text, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
    return f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS h, {leaf(lower)} AS low,
        xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda j: ascii(CAST(doc_id AS VARCHAR)[j])::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS changed FROM documents, tab),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
    {_tree_sql("l", "placed", levels)},
    langs AS MATERIALIZED (SELECT '' AS g, g AS own, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM l_top),
    {_tree_sql("o", "langs", over)},
    {_fold_sql("s", "l", "SELECT id, g, i, CASE WHEN changed THEN low ELSE h END AS f, '' AS p FROM placed", levels)},
    {_fold_sql("u", "o", f"SELECT s.id, '' AS g, langs.i, s.f, s.p FROM s{levels} s JOIN langs ON langs.own = s.g", over)}
    SELECT placed.doc_id, placed.h AS leaf, l_top.h AS subroot, o_top.h AS root, sha256(u.p) AS proof_sha256, u.f AS folded_root, u.f = o_top.h AS verified
    FROM placed JOIN u{over} u USING (id) JOIN l_top ON l_top.g = placed.g, o_top"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_merkle_manifest": _merkle_sql(),
        "op4_epsilon_join": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND list_bool_and(list_transform(embedding, lambda y: y IS NOT NULL AND isfinite(y))) AND list_bool_or(list_transform(embedding, lambda y: y <> 0))),
          link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
          reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
          SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
          FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = e.vec_id""",
        "op9_url_filter": _url_sql(),
    }
