"""BM25 as three tables, postings, document and term statistics, and scoring as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.text import tokens
from millrace.sources.stores import written


def corpus_text() -> Column:
    """A listing's non-empty fields, one a line."""
    return F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "city", "canton", "object_category", "object_type", "description")))


def embedding_text() -> Column:
    """Title; city and canton; rooms, price and category; description: blocks with a blank line between."""
    part = lambda pre, c, post: F.when(F.col(c).isNotNull(), F.concat(F.lit(pre), F.col(c).cast("string"), F.lit(post)))
    place = F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("canton", F.lit("")))
    facts = F.concat_ws(" · ", part("", "rooms", " rooms"), part("CHF ", "price", "/mo"), F.nullif("object_category", F.lit("")))
    return F.concat_ws("\n\n", *(F.nullif(c, F.lit("")) for c in (F.col("title"), place, facts, F.col("description"))))


#: Rows of the words of one batch of queries that are broadcast; more of them meet postings by an exchange.
MOST_ASKED = 100_000


class Bm25Index:
    """postings (doc_id, term, tf), docs (doc_id, dl), terms (term, df, idf), corpus (n, avgdl); queries are stemmed as the documents were."""

    def __init__(self, postings: DataFrame, docs: DataFrame, terms: DataFrame, corpus: DataFrame, stem=None):
        self.postings, self.docs, self.terms, self.corpus, self.stem = postings, docs, terms, corpus, stem

    def save(self, path: str) -> None:
        for name in ("postings", "docs", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, stem=None) -> Bm25Index:
        """stem as it was when the index was built."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms", "corpus")), stem)


def counted(documents: DataFrame, *, id: str, text: str, stem=None) -> DataFrame:
    """(doc_id, term, tf) by distinct ids; a document without a token has one row with a null term. A common word's postings are one row a document."""
    split = documents.select(F.col(id).alias("doc_id"), tokens(F.col(text), stem).alias("tokens"))
    return split.select("doc_id", F.explode_outer("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("term").alias("tf"))


def lengths(counts: DataFrame) -> DataFrame:
    """(doc_id, dl) of counted()."""
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def frequencies(counts: DataFrame) -> DataFrame:
    """(term, df) of counted()."""
    return counts.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def weighed(df: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms (term, df, idf) and corpus (n, avgdl) from document frequencies and lengths; an idf under 0 gives way to a share of the mean."""
    corpus = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = df.join(F.broadcast(corpus), how="cross").select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"))  # one row
    floor = raw.agg((F.avg("raw_idf") * V.BM25_EPSILON).alias("floor"))
    terms = raw.join(F.broadcast(floor), how="cross").select("term", "df", F.when(F.col("raw_idf") < 0, F.col("floor")).otherwise(F.col("raw_idf")).alias("idf"))  # one row
    return terms, corpus


def build_index(documents: DataFrame, *, id: str, text: str, stem=None) -> Bm25Index:
    """Statistics over all documents, by distinct ids; those without a token count too, with length 0.

    Texts are split once: the counts are written to the shared folder, and all else follows from them.
    Whole texts are exchanged by id, a third of what their words would be; rows that repeat an id meet in one task, which counts them as a stream.
    stem, such as stems.by_language, maps tokens to stems in the language that each text shows.
    """
    own = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id")
    counts = written(counted(own, id="doc_id", text="text", stem=stem))
    docs = lengths(counts)
    return Bm25Index(counts.where("term is not null"), docs, *weighed(frequencies(counts), docs), stem)


def asked_terms(queries: DataFrame, stem=None, text: str = "raw_query") -> DataFrame:
    """(query_id, term, times) of queries, stemmed in their language where they have such a column, else as German."""
    language = F.col("language") if "language" in queries.columns else F.lit("de")
    return queries.select("query_id", F.explode(tokens(F.col(text), stem, language)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def sent(asked: DataFrame, most: int | None = None) -> DataFrame:
    """asked, to be broadcast if it has no more rows than most; it is looked at while the plan is built."""
    most = MOST_ASKED if most is None else most
    return F.broadcast(asked) if len(asked.take(most + 1)) <= most else asked


def gain(tf: Column | None = None, dl: Column | None = None, idf: Column | None = None) -> Column:
    """What one occurrence of a word in a query adds to a document's score, beside a column avgdl; by default of columns tf, dl and idf."""
    k, b = V.BM25_K1, V.BM25_B
    tf, dl, idf = (F.col(name) if c is None else c for name, c in (("tf", tf), ("dl", dl), ("idf", idf)))
    return idf * tf * (k + 1) / (tf + k * (1 - b + b * dl / F.col("avgdl")))


def score(index: Bm25Index, queries: DataFrame, candidates: DataFrame | None = None, *, text: str = "raw_query") -> DataFrame:
    """(query_id, doc_id, bm25) over documents that share a term with the query; a term said twice counts twice.

    candidates (query_id, doc_id) are joined before anything is scored.
    """
    return _score(index, asked_terms(queries, index.stem, text), candidates)


def _score(index: Bm25Index, asked: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    hits = index.postings.join(sent(asked), "term")
    if candidates is not None:
        hits = hits.join(candidates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    hits = hits.join(index.terms, "term").join(F.broadcast(index.corpus), how="cross").join(index.docs, "doc_id")  # corpus: one row
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * gain()).alias("bm25"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, doc_id, bm25), scores as shares of the largest if that is over 0, ids breaking ties at nine decimals."""
    by = Window.partitionBy("query_id")
    top = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.round("bm25", 9)), "doc_id"))).where(F.col("rank") <= k)
    high = F.max("bm25").over(by)
    return top.withColumn("score", F.when(high > 0, F.col("bm25") / high).otherwise(F.col("bm25"))).select("query_id", "doc_id", "score", "rank")


def search(index: Bm25Index, queries: DataFrame, k: int, candidates: DataFrame | None = None, *, text: str = "raw_query") -> DataFrame:
    """The best k of each query. Without candidates, queries of the same words are one until theirs are found."""
    asked = asked_terms(queries, index.stem, text)
    if candidates is not None:
        return best(_score(index, asked, candidates), k)
    bags = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("bag"))  # a query's words
    alike = bags.select("query_id", F.min("query_id").over(Window.partitionBy("bag")).alias("first"))
    once = asked.join(alike.where("query_id = first"), "query_id", "left_semi")
    found = best(_score(index, once), k).withColumnRenamed("query_id", "first")
    return found.join(alike, "first").select("query_id", "doc_id", "score", "rank")
