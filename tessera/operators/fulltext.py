"""Keyword search: BM25 over the words of texts, all terms required; by a scan, or by a stored index of postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import runtime
from tessera.functions.text import words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, terms: list[str], within=None, tokens=words) -> DataFrame:
    """id and score of the documents (`id, text`) that hold every term.

    Term counts are taken within each row, so no posting is exploded or shuffled; what is gathered is one row of
    statistics, over all documents even if `within` (a condition on other columns) narrows the hits. Without terms
    nothing matches; null texts have no words; repeated terms count once.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    w = docs.withColumn("_w", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")))
    tf = [F.size(F.filter("_w", _equals(t))) for t in terms]
    counted = w.select("id", (within if within is not None else F.lit(True)).alias("_in"), F.size("_w").alias("_dl"), *[c.alias(f"_tf{i}") for i, c in enumerate(tf)])
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_av"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))])
    hits = counted.filter(F.col("_in"))
    for i in range(len(terms)):
        hits = hits.filter(F.col(f"_tf{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, n = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.ln((F.col("_n") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_av")))
    return hits.join(F.broadcast(stats)).select("id", score.alias("score"))


def bm25_many(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Set-wise search: qid, id and score for many queries (`qid, term`, a bounded set) in one pass over the words.

    The words of documents are cut down to the queries' terms by a broadcast before they are counted; statistics are
    over all documents.
    """
    q = queries.select("qid", F.lower("term").alias("term")).distinct()
    need = q.groupBy("qid").agg(F.count("*").alias("need"))
    w = docs.select("id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    size = w.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("av"))
    terms = F.broadcast(q.select("term").distinct())
    tf = w.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    j = tf.join(df, "term").join(F.broadcast(size)).join(F.broadcast(q), "term")
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("av")))
    return j.groupBy("qid", "id").agg(F.sum(part).alias("score"), F.count("*").alias("have")).join(need, "qid").filter("have = need").select("qid", "id", "score")


@dataclass
class Index:
    """An inverted index: `postings` (term, id, tf, dl, df), in files of successive terms (a search reads those whose
    statistics hold its terms), and the number and mean length of all documents."""

    postings: DataFrame
    n: int
    mean: float

    @staticmethod
    def stored(spark: SparkSession, name: str, source: str, docs, tokens=words) -> Index:
        """The index of `docs()` (`id, text`), built where `source` has changed since."""

        def cut() -> DataFrame:
            return docs().select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))

        def postings() -> DataFrame:
            p = cut().select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
            p = runtime.materialise(p, "postings")
            df = p.groupBy("term").agg(F.count("*").alias("df"))
            # terms in ranges, a common one over several of them
            return p.join(runtime.broadcast_if_small(df), "term").repartitionByRange("term", "id").sortWithinPartitions("term", "id")

        def sizes() -> DataFrame:
            return cut().select(F.size("w").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("av"))

        r = runtime.stored(spark, f"sizes-{name}", source, sizes).first()
        return Index(runtime.stored(spark, f"postings-{name}", source, postings), r.n, r.av)

    def search(self, queries: dict[str, list[str]]) -> DataFrame:
        """qid, id and score of the documents that hold every term of a query; a query without terms finds nothing.

        Document frequencies are those of the whole index; what a caller narrows the hits by comes after.
        """
        need = {q: list(dict.fromkeys(x.lower() for x in ts)) for q, ts in queries.items()}
        terms = sorted({t for ts in need.values() for t in ts})
        if not terms:
            return self.postings.sparkSession.createDataFrame([], f"qid string, id {dict(self.postings.dtypes)['id']}, score double")
        tf, df = F.col("tf"), F.col("df")
        idf = F.greatest(F.ln((F.lit(self.n) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(self.mean)))
        asking = [F.when(F.col("term").isin(*ts), F.struct(F.lit(q).alias("qid"), F.lit(len(ts)).alias("need"))) for q, ts in need.items() if ts]
        hits = self.postings.filter(F.col("term").isin(*terms)).select("id", part.alias("part"), F.explode(F.array_compact(F.array(*asking))).alias("q"))
        return hits.groupBy("q.qid", "q.need", "id").agg(F.sum("part").alias("score"), F.count("*").alias("have")).filter("have = need").select("qid", "id", "score")
