"""Stored retrievers (V6, S8, S9, S10): a versioned folder of the tables a search
needs, checked when it is read.

    <root>/version=<n>/postings   (doc_id, token, tf, dl), bucketed by doc_id
    <root>/version=<n>/weights    (token, weight): IDF or learned weights
    <root>/version=<n>/manifest   one JSON line, written last

A version without a manifest was not finished and is never read; saving again
takes the next number and replaces what such a version left.  The manifest holds
the kind of the scorer, its parameters (beta, text options, batch size of the
average length) and the counts that the tables are checked against.

Queries against a stored retriever read its postings through a table definition
with the same buckets, in any session, and are searched by block maxima: no row per
(query, document) is made.  Only queries of a learned retriever with fewer than k
documents above 0 list all documents that share a token, as the others compete
with score 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.operators import block_max as BM
from lexkit.operators import lexical as L
from lexkit.operators.windows import top_k_per_key
from lexkit.session import materialize, shuffle_partitions

KINDS = ("bm25", "learned")
TEXT_OPTIONS = ("lower", "normalize", "max_len")


@dataclass
class Retriever:
    """Postings with the weights and parameters of one scorer."""

    kind: str
    posts: DataFrame
    weights: DataFrame                      # (token, weight)
    n_docs: int
    avgdl: float
    beta: float = 0.0
    options: dict = field(default_factory=dict)
    version: int | None = None
    dealt: bool = False                     # the plan of the postings ends dealt by doc_id

    def search(self, queries: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, text)."""
        terms = L.query_terms(queries, **{o: self.options[o] for o in TEXT_OPTIONS if o in self.options})
        stats = L.CorpusStats(F.lit(float(self.n_docs)), F.lit(self.avgdl))
        weights = L.learned_query_weights(terms, self.weights)
        factor = L.bm25_doc_term(stats) if self.kind == "bm25" else L.learned_doc_term(self.beta)
        # one more, in case the query's own document is left out
        scored = BM.scored_pairs(BM.block_index(self.posts, stats=stats, factor=factor), weights, k + 1)
        if self.kind == "learned":          # weights may be negative: unscored documents count 0
            scored = self._with_zeros(scored, queries, weights, factor, k + 1)
        return top_k_per_key(L.without_own(scored, exclude_self), k)


    def _with_zeros(self, best: DataFrame, queries: DataFrame, weights: DataFrame, factor: Column, k: int) -> DataFrame:
        """``best`` (with every query's k best scored documents), where queries with fewer
        than k scores above 0 have all their scores and the documents without."""
        best = materialize(top_k_per_key(best, k).select("query_id", "doc_id", "score"))
        up = best.filter("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("up")).filter(F.col("up") >= k)
        few = materialize(queries.select("query_id").distinct().join(up, "query_id", "left_anti"))
        if few.isEmpty():
            return best
        weights = materialize(weights.join(few, "query_id", "left_semi"))
        scored = L.score(self.posts, weights, factor, L.query_side_is_small(weights))
        return best.join(few, "query_id", "left_anti").unionByName(L.with_zeros(scored, few, self.posts, k))


def build_retriever(corpus: DataFrame, kind: str, weights: DataFrame | None = None, beta: float = 0.0, *,
                    doc_title: str | None = None, lower: bool = True, normalize: bool = False,
                    max_len: int | None = None, toks: DataFrame | None = None) -> Retriever:
    """A retriever over (doc_id, [title,] text).  Without ``weights`` a BM25 retriever
    takes the IDF of its own postings; given ones may come from another corpus
    (a sampled statistics job, S8).  With weights and the written tokens of the
    corpus (``toks``: doc_id, tokens, dl) the postings are left to be written by
    ``save_retriever``, once."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if kind == "learned" and weights is None:
        raise ValueError("a learned retriever needs weights")
    if toks is not None and weights is not None:
        posts, docs = L.postings_from_tokens(toks, True), toks
    else:
        posts = docs = L.written_postings(corpus, doc_title=doc_title, lower=lower, normalize=normalize, max_len=max_len)
    lengths = docs.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    n, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    if weights is None:
        weights = L.idf_table(posts, F.lit(float(n))).select("token", F.col("idf").alias("weight"))
    return Retriever(kind, posts, weights.select("token", "weight"), n, avgdl or 0.0, beta,
                     {"lower": lower, "normalize": normalize, "max_len": max_len}, dealt=docs is toks)


def _manifests(spark: SparkSession, root: str) -> dict[int, dict]:
    """Finished versions: number -> manifest."""
    try:
        rows = spark.read.text(f"{root}/version=*/manifest").select("value").collect()
    except AnalysisException:
        return {}
    read = [json.loads(r["value"]) for r in rows]
    return {m["version"]: m for m in read}


def save_retriever(r: Retriever, root: str) -> int:
    """Write the next version; the manifest goes last.  Returns its number."""
    spark = r.posts.sparkSession
    version = max(_manifests(spark, root), default=0) + 1
    path = f"{root}/version={version}"
    buckets = shuffle_partitions(spark)
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    posts = r.posts.select("doc_id", "token", "tf", "dl")
    ((posts if r.dealt else posts.repartition(buckets, "doc_id")).write.mode("overwrite")
        .option("path", f"{path}/postings").bucketBy(buckets, "doc_id").saveAsTable(name))
    r.weights.write.mode("overwrite").parquet(f"{path}/weights")
    posts, weights = spark.read.parquet(f"{path}/postings").count(), spark.read.parquet(f"{path}/weights").count()
    manifest = {"version": version, "kind": r.kind, "beta": r.beta, "n_docs": r.n_docs, "avgdl": r.avgdl, "options": r.options,
                "buckets": buckets, "postings": posts, "weights": weights, "doc_id": dict(r.posts.dtypes)["doc_id"]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(f"{path}/manifest")
    return version


def _table_name(path: str) -> str:
    return "lexkit_store_" + "".join(c if c.isalnum() else "_" for c in path)[-80:].lower()


def load_retriever(spark: SparkSession, root: str, kind: str, version: int | str = "latest") -> Retriever:
    """The latest (or a given) finished version of that kind, checked against its
    manifest: both tables have as many rows as were written, and no posting lacks
    a document."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    found = {v: m for v, m in _manifests(spark, root).items() if m["kind"] == kind and version in ("latest", v)}
    if not found:
        raise FileNotFoundError(f"no finished {kind} retriever (version {version}) under {root}")
    m = found[max(found)]
    path = f"{root}/version={m['version']}"
    name = _table_name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (doc_id {m['doc_id']}, token STRING, tf BIGINT, dl INT) USING parquet "
              f"CLUSTERED BY (doc_id) INTO {m['buckets']} BUCKETS LOCATION '{path}/postings'")
    posts, weights = spark.table(name), spark.read.schema("token string, weight double").parquet(f"{path}/weights")
    rows, unnamed = posts.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if (rows, weights.count()) != (m["postings"], m["weights"]) or unnamed:
        raise AssertionError(f"{path} does not hold what its manifest says")
    return Retriever(kind, posts, weights, m["n_docs"], m["avgdl"], m["beta"], m["options"], m["version"])
