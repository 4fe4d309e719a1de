"""Postings, corpus statistics and lexical scoring.

Data model: a document is a row; its bag of words is the postings table
(doc_id, token, tf, dl) with one row per distinct token of the document.  A
query is (query_id, token) with one row per distinct query token (presence).

score(q, d) = sum over shared tokens t of  w(t) * g(tf(d, t), dl(d)),
with g = BM25 tf saturation (F8) and w = IDF for BM25, or g = tf/(tf+e^beta)
(F9) and w = the learned weight for the learned scorer.

Physical plan of ``score``: postings stream through a broadcast hash join with
the (size-checked) query-term table on ``token`` -- the postings side is never
shuffled by token, so frequent tokens cause no skew -- then a partial
aggregate on (query, doc) before the shuffle, then the per-query top-k, whose
partial WindowGroupLimit runs before the second shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexkit.functions import scoring as S
from lexkit.functions.arrays import chunk
from lexkit.functions import text as T
from lexkit.operators.joins import MAX_BROADCAST_ROWS, bounded_broadcast
from lexkit.operators.windows import assign_batches, ordered_index, top_k_per_key
from lexkit.session import materialize as _materialize


def analyze(text, lower: bool = True, normalize: bool = False, max_len: int | None = None) -> Column:
    """P2 -> F3 -> P8: the token list of a text column."""
    t = T.preprocess(text, normalize=normalize, lower=lower)
    return T.truncate(T.simple_tokenize(t, uncased=False), max_len)


def doc_tokens(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               title_col: str | None = None, lower: bool = True, normalize: bool = False,
               max_len: int | None = None) -> DataFrame:
    """(doc_id, tokens, dl): tokens of P1(title, text); dl = number of tokens."""
    txt = T.title_text(title_col, text_col) if title_col else F.col(text_col)
    return (corpus.select(F.col(id_col).alias("doc_id"), analyze(txt, lower, normalize, max_len).alias("tokens"))
                  .withColumn("dl", F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))))


def titled_tokens(toks: DataFrame, title_col: str = "title", lower: bool = True) -> DataFrame:
    """(doc_id, tokens, dl) of P1(title, text) from (doc_id, title, tokens of the text):
    the blank between title and text keeps their tokens apart."""
    none = F.array().cast("array<string>")
    both = F.concat(analyze(F.col(title_col), lower), F.coalesce(F.col("tokens"), none))
    return (toks.select("doc_id", F.when(F.coalesce(F.length(title_col), F.lit(0)) > 0, both).otherwise(F.col("tokens")).alias("tokens"))
                .withColumn("dl", F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))))


def postings(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             title_col: str | None = None, lower: bool = True, normalize: bool = False,
             max_len: int | None = None) -> DataFrame:
    """A1 + A5: (doc_id, token, tf, dl).  The count is a partial aggregate inside
    the scan stage (all tokens of a document are in one partition), so only
    postings rows cross the shuffle."""
    return postings_from_tokens(doc_tokens(corpus, id_col, text_col, title_col, lower, normalize, max_len))


def postings_from_tokens(toks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(doc_id, tokens, dl) -> (doc_id, token, tf, dl), hash-partitioned by doc_id.

    With ``keep_empty`` a document without tokens has one row (token null, tf 0),
    so the corpus statistics taken from the postings count it.

    The token arrays (one compact row per document) cross one shuffle keyed by
    doc_id; the tf count then runs in place, and every later aggregate keyed by
    (query, doc) is already clustered, so scoring needs no further exchange
    until the per-query top-k (which is reduced to k rows per partition first)."""
    # explode_outer + null filter: a plain explode makes the optimizer add a
    # size(tokens) > 0 filter below the projection, which evaluates the regex twice
    n = int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = toks.repartition(n, "doc_id").select("doc_id", "dl", F.explode_outer("tokens").alias("token"))
    if not keep_empty:
        rows = rows.filter(F.col("token").isNotNull())
    return rows.groupBy("doc_id", "token").agg(F.count("token").alias("tf"), F.first("dl").alias("dl"))


def drop_pad(df: DataFrame, pad_token, token_col: str = "token") -> DataFrame:
    """Remove a padding token from postings / presence rows (lists built
    here are never padded, so this only matters for padded inputs)."""
    return df.filter(F.col(token_col) != F.lit(pad_token))


def term_presence(df: DataFrame, id_col: str, tokens_col: str = "tokens",
                  out_id: str = "query_id") -> DataFrame:
    """A2: one row per distinct token of each row (0/1 presence)."""
    return (df.select(F.col(id_col).alias(out_id), F.explode_outer(F.array_distinct(tokens_col)).alias("token"))
              .filter(F.col("token").isNotNull()))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text",
                lower: bool = True, normalize: bool = False, max_len: int | None = None) -> DataFrame:
    """V4 input: (query_id, token) presence rows of each query."""
    toks = queries.select(F.col(id_col).alias("query_id"),
                          analyze(F.col(text_col), lower, normalize, max_len).alias("tokens"))
    return term_presence(toks, "query_id")


def document_frequency(posts: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """A3: (token, df).  With ``tokens`` given, only those tokens are counted
    (semi-join against the size-checked token list)."""
    p = posts.filter(F.col("token").isNotNull())
    if tokens is not None:
        p = p.join(bounded_broadcast(tokens.select("token").distinct()), "token", "left_semi")
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@dataclass
class CorpusStats:
    """A5 / A6 as scalar sub-queries (evaluated once, inlined as literals)."""
    n_docs: Column
    avgdl: Column


def corpus_stats(posts_or_docs: DataFrame) -> CorpusStats:
    """N and average document length from a (doc_id, dl) table or postings."""
    docs = posts_or_docs.groupBy("doc_id").agg(F.first("dl").alias("dl")) \
        if "token" in posts_or_docs.columns else posts_or_docs
    agg = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("a"))
    return CorpusStats(agg.select("n").scalar(), agg.select("a").scalar())


def idf_table(posts: DataFrame, n_docs: Column, tokens: DataFrame | None = None) -> DataFrame:
    """A3 + A4: (token, df, idf)."""
    return document_frequency(posts, tokens).withColumn("idf", S.idf(n_docs, F.col("df")))


def bm25_query_weights(qterms: DataFrame, idf: DataFrame) -> DataFrame:
    """J2 for BM25: query presence x IDF -> (query_id, token, weight)."""
    return qterms.join(idf.select("token", F.col("idf").alias("weight")), "token")


def learned_query_weights(qterms: DataFrame, weights: DataFrame) -> DataFrame:
    """J2 for the learned scorer: presence x per-token weight."""
    return qterms.join(weights.select("token", "weight"), "token")


def score(posts: DataFrame, qweights: DataFrame, doc_term: Column, broadcast_query: bool | None = None) -> DataFrame:
    """(query_id, doc_id, score) for every pair sharing at least one token.

    ``doc_term`` is the per-posting document factor (F8 or F9) over columns
    tf / dl.  The query side is broadcast when ``broadcast_query`` is true; when
    it is None the side is counted first (pass a cheap table then)."""
    qw = qweights.select("query_id", "token", "weight")
    if broadcast_query is None:
        qw = bounded_broadcast(qw)
    elif broadcast_query:
        qw = F.broadcast(qw)
    return (posts.join(qw, "token")
                 .groupBy("query_id", "doc_id")
                 .agg(F.sum(F.col("weight") * doc_term).alias("score")))


def materialize(df: DataFrame) -> DataFrame:
    """Postings feed three consumers (corpus statistics, document frequency,
    scoring): write them once, bucketed by doc_id, so the text is tokenised
    once and the (query, doc) aggregate of the scoring join needs no shuffle."""
    return _materialize(df, bucket_by="doc_id")


def query_side_is_small(qterms: DataFrame) -> bool:
    """Size check for broadcasting the query side (counts the cheap presence table)."""
    return qterms.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def bm25_doc_term(stats: CorpusStats) -> Column:
    return S.bm25_tf(F.col("tf"), F.col("dl"), stats.avgdl)


def learned_doc_term(beta: float | Column) -> Column:
    return S.saturate(F.col("tf"), beta)


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = 10, *, doc_id: str = "doc_id",
                doc_text: str = "text", doc_title: str | None = None, query_id: str = "query_id",
                query_text: str = "text", lower: bool = True, normalize: bool = False,
                max_len: int | None = None, posts: DataFrame | None = None,
                idf: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """V4 + V5 + J1 + W2 with BM25 weights: top-k (query_id, doc_id, score, rank).

    Only documents sharing a token with the query are ranked (IDF is positive, so
    a document without one is never nearer).  N and avgdl count documents
    without tokens too.  With ``exclude_self`` (P6) a document with the query's
    own id is left out before the cut."""
    p = posts if posts is not None else written_postings(corpus, doc_id, doc_text, doc_title, lower, normalize, max_len)
    stats = corpus_stats(p)
    qt = query_terms(queries, query_id, query_text, lower, normalize, max_len)
    small = query_side_is_small(qt)
    # df only for the query tokens: the written postings are scanned again with a
    # semi-join on the (size-checked) query-token list, so only those tokens'
    # partial counts cross the shuffle -- not the whole vocabulary
    qw = bm25_query_weights(qt, idf_table(p, stats.n_docs, qt) if idf is None else idf)
    return top_k_per_key(without_own(score(p, qw, bm25_doc_term(stats), small), exclude_self), k)


def written_postings(corpus: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", doc_title: str | None = None,
                     lower: bool = True, normalize: bool = False, max_len: int | None = None) -> DataFrame:
    """The postings artefact of a corpus: written once, documents without tokens
    kept as a row without token."""
    return materialize(postings_from_tokens(doc_tokens(corpus, doc_id, doc_text, doc_title, lower, normalize, max_len), True))


def batch_average_length(corpus: DataFrame, posts: DataFrame, batch_size: int, doc_id: str = "doc_id", doc_text: str = "text",
                         doc_title: str | None = None) -> DataFrame:
    """A5, batch scope: (doc_id, avgdl), the mean length of the batch a document is
    encoded in.  Batches of ``batch_size`` follow the texts' length, longest first."""
    chars = F.coalesce(F.length(T.title_text(doc_title, doc_text) if doc_title else F.col(doc_text)), F.lit(0))
    order = corpus.select(F.col(doc_id).alias("doc_id"), chars.alias("chars"))
    batches = assign_batches(order, batch_size, [F.col("chars").desc(), F.col("doc_id")])
    lengths = batches.join(posts.groupBy("doc_id").agg(F.first("dl").alias("dl")), "doc_id")
    return lengths.select("doc_id", F.avg("dl").over(Window.partitionBy("batch")).alias("avgdl"))   # bounded by batch_size


def bm25_batch_search(corpus: DataFrame, queries: DataFrame, k: int, batch_size: int, doc_title: str | None = None) -> DataFrame:
    """BM25 whose average length is that of a document's batch (A5, batch scope)."""
    p = written_postings(corpus, doc_title=doc_title)
    lengths = _materialize(batch_average_length(corpus, p, batch_size, doc_title=doc_title))
    terms = query_terms(queries)
    qw = bm25_query_weights(terms, idf_table(p, corpus_stats(p).n_docs, terms))
    factor = S.bm25_tf(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return top_k_per_key(score(p.join(lengths, "doc_id"), qw, factor, query_side_is_small(terms)), k)


def without_own(scored: DataFrame, exclude_self: bool) -> DataFrame:
    """Scored pairs without a query's own document (ids compared as strings)."""
    return scored.filter(F.col("query_id").cast("string") != F.col("doc_id").cast("string")) if exclude_self else scored


def with_zeros(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Scored pairs plus the unscored documents (score 0) that can reach the top
    k: for a query with s scored documents, the first unscored ones are among
    the first s + k by id, so no more than that many are looked at."""
    scored = _materialize(scored)
    need = (queries.select("query_id").distinct()
            .join(scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("s"),
                                                 F.sum((F.col("score") > 0).cast("int")).alias("up")), "query_id", "left")
            .fillna({"s": 0, "up": 0}).filter(F.col("up") < k))
    at = ordered_index(docs.select("doc_id").distinct(), [F.col("doc_id")], out="at")
    tries = need.select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s") + F.lit(k - 1))).alias("at"))
    zeros = (tries.join(at, "at").select("query_id", "doc_id")
                  .join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
                  .withColumn("score", F.lit(0.0)))
    return scored.unionByName(zeros)


def learned_search(corpus: DataFrame, queries: DataFrame, weights: DataFrame, beta: float, k: int = 10,
                   *, doc_id: str = "doc_id", doc_text: str = "text", doc_title: str | None = None,
                   query_id: str = "query_id", query_text: str = "text", lower: bool = True,
                   normalize: bool = False, max_len: int | None = None,
                   posts: DataFrame | None = None, exclude_self: bool = False, fill_zero: bool = True) -> DataFrame:
    """V6 learned retriever: weights (token, weight) and saturation beta.

    Weights can be negative, so with ``fill_zero`` documents that share no token
    with the query compete with score 0."""
    p = posts if posts is not None else written_postings(corpus, doc_id, doc_text, doc_title, lower, normalize, max_len)
    qt = query_terms(queries, query_id, query_text, lower, normalize, max_len)
    scored = score(p, learned_query_weights(qt, weights), learned_doc_term(beta), query_side_is_small(qt))
    if fill_zero:
        # one more, in case the query's own document is left out
        scored = with_zeros(scored, queries.select(F.col(query_id).alias("query_id")), p, k + 1)
    return top_k_per_key(without_own(scored, exclude_self), k)


def build_idf(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              title_col: str | None = None, chunk_length: int | None = None,
              lower: bool = True, offset: int | Column = 0) -> DataFrame:
    """IDF over the whole corpus (token, df, idf); one shuffle on token.

    With ``chunk_length`` a row counts the chunk of tokens that starts at
    ``offset`` (P4: the dataset's epoch offset, the unit the statistics job of
    the reference counts)."""
    toks = doc_tokens(corpus, id_col, text_col, title_col, lower)
    if chunk_length:
        offs = corpus.select(F.col(id_col).alias("doc_id"), (F.lit(offset) if isinstance(offset, int) else offset).alias("_off"))
        toks = toks.join(offs, "doc_id").withColumn("tokens", chunk(F.col("tokens"), F.col("_off"), chunk_length))
    pres = term_presence(toks, "doc_id", out_id="doc_id")
    n = corpus.agg(F.count(F.lit(1)).cast("double")).scalar()       # the texts are not read for it
    return pres.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", S.idf(n, F.col("df")))
