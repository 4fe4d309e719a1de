"""Registered queries: one per inventory operator / composition.

Every query reads the provided tables (or data Spark derives from them), runs
over whole tables and whole texts, and returns a DataFrame whose column names
and rounding match the SQL in ``lexkit.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.functions import scoring as S
from lexkit.operators import block_max as BM
from lexkit.operators import lexical as L
from lexkit.operators.joins import bounded_broadcast
from lexkit.session import discard, materialize, written
from lexkit.operators import metrics as M
from lexkit.plans import retrieval as R
from lexkit.sources import testdata as td

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Fixed evaluation settings of the registered queries.
FLAGSHIP_K = 10
EVAL_K_VALUES = (1, 3, 5, 10, 100, 1000)


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- retrieval core

@register("bm25_top10")
def bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: BM25 top-10 documents for every benchmark query."""
    run = L.bm25_search(td.corpus(spark, sf), td.queries(spark, sf), FLAGSHIP_K, doc_title="title")
    return run.select("query_id", "doc_id", _r6(F.col("score")).alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


def _many_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages and all user turns as queries (query_id STRING, text)."""
    turns = td.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return (td.queries(spark, sf).select(F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("query_id"), "text")
            .unionByName(turns.select(F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                                      .alias("query_id"), "text")))


@register("bm25_block_max")
def bm25_block_max(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + W2 by block maxima: BM25 top-10 for every benchmark passage and user turn,
    without a (query, document) row for blocks below the bound."""
    posts = L.written_postings(td.corpus(spark, sf), doc_title="title")
    run = BM.block_max_search(posts, _many_queries(spark, sf), FLAGSHIP_K)
    return run.select("query_id", "doc_id", _r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


AVGDL_BATCH = 128


@register("bm25_batch_avgdl")
def bm25_batch_avgdl(spark: SparkSession, sf: str) -> DataFrame:
    """A5, batch scope: BM25 top-10 where the average length is that of the batch of
    128 documents, longest texts first, that a document is encoded in."""
    run = L.bm25_batch_search(td.corpus(spark, sf), td.queries(spark, sf), FLAGSHIP_K, AVGDL_BATCH, doc_title="title")
    return run.select("query_id", "doc_id", _r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("qrels_contains")
def qrels_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements: benchmark passage contained in the document (exact substring join)."""
    return td.qrels(spark, sf)


@register("term_frequency")
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + A5: postings (doc_id, token, tf, dl) of the titled corpus."""
    return L.postings(td.corpus(spark, sf), title_col="title").select("doc_id", "token", "tf",
                                                                       F.col("dl").cast("bigint").alias("dl"))


@register("term_presence")
def term_presence(spark: SparkSession, sf: str) -> DataFrame:
    """A2: distinct tokens of every query."""
    return L.query_terms(td.queries(spark, sf))


@register("idf_table")
def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    """A3 + A4 / R10: document frequency and IDF of every token of the corpus."""
    idf = L.build_idf(td.corpus(spark, sf), title_col="title")
    return idf.select("token", "df", _r6(F.col("idf")).alias("idf"))


@register("doc_length")
def doc_length(spark: SparkSession, sf: str) -> DataFrame:
    """A5: document length and corpus average length."""
    toks = L.doc_tokens(td.corpus(spark, sf), title_col="title")
    avg = toks.agg(F.avg("dl")).scalar()
    return toks.select("doc_id", F.col("dl").cast("bigint").alias("dl"), _r6(avg).alias("avgdl"))


@register("corpus_size")
def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per dataset (source) with the grand total (dataset null)."""
    return (td.table(spark, sf, "documents").rollup("source")
              .agg(F.count(F.lit(1)).alias("n_rows")).withColumnRenamed("source", "dataset"))


@register("bm25_eval")
def bm25_eval(spark: SparkSession, sf: str) -> DataFrame:
    """V7: BM25 retrieval + NDCG/MAP/Recall/P/MRR/R_cap/Hole at 1 to 1000."""
    m = R.retrieve_and_evaluate(td.corpus(spark, sf), td.queries(spark, sf), td.qrels(spark, sf),
                                EVAL_K_VALUES)
    return m.select("metric", F.col("k").cast("bigint").alias("k"), _r6(F.col("value")).alias("value"))


@register("bm25_eval_by_lang")
def bm25_eval_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """V8 + A12: per-language corpora evaluated in one job, then macro-averaged."""
    _, macro = R.evaluate_multi(td.corpus(spark, sf), td.queries(spark, sf), td.qrels(spark, sf),
                                "lang", EVAL_K_VALUES)
    return macro.select("metric", F.col("k").cast("bigint").alias("k"), _r6(F.col("value")).alias("value"),
                        F.col("members").cast("bigint").alias("members"))


@register("learned_top10")
def learned_top10(spark: SparkSession, sf: str) -> DataFrame:
    """V6 learned scorer (F9 saturation, beta = 0) with per-token weights taken
    from the corpus IDF table."""
    c = td.corpus(spark, sf)
    w = L.build_idf(c, title_col="title").select("token", F.col("idf").alias("weight"))
    run = L.learned_search(c, td.queries(spark, sf), w, 0.0, FLAGSHIP_K, doc_title="title")
    return run.select("query_id", "doc_id", _r6(F.col("score")).alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


@register("exclude_self")
def exclude_self(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship run without a query's own document.  A query goes by the
    id of the first document that holds its passage (if no other query does;
    else by a negative id), so self-hits occur and rank high."""
    q = td.queries(spark, sf)
    holder = td.qrels(spark, sf).groupBy("query_id").agg(F.min("doc_id").alias("own"))
    first = holder.groupBy("own").agg(F.min("query_id").alias("query_id"))
    q = q.join(first, "query_id", "left").select(F.coalesce("own", -1 - F.col("query_id")).alias("query_id"), "text")
    run = L.bm25_search(td.corpus(spark, sf), q, FLAGSHIP_K, doc_title="title", exclude_self=True)
    return run.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@register("learned_fill_zero")
def learned_fill_zero(spark: SparkSession, sf: str) -> DataFrame:
    """V6 with weights of either sign (IDF minus 8): documents without a common
    token compete with score 0."""
    c = td.corpus(spark, sf)
    w = L.build_idf(c, title_col="title").select("token", (F.col("idf") - 8.0).alias("weight"))
    run = L.learned_search(c, td.queries(spark, sf), w, 0.0, FLAGSHIP_K, doc_title="title")
    return run.select("query_id", "doc_id", _r6(F.col("score")).alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


@register("metric_report")
def metric_report(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation printed as 'name@k' at one decimal."""
    m = R.retrieve_and_evaluate(td.corpus(spark, sf), td.queries(spark, sf), td.qrels(spark, sf),
                                EVAL_K_VALUES)
    return R.metric_report(m)


# ---------------------------------------------------------------- text functions

from lexkit.functions import text as T  # noqa: E402


@register("normalize_text")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over every document text."""
    d = td.table(spark, sf, "documents")
    n = T.normalize_text(F.col("text"))
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("n_chars"))


#: Stand-ins of ``nfd_decompose``: one mark, two marks, marks in the wrong order, two Hangul forms.
ACCENTED = [("a", "\u00e1"), ("e", "\u1ec1"), ("i", "\u00ef\u0323"), ("o", "\u01ed"), ("u", "\u01d6"),
            ("q", "q\u0307\u0323"), (".", "\ud558"), (",", "\uac01")]


@register("nfd_decompose")
def nfd_decompose(spark: SparkSession, sf: str) -> DataFrame:
    """canonical decomposition of every conversation turn.

    The given turns are plain, so accented letters, Hangul syllables and marks out
    of order are put in for letters and stops first."""
    t = F.col("text")
    for plain, accented in ACCENTED:
        t = F.replace(t, F.lit(plain), F.lit(accented))
    c = td.table(spark, sf, "conversations").select("conv_id", "turn", t.alias("text"))
    n = T.nfd("text")
    return c.select("conv_id", "turn", F.length(n).cast("bigint").alias("n_chars_nfd"), F.md5(n).alias("nfd_md5"))


@register("simple_tokenize")
def simple_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """F3 (uncased) over every document text."""
    d = td.table(spark, sf, "documents")
    toks = T.simple_tokenize(F.col("text"), uncased=True)
    return d.select("doc_id", F.size(toks).cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join(toks, T.RUN_SEP)).alias("tokens_md5"))


@register("preprocess_corpus")
def preprocess_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """P1 + P2: title rule, then normalisation, then lower-casing."""
    c = td.corpus(spark, sf)
    t = T.preprocess(T.title_text("title", "text"), normalize=True, lower=True)
    return c.select("doc_id", F.md5(t).alias("text_md5"))


@register("normalize_answer")
def normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    """F4 over every conversation turn."""
    c = td.table(spark, sf, "conversations")
    n = T.normalize_answer(F.col("text"))
    return c.select("conv_id", "turn", F.md5(n).alias("norm_md5"),
                    F.size(T.answer_tokens(F.col("text"))).cast("bigint").alias("n_words"))


# ---------------------------------------------------------------- answers (V9)

from lexkit.operators import qa as QA  # noqa: E402

QA_DEPTH = 100


def _qa_inputs(spark: SparkSession, sf: str):
    """Questions = benchmark passages; passages = their BM25 top-100 documents;
    answer = the whole benchmark passage."""
    q = td.queries(spark, sf)
    run = materialize(L.bm25_search(td.corpus(spark, sf), q, QA_DEPTH, doc_title="title"))
    # only the retrieved documents are read back (semi-join on the size-checked hit list)
    docs = (td.table(spark, sf, "documents").select("doc_id", "text")
              .join(bounded_broadcast(run.select("doc_id").distinct()), "doc_id", "left_semi"))
    ctxs = (run.join(docs, "doc_id")
               .select(F.col("query_id").alias("question_id"), (F.col("rank") - 1).alias("ctx_pos"), "text"))
    answers = q.select(F.col("query_id").alias("question_id"), F.col("text").alias("answer"))
    return ctxs, answers


def _qa_hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(hits, answers) of every question over its retrieved documents."""
    q = td.queries(spark, sf)
    run = L.bm25_search(td.corpus(spark, sf), q, QA_DEPTH, doc_title="title")
    answers = q.select(F.col("query_id").alias("question_id"), F.col("text").alias("answer"))
    run = run.select(F.col("query_id").alias("question_id"), (F.col("rank") - 1).alias("ctx_pos"), "doc_id")
    return QA.retrieved_hits(run, td.table(spark, sf, "documents").select("doc_id", "text"), answers), answers


@register("answer_hits")
def answer_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Does the passage contain an answer as a contiguous token run?"""
    h, _ = _qa_hits(spark, sf)
    return h.select(F.col("question_id").cast("bigint").alias("question_id"),
                    F.col("ctx_pos").cast("bigint").alias("ctx_pos"), "hit")


@register("answer_hits_curve")
def answer_hits_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose first hit is within the top k, k = 1..width."""
    h, answers = _qa_hits(spark, sf)
    c = QA.top_k_hits(h, questions=answers)
    return c.select(F.col("k").cast("bigint").alias("k"), "hits", _r6(F.col("recall")).alias("recall"))


@register("answer_recall_at_k")
def answer_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """R@5, R@10, R@20, R@100 (x100) of the answer check."""
    h, answers = _qa_hits(spark, sf)
    r = QA.answer_recall_at(QA.top_k_hits(h, questions=answers))
    return r.select(F.col("k").cast("bigint").alias("k"), _r6(F.col("recall")).alias("recall"))


# ---------------------------------------------------------------- reader

def _reader_inputs(spark: SparkSession, sf: str):
    """Predictions = assistant turns; ground truths = the user turns just before
    and just after (equi-joins on (conv_id, turn +- 1), whole texts)."""
    c = td.table(spark, sf, "conversations")
    pid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    preds = c.filter(F.col("role") == "assistant").select(
        pid.alias("pred_id"), "conv_id", "turn", F.col("text").alias("prediction"))
    users = c.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("t_turn"),
                                                    F.col("text").alias("truth"))
    before = preds.join(users.withColumn("turn", F.col("t_turn") + 1), ["conv_id", "turn"])
    after = preds.join(users.withColumn("turn", F.col("t_turn") - 1), ["conv_id", "turn"])
    truths = before.unionByName(after).select("pred_id", F.col("t_turn").alias("truth_id"), "truth")
    return preds.select("pred_id", "prediction"), truths


@register("reader_scores")
def reader_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Max exact match and max F1 over the ground truths."""
    p, t = _reader_inputs(spark, sf)
    s = QA.reader_scores(p, t)
    return s.select("pred_id", F.col("em").cast("bigint").alias("em"), _r6(F.col("f1")).alias("f1"))


@register("reader_eval")
def reader_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Mean EM and F1 (x100) over all predictions."""
    p, t = _reader_inputs(spark, sf)
    s = QA.reader_scores(p, t)
    return s.agg(F.count(F.lit(1)).alias("n"), _r6(F.avg("em") * 100).alias("em"),
                 _r6(F.avg("f1") * 100).alias("f1"))


# ---------------------------------------------------------------- vectors

from lexkit.operators import agreement as AG  # noqa: E402
from lexkit.operators import vectors as V  # noqa: E402
from lexkit.operators.windows import ordered_index  # noqa: E402

AGREEMENT_KS = (1, 5, 10, 20)


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """(label, vec): mean vector of every label group."""
    return V.as_arrays(V.mean_pool(td.vectors(spark, sf), "label"), "label")


@register("label_centroids")
def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """A26 mean pooling of the embeddings of every label."""
    m = V.mean_pool(td.vectors(spark, sf), "label")
    return m.select(F.col("label").cast("bigint").alias("label"), F.col("dim").cast("bigint").alias("dim"),
                    _r6(F.col("value")).alias("value"))


POOL_WIDTH = 16


@register("masked_pooling")
def masked_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """A26 with a mask: sequences of up to 16 vectors (consecutive ids) of which every
    fourth is padding and one sequence in five has none but padding; the masked mean
    of every sequence (in the row and as a grouped aggregate) and its first vector."""
    seq, pos = F.floor(F.col("vec_id") / POOL_WIDTH).cast("bigint"), (F.col("vec_id") % POOL_WIDTH).cast("int")
    mask = ((F.col("vec_id") % 4 != 3) & (F.floor(F.col("vec_id") / POOL_WIDTH) % 5 != 4)).cast("int")
    v = td.vectors(spark, sf).select(seq.alias("seq"), pos.alias("pos"), mask.alias("mask"), "vec_id",
                                     F.col("embedding").cast("array<double>").alias("embedding"))
    rows = v.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding", "mask"))).alias("s"))   # at most 16
    rows = rows.select("seq", V.masked_mean(F.col("s.embedding"), F.col("s.mask")).alias("mean"))
    grouped = V.as_arrays(V.mean_pool(v, "seq", mask_col="mask"), "seq", out="grouped")
    both = rows.join(V.cls_pool(v, "seq"), "seq").join(grouped, "seq", "left")
    return both.select("seq", F.posexplode("embedding").alias("dim", "first"), "mean", "grouped").select(
        "seq", F.col("dim").cast("bigint").alias("dim"), _r6(F.col("first")).alias("first"),
        _r6(F.get("mean", F.col("dim"))).alias("mean"), _r6(F.get("grouped", F.col("dim"))).alias("grouped"))


@register("vector_cosine")
def vector_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Dot, cosine and normalised dot of every vector with its label centroid."""
    c = V.cosine_to(td.vectors(spark, sf), _centroids(spark, sf), "label")
    return c.select("vec_id", _r6(F.col("dot")).alias("dot"), _r6(F.col("cos")).alias("cos"),
                    _r6(F.col("cos_normed")).alias("cos_normed"))


@register("embedding_spread")
def embedding_spread(spark: SparkSession, sf: str) -> DataFrame:
    """A10: mean over dimensions of the per-dimension sample std, per label."""
    s = V.embedding_spread(td.vectors(spark, sf), "label")
    return s.select(F.col("label").cast("bigint").alias("label"), _r6(F.col("spread")).alias("spread"))


@register("flat_ip_search")
def flat_ip_search(spark: SparkSession, sf: str) -> DataFrame:
    """Exact inner-product top-10 of every label centroid over all vectors."""
    q = _centroids(spark, sf).select(F.col("label").alias("query_id"), "vec")
    r = V.flat_ip_search(q, td.vectors(spark, sf), 10)
    return r.select(F.col("query_id").cast("bigint").alias("query_id"), "vec_id",
                    _r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _agreement_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Per label: gold order = exact cosine to the centroid; predicted order =
    cosine rounded to 2 digits (ties by vec_id).  Both orders are numbered with
    the range-partitioned ``ordered_index``."""
    c = V.cosine_to(td.vectors(spark, sf), _centroids(spark, sf), "label").select("vec_id", "label", "cos")
    g = ordered_index(c, [F.round("cos", 9).desc(), F.col("vec_id")], ["label"], out="gold")
    p = ordered_index(g, [F.round("cos", 2).desc(), F.col("vec_id")], ["label"], out="pos")
    return p.select(F.col("label").alias("list_id"), "pos", "gold")


@register("rank_agreement")
def rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Inversions, avg_topk and idx_topk per label list."""
    r = AG.rank_agreement(_agreement_lists(spark, sf), AGREEMENT_KS)
    return r.select(F.col("list_id").cast("bigint").alias("list_id"), F.col("k").cast("bigint").alias("k"),
                    _r6(F.col("avg_topk")).alias("avg_topk"), F.col("idx_topk").cast("bigint").alias("idx_topk"),
                    F.col("inversions").cast("bigint").alias("inversions"))


# ---------------------------------------------------------------- sampling

from lexkit.functions import arrays as A  # noqa: E402
from lexkit.functions.hashing import uniform  # noqa: E402
from lexkit.operators import sampling as SM  # noqa: E402
from lexkit.operators.store import build_retriever, load_retriever, save_retriever  # noqa: E402
from lexkit.operators import windows as W  # noqa: E402

SEED = 17
CHUNK_LENGTH = 256
CROP = (0.3, 0.7)
AUG_P = 0.1
MASK_ID = 3
REPLACE_RANGE = (4, 50264)
BOS, EOS = 0, 2
PAD_BATCH = 16


def ids_md5(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


def _token_corpus(spark: SparkSession, sf: str):
    return SM.token_id_corpus(td.table(spark, sf, "documents"), "source")


@register("token_corpus")
def token_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """S1 form of the documents: per dataset (source) rows of vocabulary ids."""
    ids, _ = _token_corpus(spark, sf)
    return ids.select("dataset_id", "row_id", F.size("input_ids").cast("bigint").alias("n_ids"),
                      ids_md5(F.col("input_ids")).alias("ids_md5"))


@register("pair_crops")
def pair_crops(spark: SparkSession, sf: str) -> DataFrame:
    """R1 + P4 + F12 + R4: epoch offset per dataset, chunk, two independent crops."""
    ids, _ = _token_corpus(spark, sf)
    offs = SM.epoch_offsets(ids, [1], CHUNK_LENGTH, SEED)
    pairs = SM.make_pairs(ids, offs, CHUNK_LENGTH, CROP[0], CROP[1], SEED).join(offs.select("dataset_id", "offset"), "dataset_id")
    return pairs.select("dataset_id", "row_id", F.col("offset").cast("bigint").alias("offset"),
                        F.size("chunk").cast("bigint").alias("chunk_len"),
                        F.size("q_tokens").cast("bigint").alias("q_len"), F.size("k_tokens").cast("bigint").alias("k_len"),
                        ids_md5(F.col("q_tokens")).alias("q_md5"), ids_md5(F.col("k_tokens")).alias("k_md5"))


@register("augmentations")
def augmentations(spark: SparkSession, sf: str) -> DataFrame:
    """F13-F16 (delete / replace / mask / shuffle), F18, F19, W9 + F21 over whole id lists."""
    ids, _ = _token_corpus(spark, sf)
    key = F.col("row_id")
    x = F.col("input_ids")
    # batches are made of the rows' numbers and sizes; the lists stay where they are
    ids = ids.withColumn("_n", F.monotonically_increasing_id())
    widths = W.assign_batches(ids.select("_n", "row_id", F.size("input_ids").alias("size")), PAD_BATCH, [F.col("row_id"), F.col("_n")])
    widths = widths.withColumn("width", F.max("size").over(Window.partitionBy("batch"))).select("_n", "width")
    b = ids.join(bounded_broadcast(materialize(widths)), "_n")
    b = SM.shuffle_tokens_rows(b, "row_id", "input_ids", AUG_P, SEED, "shuf", "shuffled")
    return b.select(
        "row_id",
        ids_md5(A.delete_tokens(x, AUG_P, SEED, "del", key)).alias("del_md5"),
        ids_md5(A.replace_tokens(x, REPLACE_RANGE[0], REPLACE_RANGE[1], AUG_P, SEED, "rep", key)).alias("rep_md5"),
        ids_md5(A.mask_tokens(x, MASK_ID, AUG_P, SEED, "mask", key)).alias("mask_md5"),
        ids_md5(F.col("shuffled")).alias("shuf_md5"),
        ids_md5(A.add_bos_eos(x, BOS, EOS)).alias("bos_eos_md5"),
        ids_md5(A.add_token(x, BOS)).alias("add_md5"),
        F.col("width").cast("bigint").alias("width"),
        ids_md5(A.pad(x, F.col("width"))).alias("padded_md5"),
        F.aggregate(A.pad_mask(x, F.col("width")), F.lit(0), lambda a, m: a + m).cast("bigint").alias("mask_sum"))


@register("sampling_probs")
def sampling_probs(spark: SparkSession, sf: str) -> DataFrame:
    """dataset probabilities for coefficients 0, 0.5, 1."""
    sizes = SM.dataset_sizes(td.table(spark, sf, "documents").withColumnRenamed("source", "dataset_id"))
    out = None
    for c in (0.0, 0.5, 1.0):
        p = SM.sampling_prob(sizes, c).select("dataset_id", F.lit(c).alias("coeff"), _r6(F.col("prob")).alias("prob"))
        out = p if out is None else out.unionByName(p)
    return out


@register("dataset_draws")
def dataset_draws(spark: SparkSession, sf: str) -> DataFrame:
    """J9 + R2: one draw per document row: dataset by probability (c = 0.5),
    then a uniform row inside that dataset."""
    docs = td.table(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_id"))
    return SM.sample_rows(docs, "row_id", docs, 0.5, SEED)


SAMPLED_BATCH = 64


def _text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, title, source, tokens of the text)."""
    return td.corpus(spark, sf).select("doc_id", "title", "source", L.analyze(F.col("text")).alias("tokens"))


def _written_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(_text_tokens(spark, sf))


def _sampled_idf(toks: DataFrame) -> DataFrame:
    corpus = toks.select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_id"), "tokens")
    offs = SM.epoch_offsets(corpus, [1], CHUNK_LENGTH, SEED)
    return SM.sampled_idf(corpus, offs, CHUNK_LENGTH, CROP[0], CROP[1], SAMPLED_BATCH, 0.0, SEED)


@register("idf_sampled")
def idf_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics job over one epoch of draws: as many draws as documents
    (whole batches), each a dataset (source), a row, the epoch's chunk and a crop;
    df counts the crops that hold a token."""
    return _sampled_idf(_written_tokens(spark, sf)).select("token", "df", _r6(F.col("idf")).alias("idf"))


@register("stored_bm25_eval")
def stored_bm25_eval(spark: SparkSession, sf: str) -> DataFrame:
    """S8 + V6 + V7: the sampled IDF is written, read back as the weights of a BM25
    retriever, the retriever is saved, loaded by kind, searched and evaluated."""
    root = _scratch(spark, "store")
    toks = _written_tokens(spark, sf)
    RD.write_idf(_sampled_idf(toks), f"{root}/idf")
    weights = RD.read_idf(spark, f"{root}/idf").select("token", F.col("idf").alias("weight"))
    save_retriever(build_retriever(td.corpus(spark, sf), "bm25", weights, doc_title="title", toks=L.titled_tokens(toks)),
                   f"{root}/retriever")
    m = R.evaluate_retriever(load_retriever(spark, f"{root}/retriever", "bm25"), td.queries(spark, sf), td.qrels(spark, sf),
                             EVAL_K_VALUES)
    return m.select("metric", F.col("k").cast("bigint").alias("k"), _r6(F.col("value")).alias("value"))


@register("trained_eval")
def trained_eval(spark: SparkSession, sf: str) -> DataFrame:
    """R8 + S9 + V6 + V7: the lexical model is trained over one epoch and saved, the
    saved step is loaded into a learned retriever, which is saved, loaded by kind,
    searched and evaluated; the run is written and read back (S10)."""
    root = _scratch(spark, "trained")
    toks, path = written(_text_tokens(spark, sf))
    _trained(spark, sf, f"{root}/model", toks)
    model = TR.load_model(spark, f"{root}/model")
    save_retriever(build_retriever(td.corpus(spark, sf), "learned", model.weights, model.beta, doc_title="title",
                                   toks=L.titled_tokens(toks)), f"{root}/retriever")
    discard(spark, path)
    qrels = td.qrels(spark, sf)
    judged = td.queries(spark, sf).join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    RD.write_run(load_retriever(spark, f"{root}/retriever", "learned").search(judged, max(EVAL_K_VALUES)), f"{root}/run")
    m = M.evaluate(spark.read.parquet(f"{root}/run"), qrels, EVAL_K_VALUES)
    return m.select("metric", F.col("k").cast("bigint").alias("k"), _r6(F.col("value")).alias("value"))


@register("shuffle_order")
def shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    """Repeatable random order of all documents."""
    d = td.table(spark, sf, "documents").select("doc_id")
    return SM.shuffle_order(d, "doc_id", SEED)


@register("batch_layout")
def batch_layout(spark: SparkSession, sf: str) -> DataFrame:
    """W7 + P9 + W9: batches of 32 in shuffled order, last partial batch dropped,
    pad width per batch."""
    d = td.table(spark, sf, "documents").select("doc_id", T.simple_tokenize(F.col("text")).alias("tokens"))
    d = d.withColumn("_u", uniform(SEED, "shuffle", F.col("doc_id")))
    b = W.drop_last(W.assign_batches(d, 32, [F.col("_u"), F.col("doc_id")]), 32)
    b = W.pad_width(b, "tokens")
    return b.select("doc_id", "batch", F.col("pos_in_batch").cast("bigint").alias("pos_in_batch"),
                    F.col("width").cast("bigint").alias("width"))


@register("shards")
def shards(spark: SparkSession, sf: str) -> DataFrame:
    """P11 round-robin and P12 contiguous 3-way shards of all documents."""
    d = td.table(spark, sf, "documents").select("doc_id")
    rr = W.shard_round_robin(d, 3, [F.col("doc_id")], out="rr_shard")
    return W.shard_contiguous(rr, 3, [F.col("doc_id")], out="contiguous_shard").select(
        "doc_id", F.col("rr_shard").cast("bigint").alias("rr_shard"),
        F.col("contiguous_shard").cast("bigint").alias("contiguous_shard"))


@register("maxload_rows")
def maxload_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P10: stop after 100 input rows in file order (the cap is the operator)."""
    return td.table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(100)


# ---------------------------------------------------------------- fine-tuning examples

FT_NEG_OFFSETS = (1, 2, 3)      # negatives: answers of the next conversations, same turn
FT_HARD_OFFSETS = (3, 5)        # hard negatives: later answers of the same conversation
FT_N_NEG, FT_HARD_RATIO, FT_BATCH = 2, 0.5, 8


def _qa_examples(spark: SparkSession, sf: str) -> DataFrame:
    """qa_examples from conversations: question = user turn, positive = the next
    assistant turn, negatives / hard negatives = assistant turns at fixed
    offsets (equi-joins on (conv_id, turn); lists bounded by the offsets)."""
    c = td.table(spark, sf, "conversations")
    asst = c.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    users = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    ctx = lambda t: F.struct(F.lit("").alias("title"), t.alias("text"))
    pos = users.join(asst.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ptext")),
                     ["conv_id", "turn"])

    def listed(offsets, conv_shift: bool, name: str) -> DataFrame:
        rows = asst.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in offsets])))
        if conv_shift:
            rows = rows.select((F.col("conv_id") - F.col("_d")).alias("conv_id"), (F.col("turn") - 1).alias("turn"),
                               "_d", "text")
        else:
            rows = rows.select("conv_id", (F.col("turn") - F.col("_d")).alias("turn"), "_d", "text")
        return (rows.groupBy("conv_id", "turn")
                    .agg(F.array_sort(F.collect_list(F.struct("_d", "text"))).alias("_s"))
                    .select("conv_id", "turn", F.transform("_s", lambda s: ctx(s["text"])).alias(name)))

    ex = (pos.join(listed(FT_NEG_OFFSETS, True, "negative_ctxs"), ["conv_id", "turn"], "left")
             .join(listed(FT_HARD_OFFSETS, False, "hard_negative_ctxs"), ["conv_id", "turn"], "left"))
    empty = F.array().cast("array<struct<title:string,text:string>>")
    return ex.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ex_id"),
                     "question", F.array(ctx(F.col("ptext"))).alias("positive_ctxs"),
                     F.coalesce("negative_ctxs", empty).alias("negative_ctxs"),
                     F.coalesce("hard_negative_ctxs", empty).alias("hard_negative_ctxs"))


def _ft_built(spark: SparkSession, sf: str) -> DataFrame:
    return SM.build_finetune_examples(_qa_examples(spark, sf), training=True, n_negatives=FT_N_NEG,
                                      hard_ratio=FT_HARD_RATIO, normalize=True, seed=SEED)


@register("finetune_examples")
def finetune_examples(spark: SparkSession, sf: str) -> DataFrame:
    """R5 + R6 + P1 + F1: training examples with sampled random / hard negatives."""
    e = _ft_built(spark, sf)
    return e.select("ex_id", F.md5("query").alias("query_md5"), F.md5("gold").alias("gold_md5"),
                    F.size("negatives").cast("bigint").alias("n_neg"),
                    F.md5(F.array_join("negatives", T.RUN_SEP)).alias("negs_md5"))


@register("finetune_collate")
def finetune_collate(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch of 8, golds then all negatives as one passage list."""
    col = SM.collate_finetune(_ft_built(spark, sf), FT_BATCH)
    return col.select("batch", "passage_pos", "is_gold", "ex_id", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- contrastive statistics

from lexkit.operators import contrastive as CT  # noqa: E402

CT_BATCH, CT_TEMPERATURE, CT_SMOOTHING, CT_QUEUE_BATCHES = 50, 0.1, 0.1, 2
LEX_BATCH = 32


def _vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(batch, pos, qv, kv): each vector is a query whose positive key is its
    label centroid; batches of 50 in vec_id order."""
    v = td.vectors(spark, sf)
    b = W.assign_batches(v, CT_BATCH, [F.col("vec_id")], pos_out="pos")
    cent = _centroids(spark, sf)
    return (b.join(bounded_broadcast(cent), "label")
             .select("batch", F.col("pos").cast("bigint").alias("pos"), F.col("embedding").alias("qv"),
                     F.col("vec").alias("kv")))


def _ct_out(df: DataFrame) -> DataFrame:
    return df.select("batch", *[_r6(F.col(c)).alias(c) for c in ("loss", "accuracy", "stdq", "stdk")])


@register("inbatch_contrastive")
def inbatch_contrastive(spark: SparkSession, sf: str) -> DataFrame:
    """V12 in-batch (J7, J12, A8, A9, A10): per batch loss, accuracy, stdq, stdk."""
    return _ct_out(CT.in_batch_stats(_vector_rows(spark, sf), CT_TEMPERATURE, CT_SMOOTHING))


@register("moco_contrastive")
def moco_contrastive(spark: SparkSession, sf: str) -> DataFrame:
    """V12 momentum queue (J8): negatives are the keys of the two previous batches."""
    return _ct_out(CT.moco_stats(_vector_rows(spark, sf), CT_QUEUE_BATCHES, CT_TEMPERATURE, CT_SMOOTHING))


def _lexical_pairs(spark: SparkSession, sf: str):
    """Batches of 32 (shuffled order, last partial batch dropped) of R4 crop
    pairs, and IDF weights per token.  The pairs are built on the token lists
    themselves: crops are positional and tf / presence / df only need token
    identity, so the numbers equal those over vocabulary ids (the oracle uses
    ids) without the id mapping's extra join."""
    d = td.table(spark, sf, "documents")
    toks = materialize(d.select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_id"),
                                T.simple_tokenize(F.col("text"), uncased=True).alias("input_ids")))
    offs = SM.epoch_offsets(toks, [1], CHUNK_LENGTH, SEED)
    pairs = SM.make_pairs(toks, offs, CHUNK_LENGTH, CROP[0], CROP[1], SEED)
    pairs = pairs.withColumn("_u", uniform(SEED, "shuffle", F.col("row_id")))
    b = W.drop_last(W.assign_batches(pairs, LEX_BATCH, [F.col("_u"), F.col("row_id")], pos_out="pos"), LEX_BATCH)
    # IDF per token from the same token lists (no second tokenisation)
    n_docs = toks.agg(F.count(F.lit(1)).cast("double")).scalar()
    w = (toks.select(F.explode(F.array_distinct("input_ids")).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
             .select("token", S.idf(n_docs, F.col("df")).alias("weight")))
    # the batched pairs feed several aggregates of the loss: write them once
    pairs = materialize(b.select("batch", F.col("pos").cast("bigint").alias("pos"), "q_tokens", "k_tokens"))
    return pairs, w


def _training_pairs(spark: SparkSession, sf: str, toks=None):
    """The pairs of ``_lexical_pairs`` for a job that takes no IDF: the crops are
    written and not the whole token lists (``toks`` if they are there); batches are
    made of the rows' numbers.  Returns (pairs, path of the crops they are read from)."""
    if toks is None:
        toks = td.table(spark, sf, "documents").select("doc_id", "source", T.simple_tokenize(F.col("text"), uncased=True).alias("tokens"))
    toks = toks.select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_id"), F.col("tokens").alias("input_ids"))
    crops = SM.make_pairs(toks, SM.epoch_offsets(toks, [1], CHUNK_LENGTH, SEED), CHUNK_LENGTH, CROP[0], CROP[1], SEED)
    crops, path = written(crops.select(F.monotonically_increasing_id().alias("_n"), "row_id", "q_tokens", "k_tokens"))
    order = crops.select("_n", "row_id", uniform(SEED, "shuffle", F.col("row_id")).alias("_u"))
    b = W.drop_last(W.assign_batches(order, LEX_BATCH, [F.col("_u"), F.col("row_id"), F.col("_n")], pos_out="pos"), LEX_BATCH)
    b = materialize(b.select("_n", "batch", F.col("pos").cast("bigint").alias("pos")))
    return crops.join(bounded_broadcast(b), "_n").select("batch", "pos", "q_tokens", "k_tokens"), path


@register("lexical_validate")
def lexical_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Symmetric in-batch loss and doc->query accuracy of the
    lexical scorer (IDF weights, beta = 0) on crop pairs."""
    pairs, w = _lexical_pairs(spark, sf)
    r = CT.lexical_batch_loss(pairs, w, 0.0)
    return r.select("batch", _r6(F.col("loss")).alias("loss"), _r6(F.col("acc")).alias("acc"))


# ---------------------------------------------------------------- training

from lexkit.operators import training as TR  # noqa: E402

TRAIN_LR, TRAIN_WARMUP = 0.01, 12


@register("train_lexical_log")
def train_lexical_log(spark: SparkSession, sf: str) -> DataFrame:
    """One epoch of the learned lexical scorer, an AdamW step per crop-pair batch
    (iterative; rows-only check).  Returns the training log (S12)."""
    return TR.training_log(spark, _trained(spark, sf))


def _trained(spark: SparkSession, sf: str, save_dir: str | None = None, toks=None) -> TR.LexicalModel:
    """One epoch over the crop pairs of all documents."""
    pairs, path = _training_pairs(spark, sf, toks)
    vocab = pairs.select(F.explode("k_tokens").alias("token")).unionByName(
        pairs.select(F.explode("q_tokens").alias("token"))).distinct()
    model = TR.init_model(vocab, SEED)
    steps = pairs.select("batch").distinct().count()
    if steps:
        model = TR.train_lexical(pairs, model, steps, TRAIN_LR, TRAIN_WARMUP, total=steps, save_dir=save_dir)
    elif save_dir:
        TR.save_model(model, save_dir)
    discard(spark, path)
    return model


@register("lr_schedule")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Learning-rate factors for every step of one epoch over the
    documents in batches of 32 (warm-up 12)."""
    d = td.table(spark, sf, "documents").select("doc_id")
    b = W.assign_batches(d, 32, [F.col("doc_id")]).select("batch").distinct()
    total = b.agg(F.count(F.lit(1))).first()[0]
    return b.select(F.col("batch").cast("bigint").alias("step"),
                    _r6(SCH.lr_linear(F.col("batch"), 12, total, 0.0)).alias("lr_linear"),
                    _r6(SCH.lr_cosine(F.col("batch"), 12, total, 0.1)).alias("lr_cosine"))


from lexkit.functions import schedules as SCH  # noqa: E402


def _idf_weights(spark: SparkSession, sf: str, lang: str | None = None) -> DataFrame:
    """(token, weight): corpus IDF (optionally of one language), rounded to 9 digits."""
    d = td.table(spark, sf, "documents")
    if lang:
        d = d.filter(F.col("lang") == lang)
    return L.build_idf(d).select("token", F.round("idf", 9).alias("weight"))


@register("momentum_weights")
def momentum_weights(spark: SparkSession, sf: str) -> DataFrame:
    """0.9 * (English-corpus IDF) + 0.1 * (whole-corpus IDF) per shared token."""
    w = TR.momentum_update(_idf_weights(spark, sf, "en"), _idf_weights(spark, sf), 0.9)
    return w.select("token", _r6(F.col("weight")).alias("weight"))


@register("param_count")
def param_count(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of a lexical model over the corpus vocabulary, in millions."""
    return TR.param_count(_idf_weights(spark, sf)).select(_r6(F.col("params_m")).alias("params_m"))


# ---------------------------------------------------------------- weight inspection

TOP_K = 100


def _signed_weights(spark: SparkSession, sf: str) -> DataFrame:
    a = _idf_weights(spark, sf, "en").withColumnRenamed("weight", "wa")
    b = _idf_weights(spark, sf).withColumnRenamed("weight", "wb")
    return a.join(b, "token").select("token", F.round(F.col("wa") - F.col("wb"), 9).alias("weight"))


@register("vocab_ranking")
def vocab_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """0-based position of every token in descending IDF order."""
    r = W.vocab_ranking(_idf_weights(spark, sf))
    return r.select("token", F.col("rank").cast("bigint").alias("rank"))


@register("top_weights")
def top_weights(spark: SparkSession, sf: str) -> DataFrame:
    """L1: the 100 largest corpus IDF weights."""
    return W.top_weights(_idf_weights(spark, sf), TOP_K).select("token", "weight")


@register("bottom_weights")
def bottom_weights(spark: SparkSession, sf: str) -> DataFrame:
    """L2: the 100 smallest corpus IDF weights."""
    return W.top_weights(_idf_weights(spark, sf), TOP_K, largest=False).select("token", "weight")


@register("smallest_magnitude")
def smallest_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    """L3: the 100 signed weights (English minus whole-corpus IDF) closest to zero."""
    return W.smallest_magnitude(_signed_weights(spark, sf), TOP_K).select("token", "weight")


@register("tail_of_top")
def tail_of_top(spark: SparkSession, sf: str) -> DataFrame:
    """L4: the last 10 of the top 100 corpus weights."""
    top = W.top_weights(_idf_weights(spark, sf), TOP_K)
    return top.orderBy(F.col("weight").asc(), F.col("token").desc()).limit(10).select("token", "weight")


@register("compare_rankings")
def compare_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """L5 + J5 + A27: mean position, in the whole-corpus IDF ordering, of the
    English model's top-100 and bottom-100 tokens, and their mean token id."""
    a = _idf_weights(spark, sf, "en")
    order_b = W.vocab_ranking(_idf_weights(spark, sf))
    _, vocab = _token_corpus(spark, sf)
    out = None
    for name, largest in (("top", True), ("bottom", False)):
        chosen = W.top_weights(a, TOP_K, largest=largest).select("token")
        j = chosen.join(order_b, "token").join(vocab, "token")
        r = j.agg(_r6(F.avg("rank")).alias("mean_rank"), _r6(F.avg("id")).alias("mean_token_id"),
                  F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@register("decode_tokens")
def decode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 highest-weighted tokens decoded into one string in rank order."""
    top = W.top_weights(_idf_weights(spark, sf), 20).withColumn("_o", F.struct(-F.col("weight"), F.col("token")))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "token"))),
                                            lambda s: s["token"]), " ").alias("text"))


# ---------------------------------------------------------------- running statistics

from lexkit.operators import stats as ST  # noqa: E402


@register("weighted_average")
def weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    """Per event type, value averaged with weight 1 + user_id % 3, and the total weight."""
    e = td.table(spark, sf, "events").select(F.col("event_type").alias("key"), "value",
                                             (F.lit(1) + F.col("user_id") % 3).alias("weight"))
    r = ST.weighted_average(e)
    return r.select("key", _r6(F.col("avg")).alias("avg"), F.col("total_weight").cast("bigint").alias("total_weight"))


# ---------------------------------------------------------------- product quantisation (V3)

PQ_M, PQ_BITS, PQ_ROUNDS = 8, 8, 8


@register("pq_search")
def pq_search(spark: SparkSession, sf: str) -> DataFrame:
    """V3: product-quantised inner-product top-10 of every label centroid: codebooks
    of all sub-spaces trained over all vectors, every vector encoded, codes searched."""
    v = td.vectors(spark, sf)
    book = V.pq_train(v, PQ_M, PQ_BITS, seed=SEED, max_iter=PQ_ROUNDS)
    codes = V.pq_encode(v, book)
    q = _centroids(spark, sf).select(F.col("label").alias("query_id"), "vec")
    r = V.pq_search(q, codes, book, 10)
    return r.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vec_id").cast("string").alias("vec_id"),
                    F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- streaming forms

from lexkit.streaming import running_stats as RS  # noqa: E402


@register("stream_document_frequency")
def stream_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """A3 as a Structured Streaming aggregation over the documents files."""
    schema = td.table(spark, sf, "documents").schema
    return RS.stream_document_frequency(spark, sf, schema, file_glob="documents.parquet")


@register("stream_weighted_average")
def stream_weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    """A11 as a Structured Streaming aggregation over the events files."""
    schema = td.table(spark, sf, "events").schema
    r = RS.stream_weighted_average(spark, sf, schema, "event_type", "value", F.lit(1) + F.col("user_id") % 3,
                                   file_glob="events.parquet")
    return r.select("key", _r6(F.col("avg")).alias("avg"), F.col("total_weight").cast("bigint").alias("total_weight"))


# ---------------------------------------------------------------- file sources end to end

import uuid  # noqa: E402

from lexkit.session import scratch_path  # noqa: E402
from lexkit.sources import readers as RD  # noqa: E402


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("passages_tsv")
def passages_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + P5: the corpus written as a headed TSV (id, text, title) and read back."""
    path = _scratch(spark, "passages")
    c = td.corpus(spark, sf)
    (c.select(F.col("doc_id").cast("string").alias("id"), "text", "title")
      .write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
      .option("emptyValue", "").csv(path))
    p = RD.read_passages(spark, path)
    return p.select(F.col("id").cast("bigint").alias("doc_id"), F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"),
                    F.md5("text").alias("text_md5"))


@register("beir_files_eval")
def beir_files_eval(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + V7: corpus.jsonl, queries.jsonl and qrels/test.tsv written from the
    tables, read back with the dataset reader, retrieved and evaluated."""
    root = _scratch(spark, "beir")
    c = td.corpus(spark, sf)
    c.select(F.col("doc_id").cast("string").alias("_id"), "title", "text").write.json(f"{root}/corpus.jsonl")
    td.queries(spark, sf).select(F.col("query_id").cast("string").alias("_id"), "text").write.json(f"{root}/queries.jsonl")
    (td.qrels(spark, sf).select(F.col("query_id").cast("string").alias("query-id"),
                                F.col("doc_id").cast("string").alias("corpus-id"), F.col("relevance").alias("score"))
       .write.option("sep", "\t").option("header", "true").csv(f"{root}/qrels/{RD.split_for('quora')}.tsv"))
    corpus, queries, qrels = RD.read_beir(spark, root, RD.split_for("quora"))
    # numeric ids again, so ties order exactly as in the table-based evaluation
    corpus = corpus.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    queries = queries.withColumn("query_id", F.col("query_id").cast("bigint"))
    qrels = qrels.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("doc_id").cast("bigint").alias("doc_id"),
                         "relevance")
    m = R.retrieve_and_evaluate(corpus, queries, qrels, EVAL_K_VALUES)
    return m.select("metric", F.col("k").cast("bigint").alias("k"), _r6(F.col("value")).alias("value"))


@register("qa_results_recall")
def qa_results_recall(spark: SparkSession, sf: str) -> DataFrame:
    """S6 + V9 + S11: retrieval results written as two result sets, folders of
    JSON lines (question, answers, ctxs; a question without a hit has an empty
    list), read back by glob, answer-checked: per k, the recall of either
    folder, tab-joined."""
    root = _scratch(spark, "qa-results")
    ctxs, answers = _qa_inputs(spark, sf)
    q = td.queries(spark, sf).select(F.col("query_id").alias("question_id"), F.col("text").alias("question"))
    lists = ctxs.groupBy("question_id").agg(  # bounded by the retrieval depth
        F.array_sort(F.collect_list(F.struct("ctx_pos", "text"))).alias("_c"))
    rec = (q.join(lists, "question_id", "left")
             .join(answers.groupBy("question_id").agg(F.collect_list("answer").alias("answers")), "question_id")
             .select("question_id", "question", "answers",
                     F.transform(F.coalesce("_c", F.array().cast("array<struct<ctx_pos:bigint,text:string>>")),
                                 lambda s: F.struct(s["ctx_pos"].cast("string").alias("id"), s["text"].alias("text")))
                     .alias("ctxs")))
    # one folder of part files per result set, a line per question
    (rec.withColumn("run", F.pmod("question_id", F.lit(2))).drop("question_id")
        .write.partitionBy("run").json(f"{root}/runs"))
    res = RD.read_qa_results(spark, f"{root}/runs/run=*/*.json")
    res = res.withColumn("file", F.regexp_replace("file", "/[^/]*$", ""))  # the folder is the key
    c2, a2 = RD.explode_qa_results(res)
    files = res.select("question_id", "file")
    hits = QA.passage_hits(c2.drop("file"), a2.drop("file")).join(files, "question_id")
    curve = QA.top_k_hits(hits, group_cols=["file"], questions=files)
    r = QA.answer_recall_at(curve, group_cols=["file"])
    return QA.recall_report(r, ks=(5, 10, 20, 100)).select(F.col("k").cast("bigint").alias("k"), "values")


QA_MAXLOAD, QA_RANK, QA_WORLD = 150, 1, 3


@register("qa_examples_files")
def qa_examples_files(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + P10 + P11: fine-tuning examples written as JSON lines (in ex_id
    order), read back with a 150-row load cap and round-robin shard 1 of 3."""
    root = _scratch(spark, "qa-examples")
    ex = _qa_examples(spark, sf)
    ex.orderBy("ex_id").write.json(f"{root}/examples")
    got = RD.read_qa_examples(spark, [f"{root}/examples"], maxload=QA_MAXLOAD, rank=QA_RANK, world=QA_WORLD)
    return got.select(F.col("_row").alias("row"), F.md5("question").alias("question_md5"),
                      F.size("hard_negative_ctxs").cast("bigint").alias("n_hard"))


@register("token_corpora_files")
def token_corpora_files(spark: SparkSession, sf: str) -> DataFrame:
    """The id corpus written as one folder per dataset and opened with the
    multi-corpus reader (dataset key = folder path)."""
    root = _scratch(spark, "token-corpora")
    ids, _ = _token_corpus(spark, sf)
    ids.write.partitionBy("dataset_id").parquet(root)
    folders = [f"{root}/dataset_id={r['dataset_id']}" for r in
               ids.select("dataset_id").distinct().orderBy("dataset_id").collect()]  # one row per dataset
    c = RD.read_token_corpora(spark, folders)
    return c.select(F.regexp_extract("dataset_id", r"dataset_id=([^/]+)$", 1).alias("dataset_id"), "row_id",
                    F.size("input_ids").cast("bigint").alias("n_ids"), ids_md5(F.col("input_ids")).alias("ids_md5"))
