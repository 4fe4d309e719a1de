"""Answer checks and reader scores.

Question results arrive exploded: one row per (question_id, ctx_pos, text) and
one row per (question_id, answer).  The answer check is a join on the question
key (each question only meets its own passages and answers -- no theta join);
the contiguous token-run test is a substring test on separator-framed token
strings (F7), evaluated per pair inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexkit.functions import text as T
from lexkit.operators.joins import bounded_broadcast
from lexkit.session import materialize


def passage_hits(ctxs: DataFrame, answers: DataFrame, decompose: bool = True) -> DataFrame:
    """(question_id, ctx_pos, hit) -- does any answer occur in the passage?

    ctxs: (question_id, ctx_pos, text) with text nullable (missing passage = no
    hit); answers: (question_id, answer)."""
    c = ctxs.select("question_id", "ctx_pos", F.col("text").isNull().alias("_null"),
                    T.token_run(T.qa_tokens(F.col("text"), decompose)).alias("_run"))
    a = answers.select("question_id", T.qa_tokens(F.col("answer"), decompose).alias("_at"))
    a = a.select("question_id", F.size("_at").alias("_alen"), T.token_run(F.col("_at")).alias("_arun"))
    pairs = c.join(a, "question_id", "left")
    hit = (~F.col("_null")) & F.col("_alen").isNotNull() & (
        (F.col("_alen") == 0) | (F.instr(F.col("_run"), F.col("_arun")) > 0))
    return pairs.groupBy("question_id", "ctx_pos").agg(F.bool_or(hit).alias("hit"))


def retrieved_hits(run: DataFrame, docs: DataFrame, answers: DataFrame, decompose: bool = True) -> DataFrame:
    """J10 over a ranking: (question_id, ctx_pos, hit) for run rows (question_id,
    ctx_pos, doc_id) and documents (doc_id, text).

    A document is read and tokenised once, however many questions retrieved it;
    the run with its answers meets it in place (broadcast if it is small enough),
    and only flags are shuffled."""
    a = answers.select("question_id", T.qa_tokens(F.col("answer"), decompose).alias("_at"))
    a = a.select("question_id", F.size("_at").alias("_alen"), T.token_run(F.col("_at")).alias("_arun"))
    asked = materialize(run.select("question_id", "ctx_pos", "doc_id").join(a, "question_id", "left"))
    wanted = bounded_broadcast(asked.select("doc_id").distinct())
    # written: compiled code would put the tokenizer into the loop over a document's questions
    d = materialize(docs.join(wanted, "doc_id", "left_semi").select(
        "doc_id", F.col("text").isNull().alias("_null"), T.token_run(T.qa_tokens(F.col("text"), decompose)).alias("_run")))
    hit = (~F.col("_null")) & F.col("_alen").isNotNull() & (
        (F.col("_alen") == 0) | (F.instr(F.col("_run"), F.col("_arun")) > 0))
    return (d.join(bounded_broadcast(asked), "doc_id")
             .groupBy("question_id", "ctx_pos").agg(F.bool_or(hit).alias("hit")))


def top_k_hits(hits: DataFrame, width: str = "max", group_cols=(), questions: DataFrame | None = None) -> DataFrame:
    """(k, hits, recall) for k = 1..width: number of questions whose first
    hit is at position <= k.  ``width='max'`` uses the longest passage list;
    ``'first'`` the list of the smallest question id (the reference's choice).
    ``group_cols`` (e.g. the result file) computes one curve per group.

    ``questions`` (group columns, question_id) is the denominator: a question
    without any passage counts as one without a hit."""
    g = list(group_cols)
    first = hits.groupBy(*g, "question_id").agg(
        F.min(F.when(F.col("hit"), F.col("ctx_pos"))).alias("first_hit"),
        F.count(F.lit(1)).alias("n_ctx"))
    if questions is not None:
        first = (questions.select(*g, "question_id").distinct().join(first, [*g, "question_id"], "left")
                          .fillna({"n_ctx": 0}))
    # one row per question, read by three aggregates below: write once
    first = materialize(first)
    if width == "first":
        # a minimum per group, not a window over all questions
        per = first.groupBy(*g).agg(F.min_by("n_ctx", "question_id").alias("_w"))
    else:
        per = first.groupBy(*g).agg(F.max("n_ctx").alias("_w"))
    if g:
        per = per.join(first.groupBy(*g).agg(F.count(F.lit(1)).alias("_nq")), g)
    else:
        per = per.withColumn("_nq", first.agg(F.count(F.lit(1))).scalar())
    by_pos = first.filter(F.col("first_hit").isNotNull()).groupBy(*g, "first_hit").agg(F.count(F.lit(1)).alias("c"))
    # one row per (group, cut-off k); k is bounded by the passage-list width
    ks = per.filter("_w > 0").select(*g, "_nq", F.explode(F.sequence(F.lit(1), F.col("_w").cast("int"))).alias("k"))
    counts = ks.join(by_pos.withColumn("k", (F.col("first_hit") + 1).cast("int")).drop("first_hit"), [*g, "k"], "left") \
               .fillna({"c": 0})
    cum = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*g, F.col("k").cast("int").alias("k"),
                         F.sum("c").over(cum).cast("bigint").alias("hits"),
                         (F.sum("c").over(cum) / F.col("_nq")).alias("recall"))


def answer_recall_at(hits_curve: DataFrame, ks: Sequence[int] = (5, 10, 20, 100), group_cols=()) -> DataFrame:
    """100 * hits[k] / questions at the listed k that fit the width."""
    return (hits_curve.filter(F.col("k").isin(list(ks)))
                      .select(*group_cols, "k", (F.col("recall") * 100.0).alias("recall")))


def recall_report(recall: DataFrame, group_col: str = "file", ks: Sequence[int] = (20, 100)) -> DataFrame:
    """S11 for answer recall: per k, the values of all groups (files) at one
    decimal, tab-joined in group order."""
    r = recall.filter(F.col("k").isin(list(ks)))
    return r.groupBy("k").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(group_col), F.format_number("recall", 1).alias("v")))),
        lambda s: s["v"]), "\t").alias("values"))


def with_occurrences(df: DataFrame, tokens_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the tokens of a list with the number of the occurrence
    each is (t#0, t#1, ...), so multisets become sets.  Linear in the list after
    one sort: equal tokens stand together, and their runs are numbered."""
    sorted_, starts = f"_{out}_sorted", f"_{out}_starts"
    places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
    run = lambda p, j: F.transform(
        F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), F.size(sorted_)) - p - 1),
        lambda n: F.concat_ws(T.RUN_SEP, F.get(sorted_, p), n.cast("string")))
    return (df.withColumn(sorted_, F.sort_array(tokens_col)).withColumn(starts, first)
              .withColumn(out, F.flatten(F.transform(starts, run))).drop(sorted_, starts))


def common_tokens(a, b):
    """Size of the multiset intersection of two ``with_occurrences`` lists."""
    return F.size(F.array_intersect(a, b))


def token_bags(texts: DataFrame, key_cols: Sequence[str], text_col: str, prefix: str) -> DataFrame:
    """(key..., <prefix>text, <prefix>n, <prefix>bag): a text after F4, the number
    of its tokens and the tokens with their occurrences; once per text."""
    base = texts.select(*key_cols, T.normalize_answer(F.col(text_col)).alias(prefix + "text"))
    empty = F.array().cast("array<string>")
    base = base.withColumn("_tokens", F.when(F.length(prefix + "text") == 0, empty).otherwise(F.split(prefix + "text", " ")))
    return (with_occurrences(base, "_tokens", prefix + "bag").withColumn(prefix + "n", F.size("_tokens")).drop("_tokens"))


def _f1(same, n_pred, n_truth):
    prec, rec = same / n_pred, same / n_truth
    return F.when(same == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))


def f1_pairs(pairs: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """F6 over (key..., pred, truth) rows: token-multiset F1 after F4, computed
    inside the row (no shuffle)."""
    both = token_bags(token_bags(pairs, [*key_cols, "truth"], "pred", "p"), [*key_cols, "pn", "pbag"], "truth", "t")
    return (both.select(*key_cols, "pn", "tn", common_tokens(F.col("pbag"), F.col("tbag")).alias("same"))
                .select(*key_cols, _f1(F.col("same"), F.col("pn"), F.col("tn")).alias("f1")))


def reader_scores(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Per prediction, max EM and max F1 over its ground truths.

    preds: (pred_id, prediction); truths: (pred_id, truth_id, truth).  Every text
    is normalised and counted once, before the join, whatever the pairs it is in."""
    p = token_bags(preds, ["pred_id"], "prediction", "p")
    t = token_bags(truths, ["pred_id"], "truth", "t")
    both = p.join(t, "pred_id").select("pred_id", (F.col("ptext") == F.col("ttext")).cast("int").alias("em"), "pn", "tn",
                                       common_tokens(F.col("pbag"), F.col("tbag")).alias("same"))
    return both.groupBy("pred_id").agg(F.max("em").alias("em"), F.max(_f1(F.col("same"), F.col("pn"), F.col("tn"))).alias("f1"))
