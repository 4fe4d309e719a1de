"""Sampling, pair building and example construction (R1-R7, J9, F20, S1 ids).

Every draw is a hash uniform keyed by (seed, tag, row key[, position]), so the
sample is repeatable, independent of partitioning, and recomputed identically
after an executor loss.  Per-dataset row positions come from the
range-partitioned ``ordered_index`` (no single-partition window); dataset
choice is a bucketed equi-join against the cumulative probability intervals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexkit.functions import arrays as A
from lexkit.functions import scoring as S
from lexkit.functions import text as T
from lexkit.functions.hashing import uniform
from lexkit.operators.joins import bounded_broadcast
from lexkit.operators.windows import ordered_index
from lexkit.session import discard, materialize, written

DEFAULT_SEED = 0
CHUNK_TOKENS = 2 << 20     # token occurrences coded with one table


# ---------------------------------------------------------------- token-id corpus

def vocabulary(tokens: DataFrame, token_col: str = "token", first_id: int = 1) -> DataFrame:
    """(token, id): ids follow the sorted distinct vocabulary (first_id, first_id+1, ...)."""
    v = tokens.select(F.col(token_col).alias("token")).distinct()
    return ordered_index(v, [F.col("token")], out="_ix").select(
        "token", (F.col("_ix") + first_id).cast("int").alias("id"))


def coded_rows(toks: DataFrame) -> DataFrame:
    """Rows (.., tokens) in chunks of a partition's neighbours: a row per row with
    ``codes``, places in its chunk's ``words``, and a row per chunk with its distinct
    ``words``.  Tokens leave the scan once per chunk and not once per occurrence."""
    keys, limit = [c for c in toks.columns if c != "tokens"], CHUNK_TOKENS

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // limit)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
                part = b.slice(lo, hi - lo)
                rows = len(part)
                words = pc.list_flatten(part.column("tokens")).dictionary_encode()
                ends = np.concatenate([[0], np.cumsum(n[lo:hi])])
                codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.indices)
                table = [pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)]
                chunk = part.column("_at")[0]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * rows, pa.int64()), *[part.column(c) for c in keys], codes,
                                                  pa.nulls(rows, table[0].type)], names)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.nulls(1, part.column(c).type) for c in keys],
                                                  pa.nulls(1, codes.type), table[0]], names)

    names = ["chunk", *keys, "codes", "words"]
    schema = ", ".join(["chunk bigint", *(f"`{c}` {toks.schema[c].dataType.simpleString()}" for c in keys),
                        "codes array<int>", "words array<string>"])
    return toks.withColumn("_at", F.monotonically_increasing_id()).mapInArrow(code, schema)


def decoded_rows(coded: DataFrame, vocab: DataFrame, out: str = "input_ids") -> DataFrame:
    """The rows of ``coded_rows`` with vocabulary ids: a chunk is grouped with the ids
    of its words."""
    keys = [c for c in coded.columns if c not in ("chunk", "codes", "words")]
    words = coded.filter("words IS NOT NULL").select("chunk", F.posexplode("words").alias("at", "token"))
    ids = words.join(vocab, "token").select(F.col("chunk").alias("wchunk"), "at", "id")
    schema = ", ".join([*(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keys), f"{out} array<int>"])

    def decode(t: pa.Table, w: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        table = np.zeros(len(w), np.int32)
        table[w.column("at").to_numpy()] = w.column("id").to_numpy()
        codes = t.column("codes")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy())])
        got = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table[pc.list_flatten(codes).to_numpy()]))
        return pa.table([*[t.column(c) for c in keys], got], names=[*keys, out])

    return (coded.filter("words IS NULL").drop("words").groupBy("chunk").cogroup(ids.groupBy("wchunk")).applyInArrow(decode, schema))


def token_id_corpus(docs: DataFrame, dataset_col: str, id_col: str = "doc_id", text_col: str = "text",
                    lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 form of a text table: (dataset_id, row_id, input_ids ARRAY<INT>) plus
    the vocabulary, both written.  Token occurrences are coded by chunk; only a
    chunk's distinct tokens meet the vocabulary.  Rows of one (dataset, id) make one
    row, their tokens in order of position."""
    toks = docs.select(F.col(dataset_col).alias("dataset_id"), F.col(id_col).alias("row_id"),
                       T.simple_tokenize(F.col(text_col), uncased=lower).alias("tokens"))
    coded, coded_path = written(coded_rows(toks))
    vocab = materialize(vocabulary(coded.select(F.explode("words").alias("token"))))
    ids, ids_path = written(decoded_rows(coded, vocab))
    key = ["dataset_id", "row_id"]
    repeated = materialize(ids.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                           .select(*[F.col(c).alias("_" + c) for c in key]))
    if not repeated.isEmpty():
        on = F.col("dataset_id").eqNullSafe(F.col("_dataset_id")) & F.col("row_id").eqNullSafe(F.col("_row_id"))
        side = bounded_broadcast(repeated)
        occ = ids.join(side, on, "left_semi").select(*key, F.posexplode_outer("input_ids").alias("pos", "id"))
        merged = (occ.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("_s"))
                     .select(*key, F.transform("_s", lambda s: s["id"]).alias("input_ids")))
        ids, old = materialize(ids.join(side, on, "left_anti").unionByName(merged)), ids_path
        discard(docs.sparkSession, old)
    discard(docs.sparkSession, coded_path)
    return ids, vocab


# ---------------------------------------------------------------- dataset choice

def dataset_sizes(corpus: DataFrame, dataset_col: str = "dataset_id") -> DataFrame:
    return corpus.groupBy(F.col(dataset_col).alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"))


def sampling_prob(sizes: DataFrame, coeff: float) -> DataFrame:
    """p_i = (n_i / N)^c renormalised (c = 0 gives uniform 1/D).  The size
    table has one row per dataset; its window is over that small table."""
    all_w = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(all_w)
    powed = F.pow(share, F.lit(float(coeff)))
    return (sizes.withColumn("_p", powed)
                 .select("dataset_id", "n", (F.col("_p") / F.sum("_p").over(all_w)).alias("prob")))


def prob_intervals(probs: DataFrame) -> DataFrame:
    """[lo, hi) per dataset in dataset order; the last interval ends at 1."""
    w = Window.orderBy("dataset_id").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.orderBy(F.col("dataset_id").desc())
    t = probs.withColumn("hi", F.sum("prob").over(w))
    # lo = previous hi exactly, so the intervals tile [0, 1) without float gaps
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("dataset_id")), F.lit(0.0)))
    return t.withColumn("hi", F.when(F.row_number().over(last) == 1, F.lit(1.0)).otherwise(F.col("hi")))


def pick_dataset(draws: DataFrame, u_col: str, intervals: DataFrame, buckets: int = 1024) -> DataFrame:
    """The dataset whose interval contains the draw -- a range join done as
    an equi-join on a bucket of [0, 1) followed by the interval test."""
    iv = (intervals.withColumn("_b", F.explode(F.sequence(
              F.floor(F.col("lo") * buckets).cast("int"),
              F.least(F.ceil(F.col("hi") * buckets).cast("int") - 1, F.lit(buckets - 1)))))
          .select("_b", "dataset_id", "lo", "hi", "n"))
    d = draws.withColumn("_b", F.floor(F.col(u_col) * buckets).cast("int"))
    return (d.join(bounded_broadcast(iv), "_b")
             .filter((F.col(u_col) >= F.col("lo")) & (F.col(u_col) < F.col("hi")))
             .drop("_b", "lo", "hi"))


def epoch_offsets(datasets: DataFrame, epochs: Sequence[int], chunk_length: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """One offset in [0, chunk_length - 1] per (dataset, epoch)."""
    return (datasets.select("dataset_id").distinct()
                    .withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
                    .withColumn("offset", F.floor(uniform(seed, "offset", F.col("dataset_id"), F.col("epoch"))
                                                  * chunk_length).cast("int")))


def sample_rows(draws: DataFrame, draw_id: str, corpus: DataFrame, coeff: float = 0.0,
                seed: int = DEFAULT_SEED) -> DataFrame:
    """R2: each draw picks a dataset by probability (J9), then a row uniformly
    inside it (with replacement): an equi-join on (dataset, row position)."""
    sizes = dataset_sizes(corpus)
    iv = prob_intervals(sampling_prob(sizes, coeff))
    d = draws.select(F.col(draw_id).alias("draw_id")).withColumn("_u", uniform(seed, "dataset", F.col("draw_id")))
    picked = pick_dataset(d, "_u", iv)
    picked = picked.withColumn("row_pos", F.floor(uniform(seed, "row", F.col("draw_id")) * F.col("n")).cast("bigint"))
    positions = ordered_index(corpus.select("dataset_id", "row_id"), [F.col("row_id")], ["dataset_id"], out="row_pos")
    return picked.join(positions, ["dataset_id", "row_pos"]).select("draw_id", "dataset_id", "row_id")


def crop_counts(draws: DataFrame, chunks: DataFrame, ratio_min: float, ratio_max: float, seed: int = DEFAULT_SEED,
                tag: str = "k") -> DataFrame:
    """Draws with replacement as multiplicities: (dataset_id, row_id, start, length,
    times), how often a row was drawn with that crop (F12) of its chunk.

    draws: (draw_id, dataset_id, row_id); chunks: (dataset_id, row_id, chunk).
    Every draw crops by its own id.  A row drawn often has at most one row here
    per crop its chunk has, whatever the number of draws; the counts combine
    before the shuffle and no row of the corpus is copied."""
    sizes = chunks.select("dataset_id", "row_id", F.size("chunk").alias("n"))
    ratio = F.lit(float(ratio_min)) + F.lit(float(ratio_max - ratio_min)) * uniform(seed, tag + ":ratio", F.col("draw_id"))
    length = F.floor(F.col("n").cast("double") * ratio).cast("bigint")
    start = F.floor(uniform(seed, tag + ":start", F.col("draw_id")) * (F.col("n") - F.col("length") + 1)).cast("bigint")
    return (draws.join(sizes, ["dataset_id", "row_id"]).withColumn("length", length).withColumn("start", start)
                 .groupBy("dataset_id", "row_id", "start", "length").agg(F.count(F.lit(1)).alias("times")))


def sampled_presence(corpus: DataFrame, offsets: DataFrame, chunk_length: int, ratio_min: float, ratio_max: float,
                     batch_size: int, coeff: float = 0.0, seed: int = DEFAULT_SEED) -> DataFrame:
    """R10 over one epoch of draws: (token, df), the number of draws whose crop
    holds the token.  As many rows are drawn as the corpus has, in whole batches
    of ``batch_size`` (R1 offset, R2 draw, P4 chunk, F12 crop, A2 presence).

    corpus: (dataset_id, row_id, tokens), written: it is read for the sizes, the
    positions and the chunks."""
    n = corpus.count()
    draws = corpus.sparkSession.range(n // batch_size * batch_size).withColumnRenamed("id", "draw_id")
    chunks = materialize(corpus.join(bounded_broadcast(offsets.select("dataset_id", "offset")), "dataset_id")
                         .select("dataset_id", "row_id", A.chunk(F.col("tokens"), F.col("offset"), chunk_length).alias("chunk")))
    crops = crop_counts(sample_rows(draws, "draw_id", corpus, coeff, seed), chunks, ratio_min, ratio_max, seed)
    seen = chunks.join(crops.filter("length > 0"), ["dataset_id", "row_id"]).select(
        "times", F.slice("chunk", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("crop"))
    return (seen.select("times", F.explode_outer(F.array_distinct("crop")).alias("token")).filter(F.col("token").isNotNull())
                .groupBy("token").agg(F.sum("times").alias("df")))


def sampled_idf(corpus: DataFrame, offsets: DataFrame, chunk_length: int, ratio_min: float, ratio_max: float,
                batch_size: int, coeff: float = 0.0, seed: int = DEFAULT_SEED, pad_token=None) -> DataFrame:
    """R10, the statistics job: (token, df, idf) of every token of the corpus from
    one epoch of draws; tokens in no crop, and a padding token (P7), have df 0."""
    df = sampled_presence(corpus, offsets, chunk_length, ratio_min, ratio_max, batch_size, coeff, seed)
    if pad_token is not None:
        df = df.filter(F.col("token") != F.lit(pad_token))
    tokens = corpus.select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull()).distinct()
    n = corpus.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (tokens.join(df, "token", "left").na.fill(0, ["df"]).withColumn("idf", S.idf(n, F.col("df"))))


def shuffle_order(df: DataFrame, key_col: str, seed: int = DEFAULT_SEED, out: str = "order_pos") -> DataFrame:
    """A repeatable random permutation (hash order, key breaks ties)."""
    return ordered_index(df.withColumn("_u", uniform(seed, "shuffle", F.col(key_col))),
                         [F.col("_u"), F.col(key_col)], out=out).drop("_u")


# ---------------------------------------------------------------- pairs

def make_pairs(corpus: DataFrame, offsets: DataFrame, chunk_length: int, ratio_min: float, ratio_max: float,
               seed: int = DEFAULT_SEED) -> DataFrame:
    """Per row, the dataset's epoch chunk (P4) and two independent crops
    (F12): (dataset_id, row_id, chunk, q_tokens, k_tokens)."""
    c = corpus.join(bounded_broadcast(offsets.select("dataset_id", "offset")), "dataset_id")
    c = c.withColumn("chunk", A.chunk(F.col("input_ids"), F.col("offset"), chunk_length))
    return c.select("dataset_id", "row_id", "chunk",
                    A.random_crop(F.col("chunk"), ratio_min, ratio_max, seed, "q", F.col("row_id")).alias("q_tokens"),
                    A.random_crop(F.col("chunk"), ratio_min, ratio_max, seed, "k", F.col("row_id")).alias("k_tokens"))


# ---------------------------------------------------------------- fine-tuning examples

def _passage(title: Column | None, text: Column) -> Column:
    return T.title_text(title, text) if title is not None else text


def sample_negatives(examples: DataFrame, n: int, hard_ratio: float, hard_min_idx: int = 0,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """Per example, #hard ~ Binomial(n, ratio) capped by the hard negatives
    after ``hard_min_idx``; the rest random negatives capped by availability;
    picks without replacement by hash order.  Arrays are per-example lists
    (bounded by the example), ordered with array_sort on (u, position)."""
    ex = F.col("ex_id")
    hard = F.slice(F.coalesce(F.col("hard_negative_ctxs"), F.array()), hard_min_idx + 1, 1 << 30) \
        if hard_min_idx else F.coalesce(F.col("hard_negative_ctxs"), F.array())
    draws = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0),
                        lambda acc, j: acc + (uniform(seed, "nhard", ex, j) < F.lit(hard_ratio)).cast("int")) \
        if n > 0 else F.lit(0)
    n_hard = F.when(F.col("hard_negative_ctxs").isNull(), F.lit(0)).otherwise(F.least(draws, F.size(hard)))
    negs = F.coalesce(F.col("negative_ctxs"), F.array())
    n_rand = F.when(F.col("negative_ctxs").isNull(), F.lit(0)).otherwise(F.least(F.lit(n) - n_hard, F.size(negs)))

    def pick(arr: Column, tag: str, k: Column) -> Column:
        keyed = F.transform(arr, lambda x, i: F.struct(uniform(seed, tag, ex, i).alias("u"), i.alias("i"), x.alias("x")))
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["x"])

    return examples.withColumn("_h", hard).withColumn("_nh", n_hard).withColumn("_nr", n_rand).select(
        "*", F.concat(pick(negs, "rand", F.col("_nr")), pick(F.col("_h"), "hard", F.col("_nh"))).alias("negatives")
    ).drop("_h", "_nh", "_nr")


def build_finetune_examples(examples: DataFrame, training: bool, n_negatives: int = 1,
                            hard_ratio: float = 0.0, hard_min_idx: int = 0, normalize: bool = False,
                            seed: int = DEFAULT_SEED) -> DataFrame:
    """(ex_id, query, gold, negatives ARRAY<STRING>) with P1 on passages and
    optional F1 on all texts.  Training: random positive + sampled negatives;
    evaluation: first positive + first negative."""
    if training:
        pos = F.element_at(F.col("positive_ctxs"), (F.floor(
            uniform(seed, "gold", F.col("ex_id")) * F.size("positive_ctxs")) + 1).cast("int"))
        base = sample_negatives(examples, n_negatives, hard_ratio, hard_min_idx, seed)
    else:
        pos = F.element_at(F.col("positive_ctxs"), 1)
        base = examples.withColumn("negatives", F.when(
            F.col("negative_ctxs").isNotNull() & (F.size("negative_ctxs") > 0),
            F.slice(F.col("negative_ctxs"), 1, 1)).otherwise(F.array()))
    norm = (lambda c: T.normalize_text(c)) if normalize else (lambda c: c)
    passage = lambda s: _passage(s["title"], s["text"])
    return base.withColumn("_g", pos).select(
        "ex_id",
        norm(F.col("question")).alias("query"),
        norm(passage(F.col("_g"))).alias("gold"),
        F.transform("negatives", lambda s: norm(passage(s))).alias("negatives"))


def collate_finetune(examples: DataFrame, batch_size: int, order_col: str = "ex_id") -> DataFrame:
    """Per batch, the passage list = golds in batch order, then every
    example's negatives flattened; rows (batch, passage_pos, is_gold, ex_id, text)."""
    from lexkit.operators.windows import assign_batches
    b = assign_batches(examples, batch_size, [F.col(order_col)])
    golds = b.select("batch", F.col("pos_in_batch").cast("bigint").alias("passage_pos"),
                     F.lit(True).alias("is_gold"), "ex_id", F.col("gold").alias("text"))
    n_in_batch = F.count(F.lit(1)).over(Window.partitionBy("batch"))
    negs = (b.withColumn("_bs", n_in_batch)
              .select("batch", "pos_in_batch", "ex_id", "_bs", F.posexplode("negatives").alias("ni", "text")))
    wn = Window.partitionBy("batch").orderBy("pos_in_batch", "ni")
    negs = negs.select("batch", (F.col("_bs") + F.row_number().over(wn) - 1).cast("bigint").alias("passage_pos"),
                       F.lit(False).alias("is_gold"), "ex_id", "text")
    return golds.unionByName(negs)


def shuffle_tokens_rows(df: DataFrame, key_col: str, arr_col: str, p: float, seed: int, tag: str,
                        out: str) -> DataFrame:
    """F16 for long arrays, in the row: the k-th chosen position (u < p) takes the
    value of the k-th chosen in hash order; both parts are then merged in position
    order.  No element is shuffled and the work is that of sorting the chosen ones
    (the column form in ``functions.arrays`` is for short arrays).  A row without a
    key has no draws and an empty list."""
    key, arr = F.col(key_col), F.col(arr_col)
    at = F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_u", F.transform(at, lambda i: uniform(seed, tag, key, i) < F.lit(p)))
    df = df.withColumn("_c", F.filter(at, lambda i: F.get("_u", i)))
    perm = F.sort_array(F.transform("_c", lambda i: F.struct(uniform(seed, tag + ":perm", key, i).alias("u"), i.alias("i"))))
    df = df.withColumn("_p", F.transform(perm, lambda s: s["i"]))
    kept = F.transform(F.filter(at, lambda i: ~F.get("_u", i)), lambda i: F.struct(i.alias("i"), F.get(arr, i).alias("x")))
    moved = F.zip_with("_c", "_p", lambda i, j: F.struct(i.alias("i"), F.get(arr, j).alias("x")))
    merged = F.transform(F.sort_array(F.concat(kept, moved)), lambda s: s["x"])
    return df.withColumn(out, F.when(key.isNotNull(), merged).otherwise(F.slice(arr, 1, 0))).drop("_u", "_c", "_p")
