"""Training of the learned lexical scorer.

The model is one weight per vocabulary token plus one saturation scalar beta:
    S[d, q] = sum over shared tokens t of w_t * tf/(tf + e^beta)   (J1 + F9)
with the symmetric in-batch loss of ``contrastive.lexical_batch_loss`` (A7).

AdamW applies to every token in every step (decay, moments and bias correction,
as a dense optimizer does).  A step needs the weights of the one before, so steps
follow each other; those of small batches are taken by the segment:

* tokens are numbered inside their batch first, in all tasks at once; only tokens
  that a document and a query of the batch share are kept, with their counts, as
  the others have no gradient;
* a segment is a run of batches with ``SEGMENT_PAIRS`` pairs and ``SEGMENT_ENTRIES``
  entries at most.  One group holds them and the weights of their tokens and takes
  the steps, each on the weights the step before left, in windows of ``WINDOW``
  steps: only the words of a window are moved step by step.  After every step that is
  saved, and the last, it hands on the words moved since, so saves cut no segment;
* steps without a gradient (of words between their windows, of the other tokens) are
  taken when they are needed, where the tokens are: one by one while the momentum can
  still change a weight, then at once.

So a segment, not a step, costs a few jobs, and what a group holds is bounded.
States are saved while the next segment is on its way.
Batches of over ``batch_scores.DOC_BLOCK`` pairs are taken one step at a time: the
blocked pass over the batch (``batch_scores``), which gives loss and gradients
without a row per (document, query, token), and AdamW as a projection of weights
LEFT JOIN gradients.

The batches are written in order, so a segment reads the row groups of its
batches and not the whole table.  The weight table is written to the checkpoint
folder after every segment, so lineage never grows with the loop and a lost
executor never forces a replay of earlier steps; earlier tables are removed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.functions import schedules as SCH
from lexkit.functions.hashing import uniform
from lexkit.operators import batch_scores
from lexkit.operators.joins import MAX_BROADCAST_ROWS, bounded_broadcast
from lexkit.session import discard, materialize, written

# Optimizer defaults of the reference trainer.
ADAM_BETA1, ADAM_BETA2, ADAM_EPS, WEIGHT_DECAY = 0.9, 0.98, 1e-6, 0.01
SEGMENT_PAIRS = 1 << 16    # pairs of the steps taken in one pass, and
SEGMENT_ENTRIES = 1 << 23  # (row, token) entries of their coded batches, about
WINDOW = 128               # steps that move the same words
SAVERS = 3                 # states written at a time


@dataclass
class LexicalModel:
    weights: DataFrame            # (token, weight, m, v)
    beta: float
    beta_m: float = 0.0
    beta_v: float = 0.0
    step: int = 0
    log: list = field(default_factory=list)
    options: dict = field(default_factory=dict)     # schedule of the run that saved it
    path: str | None = None       # written weights of the latest step


def init_model(vocab: DataFrame, seed: int = 0) -> LexicalModel:
    """Weights ~ U[0, 1) per token and beta ~ U[0, 1) (hash uniforms)."""
    w = vocab.select("token").distinct().select(
        "token", uniform(seed, "init", F.col("token")).alias("weight"),
        F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    beta = vocab.sparkSession.range(1).select(uniform(seed, "beta", F.lit(0))).first()[0]
    return LexicalModel(materialize(w), float(beta))


def step_gradients(pairs: DataFrame, weights: DataFrame, beta: float):
    """dL/dw (token, g) and dL/dbeta for one set of batches (pairs: batch, pos,
    q_tokens, k_tokens)."""
    _, grad_w, grad_b = batch_scores.loss_and_gradients(pairs, weights, beta)
    return grad_w, grad_b


def adamw(model: LexicalModel, grad_w: DataFrame, grad_b: float, lr: float) -> LexicalModel:
    """One AdamW step (decoupled weight decay, bias-corrected moments) over every token."""
    t = model.step + 1
    c1, c2 = 1.0 - ADAM_BETA1 ** t, 1.0 - ADAM_BETA2 ** t
    g = F.coalesce(F.col("g"), F.lit(0.0))
    w = model.weights.join(grad_w, "token", "left")
    m = F.lit(ADAM_BETA1) * F.col("m") + F.lit(1 - ADAM_BETA1) * g
    v = F.lit(ADAM_BETA2) * F.col("v") + F.lit(1 - ADAM_BETA2) * g * g
    w = w.select("token", (F.col("weight") * F.lit(1 - lr * WEIGHT_DECAY)).alias("weight"), m.alias("m"), v.alias("v"))
    w = w.select("token", (F.col("weight") - F.lit(lr) * (F.col("m") / F.lit(c1))
                           / (F.sqrt(F.col("v") / F.lit(c2)) + F.lit(ADAM_EPS))).alias("weight"), "m", "v")
    bm = ADAM_BETA1 * model.beta_m + (1 - ADAM_BETA1) * grad_b
    bv = ADAM_BETA2 * model.beta_v + (1 - ADAM_BETA2) * grad_b * grad_b
    beta = model.beta * (1 - lr * WEIGHT_DECAY)
    beta = beta - lr * (bm / c1) / (math.sqrt(bv / c2) + ADAM_EPS)
    table, path = written(w)
    return LexicalModel(table, beta, bm, bv, t, model.log, model.options, path)


def adamw_arrays(w, m, v, g, t: int, lr: float) -> tuple:
    """Step ``t`` of AdamW (as ``adamw``) on numbers or arrays."""
    m = ADAM_BETA1 * m + (1 - ADAM_BETA1) * g
    v = ADAM_BETA2 * v + (1 - ADAM_BETA2) * g * g
    c1, c2 = 1.0 - ADAM_BETA1 ** t, 1.0 - ADAM_BETA2 ** t
    return w * (1 - lr * WEIGHT_DECAY) - lr * (m / c1) / (np.sqrt(v / c2) + ADAM_EPS), m, v


def coded_batches(pairs: DataFrame) -> DataFrame:
    """A row per batch, in order of the batch: ``n`` pairs, the ``words`` its documents
    and queries share, and by number of word the entries of documents (``d``, ``dt``,
    ``tf``) and of queries (``q``, ``qt``); rows are numbered by ``pos``."""
    kind, word = pairs.schema["batch"].dataType.simpleString(), pairs.schema["k_tokens"].dataType.elementType.simpleString()
    names = ("d", "dt", "tf", "q", "qt")
    schema = f"batch {kind}, n int, words array<{word}>, " + ", ".join(f"{c} array<int>" for c in names)

    def coded(t: pa.Table) -> pa.RecordBatch:
        n, flat, row = len(t), [], []
        for c in ("k_tokens", "q_tokens"):
            size = pc.fill_null(pc.list_value_length(t.column(c)), 0).to_numpy().astype(np.int64)
            row.append(np.repeat(np.arange(n), size))
            flat.append(pc.list_flatten(t.column(c)))
        both = pa.chunked_array([x for f in flat for x in f.cast(flat[0].type).chunks], flat[0].type).combine_chunks().dictionary_encode()
        code = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        k, q = code[:len(row[0])], code[len(row[0]):]
        shared = np.zeros(len(both.dictionary) + 1, bool)
        shared[np.intersect1d(k, q)] = True
        shared[-1] = False                                                  # no token
        number = np.cumsum(shared) - 1
        (kt, d), tf = _counted(k, row[0], shared, n)
        (qt, q), _ = _counted(q, row[1], shared, n)
        words = both.dictionary.filter(pa.array(shared[:-1]))
        lists = [words, *[pa.array(x, pa.int32()) for x in (d, number[kt], tf, q, number[qt])]]
        return pa.RecordBatch.from_arrays(
            [t.column("batch").combine_chunks()[:1], pa.array([n], pa.int32()),
             *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]], ["batch", "n", "words", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            ids = t.column("batch").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and held[0].column("batch")[0].as_py() != ids[lo]:
                    yield coded(pa.concat_tables(held))
                    held = []
                held.append(t.slice(lo, hi - lo))
        if held:
            yield coded(pa.concat_tables(held))

    rows = pairs.select("batch", "pos", "q_tokens", "k_tokens").repartitionByRange("batch").sortWithinPartitions("batch", "pos")
    return rows.mapInArrow(run, schema)


def _counted(code: np.ndarray, row: np.ndarray, kept: np.ndarray, n: int) -> tuple[tuple, np.ndarray]:
    """((code, row), how often) of the kept codes, in ascending order."""
    e = kept[code]
    key, times = np.unique(code[e] * n + row[e], return_counts=True)
    return np.divmod(key, n), times


def segment_steps(coded: DataFrame, model: LexicalModel, lrs: list[float], saved: list[int]) -> DataFrame:
    """The steps of consecutive small batches (rows of ``coded_batches``), one per
    learning rate: rows (token, weight, m, v, at) of their words after step ``at``, a
    row per word up to each of the steps ``saved`` and to the last if it was moved
    since the one before, and a row without token per step (step, loss, acc, beta,
    beta_m, beta_v, known: how many words)."""
    kind = model.weights.schema["token"].dataType.simpleString()
    schema = (f"token {kind}, weight double, m double, v double, at int, step int, loss double, acc double, "
              "beta double, beta_m double, beta_v double, known int")
    first, start = model.step, (model.beta, model.beta_m, model.beta_v)
    kept = {*saved, first + len(lrs)}

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("batch").combine_chunks()
        known = known.sort_by("token")
        tokens = known.column("token").combine_chunks()
        w, m, v = (known.column(c).to_numpy().astype(float) for c in ("weight", "m", "v"))
        ends, flat = {}, {}
        for c in ("words", "d", "dt", "tf", "q", "qt"):
            ends[c] = np.concatenate([[0], np.cumsum(pc.list_value_length(t.column(c)).to_numpy())])
            flat[c] = pc.list_flatten(t.column(c))
        place = pc.fill_null(pc.index_in(flat["words"], value_set=pc.cast(tokens, flat["words"].type)), -1).to_numpy().astype(np.int64)
        entries = {c: flat[c].to_numpy() for c in ("d", "dt", "tf", "q", "qt")}
        sizes = t.column("n").to_numpy()
        beta, steps, states = start, [], []
        last, fresh = np.full(len(w), first), np.zeros(len(w), bool)
        cuts = sorted({0, len(lrs), *range(0, len(lrs), WINDOW), *(x - first for x in kept)})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            span = place[ends["words"][a]:ends["words"][b]]
            held = np.unique(span[span >= 0])
            x, since = [c[held] for c in (w, m, v)], last[held]
            for at in np.unique(since[since < first + a]):
                e = since == at
                for c, new in zip(x, idle_steps(*[c[e] for c in x], int(at), lrs[at - first:a]), strict=True):
                    c[e] = new
            move, scale = np.empty(len(held)), np.empty(len(held))
            for i in range(a, b):
                step, lr = first + i + 1, lrs[i]
                here = place[ends["words"][i]:ends["words"][i + 1]]
                d, dt, tf, q, qt = (entries[c][ends[c][i]:ends[c][i + 1]] for c in ("d", "dt", "tf", "q", "qt"))
                if (here < 0).any():                # words without a weight
                    number, e, f = np.cumsum(here >= 0) - 1, here[dt] >= 0, here[qt] >= 0
                    d, dt, tf, q, qt, here = d[e], number[dt[e]], tf[e], q[f], number[qt[f]], here[here >= 0]
                here = np.searchsorted(held, here)
                loss, acc, g, by_beta = batch_scores.coded_batch(int(sizes[i]), d, dt, tf, q, qt, x[0][here], beta[0])
                # ``adamw_arrays`` in place, the gradient is 0 elsewhere
                c1, c2 = 1.0 - ADAM_BETA1 ** step, 1.0 - ADAM_BETA2 ** step
                x[1] *= ADAM_BETA1
                x[1][here] += (1 - ADAM_BETA1) * g
                x[2] *= ADAM_BETA2
                x[2][here] += (1 - ADAM_BETA2) * g * g
                np.sqrt(np.divide(x[2], c2, out=scale), out=scale)
                scale += ADAM_EPS
                np.divide(x[1], c1, out=move)
                move *= lr
                move /= scale
                x[0] *= 1 - lr * WEIGHT_DECAY
                x[0] -= move
                beta = tuple(float(y) for y in adamw_arrays(*beta, by_beta, step, lr))
                steps.append((step, loss, acc, *beta, len(w)))
            for c, new in zip((w, m, v), x, strict=True):
                c[held] = new
            last[held], fresh[held] = first + b, True
            if first + b in kept:
                e = np.flatnonzero(fresh)
                states.append([tokens.take(pa.array(e)), *[pa.array(c[e]) for c in (w, m, v)], pa.array(last[e], pa.int32())])
                fresh[:] = False
        names = ("step", "loss", "acc", "beta", "beta_m", "beta_v", "known")
        types = (pa.int32(), *[pa.float64()] * 5, pa.int32())
        columns = ["token", "weight", "m", "v", "at", *names]
        log = [pa.nulls(len(steps), x) for x in (tokens.type, *[pa.float64()] * 3, pa.int32())]
        log += [pa.array(x, kind) for x, kind in zip(zip(*steps, strict=True), types, strict=True)]
        return pa.concat_tables([*[pa.table([*s, *[pa.nulls(len(s[0]), x) for x in types]], columns) for s in states], pa.table(log, columns)])

    seen = coded.select(F.explode("words").alias("token")).distinct()
    known = model.weights.join(bounded_broadcast(seen), "token", "left_semi").select(F.lit(0).alias("kg"), "token", "weight", "m", "v")
    rows = coded.select(F.lit(0).alias("pg"), *coded.columns)
    return rows.groupBy("pg").cogroup(known.groupBy("kg")).applyInArrow(run, schema)


def idle_steps(w: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, lrs: list[float]) -> tuple:
    """(w, m, v) after the steps that follow ``step``, none with a gradient.  What the
    momentum still moves falls faster than 0.91 a step (0.9 / sqrt(0.98)): weights
    are moved while all that is left is over 1e-17, the decay is one product."""
    keep = np.concatenate([[1.0], np.cumprod(1 - np.array(lrs) * WEIGHT_DECAY)])
    ratio = ADAM_BETA1 / math.sqrt(ADAM_BETA2)
    most = max(lrs, default=0.0) / (1 - ratio)
    out, live, x = w * keep[-1], np.arange(len(w)), (w, m, v)
    for i, lr in enumerate(lrs):
        if i % 32 == 0:
            c1, c2 = 1.0 - ADAM_BETA1 ** (step + i + 1), 1.0 - ADAM_BETA2 ** (step + i + 1)
            left = most * np.abs(x[1]) / c1 / (np.sqrt(x[2] / max(c2, ADAM_EPS)) + ADAM_EPS) > 1e-17
            out[live[~left]] = x[0][~left] * (keep[-1] / keep[i])
            live, x = live[left], tuple(a[left] for a in x)
            if not len(live):
                break
        x = adamw_arrays(*x, 0.0, step + i + 1, lr)
    out[live] = x[0]
    return out, m * ADAM_BETA1 ** len(lrs), v * ADAM_BETA2 ** len(lrs)


def after_segment(weights: DataFrame, moved: DataFrame, step: int, lrs: list[float], small: bool = False) -> DataFrame:
    """``weights`` after the steps of a segment that began after ``step``: tokens in
    ``moved`` (broadcast if ``small``) go on from their state ``at`` a step there, all
    of them take the rest of the steps without a gradient."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("weight", "m", "v")]
            at = b.column("at").to_numpy(zero_copy_only=False)
            for begin in np.unique(at):
                e = at == begin
                for c, new in zip(x, idle_steps(*[c[e] for c in x], int(begin), lrs[begin - step:]), strict=True):
                    c[e] = new
            yield pa.RecordBatch.from_arrays([b.column("token"), *[pa.array(c) for c in x]], ["token", "weight", "m", "v"])

    new = moved.groupBy("token").agg(F.max(F.struct("at", "weight", "m", "v")).alias("_x"))
    both = weights.join(F.broadcast(new) if small else new, "token", "left").select(
        "token", *[F.coalesce(f"_x.{c}", c).alias(c) for c in ("weight", "m", "v")], F.coalesce("_x.at", F.lit(step)).alias("at"))
    return both.mapInArrow(rest, weights.select("token", "weight", "m", "v").schema)


def take_segment(coded: DataFrame, model: LexicalModel, lrs: list[float], saved: list[int]) -> tuple[LexicalModel, list[LexicalModel], str]:
    """(``model`` after the steps of ``coded``, whole consecutive small batches; the
    models of the steps ``saved``; the path of the states they are read from)."""
    out, out_path = written(segment_steps(coded, model, lrs, saved))
    steps = out.filter("token IS NULL AND step IS NOT NULL").orderBy("step").collect()      # a row per step
    model.log.extend((r["step"], r["loss"], r["acc"], lr) for r, lr in zip(steps, lrs, strict=True))
    small = steps[0]["known"] <= MAX_BROADCAST_ROWS

    def after(r) -> DataFrame:
        return after_segment(model.weights, out.filter(F.col("at") <= r["step"]), model.step, lrs[:r["step"] - model.step], small)

    last = steps[-1]
    table, path = written(after(last))
    state = lambda r, t, p: LexicalModel(t, r["beta"], r["beta_m"], r["beta_v"], r["step"], model.log, model.options, p)
    end = state(last, table, path)
    return end, [end if r is last else state(r, after(r), None) for r in steps if r["step"] in saved], out_path


def lr_at(step: int, base_lr: float, warmup: int, total: int, scheduler: str = "linear", ratio: float = 0.0) -> float:
    """F22 / F23 evaluated for one step (the same expressions as the column forms)."""
    if scheduler == "linear":
        f = (1 - ratio) * step / max(1, warmup) if step < warmup else \
            max(0.0, 1.0 + (ratio - 1) * (step - warmup) / max(1.0, total - warmup))
    else:
        f = step / max(1, warmup) if step < warmup else \
            ratio + (1 - ratio) * math.cos(0.5 * math.pi * (step - warmup) / max(1, total - warmup))
    return base_lr * f


def train_lexical(pairs: DataFrame, model: LexicalModel, steps: int, base_lr: float = 0.01, warmup: int = 12,
                  total: int | None = None, scheduler: str = "linear", lr_ratio: float = 0.0,
                  save_dir: str | None = None, save_every: int = 160) -> LexicalModel:
    """One optimiser step per batch, batches in order, cycling over epochs.

    Logs (step, loss, acc, lr) per step; saves at step 1, every ``save_every``
    steps and at the end when ``save_dir`` is given (S9)."""
    total = total or steps
    model.options = {"base_lr": base_lr, "warmup": warmup, "total": total, "scheduler": scheduler, "lr_ratio": lr_ratio}
    sizes = dict(pairs.groupBy("batch").agg(F.count(F.lit(1))).collect())       # a number per batch
    n_batches = max(sizes) + 1
    rate = lambda step: lr_at(step, base_lr, warmup, total, scheduler, lr_ratio)
    end = model.step + steps
    due = lambda step: bool(save_dir) and (step == 1 or step % save_every == 0 or step == end)
    if steps and max(sizes.values()) <= batch_scores.DOC_BLOCK:
        return _by_segments(pairs, model, end, sizes, n_batches, rate, due, save_dir)
    spark = pairs.sparkSession
    pairs, pairs_path = written(pairs.select("batch", "pos", "q_tokens", "k_tokens").repartitionByRange("batch")
                                     .sortWithinPartitions("batch"))
    for i in range(steps):
        b = pairs.filter(F.col("batch") == (i % n_batches))
        lr = rate(model.step)
        stats, grad_w, grad_b = batch_scores.loss_and_gradients(b, model.weights, model.beta)
        stats, before = stats.first(), model.path
        model = adamw(model, grad_w, grad_b, lr)
        if before:
            discard(spark, before)
        model.log.append((model.step, float(stats["loss"]), float(stats["acc"]), lr))
        if due(model.step):
            save_model(model, save_dir)
    discard(spark, pairs_path)
    return model


def _by_segments(pairs: DataFrame, model: LexicalModel, end: int, sizes: dict, n_batches: int, rate: Callable[[int], float],
                 due: Callable[[int], bool], save_dir: str | None) -> LexicalModel:
    """The steps of small batches up to step ``end``, by the segment."""
    spark = pairs.sparkSession
    coded, coded_path = written(coded_batches(pairs))
    entries = dict(coded.select("batch", F.size("d") + F.size("q")).collect())              # a number per batch
    first = model.step
    waiting: list = []

    def settle() -> None:
        for saves, paths in waiting:
            for s in saves:
                s.result()
            discard(spark, *paths)
        waiting.clear()

    with ThreadPoolExecutor(SAVERS) as pool:
        while model.step < end:
            begin = at = (model.step - first) % n_batches
            held = many = 0
            while model.step + at - begin < end and at < n_batches and (at == begin or (
                    held + sizes[at] <= SEGMENT_PAIRS and many + entries[at] <= SEGMENT_ENTRIES)):
                held, many, at = held + sizes[at], many + entries[at], at + 1
            lrs = [rate(model.step + i) for i in range(at - begin)]
            saved = [s for s in range(model.step + 1, model.step + len(lrs) + 1) if due(s)]
            before = model.path
            model, states, out_path = take_segment(coded.filter(F.col("batch").between(begin, at - 1)), model, lrs, saved)
            settle()            # the states of the segment before
            waiting.append(([pool.submit(save_model, s, save_dir) for s in states], [out_path, *([before] if before else [])]))
        settle()
    discard(spark, coded_path)
    return model


def training_log(spark: SparkSession, model: LexicalModel) -> DataFrame:
    """The per-step log as a DataFrame (append it with write.mode('append'))."""
    return spark.createDataFrame(model.log, "step int, loss double, acc double, lr double")


def save_model(model: LexicalModel, root: str) -> None:
    """Weights and optimiser state under step=N; parameters in a side table."""
    model.weights.write.mode("overwrite").parquet(f"{root}/weights_step_{model.step}")
    row = (model.step, model.beta, model.beta_m, model.beta_v, json.dumps(model.options, sort_keys=True))
    model.weights.sparkSession.createDataFrame(
        [row], "step int, beta double, beta_m double, beta_v double, options string"
    ).coalesce(1).write.mode("overwrite").parquet(f"{root}/params/saved_step={model.step}")


def load_model(spark: SparkSession, root: str, step: int | str = "latest", reset_params: bool = False) -> LexicalModel:
    """Restore a saved step ('latest' = the largest saved step); with
    ``reset_params`` the optimiser state is zeroed."""
    params = spark.read.parquet(f"{root}/params")
    if step == "latest":
        step = params.agg(F.max("step")).first()[0]
    p = params.filter(F.col("step") == step).first()
    w = spark.read.parquet(f"{root}/weights_step_{step}").select("token", "weight", "m", "v")
    if reset_params:
        w = w.withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0))
        return LexicalModel(w, p["beta"], 0.0, 0.0, int(step))
    return LexicalModel(w, p["beta"], p["beta_m"], p["beta_v"], int(step), options=json.loads(p["options"]))


def continue_training(spark: SparkSession, root: str, pairs: DataFrame, steps: int) -> LexicalModel:
    """Go on from the latest saved step with its schedule and options."""
    model = load_model(spark, root)
    return train_lexical(pairs, model, steps, save_dir=root, **model.options)


def momentum_update(key_weights: DataFrame, query_weights: DataFrame, m: float) -> DataFrame:
    """F24 over weight tables: k * m + q * (1 - m) per token (inner join)."""
    return (key_weights.select("token", F.col("weight").alias("_k"))
            .join(query_weights.select("token", F.col("weight").alias("_q")), "token")
            .select("token", SCH.momentum_update(F.col("_k"), F.col("_q"), m).alias("weight")))


def param_count(weights: DataFrame) -> DataFrame:
    """Number of parameters (weights + beta) in millions."""
    return weights.agg(((F.count(F.lit(1)) + 1) / 1e6).alias("params_m"))
