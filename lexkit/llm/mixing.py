"""Operator 3, mixing sources to target weights: cube-method balanced sampling.

Every source has a target number of words; a document of it is taken
``target / source_size`` times on average.  The whole part of that rate is
taken outright, the fractional part is an inclusion probability.  The flight
phase of the cube method moves the probabilities of a block of documents along
the null space of two balancing constraints (documents taken, words taken)
until at most two documents of the block are undecided.  Undecided documents of
many blocks form new blocks, level by level, until one block per source is
left; its last one or two documents are the landing problem.  There the
document that stays between 0 and 1 is taken in part (its leading words), so
the words taken meet the target.

Blocks are bounded: a source holding a third of all rows is split over as many
blocks as its rows need.  Only (id, source, size) rows move, never texts.

Defined cases: a null source is a source of its own, after all others; null or
empty texts have size 0; repeated rows are units of their own; an empty table
gives an empty table; reruns agree (seeded by ids, not by layout).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.llm.common import documents
from lexkit.llm.flatwords import WORD_PATTERN
from lexkit.operators.windows import ordered_index
from lexkit.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 4096
COPIES = 65_536             # copies of one row numbered by one task
SEED = 97
EPS = 1e-9


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, n) per source.

    Targets share ``share`` of all words by weight; none is above ``most`` times
    its source's size, the excess goes to the others by weight until none is
    above.  With level x a target is min(most * size, x * weight); x is found by
    a few scalar passes over the per-source table."""
    per = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("_last", F.col("source").isNull())
    per = ordered_index(per, ["_last", "source"], out="_i")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    per = materialize(per.withColumn("w", w).withColumn("cap", most * F.col("source_size")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.col("cap") <= level * F.col("w")
        full, rest, n = per.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w"))),
                                F.sum(over.cast("int"))).first()
        if n == capped or not rest:
            break
        capped, level = n, (share * total - (full or 0.0)) / rest
    return per.select("source", "source_size", "n",
                      F.least("cap", F.lit(float(level)) * F.col("w")).cast("double").alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping sum(pi) and sum(pi * size), until
    at most two are strictly between."""
    pi = pi.tolist()
    x = size.astype(float).tolist()
    open_ = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    draws = iter(rng.random(2 * len(open_) + 4).tolist())
    window, rest = open_[:3], iter(open_[3:])
    while len(window) == 3:
        a, b, c = window
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / v if v > 0 else -pi[i] / v for i, v in zip(window, u) if v)
        down = min(pi[i] / v if v > 0 else (pi[i] - 1) / v for i, v in zip(window, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        keep = []
        for i, v in zip(window, u):
            p = pi[i] + step * v
            pi[i] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
            if 0.0 < pi[i] < 1.0:
                keep.append(i)
        if len(keep) == 3:  # rounding left the border unreached: settle the nearest one
            i = min(keep, key=lambda k: min(pi[k], 1 - pi[k]))
            pi[i] = float(round(pi[i]))
            keep.remove(i)
        while len(keep) < 3 and (nxt := next(rest, None)) is not None:
            keep.append(nxt)
        window = keep
    return np.array(pi)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the last undecided units: whole ones while their words still fit
    what is to be taken, the one that does not fit in part."""
    pi = pi.copy()
    open_ = [i for i in np.argsort(-pi, kind="stable") if EPS < pi[i] < 1 - EPS]
    words = float(sum(pi[i] * size[i] for i in open_))
    for i in open_:
        pi[i] = min(1.0, words / size[i]) if size[i] > 0 else float(round(pi[i]))
        words -= pi[i] * size[i]
    return pi


def _block_flight(seed: int, level: int):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "copy", "size"], kind="stable")
        size = pdf["size"].to_numpy()
        rng = np.random.default_rng([seed, level, int(pdf["block"].iloc[0]), len(pdf), int(size.sum() % 2**31)])
        order = rng.permutation(len(pdf))
        pi = np.empty(len(pdf))
        pi[order] = flight(pdf["pi"].to_numpy()[order], size[order], rng)
        return pdf.assign(pi=land(pi, size) if pdf["blocks"].iloc[0] == 1 else pi)

    return fly


def cube_sample(units: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """``units`` (doc_id, copy, source, size, pi, n) with pi settled: 0, 1 or,
    for one unit per source at most, the part that is taken."""
    spark = units.sparkSession
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))
    cur = units.withColumn("blocks", blocks.cast("bigint")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy"), F.col("blocks")))
    schema = "doc_id bigint, copy bigint, source string, size bigint, pi double, blocks bigint, block bigint"
    settled: list[DataFrame] = []
    level = 0
    while True:
        done = materialize(cur.select(*[c.split()[0] for c in schema.split(", ")])
                           .groupBy("source", "block").applyInPandas(_block_flight(seed, level), schema))
        undecided = done.filter((F.col("blocks") > 1) & (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS))
        settled.append(done.filter((F.col("blocks") == 1) | (F.col("pi") <= EPS) | (F.col("pi") >= 1 - EPS)))
        if undecided.isEmpty():
            break
        # two undecided units a block: this many blocks fill one block of the next level
        fan = max(2, block_rows // 2)
        cur = undecided.withColumn("block", F.floor(F.col("block") / fan).cast("bigint")) \
                       .withColumn("blocks", F.ceil(F.col("blocks") / fan).cast("bigint"))
        level += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def numbered_copies(rows: DataFrame, most: int = COPIES) -> DataFrame:
    """``rows`` (doc_id, source, size, m) as m units with copy = 1 .. m each, so no
    two equal rows share a draw.  A row that occurs more than ``most`` times is
    first cut into ranges of that many copies, which are dealt to all tasks."""
    one = ["doc_id", "source", "size"]
    few = rows.filter(F.col("m") <= most).select(*one, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("copy"))
    last = F.expr(f"(m - 1) div {most}")
    ranges = rows.filter(F.col("m") > most).select(*one, "m", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range")) \
                 .repartition("doc_id", "source", "size", "range")
    many = ranges.select(*one, F.explode(F.sequence(F.col("range") * most + 1,
                                                    F.least(F.col("m"), (F.col("range") + 1) * most))).alias("copy"))
    return few.unionByName(many)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken.

    ``taken`` is the number of words the mix takes of it, repeats counted."""
    rows = materialize(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"),
                                   word_count(text).alias("size"))
                           .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    units = numbered_copies(rows)
    targets = materialize(source_targets(units, weights, share, most))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate) \
                 .withColumn("pi", F.col("rate") - F.floor("rate"))
    done = cube_sample(units.select("doc_id", "copy", "source", "size", "pi", "n"), seed=seed)
    whole = F.floor("rate")
    return (done.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate)
                .select("doc_id", "copy", "source", "size", "source_size", "target",
                        (whole * F.col("size") + F.round(F.col("pi") * F.col("size"))).cast("bigint").alias("taken")))


def apply_mix(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", source: str = "source",
              text: str = "text") -> DataFrame:
    """The mix itself: every document as many times as it is taken, a document
    taken in part cut after that part's last word.  Columns as in ``docs``."""
    takes = mixed.groupBy("doc_id", "source", "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    # equal rows differ in at most three values: whole part, one more, one in part
    takes = takes.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n"))).alias("takes"),
                                                          F.sum("n").alias("rows"))
    # the document travels as one column, so its own column names meet no others
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).cast("bigint").alias("id"), F.col(source).alias("src"),
                    word_count(text).alias("words"))
    j = d.join(takes, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("src").eqNullSafe(F.col("source"))
               & (F.col("words") == F.col("size"))).select("doc", "id", "src", "size", "takes", "rows")
    one = j.filter("rows = 1").withColumn("t", F.expr("takes[0].taken"))
    many = ordered_index(j.filter("rows > 1"), [F.col("doc")[text]], ["id", "src", "size"], out="nth")
    many = many.withColumn("t", F.expr("CASE WHEN nth < takes[0].n THEN takes[0].taken WHEN nth < takes[0].n "
                                       "+ get(takes, 1).n THEN get(takes, 1).taken ELSE get(takes, 2).taken END"))
    j = one.unionByName(many.drop("nth")).filter("t > 0")
    full = F.expr("array_repeat(size, cast(t div greatest(size, 1) as int))")
    part = F.expr("IF(t % greatest(size, 1) > 0, array(t % greatest(size, 1)), array())")
    j = j.withColumn("take", F.explode(F.concat(full, part)))
    whole = F.col("doc")[text]
    lead = F.slice(F.regexp_extract_all(whole, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("take").cast("int"))
    cut = F.when(F.col("take") >= F.col("size"), whole).otherwise(F.concat_ws(" ", lead))
    return j.select(*[cut.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources weigh 5, 2, 1, repeating."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
