"""Operator 12, source divergence audit over a frequent-pattern tree of term rows.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents.  A
group (language, source) gives a kept term p = 1 + floor(SCALE (count + 2) /
(N + 2 V)); two groups differ by f(p, q) = floor((p - q)^2 / (p + q)) summed over
the kept terms.  Summing every term for every pair of sources is dense work; most
terms occur in few sources and many have the same few counts:

1. Slices of texts count their terms per (language, source) before the shuffle;
   the counts of one kept term, ordered by source, are its row.
2. A pair of sources starts from V f(p0, q0), all counts zero.  A nonzero count
   changes that by f(p, q0) - f(p0, q0): once per distinct (source, count), times
   the terms that have it, for each other source of the language.
3. Where both counts are nonzero a pair correction f(p, q) - f(p, q0) - f(p0, q)
   + f(p0, q0) makes up the rest.  Rows are inserted into a tree as paths of
   (source, count), equal paths with their multiplicity; a node's multiplicity
   is the number of terms whose paths go through it, and the correction of a
   node and an ancestor is computed once and multiplied by that.

Corrections are additive, so the tree may be cut anywhere: the sorted paths are
dealt over ranges and each task builds the tree of its paths, slice by slice.
Sums per (language, pair) are combined before the last shuffle.  All arithmetic
is on whole numbers.

Defined cases: null text, lang and source count as ''; a language without kept
terms has value 0 for every pair and no term rows; a language with one source
has no pair rows; repeated rows count each for itself; an empty table gives no
row; texts are read whole; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.llm.common import documents
from lexkit.llm.exactwords import byte_class, word_array
from lexkit.llm.flatwords import text_slices
from lexkit.operators.joins import bounded_broadcast
from lexkit.session import materialize, shuffle_partitions

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
COMBINED = 1 << 18         # distinct (group, term) counts a task holds before it hands them on
PATH_NODES = 1 << 18       # path items of one slice of the tree
#: Letters and every non-ASCII character.
INSIDE = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slice_counts(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a slice of texts."""
    words, first = word_array(part.column("text"), INSIDE)
    coded = words.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(part.num_rows), np.diff(first))
    lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
    many = max(len(source.dictionary), 1)
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + source.indices.to_numpy(zero_copy_only=False)
    # per (document, term), then per (group, term)
    pair, n = np.unique(doc * width + code, return_counts=True)
    key, at = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
    total = np.bincount(at, n, len(key)).astype(np.int64)
    g, t = np.divmod(key, width)
    return pa.Table.from_arrays([lang.dictionary.take(pa.array(g // many)), source.dictionary.take(pa.array(g % many)),
                                 coded.dictionary.take(pa.array(t)), pa.array(total),
                                 pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))], schema=_COUNTS)


def _combined(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                held.append(_slice_counts(part))
                rows += len(held[-1])
                if rows > COMBINED:
                    held = [_combined(held)]
                    rows = len(held[0])
                    if rows > COMBINED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from _combined(held).to_batches()

    counts = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); the square stays below 2 ** 63 as p <= SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), whatever the size of the counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * kept))


def _corrections(p: np.ndarray, p0: np.ndarray, q: np.ndarray, q0: np.ndarray) -> np.ndarray:
    f = lambda a, b: (a - b) ** 2 // (a + b)
    return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)


def tree_corrections(lang: np.ndarray, first: np.ndarray, source: np.ndarray, count: np.ndarray, p: np.ndarray,
                     p0: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lang, ancestor's source, node's source, correction) summed over the tree of
    sorted paths: path i are the items ``first[i]:first[i + 1]``, ``terms[i]`` terms
    have it.  ``lang`` and ``source`` are numbers."""
    paths = len(lang)
    depth = np.diff(first)
    # length of the prefix that a path shares with the one before it
    shared = np.zeros(paths, np.int64)
    alive = np.flatnonzero(lang[1:] == lang[:-1]) + 1
    level = 0
    while len(alive):
        alive = alive[(depth[alive] > level) & (depth[alive - 1] > level)]
        a, b = first[alive] + level, first[alive - 1] + level
        alive = alive[(source[a] == source[b]) & (count[a] == count[b])]
        shared[alive] = level = level + 1
    after = np.concatenate([[0], np.cumsum(terms)])
    sums: dict[tuple[int, int, int], int] = {}
    for level in range(1, int(depth.max(initial=0))):
        # nodes of this level: paths that reach it and do not share it with the path before
        new = np.flatnonzero((depth > level) & (shared <= level))
        # a node ends at the next path that leaves its prefix
        leaves = np.flatnonzero(shared <= level)
        end = np.append(leaves, paths)[np.searchsorted(leaves, new, side="right")]
        times = after[end] - after[new]
        node = first[new] + level
        for up in range(level):
            above = first[new] + up
            value = _corrections(p[above], p0[above], p[node], p0[node]) * times
            key = np.stack([lang[new], source[above], source[node]], 1)
            distinct, at = np.unique(key, axis=0, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at.ravel(), value)
            for k, v in zip(map(tuple, distinct.tolist()), total.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
    if not sums:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    keys = np.array(list(sums), np.int64)
    return keys[:, 0], keys[:, 1], keys[:, 2], np.array(list(sums.values()), np.int64)


def pair_corrections(rows: DataFrame) -> DataFrame:
    """(lang, s, r, value): sums of the pair corrections of the sources numbered
    s < r, over rows (lang, path: array of (s, n, p, p0) ordered by s)."""
    paths = rows.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("terms"))
    spark = rows.sparkSession
    paths = (paths.repartitionByRange(shuffle_partitions(spark), "lang", "path").sortWithinPartitions("lang", "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("path")).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // PATH_NODES)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                lang = batch.column("lang").slice(a, b - a).dictionary_encode()
                items = pc.list_flatten(batch.column("path").slice(a, b - a))
                column = lambda name: items.field(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                which, s, r, value = tree_corrections(
                    lang.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                    np.concatenate([[0], np.cumsum(size[a:b])]), column("s"), column("n"), column("p"), column("p0"),
                    batch.column("terms").slice(a, b - a).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(which)), pa.array(s), pa.array(r), pa.array(value)],
                                                 ["lang", "s", "r", "value"])

    out = paths.mapInArrow(run, "lang string, s bigint, r bigint, value bigint")
    return out.groupBy("lang", "s", "r").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language,
    and the ``top_terms`` terms that stand out most from the language in a group."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                        for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    # one row per kept term: its nonzero counts by source
    kept = materialize(term_counts(src).groupBy("lang", "term").agg(
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("row"), F.sum("docs").alias("docs"),
        F.sum("n").alias("total")).filter(F.col("docs") >= min_docs).drop("docs"))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    per_group = (kept.select("lang", F.explode("row").alias("x")).groupBy("lang", F.col("x.source").alias("source"))
                     .agg(F.sum("x.n").alias("words")))
    # every occurring group, numbered by source inside its language; a row per group
    groups = src.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    groups = (groups.join(per_lang, "lang", "left").join(per_group, ["lang", "source"], "left")
              .na.fill(0, ["v", "all", "words"])
              .withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    groups = materialize(groups.select("lang", "source", "s", "v", "all", "words",
                                       F.when(F.col("v") > 0, _share(zero, F.col("words"), F.col("v"))).alias("p0")))
    known = bounded_broadcast(groups)
    cells = (kept.select("lang", "term", "total", F.explode("row").alias("x"))
                 .select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
                 .join(known, ["lang", "source"])
                 .withColumn("p", _share(F.col("n"), F.col("words"), F.col("v"))))
    cells = materialize(cells.select("lang", "source", "term", "s", "n", "p", "p0",
                                     _share(F.col("total"), F.col("all"), F.col("v")).alias("q")))

    rows = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "n", "p", "p0"))).alias("path"))
    both = pair_corrections(rows)
    both = both.unionByName(both.select("lang", F.col("r").alias("s"), F.col("s").alias("r"), "value"))
    # every distinct nonzero count against the zero of each other source
    other = bounded_broadcast(groups.select("lang", F.col("s").alias("r"), F.col("p0").alias("q0")))
    counts = cells.groupBy("lang", "s", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    single = (counts.join(other, "lang").filter(F.col("s") != F.col("r"))
                    .groupBy("lang", "s", "r")
                    .agg(F.sum((_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0"))) * F.col("terms")).alias("value")))
    single = single.unionByName(single.select("lang", F.col("r").alias("s"), F.col("s").alias("r"), "value"))
    change = both.unionByName(single).groupBy("lang", "s", "r").agg(F.sum("value").alias("change"))
    right = bounded_broadcast(groups.select("lang", F.col("s").alias("r"), F.col("source").alias("item"), F.col("p0").alias("q0")))
    pairs = (groups.join(right, "lang").filter(F.col("s") != F.col("r")).join(change, ["lang", "s", "r"], "left")
                   .select("lang", "source", F.lit("pair").alias("part"), "item",
                           F.coalesce(F.col("v") * _f(F.col("p0"), F.col("q0")) + F.coalesce("change", zero), zero).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = (cells.filter(F.col("p") > F.col("q"))
                  .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                          _f(F.col("p"), F.col("q")).alias("value"))
                  .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms))
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources and the most telling terms, per language."""
    return audit(documents(spark, sf_dir))


LOWER_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {LOWER_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY ALL),
lv AS (SELECT lang, count(*) AS v, sum(n) AS n FROM tot GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * lv.v)::HUGEINT AS p
  FROM grp g JOIN kept k USING (lang) JOIN lv USING (lang) LEFT JOIN gn USING (lang, source)
       LEFT JOIN cnt c USING (lang, source, term)),
q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 2)) // (lv.n + 2 * lv.v)::HUGEINT AS q FROM tot t JOIN lv USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
       LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL),
terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms)
WHERE rank <= {TOP_TERMS}
"""
