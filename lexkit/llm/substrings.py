"""Operator 7, substring dedup: paragraph, line and sentence hashing.

A document is cut into paragraphs (at blank lines), these into lines and these
into sentences (at ``. ! ?`` before white space); between lines and paragraphs
stand runs of lines of fewer than ``min_words`` words (verse, lists).  A unit is
normalised to its lower-cased words (above lines also to its line breaks); a
128-bit digest of them groups equal units over the whole corpus.  Of each group
the earliest occurrence, by (document, position), is kept and every other one is
removed, with its original character offsets.

The minimum of ``min_words`` words holds for the unit that repeats, at every
level.  A shorter sentence belongs to the smallest line, run or paragraph around
it that has as many words and goes with it, so a repeated line or paragraph is
removed as a whole: its long sentences as repeated sentences, what stands
between them as pieces of the unit.  Words in no repeated unit of ``min_words``
words stay: short sentences repeat by chance.

The occurrences of a digest are never gathered: the earliest one is a minimum
aggregate (combined before the shuffle), and only digests that occur more than
once are joined back, so a sentence in a third of all documents is no hot group
(the join's large partitions can be split).

Defined cases: null and empty texts have no unit; a row with a null id ranks
after all others; repeated rows count as copies, the later ones (by id, then
content) are removed; an empty table gives an empty table; texts are processed
whole; other columns are ignored whatever their names (a column ``removed`` is replaced in
``without_repeats``).  ``docs`` is a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.llm.common import documents, free_names, numbered
from lexkit.llm.flatwords import U64, Words, as_long, mix, text_slices
from lexkit.session import materialize, written

MIN_WORDS = 8
_A, _B = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
_LINE = U64(0x8EBC6AF09C88C6E3)
UNITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                   ("words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])


def _digests(w: Words, first: np.ndarray, count: np.ndarray, line: np.ndarray | None = None) -> list[np.ndarray]:
    """Two 64-bit halves of the words of every unit (and of their line breaks)."""
    place = np.arange(len(w.hash)) - np.repeat(first, count)
    halves = []
    for salt in (_A, _B):
        powers = np.cumprod(np.full(int(count.max()) + 1, salt, U64), dtype=U64)
        value = w.hash ^ salt if line is None else (w.hash ^ salt) + line * _LINE
        halves.append(mix(np.add.reduceat(mix(value) * powers[place], first) + count.astype(U64)))
    return halves


def unit_table(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(row number, first character, end character, words, digest halves) of
    every sentence of at least ``min_words`` words and of every piece: sentences
    below that side by side in one line, run of short lines or paragraph of at
    least as many words.  A piece's digest is that of the unit and its place in it."""
    w = Words(texts)
    data, m = w.data, len(w.hash)
    if not m:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    last = data[w.end - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    other = w.doc[1:] != w.doc[:-1]
    feeds, returns = (np.diff(np.concatenate([[0], np.cumsum(data == c)])[np.stack([w.end[:-1], w.start[1:]])], axis=0)[0]
                      for c in (10, 13))
    sentence, line, paragraph = np.ones((3, m), bool)
    line[1:] = other | (feeds > 0) | (returns > 0)
    paragraph[1:] = other | (feeds > 1) | (returns > 1)
    sentence[1:] = stop[:-1] | line[1:]
    long = np.diff(np.append(np.flatnonzero(line), m))[np.cumsum(line) - 1] >= min_words
    run = line & (paragraph | long | np.roll(long, 1))

    levels = []
    for cut in (sentence, line, run, paragraph):
        first = np.flatnonzero(cut)
        levels.append((first, np.diff(np.append(first, m)), np.cumsum(cut) - 1))
    first, count, _ = levels[0]
    # the smallest unit of enough words around every sentence
    level, unit = np.full(len(first), -1), np.zeros(len(first), np.int64)
    for k, (_, size, at) in enumerate(levels):
        here = (level < 0) & (size[at[first]] >= min_words)
        level[here], unit[here] = k, at[first][here]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (level[1:] != level[:-1]) | (unit[1:] != unit[:-1])
    begin = np.flatnonzero(fresh)
    words = np.add.reduceat(count, begin)
    first, level, unit = first[begin], level[begin], unit[begin]
    d1, d2 = np.zeros((2, len(first)), U64)
    for k, (start, size, _) in enumerate(levels):
        here = level == k
        if here.any():
            for d, half, salt in zip((d1, d2), _digests(w, start, size, line if k > 1 else None), (_A, _B), strict=True):
                d[here] = half[unit[here]]
                if k:
                    place = (first[here] - start[unit[here]]).astype(U64)
                    d[here] = mix(d[here] ^ mix(place * U64(4) + U64(k) ^ salt))

    keep = level >= 0
    first, words = first[keep], words[keep]
    # characters before a byte = bytes before it that do not continue a character
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = w.doc[first]
    base = chars[w.offsets[doc]]
    return (doc, chars[w.start[first]] - base, chars[w.end[first + words - 1]] - base, words,
            as_long(d1[keep]), as_long(d2[keep]))


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, start, end, words, d1, d2): every sentence and piece with its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                row, *columns = unit_table(part.column("text"), min_words)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("doc_id").take(at),
                                                  *[pa.array(c.astype(np.int64)) for c in columns]], schema=UNITS)

    row, = free_names(docs, "_row")
    src = numbered(docs, row).select(F.col(row).alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "row bigint, doc_id bigint, start bigint, end bigint, words bigint, d1 bigint, d2 bigint")


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed occurrence: doc_id, start, end, words, kept_doc_id,
    kept_start, occurrences, row (tells rows with equal ids apart)."""
    all_units, _ = written(units(docs, key, text, min_words))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("doc_id", "row").alias("h"), "row", "start")
    groups = (all_units.groupBy("d1", "d2").agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("occurrences"))
                       .filter("occurrences > 1"))
    # written, so that the join deals both sides anew and can split a hot digest
    groups = materialize(groups)
    return (all_units.withColumn("rank", rank).join(groups, ["d1", "d2"]).filter(F.col("rank") != F.col("kept"))
                     .select("doc_id", "start", "end", "words", F.col("kept.doc_id").alias("kept_doc_id"),
                             F.col("kept.start").alias("kept_start"), "occurrences", "row"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the removed occurrences; ``removed`` lists their original
    character offsets (start, end), in order (empty: nothing was removed)."""
    row, = free_names(docs, "_row")
    gone = (repeated_units(docs, key, text, min_words).groupBy(F.col("row").alias(row))
            .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, removed) -> str | None:
            if t is None or removed is None or not len(removed):
                return t
            at, kept = 0, []
            for s in removed:
                kept.append(t[at:s["start"]])
                at = s["end"]
            return "".join([*kept, t[at:]])
        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    j = numbered(docs.drop("removed"), row).join(gone, row, "left")
    j = j.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return j.withColumn(text, cut(F.col(text), F.col("removed"))).drop(row)


def op7_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed repeat of a sentence or piece of a line or paragraph, with the place it repeats."""
    return repeated_units(documents(spark, sf_dir)).drop("row")
