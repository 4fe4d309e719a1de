"""Operator 11, benchmark decontamination with training suffix arrays.

1. A shard is a slice of the documents, a few megabytes of text.  Its words
   (runs of letters and digits, A-Z lower-cased) are numbered exactly by a
   dictionary of the shard, each text ends with a number of its own, and the
   suffixes of the whole sequence are sorted by prefix doubling: rounds that only
   sort the groups of suffixes not told apart yet.
2. The test suffixes are those of the benchmark items that still have a whole
   window (10 words, or the whole item if it is shorter).  All of them are
   binary-searched together in every shard, word by word: a suffix whose
   interval runs empty drops out, one that keeps an interval for its whole window
   occurs at every place of that interval.
3. Places whose test suffixes follow one another in an item belong to one match:
   runs along a diagonal are the longest verbatim matches (``longest_matches``).
   Places alone give the hit words and the items of a document (``hits``).
4. ``decontaminated`` removes the documents with a hit.

Documents are not shuffled: a shard is built and searched in the task that reads
it.  The benchmark is cut into blocks of at most ``BLOCK_WORDS`` words on
average, dealt by a hash of id and text; one block is sent to the tasks at a
time.  With more than one block the shards are written once with their suffix
arrays, searched once per block, and a document's parts are put together.
Items are compared as sets of distinct windows, so a window that a third of all
items or documents hold is searched once a shard; a document's item list is
made once per distinct set of windows.

Defined cases: null, empty and word-less texts have no words and no hit;
word-less items have no window; rows of the benchmark with one id are one item;
an item without an id is listed as the empty string; repeated documents are
reported each for itself, null ids are kept; empty tables give no row or no
hit; texts and items are read whole; other columns are ignored whatever
their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.llm.common import documents
from lexkit.llm.exactwords import byte_class, word_array
from lexkit.llm.flatwords import text_slices
from lexkit.session import written

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Letters, digits and every non-ASCII character.
INSIDE = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_STORED = "shard bigint, doc_ids array<bigint>, first binary, vocabulary array<string>, codes binary, order binary"


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in sorted order.  The last number must occur
    once only, so suffixes that are alike so far never run off the end."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.ones(n, bool)
    head[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        who = order[at]
        key = rank[who] * n + rank[who + step]
        by = np.argsort(key)
        who, key = who[by], key[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        order[at], head[at] = who, fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2


class Shard:
    """Words of a slice of texts and their suffix array.  ``codes`` holds every
    text's words and its end; ``first`` the texts' borders in it."""

    def __init__(self, vocabulary: pa.Array, first: np.ndarray, codes: np.ndarray, order: np.ndarray):
        self.vocabulary, self.first, self.codes, self.order = vocabulary, first, codes, order

    @classmethod
    def of(cls, texts: pa.Array) -> Shard:
        words, first = word_array(texts, INSIDE)
        coded = words.dictionary_encode()
        ends = len(coded.dictionary) + np.arange(len(texts))
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first[1:], ends)
        return cls(coded.dictionary, first + np.arange(len(first)), codes, suffix_order(codes))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first) - 1

    def _bound(self, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, depth: int, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            word = self.codes[self.order[mid] + depth]
            right = word <= target[open_] if after else word < target[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    def search(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``targets``, first and last + 1 place in ``order``) of every
        row, a sequence of the shard's numbers, that occurs."""
        who = np.flatnonzero((targets >= 0).all(1))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), len(self.order), np.int64)
        for depth in range(targets.shape[1]):
            word = targets[who, depth]
            lo, hi = self._bound(lo, hi, word, depth, False), self._bound(lo, hi, word, depth, True)
            found = lo < hi
            who, lo, hi = who[found], lo[found], hi[found]
        return who, lo, hi


class Block:
    """Distinct windows of some benchmark items.  ``windows[k]`` are those of
    ``lengths[k]`` words, in numbers of ``vocabulary``; windows are numbered through.
    ``owner[first[w]:first[w + 1]]`` are the (item, place in it) of window w."""

    def __init__(self, names: list[str], texts: list[str], window: int = WINDOW):
        words, first = word_array(pa.array(texts, pa.string()), INSIDE)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary, self.names = coded.dictionary, names
        count = np.diff(first)
        self.lengths, self.windows, owners, seen = [], [], [], 0
        for n in np.unique(np.minimum(count[count > 0], window)).tolist():
            item = np.flatnonzero(count == n if n < window else count >= window)
            many = count[item] - n + 1
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item = np.repeat(item, many)
            rows = codes[(first[item] + place)[:, None] + np.arange(n)]
            distinct, at = np.unique(rows, axis=0, return_inverse=True)
            self.lengths.append(n)
            self.windows.append(distinct)
            owners.append(np.stack([at.ravel() + seen, item, place], 1))
            seen += len(distinct)
        owner = np.concatenate(owners) if owners else np.empty((0, 3), np.int64)
        owner = owner[np.argsort(owner[:, 0], kind="stable")]
        self.first, self.owner = np.searchsorted(owner[:, 0], np.arange(seen + 1)), owner[:, 1:]
        self.length = np.repeat(np.array(self.lengths, np.int64), [len(w) for w in self.windows])
        self._lists: dict[bytes, list[str]] = {}

    def places(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the shard) of every occurrence of a window."""
        known = pc.fill_null(pc.index_in(self.vocabulary, value_set=shard.vocabulary), -1).to_numpy(zero_copy_only=False)
        window, place, seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for rows in self.windows:
            who, lo, hi = shard.search(known[rows].astype(np.int64))
            many = hi - lo
            window.append(np.repeat(who + seen, many))
            place.append(shard.order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())])
            seen += len(rows)
        return np.concatenate(window), np.concatenate(place)

    def items(self, windows: np.ndarray) -> list[str]:
        """Sorted names of the items that hold one of the distinct ``windows``."""
        key = windows.tobytes()
        if key not in self._lists:
            if len(self._lists) > 10_000:
                self._lists.clear()
            owners = np.concatenate([self.owner[self.first[w]:self.first[w + 1], 0] for w in windows])
            self._lists[key] = sorted({self.names[i] for i in np.unique(owners)})
        return self._lists[key]


def hit_rows(shard: Shard, block: Block) -> dict[int, tuple[list[dict], list[str]]]:
    """Per text with a hit: its hit spans of words (start, end) and its items."""
    window, place = block.places(shard)
    change = np.zeros(len(shard.codes) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + block.length[window], -1)
    hit = np.cumsum(change) > 0
    turn = np.flatnonzero(np.diff(hit, prepend=False))
    begin, end = turn[::2], turn[1::2]
    # a text's end is never hit, so no span crosses it
    doc_of = lambda p: np.searchsorted(shard.first, p, side="right") - 1
    spans: dict[int, list[dict]] = {}
    for d, a, b in zip(doc_of(begin).tolist(), begin.tolist(), end.tolist(), strict=True):
        base = int(shard.first[d])
        spans.setdefault(d, []).append({"start": a - base, "end": b - base})
    pair = np.unique(doc_of(place) * max(len(block.length), 1) + window)
    doc, w = np.divmod(pair, max(len(block.length), 1))
    cut = np.flatnonzero(np.diff(doc, prepend=-1))
    return {int(doc[a]): (spans[int(doc[a])], block.items(w[a:b])) for a, b in itertools.pairwise([*cut, len(doc)])}


def match_rows(shard: Shard, block: Block) -> list[tuple[int, int, str, int, int]]:
    """(text, start, item, start in the item, words) of every longest match:
    it can be grown by no word on either side, and holds a window."""
    window, place = block.places(shard)
    many = np.diff(block.first)[window]
    at = np.repeat(block.first[window] - np.cumsum(many) + many, many) + np.arange(many.sum())
    item, j = block.owner[at].T if len(at) else np.empty((2, 0), np.int64)
    place, length = np.repeat(place, many), np.repeat(block.length[window], many)
    by = np.lexsort((place, place - j, item))
    item, j, place, length = item[by], j[by], place[by], length[by]
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(place - j) != 0) | (np.diff(place) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head, len(item))[1:] - 1
    doc = np.searchsorted(shard.first, place[head], side="right") - 1
    return [(d, p, block.names[i], a, n) for d, p, i, a, n in zip(
        doc.tolist(), (place[head] - shard.first[doc]).tolist(), item[head].tolist(), j[head].tolist(),
        (place[tail] - place[head] + length[head]).tolist(), strict=True)]


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[Block]:
    """The benchmark, block by block."""
    src = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text")) \
               .filter(F.length("text") > 0).distinct()
    # a word and its separator take two bytes at least
    size = src.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    for b in range(blocks):
        part = src.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else src
        rows = part.collect()                       # about block_words words at most
        yield Block([r["name"] for r in rows], [r["text"] for r in rows])


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    for part in text_slices(batch, "text"):
        yield part, Shard.of(part.column("text"))


def _hits_table(ids: pa.Array, texts: Shard, block: Block, **more: pa.Array) -> pa.RecordBatch:
    found = hit_rows(texts, block)
    none: tuple[list, list] = ([], [])
    rows = [found.get(i, none) for i in range(len(ids))]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = {**more, "doc_id": ids, "n_words": pa.array(texts.n_words.astype(np.int64)),
               "spans": pa.array([r[0] for r in rows], span), "items": pa.array([r[1] for r in rows], pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_HITS = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def stored_shards(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The training suffix arrays, written: one row per shard, with the numbered
    words (``codes``), the sorted suffixes (``order``), the texts' borders and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in _shards(batch):
                yield pa.RecordBatch.from_pylist([{
                    "doc_ids": part.column("doc_id").to_pylist(), "first": s.first.astype(np.int64).tobytes(),
                    "vocabulary": s.vocabulary.to_pylist(), "codes": s.codes.astype(np.int32).tobytes(),
                    "order": s.order.astype(np.int32).tobytes()}], schema=stored)

    stored = pa.schema([("doc_ids", pa.list_(pa.int64())), ("first", pa.binary()), ("vocabulary", pa.list_(pa.string())),
                        ("codes", pa.binary()), ("order", pa.binary())])
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = src.mapInArrow(run, _STORED.split(", ", 1)[1]).withColumn("shard", F.monotonically_increasing_id())
    return written(table)[0]


def search_shards(shards: DataFrame, block: Block) -> DataFrame:
    """(shard, place, hits) of every document of written shards against one block."""
    sent = shards.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                read = lambda c, kind: np.frombuffer(row[c].as_py(), kind).astype(np.int64)  # noqa: B023, E731
                shard = Shard(row["vocabulary"].values, read("first", np.int64), read("codes", np.int32), read("order", np.int32))
                ids = row["doc_ids"].values
                yield _hits_table(ids, shard, sent.value, shard=pa.array(np.full(len(ids), row["shard"].as_py())),
                                  place=pa.array(np.arange(len(ids))))

    return shards.mapInArrow(run, "shard bigint, place bigint, " + _HITS)


def _merged(spans: Column) -> Column:
    """Sorted spans joined where they touch or overlap."""
    empty = F.expr("struct(cast(array() as array<struct<start:bigint,end:bigint>>) as done, bigint(-1) as a, bigint(-1) as b)")

    def add(acc: Column, s: Column) -> Column:
        grown = F.struct(acc["done"].alias("done"), acc["a"].alias("a"), F.greatest(acc["b"], s["end"]).alias("b"))
        fresh = F.struct(F.when(acc["a"] < 0, acc["done"]).otherwise(
            F.array_append(acc["done"], F.struct(acc["a"].alias("start"), acc["b"].alias("end")))).alias("done"),
            s["start"].alias("a"), s["end"].alias("b"))
        return F.when(s["start"] <= acc["b"], grown).otherwise(fresh)

    close = lambda acc: F.when(acc["a"] < 0, acc["done"]).otherwise(
        F.array_append(acc["done"], F.struct(acc["a"].alias("start"), acc["b"].alias("end"))))
    return F.aggregate(F.array_sort(spans), empty, add, close)


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start and end of every run of
    hit words), items (sorted names of the items with an occurring window)."""
    blocks = _blocks(items, item_key, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, shard in _shards(batch):
                    yield _hits_table(part.column("doc_id"), shard, sent.value)

        return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _HITS)
    shards = stored_shards(docs, key, text)
    parts = None
    for block in (b for group in ((first, second), blocks) for b in group):
        part = written(search_shards(shards, block))[0]
        parts = part if parts is None else parts.unionByName(part)
    return (parts.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        .select("doc_id", "n_words", _merged(F.col("spans")).alias("spans"),
                F.array_sort(F.array_distinct("items")).alias("items")))


def longest_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                    item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per longest verbatim match of at least a window: doc_id, start
    (word), item_id, item_start, n_words.  One pass over the documents per block."""
    out = None
    for block in _blocks(items, item_key, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = ("doc_id", "start", "item_id", "item_start", "n_words")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            for batch in batches:
                for part, shard in _shards(batch):
                    rows = match_rows(shard, sent.value)
                    ids = part.column("doc_id").to_pylist()
                    columns = zip(*((ids[d], *more) for d, *more in rows), strict=True) if rows else ([],) * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        part = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            run, "doc_id bigint, start bigint, item_id string, item_start bigint, n_words bigint")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, all columns, without the documents that hold a window; each
    block of the benchmark filters what the blocks before it left."""
    for block in _blocks(items, item_key, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, text):
                    gone = hit_rows(Shard.of(part.column(text)), sent.value)
                    keep = np.ones(part.num_rows, bool)
                    keep[list(gone)] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op11_suffix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and benchmark items."""
    found = hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


LOWER_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {LOWER_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), {LOWER_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0))),
gram AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM gram JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
