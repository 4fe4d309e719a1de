"""Operator 10, n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles; two sets link when their
Jaccard similarity is at least 0.75.  The result is exact: every link between
different sets is found, at least through the component it makes.

1. Rarity.  Documents are read in chunks; a chunk sends its distinct shingles,
   one sorted block per hash range, and gets back how often each occurs in the
   corpus.  The blocks hold as many bits of a hash as the corpus needs, so a
   chance meeting of two shingles (which only makes one look commoner) is rare.
2. Prefixes.  Shingles are ordered by rarity.  Sets that link share one of
   their first n - ceil(0.75 n) + 1 shingles, so a set with that many shingles
   of its own links with nothing and leaves the join here.  Equal sets are one
   set from now on.
3. Index lists.  For each remaining prefix shingle, the sets that hold it, with
   length and position.
4. Computed answers.  In each list the set with the fewest shingles of its own
   leads: among near copies that is the text the others were made from.  A set
   is verified against the two leaders it shares most lists with.  Links give
   first components, so a group of thousands of near copies is joined by a star
   and not by all its pairs.
5. Derived answers.  Only lists over several components go on.  They are sorted
   by length and scanned in blocks; lengths out of reach skip blocks,
   positions that leave too little room skip pairs, and for two sets with the
   same leader its two known similarities decide: similarities to the leader
   that differ by more than 0.25 exclude a link (Jaccard distance is a metric).
   Pairs left over are verified.

Defined cases: null and empty texts have an empty set (0 shingles, linked with
nothing); texts of fewer words have one shingle, the whole sequence; repeated
rows are equal sets; a null id never names a component (a component of null
ids alone has null); an empty table gives an empty table; very long texts are
one set like others; other columns are ignored.  ``docs`` is a stored table
(its rows are numbered by their place, the same in every pass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.llm.blocks import pack_sorted, unpack_sorted
from lexkit.llm.common import checked_broadcast, components, documents, free_names, numbered
from lexkit.llm.flatwords import U64, as_long, mix, shingle_sets
from lexkit.session import materialize, shuffle_partitions, written

WORDS = 5
NUM, DEN = 3, 4             # similarity of at least NUM / DEN
CHUNK_ROWS = 1000
RANGE_KEYS = 1 << 19
SPARE_BITS = 7              # hash bits beyond those that number all shingles
LEADERS = 2
LIST_ROWS = 8192            # longest list scanned in one piece
SALT = U64(0x2545F4914F6CDD1D)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


class ChunkSets:
    """Shingle sets of a chunk and its distinct shortened hashes."""

    def __init__(self, texts: pa.Array, bits: int):
        self.sets = shingle_sets(texts, WORDS)
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.flat = np.concatenate(self.sets) if self.sets else np.empty(0, U64)
        self.keys, self.at, self.count = np.unique(self.flat >> U64(64 - bits), return_inverse=True, return_counts=True)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for salt in (U64(0), SALT):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.flat ^ salt), dtype=U64)])
            ends = np.cumsum(self.n)
            out.append(as_long(mix(total[ends] - total[ends - self.n] + self.n.astype(U64))))
        return out[0], out[1]


def shingle_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row, n, s1, s2 (digest of the set); for sets
    that may link also u (shingles of its own), prefix (shared shingles in order
    of rarity) and shingles (sorted 64-bit hashes)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = shuffle_partitions(spark)
    bits = int(min(63, max(32, np.ceil(np.log2(max(size / 4, 2))) + SPARE_BITS)))
    range_bits = max(int(np.ceil(np.log2(max(size / 6 / RANGE_KEYS, partitions, 2)))), 1)
    ranges, shift = 1 << range_bits, U64(bits - range_bits)
    row, = free_names(docs, "_row")
    src = numbered(docs, row).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(row).alias("row"))
    src = src.withColumn("chunk", F.shiftright("row", 33) * (1 << 24)
                         + F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / CHUNK_ROWS)).withColumn(
        "chunk", F.col("chunk").cast("bigint"))

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
        held: list[pa.Array] = []
        now = None
        for b in batches:
            number = b.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(number)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(number)], strict=True):
                if z > a:
                    if held and number[a] != now:
                        yield now, pa.concat_arrays(held)
                        held = []
                    now = int(number[a])
                    held.append(b.column("text").slice(a, z - a))
        if held:
            yield now, pa.concat_arrays(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in chunks_of(batches):
            c = ChunkSets(texts, bits)
            border = np.searchsorted(c.keys >> shift, np.arange(ranges + 1, dtype=np.uint64))
            count = np.minimum(c.count, 255).astype(np.uint8)
            rows = [(r, chunk, pack_sorted(c.keys[a:b]), count[a:b].tobytes())
                    for r, (a, b) in enumerate(zip(border[:-1], border[1:], strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()),
                                                    strict=True)], ["g", "chunk", "keys", "n"])

    def answer(t: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in t.column("keys")]
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("n")])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, n, len(distinct))
        code = np.where(total > 1, np.minimum(8 * np.log2(total), 254), 0).astype(np.uint8)[at]
        parts = np.split(code, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"g": t.column("g"), "chunk": t.column("chunk"), "code": pa.array([p.tobytes() for p in parts], pa.binary())})

    names = ["doc_id", "row", "n", "s1", "s2", "u", "prefix", "shingles"]

    def prefixes(t: pa.Table, a: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        c = ChunkSets(t.column("text").combine_chunks(), bits)
        a = a.sort_by("g")
        code = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8)[c.at]
        s1, s2 = c.digests()
        end = np.cumsum(c.n)
        own = np.concatenate([[0], np.cumsum(code == 0)])
        u = own[end] - own[end - c.n]
        prefix: list = [None] * len(t)
        shingles: list = [None] * len(t)
        for i in np.flatnonzero((c.n > 0) & (u < c.n - -(-NUM * c.n // DEN) + 1)):
            s, k = c.sets[i], code[end[i] - c.n[i]:end[i]]
            shared = np.flatnonzero(k)
            order = shared[np.argsort(k[shared], kind="stable")][:prefix_length(len(s)) - u[i]]
            prefix[i], shingles[i] = as_long(s[order]), s.tobytes()
        return pa.table([t.column("doc_id"), t.column("row"), pa.array(c.n), pa.array(s1), pa.array(s2), pa.array(u),
                         pa.array(prefix, pa.list_(pa.int64())), pa.array(shingles, pa.binary())], names=names)

    asked = src.select("chunk", "text").mapInArrow(ask, "g int, chunk bigint, keys binary, n binary")
    answers = asked.groupBy("g").applyInArrow(answer, "g int, chunk bigint, code binary")
    return (src.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        prefixes, "doc_id bigint, row bigint, n bigint, s1 bigint, s2 bigint, u bigint, prefix array<bigint>, shingles binary"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, common) with the exact number of common shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True))
                      for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")],
                                              pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])

    def side(x: str) -> DataFrame:
        return sets.select(F.col("row").alias(x), F.col("n").alias("n" + x), F.col("shingles").alias("s" + x))

    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
                 .mapInArrow(count, "a bigint, b bigint, na bigint, nb bigint, common bigint"))


LINKED = f"{DEN} * common >= {NUM} * (na + nb - common)"


def _list_pairs(t: pa.Table) -> pa.Table:
    """Pairs of index lists that length, position and known similarities allow."""
    cols = {c: t.column(c).to_numpy() for c in ("token", "row", "n", "pos", "component", "leader", "known", "block")}
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    order = np.lexsort((cols["row"], cols["n"], cols["token"]))
    cols = {c: x[order] for c, x in cols.items()}
    token = cols["token"]
    border = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, int)
    out: list[np.ndarray] = []
    for lo, hi in zip(border[:-1], border[1:], strict=True):
        n, pos, comp, leader, known, block, row = (cols[c][lo:hi] for c in ("n", "pos", "component", "leader", "known", "block", "row"))
        reach = np.searchsorted(n, n * DEN // NUM, side="right")      # lists are skipped past this length
        for a in range(0, hi - lo, 256):
            x = slice(a, min(a + 256, hi - lo))
            y = slice(a, int(reach[x].max()))
            gone = np.arange(y.start, y.stop)[None] <= np.arange(x.start, x.stop)[:, None]
            ok = ~gone & (comp[x, None] != comp[None, y]) & (np.arange(y.start, y.stop)[None] < reach[x, None])
            if i != j:
                ok &= block[x, None] != block[None, y]
            need = -(-NUM * (n[x, None] + n[None, y]) // (NUM + DEN))
            ok &= np.minimum((n - pos)[x, None], (n - pos)[None, y]) >= need
            same = (leader[x, None] == leader[None, y]) & (leader[x, None] >= 0)
            ok &= ~(same & (np.abs(known[x, None] - known[None, y]) > 1 - NUM / DEN + 1e-9))
            p, q = np.nonzero(ok)
            out.append(np.stack([row[x][p], row[y][q]], 1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    pairs = np.unique(np.sort(pairs, 1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def set_links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between set numbers whose components are those of all links.

    ``sets``: row, n, u, prefix, shingles, one row per distinct set."""
    spark = sets.sparkSession
    lists = materialize(sets.select("row", "n", "u", F.posexplode("prefix").alias("k", "token"))
                            .select("token", "row", "n", "u", (F.col("u") + F.col("k")).alias("pos")))
    near = F.least("n", "ln") * DEN >= F.greatest("n", "ln") * NUM
    lead = (lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("u", "n", "row")).alias("first"))
                 .filter("m > 1").select("token", F.col("first.row").alias("leader"), F.col("first.n").alias("ln")))
    best = Window.partitionBy("row").orderBy(F.col("shared").desc(), "leader")
    star = (lists.join(materialize(lead), "token").filter(near & (F.col("row") != F.col("leader")))
                 .groupBy("row", "leader").agg(F.count(F.lit(1)).alias("shared"))
                 .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADERS)
                 .select(F.col("leader").alias("a"), F.col("row").alias("b")))
    known = materialize(overlaps(star, sets))
    first = components(known.filter(LINKED).select("a", "b"))
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    answer = (known.groupBy(F.col("b").alias("row")).agg(F.max(F.struct(similarity.alias("known"), F.col("a").alias("leader"))).alias("x"))
                   .select("row", "x.known", "x.leader"))
    placed = (lists.join(first.withColumnRenamed("id", "row"), "row", "left").join(answer, "row", "left")
                   .withColumn("component", F.coalesce("component", "row")).fillna(-1, ["leader"]).fillna(0.0, ["known"]))
    placed = materialize(placed)
    mixed = materialize(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                    F.count(F.lit(1)).alias("m")).filter("lo <> hi")
                        .select("token", F.ceil(F.col("m") / LIST_ROWS).cast("int").alias("blocks")))
    open_ = placed.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    short = open_.filter("blocks = 1").withColumn("key", F.pmod(F.xxhash64("token"), F.lit(4 * shuffle_partitions(spark)))) \
                 .withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    long = open_.filter("blocks > 1").withColumn("key", F.col("token")) \
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
                .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    pairs = (short.unionByName(long).withColumn("long", F.col("blocks") > 1)
             .groupBy("long", "key", "i", "j").applyInArrow(_list_pairs, "a bigint, b bigint").distinct())
    seen = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = overlaps(pairs.join(seen, ["a", "b"], "left_anti"), sets)
    return known.filter(LINKED).select("a", "b").unionByName(more.filter(LINKED).select("a", "b"))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id, kept (the
    first document of its component)."""
    table, _ = written(shingle_table(docs, key, text))
    # equal sets are one: its first row stands for it
    same = materialize(table.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("first")))
    sets = table.filter("prefix IS NOT NULL").join(same.select(F.col("first").alias("row")), "row", "left_semi")
    sets = materialize(sets.select("row", "n", "u", "prefix", "shingles"))
    linked = components(set_links(sets)).withColumnRenamed("id", "first")
    member = (table.select("doc_id", "row", "n", "s1", "s2").join(same, ["s1", "s2", "n"], "left")
                   .join(linked, "first", "left")
                   .select("doc_id", "row", "n", F.coalesce("component", "first", "row").alias("group")))
    member = materialize(member)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    name = materialize(member.groupBy("group").agg(first.alias("first")))
    return member.join(name, "group").select("doc_id", "row", F.col("n").alias("n_shingles"),
                                             F.col("first.doc_id").alias("component_id"),
                                             (F.col("first.row") == F.col("row")).alias("kept"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but the first document, by id, of every component."""
    row, = free_names(docs, "_row")
    dropped = materialize(ngram_components(docs, key, text).filter(~F.col("kept")).select(F.col("row").alias(row)))
    return numbered(docs, row).join(checked_broadcast(dropped), row, "left_anti").select(*docs.columns)


def op10_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set components of all documents at Jaccard 0.75."""
    return ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
