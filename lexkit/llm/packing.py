"""Operator 1, packing along a space-filling curve.

1. Every text is tokenised; its hashed token counts are projected to a few
   dimensions with fixed random signs and written beside the token ids.
2. The projections are centred and scaled by their corpus mean and deviation
   (one row of numbers), cut into a grid, and the cell's place on the Hilbert
   curve is the sort key.
3. Rows are range-partitioned and sorted by (Hilbert key, id, row number), so
   neighbours on the curve, documents with similar words, come together; id and
   number split a large group of equal texts or rows over many partitions.
4. Each partition packs its documents one after the other into sequences of
   2048 tokens, cutting documents at the border.  What is left at the end of a
   partition is cut into sequences whose lengths are powers of two, so no
   sequence needs padding.

Defined cases: a null or empty text is its end token alone; repeated rows are
packed each for itself; null ids are kept; an empty table gives no piece; texts
of any length are cut over as many sequences as they need; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.llm.common import documents
from lexkit.llm.flatwords import mix, text_slices
from lexkit.session import shuffle_partitions, written

#: The vocabulary of byte_bpe_50k.json in the form of the faster library: the same ids.
VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 1
#: Fixed value: the vocabulary's special token, which the named tokenizer finds in texts.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
STORED = np.dtype("<u2")        # ids between the passes; enough for 65,536 ids
SEQUENCE = 2048
PARTITION_TOKENS = 8 << 20
HASH_BUCKETS = 4096
DIMS = 4
BITS = 8
# White space of the tokenizer's split pattern, followed by a space.
SPACE_BEFORE_SPACE = ("[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0  -     　] ")
_SIGNS = np.random.default_rng(31).choice([-1.0, 1.0], (HASH_BUCKETS, DIMS))
_loaded: dict[str, object] = {}


def encoding(name: str):
    """A function from distinct strings to their lists of ids, by the library
    that the vocabulary file ``name`` is for; loaded once per process."""
    if name not in _loaded:
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[name] = lambda texts: [e.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[name] = lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    return _loaded[name]


class Encoder:
    """Token ids of whole texts.

    A byte-level BPE never joins a non-space character with the space after it,
    so a text splits before every such space without changing its ids.  Each
    distinct piece of a slice is encoded once; texts with white space before a
    space are encoded as they are.  The special token's string in a text is that
    token, and the text on both sides of it is encoded by itself."""

    def __init__(self, name: str = VOCABULARY):
        self.encode = encoding(name)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids per text)."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, SPACE_BEFORE_SPACE), pc.match_substring(texts, SPECIAL))
        whole = whole.to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(parts)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        opens = np.zeros(len(flat), bool)
        opens[first] = True
        coded = flat.filter(pa.array(~opens)).dictionary_encode()
        table = self.encode(pc.binary_join_element_wise(" ", coded.dictionary, "").to_pylist())
        lead = [e if w is None else w for e, w in zip(
            self.encode(flat.filter(pa.array(opens)).to_pylist()),
            self._whole(texts, whole), strict=True)]
        table, size = table + lead, len(table)
        code = np.empty(len(flat), np.int64)
        code[~opens] = coded.indices.to_numpy(zero_copy_only=False)
        code[opens] = size + np.arange(len(texts))
        length = np.fromiter(map(len, table), np.int64, len(table))
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        each = length[code]
        ends = np.cumsum(each)
        pool = np.fromiter(chain.from_iterable(table), np.int32, int(length.sum()))
        ids = pool[np.repeat(begin[code] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.add.reduceat(each, first) if len(first) else np.empty(0, np.int64)

    def _whole(self, texts: pa.Array, whole: np.ndarray) -> list[list[int] | None]:
        out: list[list[int] | None] = [None] * len(texts)
        for i in np.flatnonzero(whole):
            first, *others = self.encode(texts[int(i)].as_py().split(SPECIAL))
            out[i] = list(chain(first, *([SPECIAL_ID, *ids] for ids in others)))
        return out


def projections(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: hashed counts of its ids, damped by a logarithm, scaled to
    length one and projected with random signs to ``DIMS`` numbers."""
    out = np.zeros((len(counts), DIMS))
    bucket = (mix(ids.astype(np.uint64)) % np.uint64(HASH_BUCKETS)).astype(np.int64)
    at = 0
    for i, n in enumerate(counts.tolist()):
        b, c = np.unique(bucket[at:at + n], return_counts=True)
        w = np.log1p(c)
        norm = np.sqrt(w @ w)
        if norm > 0:
            out[i] = (w / norm) @ _SIGNS[b]
        at += n
    return out


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer grid cells (rows x dimensions):
    Gray-code untangling of the axes, then interleaving of their bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY,
              end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, ids as little-endian numbers of STORED type, n, p0..): ids with
    the end id, and the projection of the text; ``row`` tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = Encoder(name), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, counts = encoder.texts(part.column("text"))
                p = projections(ids, counts)
                ends = np.cumsum(counts)
                with_end = np.insert(ids, ends, end_id)
                if with_end.max(initial=0) > np.iinfo(STORED).max:
                    raise ValueError("the vocabulary has more ids than the stored type")
                with_end = with_end.astype(STORED)
                ends = (ends + np.arange(1, len(ends) + 1)) * with_end.itemsize
                blob = pa.Array.from_buffers(pa.binary(), len(part), [
                    None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(with_end)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.arange(row, row + len(part))), blob, pa.array(counts + 1),
                     *[pa.array(p[:, d]) for d in range(DIMS)]], ["doc_id", "row", "ids", "n", *[f"p{d}" for d in range(DIMS)]])
                row += len(part)

    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, row bigint, ids binary, n bigint, "
                          + ", ".join(f"p{d} double" for d in range(DIMS)))


def with_hilbert_key(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``place`` on the curve; the grid spans three deviations
    around the corpus mean in every dimension."""
    stats = tokens.agg(*[f(f"p{d}").alias(f"{f.__name__}{d}") for d in range(DIMS) for f in (F.avg, F.stddev)]).first()
    cells = []
    for d in range(DIMS):
        mean, dev = stats[f"avg{d}"] or 0.0, stats[f"stddev{d}"] or 0.0
        z = (F.col(f"p{d}") - mean) / (dev if dev > 0 else 1.0)
        cells.append(F.least(F.greatest(F.floor((z + 3) / 6 * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("int"))

    @F.pandas_udf("bigint")
    def place(*xs: pd.Series) -> pd.Series:
        return pd.Series(hilbert_key(np.stack([x.to_numpy() for x in xs], 1)))

    return tokens.withColumn("place", place(*cells))


def _sequence_lengths(left: int) -> list[int]:
    """Lengths of the last sequences: the powers of two that add up to ``left``."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit),
    ids_crc32, doc_tokens, sequence_id, offset, place (on the curve)."""
    tokens, _ = written(tokenised(docs, key, text))
    # partitions of a bounded size, whatever the setting: they grow in number with the input
    total = tokens.agg(F.sum("n")).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-total // PARTITION_TOKENS))
    ordered = (with_hilbert_key(tokens).select("doc_id", "row", "place", "n", "ids")
               .repartitionByRange(n, "place", "doc_id", "row").sortWithinPartitions("place", "doc_id", "row").drop("row")
               .withColumn("part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place"]
        rows: list[list] = [[] for _ in names]
        held: list[tuple] = []  # pieces of the open sequence: written when it is full or the partition ends
        count, fill, part = 0, 0, 0

        def flush(pieces: list[tuple], seq: int) -> None:
            offset = 0
            for doc_id, start, ids, total, place in pieces:
                values = (doc_id, start, len(ids) // 4, bytes(ids), zlib.crc32(ids), total,
                          (part << 40) + seq, offset, place)
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
                offset += len(ids) // 4

        def batch_out() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, PIECES, strict=True)],
                                             schema=PIECES)
            for column in rows:
                column.clear()
            return out

        for batch in batches:
            for doc_id, place, total, ids, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = memoryview(np.frombuffer(ids, STORED).astype("<u4").tobytes())
                start = 0
                while start < total:
                    take = min(sequence - fill, total - start)
                    held.append((doc_id, start, ids[4 * start:4 * (start + take)], total, place))
                    start, fill = start + take, fill + take
                    if fill == sequence:
                        flush(held, count)
                        held, fill, count = [], 0, count + 1
                        if len(rows[0]) > 5000:
                            yield batch_out()
        for size in _sequence_lengths(fill):
            piece: list[tuple] = []
            while size:
                doc_id, start, ids, total, place = held.pop(0)
                take = min(size, len(ids) // 4)
                piece.append((doc_id, start, ids[:4 * take], total, place))
                if 4 * take < len(ids):
                    held.insert(0, (doc_id, start + take, ids[4 * take:], total, place))
                size -= take
            flush(piece, count)
            count += 1
        yield batch_out()

    return ordered.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, "
                                   "doc_tokens bigint, sequence_id bigint, offset bigint, place bigint")


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("place", pa.int64())])


def op1_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                 "sequence_id", "offset")
