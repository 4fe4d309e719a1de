"""Operator 13, cross-tokenizer alignment at whitespace-token anchors.

Every text is tokenised whole by two tokenizers, A byte-level and B with marked
spaces, both over the bytes of space + text.

1. Tokenisation.  Neither tokenizer joins a character that is no white space
   with the space after it (B: checked on its vocabulary), so texts split there
   without changing an id; each distinct piece of a slice is encoded once.  The
   tokens' bytes are compared with the text; a text that differs has no tokens.
2. Anchors are byte offsets where tokens of both end (verified on the running
   offsets of both) and the next tokens start with a space, and the end of the
   text.  They split a text into windows, tuples of A ids and B ids.
3. Equal tuples have equal alignments.  Windows are numbered by an exact
   dictionary of their id tuples; a distinct window of a slice is aligned once: cut
   at shared ends into groups, overlapping pairs as links.  All distinct windows
   are aligned together: between two neighbouring ends of either side lies exactly
   one pair of overlapping tokens.
4. Links are counted over the corpus: every slice of the documents hands on its
   distinct id pairs with their counts, Spark adds them up (combined before the
   shuffle) and marks the pairs with the highest count of their B id.
5. A slice's pairs are joined back with the corpus counts and meet the stored
   windows of the slice's documents, grouped by slice: no row per token or link
   is shuffled, and a slice is bounded.  The table of counts is broadcast only
   if it is small; a pair that occurs in every slice is a hot key that the join
   of written tables can split.

Defined cases: null and empty texts, and texts whose tokens do not give back
their bytes, have zeros and an empty digest; repeated rows count each for itself;
null ids are kept; an empty table gives no row; texts are read whole, also long
ones; strings of special tokens are plain text; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.llm.blocks import numbers, planes
from lexkit.llm.common import documents
from lexkit.llm.flatwords import buffer_of, text_slices
from lexkit.llm.packing import encoding
from lexkit.operators.joins import bounded_broadcast
from lexkit.session import written

#: The byte-level vocabulary in the form of the faster library (the same ids).
BYTE_LEVEL = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
SLICE = 4 << 20            # bytes of text aligned together
SPACE_MARK = "▁"
ROWS = pa.schema([("slice", pa.string()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("data", pa.binary()),
                  ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_ROWS = ("slice string, kind string, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
         "groups_sha256 string, data binary, pair int, a int, b int, n bigint")
_loaded: dict[tuple[str, str], Pair] = {}


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from ``begin[i]`` on, ``length[i]`` of them, for every i."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Strings:
    """Byte strings by number, to be strung together."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.begin[which], self.size[which])]


class Pair:
    """Both tokenizers: functions from strings that start with a space to ids,
    and the bytes of every id."""

    def __init__(self, byte_level: str, pieces: str):
        import public_tokenizers
        import sentencepiece

        b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        with open(public_tokenizers.path(byte_level), "rb") as f:
            entries = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        self.encode_a = encoding(byte_level)
        self.bytes_a = Strings([entries.get(i, b"") for i in range(max(entries) + 1)])
        names = [b.id_to_piece(i) for i in range(b.vocab_size())]
        self.bytes_b = Strings([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                                for i, p in enumerate(names)])
        # a piece that goes on after a word into the next space would cross a cut
        self.cut = not any(x != SPACE_MARK and y == SPACE_MARK for p in names for x, y in zip(p, p[1:], strict=False))
        # the tokenizer adds the first space itself, but not to an empty string
        space = [b.piece_to_id(SPACE_MARK)]
        self.encode_b = lambda texts: [x or space for x in b.encode([t[1:] for t in texts], num_threads=1)]
        # decimal numbers with what follows them: nothing , | ;
        self.decimals = Strings([b"%d%s" % (i, c) for c in (b"", b",", b"|", b";") for i in range(self.most)])

    @property
    def most(self) -> int:
        return max(len(self.bytes_a.size), len(self.bytes_b.size))


def tokenizers(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Pair:
    """The two tokenizers, loaded once per process."""
    if (byte_level, pieces) not in _loaded:
        _loaded[byte_level, pieces] = Pair(byte_level, pieces)
    return _loaded[byte_level, pieces]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text may be cut: at its start, and at a space after a character
    that is certainly no white space."""
    before = data[:-1]
    solid = (before > 32) & (before < 127)
    # after a longer character, unless its first byte is one white space begins with
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        back = np.zeros(len(data), np.int64)
        back[first] = first
        lead = data[np.maximum.accumulate(back)[:-1]]
        solid |= (before >= 0x80) & ~np.isin(lead, [0xC2, 0xE1, 0xE2, 0xE3])
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = solid & (data[1:] == 32)
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:-1])


@dataclass
class Tokens:
    """Tokens of the texts of a slice whose bytes both tokenizers give back: flat
    ids, each text's first token, the texts' bytes and each text's first byte."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    data: np.ndarray
    first_byte: np.ndarray


def _before(values: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values from ``first[i]`` to ``first[i + 1]``."""
    total = _before(values)
    return total[first[1:]] - total[first[:-1]]


def _encoded(ids: list[list[int]], strings: Strings, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, ids per piece, which pieces come back): the pieces' bytes are
    ``data``, ``size`` of them each."""
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))
    good = _sums(strings.size[flat], _before(length)) == size
    # pieces of another length are left out of the comparison of bytes
    back = strings.joined(flat[np.repeat(good, length)])
    differs = _sums(back != data[np.repeat(good, size)], _before(size[good]))
    good[good] = differs == 0
    return flat, length, good


def tokenise(pair: Pair, texts: pa.Array) -> tuple[np.ndarray, Tokens]:
    """(numbers of the texts with tokens, their tokens)."""
    texts = pc.fill_null(texts, "")
    kept = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    spaced = pc.binary_join_element_wise("", texts.take(pa.array(kept)), " ")
    data, offsets = buffer_of(spaced)
    starts = piece_starts(data, offsets) if pair.cut and len(data) else offsets[:-1]
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
    coded = pieces.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    raw, borders = buffer_of(coded.dictionary)
    sides = [(strings, *_encoded(encode(distinct), strings, raw, np.diff(borders)))
             for strings, encode in ((pair.bytes_a, pair.encode_a), (pair.bytes_b, pair.encode_b))]
    good = sides[0][3] & sides[1][3]
    border = np.searchsorted(starts, offsets)
    ok = np.ones(len(kept), bool)
    for d in np.unique(np.searchsorted(border, np.flatnonzero(~good[code]), side="right") - 1):
        part = code[border[d]:border[d + 1]]
        ok[d] = all(np.array_equal(strings.joined(flat[_ranges((np.cumsum(length) - length)[part], length[part])]),
                                   data[offsets[d]:offsets[d + 1]]) for strings, flat, length, _ in sides)
    code, first = code[np.repeat(ok, np.diff(border))], _before(np.diff(border)[ok])
    (_, a, length_a, _), (_, b, length_b, _) = sides
    ids = [flat[_ranges((np.cumsum(length) - length)[code], length[code])] for flat, length in ((a, length_a), (b, length_b))]
    return kept[ok], Tokens(*ids, _before(length_a[code])[first], _before(length_b[code])[first],
                            data[np.repeat(ok, np.diff(offsets))], _before(np.diff(offsets)[ok]))


@dataclass
class Aligned:
    """Alignments of distinct windows: the window's groups as text, how many, and
    its links, 64-bit numbers of A id and B id, ``first[i]:first[i + 1]``."""

    texts: list[str]
    groups: np.ndarray
    links: np.ndarray
    first: np.ndarray


def align(pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
    """Align windows of ``n_a[i]`` and ``n_b[i]`` ids each, whose two sides cover the same bytes."""
    end_a, end_b = np.cumsum(pair.bytes_a.size[a]), np.cumsum(pair.bytes_b.size[b])
    total = int(end_a[-1]) if len(end_a) else 0
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_a[end_a], is_b[end_b] = True, True
    end = np.flatnonzero(is_a | is_b)
    is_a, is_b = is_a[end], is_b[end]
    links = a[np.cumsum(is_a) - is_a].astype(np.int64) << 32 | b[np.cumsum(is_b) - is_b]
    both = is_a & is_b
    group = np.cumsum(both) - both
    groups = int(both.sum())
    group_a, group_b = group[is_a], group[is_b]
    many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)          # tokens up to each window's end
    # decimals in the order of the text: a group's A ids, then its B ids
    after_a, after_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    after_a[np.cumsum(many_a) - 1] = 2
    after_b[np.cumsum(many_b) - 1] = 3
    after_b[last_b - 1] = 0
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = a + after_a * pair.most
    order[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = b + after_b * pair.most
    chars = pair.decimals.joined(order)
    borders = _before(pair.decimals.size[order])[np.concatenate([[0], last_a + last_b])]
    texts = pa.StringArray.from_buffers(len(n_a), pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(chars))
    to = np.concatenate([[0], np.searchsorted(end, end_a[last_a - 1], side="right")]) if len(n_a) else np.zeros(1, np.int64)
    return Aligned(texts.to_pylist(), _sums(both, to), links, to)


def windows(t: Tokens, pair: Pair) -> tuple[np.ndarray, np.ndarray, Aligned]:
    """(first window of each text, number of the tuple of each window, alignments
    of the tuples): a tuple is the number of A ids, the A ids, the B ids."""
    end_a, end_b = np.cumsum(pair.bytes_a.size[t.a]), np.cumsum(pair.bytes_b.size[t.b])
    here = np.zeros(len(t.data) + 1, bool)
    here[end_a] = True
    shared = end_b[here[end_b]]
    following = np.append(t.data, np.uint8(32))[shared] == 32          # the next text starts with a space as well
    anchor = shared[following]
    to_a, to_b = np.searchsorted(end_a, anchor) + 1, np.searchsorted(end_b, anchor) + 1
    from_a, from_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (to_a, to_b))
    n_a, n_b = to_a - from_a, to_b - from_b
    size = n_a + n_b + 1
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int32)
    flat[begin] = n_a
    flat[np.repeat(begin + 1 - from_a, n_a) + np.arange(len(t.a))] = t.a
    flat[np.repeat(begin + 1 + n_a - from_b, n_b) + np.arange(len(t.b))] = t.b
    tuples = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(begin, len(flat)).astype(np.int64) * 4),
                                                                  pa.py_buffer(flat)])
    coded = tuples.dictionary_encode()
    size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) // 4
    raw = coded.dictionary.buffers()[2]
    flat, begin = np.frombuffer(raw, np.int32) if raw is not None else np.empty(0, np.int32), np.cumsum(size) - size
    n_a = flat[begin].astype(np.int64)
    n_b = size - n_a - 1
    aligned = align(pair, flat[_ranges(begin + 1, n_a)], flat[_ranges(begin + 1 + n_a, n_b)], n_a, n_b)
    return (np.searchsorted(anchor, t.first_byte, side="right"), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), aligned)


def slice_rows(name: str, ids: pa.Array, texts: pa.Array, pair: Pair) -> Iterator[pa.RecordBatch]:
    """Rows of one slice, by kind: ``doc`` per document (``data``: its windows,
    numbered inside the slice), one ``window`` row (links of every distinct
    window), ``pair`` per distinct id pair with its count in the slice."""
    kept, t = tokenise(pair, texts)
    first, code, found = windows(t, pair)
    links, strings = np.diff(found.first), found.texts
    pairs, at = np.unique(found.links, return_inverse=True)
    times = np.bincount(code, minlength=len(links))
    n = np.bincount(at, np.repeat(times, links), len(pairs)).astype(np.int64)

    rows = len(texts)
    zero = lambda: np.zeros(rows, np.int64)
    n_a, n_b, n_groups, n_links = zero(), zero(), zero(), zero()
    n_a[kept], n_b[kept] = np.diff(t.first_a), np.diff(t.first_b)
    n_groups[kept], n_links[kept] = _sums(found.groups[code], first), _sums(links[code], first)
    digest, data = [""] * rows, [b""] * rows
    for d, a, b in zip(kept.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        of = code[a:b]
        digest[d] = hashlib.sha256(";".join([strings[w] for w in of.tolist()]).encode()).hexdigest()
        data[d] = planes(of.astype(np.int32))

    def batch(count: int, **columns) -> pa.RecordBatch:
        columns["slice"] = pa.array([name] * count, pa.string())
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in ROWS], schema=ROWS)

    yield batch(rows, kind=pa.array(["doc"] * rows), doc_id=ids, n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups),
                n_links=pa.array(n_links), groups_sha256=pa.array(digest, pa.string()), data=pa.array(data, pa.binary()))
    blob = planes(links.astype(np.int32)) + planes(at.ravel().astype(np.int32)) if len(links) else b""
    yield batch(1, kind=pa.array(["window"]), n=pa.array([len(links)], pa.int64()), data=pa.array([blob], pa.binary()))
    yield batch(len(pairs), kind=pa.array(["pair"] * len(pairs), pa.string()), pair=pa.array(np.arange(len(pairs), dtype=np.int32)),
                a=pa.array((pairs >> 32).astype(np.int32)), b=pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), n=pa.array(n))


def slices(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL,
           pieces: str = PIECES) -> DataFrame:
    """The rows of all slices (see ``slice_rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = tokenizers(byte_level, pieces)
        partition, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                yield from slice_rows(f"{partition}-{number}", part.column("doc_id"), part.column("text"), pair)
                number += 1

    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, _ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked id pair: links of the corpus that hold
    it, and whether no other pair of the same B id has more."""
    counts = written(rows.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("count")))[0]
    # at most one row per A id in a group
    return written(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))))[0]


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL,
                    pieces: str = PIECES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    rows = written(slices(docs, key, text, byte_level, pieces))[0]
    answers = (rows.filter("kind = 'pair'").select("slice", "pair", "a", "b")
                   .join(bounded_broadcast(pair_counts(rows)), ["a", "b"])
                   .select(F.col("slice").alias("asked_by"), "pair", "count", "best"))

    def finish(t: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = np.array(t.column("kind").to_pylist())
        count, best = (np.zeros(len(asked), np.int64) for _ in range(2))
        at = asked.column("pair").to_numpy()
        count[at], best[at] = asked.column("count").to_numpy(), asked.column("best").to_numpy().astype(np.int64)
        window = t.slice(int(np.flatnonzero(kinds == "window")[0]), 1)
        m, blob = window.column("n")[0].as_py(), window.column("data")[0].as_py()
        links = numbers(blob[:4 * m], np.int32) if m else np.empty(0, np.int32)
        of = numbers(blob[4 * m:], np.int32) if m else np.empty(0, np.int32)
        first = np.concatenate([[0], np.cumsum(links)])
        best, count = _sums(best[of], first), _sums(count[of], first)
        mine = t.filter(pa.array(kinds == "doc"))
        codes = [numbers(x, np.int32) if x else np.empty(0, np.int32) for x in mine.column("data").to_pylist()]
        out = {c: mine.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        out["n_best"] = pa.array([int(best[c].sum()) for c in codes], pa.int64())
        out["count_sum"] = pa.array([int(count[c].sum()) for c in codes], pa.int64())
        return pa.table({**out, "groups_sha256": mine.column("groups_sha256")})

    return (rows.filter("kind <> 'pair'").drop("pair", "a", "b").groupBy("slice").cogroup(answers.groupBy("asked_by"))
            .applyInArrow(finish, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                                  "count_sum bigint, groups_sha256 string"))


def op13_anchor_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizations of every document."""
    return align_documents(documents(spark, sf_dir))
