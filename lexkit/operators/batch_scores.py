"""Blocked scores, loss and gradients of the lexical scorer inside batches (R8, R9,
A7, A9).

A batch is B (query, document) crop pairs; S[d, q] is the sum over shared tokens
of weight * tf / (tf + e^beta).  The documents of a batch are dealt to blocks of
at most ``DOC_BLOCK``; the queries are copied to every block of their batch, as
are the weights of the batch's tokens.  A block multiplies its sparse documents
with the sparse queries, slice by slice of bounded size, into its part of S
(block x B numbers), so no row per (document, query, token) leaves a task and a
token that every text has (a comma) is spread over the blocks.

A block sees all queries, so the log-sum-exp and the best query of its documents
are final; for the queries it gives a maximum and a sum that are combined over
the blocks of the batch.  With one block a batch is finished in one pass, loss
and gradients; with several, the gradients take a second pass that is given the
queries' log-sum-exp.  Pairs without a shared token score 0, as in a dense
matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkit.operators.joins import bounded_broadcast
from lexkit.session import materialize

DOC_BLOCK = 512
SLICE = 2 << 20            # (document, query, token) products made at a time
DENSE = 1 << 20            # cells of a dense (row, token) table of a coded batch
_ROWS = ("batch bigint, kind string, pos bigint, token string, m double, s double, own double, hit double")
_SCHEMA = pa.schema([("batch", pa.int64()), ("kind", pa.string()), ("pos", pa.int64()), ("token", pa.string()), ("m", pa.float64()),
                     ("s", pa.float64()), ("own", pa.float64()), ("hit", pa.float64())])


class Block:
    """Sparse documents and queries of one block, tokens numbered."""

    def __init__(self, docs: pa.Table, queries: pa.Table, weights: pa.Table, beta: float):
        self.docs, self.queries = docs.column("pos").to_numpy(), queries.column("pos").to_numpy()
        tokens = weights.column("token").combine_chunks()
        d, code_d = self._coded(docs.column("k_tokens"), tokens)
        key, tf = np.unique(code_d * max(len(self.docs), 1) + d, return_counts=True)
        self.code_d, self.d = np.divmod(key, max(len(self.docs), 1))            # in order of the token
        q, code_q = self._coded(queries.column("q_tokens"), tokens)
        self.code_q, self.q = np.divmod(np.unique(code_q * max(len(self.queries), 1) + q), max(len(self.queries), 1))
        eb = np.exp(beta)
        self.weight = weights.column("weight").to_numpy().astype(float)
        self.sat, self.slope = tf / (tf + eb), -tf * eb / (tf + eb) ** 2
        self.tokens = tokens
        self.lo, self.hi = np.searchsorted(self.code_d, self.code_q), np.searchsorted(self.code_d, self.code_q, side="right")

    @staticmethod
    def _coded(lists: pa.ChunkedArray, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of the token) of every token that has a weight."""
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = pc.list_flatten(lists)
        code = pc.fill_null(pc.index_in(flat, value_set=tokens), -1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        return row[code >= 0], code[code >= 0]

    def _slices(self):
        """(document entry, query entry) of every shared token, in bounded slices."""
        many = self.hi - self.lo
        total = np.cumsum(many)
        for part in np.split(np.arange(len(many)), np.flatnonzero(np.diff(total // SLICE)) + 1):
            n = many[part]
            entry = np.repeat(self.lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield entry, np.repeat(part, n)

    def scores(self) -> np.ndarray:
        """S, documents x queries."""
        width = len(self.queries)
        s = np.zeros(len(self.docs) * width)
        value = self.weight[self.code_d] * self.sat
        for e, q in self._slices():
            at, key = np.unique(self.d[e] * width + self.q[q], return_inverse=True)
            s[at] += np.bincount(key, value[e], len(at))
        return s.reshape(len(self.docs), width)

    def gradients(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        """Per token sum G sat, and the sum of G weight d sat / d beta."""
        by_token, by_beta = np.zeros(len(self.tokens)), 0.0
        for e, q in self._slices():
            pull = g[self.d[e], self.q[q]]
            by_token += np.bincount(self.code_d[e], pull * self.sat[e], len(self.tokens))
            by_beta += float((pull * self.weight[self.code_d[e]] * self.slope[e]).sum())
        return by_token, by_beta


def _lse(s: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    m = s.max(axis)
    return m, np.exp(s - np.expand_dims(m, axis)).sum(axis)


def coded_batch(n: int, d: np.ndarray, dt: np.ndarray, tf: np.ndarray, q: np.ndarray, qt: np.ndarray, weight: np.ndarray,
                beta: float) -> tuple[float, float, np.ndarray, float]:
    """(loss, acc, gradient per token, gradient of beta) of a batch of ``n`` documents and
    queries, given as entries in order of the token: documents (``d``, ``dt``, ``tf``),
    queries (``q``, ``qt``).  A stretch of tokens of bounded size at a time is a matrix
    product."""
    eb = np.exp(beta)
    sat, slope = tf / (tf + eb), -tf * eb / (tf + eb) ** 2
    value = weight[dt] * sat
    cuts = np.arange(0, len(weight) + 1, max(DENSE // n, 1))
    cuts = cuts if cuts[-1] == len(weight) else np.append(cuts, len(weight))
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        (e0, e1), (f0, f1) = np.searchsorted(dt, (a, b)), np.searchsorted(qt, (a, b))
        parts.append((slice(e0, e1), d[e0:e1], dt[e0:e1] - a, q[f0:f1], qt[f0:f1] - a, b - a))

    def asked(row: np.ndarray, token: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((n, width))
        out[row, token] = 1.0
        return out

    s = np.zeros((n, n))
    for e, row, token, other, of, width in parts:
        docs = np.zeros((n, width))
        docs[row, token] = value[e]
        s += docs @ asked(other, of, width).T
    loss, acc, g = _loss(s)
    pull = np.empty(len(d))
    for e, row, token, other, of, width in parts:
        pull[e] = (g @ asked(other, of, width))[row, token]
    return loss, acc, np.bincount(dt, pull * sat, len(weight)), float((pull * weight[dt] * slope).sum())


def _loss(s: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(loss, acc, gradient by score) of the scores of a batch, documents x queries."""
    n = len(s)
    at = np.arange(n)
    m, total = _lse(s, 1)
    lse_d = m + np.log(total)
    m, total = _lse(s, 0)
    lse_q = m + np.log(total)
    loss = float(np.mean(lse_d - s[at, at]) + np.mean(lse_q - s[at, at]))
    acc = float(np.mean(np.round(s, 9).argmax(1) == at))
    g = np.exp(s - lse_d[:, None]) + np.exp(s - lse_q[None])
    g[at, at] -= 2
    return loss, acc, g / n


def _table(batch: int, parts: list[dict]) -> pa.Table:
    rows = []
    for p in parts:
        n = len(p["s"])
        full = {**p, "batch": np.full(n, batch, np.int64), "kind": [p["kind"]] * n}
        rows.append(pa.Table.from_arrays([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(n, f.type) for f in _SCHEMA],
                                         schema=_SCHEMA))
    return pa.concat_tables(rows) if rows else _SCHEMA.empty_table()


def _blocks(pairs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of every block, weights of every block's batch), keyed (batch, block):
    a row is a document of the block (``mine``), a query, or both."""
    size = bounded_broadcast(pairs.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / DOC_BLOCK).cast("int").alias("blocks")))
    spread = lambda df: df.join(size, "batch").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = [c for c in ("lse",) if c in pairs.columns]
    rows = spread(pairs).withColumn("mine", F.pmod("pos", "blocks") == F.col("block")).select(
        "batch", "block", "blocks", "pos", "q_tokens", F.when(F.col("mine"), F.col("k_tokens")).alias("k_tokens"), "mine", *more)
    tokens = pairs.select("batch", F.explode(F.array_distinct("k_tokens")).alias("token")).distinct()
    known = tokens.join(weights.select("token", "weight"), "token")
    return rows, spread(known).select(F.col("batch").alias("wbatch"), F.col("block").alias("wblock"), "token", "weight")


def block_pass(pairs: DataFrame, weights: DataFrame, beta: float, gradients: bool = False) -> DataFrame:
    """Rows by kind: ``d`` (final loss ``s`` and ``hit`` of a document), ``q`` (maximum
    ``m``, sum ``s`` and own score of a query in a block), with ``gradients`` ``w``
    (token, ``s``) and ``b`` (``s``): for batches of one block, and for all when the
    pairs carry the queries' log-sum-exp (``lse``)."""
    given = "lse" in pairs.columns

    def run(t: pa.Table, w: pa.Table) -> pa.Table:
        if not len(t):
            return _table(0, [])
        t = t.sort_by("pos")
        batch, alone = t.column("batch")[0].as_py(), t.column("blocks")[0].as_py() == 1
        block = Block(t.filter(t.column("mine")), t, w, beta)
        s = block.scores()
        own = np.searchsorted(block.queries, block.docs)
        m, total = _lse(s, 1)
        lse_d = m + np.log(total)
        parts = []
        if not given:
            best = np.round(s, 9).argmax(1)
            parts.append({"kind": "d", "pos": block.docs, "s": lse_d - s[np.arange(len(own)), own], "hit": (best == own).astype(float)})
            mq, sq = _lse(s, 0)
            mine = np.full(len(block.queries), np.nan)
            mine[own] = s[np.arange(len(own)), own]
            parts.append({"kind": "q", "pos": block.queries, "m": mq, "s": sq, "own": pa.array(mine, from_pandas=True)})
        if gradients and (given or alone):
            lse_q = t.column("lse").to_numpy() if given else mq + np.log(sq)
            g = np.exp(s - lse_d[:, None]) + np.exp(s - lse_q[None])
            g[np.arange(len(own)), own] -= 2
            by_token, by_beta = block.gradients(g / len(block.queries))
            parts += [{"kind": "w", "token": pc.cast(block.tokens, pa.string()), "s": by_token}, {"kind": "b", "s": np.array([by_beta])}]
        return _table(batch, parts)

    rows, known = _blocks(pairs, weights)
    return rows.groupBy("batch", "block").cogroup(known.groupBy("wbatch", "wblock")).applyInArrow(run, _ROWS)


def query_lse(out: DataFrame) -> DataFrame:
    """(batch, pos, lse, own) of every query, its blocks combined."""
    parts = out.filter("kind = 'q'").groupBy("batch", "pos").agg(
        F.max("m").alias("m"), F.max("own").alias("own"), F.collect_list(F.struct("m", "s")).alias("parts"))   # one per block
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["s"] * F.exp(x["m"] - F.col("m")))
    return parts.select("batch", "pos", (F.col("m") + F.log(total)).alias("lse"), "own")


def batch_loss(out: DataFrame) -> DataFrame:
    """(batch, loss, acc): mean cross entropy of documents and of queries, and the
    share of documents whose best query is their own."""
    d = out.filter("kind = 'd'").groupBy("batch").agg(F.avg("s").alias("ce_d"), F.avg("hit").alias("acc"))
    q = query_lse(out).groupBy("batch").agg(F.avg(F.col("lse") - F.col("own")).alias("ce_q"))
    return d.join(q, "batch").select("batch", (F.col("ce_d") + F.col("ce_q")).alias("loss"), "acc")


def loss_and_gradients(pairs: DataFrame, weights: DataFrame, beta: float) -> tuple[DataFrame, DataFrame, float]:
    """((batch, loss, acc), (token, g), d loss / d beta) summed over the batches."""
    out = materialize(block_pass(pairs, weights, beta, gradients=True))
    steps = out.filter("kind in ('w', 'b')")
    large = pairs.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DOC_BLOCK).select("batch")
    if not large.isEmpty():
        rest = pairs.join(large, "batch").join(query_lse(out).select("batch", "pos", "lse"), ["batch", "pos"])
        steps = steps.unionByName(materialize(block_pass(rest, weights, beta, gradients=True)).filter("kind in ('w', 'b')"))
    grad_w = (steps.filter("kind = 'w'").groupBy(F.col("token").cast(weights.schema["token"].dataType).alias("token"))
                   .agg(F.sum("s").alias("g")))
    return batch_loss(out), grad_w, float(steps.filter("kind = 'b'").agg(F.sum("s")).first()[0] or 0.0)
