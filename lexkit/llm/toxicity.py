"""Operator 2, toxicity: weak supervision.

1. Lexicons.  Over the labelled training rows (at most about LABELLED_ROWS of
   them, chosen by a hash of the id), the document frequency of every
   word and of every word beginning (4 to 7 bytes) is counted per label; those
   tied to label 1 form lexicons by how sure the tie is (lower bound of the
   log-odds).  The lexicons are bounded top lists.
2. Voters.  Lexicon voters (does the text hold a word, two words of a lexicon),
   pattern voters (beginnings, their number and density) vote 1, 0 or abstain
   on every training document.
3. Label model.  A generative model with one latent label per document: each
   voter's accuracy (its mean vote under either label) and the voters'
   correlations (their covariance under the label) are estimated by
   expectation-maximisation over the counted vote patterns of all training
   documents, with known labels held fixed.  Correlated voters share their
   weight through the inverse covariance.
4. Classifier.  A logistic regression over word-count features is fitted to the
   posterior labels of a bounded sample of training documents and scores every
   text.

What is learnt comes only from rows whose crc32(id) mod 5 is not 0; labels,
lang, source and id are no input of a score.

Defined cases: null and empty texts get features of zero hits and a score; a
null id is a training row without a label; repeated label rows count as their
mean; without labelled rows of both labels, or without a word that is tied to
label 1, nothing can be told apart and every score is 0; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.llm.common import crc_mod, documents, hash_sample
from lexkit.llm.flatwords import U64, Words, as_long, text_slices
from lexkit.llm.vectortable import lists, matrix
from lexkit.session import materialize

FOLDS = 5
PREFIX_BYTES = (4, 5, 6, 7)
TIERS = (4.0, 2.75, 1.5)          # lower bounds of the log-odds of a lexicon
TIER_WORDS = 4096                 # most entries of one lexicon
LABELLED_ROWS = 200_000           # labelled rows that are learnt from
SAMPLE_ROWS = 40_000              # training rows of the classifier
EM_ROUNDS = 40
COUNT_BYTES = 8 << 20             # text whose entries are counted together
KINDS = 2                         # words, beginnings


def _prefix_hashes(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hash) of the words longer than n bytes, per n."""
    for n in PREFIX_BYTES:
        at = np.flatnonzero(w.end - w.start > n)
        yield at, w.spans(w.start[at], w.start[at] + n) + U64(n)


def _letters_only(w: Words) -> np.ndarray:
    """Word hashes without trailing punctuation (. , ; : ! ?)."""
    end = w.end.copy()
    marks = np.zeros(256, bool)
    marks[[33, 44, 46, 58, 59, 63]] = True
    cut = marks[w.data[end - 1]] & (end - w.start > 1) if len(end) else np.empty(0, bool)
    end[cut] -= 1
    return w.spans(w.start, end)


def _entry_lists(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, row numbers, entry hashes) of every occurrence: the words, then
    the beginnings of each length."""
    yield 0, w.doc, _letters_only(w)
    for at, h in _prefix_hashes(w):
        yield 1, w.doc[at], h


def entry_counts(labelled: DataFrame) -> DataFrame:
    """(kind, entry, df1, df0): documents of either label holding the entry,
    counted inside each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", COUNT_BYTES):
                w = Words(part.column("text"))
                y = part.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                # one length of beginnings at a time: only its entries are sorted and held
                for kind, doc, h in _entry_lists(w):
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    u, at = np.unique(h[new], return_inverse=True)
                    one = np.bincount(at, weights=y[doc[new]], minlength=len(u)).astype(np.int64)
                    both = np.bincount(at, minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(u), kind, np.int32)), pa.array(as_long(u)), pa.array(one), pa.array(both - one)],
                        ["kind", "entry", "df1", "df0"])

    return (labelled.select("text", "y").mapInArrow(run, "kind int, entry bigint, df1 bigint, df0 bigint")
            .groupBy("kind", "entry").agg(F.sum("df1").alias("df1"), F.sum("df0").alias("df0")))


def induce_lexicons(labelled: DataFrame, n1: int, n0: int) -> list[list[np.ndarray]]:
    """Per kind and tier, the sorted entry hashes whose tie to label 1 is sure
    enough; an entry belongs to the highest tier it reaches."""
    odds = (F.log((F.col("df1") + 0.5) / (n1 + 1.0)) - F.log((F.col("df0") + 0.5) / (n0 + 1.0)))
    error = F.sqrt(1.0 / (F.col("df1") + 0.5) + 1.0 / (F.col("df0") + 0.5))
    sure = materialize(entry_counts(labelled).filter("df1 >= 2").withColumn("sure", odds - 1.645 * error)
                       .filter(F.col("sure") >= TIERS[-1]))
    out = []
    for kind in range(KINDS):
        tiers = []
        for i, low in enumerate(TIERS):
            s = sure.filter((F.col("kind") == kind) & (F.col("sure") >= low)
                            & (F.lit(True) if i == 0 else F.col("sure") < TIERS[i - 1]))
            top = s.orderBy(F.col("sure").desc(), "entry").select("entry").limit(TIER_WORDS).collect()
            tiers.append(np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64)))
        out.append(tiers)
    return out


def _hits(doc: np.ndarray, h: np.ndarray, lexicon: np.ndarray, rows: int) -> np.ndarray:
    if not len(lexicon) or not len(h):
        return np.zeros(rows)
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    return np.bincount(doc[lexicon[at] == h], minlength=rows).astype(float)


def hit_counts(texts: pa.Array, lexicons: list[list[np.ndarray]]) -> np.ndarray:
    """Rows x (kinds * tiers + 1): occurrences of each lexicon, and words."""
    w = Words(texts)
    columns = [np.zeros((len(texts), len(tiers))) for tiers in lexicons]
    for kind, doc, h in _entry_lists(w):
        for i, lexicon in enumerate(lexicons[kind]):
            columns[kind][:, i] += _hits(doc, h, lexicon, len(texts))
    return np.concatenate([*columns, w.counts.astype(float)[:, None]], 1)


def features(hits: np.ndarray) -> np.ndarray:
    """Classifier inputs: per lexicon one, two, three or more hits (as steps),
    the logarithm of the hits, and their density; then the text's length."""
    counts, words = hits[:, :-1], hits[:, -1]
    steps = [np.minimum(counts, k) / k for k in (1, 2, 3)]
    density = np.log1p(1000 * counts / np.maximum(words, 1)[:, None])
    return np.concatenate([*steps, np.log1p(counts), density, np.log1p(words)[:, None] / 10], 1)


def votes(hits: np.ndarray) -> np.ndarray:
    """Rows x voters of 1 (toxic), -1 (not), 0 (abstains)."""
    counts, words = hits[:, :-1], hits[:, -1]
    n = len(TIERS)
    word, begin = counts[:, :n], counts[:, n:]
    rate = 1000 * counts / np.maximum(words, 1)[:, None]
    out = [np.where(word[:, 0] >= 1, 1, -1), np.where(word[:, 0] >= 2, 1, 0), np.where(word[:, 1] >= 1, 1, 0),
           np.where(word[:, 1] >= 2, 1, 0), np.where(word[:, 2] >= 2, 1, 0),
           np.where(begin[:, 0] >= 1, 1, -1), np.where(begin[:, 0] >= 2, 1, 0), np.where(begin[:, 1] >= 1, 1, 0),
           np.where(begin[:, 2] >= 2, 1, 0), np.where(rate[:, 0] + rate[:, n] >= 1, 1, -1),
           np.where(counts.sum(1) == 0, -1, 0)]
    return np.stack(out, 1).astype(np.int64)


VOTERS = 11


def pattern_code(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def pattern_votes(code: np.ndarray) -> np.ndarray:
    return (np.asarray(code)[:, None] // 3 ** np.arange(VOTERS)) % 3 - 1


@dataclass
class LabelModel:
    """Voter means under either label, their shared covariance, the share of
    label 1; ``posterior`` gives P(label 1 | votes)."""

    share: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros((2, VOTERS)))
    covariance: np.ndarray = field(default_factory=lambda: np.eye(VOTERS))

    def fit(self, v: np.ndarray, known: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
        """``v`` patterns, ``known`` their label (1, 0, -1 unknown), ``n`` rows."""
        v = v.astype(float)
        q = np.where(known >= 0, known, 0.0)
        weight = np.where(known >= 0, n, 0.0)          # the first round learns from known labels
        for _ in range(rounds):
            w1, w0 = weight * q, weight * (1 - q)
            total = max(weight.sum(), 1e-9)
            self.share = float(np.clip(w1.sum() / total, 1e-4, 1 - 1e-4))
            self.mean = np.stack([(w0 @ v + 0) / max(w0.sum(), 1e-9), (w1 @ v) / max(w1.sum(), 1e-9)])
            d0, d1 = v - self.mean[0], v - self.mean[1]
            self.covariance = ((d0 * w0[:, None]).T @ d0 + (d1 * w1[:, None]).T @ d1) / total + 0.02 * np.eye(v.shape[1])
            new = np.where(known >= 0, np.maximum(known, 0), self.posterior(v))
            if np.abs(new - q).max(initial=0) < 1e-6 and (weight == n).all():
                break
            q, weight = new, n.astype(float)
        return self

    @property
    def accuracy(self) -> np.ndarray:
        """Per voter, the chance that a vote agrees with the label."""
        agree = (1 + np.stack([-self.mean[0], self.mean[1]])) / 2
        return (1 - self.share) * agree[0] + self.share * agree[1]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        w = np.linalg.solve(self.covariance, self.mean[1] - self.mean[0])
        z = v @ w - w @ (self.mean[0] + self.mean[1]) / 2 + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (last one: bias) of a logistic regression on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty),
                               x.T @ (p - q) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Scorer:
    """Lexicons and classifier weights; without lexicons every score is 0."""

    lexicons: list[list[np.ndarray]]
    weights: np.ndarray

    def of_hits(self, hits: np.ndarray) -> np.ndarray:
        z = features(hits) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        return self.of_hits(hit_counts(texts, self.lexicons)) if self.lexicons else np.zeros(len(texts))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> tuple[Scorer, DataFrame]:
    """The scorer, and the table (doc_id, held_out, hits, pattern) it was fitted on:
    one row per document, hits null if there was nothing to learn from."""
    y = materialize(labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_y"))
                    .filter("_y IS NOT NULL AND _id IS NOT NULL").groupBy("_id")
                    .agg((F.avg("_y") >= 0.5).cast("int").alias("y"))
                    .filter(crc_mod("_id", FOLDS) != 0))
    # bounded: two numbers for each of about LABELLED_ROWS rows
    y = F.broadcast(hash_sample(y, LABELLED_ROWS, "_id"))
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")) \
              .withColumn("held_out", crc_mod("doc_id", FOLDS) == 0)
    labelled = src.join(y, F.col("doc_id") == F.col("_id")).select("text", "y")
    n1, n = labelled.agg(F.sum("y"), F.count("y")).first()
    n1 = n1 or 0
    lexicons = induce_lexicons(labelled, n1, n - n1) if 0 < n1 < n else []
    if not any(len(tier) for kind in lexicons for tier in kind):
        return Scorer([], np.zeros(1)), src.select(
            "doc_id", "held_out", F.lit(None).cast("array<double>").alias("hits"), F.lit(0).cast("bigint").alias("pattern"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                hits = hit_counts(part.column("text"), lexicons)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), lists(hits), pa.array(pattern_code(votes(hits)))],
                    ["doc_id", "held_out", "hits", "pattern"])

    table = materialize(src.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, hits array<double>, pattern bigint"))
    train = table.filter(~F.col("held_out")).join(y, F.col("doc_id") == F.col("_id"), "left")
    # at most 3 ** voters patterns x 3 label states, however many documents
    patterns = train.groupBy("pattern", F.coalesce("y", F.lit(-1)).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    model = LabelModel().fit(pattern_votes(np.array([r[0] for r in patterns])),
                             np.array([r[1] for r in patterns]), np.array([r[2] for r in patterns], float))
    sample = hash_sample(table.filter(~F.col("held_out")), SAMPLE_ROWS, "doc_id").select("hits", "pattern").collect()
    q = model.posterior(pattern_votes(np.array([r[1] for r in sample])).astype(float))
    return Scorer(lexicons, fit_logistic(features(np.array([r[0] for r in sample], float)), q)), table


def score_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1)."""
    scorer, table = fit(docs, labels, key, text, label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = scorer.of_hits(matrix(b.column("hits"))) if scorer.lexicons else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s)],
                                                 ["doc_id", "held_out", "score"])

    return table.select("doc_id", "held_out", "hits").mapInArrow(score, "doc_id bigint, held_out boolean, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  threshold: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches ``threshold``."""
    scorer, _ = fit(docs, labels, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                yield part.filter(pa.array(scorer.of_texts(part.column(text)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scores = score_texts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
