"""Quality classifier: a weak-label model trains a hashed linear scorer.

1. Twelve heuristic labellers vote good, bad or abstain on every document. They
   overlap and err; none needs labels.
2. Expectation-maximisation (Dawid and Skene 1979) estimates each labeller's vote
   distribution under good and bad documents, and so its accuracy. It needs only
   how often each combination of votes occurs: at most 3^12 rows, whatever the
   number of documents, counted over all of them with a partial aggregate.
3. The posterior of its votes labels each document of a bounded sample
   (``SAMPLE`` smallest id hashes), on which a logistic scorer over hashed
   byte-shape trigrams and measure bins is trained. It scores every document.

``kept`` is ``score >= 0.5``. Null and empty texts have no words: they get the
vote "too short", score 0 and are not kept. Long texts are measured whole. A score of exactly 0.5
is kept. Repeated rows count as often as they occur and score alike; rows without an id score like
others and are not sampled. An empty table gives an empty result. Extra columns pass through, but those called
``votes_bad``, ``votes_good``, ``posterior`` or ``quality_score``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import Words, fitted, sample_ids, shingle_sets, small_text_batches, steps, text_buffer

#: Documents of the sample that the scorer is trained on.
SAMPLE = 5000
BINS = 1 << 12
GOOD, BAD, NONE = 1, 2, 0

#: Byte classes: 0 space, 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 sentence mark, 5 up other marks by byte.
SHAPE = np.full(256, 1, dtype=np.int64)
SHAPE[:128] = 5 + np.arange(128) % 58
SHAPE[[0x20, *range(0x09, 0x0E)]] = 0
SHAPE[97:123] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3
SHAPE[[ord(c) for c in ".,?;:'\"()-"]] = 4
CLASSES = int(SHAPE.max()) + 1
PLAIN = SHAPE < 5

#: A labeller says bad above ``bad`` (good at or below ``good``) of its measure; negative signs turn it round.
LABELLERS = (
    ("marks", 0.02, 0.06),
    ("capitals", 0.2, 0.5),
    ("exclamations", 0.05, 0.3),
    ("top_word", 0.15, 0.3),
    ("same_words", 0.6, 0.75),
    ("no_word_tokens", 0.05, 0.12),
    ("word_length", 0.0, 4.0),
    ("same_shingles", 0.15, 0.35),
    ("marked_words", 0.1, 0.4),
    ("doubled_marks", 0.01, 0.05),
    ("stutter", 0.08, 0.2),
    ("too_short", 0.0, 0.5),
)
#: Edges of the bins in which measures become hashed features.
EDGES = np.array([0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95])


def measures(texts: pa.Array) -> np.ndarray:
    """(n, labellers) of a batch of texts."""
    raw, offs = text_buffer(texts)
    n, size = len(texts), np.maximum(np.diff(offs), 1)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])
    upper, lower = (raw >= 65) & (raw <= 90), ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    letters = np.maximum(per(upper | lower), 1)
    w = Words(texts)
    words = np.maximum(w.count, 1)
    doc = np.repeat(np.arange(n), w.count)
    alpha = np.concatenate([[0], np.cumsum(upper | lower | ((raw >= 48) & (raw <= 57)), dtype=np.int64)])
    bare = (alpha[w.end] - alpha[w.start]) == 0
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(d)))
    top, distinct = np.zeros(n), np.zeros(n)
    if len(first):
        np.maximum.at(top, d[first], runs)
        distinct = np.bincount(d[first], minlength=n).astype(float)
    lengths = np.bincount(doc, weights=w.end - w.start, minlength=n) / words if n else np.zeros(0)
    _, so = shingle_sets(w)
    shingles = np.where(w.count >= 5, w.count - 4, w.count > 0)
    enough = w.count >= 20
    out = np.zeros((n, len(LABELLERS)))
    out[:, 0] = per(~PLAIN[raw]) / size
    out[:, 1] = per(upper) / letters
    out[:, 2] = per(raw == ord("!")) / words
    out[:, 3] = np.where(enough, top / words, 0.0)
    out[:, 4] = np.where(enough, 1.0 - distinct / words**0.9, 0.0)
    out[:, 5] = np.bincount(doc, weights=bare, minlength=n) / words if n else 0.0
    out[:, 6] = np.maximum(0.0, np.maximum(3.0 - lengths, lengths - 12.0))
    out[:, 7] = np.where(enough, 1.0 - np.diff(so) / np.maximum(shingles, 1), 0.0)
    marks = np.concatenate([[0], np.cumsum(~PLAIN[raw], dtype=np.int64)])
    out[:, 8] = np.bincount(doc, weights=(marks[w.end] - marks[w.start]) > 0, minlength=n) / words if n else 0.0
    twin = np.zeros(len(raw), dtype=bool)
    twin[1:] = ~PLAIN[raw[1:]] & (raw[1:] == raw[:-1])
    out[:, 9] = per(twin) / size
    echo = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    out[:, 10] = np.where(enough, np.bincount(doc[1:][echo], minlength=n) / words, 0.0) if n else 0.0
    out[:, 11] = np.clip((5 - w.count) / 5.0, 0.0, 1.0) * 2
    return out


def votes(m: np.ndarray) -> np.ndarray:
    good, bad = np.array([v[1] for v in LABELLERS]), np.array([v[2] for v in LABELLERS])
    return np.where(m > bad, BAD, np.where(m <= good, GOOD, NONE)).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def unpattern(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    prior: float  # of bad
    table: np.ndarray  # (2 good/bad, labellers, 3 votes)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        at = np.arange(v.shape[1])
        lg = np.log(1 - self.prior) + np.log(self.table[0, at, v]).sum(axis=1)
        lb = np.log(self.prior) + np.log(self.table[1, at, v]).sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(lb - lg, -40, 40)))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among the votes that a labeller casts, by the model."""
        p = np.array([1 - self.prior, self.prior])[:, None]
        right = (p * np.stack([self.table[0, :, GOOD], self.table[1, :, BAD]])).sum(axis=0)
        cast = (p * self.table[:, :, [GOOD, BAD]].sum(axis=2)).sum(axis=0)
        return {name[0]: float(r / max(c, 1e-12)) for name, r, c in zip(LABELLERS, right, cast, strict=True)}


def expectation_maximisation(v: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """Fit on vote combinations and their counts; starts from the number of bad votes (good ones are cheap: most
    labellers look for one kind of fault)."""
    q = np.array([0.02, 0.4, 0.95])[np.minimum((v == BAD).sum(axis=1), 2)]
    model = LabelModel(0.5, np.full((2, v.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        prior = float(np.clip((q * count).sum() / max(count.sum(), 1e-9), 0.005, 0.5))
        table = np.empty_like(model.table)
        for c, weight in enumerate(((1 - q) * count, q * count)):
            for k in range(3):
                table[c, :, k] = ((v == k) * weight[:, None]).sum(axis=0) + 0.5
            table[c] /= table[c].sum(axis=1, keepdims=True)
        done = np.abs(table - model.table).max() < 1e-7 and abs(prior - model.prior) < 1e-7
        model = LabelModel(prior, table)
        if done:
            break
        q = 1.0 - model.posterior(v)
    return model


#: Features of the scorer.
WIDTH = BINS + len(LABELLERS) * (len(EDGES) + 1)


def hashed(texts: pa.Array, m: np.ndarray) -> np.ndarray:
    """(n, BINS + measures x bins) features: root shares of hashed shape trigrams, and measure bins."""
    raw, offs = text_buffer(texts)
    n = len(texts)
    s = SHAPE[raw]
    out = np.zeros((n, BINS))
    if len(s) >= 3:
        code = (s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:]
        slot = (code * 2654435761 >> 9) & (BINS - 1)
        doc = np.repeat(np.arange(n), np.diff(offs))
        same = doc[:-2] == doc[2:]
        out = np.bincount(doc[:-2][same] * BINS + slot[same], minlength=n * BINS).reshape(n, BINS).astype(float)
    out = np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))
    width = len(EDGES) + 1
    bins = np.zeros((n, m.shape[1] * width))
    at = np.searchsorted(EDGES, m, side="right") + np.arange(m.shape[1]) * width
    np.put_along_axis(bins, at, 0.5, axis=1)
    return np.hstack([out, bins])


def train_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4, rate: float = 0.05) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adam; the last coefficient is the intercept.

    ``x`` is float32 and is never copied.
    """
    y = y.astype(np.float32)
    w, m, v = np.zeros(x.shape[1] + 1, dtype=np.float32), 0.0, 0.0
    for t in range(1, rounds + 1):
        e = (1.0 / (1.0 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y) / max(len(y), 1)
        g = np.append(e @ x, e.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def _vote_rows(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, column):
                code = pattern(votes(measures(b.column(b.schema.get_field_index(column)))))
                k, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["code", "n"])

    return run


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vote patterns and probabilities of being good."""
        m = measures(texts)
        v = votes(m)
        p = 1.0 / (1.0 + np.exp(-np.clip(hashed(texts, m) @ self.weights[:-1] + self.weights[-1], -30, 30)))
        empty = m[:, -1] >= 2
        return v, np.where(empty, 0.0, p)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Vote on all documents, fit the label model on counts, the scorer on the bounded sample."""
    small_text_batches(docs.sparkSession)
    counts = docs.select(text_col).mapInArrow(_vote_rows(text_col), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    v = unpattern(np.array([r["code"] for r in counts], dtype=np.int64)) if counts else np.zeros((0, len(LABELLERS)), np.int64)
    labels = expectation_maximisation(v, np.array([r["n"] for r in counts], dtype=float))
    picked = sample_ids(docs.select(id_col), id_col, sample)  # at most `sample` ids to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id")

    def fit(table: pa.Table) -> np.ndarray:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]).slice(0, sample).combine_chunks()  # repeated ids are more rows than ids
        x, y = np.zeros((len(table), WIDTH), dtype=np.float32), np.zeros(len(table))
        for at in range(0, len(table), 100):
            texts = table.column("text").slice(at, 100).combine_chunks()
            m = measures(texts)
            x[at : at + 100], y[at : at + 100] = hashed(texts, m), labels.posterior(votes(m))
        used = np.flatnonzero(x.any(axis=0))
        w = np.zeros(WIDTH + 1)
        got = train_scorer(x[:, used], y)
        w[used], w[-1] = got[:-1], got[-1]
        return w

    w = fitted(rows, fit)
    return QualityModel(labels, np.zeros(WIDTH + 1) if w is None else w)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``votes_bad``, ``votes_good``, ``posterior`` and ``quality_score`` appended."""
    small_text_batches(docs.sparkSession)
    base = docs.drop("votes_bad", "votes_good", "posterior", "quality_score")
    added = {"votes_bad": F.lit(0), "votes_good": F.lit(0), "posterior": F.lit(0.0), "quality_score": F.lit(0.0)}
    out = base.withColumns(added).schema
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, text_col):
                v, p = model.score(b.column(at))
                bad, good = ((v == k).sum(axis=1).astype(np.int32) for k in (BAD, GOOD))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad), pa.array(good), pa.array(model.labels.posterior(v)), pa.array(p)], names=out.names)

    return base.mapInArrow(run, out)


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id, votes_bad, votes_good, posterior, score, kept`` of every document."""
    got = score(docs.select("doc_id", "text"), train(docs))
    return got.select("doc_id", "votes_bad", "votes_good", "posterior", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
