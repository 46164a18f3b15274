"""Toxicity by compression distance.

Two zstandard dictionaries are trained by zstd's trainer on windows of labelled texts, one on ordinary
and one on toxic text. A window is cheap under the dictionary whose text it resembles; the
difference of the two compressed lengths is its toxicity in bytes. A text is described by
its largest differences and by how many windows pass fixed differences; a
logistic calibration on labelled texts that the dictionaries have not seen turns
that into a probability, and 0.5 of it is the threshold.

A window is one word between constant frames that both dictionaries hold: a frame
compresses to a match, so every byte of difference comes from the word, and equal
words share one result. (Windows of several words without frames carry too much noise here: README.)
The toxic dictionary is trained on the windows of toxic texts that the ordinary dictionary does not
compress: they cost ``COST`` bytes or more, or all of a shorter word (of ``SHORTEST`` bytes at least). A window counts once for each pair of
neighbours it was seen between, so a text copied thirty times counts once; windows seen fewer
than ``least`` times are left out, and the calibration texts choose ``least`` among ``LEAST`` by
their log loss.

Labels are learnt from rows outside fold 0 of 5 only, at most ``MAX_TOXIC`` and
``MAX_ORDINARY`` of them (the smallest ids by hash) and ``MAX_WINDOWS`` ordinary windows; nothing but the
text enters a score. Columns called ``toxic_score`` or ``toxic_predicted`` are replaced. Null and empty texts get the score of a text without windows; long texts are
scored whole; ties (a score of exactly 0.5) are toxic. Without
toxic or without ordinary training rows every score is 0. Extra columns,
repeated rows, labels of missing documents and empty tables are harmless.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import fitted, fold_of, sample_ids, small_text_batches

#: Bounds of the labelled sample that the model is fitted on.
MAX_TOXIC, MAX_ORDINARY = 2000, 4000
#: Ordinary windows of the trainer; bytes of the dictionaries; segment and match size of the trainer.
MAX_WINDOWS, ORDINARY_BYTES, TOXIC_BYTES = 600_000, 1 << 17, 1 << 12
ORDINARY_FIT, TOXIC_FIT = {"k": 16, "d": 6}, {"k": 200, "d": 8}
#: Bytes that a window of the toxic dictionary costs under the ordinary one, and of its word; choices of the least count.
COST, SHORTEST, LEAST = 5, 4, (3, 5, 10, 20)
FRAME = b"qZ7~Xv#Kj2@Wm9%Ry4^Ht6&Gp1*Nb8!Fd"
STEPS = (2, 3, 4, 5)
LOW, HIGH = -4.0, 10.0
MEMO = 1 << 20
_WORD = re.compile(rb"[^\x00-\x20!-&(-,./:-@\[-^`{-~]+")


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8, without ASCII punctuation."""
    if not text:
        return []
    raw = text.lower().encode() if isinstance(text, str) else text.lower()
    return _WORD.findall(raw)


def trained(windows: list[bytes], size: int, fit: dict) -> bytes:
    """Dictionary of zstd's trainer; the windows themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, [w.ljust(8) for w in windows], **fit).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(windows)))[-size:]


def ordinary_windows(texts: list[str]) -> list[bytes]:
    """Every word of every text once, in an order that is chance; at most ``MAX_WINDOWS``."""
    keyed = ((zlib.crc32(b"%d " % i + w), w) for i, t in enumerate(texts) for w in set(words(t)))
    return [b" " + w + b" " for _, w in heapq.nsmallest(MAX_WINDOWS, keyed)]


def toxic_windows(texts: list[str], ordinary: "Scorer") -> list[bytes]:
    """Windows that the ordinary dictionary does not compress, once for each pair of neighbours.

    In order of the word before, so that equal windows are spread: the trainer takes one segment of every stretch.
    """
    between = set()
    for ws in map(words, texts):
        between.update(zip([b"", *ws], ws, [*ws[1:], b""], strict=False))
    return [b" " + w + b" " for _, w, _ in sorted(between) if len(w) >= SHORTEST and ordinary.cost(w) >= min(len(w), COST)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # last: intercept

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A model with its compressors and a bounded memo of word windows."""

    def __init__(self, model: Model) -> None:
        params = zstandard.ZstdCompressionParameters(
            window_log=20, hash_log=18, chain_log=18, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        content = lambda b: zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.model = model
        self.pair = [zstandard.ZstdCompressor(dict_data=content(d), compression_params=params) for d in (model.toxic, model.ordinary)]
        self.memo: dict[bytes, int] = {}
        self.bare = len(self.pair[1].compress(FRAME + b" " + FRAME))
        self.usual: dict[bytes, int] = {}  # lengths under the ordinary dictionary, kept while the toxic one is chosen

    def length(self, word: bytes) -> int:
        return len(self.pair[1].compress(FRAME + b" " + word + b" " + FRAME))

    def cost(self, word: bytes) -> int:
        """Bytes of a word between frames under the ordinary dictionary."""
        if word not in self.usual:
            self.usual[word] = self.length(word)
        return self.usual[word] - self.bare

    def difference(self, word: bytes) -> int:
        return (self.usual.get(word) or self.length(word)) - len(self.pair[0].compress(FRAME + b" " + word + b" " + FRAME))

    def differences(self, text: str | bytes | None) -> list[int]:
        out, memo = [], self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in words(text):
            v = memo.get(w)
            if v is None:
                v = memo[w] = self.difference(w)
            out.append(v)
        return out

    def features(self, text: str | bytes | None) -> list[float]:
        d = self.differences(text)
        top = sorted(d, reverse=True)[:3]
        top += [LOW] * (3 - len(top))
        counts = [np.log1p(sum(v >= s for v in top) if len(d) < 4 else np.count_nonzero(np.asarray(d) >= s)) for s in STEPS]
        return [*(min(max(v, LOW), HIGH) for v in top), *counts, np.log1p(len(d))]

    def score(self, texts: list) -> np.ndarray:
        m = self.model
        if not len(m.weights):
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), len(m.center)) - m.center) / m.scale
        z = (x * m.weights[:-1]).sum(axis=1) + m.weights[-1]  # row by row: the same in every batch
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, str, int]], toxic_share: float) -> Model:
    """Train on (id, text, toxic): even checksums make dictionaries, odd ones calibrate."""
    empty = Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0))
    half = lambda k: [(t, y) for i, t, y in rows if zlib.crc32(f"half {i}".encode()) % 2 == k]
    make, tune = half(0), half(1)
    if any(len({y for _, y in part}) < 2 for part in (make, tune)):
        return empty
    framed = lambda content: content + b" " + FRAME
    ordinary = framed(trained(ordinary_windows([t for t, y in make if not y]), ORDINARY_BYTES, ORDINARY_FIT))
    scorer = Model(FRAME, ordinary, np.zeros(0), np.zeros(0), np.zeros(0)).scorer()
    found = toxic_windows([t for t, y in make if y], scorer)
    seen = Counter(found)
    usual = scorer.usual | {w: scorer.length(w) for w in {w for t, _ in tune for w in words(t)} - scorer.usual.keys()}
    y = np.array([float(v) for _, v in tune])
    share = min(max(toxic_share, 0.01), 0.99)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    best, lowest = empty, np.inf
    for least in LEAST:
        model = Model(framed(trained([w for w in found if seen[w] >= least], TOXIC_BYTES, TOXIC_FIT)), ordinary, np.zeros(0), np.zeros(0), np.zeros(0))
        scorer = model.scorer()
        scorer.usual = usual
        x = np.array([scorer.features(t) for t, _ in tune])
        model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        model.weights = logistic((x - model.center) / model.scale, y, weight)
        p = 1.0 / (1.0 + np.exp(-np.clip(((x - model.center) / model.scale) @ model.weights[:-1] + model.weights[-1], -30, 30)))
        loss = -np.mean(weight * np.log(np.where(y > 0, p, 1 - p)))
        if loss < lowest:
            best, lowest = model, loss
    return best


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """Fit on the bounded labelled sample outside fold 0."""
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y")).where("y in (0, 1)").where(fold_of("_id", folds) != 0)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"))
    picked = [sample_ids(known.where(F.col("y") == y), "_id", most).withColumn("y", F.lit(y)) for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "_id")  # at most both bounds of ids to broadcast
    share = n.get(1, 0) / max(1, sum(n.values()))

    def run(table: pa.Table) -> Model:
        ids, texts, ys = (table.column(c).to_pylist() for c in ("_id", "t", "y"))
        return fit(sorted(zip(ids, (t or "" for t in texts), ys, strict=True)), share)

    return fitted(rows.select("_id", "t", "y"), run) or fit([], share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxic_score`` and ``toxic_predicted`` appended, in one narrow pass."""
    small_text_batches(docs.sparkSession)
    base = docs.drop("toxic_score", "toxic_predicted")
    out = base.withColumns({"toxic_score": F.lit(0.0), "toxic_predicted": F.lit(0)}).schema
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            p = scorer.score([t.as_py() for t in b.column(at)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=out.names)

    return base.mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels)
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
