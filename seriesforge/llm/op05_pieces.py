"""Unigram segmentation over a double-array trie, with byte fallback, and decoding.

A text is prefixed with the whitespace marker, its spaces become markers, and it is
cut before every run of markers: no piece holds a marker after another character,
so the best segmentation of a text is that of its segments. Segments repeat; each
distinct one is segmented once for a task and remembered.

New segments are segmented together: the trie (Aoe 1989: ``base[s] + byte`` is the
child if its ``check`` is s) is walked from all positions of all segments at once,
one byte a step, and the Viterbi recursion runs over positions in step. Among equal
scores the longest last piece wins. A character that no piece covers alone is
unknown; it costs the lowest score less ``UNKNOWN_PENALTY`` and is written as
its byte pieces. Decoding concatenates pieces and bytes, turns markers into spaces
and drops the first.

Null texts are empty; an empty text has no pieces. A marker character in a text
decodes to a space, as it does in the format itself (``round_trip`` is then
false). Long texts are segmented whole, since no segment crosses a run of markers. Repeated rows get a
row each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import small_text_batches

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Scores at or below this stand for "no score" (markers alone, runs of markers).
UNSCORED = -1e8
MEMO = 600_000
#: Bytes of new segments that are segmented together.
CHUNK_BYTES = 1 << 19
_SEGMENT = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


@dataclass
class Pieces:
    """Vocabulary: text and score of usable pieces, the 256 byte pieces, bytes of every id."""

    usable: list[tuple[bytes, int, float]]
    byte_ids: list[int]
    blob: list[bytes]  # what an id decodes to
    low: float


def load(path: str) -> Pieces:
    """Pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable, byte_ids, blob = [], [0] * 256, []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(text[3:-1], 16)
            byte_ids[value] = i
            blob.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            blob.append(b"")
        else:
            blob.append(text.encode())
            usable.append((text.encode(), i, sp.get_score(i)))
    low = min(s for _, _, s in usable if s > UNSCORED)
    # a piece without score loses to scored pieces and wins against bytes
    usable = [(t, i, s if s > UNSCORED else low - UNKNOWN_PENALTY / 2) for t, i, s in usable]
    return Pieces(usable, byte_ids, blob, low)


class DoubleArray:
    """Trie in two arrays; ``value`` is the piece id at a state or -1."""

    def __init__(self, entries: list[tuple[bytes, int]]) -> None:
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        keys = sorted(entries)
        level = [(0, 0, len(keys), 0)]
        hint, top = 1, 0
        while level:
            below = []
            for state, lo, hi, depth in level:
                if len(keys[lo][0]) == depth:
                    self.value[state] = keys[lo][1]
                    lo += 1
                groups: list[tuple[int, int, int]] = []
                at = lo
                while at < hi:
                    byte, end = keys[at][0][depth], at + 1
                    while end < hi and keys[end][0][depth] == byte:
                        end += 1
                    groups.append((byte, at, end))
                    at = end
                if not groups:
                    continue
                b = np.array([g[0] for g in groups])
                base, hint = self._room(b, hint)
                self.base[state] = base
                self.check[base + b] = state
                top = max(top, base + 256)
                below += [(base + byte, a, z, depth + 1) for byte, a, z in groups]
            level = below
        self.base, self.check, self.value = (v[: top + 257].copy() for v in (self.base, self.check, self.value))


    def _room(self, b: np.ndarray, hint: int, window: int = 512) -> tuple[int, int]:
        """A base whose slots for the bytes ``b`` are free, and the first free slot."""
        at = hint
        while True:
            if at + window + 512 >= len(self.check):
                grow = len(self.check)
                self.base = np.append(self.base, np.zeros(grow, np.int32))
                self.check = np.append(self.check, np.full(grow, -1, np.int32))
                self.value = np.append(self.value, np.full(grow, -1, np.int32))
            free = np.flatnonzero(self.check[at : at + window] == -1) + at
            if at == hint and len(free):
                hint = int(free[0])
            base = free[free > b[0]] - b[0]
            if len(b) > 1 and len(base):
                base = base[(self.check[base[:, None] + b[None, 1:]] == -1).all(axis=1)]
            if len(base):
                return int(base[0]), hint
            at += window
            # a crowded window is left for good once many-child states have passed it
            hint = at - window // 2 if len(free) < window // 50 else hint


class Segmenter:
    """Unigram Viterbi over many segments at once."""

    def __init__(self, pieces: Pieces) -> None:
        self.trie = DoubleArray([(t, i) for t, i, _ in pieces.usable])
        self.score = np.full(len(pieces.blob) + 1, -np.inf)
        for _, i, s in pieces.usable:
            self.score[i] = s
        self.unknown = pieces.low - UNKNOWN_PENALTY
        self.byte_ids = np.array(pieces.byte_ids, dtype=np.int32)
        self.length = np.array([len(b) for b in pieces.blob], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(pieces.blob), dtype=np.uint8)

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the segments: begin, end, id; ``stop``: end of the segment of each position."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        state = np.zeros(len(at), dtype=np.int64)
        out, step, t = [], 0, self.trie
        while len(at):
            inside = at + step < stop[at]
            at, state = at[inside], state[inside]
            child = t.base[state] + data[at + step]
            live = t.check[child] == state
            at, state = at[live], child[live].astype(np.int64)
            step += 1
            hit = t.value[state] >= 0
            out.append((at[hit], at[hit] + step, t.value[state[hit]]))
        begin, end, ids = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        # characters without a piece of their own
        where = np.flatnonzero(lead)
        nxt = np.append(where[1:], len(data))
        nxt = np.minimum(nxt, stop[where])
        alone = np.zeros(len(data) + 1, dtype=bool)
        width = np.zeros(len(data) + 1, dtype=np.int64)
        width[where] = nxt - where
        alone[begin[end - begin == width[begin]]] = True
        lost = where[~alone[where]]
        none = np.full(len(lost), len(self.score) - 1)
        return np.concatenate([begin, lost]), np.concatenate([end, lost + width[lost]]), np.concatenate([ids, none])

    def segment(self, parts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each segment."""
        if not parts:
            return []
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(parts)), size)
        begin, end, ids = self.edges(data, (first + size)[owner])
        # positions of segment s are first[s] + s ... + size: one more than bytes
        node = lambda p, seg: p + seg
        seg = owner[begin]
        rel = begin - first[seg]
        cost = np.where(ids == len(self.score) - 1, self.unknown, self.score[ids])
        order = np.lexsort((end, rel))
        rel, src, dst, ids, cost = rel[order], node(begin, seg)[order], node(end, seg)[order], ids[order], cost[order]
        best = np.full(len(data) + len(parts), -np.inf)
        best[node(first, np.arange(len(parts)))] = 0.0
        back, via = np.full(len(best), -1, dtype=np.int64), np.full(len(best), -1, dtype=np.int64)
        cuts = np.flatnonzero(np.append(True, rel[1:] != rel[:-1])) if len(rel) else []
        for a, z in zip(cuts, np.append(cuts[1:], len(rel)), strict=True):  # ends of one step differ within a segment
            total = best[src[a:z]] + cost[a:z]
            up = total > best[dst[a:z]]
            d = dst[a:z][up]
            best[d], back[d], via[d] = total[up], src[a:z][up], ids[a:z][up]
        # back from all ends in step
        here = node(first + size, np.arange(len(parts)))
        alive = np.flatnonzero(size > 0)
        found = []
        depth = 0
        while len(alive):
            p = here[alive]
            found.append((alive, np.full(len(alive), depth), via[p], back[p] - alive, p - alive))
            here[alive] = back[p]
            alive = alive[here[alive] > first[alive] + alive]
            depth += 1
        who, dep, ids, lo, hi = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        order = np.lexsort((-dep, who))
        who, ids, lo, hi = who[order], ids[order], lo[order], hi[order]
        unknown = ids == len(self.score) - 1
        n = np.where(unknown, hi - lo, 1)
        flat = np.repeat(ids, n).astype(np.int32)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        spelt = np.repeat(unknown, n)
        flat[spelt] = self.byte_ids[data[(np.repeat(lo, n) + within)[spelt]]]
        counts = np.bincount(who, weights=n, minlength=len(parts)).astype(np.int64)
        return np.split(flat, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: markers as spaces, without the first."""
        n = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.data[at].tobytes().replace(MARKER.encode(), b" ")[1:]


class Codec:
    """Encoder and decoder of whole texts with a bounded memory of segments."""

    def __init__(self, segmenter: Segmenter) -> None:
        self.segmenter = segmenter
        self.memo: dict[str, bytes] = {}
        self.is_byte = np.zeros(len(self.segmenter.length), dtype=bool)
        self.is_byte[self.segmenter.byte_ids] = True

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        parts = [_SEGMENT.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        new, size, todo = dict.fromkeys(p for ps in parts for p in ps if p not in memo), 0, []
        for p in new:
            todo.append(p)
            size += len(p)
            if size > CHUNK_BYTES:
                self._learn(todo)
                todo, size = [], 0
        self._learn(todo)
        return [np.frombuffer(b"".join(map(memo.__getitem__, ps)), dtype=np.int32) for ps in parts]

    def _learn(self, parts: list[str]) -> None:
        for p, ids in zip(parts, self.segmenter.segment([p.encode() for p in parts]), strict=True):
            self.memo[p] = ids.tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.segmenter.decode(ids).decode("utf-8", errors="replace")


_workers: dict[tuple, Codec] = {}


def _worker(key: tuple, held) -> Codec:
    """One codec a worker process, kept across tasks."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = Codec(held.value)
    return _workers[key]


def _shipped(spark, path: str | None):
    """A function for executors that returns the codec; the trie (under 3 MB for 32,000 pieces) is built once here."""
    path = path or model_path()
    held = spark.sparkContext.broadcast(Segmenter(load(path)))
    key = (path, held._jbroadcast.id())
    return lambda: _worker(key, held)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pieces array<int>``."""
    small_text_batches(docs.sparkSession)
    codec_of = _shipped(docs.sparkSession, path)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = codec_of().encode(b.column("text").to_pylist())
            offs = np.cumsum([0, *map(len, got)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *got])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["doc_id", "pieces"])

    return src.mapInArrow(run, src.select("doc_id", F.array(F.lit(0)).alias("pieces")).schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, pieces``; a null list is a null text."""
    codec_of = _shipped(coded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codec_of().decode(p.values.to_numpy()) if p.is_valid else None for p in b.column("pieces")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    src = coded.select("doc_id", F.col("pieces").cast("array<int>").alias("pieces"))
    return src.mapInArrow(run, src.select("doc_id", F.lit("").alias("text")).schema)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, pieces_sha256, round_trip``: encode, decode and compare whole texts."""
    small_text_batches(docs.sparkSession)
    codec_of = _shipped(docs.sparkSession, path)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_pieces", "n_byte_pieces", "pieces_sha256", "round_trip"]
    z = F.lit(0).cast("bigint")
    schema = src.select("doc_id", z.alias(names[1]), z.alias(names[2]), F.lit("").alias(names[3]), F.lit(True).alias(names[4])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec, texts, rows = codec_of(), b.column("text").to_pylist(), []
            for t, ids in zip(texts, codec.encode(texts), strict=True):
                back = codec.segmenter.decode(ids)
                rows.append((len(ids), int(codec.is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), back == (t or "").encode()))
            cols = [pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=names)

    return src.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
