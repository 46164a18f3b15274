"""Exact substring dedup by bucket-pointer refinement of a sampled suffix array.

A byte goes if a 100-byte string that covers it also starts earlier (smaller id,
or same text and earlier start). Suffixes need sorting to depth 100 only, and
only where a bucket holds more than one of them, so buckets are refined in rounds
in which resolved suffixes drop out:

* Depth 40. Identifiers of q-gram buckets (q = 20) are refined to depth 40 with
  the identifier 20 bytes later. Every 100-byte window is represented by the
  smallest depth-40 identifier within it (leftmost on ties); equal windows choose
  the same one at the same offset, so windows in different buckets never need to
  meet. About one position in 31 is such an anchor.
* Runs. Consecutive windows that share an anchor form a run; the identifier of
  the run's whole byte span refines the anchor's bucket. A span that occurs
  earlier resolves all windows of its run; an anchor bucket of one suffix, or of
  one span, is final.
* Depth 100. For the first occurrence of each span in a bucket of several spans,
  the bytes travel to the bucket. There buckets are exact: 8-gram buckets are
  refined by sorting pairs (own bucket, bucket of the suffix as many bytes on as is
  known), 8 to 16, 32, 64, and last 100 by the one 36 bytes on; every refinement uses the
  buckets that the one before left, and suffixes alone in their bucket drop out. Of each
  final bucket the earliest window stays and the others are resolved.

Buckets are pre-aggregated in each task: of equal spans only the earliest is
sent, and a bucket that is known to hold several spans sends one witness. Hence a
passage in a third of all texts sends one row a task. Identifiers before the last
refinement are 64-bit fingerprints (of a span together with its anchor); the number
of buckets follows the bytes of all texts.

Null texts are empty. Texts under 100 bytes are never cut. Long texts are worked on whole.
Rows that share an id have no order among them: they do not cut each other, whether
their texts are equal or not, and each is cut on its own. Texts without an id stay
uncut and cut no other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import U64, bucket_count, lookup, materialise, mix, powers, prefix_hash, small_text_batches, steps, text_buffer

DEPTH, Q = 100, 20
GRAM = 2 * Q
CHOICES = DEPTH - GRAM + 1  # anchors that a window can choose from
#: Anchors (some 250 bytes each at the most) and bytes of spans that a task gathers before it sends them on.
FLUSH, SPAN_BYTES = 500_000, 16 << 20
#: Text bytes whose anchors are found at a time, some 130 bytes of work each (a single longer text is one step).
ANCHOR_STEP = 1 << 19
_RUN, _BUCKET = 8, 22  # bits in a packed range
#: Text bytes whose anchors one bucket holds on average.
BUCKET_BYTES = 8 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (two scans over blocks of ``w``)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def gram_ids(h: np.ndarray) -> np.ndarray:
    """Depth-20 bucket identifiers of all positions from a prefix hash."""
    n = len(h) - 1 - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    _, inv = powers(len(h))
    return mix((h[Q:] - h[:-Q]) * inv[:n])


def refine(ids: np.ndarray, later: int) -> np.ndarray:
    """Identifiers of the bucket pair (own, ``later`` bytes on)."""
    if len(ids) <= later:
        return ids[:0]
    return mix(ids[:-later] * U64(0xD1342543DE82EF95) + ids[later:])


def anchors(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows by anchor: text index, first start, length less one, anchor id, span id."""
    h = prefix_hash(data)
    g40 = refine(gram_ids(h), Q)
    low = np.arange(len(g40), dtype=np.uint64)
    m = sliding_min((g40 & U64(0xFFFFFFFF00000000)) | low, CHOICES)
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - DEPTH + 1, 0))
    before = np.cumsum(np.maximum(size - DEPTH + 1, 0)) - np.maximum(size - DEPTH + 1, 0)
    start = np.arange(len(doc)) - before[doc] + offs[:-1][doc]
    at = (m[start] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at))) - 1
    lo, at, doc = start[first], at[first], doc[first]
    _, inv = powers(len(h))
    end = lo + run + DEPTH
    span = mix((h[end] - h[lo]) * inv[lo] + mix(((at - lo) * 4096 + run).astype(np.uint64)))
    return {"doc": doc, "lo": (lo - offs[:-1][doc]).astype(np.int64), "run": run.astype(np.int64), "anchor": g40[at], "span": span}


def pack(**arrays: np.ndarray) -> bytes:
    """Columns as one compressed block."""
    table = pa.table({k: pa.array(v) for k, v in arrays.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return {k: table.column(k).to_numpy() for k in table.column_names}


def resolve(key: np.ndarray, span: np.ndarray, doc: np.ndarray, row: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by (key, span, doc, row, lo); in that order: starts a key, earliest of its span, later than another, first of its span and row.

    Later is what has its span in a smaller doc, or earlier in its own row.
    """
    order = np.lexsort((lo, row, doc, span, key))
    k, s, d, w, p = key[order], span[order], doc[order], row[order], lo[order]
    newk = np.ones(len(k), dtype=bool)
    newk[1:] = k[1:] != k[:-1]
    news = newk.copy()
    news[1:] |= s[1:] != s[:-1]
    neww = news.copy()
    neww[1:] |= (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    at = np.arange(len(k))
    head, own = (np.maximum.accumulate(np.where(new, at, 0)) for new in (news, neww))
    return order, newk, news, (d != d[head]) | (p != p[own]), own


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``len(x)``, equal for equal values, and whether another value is equal; a third of ``np.unique``'s memory."""
    order = np.argsort(x)
    new = np.ones(len(x) + 1, dtype=bool)
    x = x[order]
    new[1:-1] = x[1:] != x[:-1]
    del x
    number, shared = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=bool)
    shared[order] = ~(new[1:] & new[:-1])
    number[order] = np.cumsum(new[:-1]) - 1
    return number, shared


def refined(data: np.ndarray) -> np.ndarray:
    """Buckets of equal ``DEPTH``-byte strings at all positions of ``data`` that have so many bytes, exact.

    Equal buckets, equal strings; a suffix alone in its bucket gets a number of its own.
    """
    n = len(data) - DEPTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bucket, shared = _numbered(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel())
    depth, most = 8, len(bucket)
    while depth < DEPTH:
        later = min(depth, DEPTH - depth)
        m = len(bucket) - later
        shared, open_ = shared[:m], np.flatnonzero(shared[:m])
        pair = bucket[open_].astype(np.uint64)
        pair *= U64(2 * most)  # more than any bucket
        pair += bucket[open_ + later].astype(np.uint64)
        bucket = np.arange(most, most + m)
        bucket[open_], shared[open_] = _numbered(pair)
        depth += later
    return bucket[:n]


def _per_key(newk: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each key, repeated for its rows."""
    group = np.cumsum(newk) - 1
    return np.bincount(group, weights=values, minlength=0)[group] if len(group) else values


FULL, CHECK = 0, 1


def ranges(lo: np.ndarray, bucket: np.ndarray, run: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (lo << (_BUCKET + _RUN + 1)) | (bucket << (_RUN + 1)) | (run << 1) | kind


def _split(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    for a, z in zip(cuts, np.append(cuts[1:], len(b)), strict=True):
        yield int(b[a]), {k: v[order[a:z]] for k, v in columns.items()}


def _send_anchors(buckets: int):
    """Round 1, map side: resolved ranges and unresolved anchors by bucket."""
    names = ["bucket", "kind", "blob"]

    def flush(got: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c = {k: np.concatenate([g.pop(k) for g in got]) for k in list(got[0])}
        order, newk, news, later, _ = resolve(c["anchor"], c["span"], c["doc"], c["row"], c["lo"])
        c = {k: v[order] for k, v in c.items()}
        several = _per_key(newk, news.astype(float)) > 1
        bucket = (c["anchor"] % U64(buckets)).astype(np.int64)
        short = c["anchor"] >> U64(24)
        own = (news | ~later) & ~several  # repeated ids stay with their twin
        check = (news | ~later) & several
        witness = newk & several
        done = later & ~news
        known = done | check
        out = []
        for b, v in _split(bucket[known], {"doc": c["doc"][known], "row": c["row"][known], "r": ranges(c["lo"], bucket, c["run"], np.where(check, CHECK, FULL))[known]}):
            out.append((b, 0, pack(**v)))
        send = own | witness
        blank = np.where(witness, np.int64(-1), c["lo"])
        cols = {"doc": c["doc"][send], "row": c["row"][send], "lo": blank[send], "run": c["run"][send].astype(np.uint8)}
        h = short[send]
        cols |= {"span": c["span"][send], "high": (h >> U64(32)).astype(np.uint8), "low": h.astype(np.uint32)}
        place = np.lexsort((cols["lo"], cols["doc"]))
        for b, v in _split(bucket[send][place], {k: x[place] for k, x in cols.items()}):
            out.append((b, 1, pack(doc_delta=np.diff(v.pop("doc"), prepend=0), **v)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names).cast(_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for whole in batches:
            for b in steps(whole, limit=ANCHOR_STEP):
                data, offs = text_buffer(b.column("text"))
                a = anchors(data, offs)
                a["row"] = b.column("row").to_numpy()[a["doc"]]
                a["doc"] = b.column("doc_id").to_numpy()[a["doc"]]
                got.append(a)
                n += len(a["lo"])
                if n >= FLUSH:
                    yield from flush(got)
                    got, n = [], 0
        if n:
            yield from flush(got)

    return run


_BLOBS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _join_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Round 1, bucket side: ranges of texts that are resolved or need depth 100."""
    bucket = int(pdf["bucket"].iloc[0])
    docs, rows, out, got = [], [], [], []
    for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
        v = unpack(blob)
        if kind == 0:
            docs.append(v["doc"]), rows.append(v["row"]), out.append(v["r"])
        else:
            v["doc"] = np.cumsum(v.pop("doc_delta"))
            got.append(v)
    if got:
        c = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
        key = (c["high"].astype(np.uint64) << U64(32)) | c["low"]
        order, newk, news, later, own = resolve(key, c["span"], c["doc"], c["row"], c["lo"])
        lo, doc, run = c["lo"][order], c["doc"][order], c["run"][order].astype(np.int64)
        witness = lo < 0
        several = (_per_key(newk, (news & ~witness).astype(float)) > 1) | (_per_key(newk, witness.astype(float)) > 0)
        done = later & ~news & ~witness
        # a witness may stand first in its span; then the rest of the span is checked instead
        head = np.maximum.accumulate(np.where(news, np.arange(len(news)), 0))
        done &= ~witness[head] & ~witness[own]
        check = several & ~done & ~witness
        known = done | check
        docs.append(doc[known]), rows.append(c["row"][order][known])
        out.append(ranges(lo, np.int64(bucket), run, np.where(check, CHECK, FULL))[known])
    if not docs:
        return pd.DataFrame({"doc_id": [], "row": [], "r": []}, dtype="int64")
    return pd.DataFrame({"doc_id": np.concatenate(docs), "row": np.concatenate(rows), "r": np.concatenate(out)})


def _send_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2, map side: bytes of unresolved runs by anchor bucket; resolved ranges pass."""
    held: dict[int, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for b, v in held.items():
            doc, row, r, body = zip(*v, strict=True)
            rows.append((b, 1, pack(doc=np.array(doc), row=np.array(row), r=np.array(r), body=np.array([b"".join(body)] + [b""] * (len(doc) - 1), dtype=object))))
        held.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=_BLOBS.names).cast(_BLOBS)

    for batch in batches:
        keep = []
        for doc, row, text, rs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row")), batch.column("text"), batch.column("rs"), strict=True):
            r = rs.values.to_numpy()
            check = (r & 1) == CHECK
            if not check.all():
                keep.append((doc, row, r[~check]))
            if not check.any():
                continue
            raw = text.as_buffer().to_pybytes()
            r = r[check]
            lo, bucket, run = r >> (_BUCKET + _RUN + 1), (r >> (_RUN + 1)) & ((1 << _BUCKET) - 1), (r >> 1) & ((1 << _RUN) - 1)
            for x, b, a, n in zip(r.tolist(), bucket.tolist(), lo.tolist(), run.tolist(), strict=True):
                held.setdefault(b, []).append((doc, row, x, raw[a : a + n + DEPTH]))
                size += n + DEPTH
        if keep:
            doc, row, r = zip(*keep, strict=True)
            blob = pack(**{k: np.repeat(v, [len(x) for x in r]) for k, v in (("doc", doc), ("row", row))}, r=np.concatenate(r))
            yield pa.RecordBatch.from_arrays([pa.array([keep[0][0] % 997]), pa.array([0]), pa.array([blob])], names=_BLOBS.names).cast(_BLOBS)
        if size > SPAN_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _join_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """Round 2, bucket side: refine to depth 100 and keep the earliest window of each bucket."""
    none = np.empty(0, np.int64)
    docs, rows, los, his = [none], [none], [none], [none]
    doc, row, r, body = [], [], [], []
    for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
        v = unpack(blob)
        if kind == 0:
            lo = v["r"] >> (_BUCKET + _RUN + 1)
            docs.append(v["doc"]), rows.append(v["row"]), los.append(lo), his.append(lo + ((v["r"] >> 1) & ((1 << _RUN) - 1)))
        else:
            doc.append(v["doc"]), row.append(v["row"]), r.append(v["r"]), body.append(v["body"][0])
    if doc:
        doc, row, r = map(np.concatenate, (doc, row, r))
        lo, run = r >> (_BUCKET + _RUN + 1), (r >> 1) & ((1 << _RUN) - 1)
        at = np.cumsum(run + DEPTH) - (run + DEPTH)
        owner = np.repeat(np.arange(len(run)), run + 1)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(run + 1) - (run + 1), run + 1)
        bucket = refined(np.frombuffer(b"".join(body), dtype=np.uint8))[at[owner] + within]
        start = lo[owner] + within
        order, _, _, later, _ = resolve(bucket, np.zeros(len(owner), np.int8), doc[owner], row[owner], start)
        gone = np.zeros(len(owner), dtype=bool)
        gone[order] = later
        d, w, s = doc[owner][gone], row[owner][gone], start[gone]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        if len(d):
            docs.append(d[first]), rows.append(w[first]), los.append(s[first]), his.append(s[last])
    lo = np.concatenate(los)
    return pd.DataFrame({"doc_id": np.concatenate(docs), "row": np.concatenate(rows), "r": (lo << 31) | (np.concatenate(his) - lo)})


def covered(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by packed start ranges."""
    lo = np.sort(r >> 31)
    order = np.argsort(r >> 31, kind="stable")
    end = np.maximum.accumulate((r >> 31)[order] + (r & ((1 << 31) - 1))[order] + DEPTH)
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]


#: What names a row: its id, and a digest of its text where several rows have the id.
_ROW = ["doc_id", "row"]


def repeated_ranges(src: DataFrame, n_bytes: int) -> DataFrame:
    """``doc_id, row, rs``: packed start ranges of repeated windows, for texts that have any. ``src``: doc_id, row, text."""
    src = src.where("doc_id is not null")
    buckets = min(max(bucket_count(src.sparkSession), -(-n_bytes // BUCKET_BYTES)), (1 << _BUCKET) - 1)
    blobs = src.mapInArrow(_send_anchors(buckets), "bucket long, kind int, blob binary")
    found = blobs.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_join_anchors, "doc_id long, row long, r long")
    lists = found.groupBy(*_ROW).agg(F.collect_list("r").alias("rs"))
    spans = src.join(lists.hint("shuffle_hash"), _ROW).mapInArrow(_send_spans, "bucket long, kind int, blob binary")
    return spans.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_join_spans, "doc_id long, row long, r long").groupBy(*_ROW).agg(F.collect_set("r").alias("rs"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``docs`` with columns _cut_id, _cut_row, _cut_text, and the bytes of all texts."""
    small_text_batches(docs.sparkSession)
    full = docs.withColumns({"_cut_id": F.col(id_col).cast("bigint"), "_cut_text": F.coalesce(F.col(text_col), F.lit(""))})
    ids = full.groupBy("_cut_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length("_cut_text")).alias("_bytes"))
    ids = ids.groupBy((F.col("_rows") > 1).alias("several"), F.when(F.col("_rows") > 1, F.col("_cut_id")).alias("_cut_id")).agg(F.sum("_bytes").alias("_bytes"))
    ids = materialise(ids)
    twins = ids.where("several and _cut_id is not null").select("_cut_id", F.lit(True).alias("_cut_twin"))
    n_bytes = ids.agg(F.sum("_bytes")).first()[0] or 0
    full = lookup(full, "_cut_id", twins).withColumn("_cut_row", F.when(F.col("_cut_twin"), F.xxhash64("_cut_text")).otherwise(F.lit(0)))
    return full.drop("_cut_twin"), n_bytes


def _source(full: DataFrame) -> DataFrame:
    return full.select(F.col("_cut_id").alias("doc_id"), F.col("_cut_row").alias("row"), F.col("_cut_text").alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, rs in zip(b.column("text"), b.column("rs"), strict=True):
            raw = text.as_buffer().to_pybytes()
            kept, removed, spans = _cut(raw, rs)
            rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
        cols = [pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(raw: bytes, rs: pa.Scalar) -> tuple[bytes, int, int]:
    if not rs.is_valid or not len(rs.values):
        return raw, 0, 0
    a, z = covered(rs.values.to_numpy())
    pieces, at = [], 0
    for lo, hi in zip(a.tolist(), z.tolist(), strict=True):
        pieces.append(raw[at:lo])
        at = hi
    pieces.append(raw[at:])
    return b"".join(pieces), int((z - a).sum()), len(a)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document; texts without an id stay uncut and cut no other."""
    full, n_bytes = _named(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    src = _source(full)
    whole = src.join(repeated_ranges(src, n_bytes).hint("shuffle_hash"), _ROW, "left")
    return whole.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from the text; pieces of a cut character go with it. Same columns. Texts without an id stay uncut."""
    schema = docs.schema
    full, n_bytes = _named(docs, id_col, text_col)
    ranges_of = repeated_ranges(_source(full), n_bytes).select(F.col("doc_id").alias("_cut_id"), F.col("row").alias("_cut_row"), F.col("rs").alias("_cut_ranges"))
    joined = full.join(ranges_of.hint("shuffle_hash"), ["_cut_id", "_cut_row"], "left").select(*docs.columns, "_cut_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            for text, rs in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                if not text.is_valid or not rs.is_valid:
                    out.append(text.as_py())
                else:
                    out.append(_cut(text.as_buffer().to_pybytes(), rs)[0].decode("utf-8", errors="ignore"))
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
