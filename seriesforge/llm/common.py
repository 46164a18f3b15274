"""What the corpus operators share: shared-folder tables, byte-bounded batches,
vectorised words and hashes, connected components.

Texts are handled as one byte buffer a batch with numpy; a batch is cut by
bytes, not rows, so that long documents do not decide a worker's memory.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on (a single longer text is one step).
STEP_BYTES = 1 << 21
#: Rows and bytes of an Arrow batch that carries texts.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20
#: Edges of which one partition's union-find holds at most this many at a time.
FOREST_EDGES = 4_000_000
#: Rows of a table that a lookup broadcasts (three longs a row); share of the rows, as its inverse, that makes a key hot.
BROADCAST_ROWS, HOT_KEYS = 200_000, 1000

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The table goes when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _files(spark, path, "deleteOnExit")
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def _files(spark: SparkSession, path: str, method: str, *args) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(at.getFileSystem(spark._jsc.hadoopConfiguration()), method)(at, *args)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for t in tables:
        _files(t.sparkSession, t._shared_path, "delete", True)


def small_text_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches; long texts share a batch otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _powers = 0x9E3779B97F4A7C15 | 1, {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of each."""
    if _powers.get("n", 0) < n:
        n = max(n, STEP_BYTES + 1)
        inv = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inv):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers.update(n=n, p=tuple(out))
    return _powers["p"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``h`` of n + 1 values; the hash of data[a:b] is (h[b] - h[a]) * inverse power a."""
    fwd, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, dtype=np.uint64)
    h[0] = 0
    np.cumsum(BYTE_HASH[data] * fwd[: len(data)], out=h[1:])
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets; null texts are empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold ``limit`` bytes or one text."""
    if not batch.num_rows:
        return
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, A-Z lower-cased.

    data: lower-cased bytes; start, end: byte range of each word; first: index
    of the first word of each text, n + 1 values; hash: 64 bits of each word.
    """

    def __init__(self, col: pa.Array, hashes: bool = True) -> None:
        raw, self.offsets = text_buffer(col)
        self.data = LOWER[raw]
        word = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)  # a text starts here
        edge[self.offsets] = True
        before = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0] = False
            before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(len(raw), dtype=bool)
        if len(raw):
            after[-1] = False
            after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        if hashes:
            h = prefix_hash(self.data)
            _, inv = powers(len(raw) + 1)
            self.hash = mix((h[self.end] - h[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and n + 1 offsets.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(words.count)
    counts = np.where(words.count >= size, words.count - size + 1, (words.count > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = words.first[:-1][doc] + within
    have = np.minimum(words.count, size)[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    padded = np.concatenate([words.hash, np.zeros(size, dtype=np.uint64)])
    for j in range(size):
        h = mix(h * U64(0x2545F4914F6CDD1D) + np.where(have > j, padded[at + j], U64(j + 1)))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """What ``fit`` makes of a bounded sample, in one task: the driver holds the model, never the rows. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(got)))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def fold_of(column: str, folds: int) -> Column:
    """``crc32(id as text) mod folds``: the split of documents into training and held-out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def sample_ids(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` ids, those of the smallest hashes.

    A hash threshold from the count thins the rows where they are read, so that
    no task sends ``most`` rows on; the final order decides among the rest.
    """
    n = ids.count()
    space = 1 << 40
    share = min(space, int(space * 1.3 * (most + 100) / max(n, 1)))
    h = F.xxhash64(F.col(id_col), F.lit(17))
    thin = ids.select(id_col).where(F.pmod(h, F.lit(space)) < share)
    return thin.orderBy(F.pmod(h, F.lit(space)), id_col).limit(most)


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find on positions: hook the roots of both ends to the smaller until all links agree."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # flatten
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the smallest of its component, and that smallest node."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    hook(parent, code[: len(a)], code[len(a) :])
    child = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[child], ids[parent[child]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, nodes) unite the nodes with the anchor; the forest of a partition, in pieces of bounded size."""
    out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    held, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    for batch in batches:
        nodes = batch.column("nodes")
        n = np.diff(nodes.offsets.to_numpy())
        held.append((np.repeat(batch.column("anchor").to_numpy(), n), nodes.flatten().to_numpy()))
        size += int(n.sum())
        if size > FOREST_EDGES:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > FOREST_EDGES // 2:
                yield out(*held[0])
                held, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    yield out(*forest(*map(np.concatenate, zip(*held, strict=True))))


def lookup(rows: DataFrame, key: str | list[str], table: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Left join with ``table``, unique by ``key``, where one key may hold a third of ``rows``.

    A table of at most ``BROADCAST_ROWS`` rows is broadcast. Of a larger one only the
    entries of ``hot`` keys are (those that hold a thousandth of the rows, so at most a
    thousand; counted here if not given); the other rows are joined by shuffle.
    ``rows`` should be cheap to read several times.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    if hot is None:
        keys = [key] if isinstance(key, str) else key
        hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2, rows.count() // HOT_KEYS)).select(*keys)
    hot = F.broadcast(materialise(hot))
    many = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    return many.unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes of ``edges(a, b)`` but isolated ones and the components' smallest.

    A round runs union-find inside every partition, so that a node keeps at most one
    edge a partition, and gathers each node's lower neighbours (a root is summed map-side,
    however many nodes hang on it). Nodes below no other leave the graph with their
    smallest neighbour as pointer, after linking their other neighbours to it; nodes in
    the middle of a chain jump over their neighbour, so chains halve. Pointers are followed back
    at the end, one lookup a round. No task or driver holds all edges.
    """
    pairs = edges.select(F.col("a").alias("anchor"), F.array("b").alias("nodes"))
    links, levels = materialise(pairs.mapInArrow(_forests, "a long, b long")), []
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("low"))
        ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("low")))
        state = ends.groupBy("node").agg(F.min("low").alias("component"), F.collect_set("low").alias("lows"), F.max(F.isnull("low")).alias("above"))
        state = materialise(state.where("component is not null"))
        discard(links)
        levels.append(state.where("not above").select("node", "component"))
        middle = state.where("above")
        n = state.agg(F.count_if("above").alias("middle"), F.count_if(F.col("above") | (F.size("lows") > 1)).alias("open")).first()
        if not n["open"]:
            break
        unite = state.where(F.size("lows") > 1).select(F.col("component").alias("anchor"), F.col("lows").alias("nodes"))
        if n["middle"]:
            up = middle.select(F.col("node").alias("component"), F.col("component").alias("top"))
            jumps = lookup(middle.select("node", "component"), "component", up)
            unite = unite.unionByName(jumps.select(F.coalesce("top", "component").alias("anchor"), F.array("node").alias("nodes")))
        links = materialise(unite.mapInArrow(_forests, "a long, b long"))
    found = levels.pop()
    while levels:
        up = found.select(F.col("node").alias("component"), F.col("component").alias("top"))
        below = lookup(levels.pop(), "component", up).select("node", F.coalesce("top", "component").alias("component"))
        found = materialise(below.unionByName(found))
    return found
