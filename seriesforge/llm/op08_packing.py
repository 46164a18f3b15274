"""Conflict-constrained best-fit-decreasing packing of documents into context bins.

Documents are cut into pieces of at most ``capacity`` characters; pieces go,
longest first, to the open bin of the smallest sufficient residual that does not
hold another piece of their duplicate cluster and holds fewer than
``per_source`` pieces of their source. Bins are ordered by residual: a bitmap of
the residuals in use gives the successor of a length, and the search goes on to
the next residual as long as all bins of one conflict. Every bin carries a bitmap
of its duplicate clusters and counting bitmaps of its sources (plane k has a
source's bit if the bin holds at least k + 1 of its pieces).

Only ids, lengths, sources and cluster keys are shuffled, never texts. Shards of
about ``shard_rows`` documents, dealt by a hash of id and cluster so that a hot source, a
cluster or rows without an id spread evenly, are packed independently; each leaves a few open
bins, so "tightest" is tightest of a shard (README: what that costs).
Equal pieces of one cluster and source resume where the last one was placed, so
thousands of copies do not search the same bins again.

Lengths are characters, or ``size_col`` (tokens, say); a document beyond the capacity is cut into
pieces of it. Null and empty texts get one row of length 0 and no bin. Repeated rows are
packed once each, equal lengths in order of cluster, source and id. A null source is a source of its own.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, PER_SOURCE, SHARD_ROWS = 16384, 8, 20_000


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit r: some bin has residual r

    def successor(self, r: int) -> int:
        """The smallest residual in use that is at least ``r``; -1 for none."""
        rest = self.used >> r
        return r + (rest & -rest).bit_length() - 1 if rest else -1

    def fits(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def find(self, size: int, source: int, cluster: int, start: int) -> tuple[int, int]:
        """Tightest compatible bin and its residual from residual ``start`` on; (-1, capacity + 1) for none."""
        r = self.successor(max(size, start))
        while r >= 0:
            for b in self.at[r]:
                if self.fits(b, source, cluster):
                    return b, r
            r = self.successor(r + 1)
        return -1, self.capacity + 1

    def _move(self, b: int, to: int) -> None:
        r = self.residual[b]
        self.at[r].remove(b)
        if not self.at[r]:
            self.used &= ~(1 << r)
        self.residual[b] = to
        insort(self.at[to], b)  # the older bin first on equal residuals
        self.used |= 1 << to

    def open(self) -> int:
        b = len(self.residual)
        self.residual.append(self.capacity), self.clusters.append(0), self.sources.append([0] * self.per_source)
        self.at[self.capacity].append(b)
        self.used |= 1 << self.capacity
        return b

    def put(self, b: int, size: int, source: int, cluster: int) -> None:
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                break
        self._move(b, self.residual[b] - size)


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """Bin of each piece; pieces are given in any order and placed longest first (then by cluster, source, order)."""
    plain = [(s is not None, s or "") for s in sources]  # a null source is no source's name
    names = {s: 1 << i for i, s in enumerate(sorted(set(plain)))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    several = {c: 1 << i for i, c in enumerate(sorted(c for c, n in seen.items() if n > 1))}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], plain[i], i))
    bins, out, last, start = Bins(capacity, per_source), [0] * len(sizes), None, 0
    for i in order:
        size, source, cluster = sizes[i], names[plain[i]], several.get(clusters[i], 0)
        alike = (size, source, cluster)
        # bins below the last one's residual refused an equal piece and still do
        b, r = bins.find(size, source, cluster, start if cluster and alike == last else 0)
        if b < 0:
            b = bins.open()
        bins.put(b, size, source, cluster)
        out[i], last, start = b, alike, r
    return out


def _pack(capacity: int, per_source: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "piece"], kind="stable").reset_index(drop=True)
        sources = [None if s is None or s != s else s for s in pdf["source"].tolist()]
        bins = pack_shard(pdf["length"].tolist(), sources, pdf["cluster"].tolist(), capacity, per_source)
        pdf["bin_id"] = pdf["shard"].astype("int64") * (1 << 32) + pd.Series(bins, dtype="int64")
        by = pdf.groupby("bin_id")["length"]
        pdf["bin_fill"], pdf["bin_pieces"] = by.transform("sum"), by.transform("size")
        return pdf[["doc_id", "source", "piece", "start", "length", "bin_id", "bin_fill", "bin_pieces"]]

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, size_col: str | None = None,
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row a piece: ``doc_id, source, piece, start, length``, ``bin_id, bin_fill, bin_pieces``.

    Without ``cluster_col`` equal texts form a cluster.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(text)
    size = F.coalesce(F.col(size_col) if size_col else F.char_length(text), F.lit(0)).cast("bigint")
    pieces = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("int")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), size.alias("size"), pieces.alias("n"))
    shards = max(1, -(-docs.count() // shard_rows))
    cut = base.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
    cut = cut.select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece") * F.lit(capacity)).alias("length"),
        F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).alias("shard"),
    )
    schema = "doc_id long, source string, piece int, start long, length long, bin_id long, bin_fill long, bin_pieces long"
    placed = cut.where("length > 0").groupBy("shard").applyInPandas(_pack(capacity, per_source), schema)
    none = F.lit(None).cast("bigint")
    empty = cut.where("length <= 0").select("doc_id", "source", "piece", "start", "length", none.alias("bin_id"), none.alias("bin_fill"), none.alias("bin_pieces"))
    return placed.unionByName(empty)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
