"""Embedding near-dedup by product quantisation.

1. Equal vectors collapse to one row with a multiplicity (partial aggregate).
2. A bounded sample trains coarse centroids and, on residuals, a codebook for each of
   ``SUBSPACES`` subspaces. Vectors of different lengths have no cosine, so every length has
   centroids and codebooks of its own; the lengths share the sample (``SAMPLE`` in proportion,
   ``LENGTH_SAMPLE`` at least) and all later steps.
3. Every vector goes to the inverted list of its nearest centroid with its residual
   codes and the length of what the codes miss, and queries its ``PROBES``
   nearest lists.
4. Lists are cut into blocks of members and chunks of queries, so a hot list is
   many tasks. A task looks distances up in tables of (query, subspace, code). The
   inner product differs from the looked-up one by at most the missed length, so
   candidates are those within it of the threshold; exact cosines in double
   precision decide.
5. A task returns a row a vector: how many links it adds and the root of its local
   union-find, never pairs. A link is credited to both ends exactly once: to the
   query, and to the member unless the member's own probes find it.
6. Distributed union-find joins the local roots.

Vectors that are null, zero, empty, or hold null or non-finite components link with
nothing; so do vectors without an id, which have no component and are kept. A cosine of exactly the threshold links. Repeated ids count as vectors of their
own in ``n_links`` and give a row each. An empty table gives an empty result. Labels and extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import HOT_KEYS, connected_components, hook, lookup, materialise

THRESHOLD = 0.9
SAMPLE, SUBSPACES, CODES, PROBES = 16_384, 8, 256, 8
LENGTH_SAMPLE, MOST_LISTS = 256, 1024
MEMBERS, QUERIES = 2048, 2048


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct sample rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first, lower index on ties."""
    d = (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)
    k = min(k, len(c))
    top = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    top = np.sort(top, axis=1)
    return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable"), axis=1)


def apart(c: np.ndarray, gap: float = (2.0 - 2.0 * THRESHOLD) ** 0.5) -> np.ndarray:
    """Centres of which no two are nearer than a link is long.

    A dense group draws many centres; without this its links would run between
    more lists than a query probes.
    """
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or ((c[kept] - c[i]) ** 2).sum(axis=1).min() > gap * gap:
            kept.append(i)
    return c[kept]


@dataclass
class Index:
    coarse: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # per subspace (codes, width)
    cuts: np.ndarray  # dimension ranges of subspaces

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes and the lengths that they miss."""
        rest = unit - self.coarse[lists]
        codes = np.empty((len(unit), len(self.books)), dtype=np.uint8)
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = nearest(part, book, 1)[:, 0]
            rest[:, self.cuts[m] : self.cuts[m + 1]] = part - book[codes[:, m]]
        return codes, np.sqrt((rest * rest).sum(axis=1))


def train(unit: np.ndarray, lists: int, seed: int = 11) -> Index:
    coarse = apart(kmeans(unit, lists, 8, seed))
    rest = unit - coarse[nearest(unit, coarse, 1)[:, 0]]
    cuts = np.linspace(0, unit.shape[1], min(SUBSPACES, unit.shape[1]) + 1).astype(int)
    books = [kmeans(rest[:, a:b], CODES, 8, seed + 1 + i) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return Index(coarse, books, cuts)


@dataclass
class Indexes:
    """An index a vector length; lists are numbered through."""

    by_length: dict[int, Index]

    def __post_init__(self) -> None:
        self.lengths = sorted(self.by_length)
        self.first = np.cumsum([0, *(len(self.by_length[d].coarse) for d in self.lengths)])

    def of_list(self, number: int) -> tuple[Index, int]:
        """The index of a list and the number of its first list."""
        k = int(np.searchsorted(self.first, number, side="right")) - 1
        return self.by_length[self.lengths[k]], int(self.first[k])


def _stack(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of tiny or huge components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(indexes, probes: int):
    names = ["vec_id", "mult", "v", "list", "codes", "miss", "probes"]
    blob = lambda m: pa.array([r.tobytes() for r in m], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = indexes.value
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            for dim in np.unique(lengths):
                b = batch.filter(pa.array(lengths == dim))
                ix, first = found.by_length[int(dim)], found.first[found.lengths.index(int(dim))]
                unit = _unit(b.column("embedding").flatten().to_numpy().reshape(-1, dim))
                near = nearest(unit, ix.coarse, probes)
                codes, miss = ix.encode(unit, near[:, 0])
                near = (near + first).astype(np.int32)
                cols = [b.column("vec_id"), b.column("mult"), blob(unit), pa.array(near[:, 0]), blob(codes), pa.array(miss), pa.array(near.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def block_links(ix: Index, home: int, q: dict[str, np.ndarray], m: dict[str, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (query, member) positions of one list, by table lookup and exact rerank, in strips of queries."""
    strip = max(1, (1 << 22) // max(1, len(m["v"])))
    for at in range(0, len(q["v"]), strip):
        v = q["v"][at : at + strip]
        near = np.repeat((v @ ix.coarse[home])[:, None], len(m["v"]), axis=1).astype(np.float32)
        for s, book in enumerate(ix.books):
            table = (v[:, ix.cuts[s] : ix.cuts[s + 1]] @ book.T).astype(np.float32)
            near += table[:, m["codes"][:, s]]
        i, j = np.nonzero(near >= threshold - m["miss"][None, :] - 1e-5)
        for lo in range(0, len(i), 1 << 18):
            a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            ok = np.einsum("ij,ij->i", v[a], m["v"][b]) >= threshold
            yield a[ok] + at, b[ok]


def _search(index, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = int(pdf["at"].iloc[0])
        ix, first = index.value.of_list(home)
        side = pdf["side"].to_numpy()

        def part(s: int) -> dict[str, np.ndarray]:
            p = pdf[side == s]
            return {"id": p["vec_id"].to_numpy(), "mult": p["mult"].to_numpy(), "v": _stack(p["v"], ix.dim), "list": p["list"].to_numpy(), "probes": p["probes"].to_numpy(), "p": p}

        q, m = part(0), part(1)
        if not len(q["id"]) or not len(m["id"]):
            return pd.DataFrame({"vec_id": [], "n": [], "root": []}, dtype="int64")
        m["codes"] = np.frombuffer(b"".join(m["p"]["codes"]), dtype=np.uint8).reshape(len(m["id"]), -1)
        m["miss"] = m["p"]["miss"].to_numpy()
        finds = np.zeros((len(m["id"]), len(ix.coarse)), dtype=bool)  # lists that a member queries itself
        finds[np.repeat(np.arange(len(m["id"])), [len(x) for x in m["probes"]]), np.concatenate(list(m["probes"])) - first] = True
        ids = np.unique(np.concatenate([q["id"], m["id"]]))
        qi, mi = np.searchsorted(ids, q["id"]), np.searchsorted(ids, m["id"])
        n, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for a, b in block_links(ix, home - first, q, m, threshold):
            other = q["id"][a] != m["id"][b]
            a, b = a[other], b[other]
            np.add.at(n, qi[a], m["mult"][b])
            back = ~finds[b, q["list"][a] - first]
            np.add.at(n, mi[b[back]], q["mult"][a[back]])
            hook(parent, qi[a], mi[b])
        hit = np.flatnonzero((n > 0) | (parent != np.arange(len(ids))))
        return pd.DataFrame({"vec_id": ids[hit], "n": n[hit], "root": ids[parent[hit]]})

    return run


def train_lengths(reps: DataFrame, sample: int, lists: int | None) -> Indexes:
    """An index for every vector length of ``reps(embedding)``, from a sample of bounded size."""
    dim = F.size("embedding").alias("dim")
    sizes = {r["dim"]: r["count"] for r in reps.groupBy(dim).count().collect()}
    total = sum(sizes.values())
    want = {d: min(n, max(LENGTH_SAMPLE, sample * n // total)) for d, n in sizes.items()}
    space = 1 << 40  # a hash threshold a length thins the rows where they are read; the smallest hashes decide
    share = [(d, min(space, int(space * 1.3 * (want[d] + 100) / n))) for d, n in sizes.items()]
    if not share:
        return Indexes({})
    thin = reps.select(dim, "vec_id", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(space)).alias("h"))
    thin = thin.join(F.broadcast(reps.sparkSession.createDataFrame(share, "dim int, most long")), "dim").where("h < most")
    got = thin.select("dim", "h", "vec_id", "embedding").toArrow().combine_chunks()
    dims, order = got.column("dim").to_numpy(), np.lexsort((got.column("vec_id").to_numpy(), got.column("h").to_numpy()))
    out = {}
    for d, n in sizes.items():
        pick = order[dims[order] == d][: want[d]]
        x = got.column("embedding").combine_chunks().take(pa.array(pick)).flatten().to_numpy().reshape(-1, d)
        out[d] = train(_unit(x), lists or int(np.clip(4 * np.sqrt(n), 1, MOST_LISTS)))
    return Indexes(out)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES, sample: int = SAMPLE, lists: int | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    clean = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(F.exists("embedding", bad), F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    keyed = src.withColumn("ok", F.coalesce(clean, F.lit(False))).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64("embedding", F.lit(7)))
    reps = materialise(keyed.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding")))
    indexes = train_lengths(reps, sample, lists)
    alone = keyed.select("ok", "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not indexes.lengths:
        return alone.drop("ok").withColumn("kept", F.lit(True))
    index = spark.sparkContext.broadcast(indexes)
    schema = "vec_id long, mult long, v binary, list int, codes binary, miss double, probes array<int>"
    placed = materialise(reps.select("vec_id", "mult", "embedding").mapInArrow(_assign(index, probes), schema))
    # sizes of the lists: at most MOST_LISTS rows a vector length
    held = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    asked = {r["at"]: r["count"] for r in placed.select(F.explode("probes").alias("at")).groupBy("at").count().collect()}
    grid = spark.createDataFrame([(k, -(-held[k] // MEMBERS), -(-asked.get(k, 1) // QUERIES)) for k in held], "at int, blocks int, chunks int")
    grid = F.broadcast(grid)
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["at", "block", "chunk", "side", "vec_id", "mult", "v", "list", "codes", "miss", "probes"]
    m = placed.withColumn("at", F.col("list")).join(grid, "at").withColumn("side", F.lit(1)).withColumn("block", spread(F.col("blocks"), 1)).withColumn("chunk", every(F.col("chunks")))
    q = placed.withColumn("at", F.explode("probes")).join(grid, "at").withColumn("side", F.lit(0)).withColumn("chunk", spread(F.col("chunks"), 2)).withColumn("block", every(F.col("blocks")))
    q = q.withColumn("codes", F.lit(None).cast("binary"))
    found = m.select(cols).unionByName(q.select(cols)).groupBy("at", "block", "chunk").applyInPandas(_search(index, threshold), "vec_id long, n long, root long")
    found = materialise(found)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec_id")
    by = reps.drop("embedding").join(links, "vec_id", "left").join(comp, "vec_id", "left")
    by = materialise(by.select("k1", "k2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    total = by.agg(F.sum("mult")).first()[0]
    hot = by.where(F.col("mult") >= max(2, total // HOT_KEYS)).select("k1", "k2")  # one vector may be a third of all rows
    linked = lookup(keyed.where("ok").select("vec_id", "k1", "k2"), ["k1", "k2"], by.drop("mult"), hot).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(alone.where("not ok").select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
