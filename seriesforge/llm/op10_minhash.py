"""SuperMinHash near-dedup: correlated ranks, banding, exact verification, union-find grouping.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Equal sets are
   collapsed by a 128-bit digest with a partial aggregate, so that thousands of
   copies cost one row from then on.
2. A SuperMinHash signature (Ertl 2017): element e draws a random permutation
   of the slots and offers rank j + r_j to the j-th of them; a slot keeps the
   lowest offer. Elements go through j = 0, 1, ... together and a text stops as
   soon as every slot holds a rank below j + 1, which later levels cannot beat.
3. Band hashes collect candidate families: a task unites its texts of equal band
   hash and sends one root a hash, so a hash that a third of all texts share is one
   row a task, and roots that meet under a hash are united. Within a family, blocks
   of bounded shingles compare full sets by a sparse matrix product. Families beyond one block
   are compared by block representatives first; then texts that still share a band hash
   with a text of another component are compared across blocks, so no link between
   components is lost, and members already linked are not compared again.
4. Links are grouped by distributed union-find.

Nulls and texts without words have an empty set, link with nothing and are kept.
Ties do not matter: the component is the smallest id. Rows that share an id are one
document to the links (it links where any of its texts does) and keep one row each.
A text without an id links with nothing, has no component and is kept; an empty table gives an empty
result. Long texts are worked on whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.llm.common import HOT_KEYS, U64, Words, connected_components, discard, forest, lookup, materialise, mix, shingle_sets, small_text_batches, steps

BANDS, ROWS = 32, 8
#: Sets, and shingles on average, that one comparison task holds on each side.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Texts whose band hashes a task unites at a time.
BAND_TEXTS = 50_000
#: Shingles that a comparison holds at a time.
SLICE = 1 << 19
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(h: np.ndarray, offs: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (n, slots) of hash sets given as one array and n + 1 offsets.

    Values are ``level << 32 | random``; empty sets keep all ones.
    """
    n = len(offs) - 1
    sig = np.full(n * slots, _NONE, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    elem = h
    perm: np.ndarray | None = None
    for j in range(slots):
        draw = mix(elem + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + ((draw >> U64(32)) * U64(slots - j) >> U64(32))).astype(np.int64)
        value = (U64(j) << U64(32)) | (draw & U64(0xFFFFFFFF))
        if j == 0:
            slot = k
        else:
            row = np.arange(len(elem))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(sig, doc * slots + slot, value)
        # a text goes on while one of its slots holds nothing below the next level
        worst = sig.reshape(n, slots).max(axis=1) if n else sig
        going = worst >= (U64(j + 1) << U64(32))
        if not going.any():
            break
        live = going[doc]
        first_k = k[live]
        doc, elem = doc[live], elem[live]
        if not len(doc):
            break
        if j == 0:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elem), 1))
            perm[np.arange(len(elem)), first_k] = 0
        else:
            perm = perm[live]
    return sig.reshape(n, slots)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sketch(bands: int, rows: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, limit=1 << 20):
                h, offs = shingle_sets(Words(b.column("text")), size)
                n = np.diff(offs)
                sig = superminhash(h, offs, bands * rows)
                bh, slot = np.zeros((len(n), bands), dtype=np.uint64), np.arange(bands, dtype=np.uint64) << U64(40)
                for r in range(rows):
                    bh = mix(bh * U64(31) + sig[:, r::rows] + U64(r + 1) + slot)
                sums = lambda v: np.diff(np.concatenate([[U64(0)], np.cumsum(v, dtype=np.uint64)])[offs])
                flat = pa.array(_signed(bh).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(n) + 1, bands, dtype=np.int32)), flat)
                cols = [b.column("doc_id"), pa.array(n), pa.array(_signed(sums(mix(h)))), pa.array(_signed(sums(mix(h ^ U64(0xA5A5A5A5A5A5A5A5))))), lists]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node): nodes under one h belong to one family; of the texts of a chunk only a root meets others."""

    def flush(rep: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        node = np.repeat(rep, h.shape[1])
        h = h.ravel()
        order = np.argsort(h, kind="stable")
        h, node = h[order], node[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        head = np.repeat(node[first], np.diff(np.append(first, len(h))))
        child, root = forest(node, head)
        top = node[first]
        at = np.minimum(np.searchsorted(child, top), max(len(child) - 1, 0))
        if len(child):
            top = np.where(child[at] == top, root[at], top)
        own = _signed(mix(child.view(np.uint64) ^ U64(0x5EED)))  # a child meets its root under a hash of their own
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[first], own, own])), pa.array(np.concatenate([top, child, root]))], names=["h", "node"])

    reps, hashes, size = [], [], 0
    for b in batches:
        if b.num_rows:
            bands = b.column("bands")
            reps.append(b.column("rep").to_numpy()), hashes.append(bands.flatten().to_numpy().reshape(b.num_rows, -1))
            size += b.num_rows
        if size >= BAND_TEXTS:
            yield flush(np.concatenate(reps), np.vstack(hashes))
            reps, hashes, size = [], [], 0
    if size:
        yield flush(np.concatenate(reps), np.vstack(hashes))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole):
                h, offs = shingle_sets(Words(b.column("text")), size)
                blobs = pa.array([h[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), blobs], names=["doc_id", "shingles"])

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; ranges of hashes one after the other, so that memory does not follow the sets."""
    same = right is left
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    every = left if same else [*left, *right]
    slices = sum(map(len, every)) // SLICE + 1
    edges = np.array([(k << 64) // slices for k in range(1, slices)], dtype=np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(v, edges), [len(v)]]) for v in every]
    for k in range(slices):
        _add_shared(out, [v[c[k] : c[k + 1]] for v, c in zip(every, cuts, strict=True)], len(left), same)
    return out


def _add_shared(out: np.ndarray, sets: list[np.ndarray], n_left: int, same: bool) -> None:
    """Adds products of 0/1 matrices over shared elements, in column blocks."""
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, code = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # elements of one set only cannot be shared, other than with itself
    shared = np.bincount(code, minlength=1)[code] > 1
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    width = 8192
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1.0
        out += m @ m.T if same else m[:n_left] @ m[n_left:].T


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Boolean matrix of ``den * |A & B| >= num * |A | B|`` (sets sorted and distinct)."""
    inter = np.rint(_intersections(left, right)).astype(np.int64)
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    union = a[:, None] + b[None, :] - inter
    return (den * inter >= num * union) & (inter > 0)


def _compare(num: int, den: int):
    """Links within side 0 (no side 1), or between side 0 and side 1 where components differ."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        ids, comp = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        li, ri = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inner = not len(ri)
        if inner:
            ri = li
        left = [sets[i] for i in li]
        ok = linked_pairs(left, left if inner else [sets[i] for i in ri], num, den)
        ok &= np.triu(np.ones(ok.shape, bool), 1) if inner else comp[li][:, None] != comp[ri][None, :]
        x, y = np.nonzero(ok)
        return pd.DataFrame({"a": ids[li][x], "b": ids[ri][y]})

    return run


def _relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    comp = connected_components(links).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "found")
    return nodes.join(comp, "doc_id", "left").withColumn("component", F.coalesce("found", "doc_id")).drop("found")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, size: int = 5, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; see the module for the method."""
    small_text_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialise(src.mapInArrow(_sketch(bands, rows, size), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    same = base.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles")
    reps = materialise(same.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    met = reps.where("rep is not null").select("rep", "bands").mapInArrow(_meetings, "h long, node long")
    met = met.withColumn("low", F.min("node").over(Window.partitionBy("h"))).where("node <> low")
    families = materialise(connected_components(met.select(F.col("node").alias("a"), F.col("low").alias("b"))))
    heads = families.select(F.col("component").alias("rep"), F.col("component").alias("family")).distinct()
    members = families.select(F.col("node").alias("rep"), F.col("component").alias("family")).unionByName(heads)
    members = materialise(reps.select("rep", "n_shingles").join(members, "rep"))
    need = F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / BLOCK_SHINGLES)
    large = members.groupBy("family").agg(F.ceil(need).cast("int").alias("blocks")).where("blocks > 1")
    members = lookup(members.select("rep", "family").distinct(), "family", materialise(large))
    members = members.select(F.col("rep").alias("doc_id"), "family", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    members = materialise(members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    sets = materialise(src.join(members.select("doc_id"), "doc_id").mapInArrow(_sets(size), "doc_id long, shingles binary"))
    bands_of = reps.select(F.col("rep").alias("doc_id"), "bands")
    links = _family_links(members, sets, bands_of, num, den, block)
    discard(members, sets)
    comp = connected_components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "root")
    text = ["d1", "d2", "n_shingles"]
    hot = reps.where(F.col("copies") >= max(2, base.count() // HOT_KEYS)).select(text)  # one text may be a third of all rows
    groups = materialise(reps.select(*text, "rep").join(comp, "rep", "left").select(*text, F.coalesce("root", "rep").alias("found")))
    out = lookup(base.select("doc_id", *text), text, groups, hot)
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _family_links(members: DataFrame, sets: DataFrame, bands: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """All links within families that join different components, and enough of the others.

    ``members``: doc_id, family, blocks, block; ``sets``: doc_id, shingles; ``bands``: doc_id, bands. Tasks
    are planned on ids alone; sets join by document last and are dealt by the whole
    task key, so a family of many blocks is many tasks.
    """

    def compare(plan: DataFrame, *keys: str) -> DataFrame:
        rows = plan.select(*keys, "doc_id", "component", "side").join(sets, "doc_id")
        return materialise(rows.groupBy(*keys).applyInPandas(_compare(num, den), "a long, b long"))

    side = lambda df, s: df.withColumn("side", F.lit(s))
    own = members.withColumn("component", F.col("doc_id"))
    links = compare(side(own, 0), "family", "block")
    big = members.where("blocks > 1")
    if not big.limit(1).count():
        return links
    # representatives of block components, regrouped into fresh blocks, merge most of a large family
    count = lambda df, name: materialise(df.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)))
    for salt in range(2):
        reps = materialise(_relabel(big, links).where("doc_id = component").drop("block"))
        mixed = lookup(reps, "family", count(reps, "m")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(salt + 1)), F.col("m")).cast("int"))
        links = links.unionByName(compare(side(mixed, 0), "family", "block"))
    # the rest: texts under a band hash of several components, a family's largest component against the others
    nodes = materialise(_relabel(big, links))
    keys = materialise(nodes.join(bands, "doc_id").select("doc_id", "component", F.explode("bands").alias("h")))
    mixed = materialise(keys.groupBy("h").agg((F.min("component") < F.max("component")).alias("open")).where("open"))
    if not mixed.limit(1).count():
        return links
    met = lookup(keys.select("doc_id", "h"), "h", mixed).where("open").select("doc_id").distinct()
    nodes = materialise(nodes.join(met, "doc_id", "left_semi"))
    by = nodes.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = materialise(lookup(nodes, "family", materialise(top)).where("top is not null"))
    chunks = count(open_.where("component <> top"), "chunks")
    open_ = materialise(lookup(open_, "family", chunks))
    rest = open_.where("component <> top").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("chunks")).cast("int"))
    left = open_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["family", "block", "chunk", "doc_id", "component"]
    pairs = side(left.select(cols), 0).unionByName(side(right.select(cols), 1))
    return links.unionByName(compare(pairs, "family", "block", "chunk"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
