import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import common
from seriesforge.llm import op03_suffix as S
from seriesforge.llm import op04_pq as P
from seriesforge.llm import op10_minhash as M
from seriesforge.llm.common import connected_components, sample_ids

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    """Plain union-find."""

    def __init__(self, ids):
        self.p = {i: i for i in ids}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.p[b] = a


def shingles(text, size=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()


def brute_near(rows, num=85):
    sets, u = {i: shingles(t) for i, t in rows}, Sets(i for i, _ in rows)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                u.join(a, b)
    return {i: (len(sets[i]), u.find(i), u.find(i) == i) for i in ids}


def as_rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_near_duplicates_equal_brute_force(docs, corpus):
    assert as_rows(M.near_duplicates(docs(corpus))) == brute_near(corpus)


def test_large_family_in_small_blocks_loses_no_link(docs):
    # a chain: neighbours are linked, ends are far apart; many members, tiny blocks
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 120])) for i in range(0, 60, 2)] + [(1000 + i, " ".join(words[i + 200 : i + 320])) for i in range(0, 60, 2)]
    got = as_rows(M.near_duplicates(docs(rows), block=4))
    assert got == brute_near(rows) and len({v[1] for v in got.values()}) == 2


def test_near_duplicates_edge_tables(docs, clashing):
    assert M.near_duplicates(docs([])).count() == 0
    one = as_rows(M.near_duplicates(docs([(7, None), (8, ""), (9, "a b")])))
    assert one == {7: (0, 7, True), 8: (0, 8, True), 9: (1, 9, True)}
    twice = M.near_duplicates(docs([(1, "a b c"), (1, "a b c"), (2, "A B C")])).collect()
    assert sorted(map(tuple, twice)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert as_rows(M.near_duplicates(clashing([(3, "x y z"), (4, "x y z")])))[4] == (1, 3, False)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.85):
        a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        k = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 1000 - k, dtype=np.uint64)])
        sig = M.superminhash(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]), 256)
        assert abs((sig[0] == sig[1]).mean() - share) < 0.1
    small = M.superminhash(np.arange(3, dtype=np.uint64), np.array([0, 0, 3]), 64)
    assert (small[0] == M._NONE).all() and (small[1] != M._NONE).all()
    # every slot of a one-element set holds one of the ranks 0..63, each once
    one = M.superminhash(np.array([5], dtype=np.uint64), np.array([0, 1]), 64)[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(64))


def brute_suffix(rows, depth=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            w = b[k : k + depth]
            if w in seen:
                gone[k : k + depth] = b"\1" * depth
            else:
                seen.add(w)
        runs = sum(1 for r in bytes(gone).split(b"\0") if r)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_equal_brute_force(docs, corpus):
    got = as_rows(S.dedup_digest(docs(corpus).repartition(5)))
    assert got == brute_suffix(corpus) and sum(v[1] for v in got.values()) > 0


@pytest.mark.parametrize("buckets", [1, 7])
def test_repeats_across_tasks_and_edges(docs, monkeypatch, buckets):
    monkeypatch.setattr(S, "bucket_count", lambda spark: buckets)
    tail = "".join(chr(97 + (i * i) % 26) for i in range(260))
    rows = [(i, f"{i:03d}" * (i % 5) + tail[i % 7 : 160 + i] + "z" * (i % 3)) for i in range(60)]
    rows += [(100, "x" * 99), (101, "x" * 99), (102, "x" * 100), (103, "x" * 350), (104, "é" * 120), (105, "aé" * 120)]
    assert as_rows(S.dedup_digest(docs(rows).repartition(6))) == brute_suffix(rows)


def test_repeats_edge_tables(docs, clashing):
    assert S.dedup_digest(docs([])).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert as_rows(S.dedup_digest(docs([(1, None), (2, "")]))) == {1: (0, 0, 0, empty), 2: (0, 0, 0, empty)}
    same = S.dedup_digest(docs([(1, "q" * 40 + "w" * 90), (1, "q" * 40 + "w" * 90)])).collect()
    assert [r.n_removed for r in same] == [0, 0]  # rows of one id are not earlier than one another
    text = "".join(chr(97 + (i * 7) % 26) + str(i) for i in range(60))
    got = {r.doc_id: r for r in S.remove_repeats(clashing([(5, text), (6, "new " + text)])).collect()}
    assert got[5].text == text and got[6].text == "new " and got[6].component == "x" and got[6].rs == "x"


def brute_vectors(rows):
    clean = {}
    for k, (i, v) in enumerate(rows):
        if v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            clean[k] = np.array(v, float) / np.linalg.norm(v)
    u, n = Sets(i for i, _ in rows), dict.fromkeys(range(len(rows)), 0)
    for a, x in clean.items():
        for b, y in clean.items():
            if a != b and x @ y >= 0.9:
                n[a] += 1
                u.join(rows[a][0], rows[b][0])
    return {i: (n[k], u.find(i), u.find(i) == i) for k, (i, _) in enumerate(rows)}


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.uniform(0.5, 3) + rng.normal(0, 0.12, 8)).tolist()) for i in range(150)]
    rows += [(200 + i, rng.normal(size=8).tolist()) for i in range(60)] + [(300 + i, rows[0][1]) for i in range(9)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [1.0]), (406, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, mult int")
    want = brute_vectors(rows)
    got = as_rows(P.near_duplicates(df))
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert 0.9 * true <= found <= true  # recall against brute force; never a false link
    monkeypatch.setattr(P, "MEMBERS", 16)
    monkeypatch.setattr(P, "QUERIES", 16)
    assert as_rows(P.near_duplicates(df, probes=10_000)) == want  # all lists probed, in many blocks: exact


def test_vectors_edge_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert P.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert as_rows(P.near_duplicates(spark.createDataFrame([(1, None)], schema))) == {1: (0, 1, True)}
    assert as_rows(P.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0]), (2, [2.0, 0.0])], schema))) == {5: (1, 2, False), 2: (1, 2, True)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(90)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300), (400, 400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 91)}, **{i: 200 for i in range(201, 260)}, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_sample_is_bounded_and_stable(spark):
    ids = spark.range(5000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in sample_ids(df, "k", 300).collect()) for df in (ids, ids.repartition(9).orderBy(F.desc("k"))))
    assert a == b and len(a) == 300 and sample_ids(ids.limit(20), "k", 300).count() == 20


def test_rows_that_share_an_id_keep_their_own_cuts(docs):
    rng = random.Random(9)
    x, y = (bytes(rng.randrange(97, 123) for _ in range(300)).decode() for _ in range(2))
    rows = [(0, x), (1, x), (1, y), (2, y), (3, y + y), (3, x[:150] + y[:120])]
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in S.dedup_digest(docs(rows).repartition(4)).collect()}
    assert got == {(0, 300, 0), (1, 300, 300), (1, 300, 0), (2, 300, 300), (3, 600, 600), (3, 270, 270)}
    kept = sorted((r.doc_id, r.text) for r in S.remove_repeats(docs(rows)).collect())
    assert kept == sorted([(0, x), (1, ""), (1, y), (2, ""), (3, ""), (3, "")])
    twice = [(7, x + x), (7, y + x), (8, "")]  # unequal texts of one id: each only against itself
    assert {(r.n_bytes, r.n_removed) for r in S.dedup_digest(docs(twice)).collect()} == {(600, 300), (600, 0), (0, 0)}


def test_refinement_equals_brute_force():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    data[1500:1900], data[3000:3250], data[3700:] = data[100:500], data[200:450], 0
    bucket = S.refined(data)
    raw = data.tobytes()
    first = {}
    assert len(bucket) == len(raw) - 99
    assert all(first.setdefault(raw[i : i + 100], int(b)) == b for i, b in enumerate(bucket)) and len(set(first.values())) == len(first)
    assert not len(S.refined(data[:99])) and len(S.refined(data[:100])) == 1


def test_vectors_of_every_length_take_part(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.1, 0.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [2.0, 4.1]), (7, [5.0]), (9, [-5.0]), (8, [1.0] * 5), (None, [1.0, 2.0])]
    got = as_rows(P.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False), 7: (0, 7, True), 9: (0, 9, True), 8: (0, 8, True), None: (0, None, True)}


def test_lookups_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, i) for i in range(600, 900)] + [(i, i + 1) for i in range(1000, 1040)]
    want, nodes = Sets(x for e in edges for x in e), {x for e in edges for x in e}
    for a, b in edges:
        want.join(a, b)
    for bound, held in ((200_000, 4_000_000), (0, 40)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(common, "FOREST_EDGES", held)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
        assert got == {x: want.find(x) for x in nodes if want.find(x) != x}
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (None, 51)], "k long, i int")
    got = common.lookup(rows, "k", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string"))
    assert {r.i: r.v for r in got.collect()} == {**dict.fromkeys(range(50), "a"), 50: "b", 51: None}


def test_memory_of_a_suffix_task_is_bounded(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    text = rng.integers(97, 122, (1 << 24)).astype(np.uint8).tobytes().decode()
    S.refined(np.zeros(200, np.uint8))
    common.powers(1)
    tracemalloc.start()
    S.refined(np.frombuffer(text.encode()[: 1 << 21], np.uint8))
    assert tracemalloc.get_traced_memory()[1] < 45 << 21  # 70 bytes a byte with np.unique
    texts = [text[i : i + 4000] for i in range(0, len(text), 4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(len(texts)), "row": np.zeros(len(texts), np.int64), "text": texts})
    tracemalloc.reset_peak()
    sent = sum(b.num_rows for b in S._send_anchors(5)(batch.slice(at, 500) for at in range(0, len(texts), 500)))
    assert sent and tracemalloc.get_traced_memory()[1] < 180 << 20
    tracemalloc.stop()
