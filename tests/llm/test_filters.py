import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seriesforge.llm import op01_quality as Q
from seriesforge.llm import op06_images as I
from seriesforge.llm import op08_packing as B
from seriesforge.llm import op09_toxicity as X


def sentence(rng, n):
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('nrst')}" for _ in range(n)]
    return " ".join(w if k % 9 else w.capitalize() + "." for k, w in enumerate(words))


def labelled(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        ws, toxic = sentence(rng, rng.randrange(20, 90)).split(), int(i % 6 == 0)
        for _ in range(3 * toxic):
            ws.insert(rng.randrange(len(ws)), rng.choice(["vilescum", "idiotic", "pathetik", "worthlez"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_finds_held_out_texts(spark, docs):
    rows, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.classify(docs(rows), table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    hits = sum(got[i].predicted == labels[i][2] for i in held)
    assert hits / len(held) > 0.95
    # labels of held-out rows must not matter
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in X.classify(docs(rows), flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_edges(spark, docs, clashing):
    rows, labels = labelled(120)
    table = spark.createDataFrame([*labels, (0, 1, None), (99999, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    texts = [*rows, (5000, None), (5001, ""), (5002, "idiotic " * 20000), (5003, "!!!")]
    got = {r.doc_id: r for r in X.classify(docs(texts), table).collect()}
    assert len(got) == len(texts) and got[5000].score == got[5001].score == got[5003].score
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in X.classify(docs(rows[:3]), none).collect()} == {0.0} and X.classify(docs([]), none).count() == 0
    out = X.score(clashing([(1, "a")]), X.train(docs(rows), table))
    assert dict(out.dtypes)["toxic_score"] == "double" and out.first().component == "x"


def junk(rng, k):
    ws = sentence(rng, 60).split()
    return [" ".join(w + rng.choice(["***", "###"]) for w in ws), " ".join(w.upper() + "!!" for w in ws), " ".join([ws[0]] * 60), " | ".join(ws)][k % 4]


def test_quality_keeps_clean_texts_and_drops_junk(docs):
    rng = random.Random(8)
    rows = [(i, junk(rng, i // 8) if i % 8 == 0 else sentence(rng, rng.randrange(30, 120))) for i in range(640)]
    got = {r.doc_id: r for r in Q.classify(docs(rows)).collect()}
    clean, bad = [got[i].kept for i in got if i % 8], [got[i].kept for i in got if i % 8 == 0]
    assert all(clean) and sum(bad) <= 0.1 * len(bad)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    bad = rng.random(20000) < 0.2
    v = np.full((len(bad), len(Q.LABELLERS)), Q.NONE)
    truth = np.linspace(0.95, 0.7, v.shape[1])
    for j, a in enumerate(truth):
        v[:, j] = np.where(rng.random(len(bad)) < a, np.where(bad, Q.BAD, Q.GOOD), np.where(bad, Q.GOOD, Q.BAD))
    code, n = np.unique(Q.pattern(v), return_counts=True)
    assert (Q.unpattern(Q.pattern(v)) == v).all()
    model = Q.expectation_maximisation(Q.unpattern(code), n)
    assert np.allclose(list(model.accuracies().values()), truth, atol=0.03) and abs(model.prior - 0.2) < 0.02
    assert ((model.posterior(v) < 0.5) == bad).mean() > 0.97


def test_quality_edges(docs, clashing):
    assert Q.classify(docs([])).count() == 0
    rows = [(1, None), (2, ""), (3, "   "), (4, "one two"), (5, "word " * 40000), (5, "word " * 40000), (6, "中文 text é.")]
    got = Q.classify(docs(rows)).collect()
    assert len(got) == 7 and all(not r.kept and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    m = Q.measures(pa.array([None, "", "A b!"]))
    assert m.shape == (3, len(Q.LABELLERS)) and np.isfinite(m).all()
    assert Q.score(clashing([(1, "a b c")]), Q.train(docs([(1, "a b c")]))).first().component == "x"


def brute_pack(sizes, sources, clusters, capacity, per):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], str(sources[i]), i)):
        fit = [b for b, (r, c, s) in enumerate(bins) if r >= sizes[i] and clusters[i] not in c and s.count(sources[i]) < per]
        b = min(fit, key=lambda b: (bins[b][0], b)) if fit else len(bins)
        if b == len(bins):
            bins.append([capacity, set(), []])
        bins[b][0] -= sizes[i]
        bins[b][1].add(clusters[i]), bins[b][2].append(sources[i])
        out[i] = b
    return out


def test_packing_equals_brute_force():
    for seed in range(150):
        r = random.Random(seed)
        n, cap, per = r.randrange(1, 90), r.choice([20, 50, 100]), r.choice([1, 2, 3])
        case = [r.randrange(1, cap + 1) for _ in range(n)], [r.choice("abc") for _ in range(n)], [r.randrange(r.choice([3, 50])) for _ in range(n)]
        assert B.pack_shard(*case, cap, per) == brute_pack(*case, cap, per)


def test_packing_covers_texts_and_keeps_constraints(docs, corpus):
    df = docs([(i, t, f"s{i % 3}") for i, t in corpus]).cache()
    rows = B.pack(df, capacity=300, per_source=2, shard_rows=40).collect()
    text = dict(corpus)
    for i, t in corpus:
        mine = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert sum(n for _, n in mine) == len(t or "") and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
    bins = {}
    for r in rows:
        assert (r.bin_id is None) == (r.length == 0)
        if r.length:
            bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        assert sum(r.length for r in rs) == rs[0].bin_fill <= 300 and len(rs) == rs[0].bin_pieces
        assert len({text[r.doc_id] for r in rs}) == len(rs)
        assert max(sum(r.source == s for r in rs) for s in ("s0", "s1", "s2")) <= 2
    assert B.pack(docs([])).count() == 0
    assert B.pack(docs([(1, "a", None), (1, "a", None)])).count() == 2


def test_packing_of_null_sources_given_sizes_and_clashing_names(spark, docs, clashing):
    assert B.pack_shard([1, 1], [None, "None"], [1, 2], 10, 1) == [0, 0]  # two sources
    assert B.pack_shard([1, 1], [None, None], [1, 2], 10, 1) == [0, 1]
    rows = B.pack(docs([(None, "abc", None), (None, "abd", "None"), (1, "abcd", None)]), capacity=10, per_source=1).collect()
    assert len(rows) == 3 and len({r.bin_id for r in rows}) == 2
    sized = clashing([(1, "a"), (2, "b")]).drop("n_tokens").withColumn("n_tokens", F.lit(700))
    got = B.pack(sized, size_col="n_tokens", capacity=1024).collect()
    assert sorted((r.doc_id, r.length, r.bin_fill) for r in got) == [(1, 700, 700), (2, 700, 700)]


def expanded(found):
    """Every (query, copy) pair of representatives' pairs and members, equal images included."""
    rows, group, pairs = found.collect(), {}, {}
    for r in rows:
        if r.kind == "member":
            group.setdefault(r.match_id, []).append(r.query_id)
    for r in rows:
        if r.kind == "copy":
            pairs |= {(q, x): r for q in group[r.query_id] if q % 50 == 0 for x in group[r.match_id]}
    return pairs | {(q, x): None for ids in group.values() for q in ids if q % 50 == 0 for x in ids if x != q}


def test_equal_images_are_members_not_pairs(spark):
    image = I.render(np.random.default_rng(4).normal(size=64))
    rows = I.find_copies(spark.createDataFrame([(i, image, 1) for i in range(120)], "image_id long, image binary, k int")).collect()
    assert sorted((r.kind, r.query_id, r.match_id) for r in rows) == [("member", i, 0) for i in range(120)]


def test_image_copies(spark):
    rng = np.random.default_rng(1)
    images = {i: I.render(rng.normal(size=64)) for i in range(100, 160)}
    rows = list(images.items())
    turned = np.ascontiguousarray(np.rot90(I.decode(images[100])))
    rows += [(1001, I.edited(images[100], 5)), (1003, I.encode_pgm(turned)), (1005, images[100]), (1007, I.encode_pgm(np.clip(I.resized(I.decode(images[150]), 0.75), 0, 255)))]
    rows += [(2000, None), (2001, b""), (2002, b"GIF89a"), (2003, b"P5\n9 9\n255\nshort"), (2050, I.encode_pgm(np.full((64, 64), 7.0))), (2051, b"P5\n2 2\n255\n\x00\x01\x02\x03")]
    got = expanded(I.find_copies(spark.createDataFrame(rows, "image_id long, image binary")))
    assert {(100, 1001), (100, 1003), (100, 1005), (150, 1007)} <= set(got)
    assert all(q in (100, 150) for q, _ in got) and len(got) <= 6
    assert abs(abs(got[100, 1003].turn) - 90) < 3 and abs(got[150, 1007].scale - 0.75) < 0.05
    assert I.find_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_image_search_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(0, 30):
        a = I.render(rng.normal(size=64))
        rows += [(i * 50, a), (i * 50 + 1, I.edited(a, i * 977))]
    described = {i: I.keypoints(I.decode(b)) for i, b in rows}
    want = {(q, x) for q in described if q % 50 == 0 for x in described if x != q and I.compare(*described[q], *described[x])[1] >= I.INLIERS}
    got = set(expanded(I.find_copies(spark.createDataFrame(rows, "image_id long, image binary"))))
    assert got <= want and len(got) >= 0.9 * len(want) >= 20


def test_media_of_bad_vectors(spark):
    df = spark.createDataFrame([(1, [float("nan")] * 4), (2, None), (3, [1.0, None]), (10, [0.0] * 64)], "vec_id long, embedding array<float>")
    got = {r.image_id: r.image for r in I.media_of(df).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and got[10] and got[10 + I.COPY]


def test_scores_equal_a_plain_reimplementation():
    """Every window compressed anew under both dictionaries, features and probability by their definitions."""
    import math
    import re

    import zstandard

    rows, labels = labelled(300)
    m = X.fit([(i, t, labels[i][2]) for i, t in rows], 1 / 6)
    params = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=18, chain_log=18, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )

    def length(content, word):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(X.FRAME + b" " + word + b" " + X.FRAME))

    texts = [t for _, t in rows[:12]] + ["", None, "One", "vilescum Idiotic, pathetik!"]
    got = m.scorer().score(texts)
    for t, score in zip(texts, got, strict=True):
        ws = re.findall(rb"[^\x00-\x20!-&(-,./:-@\[-^`{-~]+", (t or "").lower().encode())
        d = [length(m.ordinary, w) - length(m.toxic, w) for w in ws]
        top = (sorted(d, reverse=True)[:3] + [X.LOW] * 3)[:3]
        x = [min(max(v, X.LOW), X.HIGH) for v in top] + [math.log1p(sum(v >= s for v in d)) for s in X.STEPS] + [math.log1p(len(d))]
        z = float(((np.array(x) - m.center) / m.scale) @ m.weights[:-1] + m.weights[-1])
        assert abs(1 / (1 + math.exp(-min(max(z, -30), 30))) - score) < 1e-9
    assert got[12] == got[13] and got[15] > 0.5 > got[12]
    assert X.trained([b" a "], 100, X.TOXIC_FIT) == b" a " and len(X.ordinary_windows(["a b a", "b"])) == 3
