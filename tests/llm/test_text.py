import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import op02_tokens as T
from seriesforge.llm import op05_pieces as U
from seriesforge.llm import op07_pitman_yor as L

ALPHABET = ["a", "the", " ", "  ", "\n", "é", "中", "😀", "ing", "\t", "x", "1", "'s", "<|endoftext|>", "\x00", "_", " ", "　", "\x1c", "▁"]


def noise(seed, n, size=40):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(size))) for _ in range(n)]


def test_token_counts_equal_the_library(docs, corpus):
    rows = [t for _, t in corpus] + noise(1, 400) + [" ".join(noise(2, 3000, 12)), "ab" * 30000]
    got = {r.doc_id: r for r in T.count_tokens(docs(list(enumerate(rows)))).collect()}
    tok = T.Counter(T.tokenizer_path()).tok
    for i, t in enumerate(rows):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert T.count_tokens(docs([])).count() == 0


def test_token_pieces_are_safe_and_batches_balanced():
    tok = T.Counter(T.tokenizer_path())
    for t in noise(3, 60, 900):
        assert "".join(T.pieces(t, 50)) == t
        assert sum(tok.encode_lengths(T.pieces(t, 50))) == len(tok.tok.encode(t, add_special_tokens=False))
    sizes = [sum(map(len, b)) for b in T.balanced(noise(4, 500), 300)]
    assert max(sizes) <= 300 and sum(sizes) == sum(map(len, noise(4, 500)))
    tok.memo = dict.fromkeys(map(str, range(T.MEMO + 1)), 1)
    assert tok.lengths(["a b"]).tolist() == [2] and len(tok.memo) < 10


@pytest.fixture(scope="module")
def pieces():
    return U.load(U.model_path())


def brute_pieces(p, text):
    table = {t: (i, s) for t, i, s in p.usable}
    t = U.MARKER + text.replace(" ", U.MARKER)
    best, back = [0.0] + [-np.inf] * len(t), [None] * (len(t) + 1)
    for i in range(len(t)):
        alone = False
        for j in range(i + 1, min(len(t), i + 20) + 1):
            if (v := table.get(t[i:j].encode())) is None:
                continue
            alone |= j == i + 1
            if best[i] + v[1] > best[j]:
                best[j], back[j] = best[i] + v[1], (i, [v[0]])
        if not alone and best[i] + p.low - U.UNKNOWN_PENALTY > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + p.low - U.UNKNOWN_PENALTY, (i, [p.byte_ids[b] for b in t[i].encode()])
    out, j = [], len(t)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def test_pieces_equal_brute_force_viterbi(pieces):
    codec = U.Codec(U.Segmenter(pieces))
    texts = noise(5, 1500)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == (brute_pieces(pieces, t) if t else [])


def test_double_array_holds_exactly_its_keys(pieces):
    trie = U.DoubleArray([(t, i) for t, i, _ in pieces.usable])

    def walk(key):
        s = 0
        for b in key:
            c = trie.base[s] + b
            if trie.check[c] != s:
                return -1
            s = c
        return trie.value[s]

    assert all(walk(t) == i for t, i, _ in pieces.usable)
    keys = {t for t, _, _ in pieces.usable}
    assert all(walk(t + b"\xff") == -1 for t, _, _ in pieces.usable[:2000])
    assert all(walk(t.encode()) == -1 for t in noise(6, 300) if t.encode() not in keys)


def test_round_trip(docs, corpus):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(noise(7, 300))]
    back = {r.doc_id: r.text for r in U.decode(U.encode(docs(rows))).collect()}
    digest = {r.doc_id: r for r in U.digests(docs(rows)).collect()}
    for i, t in rows:
        assert back[i] == (t or "").replace("▁", " ") and digest[i].round_trip == ("▁" not in (t or ""))
    assert digest[next(i for i, t in rows if not t)].n_pieces == 0 and U.digests(docs([])).count() == 0


def exact_tables(count, weight, discount):
    """Mean and deviation of the tables of one dish by the recursion over its customers."""
    row = np.array([1.0])
    for c in range(1, count):
        t = np.arange(1, c + 2)
        row = (np.append(row, 0) * np.maximum(c - discount * t, 0) + np.append(0, row)) / c
    t = np.arange(1, count + 1)
    w = np.where(row > 1e-290, np.log(np.maximum(row, 1e-300)) + t * np.log(weight), -np.inf)
    w = np.exp(w - w.max())
    w /= w.sum()
    return (w * t).sum(), (w * t * t).sum() - (w * t).sum() ** 2


@pytest.mark.parametrize(("count", "weight", "discount"), [(5, 1.2, 0.5), (30, 1.2, 0.5), (1000, 0.12, 0.5), (1024, 20.0, 0.7), (1500, 40.0, 0.3), (3000, 0.3, 0.8), (3000, 60.0, 0.6)])
def test_tables_match_the_exact_conditional(count, weight, discount):
    n, rng = 6000, np.random.default_rng(1)
    t = L.draw_tables(np.full(n, count), np.full(n, weight), discount, rng)
    mean, variance = exact_tables(count, weight, discount)
    assert abs(t.mean() - mean) < 5 * np.sqrt(variance / n) + 0.01 * mean and t.min() >= 1 and t.max() <= count
    assert (L.draw_tables(np.array([0, 1, 2]), np.ones(3), discount, rng)[:2] == [0, 1]).all()


def chain(word, context, c, n, contexts, types, d=0.6, e=0.4):
    totals = L.Totals(int(sum(n)), types, d, e, L.Contexts(np.arange(contexts).astype(np.uint64), np.bincount(context, weights=c, minlength=contexts).astype(np.int64)))
    u = lambda v, k: np.array(v, dtype=k)
    return totals, L.Seating(0, L.pack(n=u(n, np.int64)), L.pack(word=u(word, np.uint32), context=u(context, np.uint16), c=u(c, np.int64)), totals)


def test_gibbs_sweeps_sample_the_exact_posterior():
    import itertools
    import math

    word, context, c = [0, 1, 0], [0, 0, 1], [4, 2, 3]
    totals, seating = chain(word, context, c, [8, 3], 2, 2)
    d, e, th = totals.discount, totals.top_discount, L.STRENGTH
    rise = lambda d, t: d**t * math.gamma(th / d + t) / math.gamma(th / d)
    s, s1 = np.exp(L.stirling(d, 16)), np.exp(L.stirling(e, 16))
    want, mass = np.zeros(5), 0.0
    for t in itertools.product(*(range(1, k + 1) for k in c)):
        top = [1 + t[0] + t[2], 1 + t[1]]  # one customer a word comes without a context
        for t1 in itertools.product(*(range(1, k + 1) for k in top)):
            w = rise(d, t[0] + t[1]) * rise(d, t[2]) * s[4, t[0]] * s[2, t[1]] * s[3, t[2]]
            w *= rise(e, sum(t1)) / math.gamma(th + sum(top)) * s1[top[0], t1[0]] * s1[top[1], t1[1]] * totals.uniform ** sum(t1)
            want, mass = want + w * np.array([*t, *t1]), mass + w
    got, rounds = np.zeros(5), 12_000
    for k in range(rounds):
        tables = np.bincount(seating.context, weights=seating.t, minlength=2)
        seating.sweep(L.draw_shared(tables, seating.tables.sum(), seating.mass.sum(), totals, k))
        got += np.append(seating.t, seating.tables)
    assert np.abs(got / rounds - want / mass).max() < 0.05


def test_predictions_are_a_distribution_and_replay():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 40 * 6, 120))
    word, context, c = key // 6, key % 6, rng.integers(1, 9, len(key))
    n = np.bincount(word, weights=c, minlength=40).astype(int) + rng.integers(1, 4, 40)
    totals, a = chain(word, context, c, n, 6, 40)
    _, b = chain(word, context, c, n, 6, 40)
    past = []
    for k in range(4):
        past.append(L.draw_shared(np.bincount(a.context, weights=a.t, minlength=6), a.tables.sum(), a.mass.sum(), totals, k))
        a.sweep(past[-1])
    for s in past:
        b.sweep(s)
    assert (a.t == b.t).all() and (a.mass == b.mass).all()  # another task seats alike
    sample = L.Sample(np.bincount(a.context, weights=a.t, minlength=6), a.tables.sum(), a.customers.sum())
    parent = a.parent(sample)
    assert abs(parent.sum() - 1) < 1e-9 and parent.min() > 0
    for u in range(6):
        own = np.zeros(41)
        own[a.word[a.context == u]] = (a.c - totals.discount * a.t)[a.context == u]
        p = (own + (L.STRENGTH + totals.discount * sample.tables[u]) * parent) / (L.STRENGTH + totals.contexts.n[u])
        assert abs(p.sum() - 1) < 1e-9 and p.min() > 0


def test_scores_equal_definitions(docs, corpus):
    got = {r.doc_id: r for r in L.score_texts(docs(corpus)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in corpus}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import collections
    import math
    import re

    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), None] for i, t in corpus}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    ppl = {r.held_out: r for r in L.perplexity(L.score_texts(docs(corpus))).collect()}
    # this vocabulary is uniform and closed: nothing to gain over the base, and nothing to lose
    assert ppl[True].perplexity < 1.02 * ppl[True].base_perplexity


def test_word_order_counts(docs):
    rng = random.Random(6)
    follow = {w: [f"w{rng.randrange(80)}" for _ in range(3)] for w in (f"w{i}" for i in range(80))}

    def walk(n):
        out = [f"w{rng.randrange(80)}"]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(i, walk(60)) for i in range(300)]
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    ws = walk(60).split()
    rows += [(held[0], " ".join(ws)), (held[1], " ".join(sorted(ws)))]
    got = L.score_texts(docs(rows))
    by = {r.doc_id: r for r in got.collect()}
    assert by[held[0]].score > by[held[1]].score + 20 and abs(by[held[0]].base_score - by[held[1]].base_score) < 1e-6
    few = {r.doc_id: r.score for r in L.score_texts(docs(rows), contexts=0).collect()}
    assert abs(few[held[0]] - few[held[1]]) < 1e-4  # without context restaurants order is nothing
    ppl = {r.held_out: r for r in L.perplexity(got).collect()}
    assert ppl[True].perplexity < 0.25 * ppl[True].base_perplexity


def test_batches_and_owners_do_not_change_scores(docs, corpus, monkeypatch):
    whole = {r.doc_id: (r.n_known, r.base_score) for r in L.score_texts(docs(corpus)).collect()}
    scores = []
    for size in (4_000_000, 300):
        monkeypatch.setattr(L, "OWNER_TOKENS", size)
        got = {r.doc_id: r for r in L.score_texts(docs(corpus).repartition(3)).collect()}
        assert {i: r.n_known for i, r in got.items()} == {i: v[0] for i, v in whole.items()}
        assert all(abs(got[i].base_score - v[1]) < 1e-6 for i, v in whole.items())
        scores.append(sum(r.score for r in got.values()))
    assert abs(scores[1] / scores[0] - 1) < 0.01  # other draws, the same model


def test_score_edge_tables(docs):
    assert L.score_texts(docs([])).count() == 0
    r = L.score_texts(docs([(5, None), (6, "")])).orderBy("doc_id").collect()
    assert [x.n_tokens for x in r] == [1, 1] and r[0].score == r[1].score
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    x = L.score_texts(docs([(only_held, "a b")])).first()
    assert x.train_tokens == 0 and x.n_known == 0 and x.base_score == 0.0 and np.isfinite(x.score)
    assert L.score_texts(docs([(1, "a"), (1, "a")]).withColumn("batch", F.lit("x"))).count() == 2


def test_rare_contexts_predict_by_all_their_pairs(docs):
    rng = random.Random(9)
    follow = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(2)] for i in range(60)}

    def walk(n):
        out = [f"w{rng.randrange(60)}"]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    rows = [(i, " ".join(walk(40))) for i in range(120)]
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    ws = walk(60)
    rows += [(held[0], " ".join(ws)), (held[1], " ".join(sorted(ws)))]
    by = {r.doc_id: r.score for r in L.score_texts(docs(rows), contexts=3).collect()}
    assert by[held[0]] > by[held[1]] + 20  # all but three contexts are rare


@pytest.mark.parametrize("buckets", [1, 3])
def test_rare_contexts_equal_brute_force(buckets):
    import collections
    from types import SimpleNamespace

    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(8)
    every = np.append(rng.integers(1, 1 << 63, 40).astype(np.uint64), L.END)  # number 40 is the end
    common = np.sort(every[:5])
    shared = SimpleNamespace(value=L.Contexts(common, np.full(5, 9)))
    texts, coded = [], []
    for batch in range(3):
        held = rng.random(12) < 0.3
        of = [[*np.minimum(rng.geometric(0.1, k) - 1, 39), 40] for k in rng.integers(0, 9, 12)]
        word, token = np.unique(np.concatenate(of), return_inverse=True)
        info = pa.table({"doc": np.arange(12) + 100 * batch, "n": [len(t) for t in of], "held": held})
        coded.append((batch, L.pack(word=every[word]), L.planes(token), L._table(info)))
        texts += [(100 * batch + i, t, h) for i, (t, h) in enumerate(zip(of, held, strict=True))]
    coded = pd.DataFrame(coded, columns=["batch", "words", "tokens", "docs"])
    rare = [w for w in range(41) if every[w] not in common]
    count = collections.Counter(p for _, t, h in texts if not h for p in zip([40, *t], t, strict=False) if p[0] in rare)
    asked = pd.concat(L._rare_requests(buckets, shared)(iter([coded])))
    merged = pd.concat([L._rare_merge(buckets, shared)(g) for _, g in asked.groupby("bucket")])
    assert (merged["n1"].sum(), merged["n2"].sum()) == tuple(sum(c == k for c in count.values()) for k in (1, 2))
    over, want = collections.Counter(), collections.Counter()
    for bucket, blob in merged.loc[merged["batch"] == L.EXCESS, ["bucket", "words"]].itertuples(index=False):
        v = L.unpack(blob)
        assert (v["word"] % np.uint64(buckets) == bucket).all()
        over.update(dict(zip(v["word"].tolist(), v["n"].tolist(), strict=True)))
    for (_, w), c in count.items():
        want[int(every[w])] += c - 1
    assert +over == +want and sum(want.values())
    g, d = rng.dirichlet(np.ones(41)), 0.6
    totals = SimpleNamespace(value=L.Totals(100, 41, d, 0.4, shared.value))
    for batch, words, tokens, docs in coded.itertuples(index=False):
        one = pd.DataFrame([(batch, words, tokens, docs)], columns=coded.columns)
        number = {int(h): k for k, h in enumerate(every)}
        parts = next(iter(L._requests(buckets, shared)(iter([one]))))
        rows = []
        for r in parts.itertuples():
            w = L.unpack(r.words)["word"]
            p = np.log10([g[number[int(h)]] for h in w])
            rows.append((r.bucket, L.pack(n=np.ones(len(w), np.uint32), p=p), L.pack(p=np.full(len(L.unpack(r.pairs)["n"]), -1.0)), False))
        answers = pd.DataFrame(rows, columns=["bucket", "words", "pairs", "rare"])
        mine = merged.loc[merged["batch"] == batch, ["bucket", "words", "pairs"]].assign(rare=True)
        got = L._sums(buckets, totals)(one, pd.concat([answers, mine])).set_index("doc_id")["score"]
        for i, t, _ in texts:
            if i // 100 == batch:
                score = 0.0
                for u, w in zip([40, *t], t, strict=False):
                    n, dishes = (sum(v for (x, _), c in count.items() if x == u for v in [k(c)]) for k in (int, bool))
                    c = count[u, w]
                    score += np.log10(((c - d if c else 0) + (L.STRENGTH + d * dishes) * g[w]) / (L.STRENGTH + n)) if u in rare else -1.0
                assert abs(got[i] - score) < 1e-6
