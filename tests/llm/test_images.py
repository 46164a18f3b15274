"""Candidate recall of the image search on strongly edited and cropped copies."""

import numpy as np
import pytest

from seriesforge.llm import op06_images as I


def waves(v):
    """A textured picture: few pairs of them look alike, unlike the rectangles of ``render``."""
    v = np.clip(v / np.sqrt((v * v).mean()), -2.5, 2.5).reshape(16, 4)
    t = np.arange(128) / 128
    across = np.exp(2j * np.pi * 4.5 * v[:, :1] * t)
    down = np.exp(2j * np.pi * (4.5 * v[:, 1:2] * t + v[:, 2:3] / 2)) * (1 + 0.3 * v[:, 3:])
    return I.encode_pgm(128 + 110 * np.tanh((down.T @ across).real / 5.0))


def strongly_edited(image, rng):
    a = I.decode(image)
    top, left, bottom, right = rng.integers(15, 30, 4)
    a = a[top : a.shape[0] - bottom, left : a.shape[1] - right] * 0.6 + 30
    return I.encode_pgm(a + rng.normal(0, 10, a.shape))


@pytest.mark.parametrize(("picture", "least"), [(waves, 40), (I.render, 140)])
def test_strong_edits_are_found_as_by_brute_force(picture, least):
    rng = np.random.default_rng(5)
    images = [picture(rng.normal(size=64)) for _ in range(150)]
    q = [I.keypoints(I.decode(a)) for a in images]
    x = [I.keypoints(I.decode(strongly_edited(a, rng))) for a in images]
    want = {k for k in range(len(q)) if I.compare(*q[k], *x[k])[1] >= I.INLIERS}
    met = set(zip(*(v.tolist() for v in I.candidates(q, x)), strict=True))
    assert len(want) >= least and sum((k, k) in met for k in want) >= 0.97 * len(want)


def test_candidates_of_twelve_matching_corners_with_flipped_bits():
    rng = np.random.default_rng(6)
    trials, corners = 200, I.KEYPOINTS
    q, x = [], []
    for _ in range(trials):
        bits, other = rng.integers(0, 2, (2, corners, I.BITS), dtype=np.uint8)
        other[:12] = bits[:12] ^ (rng.random((12, I.BITS)) < 0.12)
        q.append((None, np.packbits(bits, axis=1))), x.append((None, np.packbits(other, axis=1)))
    met = set(zip(*(v.tolist() for v in I.candidates(q, x)), strict=True))
    assert sum((k, k) in met for k in range(trials)) >= 0.93 * trials


def test_comparison_refuses_only_what_compare_refuses(monkeypatch):
    rng = np.random.default_rng(7)
    images = [I.render(rng.normal(size=64)) for _ in range(40)]
    x = [I.keypoints(I.decode(b)) for a in images for b in (a, strongly_edited(a, rng))]
    x.append((x[0][0][:5], x[0][1][:5]))
    for q in x[:12]:
        want = {k for k, one in enumerate(x) if I.compare(*q, *one)[1] >= I.INLIERS}
        assert want and want <= set(I.promising(q, x).tolist())
    whole = I.candidates(x[:12], x)
    monkeypatch.setattr(I, "MEETINGS", 50)  # a query at a time
    assert all((a == b).all() for a, b in zip(whole, I.candidates(x[:12], x), strict=True))


def test_batched_comparison_equals_pair_by_pair_and_is_fast(monkeypatch):
    import time

    rng = np.random.default_rng(12)
    images = [I.render(rng.normal(size=64)) for _ in range(120)]
    x = [I.keypoints(I.decode(b)) for a in images for b in (a, strongly_edited(a, rng))]
    flat = np.array([[0] * 32, [255] * 32, [0] * 31 + [1]], np.uint8)
    ab, near, ba = I._nearest(flat.view(np.uint64), np.ascontiguousarray(flat[None, :2].view(np.uint64).transpose(2, 1, 0)))
    assert (ab[:, 0].tolist(), near[:, 0].tolist(), ba[:, 0].tolist()) == ([0, 1, 0], [0, 0, 1], [0, 1])  # 256 bits apart is not 0
    monkeypatch.setattr(I, "PAIRS", 7)
    monkeypatch.setattr(I, "GROUP", 50)
    every = np.ones(len(x), dtype=bool)
    got = {(i, j) for i, j in I.confirmable(((i, x[i], every) for i in range(10)), I.Described(x)) if I.compare(*x[i], *x[j])[1] >= I.INLIERS}
    assert got == {(i, j) for i in range(10) for j in range(len(x)) if I.compare(*x[i], *x[j])[1] >= I.INLIERS} and len(got) >= 20
    monkeypatch.undo()
    blobs = [k.tobytes() + d.tobytes() for k, d in x]
    table = I.pd.DataFrame({"side": [0] * 120 + [1] * 240, "rep": [*range(0, 240, 2), *range(240)], "blob": blobs[::2] + blobs})
    at = time.process_time()
    found = I._search(table)
    assert len(found) >= 100 and (time.process_time() - at) / (120 * 240) < 35e-6  # 44 before


def test_few_pairs_need_all_similarities_and_odd_descriptors_count(monkeypatch):
    rng = np.random.default_rng(13)
    images = [I.render(rng.normal(size=64)) for _ in range(60)]
    x = [I.keypoints(I.decode(b)) for a in images for b in (a, strongly_edited(a, rng))]
    kp, d = x[0]
    flat = np.repeat(np.array([[0] * 32, [255] * 32], np.uint8), 6, axis=0)  # 256 bits apart, and 6 equal
    x += [(kp[:9], d[:9]), (kp[:31], d[:31]), (kp, ~d), (kp[:12], flat), (kp[:12], flat[::-1].copy()), (kp, np.repeat(d[:4], 12, axis=0))]
    q = [*x[:20], *x[-6:]]
    whole, tried = I._agreeing, []
    monkeypatch.setattr(I, "_agreeing", lambda a, b: tried.append(len(a)) or whole(a, b))
    every = np.ones(len(x), dtype=bool)
    some = rng.random((len(q), len(x))) < 0.7
    for asked in ([every] * len(q), some, some & (rng.random(some.shape) < 0.5)):  # met by all, most and few
        tried.clear()
        want = {(i, j) for i in range(len(q)) for j in np.flatnonzero(asked[i]).tolist() if I.compare(*q[i], *x[j])[1] >= I.INLIERS}
        got = set(I.confirmable(((i, q[i], asked[i]) for i in range(len(q))), I.Described(x)))
        assert want <= got and len(want) >= 10
        assert all(asked[i][j] for i, j in got)
        assert sum(tried) < 0.1 * sum(m.sum() for m in asked)  # nearly all before


def test_distances_by_products_are_exact():
    rng = np.random.default_rng(14)
    bits = np.concatenate([rng.integers(0, 2, (7, 256)), np.repeat([[1, 0]], 128, axis=1)[:, :256], (np.arange(256) < 254)[None], (np.arange(256) < 2)[None]]).astype(np.uint8)
    mine, own = np.packbits(bits, axis=1), np.packbits(np.concatenate([bits, rng.integers(0, 2, (14, 256), dtype=np.uint8)]), axis=1)
    other = np.ascontiguousarray(own.reshape(4, 6, 32).view(np.uint64).transpose(2, 1, 0))  # 4 images of 6 corners
    packed, add = I._packed(mine, 4)
    far = (packed @ I._planes(other)).astype(np.int64) + add[:, None]
    far = np.stack([far >> 8 * k & 255 for k in range(3)], axis=1).reshape(12, 6, 4)
    true = np.bitwise_count(mine[:, None] ^ own[None]).sum(axis=2, dtype=np.int64).reshape(len(mine), 4, 6).transpose(0, 2, 1)
    assert (far[: len(mine)] == true).all() and (far[len(mine) :] == 255).all()
