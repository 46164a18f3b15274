"""Copies of images by local descriptors.

1. A binary column of PGM/PPM images is decoded to grey values; equal images
   collapse to one.
2. On three scales, corners are local maxima of the Harris response; the strongest
   ``KEYPOINTS`` stay. A corner's orientation points to the intensity centroid of
   its disc; 256 brightness tests, rotated to it, make its descriptor.
3. Blocks of images meet chunks of queries. In a task, descriptors are joined on
   ``TABLES`` tables keyed by 24 of their bits; pairs of images that meet ``VOTES`` times
   are candidates. No pair leaves the task before it is confirmed.
4. A candidate pair compares all its descriptors exactly: mutual nearest within
   ``HAMMING`` bits. Every pair of matches proposes a shift, turn and scale; the
   proposal that most matches agree with within ``TOLERANCE`` pixels is the
   consensus, and ``INLIERS`` of them confirm a copy, cropped and edited ones too.

Queries are the images whose id is divisible by 50, against all images. Pairs are pairs of
representatives (the smallest id of equal images), and a row of kind ``member`` names the
representative of every image that has corners: equal images are not expanded into pairs. Null,
empty and undecodable images, and images without corners, match nothing and have no row; an
undecodable image is not an error. Repeated ids give a member row each. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import HOT_KEYS, bucket_count, lookup, materialise

QUERY_EVERY = 50
SCALES = (1.0, 2**-0.5, 0.5)
KEYPOINTS, BITS, RADIUS = 48, 256, 12
TABLES, KEY_BITS, VOTES = 12, 24, 3
#: Images and queries of one comparison task, and meetings that it counts at a time (a single query's at least).
IMAGES, QUERIES, MEETINGS = 1024, 2048, 1 << 20
#: Tasks that describe images, where a shuffle has fewer but a quarter of them at least.
DEALT = 64
#: Pairs of equally many matches whose similarities are tried together.
PAIRS = 2048
#: Images whose corners a query's are held against at a time.
GROUP = 1024
#: Images and queries of one matrix product, queries whose distances are searched and pairs whose matches are sorted together.
SIDE_BY_SIDE, ASKED, AT_A_TIME, SORTED = 64, 64, 2, 16384
#: Matches of pairs that wait for others with equally many; so few pairs are left to ``compare``.
WAITING, FEW = 1 << 18, 16
HAMMING, TOLERANCE, INLIERS = 60, 3.0, 8
TURNS = 30

_rng = np.random.default_rng(2011)
_pattern = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 3, RADIUS - 3)
_angles = 2 * np.pi * np.arange(TURNS) / TURNS
_turn = np.stack([np.stack([np.cos(_angles), -np.sin(_angles)], -1), np.stack([np.sin(_angles), np.cos(_angles)], -1)], -2)
#: (turn, bit, point, xy): test points rotated to each orientation.
TESTS = np.rint(np.einsum("tij,bpj->tbpi", _turn, _pattern)).astype(np.int64)
#: Bits of the key of each table.
KEYS = np.stack([_rng.permutation(BITS)[:KEY_BITS] for _ in range(TABLES)])
_disc = [(x, y) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49]
DISC = np.array(_disc)
_HEADER = re.compile(rb"^(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM image; None if it is not one."""
    m = _HEADER.match(image or b"")
    if not m:
        return None
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    body = np.frombuffer(image, dtype=np.uint8)[m.end() :]
    if not w or not h or int(m[4]) > 255 or len(body) < w * h * depth:
        return None
    out = body[: w * h * depth].reshape(h, w, depth).astype(np.float32)
    return out[..., 0] if depth == 1 else out @ np.array([0.299, 0.587, 0.114], dtype=np.float32)


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, after a little smoothing when shrinking."""
    if scale == 1.0:
        return a
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    a = smooth(a, 1)
    y, x = np.linspace(0, a.shape[0] - 1, h), np.linspace(0, a.shape[1] - 1, w)
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 2 if a.shape[0] > 1 else 0), np.minimum(x.astype(int), a.shape[1] - 2 if a.shape[1] > 1 else 0)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def smooth(a: np.ndarray, times: int) -> np.ndarray:
    """Binomial 1-2-1 smoothing in both directions."""
    for _ in range(times):
        p = np.pad(a, 1, mode="edge")
        p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        a = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
    return a


def harris(a: np.ndarray) -> np.ndarray:
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[:, 1:-1], gy[1:-1] = a[:, 2:] - a[:, :-2], a[2:] - a[:-2]
    xx, yy, xy = smooth(gx * gx, 2), smooth(gy * gy, 2), smooth(gx * gy, 2)
    return xx * yy - xy * xy - 0.05 * (xx + yy) ** 2


def keypoints(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) x, y, size in image pixels, and (n, 32) descriptors, strongest first."""
    rows = []
    for scale in SCALES:
        a = resized(grey, scale)
        edge = RADIUS + 1
        if min(a.shape) <= 2 * edge + 2:
            continue
        r = harris(a)
        c = r[edge:-edge, edge:-edge]
        top = c > 1e3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = r[edge + dy : r.shape[0] - edge + dy, edge + dx : r.shape[1] - edge + dx]
                    top &= (c > other) if (dy, dx) < (0, 0) else (c >= other)
        y, x = np.nonzero(top)
        if not len(y):
            continue
        strong = np.argsort(-c[y, x], kind="stable")[:KEYPOINTS]
        y, x = y[strong] + edge, x[strong] + edge
        light = smooth(a, 2)
        disc = a[y[:, None] + DISC[:, 1], x[:, None] + DISC[:, 0]]
        angle = np.arctan2((disc * DISC[:, 1]).sum(axis=1), (disc * DISC[:, 0]).sum(axis=1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        t = TESTS[turn]
        p = light[y[:, None, None] + t[..., 1], x[:, None, None] + t[..., 0]]
        bits = np.packbits(p[..., 0] < p[..., 1], axis=1)
        for i in range(len(y)):
            rows.append((r[y[i], x[i]], x[i] / scale, y[i] / scale, 1 / scale, bits[i]))
    rows.sort(key=lambda v: -v[0])
    rows = rows[:KEYPOINTS]
    if not rows:
        return np.zeros((0, 3), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.array([v[1:4] for v in rows], dtype=np.float32), np.stack([v[4] for v in rows])


def table_keys(desc: np.ndarray) -> np.ndarray:
    """(n, TABLES) keys, the table number in the high bits."""
    bits = np.unpackbits(desc, axis=1).astype(np.int64)
    value = bits[:, KEYS] @ (1 << np.arange(KEY_BITS, dtype=np.int64))
    return value + (np.arange(TABLES, dtype=np.int64) << KEY_BITS)


def consensus(pa_: np.ndarray, pb: np.ndarray) -> tuple[int, complex, complex]:
    """Most matches that one similarity explains, and its factor and shift (points as complex numbers)."""
    n = len(pa_)
    if n < 2:
        return n if n else 0, 1 + 0j, 0j
    i, j = np.triu_indices(n, 1)
    d = pa_[j] - pa_[i]
    ok = np.abs(d) > 8
    i, j, d = i[ok], j[ok], d[ok]
    if not len(i):
        return 0, 1 + 0j, 0j
    f = (pb[j] - pb[i]) / d
    ok = (np.abs(f) > 0.4) & (np.abs(f) < 2.5)
    i, f = i[ok], f[ok]
    if not len(i):
        return 0, 1 + 0j, 0j
    s = pb[i] - f * pa_[i]
    agree = (np.abs(f[:, None] * pa_[None, :] + s[:, None] - pb[None, :]) < TOLERANCE).sum(axis=1)
    k = int(agree.argmax())
    return int(agree[k]), complex(f[k]), complex(s[k])


def compare(kp_a: np.ndarray, d_a: np.ndarray, kp_b: np.ndarray, d_b: np.ndarray) -> tuple[int, int, float, float]:
    """Mutual matches, inliers, scale and turn (degrees) of the best similarity from a to b."""
    if not len(d_a) or not len(d_b):
        return 0, 0, 1.0, 0.0
    far = np.bitwise_count(d_a.view(np.uint64)[:, None, :] ^ d_b.view(np.uint64)[None, :, :]).sum(axis=2, dtype=np.int64)
    ab, ba = far.argmin(axis=1), far.argmin(axis=0)
    i = np.arange(len(d_a))
    good = (ba[ab] == i) & (far[i, ab] <= HAMMING)
    a, b = kp_a[i[good]], kp_b[ab[good]]
    n, f, _ = consensus(a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1])
    return int(good.sum()), n, abs(f), math.degrees(math.atan2(f.imag, f.real))


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a similarity may explain ``INLIERS`` of the matches of each pair; a, b: (pairs, n, 2) points.

    The bounds of ``consensus`` with some slack for rounding, so that a pair it confirms is never refused.
    """
    n, limit = a.shape[1], np.float32((TOLERANCE * 1.01) ** 2)
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), PAIRS):
        ax, ay, bx, by = (np.ascontiguousarray(v[at : at + PAIRS, :, k].T) for v in (a, b) for k in (0, 1))  # (n, pairs)
        hit, u, v, t = np.zeros(ax.shape[1], dtype=bool), np.empty_like(ax), np.empty_like(ax), np.empty_like(ax)
        for i in range(n - 1):
            x, y, p, q = ax - ax[i], ay - ay[i], bx - bx[i], by - by[i]
            dd = x * x + y * y
            inverse = 1 / np.maximum(dd, np.float32(1e-6))
            ratio = (p * p + q * q) * inverse
            re, im = (x * p + y * q) * inverse, (x * q - y * p) * inverse
            ok = (dd > 63.9) & (ratio > 0.159) & (ratio < 6.26) & ~hit
            for j in range(i + 1, n):
                if not ok[j].any():
                    continue
                np.multiply(re[j], x, out=u)
                np.multiply(im[j], y, out=t)
                u -= t
                u -= p
                np.multiply(re[j], y, out=v)
                np.multiply(im[j], x, out=t)
                v += t
                v -= q
                u *= u
                v *= v
                u += v
                hit |= ok[j] & ((u < limit).view(np.uint8).sum(axis=0, dtype=np.uint8) >= INLIERS)
        out[at : at + PAIRS] = hit
    return out


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two matches of each pair may be the first of ``INLIERS`` that one similarity explains; a, b: (pairs, n, 2) points.

    Matches p and l of a similarity f lie within ``2 * TOLERANCE`` of f (a_l - a_p) = b_l - b_p, so f is in a disc
    for each l, and the discs of all its matches, and the squares around them, meet. Few p and k can be the first two of ``INLIERS``. Refuses no more than ``_agreeing``.
    """
    n, reach, out = a.shape[1], np.float32(2 * TOLERANCE * 1.01), np.zeros(len(a), dtype=bool)
    last = n - INLIERS + 1  # that many matches can be the first
    whole, bits = np.empty((9, n, min(PAIRS, len(a))), np.float32), np.empty((2, n, min(PAIRS, len(a))), bool)  # memory is touched once
    for at in range(0, len(a), PAIRS):
        ax, ay, bx, by = (np.ascontiguousarray(z[at : at + PAIRS, :, k].T) for z in (a, b) for k in (0, 1))  # (n, pairs)
        hit = np.zeros(ax.shape[1], dtype=bool)
        for p in range(last):
            x, y, u, v, re, im, size, s, t = whole[:, : n - p - 1, : len(hit)]
            for z, of in ((x, ax), (y, ay), (u, bx), (v, by)):
                np.subtract(of[p + 1 :], of[p], out=z)
            np.multiply(x, x, out=s)
            np.multiply(y, y, out=t)
            s += t
            np.maximum(s, np.float32(1e-6), out=s)
            np.divide(np.float32(1), s, out=size)
            for z, one, two, add in ((re, (x, u), (y, v), np.add), (im, (x, v), (y, u), np.subtract)):
                np.multiply(*one, out=s)
                np.multiply(*two, out=t)
                add(s, t, out=z)
                z *= size
            np.sqrt(size, out=size)
            size *= reach
            left, right, low, high = x, y, u, v  # squares around the discs
            for z, edge, centre in ((left, np.subtract, re), (right, np.add, re), (low, np.subtract, im), (high, np.add, im)):
                edge(centre, size, out=z)
            for k in range(last - p):
                ok, t = bits[:, : n - p - k - 2, : len(hit)]
                np.less_equal(left[k + 1 :], right[k], out=ok)
                for z, edge, other in ((right, np.greater_equal, left), (low, np.less_equal, high), (high, np.greater_equal, low)):
                    ok &= edge(z[k + 1 :], other[k], out=t)
                hit |= np.add.reduce(ok.view(np.uint8), axis=0, dtype=np.uint8) >= INLIERS - 2
        out[at : at + PAIRS] = hit
    return out


class Described:
    """Descriptors and points of images, those with equally many corners side by side in groups of ``GROUP``."""

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]]) -> None:
        size = np.array([len(d) for _, d in x], dtype=np.int64)
        self.groups = []
        for n in np.unique(size):
            every = np.flatnonzero(size == n)
            for at in range(0, len(every), GROUP):
                own = every[at : at + GROUP]
                words = np.stack([x[k][1] for k in own]).view(np.uint64)
                self.groups.append((own, np.ascontiguousarray(words.transpose(2, 1, 0)), np.stack([x[k][0][:, :2] for k in own])))


def _nearest(mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest corner of each image to each of the query's, its distance, and nearest of the query's to it (the first of equals).

    mine: (corners, words); other: (words, corners, images). Distances beyond 64 may be one short (256 would not fit a byte).
    """
    _, n, images = other.shape
    tmp, far, count = np.empty((n, images), np.uint64), np.empty((n, images), np.uint8), np.empty((n, images), np.uint8)
    code, best = np.empty((n, images), np.uint16), np.full((n, images), np.iinfo(np.uint16).max, np.uint16)
    ab, j = np.empty((len(mine), images), np.uint16), np.arange(n, dtype=np.uint16)[:, None]
    for i, words in enumerate(mine):
        np.bitwise_xor(other[0], words[0], out=tmp)
        np.bitwise_count(tmp, out=far)
        for w in range(1, len(words)):
            np.bitwise_xor(other[w], words[w], out=tmp)
            np.bitwise_count(tmp, out=count)
            if w == len(words) - 1:
                np.minimum(count, 63, out=count)
            np.add(far, count, out=far)
        code[...] = far
        code <<= 6  # distance, then place
        code += np.uint16(i)
        np.minimum(best, code, out=best)
        code += j - np.uint16(i)
        code.min(axis=0, out=ab[i])
    return ab & 63, ab >> 6, best & 63


def _matches(q: tuple[np.ndarray, np.ndarray], groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], met: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Images of the mask ``met`` with ``INLIERS`` mutual matches or more, by their number: positions, and matched points of both."""
    kp, desc = q
    mine = desc.view(np.uint64)
    for own, other, points in groups:
        pick = np.flatnonzero(met[own])
        if not len(pick):
            continue
        if len(pick) < len(own):
            own, other, points = own[pick], np.ascontiguousarray(other[:, :, pick]), points[pick]
        ab, near, ba = _nearest(mine, other)
        good = (np.take_along_axis(ba, ab.astype(np.int64), axis=0) == np.arange(len(mine))[:, None]) & (near <= HAMMING)
        n_good, good, ab = good.sum(axis=0), good.T, ab.T
        for m in np.unique(n_good[n_good >= INLIERS]):
            of = np.flatnonzero(n_good == m)
            row, i = np.nonzero(good[of])
            yield int(m), own[of], kp[i, :2].reshape(len(of), m, 2), points[of[row], ab[of[row], i]].reshape(len(of), m, 2)


@cache
def _blas():
    """Reads and sets the threads of numpy's OpenBLAS, or None where it has another BLAS."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        for name in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            with suppress(OSError, AttributeError):
                lib = ctypes.CDLL(str(path))
                return getattr(lib, name.format("get")), getattr(lib, name.format("set"))
    return None


@contextmanager
def one_thread() -> Iterator[None]:
    """Small products: more threads would wait on cores that other tasks use."""
    get, put = _blas() or (lambda: 1, lambda _: None)
    before = get()
    if before > 1:
        put(1)
    try:
        yield
    finally:
        if before > 1:
            put(before)


def _planes(other: np.ndarray) -> np.ndarray:
    """Bits of the corners of images, (words, corners, images), as a matrix of a row a bit."""
    octets = np.ascontiguousarray(other.transpose(1, 2, 0)).view(np.uint8).reshape(-1, BITS // 8)
    return np.unpackbits(octets, axis=1).astype(np.float32).T


def _packed(desc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose product with ``_planes``, with a number added, holds the distances of three corners 256 apart; a missing corner is 255 from all."""
    bits, add = np.zeros((3 * rows, BITS), np.float32), np.full(3 * rows, 255, np.int32)
    own = np.unpackbits(desc, axis=1)
    bits[: len(own)], add[: len(own)] = 1 - 2 * own.astype(np.float32), own.sum(axis=1)
    return np.einsum("rlk,l->rk", bits.reshape(rows, 3, -1), np.array([1, 256, 65536], np.float32)), add.reshape(rows, 3) @ np.array([1, 256, 65536], np.int32)


def _exact(q: list[tuple[np.ndarray, np.ndarray]], x: Described) -> np.ndarray:
    """Queries whose distances to all images are exact in ``_packed``: below 256, and no sum of a product beyond 2 ** 24."""
    desc = np.concatenate([np.zeros((0, BITS // 64), np.uint64), *(d.view(np.uint64) for _, d in q)])
    weight = np.bitwise_count(desc).sum(axis=1, dtype=np.int64)
    odd = (weight < 2) | (weight > BITS - 2)
    for _, other, _ in x.groups:
        odd |= np.isin(~desc[:, 0], other[0])
    out = np.ones(len(q), dtype=bool)
    out[np.repeat(np.arange(len(q)), [len(d) for _, d in q])[odd]] = False
    return out


def _mutual(q: list[tuple[np.ndarray, np.ndarray]], other: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Matches of all queries and images: first query, first image, and matches as query, image, corners (6 bits each).

    All mutual matches within ``HAMMING`` bits, and those that tie with them.
    """
    _, n, images = other.shape
    rows = -(-max(len(d) for _, d in q) // 3)
    packed = [tuple(np.concatenate(v) for v in zip(*(_packed(d, rows) for _, d in q[k : k + ASKED]), strict=True)) for k in range(0, len(q), ASKED)]
    step, most = rows * n * min(images, SIDE_BY_SIDE), min(len(q), AT_A_TIME) * rows * n * min(images, SIDE_BY_SIDE)
    product = np.empty(min(len(q), ASKED) * step, np.float32)  # memory is touched once, and a core's cache holds the rest
    whole, limit, equal, some = np.empty(most, np.int32), np.empty(4 * most, np.uint8), np.empty(4 * most + 7, bool), np.empty(most // 2 + 1, bool)
    place: dict[int, np.ndarray] = {}  # query, image and corners of each byte
    for at in range(0, images, SIDE_BY_SIDE):
        bits = _planes(other[:, :, at : at + SIDE_BY_SIDE])
        g = bits.shape[1] // n
        if g not in place:
            query, row, j, image, lane = np.ogrid[:AT_A_TIME, :rows, :n, :g, :4]
            place = {g: ((query * SIDE_BY_SIDE + image) << 12 | (3 * row + lane) << 6 | j).ravel()}
        for k, (a, add) in enumerate(packed):
            every = product[: len(a) * n * g]
            with one_thread():
                np.matmul(a, bits, out=every.reshape(len(a), n * g))
            for some_of in range(0, len(a) // rows, AT_A_TIME):
                part = every[some_of * rows * n * g :][: AT_A_TIME * rows * n * g]
                size = 4 * len(part)
                np.copyto(whole[: len(part)], part, casting="unsafe")
                far = whole[: len(part)].reshape(-1, n * g)
                far += add[some_of * rows :][: len(far), None]
                d = far.view(np.uint8).reshape(-1, rows, n, g, 4)
                least, best = d.min(axis=2, keepdims=True), d.min(axis=1, keepdims=True)
                best = np.minimum(np.minimum(best[..., 0], best[..., 1]), best[..., 2])
                for z in (least, best):  # beyond them is no match
                    z += 1
                    z *= z <= HAMMING + 1
                best = (best * np.uint32(0x010101)).view(np.uint8).reshape(-1, 1, n, g, 4)  # the fourth byte of d is 0, and never below 0
                np.less(d, np.minimum(least, best, out=limit[:size].reshape(d.shape)), out=equal[:size].reshape(d.shape))
                end = -(-size // 8)
                equal[size : 8 * end] = False
                words = equal[: 8 * end].view(np.uint64)  # eight bytes at a time: few hold a match
                hold = np.flatnonzero(np.not_equal(words, 0, out=some[:end]))
                hit = np.flatnonzero(words[hold].view(bool))
                yield k * ASKED + some_of, at, place[g][hold[hit >> 3] * 8 + (hit & 7)]


def _crowd(
    asked: list[tuple[int, tuple[np.ndarray, np.ndarray], np.ndarray]], own: np.ndarray, other: np.ndarray, points: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_matches`` gives, of queries that met most images of a group, with the position of each pair's query.

    Of matches that tie more may stay than ``compare`` counts.
    """
    at_query, met = np.array([at for at, _, _ in asked]), np.stack([m[own] for _, _, m in asked]).ravel()
    most, n = max(len(d) for _, (_, d), _ in asked), other.shape[1]
    flat = lambda kp: np.ascontiguousarray(kp, np.float32).view(np.complex64).ravel()
    mine = flat(np.stack([np.pad(kp[:, :2], ((0, most - len(kp)), (0, 0))) for _, (kp, _), _ in asked]))
    theirs = flat(points)
    held: list[np.ndarray] = []
    pairs = 0

    def sort() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        code = np.sort(np.concatenate(held))
        held.clear()
        first = np.ones(len(code), dtype=bool)
        np.not_equal(code[1:] >> 6, code[:-1] >> 6, out=first[1:])  # a query's corner matches the first of equals
        code = code[first]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] >> 12 != code[:-1] >> 12])) if len(code) else np.zeros(0, np.int64)
        count, pair = np.diff(starts, append=len(code)), code[starts] >> 12
        ok = met[pair] & (count >= INLIERS)
        starts, count, pair = starts[ok], count[ok], pair[ok]
        query, image = np.divmod(pair, len(own))
        order = np.argsort(count, kind="stable")
        ends = np.searchsorted(count[order], np.arange(INLIERS, most + 2))
        for m, lo, hi in zip(range(INLIERS, most + 1), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if lo < hi:
                of = order[lo:hi]
                c = code[starts[of][:, None] + np.arange(m)]
                a, b = mine[query[of][:, None] * most + (c >> 6 & 63)], theirs[image[of][:, None] * n + (c & 63)]
                yield m, at_query[query[of]], own[image[of]], a.view(np.float32).reshape(-1, m, 2), b.view(np.float32).reshape(-1, m, 2)

    for first_query, first_image, code in _mutual([q for _, q, _ in asked], other):
        query, image = np.divmod(code >> 12, SIDE_BY_SIDE)
        held.append(((query + first_query) * len(own) + image + first_image) << 12 | code & 4095)
        pairs += AT_A_TIME * SIDE_BY_SIDE
        if pairs >= SORTED:
            pairs = 0
            yield from sort()
    if held:
        yield from sort()


def confirmable(asked: Iterator[tuple[int, tuple[np.ndarray, np.ndarray], np.ndarray]], x: Described) -> Iterator[tuple[int, int]]:
    """(query, image) positions that ``compare`` may confirm; only pairs it refuses are left out.

    ``asked``: position, corners and mask of images of each query. Pairs of equally many matches wait for one another.
    Queries that met half of a group's images or more are held against all of it at once.
    """
    fresh, likely = defaultdict(list), defaultdict(list)

    def taken(held: dict[int, list], m: int, least: int) -> list[np.ndarray]:
        """All pairs of m matches that wait, once they are ``least``."""
        return [np.concatenate(v) for v in zip(*held.pop(m), strict=True)] if m in held and sum(len(v[0]) for v in held[m]) >= least else []

    def screen(m: int, least: int) -> Iterator[tuple[int, int]]:
        if pairs := taken(fresh, m, least):
            may = _possible(*pairs[2:]) if len(pairs[0]) > FEW else slice(None)
            likely[m].append([v[may] for v in pairs])
        if not (pairs := taken(likely, m, least)):
            return
        for order in (np.arange(m)[::-1], np.argsort(np.arange(m) * 5 % 7, kind="stable"), None):  # other discs in another order
            if len(pairs[0]) > FEW:
                may = _agreeing(*pairs[2:]) if order is None else _possible(*(v[:, order] for v in pairs[2:]))
                pairs = [v[may] for v in pairs]
        yield from zip(pairs[0].tolist(), pairs[1].tolist(), strict=True)

    def found() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        every = list(asked)
        exact = _exact([q for _, q, _ in every], x)
        for group in x.groups:
            dense = [e and 2 * met[group[0]].sum() >= len(group[0]) for e, (_, _, met) in zip(exact, every, strict=True)]
            if any(dense):
                yield from _crowd([one for one, d in zip(every, dense, strict=True) if d], *group)
            for (at, q, met), d in zip(every, dense, strict=True):
                if not d:
                    for m, own, a, b in _matches(q, [group], met):
                        yield m, np.full(len(own), at), own, a, b

    for m, *pairs in found():
        fresh[m].append(pairs)
        yield from screen(m, WAITING // m)
    for m in [*{*fresh, *likely}]:
        yield from screen(m, 0)


def promising(q: tuple[np.ndarray, np.ndarray], x: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Positions of the images that ``compare`` may confirm for a query."""
    return np.array(sorted(j for _, j in confirmable(iter([(0, q, np.ones(len(x), dtype=bool))]), Described(x))), dtype=np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images to digests and descriptors; images without corners drop out. Pixels go no further."""
    for b in batches:
        ids, digests, blobs = [], [], []
        for i, image in zip(b.column("image_id").to_pylist(), b.column("image").to_pylist(), strict=True):
            grey = decode(image)
            if grey is None:
                continue
            kp, d = keypoints(grey)
            if len(d):
                ids.append(i), digests.append(hashlib.sha256(image).digest()), blobs.append(kp.tobytes() + d.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["image_id", "k", "blob"])


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (12 + BITS // 8)
    return np.frombuffer(blob, np.float32, 3 * n).reshape(n, 3), np.frombuffer(blob, np.uint8, offset=12 * n).reshape(n, BITS // 8)


def _postings(described: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Table keys of images and the image of each, ordered by key."""
    keys = [np.unique(table_keys(d)) for _, d in described]
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    order = np.argsort(key, kind="stable")
    return key[order], owner[order]


def candidates(q: list[tuple[np.ndarray, np.ndarray]], x: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of (query, image) pairs that meet ``VOTES`` times in the tables."""
    xk, xo = _postings(x)
    found = []
    qk, qo = _postings(q)
    order = np.argsort(qo, kind="stable")
    lo, hi = (np.searchsorted(xk, qk, side)[order] for side in ("left", "right"))  # sorted keys are found faster
    qo = qo[order]
    ends = np.searchsorted(qo, np.arange(len(q) + 1))
    upto = np.concatenate([[0], np.cumsum(hi - lo)])[ends]  # meetings before each query
    at = 0
    while at < len(q):  # whole queries, so that all votes of a pair are counted together
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + MEETINGS, "right")) - 1)
        part = slice(ends[at], ends[to])
        n = hi[part] - lo[part]
        met = np.repeat((qo[part] - at) * len(x), n) + xo[np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if len(met) * 8 > (to - at) * len(x):
            pair = np.flatnonzero(np.bincount(met, minlength=1) >= VOTES)
        else:  # few meetings of many pairs
            pair, votes = np.unique(met, return_counts=True)
            pair = pair[votes >= VOTES]
        found.append(pair + at * len(x))
        at = to
    pair = np.concatenate([np.zeros(0, np.int64), *found])
    return pair // max(1, len(x)), pair % max(1, len(x))


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of images against one chunk of queries: tables, then exact comparison."""
    asked = pdf["side"].to_numpy() == 0
    qid, xid = pdf["rep"].to_numpy()[asked], pdf["rep"].to_numpy()[~asked]
    q, x = ([_unblob(b) for b in pdf["blob"][m]] for m in (asked, ~asked))
    rows = []
    asks, has = candidates(q, x)
    described, ends = Described(x), np.searchsorted(asks, np.arange(len(q) + 1))  # pairs come by query

    def asked_of() -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], np.ndarray]]:
        for i in np.flatnonzero(np.diff(ends)).tolist():
            met = np.zeros(len(x), dtype=bool)
            met[has[ends[i] : ends[i + 1]]] = True
            yield i, q[i], met

    for i, j in confirmable(asked_of(), described):
        if qid[i] != xid[j]:
            found = compare(*q[i], *x[j])
            if found[1] >= INLIERS:
                rows.append((qid[i], xid[j], *found))
    return pd.DataFrame(rows, columns=["query_rep", "match_rep", "n_matches", "n_inliers", "scale", "turn"])


def find_copies(media: DataFrame, id_col: str = "image_id", image_col: str = "image", every: int = QUERY_EVERY) -> DataFrame:
    """Rows of kind ``copy`` and ``member``: ``kind, query_id, match_id, n_matches, n_inliers, scale, turn``.

    copy: a confirmed copy ``match_id`` of the query image ``query_id``, both representatives;
    member: ``match_id`` is the representative of the image ``query_id``. A query's copies are its
    representative's, and their members.
    """
    src = media.select(F.col(id_col).cast("bigint").alias("image_id"), F.col(image_col).alias("image")).where("image is not null and image_id is not null")
    buckets = bucket_count(media.sparkSession)
    dealt = src.repartition(max(buckets, min(4 * buckets, DEALT)))  # describing takes long: no task of many images
    described = materialise(dealt.mapInArrow(_describe, "image_id long, k binary, blob binary"))
    ask = F.max((F.pmod("image_id", F.lit(every)) == 0).cast("int")).alias("asked")
    index = materialise(described.groupBy("k").agg(F.min("image_id").alias("rep"), F.first("blob").alias("blob"), F.count(F.lit(1)).alias("images"), ask))
    hot = index.where(F.col("images") >= max(2, described.count() // HOT_KEYS)).select("k")  # one picture may be a third of all
    member = lookup(described.select("image_id", "k"), "k", index.select("k", "rep"), hot).select("image_id", "rep")
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("asked").alias("q")).first()
    blocks, chunks = max(1, -(-size["n"] // IMAGES)), max(1, -(-(size["q"] or 0) // QUERIES))
    deal = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = index.select("rep", "blob", F.lit(1).alias("side"), deal(blocks, 1).alias("block"), every_one(chunks).alias("chunk"))
    q = index.where("asked = 1").select("rep", "blob", F.lit(0).alias("side"), every_one(blocks).alias("block"), deal(chunks, 2).alias("chunk"))
    schema = "query_rep long, match_rep long, n_matches long, n_inliers long, scale double, turn double"
    both = x.unionByName(q.select(x.columns)).repartition(max(bucket_count(media.sparkSession), blocks * chunks), "block", "chunk")
    seen = both.groupBy("block", "chunk").applyInPandas(_search, schema)
    copies = seen.withColumnsRenamed({"query_rep": "query_id", "match_rep": "match_id"}).select(F.lit("copy").alias("kind"), "*")
    none = {"n_matches": F.lit(None).cast("bigint"), "n_inliers": F.lit(None).cast("bigint"), "scale": F.lit(None).cast("double"), "turn": F.lit(None).cast("double")}
    members = member.select(F.lit("member").alias("kind"), F.col("image_id").alias("query_id"), F.col("rep").alias("match_id")).withColumns(none)
    return copies.unionByName(members)


SIDE, SHAPES = 128, 16


def render(vector: np.ndarray) -> bytes:
    """A deterministic picture of a vector: overlapping rectangles placed by groups of four components.

    Near vectors give slightly edited pictures, so a table of vectors serves as a media table.
    """
    v = np.resize(np.asarray(vector, dtype=np.float64), 4 * SHAPES).reshape(SHAPES, 4)
    scale = np.sqrt((v * v).mean()) or 1.0
    v = np.clip(v / scale, -2.5, 2.5)
    a = np.full((SIDE, SIDE), 128.0)
    for x, y, size, tone in v:
        cx, cy = SIDE / 2 + x * SIDE / 6, SIDE / 2 + y * SIDE / 6
        w, h = 10 + abs(size) * 9, 10 + abs(tone) * 9
        a[max(0, round(cy - h)) : max(0, round(cy + h)), max(0, round(cx - w)) : max(0, round(cx + w))] += 45 * (1 if size > 0 else -1) + 12 * tone
    return encode_pgm(a)


#: Every tenth picture of the media table has an edited crop; its id is that of the picture plus ``COPY``.
CROP_EVERY, COPY = 10, 1 << 40


def edited(image: bytes, salt: int) -> bytes:
    """A crop of a picture with less contrast, more light and a little noise."""
    a = decode(image)
    top, left, bottom, right = (4 + (salt >> k) % 11 for k in (0, 3, 6, 9))
    a = a[top : a.shape[0] - bottom, left : a.shape[1] - right] * 0.9 + 10
    return encode_pgm(a + np.random.default_rng(salt & 0xFFFFFFFF).normal(0, 2, a.shape))


def media_of(vectors: DataFrame) -> DataFrame:
    """A media table ``image_id, image``: a picture of each vector and edited crops of every tenth.

    Vectors that are null or hold no finite values have no picture (a null image).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                x = np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) if v.is_valid else np.zeros(0)
                image = render(x) if len(x) and np.isfinite(x).all() else None
                ids.append(i), out.append(image)
                if image and i is not None and i % CROP_EVERY == 0:
                    ids.append(i + COPY), out.append(edited(image, i * 2654435761 + 12345))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "image_id long, image binary")


def query(spark, sf_dir: str) -> DataFrame:
    return find_copies(media_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
