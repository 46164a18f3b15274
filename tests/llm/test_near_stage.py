"""The near-dedup stage links at a similarity of 0.80, not at op10's 0.85."""

import random

import corpus_pipeline as C
import numpy as np
from conftest import word_text
from test_dedup import brute_near, shingles

from seriesforge.llm import op10_minhash as M


def test_stage_equals_brute_force_at_eighty_percent(spark, docs):
    rng, rows = random.Random(11), []
    for k in range(60):
        ws = word_text(rng, 260, 5000).split()
        rows.append((10 * k, " ".join(ws)))
        for c in range(1, 4):  # 3 to 5 words replaced, far apart: similarity 0.89, 0.85, 0.82
            cut = list(ws)
            for at in range(2 + c):
                cut[20 + 40 * at] = f"edit{rng.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(cut)))
    at_80, at_85 = ({i for i, v in brute_near(rows, num).items() if v[2]} for num in (80, 85))
    between = sum(0.80 <= len(shingles(rows[k][1]) & shingles(rows[k + 3][1])) / len(shingles(rows[k][1]) | shingles(rows[k + 3][1])) < 0.85 for k in range(0, len(rows), 4))
    got = {r.doc_id for r in C.near_dedup(spark, docs(rows), "").collect()}
    assert between >= 30 and len(at_80) < len(at_85) and got == at_80
    assert (1 - 0.8**C.NEAR_ROWS) ** C.NEAR_BANDS < 5e-5


def test_intersections_by_ranges_equal_set_intersections(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64) // np.uint64(2**58) * np.uint64(2**58)) for _ in range(12)]
    monkeypatch.setattr(M, "SLICE", 16)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (M._intersections(sets[:5], sets[5:]) == want[:5, 5:]).all()
    assert (np.triu(M._intersections(sets, sets), 1) == np.triu(want, 1)).all()
