"""Rows without an id come through the dedup operators."""

import hashlib

import corpus_pipeline as C

from seriesforge.llm import op03_suffix as S

TEXT = "".join(chr(97 + (i * 7) % 26) + str(i) for i in range(60))


def test_repeats_keep_rows_without_an_id(docs):
    df = docs([(1, TEXT), (2, "new " + TEXT), (None, TEXT), (None, None)])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in S.dedup_digest(df).collect()), key=str)
    whole, empty, new = (hashlib.sha256(t.encode()).hexdigest() for t in (TEXT, "", "new "))
    n = len(TEXT)
    assert got == sorted([(1, n, 0, whole), (2, n + 4, n, new), (None, n, 0, whole), (None, 0, 0, empty)], key=str)
    assert sorted((r.text for r in S.remove_repeats(df).where("doc_id is null").collect()), key=str) == sorted([TEXT, None], key=str)


def test_near_dedup_stage_keeps_rows_without_an_id(spark, docs):
    df = docs([(1, TEXT), (2, TEXT), (None, TEXT), (None, TEXT), (None, None)])
    assert sorted((r.doc_id for r in C.near_dedup(spark, df, "").collect()), key=str) == [1, None, None, None]
