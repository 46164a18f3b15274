"""The pipeline against its stages applied by brute force where they are exact."""

import zlib

import corpus_pipeline as C
from tests_support import brute_near_kept, brute_suffix_texts

from seriesforge.llm import registry


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows, seen = {r.doc_id: r.text for r in docs.collect()}, []
    for name, stage in C.STAGES:
        out = C.materialise(stage(spark, docs, sf))
        got = {r.doc_id: getattr(r, "text", None) for r in out.collect()}
        if name in ("toxicity", "quality"):
            assert set(got) <= set(rows) and len(got) > 0.5 * len(rows) and all(got[i] == rows[i] for i in got)
        if name == "near_dedup":
            assert set(got) == brute_near_kept(rows)
        if name == "suffix_dedup":
            assert got == brute_suffix_texts(rows)
        if name != "packing":
            assert out.columns == names
            rows = got
        else:
            assert set(got) == set(rows)
        docs = out
        seen.append(name)
    assert seen == ["toxicity", "quality", "near_dedup", "suffix_dedup", "packing"]
    assert C.run(spark, sf).count() == docs.count()


def test_clean_documents_stay(spark, sf):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in C.STAGES[:2]:
        kept = stage(spark, kept, sf)
    kept = {r.doc_id for r in kept.collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_registered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
    assert zlib.crc32(b"0") % 10 in range(10) and set(registry.oracle_sql()) <= set(registry.queries())


def test_stages_on_odd_tables(spark, sf, docs, clashing):
    clean = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("text").collect()
    odd = [(k, r.text) for k, r in enumerate(clean)] + [(0, clean[0].text), (1, clean[5].text), (None, clean[2].text), (None, None), (900, None), (901, ""), (902, clean[3].text * 40)]
    for table in (docs([]), docs(odd), clashing(odd)):
        rows = table.count()
        for name, stage in C.STAGES:
            out = C.materialise(stage(spark, table, sf))
            if name == "packing":
                assert out.count() >= rows
            else:
                assert out.columns == table.columns and out.count() <= rows
                rows = out.count() if name != "packing" else rows
            table = out
