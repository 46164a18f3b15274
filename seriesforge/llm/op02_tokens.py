"""Token counts of whole texts, lengths only.

Texts are split at safe boundaries: between a character that is not white space
and a single space that a non-space character follows. The tokenizer's pattern
never joins the two sides there (no alternative matches a non-space character
and then white space, and its look-ahead only concerns runs of white space), so a
text's count is the sum over its parts. Parts repeat, so each distinct part is
encoded once for a task and remembered, new parts going to the tokenizer in batches
balanced by bytes. Texts with other runs of white space are split where it is
safe and encoded in pieces of bounded size.

Special strings inside a text hold no white space, so no boundary cuts one, and
the tokenizer treats them as it does by default. Null texts are empty. Empty
texts have no tokens; an empty table gives an empty result. Repeated rows and extra columns are harmless.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import small_text_batches

#: Tokens above which a document is marked.
LIMIT = 1024
#: Bytes of one call to the tokenizer and of a piece of a long text.
BATCH_BYTES, PIECE_CHARS = 1 << 18, 1 << 14
#: Parts that a worker remembers; the memory starts anew beyond.
MEMO = 600_000
#: White space next to white space, at the start or at the end: the single-space rule does not apply.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
_SAFE = re.compile(r"(?<=\S)(?=\s)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def balanced(parts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive parts of at most ``limit`` bytes a batch (one longer part is a batch)."""
    size = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), np.int64, len(parts))
    upto, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(parts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, side="right")) - 1)
        yield parts[at:end]
        at = end


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """A text cut at safe boundaries into pieces of about ``most`` characters (more if it has none)."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class Counter:
    """A tokenizer with a bounded memory of part lengths."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[str, int] = {}

    def encode_lengths(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for batch in balanced(parts):
            out += [len(e) for e in self.tok.encode_batch_fast(batch, add_special_tokens=False)]
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = np.zeros(len(texts), dtype=np.int64)
        split: list[tuple[int, list[str]]] = []
        whole: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if _UNEVEN.search(t):
                whole.append((i, pieces(t)))
            else:
                head, *rest = t.split(" ")
                split.append((i, [head, *[" " + r for r in rest]]))
        new = list({p for _, ps in split for p in ps if p not in memo})
        memo.update(zip(new, self.encode_lengths(new), strict=True))
        for i, ps in split:
            out[i] = sum(map(memo.__getitem__, ps))
        got = iter(self.encode_lengths([p for _, ps in whole for p in ps]))
        for i, ps in whole:
            out[i] = sum(next(got) for _ in ps)
        return out


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One counter a worker process, kept across tasks."""
    if path not in _counters:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    small_text_batches(docs.sparkSession)
    path = path or tokenizer_path()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    schema = src.select("doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = _counter(path).lengths(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=schema.names)

    return src.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
