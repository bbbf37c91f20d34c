"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies and summed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, wordpieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_block(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text. The ids of a document are never made."""
    known = wordpieces.word_pieces(path)
    split = [known.split(t) for t in texts]
    code: dict[str, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code)) for words in split for w in words), dtype=np.int64)
    if not len(flat):
        return np.zeros(len(texts), dtype=np.int64)
    known.learn(set(code))
    pieces = np.fromiter((len(known.pieces[w]) // 4 for w in code), dtype=np.int64, count=len(code))
    owner = np.repeat(np.arange(len(texts)), [len(words) for words in split])
    pair, freq = np.unique(owner * len(code) + flat, return_counts=True)  # (document, pre-token), frequency
    return np.bincount(pair // len(code), weights=pieces[pair % len(code)] * freq, minlength=len(texts)).astype(np.int64)


def _run(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.blocks(batch):
            n = count_block(part.column("text").to_pylist(), path)
            size = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.record_batch([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and null ids come out as they went in; other columns are
    not read. No shuffle: in each block of documents the distinct pre-tokens are encoded once (and remembered by the
    worker), then joined by code to the block's (document, pre-token) frequencies."""
    run = partial(_run, path=tokenizer_path or wordpieces.default_path(), limit=limit)
    return common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), run, SCHEMA)
