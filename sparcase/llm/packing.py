"""Cost-balanced packing of tokenised documents into sequences of a fixed number of tokens.

The cost of a piece of n tokens is linear * n + quadratic * n ** 2 (feed-forward and attention work, documents not
attending to each other). Pieces go, in descending order, to the sequence of lowest cost that still has room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, wordpieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens that a task balances at once: about 500 sequences of 4096, 8 MB of ids.
BLOCK_TOKENS = 1 << 21


class Packer:
    """Packs pieces (key, start, length); add() and close() yield (key, start, length, sequence, offset).

    All sequences are full, but for those of close(): it cuts the last, less than full, remainder of a task into
    sequences whose lengths are powers of two, so that nothing is padded."""

    def __init__(self, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.waiting: list[tuple[int, int, int]] = []
        self.tokens = 0
        self.sequences = 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, key: int, length: int) -> None:
        self.waiting.append((key, 0, length))
        self.tokens += length

    def flush(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Fills as many sequences as the waiting tokens can; what is left over, less than one sequence, goes on waiting."""
        cap, short = self.capacity, []
        for key, start, n in self.waiting:
            while n >= cap:
                yield key, start, cap, self.sequences, 0
                self.sequences += 1
                start, n = start + cap, n - cap
            if n:
                short.append((key, start, n))
        many = sum(n for *_, n in short) // cap
        first, self.sequences = self.sequences, self.sequences + many
        cost, room, left = np.zeros(many), np.full(many, cap), []
        short.sort(key=lambda p: (-p[2], p[0], p[1]))
        for key, start, n in short:
            while n and many:
                fits = np.flatnonzero(room >= n)
                if not len(fits):  # no sequence takes it whole: the cheapest with room takes what it can
                    fits = np.flatnonzero(room)
                if not len(fits):
                    break
                i = int(fits[cost[fits].argmin()])
                take = min(n, int(room[i]))
                yield key, start, take, first + i, cap - int(room[i])
                room[i] -= take
                cost[i] += self.cost(take)
                start, n = start + take, n - take
            if n:
                left.append((key, start, n))
        self.waiting, self.tokens = left, sum(n for *_, n in left)

    def close(self) -> Iterator[tuple[int, int, int, int, int]]:
        yield from self.flush()
        room, offset = 0, 0
        rest = self.tokens
        for key, start, n in self.waiting:
            while n:
                if not room:
                    room, offset = 1 << (rest.bit_length() - 1), 0
                    self.sequences += 1
                take = min(n, room)
                yield key, start, take, self.sequences - 1, offset
                start, n, room, offset, rest = start + take, n - take, room - take, offset + take, rest - take
        self.waiting, self.tokens = [], 0


def _run(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, linear: float, quadratic: float, block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 36
    packer = Packer(capacity, linear, quadratic)
    held: dict[int, tuple[int | None, bytes]] = {}  # of documents with waiting pieces
    end, key = np.array([end_id], "<u4").tobytes(), 0

    def emit(pieces: Iterator[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        rows = [(held[k][0], s, n, zlib.crc32(memoryview(held[k][1])[4 * s : 4 * (s + n)]), len(held[k][1]) // 4, base + q, o) for k, s, n, q, o in pieces]
        keep = {k for k, *_ in packer.waiting}
        for k in [k for k in held if k not in keep]:
            del held[k]
        columns = list(zip(*rows)) or [[]] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    for batch in batches:
        for part in common.blocks(batch, limit=1_000_000):
            for doc, ids in zip(part.column("doc_id").to_pylist(), wordpieces.encode_texts(part.column("text").to_pylist(), path)):
                ids += end
                held[key] = (doc, ids)
                packer.add(key, len(ids) // 4)
                key += 1
                if packer.tokens >= block_tokens:
                    yield emit(packer.flush())
    yield emit(packer.close())


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = BLOCK_TOKENS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id, so an empty or null text is one token. Each id lies in exactly one piece.
    Sequences hold `capacity` tokens; only the last remainder of a task is cut into sequences of 2 ** k tokens, so
    there is no padding. Each task packs blocks of block_tokens tokens of its own partition: no shuffle, and memory
    bounded by the block, or by one document where that is longer. Repeated rows are packed each; a null id is kept.
    sequence_id holds the partition's number in its high bits, so a task that is run again gives the same rows."""
    run = partial(_run, path=tokenizer_path or wordpieces.default_path(), end_id=end_id, capacity=capacity, linear=linear, quadratic=quadratic, block_tokens=block_tokens)
    return common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), run, SCHEMA)
