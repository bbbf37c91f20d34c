"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words and their shapes (which kinds of characters, in what order, and whether a word repeats the one before) are hashed
to a fixed number of entries. Each entry has a sparse random index vector. Its context vector sums the index vectors of
the neighbours of all its occurrences in all documents; the entry's vector is its index vector plus its context vector,
both of length one. A document is the mean vector of its words and that of its shapes. The network has one hidden layer;
a temperature, fitted on labelled rows that the weights haven't seen, calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Entries of the two tables and their dimensions: together 4 MB, whatever the corpus.
WORD_BITS, SHAPE_BITS, SIZE, NONZERO = 14, 10, 48, 4
ENTRIES = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Context tables travel in blocks of so many entries, so that a thousand tasks can add them up.
BLOCK = 256
#: Labelled rows at most that the network is fitted on: those with the lowest digests of their ids.
FIT_ROWS = 20_000


@lru_cache(maxsize=1)
def index_places(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the NONZERO places of its index vector and their signs."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((ENTRIES, SIZE)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (ENTRIES, NONZERO))


def index_vectors(seed: int = 7) -> np.ndarray:
    places, signs = index_places(seed)
    out = np.zeros((ENTRIES, SIZE), dtype=np.float32)
    np.put_along_axis(out, places, signs.astype(np.float32), axis=1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


_OTHER = re.compile(r"[\W\d_]+")
_BREAK = ord("\n")


@common.worker_cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, or the break between words; for those under 256 what a shape shows:
    small letters, capitals and digits as a, A and 0, all else as it is."""
    letter = np.zeros(0x110000, dtype=bool)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    letter[np.frombuffer(_OTHER.sub("", every).encode("utf-32-le"), "<u4")] = True
    letter[_BREAK] = True
    shown = np.arange(256, dtype="<u4")
    for kind, codes in (("a", [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]), ("A", [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]), ("0", range(48, 58))):
        shown[list(codes)] = ord(kind)
    return letter, shown


def _bucket(text: str, bits: int) -> int:
    return zlib.crc32(text.encode(errors="replace")) & ((1 << bits) - 1)


@common.worker_cache(size=100_000)
def _shape_entries(shape: str) -> tuple[int, int]:
    """The entries of a shape (runs of a character being one, at most eight in all), alone and as a repetition."""
    base = 1 << WORD_BITS
    return base + _bucket(shape, SHAPE_BITS), base + _bucket(shape + "=", SHAPE_BITS)


def _codes(words: pa.Array) -> np.ndarray:
    """For each word its entry, by its letters in lower case, and its shape's two; all words in one string, with breaks."""
    (letter, shown), count = _characters(), len(words)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), words.cast(pa.string())), "\n")
    chars = np.frombuffer(joined[0].as_py().encode("utf-32-le"), "<u4")
    letters = chars[letter[chars]].tobytes().decode("utf-32-le").lower().encode().split(b"\n")
    out = np.empty((count, 3), dtype=np.int64)
    out[:, 0] = np.fromiter(map(zlib.crc32, letters), dtype=np.int64, count=count) & ((1 << WORD_BITS) - 1)
    kinds = np.where(chars < 256, shown[np.minimum(chars, 255)], chars).astype("<u4", copy=False)
    first = np.ones(len(kinds), dtype=bool)
    first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _BREAK)
    shapes = [s[:8] for s in kinds[first].tobytes().decode("utf-32-le").split("\n")]
    out[:, 1:] = np.fromiter(chain.from_iterable(map(_shape_entries, shapes)), dtype=np.int64, count=2 * count).reshape(-1, 2)
    return out


class Words:
    """Codes of words: word entry, and shape entry as it is and as a repetition of the word before.

    White space is Unicode's, as in str.split(); each distinct word of the texts is looked at once. Nothing is kept."""

    def read(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word entries and shape entries of all texts in a row, and the number of words of each text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return (np.zeros(0, dtype=np.int64),) * 3
        split = pc.utf8_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        ids, counts = flat.indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)
        starts = np.cumsum(counts) - counts
        empty = pc.index(flat.dictionary, "").as_py()
        if empty >= 0:  # before white space at a text's start, after that at its end, or an empty text's only one
            some = ids != empty
            ids, counts = ids[some], np.add.reduceat(some, starts, dtype=np.int64)
            starts = np.cumsum(counts) - counts
        codes = _codes(flat.dictionary)
        same = np.zeros(len(ids), dtype=bool)
        same[1:] = ids[1:] == ids[:-1]
        same[starts[counts > 0]] = False
        return codes[ids, 0], np.where(same, codes[ids, 2], codes[ids, 1]), counts


def _contexts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """The task's part of the context table, in blocks."""
    (places, signs), words = index_places(seed), Words()
    table = np.zeros(ENTRIES * SIZE)
    for batch in batches:
        for part in common.blocks(batch, limit=2_000_000):
            word, shape, counts = words.read(part.column("text"))
            if len(word) < 2:
                continue
            inside = np.repeat(np.arange(len(counts)), counts)
            pair = np.flatnonzero(inside[1:] == inside[:-1])  # neighbours in a text
            for here, there in ((pair, pair + 1), (pair + 1, pair)):
                near = word[there]
                place, sign = places[near], signs[near].ravel()  # the neighbour's index vector has only these places
                for own in (word[here], shape[here]):
                    table += np.bincount((own[:, None] * SIZE + place).ravel(), weights=sign, minlength=len(table))
    table = table.reshape(ENTRIES, SIZE)
    for b in range(0, ENTRIES, BLOCK):
        if table[b : b + BLOCK].any():
            yield pa.record_batch([pa.array([b], pa.int64()), pa.array([table[b : b + BLOCK].astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks as they come: memory is bounded by the table."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, s in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            x = np.frombuffer(s, "<f4").astype(np.float64)
            total[b] = total[b] + x if b in total else x
    for b in sorted(total):
        yield pa.record_batch([pa.array([b], pa.int64()), pa.array([total[b].astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, seed: int = 7) -> np.ndarray:
    """The table of vectors, from every word of every document."""
    parts = common.map_batches(docs.select("text"), partial(_contexts, seed=seed), "block long, sums binary")
    total = common.map_batches(parts.repartition("block"), _add_up, "block long, sums binary")
    table = np.zeros((ENTRIES, SIZE), dtype=np.float32)
    for row in total.collect():  # ENTRIES / BLOCK rows, 3 MB
        table[row["block"] : row["block"] + BLOCK] = np.frombuffer(row["sums"], "<f4").reshape(-1, SIZE)
    index = index_vectors(seed)
    centred = unit(table) - unit(table).mean(axis=0) * (np.abs(table).sum(axis=1, keepdims=True) > 0)
    return (unit(index) + unit(centred)).astype(np.float32)


def pooled(texts: list[str] | pa.Array, vectors: np.ndarray, words: Words) -> np.ndarray:
    """For each text, the mean vector of its words, that of its shapes, and one that is 1 for texts with words."""
    word, shape, counts = words.read(texts)
    out = np.zeros((len(texts), 2 * SIZE + 1), dtype=np.float32)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if len(starts):
        for i, entries in enumerate((word, shape)):
            sums = np.add.reduceat(vectors[entries], starts, axis=0)
            out[some, i * SIZE : (i + 1) * SIZE] = sums / counts[some, None]
        out[some, -1] = 1
    return out


@dataclass
class Network:
    """tanh layer, then a logit; temperature divides it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on four fifths of the rows; the temperature on the rest. Without both labels, a constant."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = rng.permutation(len(y))
    rest, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    size = int(np.clip(len(own) // 20, 16, 256))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // size)):
            h = np.tanh(z[part] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[part]) / len(part)
            back = g[:, None] * p[2] * (1 - h * h)
            step += 1
            for i, grad in enumerate((z[part].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], g.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(rest) >= 10:
        raw = net.logits(x[rest])
        loss = lambda t: np.logaddexp(0, np.where(y[rest] > 0.5, -raw, raw) / t).mean()
        net.temperature = float(min(np.geomspace(0.5, 10, 61), key=loss))
    return net


def _pool(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for part in common.blocks(batch, limit=1_000_000):
            x = pooled(part.column("text"), vectors.value, words)
            yield pa.record_batch([part.column("doc_id"), part.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "vector"])


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7):
    """The broadcast word vectors (from all of docs) and the network (from at most fit_rows labelled rows that aren't
    held out). Of contradicting labels of a document the lower counts."""
    rows = common.documents(docs)
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(rows, seed))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # at most fit_rows rows of 12 bytes
    chosen = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    data = common.map_batches(chosen, partial(_pool, vectors=vectors), "doc_id long, quality int, vector binary")
    data = data.groupBy("doc_id", "quality").agg(F.min("vector").alias("vector")).toPandas()  # a row an id, so at most fit_rows
    data = data.sort_values(["quality", "vector"], kind="stable")
    x = np.frombuffer(b"".join(data["vector"]), dtype=np.float32).reshape(-1, 2 * SIZE + 1)
    net = fit(x, data["quality"].to_numpy())
    del data, x
    common.give_back()
    return vectors, net


def _score(batches: Iterator[pa.RecordBatch], vectors, net: Network, threshold: float, rows: bool) -> Iterator[pa.RecordBatch]:
    """rows: whole rows that are accepted; else doc_id, held_out and the score."""
    words = Words()
    for batch in batches:
        for part in common.blocks(batch, limit=1_000_000):
            score = net.scores(pooled(part.column("text"), vectors.value, words))
            if rows:
                yield part.filter(pa.array(score >= threshold))
            else:
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts have the zero vector and get the score that the network gives it. Null ids are not held out
    and have no label. Repeated rows are scored each. Without labels, or with one label only, the score is constant."""
    vectors, net = train(docs, labels, fit_rows)
    rows = common.documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return common.map_batches(rows, partial(_score, vectors=vectors, net=net, threshold=threshold, rows=False), SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold.

    Null texts are scored as empty ones and stay null; null ids have no label; repeated rows are judged alike. Without
    labels, or with one label only, all scores are equal, so all rows stay or none does. An empty table gives an empty
    one."""
    vectors, net = train(docs, labels, fit_rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_batches(docs, partial(_score, vectors=vectors, net=net, threshold=threshold, rows=True), schema)
