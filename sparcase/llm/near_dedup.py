"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document's features are its shingles of five words (lower-cased runs of letters and digits), each weighing
tf * (FLOOR + (1 - FLOOR) * idf), idf in 0..1. Document frequencies come from all documents, counted in 2 ** 20 hashed
entries, so that the table that the tasks read has a fixed size of 4 MB at any scale. What other shingles add to an entry
is about the same everywhere: the median entry and three standard deviations of it are subtracted, so that rare shingles
weigh the same in any corpus and frequent ones stand out. FLOOR keeps a group of thousands of near copies, whose
shingles are therefore frequent, from drifting apart over its few rare ones.

Improved consistent weighted sampling (Ioffe 2010) draws SAMPLES samples a document; two documents agree in each with
the probability of their weighted Jaccard similarity. BANDS bands of ROWS samples make the buckets: two texts at a
similarity of 0.8 share none with a probability of 2e-4, at 0.85 of 7e-6.

Buckets are compared in two steps. First star-wise: all texts of a bucket with its hub. Verified links join texts into
classes. Then, where a bucket still holds texts of several classes: those outside its largest class with each other and
with the largest class, in blocks of texts, by their samples, of which at least NEAR of the SAMPLES must agree (a pair at
0.8 passes with a probability of 0.9998). Only texts with such a pair are read; where they are more than LARGE, at least
NEARER of MORE further samples must agree (0.9999). What passes is verified until a link joins the two classes. So every
pair of a bucket is either decided or of one class already, and a bucket of a million copies and a stranger makes a
million comparisons.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
FLOOR = 0.7
FREQUENCY_BITS, FREQUENCY_BLOCK = 20, 1024
#: Entries of the tables of random draws. For each sample three hashes of a shingle choose its r, c and beta, each of its
#: own, so that few shingles of a text share all of them, however long it is.
DRAW_BITS = 14
KEEP = 150_000
#: Orders by which buckets draw their hubs; texts in a block; samples that must agree for a pair to be verified.
HUBS, BLOCK, NEAR = 4, 512, 40
#: Shingles of a block's texts that are held at once.
HELD = 2_000_000
LARGE, MORE, NEARER = 64, 384, 276
WORD = re.compile(r"[^\W_]+")
#: The same words, faster, in lower-case texts of these characters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eß-öø-ÿ]*")
PLAIN_WORD = re.compile(r"[a-z0-9ß-öø-ÿ]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


class Shingler:
    """Distinct shingles of texts, as 64-bit hashes in ascending order, with their counts."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        low = text.lower()
        words = (PLAIN_WORD if PLAIN.fullmatch(low) else WORD).findall(low)
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > KEEP:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(ids) - WORDS + 1)
        keys = np.zeros(n, dtype=np.uint64)
        for i in range(min(WORDS, len(ids))):
            keys += ids[i : i + n] * _PLACES[i]
        keys ^= keys >> np.uint64(32)
        keys *= _MIX
        return np.unique(keys, return_counts=True)


@common.worker_cache
def shared_shingler() -> Shingler:
    """One per Python worker."""
    return Shingler()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's part of the table of document frequencies, in blocks; block -1: texts with words."""
    table, texts, shingles = np.zeros(1 << FREQUENCY_BITS, dtype=np.uint32), 0, shared_shingler()
    for batch in batches:
        for part in common.blocks(batch):
            found = [shingles(t)[0] for t in part.column("text").to_pylist()]
            texts += sum(len(f) > 0 for f in found)
            if found:
                flat = (np.concatenate(found) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)
                new = np.r_[True, flat[1:] != flat[:-1]]  # a document's hashes ascend, so its equal entries are neighbours
                new[np.cumsum([0, *map(len, found[:-1])])[[len(f) > 0 for f in found]]] = True
                table += np.bincount(flat[new[: len(flat)]], minlength=len(table)).astype(np.uint32)
    yield from _shown({-1: np.array([texts], np.int64)} | {b: table[b : b + FREQUENCY_BLOCK].astype(np.int64) for b in range(0, len(table), FREQUENCY_BLOCK) if table[b : b + FREQUENCY_BLOCK].any()})


def _shown(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b, x in sorted(total.items()):
        small = "<u1" if x.max() < 256 else "<u2" if x.max() < 65536 else "<i8"
        yield pa.record_batch([pa.array([b], pa.int64()), pa.array([small]), pa.array([x.astype(small).tobytes()], pa.binary())], names=["block", "kind", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks as they come: memory is bounded by the table."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, k, x in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "counts"))):
            x = np.frombuffer(x, k).astype(np.int64)
            total[b] = total[b] + x if b in total else x
    yield from _shown(total)


def shingle_weights(docs: DataFrame, floor: float = FLOOR) -> np.ndarray:
    """The natural logarithm of a shingle's weight at a count of one, by the first bits of its hash."""
    schema = "block long, kind string, counts binary"
    total = common.map_batches(common.map_batches(docs.select("text"), _frequencies, schema).repartition("block"), _add_up, schema)
    df, n = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64), 0
    for row in total.collect():  # 1025 rows, 8 MB
        x = np.frombuffer(row["counts"], row["kind"])
        if row["block"] < 0:
            n = int(x[0])
        else:
            df[row["block"] : row["block"] + len(x)] = x
    weights = log_weights_of(df, n, floor)
    common.give_back()
    return weights


def log_weights_of(df: np.ndarray, n: int, floor: float = FLOOR) -> np.ndarray:
    """Logarithms of weights from an entry's documents, of n. The load that other shingles bring to every entry is left out."""
    load = float(np.median(df))
    idf = np.clip(1 - np.log1p(np.maximum(0, df - load - 3 * math.sqrt(load))) / math.log1p(max(n, 1)), 0, 1)
    return np.log(floor + (1 - floor) * idf).astype(np.float32)


@common.worker_cache(size=2)
def _draws(many: int = SAMPLES, bits: int = DRAW_BITS, seed: int = 11) -> tuple[np.ndarray, ...]:
    """r, 1 / r and ln c, r and c being of Gamma(2, 1), and beta, uniform, for each sample and row; odd factors for the rows' hashes."""
    rng = np.random.default_rng(seed)
    shape = (many, 1 << bits)
    r = np.maximum(rng.gamma(2, 1, shape), 1e-4).astype(np.float32)
    return r, np.float32(1) / r, np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, dtype=np.float32), rng.integers(0, 1 << 63, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def weighted(text: str, shingles: Shingler, log_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles and their weights' logarithms."""
    keys, count = shingles(text)
    return keys, log_weights[(keys >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)] + np.log(count).astype(np.float32)


def sample(features: list[tuple[np.ndarray, np.ndarray]], many: int = SAMPLES, bits: int = DRAW_BITS, seed: int = 11) -> np.ndarray:
    """Consistent weighted samples of each document, all having features: hashes of (shingle, step)."""
    r, inverse, log_c, beta, factor = _draws(many, bits, seed)
    keys, weight = np.concatenate([k for k, _ in features]), np.concatenate([w for _, w in features])
    sizes = np.array([len(k) for k, _ in features])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty((len(sizes), many), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(many):
        mixed = keys * factor[k]
        row = (mixed >> np.uint64(64 - bits)).view(np.int64)
        bk = beta[k].take((mixed >> np.uint64(64 - 2 * bits) & mask).view(np.int64))
        step = inverse[k].take(row)
        step *= weight
        step += bk
        np.floor(step, out=step)
        bk -= step
        bk -= np.float32(1)
        bk *= r[k].take(row)
        bk += log_c[k].take((mixed >> np.uint64(64 - 3 * bits) & mask).view(np.int64))
        log_a = bk  # ln c - r * (step - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == least[owner])
        at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]  # of equals the shingle of the smallest hash
        out[:, k] = (keys[at] + step[at].astype(np.int64).astype(np.uint64) * _PLACES[1]) * _PLACES[2]
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each document."""
    out = np.empty((len(samples), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(samples), b + 1, dtype=np.uint64) * _PLACES[3]
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ samples[:, k]) * _MIX
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], log_weights) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row, shingles = TaskContext.get().partitionId() << 36, shared_shingler()
    kind = pa.list_(pa.int64())
    for batch in batches:
        for part in common.blocks(batch, limit=1_000_000):
            texts = part.column("text").to_pylist()
            features = [weighted(t, shingles, log_weights.value) for t in texts]
            some = [i for i, (k, _) in enumerate(features) if len(k)]
            keys: list[list[int]] = [[] for _ in texts]
            brief, packed = [b""] * len(texts), [b""] * len(texts)
            if some:
                drawn = sample([features[i] for i in some])
                for i, x, y in zip(some, bands(drawn), (drawn >> np.uint64(48)).astype("<u2")):
                    keys[i], packed[i], brief[i] = x.tolist(), x.tobytes(), y.tobytes()
            node = [hashlib.sha256(t.encode()).digest()[:16] for t in texts]
            yield pa.record_batch([pa.array(range(row, row + len(texts)), pa.int64()), part.column("doc_id"), pa.array(node, pa.binary()), pa.array(keys, kind), pa.array(brief, pa.binary()), pa.array(packed, pa.binary())], names=["row_id", "doc_id", "node", "bands", "brief", "packed"])
            row += len(texts)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of the lesser weights by that of the greater."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    wa, wb = np.exp(a[1].astype(np.float64)), np.exp(b[1].astype(np.float64))
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    both = np.minimum(wa[at[same]], wb[same]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def _verify(batches: Iterator[pa.RecordBatch], log_weights, least: float) -> Iterator[pa.RecordBatch]:
    shingles, last, kept = shared_shingler(), None, None
    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            b = batch.column("b")[i].as_py()
            if b != last:  # rows come in the order of b, mostly
                last, kept = b, weighted(batch.column("text_b")[i].as_py(), shingles, log_weights.value)
            good.append(jaccard(weighted(batch.column("text_a")[i].as_py(), shingles, log_weights.value), kept) >= least)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many samples agree, of each row of a with each of b."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _candidates(rows: list[tuple], band: int) -> tuple[list[tuple], list[tuple], np.ndarray, np.ndarray]:
    """Both sides of a block and, by agreement, pairs of their rows (side, node, comp, brief, bands, ...) across classes that
    agree in enough samples. A pair that shares several buckets comes from the first of them alone."""
    sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
    two = bool(sides[1])
    left, right = sides if two else (sides[0], sides[0])
    none = np.zeros(0, dtype=np.int64)
    if not left:
        return left, right, none, none
    table = lambda side, at, kind: np.frombuffer(b"".join(r[at] for r in side), kind).reshape(len(side), -1)
    agree = agreeing(table(left, 3, "<u2"), table(right, 3, "<u2"))
    i, j = np.nonzero(agree >= NEAR)
    comps = {c: n for n, c in enumerate({r[2] for r in rows})}
    of = lambda side: np.array([comps[r[2]] for r in side])
    good = of(left)[i] != of(right)[j]
    if not two:
        good &= i < j
    i, j = i[good], j[good]
    keys, others = table(left, 4, "<i8"), table(right, 4, "<i8")
    good = np.concatenate([~(keys[i[at : at + 100_000], :band] == others[j[at : at + 100_000], :band]).any(axis=1) for at in range(0, len(i), 100_000)]) if len(i) else none.astype(bool)
    i, j = i[good], j[good]
    order = np.argsort(-agree[i, j].astype(np.int64), kind="stable")
    return left, right, i[order], j[order]


class _Features:
    """The weighted shingles of a block's texts, so many of them held at once."""

    def __init__(self, log_weights: np.ndarray):
        self.log_weights, self.shingles = log_weights, shared_shingler()
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def __call__(self, node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in self.known:
            found = weighted(text, self.shingles, self.log_weights)
            if self.size > HELD:
                self.known.clear()
                self.size = 0
            self.known[node] = found
            self.size += len(found[0])
        return self.known[node]


def _more_samples(side: list[tuple], features: _Features) -> np.ndarray:
    out, held, size = [], [], 0
    for r in side:
        held.append(features(r[1], r[5]))
        size += len(held[-1][0])
        if size > 100_000:
            out.append(sample(held, MORE, 12, 12))
            held, size = [], 0
    if held:
        out.append(sample(held, MORE, 12, 12))
    return (np.concatenate(out) >> np.uint64(56)).astype("u1")


def _block_links(rows: list[tuple], band: int, log_weights: np.ndarray, least: float) -> Iterator[tuple[bytes, bytes]]:
    """Verified links across classes, at most one fewer than there are classes."""
    left, right, i, j = _candidates(rows, band)
    if not len(i):
        return
    features, parent = _Features(log_weights), {}
    if len(rows) > LARGE:
        more = _more_samples(left, features), _more_samples(right, features)
        good = np.concatenate([(more[0][i[at : at + 10_000]] == more[1][j[at : at + 10_000]]).sum(axis=1) >= NEARER for at in range(0, len(i), 10_000)])
        i, j = i[good], j[good]

    def find(x: bytes) -> bytes:
        while x in parent:
            x = parent[x]
        return x

    for p, q in zip(i.tolist(), j.tolist()):
        a, b = left[p], right[q]
        x, y = find(a[2]), find(b[2])
        if x != y and jaccard(features(a[1], a[5]), features(b[1], b[5])) >= least:
            parent[x] = y
            yield max(a[1], b[1]), min(a[1], b[1])


def _by_block(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, int, list[tuple]]]:
    """Key, band and rows of each block. Rows come sorted by bucket and pair of blocks; memory is bounded by two blocks."""
    last, band, rows = None, 0, []
    for batch in batches:
        for key, i, j, at, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "band", *columns))):
            if (key, i, j) != last:
                if rows:
                    yield last, band, rows
                last, band, rows = (key, i, j), at, []
            rows.append(tuple(row))
    if rows:
        yield last, band, rows


PARTS = "key long, i long, j long, band int, side int, node binary, comp binary, brief binary, bands binary"


def _taking_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a candidate in their block: those whose texts must be read."""
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 4
    names = [f.split()[0] for f in PARTS.split(", ")]
    for key, band, rows in _by_block(batches, ("side", "node", "comp", "brief", "bands")):
        left, right, i, j = _candidates(rows, band)
        some = {(r[0], r[1]): r for r in [*(left[p] for p in np.unique(i)), *(right[q] for q in np.unique(j))]}
        if some:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*((*key, band, *r) for r in some.values())), kinds)], names=names)


def _across(batches: Iterator[pa.RecordBatch], log_weights, least: float) -> Iterator[pa.RecordBatch]:
    found = []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    for _, band, rows in _by_block(batches, ("side", "node", "comp", "brief", "bands", "text")):
        found += _block_links(rows, band, log_weights.value, least)
        if len(found) > 50_000:
            yield out()
            found = []
    yield out()


def _deal(held: DataFrame) -> DataFrame:
    """Rows of mixed buckets (key, node, comp, with the bucket's number of rows n, its largest class top and the number of
    rows outside it, rest), each in the pairs of blocks (i, j; side) in which it is compared. Blocks of rows outside the
    largest class, 0 to outer - 1, meet each other and the blocks of the largest class, which don't meet each other.
    A bucket of no more than one block is compared as it is."""
    small, outside = F.col("n") <= BLOCK, F.col("comp") != F.col("top")
    count = lambda n: F.ceil(n / F.lit(BLOCK))
    held = held.withColumn("outer", F.when(small, 1).otherwise(count(F.col("rest")))).withColumn("inner", F.when(small, 0).otherwise(count(F.col("n") - F.col("rest"))))
    digest = F.xxhash64("node")
    own = F.when(small, 0).when(outside, F.pmod(digest, "outer")).otherwise(F.col("outer") + F.pmod(digest, "inner"))
    held = held.withColumn("block", own.cast("long"))
    others = F.when(outside & ~small, F.sequence(F.lit(0).cast("long"), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1))
    held = held.withColumn("other", F.explode(others))
    return held.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int")).drop("block", "other", "n", "top", "rest", "outer", "inner")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, floor: float = FLOOR, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, class_id, class_size, kept, text_id.

    A class is a connected component of the links between texts of a weighted Jaccard similarity of at least
    `similarity`; equal texts, empty ones too, are one text. class_id is the smallest doc_id of the class, and the row
    with it is kept (of repeated rows of that doc_id one; null ids count as the largest). Texts of less than five words
    have one shingle, of all their words; texts without words have none and are linked to no other text. Null counts
    as empty."""
    spark = docs.sparkSession
    texts = common.documents(docs, id_col=id_col, text_col=text_col)
    log_weights = spark.sparkContext.broadcast(shingle_weights(texts, floor))
    rows = common.cut(common.map_batches(texts, partial(_signatures, log_weights=log_weights), "row_id long, doc_id long, node binary, bands array<long>, brief binary, packed binary"))
    n = rows.count()
    nodes = common.few(rows, n).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("brief").alias("brief"), F.first("packed").alias("packed"))
    keys = common.few(nodes, n).select("node", F.posexplode("bands").alias("band", "key"))
    # each bucket's hub is drawn by one of HUBS orders, so that a group of copies is compared with several of its texts
    drawn = F.struct(F.xxhash64("node", F.col("band") % HUBS).alias("h"), F.col("node"))
    hubs = keys.groupBy("key").agg(F.min(drawn)["node"].alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    member = common.cut(common.spread_join(keys.select("node", "band", "key"), hubs, "key"))  # rows of the buckets of two texts or more
    many = member.count()
    member = common.few(member, many)
    pairs = member.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    pairs = common.cut(common.few(pairs, many))
    own = common.cut(common.few(nodes.select("node", "doc_id").join(member.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("text_id"), F.col("doc_id").alias("first_id")), n))
    # texts of the buckets: of each one row, that of its smallest id. Rows that can't be among them aren't moved
    named = common.flag_members(texts.withColumn("node", common.text_key()), "node", own.select(F.col("text_id").alias("node"))).where("_maybe")
    wanted = named.join(own, (F.col("node") == F.col("text_id")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    bucket_text = common.cut(wanted.dropDuplicates(["node", "doc_id"]).select("node", "text"))

    a = pairs.join(bucket_text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = a.join(bucket_text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = common.cut(common.map_batches(both, partial(_verify, log_weights=log_weights, least=similarity), "a binary, b binary"))
    comps = components(links)
    placed = common.cut(common.few(member.join(comps, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp")), many))
    sizes = common.few(common.few(placed, many).groupBy("key", "comp").agg(F.count("*").alias("c")), many)
    top = F.max(F.struct("c", "comp"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("n"), top["comp"].alias("top"), (F.sum("c") - top["c"]).alias("rest")).where("rest > 0")
    brief = nodes.select("node", "brief", F.col("packed").alias("bands")).join(own.select(F.col("text_id").alias("node")), "node", "left_semi")
    held = common.cut(common.few(common.spread_join(common.few(placed, many), mixed, "key"), many))
    held = _deal(common.spread_join(held, common.few(brief, n), "node"))
    dealt = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    parts = common.cut(common.map_batches(dealt.select(*(f.split()[0] for f in PARTS.split(", "))), _taking_part, PARTS))
    text = common.flag_members(bucket_text, "node", parts.select("node")).where("_maybe").select("node", "text")
    parts = parts.join(text, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = common.cut(common.map_batches(parts, partial(_across, log_weights=log_weights, least=similarity), "a binary, b binary"))
    comps = components(links.unionByName(found))
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    placed = common.few(common.few(rows, n).select("row_id", "doc_id", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), n)
    classes = placed.groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    out = common.spread_join(placed, classes, "comp")
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.row_id") == F.col("row_id")).alias("kept"), F.col("node").alias("text_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the one with the smallest doc_id, null ids counting
    as the largest; of rows alike in doc_id and text, one. Null texts count as empty, and texts without words are alike
    only if they are equal. Other columns come along as they are. An empty table gives an empty one."""
    return common.keep_rows(docs, near_dedup(docs))
