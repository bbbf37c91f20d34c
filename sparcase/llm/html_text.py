"""Main text of web pages: a host's repeated passages, with structure for block boundaries and a first cut.

A page's markup gives its blocks. Blocks in menus, page headers, footers, sidebars, notices, adverts, forms and reader
comments are its chrome. If the page marks its article (article, main, role=main, itemprop=articleBody), that article is
the body and what is outside it is chrome too; else the body is all that isn't chrome.

The token streams of both, of all pages of a host, are then searched for substrings of at least `depth` tokens that are
repeated: that stand on two pages or more whose bodies differ. A page and its copies, near ones too, are one page here
(most of SKETCHES min-hashes of the bodies agree), so that an article isn't deleted for being published twice. What
repeated substrings cover is boilerplate and is removed, the unique runs stay:

* in the body of a page without a marked article, substrings repeated in such bodies or in chrome;
* in a marked article, substrings repeated in articles that are also repeated chrome of the host, or that stand in more
  than half of its articles, of SITE at least. Passages that some articles share are part of them, and stay.

Runs of `depth` tokens are counted under a 128-bit digest of host and tokens, over the whole host (those that a lossless
filter tells not to be repeated aren't), so the result is that of one suffix array over all of a host's pages (`repeated`),
whatever its size.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Texts (and runs of tokens) counted together in a worker before the counts are shuffled.
SHARD_PAGES = 500
SHARD_RUNS = 500_000
#: Min-hashes of a body, of which most must differ for two pages to be different ones; articles of which a host's passage must be on more than half.
SKETCHES, DIFFERING, SITE = 5, 3, 8
#: Element names of HTML by what they are here for.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button dialog footer form head header iframe menu nav noscript object search select svg template textarea video audio canvas map".split())
#: Dropped elements that show nothing on the page; a title in the head isn't evidence against the article's own.
UNSEEN = frozenset("head noscript object select svg template textarea video audio canvas map iframe".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related remark respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Elements that class and id words may drop; not, say, a paragraph's words.
CONTAINERS = frozenset("div section ul ol dl table figure span p center details".split())
#: A class of several words that begins so says something of what is around or within the element, not what it is.
RELATIONS = frozenset("has with without no not hide show open above below after before".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL | re.IGNORECASE)
HEADED = re.compile(r"<(?:h1|main|article)\b", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if "=" in raw or raw.strip() else {}


def _named_after(names: str) -> bool:
    """Whether a class or id names something dropped: `sidebar`, `site-footer`, `comment_list`, but not `has-sidebar`."""
    for name in names.lower().split():
        words = re.split(r"[_-]+", name)
        if words[0] not in RELATIONS and not DROPPED_WORDS.isdisjoint(words):
            return True
    return False


def _dropped(name: str, attrs: dict[str, str]) -> bool:
    if name in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    return name in CONTAINERS and (_named_after(attrs.get("class", "")) or _named_after(attrs.get("id", "")))


def _marks(name: str, attrs: dict[str, str]) -> bool:
    return name in ("article", "main") or attrs.get("role") == "main" or "articlebody" in attrs.get("itemprop", "").lower()


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each element of that name begins, and where its own end tag does, if it has one."""
    open_, out = [], {}
    for m in re.finditer(rf"<(/?){name}\b", page, re.IGNORECASE):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def page_blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """The blocks of the page's marked articles, all blocks that aren't dropped, and the text of each dropped element (and of
    each block outside the articles).

    An article mark within a dropped element (a card in a sidebar, a reader's comment) marks nothing. Only where a page
    would have no article otherwise, dropped elements around one are taken to be never closed, and end there; where it
    would have no text at all otherwise, forms and class names drop nothing."""
    strict = _parse(page, False, False)
    if strict[0]:
        return strict
    inner, *others = _parse(page, True, False)
    if inner or strict[1]:
        return (inner, *others) if inner else strict
    return _parse(page, True, True)


def _parse(page: str, reopen: bool, lenient: bool) -> tuple[list[str], list[str], list[str]]:
    inner: list[str] = []
    every: list[str] = []
    chrome: list[str] = []
    current: list[str] = []
    beside: list[str] = []  # text of dropped elements
    open_: list[tuple[str, bool, bool, int]] = []  # element, whether it drops, whether it marks the article, its place
    beside_of = ""
    drops = marks = 0
    ends: dict[str, dict[int, int]] = {}

    def end_of(name: str, at: int) -> int:
        if name not in ends:
            ends[name] = _ends(page, name)
        return ends[name].get(at, -1)

    def part() -> None:
        words = html.unescape("".join(beside)).split()
        beside.clear()
        if words and beside_of not in UNSEEN:
            chrome.append(" ".join(words))

    def flush() -> None:
        if beside:
            beside.append(" ")
        if current:
            block = " ".join(html.unescape("".join(current)).split())
            current.clear()
            if block:
                every.append(block)
                if marks:
                    inner.append(block)

    def pop() -> None:
        nonlocal drops, marks
        _, d, m, _ = open_.pop()
        drops, marks = drops - d, marks - m

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            (beside if drops else current).append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not drops:
                current.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name in BLOCK:
            flush()
        if m[2] or m[5]:  # an end tag closes the last such element; none, if there is none
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    while len(open_) > i:
                        pop()
                    break
                if open_[i][2] and name not in ("body", "html"):
                    break  # stray end tags don't leave the article
            continue
        if name in VOID:
            continue
        attrs = _attributes(m[4] or m[7] or "")
        marked = _marks(name, attrs)
        if marked and drops and not marks and (reopen or all(end_of(n, i) < 0 for n, d, _, i in open_ if d)):
            while open_ and drops:  # an element that was never closed doesn't swallow the article
                pop()
        if name in BLOCK and open_ and open_[-1][0] == "p":
            pop()  # a block ends a paragraph
        drop = _dropped(name, attrs) and not marked
        if drop and name == "form" and (lenient or HEADED.search(page, m.end(), max(m.end(), end_of(name, m.start())))):
            drop = False  # the whole page is in it
        elif drop and lenient and name in CONTAINERS:
            drop = False
        elif name == "header" and marks:
            drop = False  # the article's own head, with its title
        if name not in BLOCK and not drop and not marked:
            continue  # plain inline markup needs no account
        if drop and not drops:
            part()
            beside_of = name
        open_.append((name, drop, marked, m.start()))
        drops, marks = drops + drop, marks + marked
    (beside if drops else current).append(page[at:])
    flush()
    part()
    if inner:  # what is outside the article
        rest = Counter(every)
        rest.subtract(inner)
        chrome += [b for b, n in rest.items() if n > 0]
    return inner, every, chrome


def repeated(streams: list[list[str]], depth: int, pages: int) -> list[np.ndarray]:
    """For each page's tokens, which are covered by substrings of `depth` tokens or more that stand on `pages` pages.

    Suffixes are sorted by doubling, up to their first `depth` tokens: suffixes of equal rank begin with the same
    `depth` tokens. A separator of its own ends each page, so that no substring runs from one into the next."""
    code: dict[str, int] = {}
    flat, owner = [], []
    for i, tokens in enumerate(streams):
        flat += [code.setdefault(t, len(code)) for t in tokens]
        flat.append(-1 - i)
        owner += [i] * (len(tokens) + 1)
    ids, page = np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64)
    _, rank = np.unique(ids, return_inverse=True)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.full(len(rank), -1, dtype=np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + after + 1, return_inverse=True)
        have += step
    pair = np.unique(rank.astype(np.int64) * len(streams) + page)
    on = np.bincount(pair // len(streams), minlength=int(rank.max()) + 1)  # distinct pages of each rank
    starts = np.flatnonzero(on[rank] >= pages)
    covered = np.zeros(len(ids) + depth + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + depth, -1)
    mask = np.cumsum(covered)[: len(ids)] > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [mask[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends)]


def unique_runs(blocks: list[str], mask: np.ndarray) -> list[str]:
    """The blocks without covered tokens; runs of what is left, in order."""
    out, at = [], 0
    for b in blocks:
        words = b.split(" ")
        keep = [w for w, c in zip(words, mask[at : at + len(words)]) if not c]
        at += len(words)
        if keep:
            out.append(" ".join(keep))
    return out


def _tokens(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ") if text else []


def run_keys(host: str, tokens: list[str], depth: int, starts: np.ndarray) -> np.ndarray:
    """Two whole numbers for the `depth` tokens from each of the starts on: a 128-bit digest of host and tokens."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    own = blake2b(f"{len(host)}:{host}".encode(), digest_size=16)
    coded = [t.encode() for t in tokens]
    ends = np.cumsum([0, *(len(t) + 1 for t in coded)]).tolist()
    flat, out = b" ".join(coded), bytearray()
    for i in starts.tolist():
        digest = own.copy()
        digest.update(flat[ends[i] : ends[i + depth] - 1])
        out += digest.digest()
    return np.frombuffer(bytes(out), dtype=np.int64).reshape(-1, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def run_hashes(host: str, tokens: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For the run of `depth` tokens from each place on: the least hash of the shorter runs of half its length in it, and
    a hash of its own.

    Equal runs have equal minima, so a run is repeated only if its minimum is. Neighbours mostly share theirs, so there
    are several times fewer minima than runs."""
    if len(tokens) < depth:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    half = max(1, depth // 2)
    code = _mixed(np.fromiter(map(crc32, map(str.encode, tokens)), dtype=np.uint64, count=len(tokens)))
    short = np.full(len(tokens) - half + 1, crc32(host.encode()), dtype=np.uint64)
    for k in range(half):
        short = short * np.uint64(0xD6E8FEB86659FD93) + code[k : k + len(short)]
    whole = np.zeros(len(tokens) - depth + 1, dtype=np.uint64)
    for k in sorted({*range(0, depth - half, half), depth - half}):
        whole = _mixed(whole + short[k : k + len(whole)])
    return np.lib.stride_tricks.sliding_window_view(_mixed(short), depth - half + 1).min(axis=1).view(np.int64), whole


class Page:
    """A page's blocks, and the hashed runs of its body and of each dropped part."""

    def __init__(self, host: str, page: str, depth: int):
        inner, every, self.chrome = page_blocks(page)
        self.marked = bool(inner)
        self.blocks = inner or every
        self.tokens = _tokens("\n".join(self.blocks))
        self.minima, self.runs = run_hashes(host, self.tokens, depth)

    def sketch(self, many: int = SKETCHES) -> tuple[int, ...]:
        """Min-hashes of the body's runs, of 15 bits each; of a body too short for a run, of its text."""
        runs = self.runs if len(self.runs) else np.array([crc32("\n".join(self.blocks).encode())], dtype=np.uint64)
        return tuple(int(_mixed(runs * np.uint64(2 * k + 1) ^ np.uint64(0x94D049BB133111EB)).min() >> np.uint64(16)) & 0x7FFF for k in range(1, many + 1))

    def chrome_streams(self) -> list[list[str]]:
        """The tokens of each dropped part: no substring runs from one into the next."""
        return [_tokens(part) for part in self.chrome]


def _groups(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Distinct keys, the least and greatest of each column, and how many rows each has."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    spans = [(np.minimum.reduceat(c[order], starts), np.maximum.reduceat(c[order], starts)) if len(keys) else (c, c) for c in columns]
    return keys[starts], spans, np.diff(np.r_[starts, len(keys)])


MINIMA = "m long, kind int, lo int, hi int"


def _count_minima(batches: Iterator[pa.RecordBatch], depth: int, shard_pages: int) -> Iterator[pa.RecordBatch]:
    """Minima of runs, with the least and greatest of their bodies' joint sketches. kind 0: of bodies without a marked
    article, 1: of dropped parts, 2: of marked articles. A passage on more than half of a host's articles is on at least
    half of them in some block, so of the last kind no others need be shown."""
    held: dict[int, list[tuple[np.ndarray, int]]] = {0: [], 1: []}
    articles: dict[str, list[tuple[np.ndarray, int]]] = {}
    size = pages = 0

    def shown(kind: int, found: list[tuple[np.ndarray, int]], least: float = 0) -> pa.RecordBatch:
        m = np.concatenate([x for x, _ in found])
        keys, [(lo, hi)], n = _groups(m, np.repeat(np.array([s for _, s in found], dtype=np.int32), [len(x) for x, _ in found]))
        some = n >= least
        return pa.record_batch([pa.array(keys[some]), pa.array(np.full(some.sum(), kind, dtype=np.int32)), pa.array(lo[some]), pa.array(hi[some])], names=["m", "kind", "lo", "hi"])

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal size, pages
        for kind, found in held.items():
            if found:
                yield shown(kind, found)
                found.clear()
        for found in articles.values():
            yield shown(2, found, len(found) / 2)
        articles.clear()
        size = pages = 0

    for batch in batches:
        for part in common.blocks(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                p = Page(host, page, depth)
                joint = crc32(repr(p.sketch(SKETCHES - DIFFERING + 1)).encode()) >> 1
                body, chrome = np.unique(p.minima), np.unique(np.concatenate([p.minima[:0], *(run_hashes(host, t, depth)[0] for t in p.chrome_streams())]))
                if p.marked:
                    articles.setdefault(host, []).append((body, joint))
                else:
                    held[0].append((body, joint))
                held[1].append((chrome, joint))
                size, pages = size + len(body) + len(chrome), pages + 1
                if pages >= shard_pages or size >= SHARD_RUNS:
                    yield from out()
    yield from out()


SKETCH_NAMES = [f"s{k}" for k in range(SKETCHES)]
PLACES = "content binary, place int, a long, b long, kind int, host_key long, n long, " + ", ".join(f"{s}_lo int, {s}_hi int" for s in SKETCH_NAMES)


def _flagged(bits: np.ndarray, minima: np.ndarray) -> np.ndarray:
    slot = minima & (common.FILTER_BITS - 1)
    return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def _places(batches: Iterator[pa.RecordBatch], depth: int, open_bits: Broadcast[np.ndarray], article_bits: Broadcast[np.ndarray], shard_pages: int) -> Iterator[pa.RecordBatch]:
    """Runs whose minimum may be repeated. Those of bodies with content and place; n: 1 at a run's first place in its text,
    else 0. Those of dropped parts without, added up for some pages. And a row for each article, of place -1."""
    names = [f.split()[0] for f in PLACES.split(", ")]
    chrome: list[tuple[np.ndarray, tuple[int, ...]]] = []
    articles: list[tuple[bytes, int]] = []
    size = 0

    def batch_of(content: list, place: np.ndarray, keys: np.ndarray, kind: int, host_key: int, n: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        full = lambda x, k: np.full(len(place), x, dtype=k)
        columns = [pa.array(content, pa.binary()), pa.array(place.astype(np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(full(kind, np.int32)), pa.array(full(host_key, np.int64)), pa.array(n.astype(np.int64))]
        return pa.record_batch([*columns, *(pa.array(np.asarray(x, dtype=np.int32)) for pair in spans for x in pair)], names=names)

    def of_chrome() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if not chrome:
            return
        size = 0
        keys = np.concatenate([k for k, _ in chrome])
        owner = np.repeat(np.arange(len(chrome)), [len(k) for k, _ in chrome])
        table = np.array([s for _, s in chrome], dtype=np.int32)
        _, at = np.unique(keys, axis=0, return_inverse=True)
        groups, spans, n = _groups(at.ravel(), *table[owner].T)
        first = np.zeros(len(groups), dtype=np.int64)
        first[at.ravel()] = np.arange(len(keys))
        chrome.clear()
        yield batch_of([None] * len(groups), np.full(len(groups), -2), keys[first], 1, 0, n, spans)

    def of_articles() -> pa.RecordBatch:
        n = len(articles)
        keys = np.array([[h, 0] for _, h in articles], dtype=np.int64).reshape(-1, 2)
        out = batch_of([c for c, _ in articles], np.full(n, -1), keys, 2, 0, np.ones(n), [(np.zeros(n), np.zeros(n))] * SKETCHES)
        articles.clear()
        return out

    for batch in batches:
        for part in common.blocks(batch, "html"):
            for content, host, page in zip(*(part.column(c).to_pylist() for c in ("content", "host", "html"))):
                p = Page(host, page, depth)
                host_key = int.from_bytes(blake2b(host.encode(), digest_size=8).digest(), "little", signed=True)
                beside = [run_keys(host, t, depth, _flagged(open_bits.value, run_hashes(host, t, depth)[0])) for t in p.chrome_streams() if len(t) >= depth]
                if sum(map(len, beside)):
                    chrome.append((np.unique(np.concatenate(beside), axis=0), p.sketch()))
                    size += len(chrome[-1][0])
                    if len(chrome) >= shard_pages or size >= SHARD_RUNS:
                        yield from of_chrome()
                starts = _flagged((article_bits if p.marked else open_bits).value, p.minima)
                keys = run_keys(host, p.tokens, depth, starts)
                first = np.zeros(len(starts), dtype=np.int64)
                if len(starts):
                    first[np.unique(keys, axis=0, return_index=True)[1]] = 1
                if p.marked:  # the article itself, to be counted by host
                    articles.append((content, host_key))
                    if len(articles) >= shard_pages:
                        yield of_articles()
                if len(starts):
                    same = [np.full(len(starts), x) for x in p.sketch()]
                    yield batch_of([content] * len(starts), starts, keys, 2 if p.marked else 0, host_key, first, [(x, x) for x in same])
    yield from of_chrome()
    yield of_articles()


def _bitmap(members: DataFrame, key: str) -> np.ndarray:
    """Bits of the members' keys by their lower bits: 8 MB, at any scale. When it fills up it lets more pass, no fewer."""
    slot = F.pmod(key, F.lit(common.FILTER_BITS)) + 1
    rows = members.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros(common.FILTER_BITS // 8, dtype=np.uint8)
    for bucket, bits in rows.collect():
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def boilerplate(n: int, places: np.ndarray, on: np.ndarray, depth: int, pages: int) -> np.ndarray:
    """Which of a text's n tokens are covered by runs from `places` on, that stand on so many texts.

    A text that is repeated itself isn't deleted. Where fewer than `depth` tokens would stay, only runs on more texts
    are removed, of the least number that lets `depth` tokens (or all) stay: a passage shared with a few copies stays,
    a menu on all pages goes. If nothing could be removed then, a rest that isn't empty stays as it is."""
    most = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        most[places + k] = np.maximum(most[places + k], on)
    level, least = pages, min(depth, n)
    left = int((most < level).sum())
    if left < least:
        raised = int(np.sort(most)[least - 1]) + 1
        if not left or (most >= raised).any():
            level = raised
    return most >= level


def _cleaned(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The bodies, without what the given runs cover."""
    for batch in batches:
        for part in common.blocks(batch, "html"):
            out = []
            for page, runs in zip(part.column("html").to_pylist(), part.column("runs").to_pylist()):
                inner, every, _ = page_blocks(page)
                blocks = inner or every
                if runs:
                    places, on = np.array([(r["place"], r["n"]) for r in runs], dtype=np.int64).T
                    blocks = unique_runs(blocks, boilerplate(len(_tokens("\n".join(blocks))), places, on, depth, 2))
                out.append("\n".join(blocks))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def repeated_runs(rows: DataFrame, depth: int, shard_pages: int, site: int = SITE) -> DataFrame:
    """content, runs (place, n): which runs of `depth` tokens of the bodies of rows (host, html, content) are boilerplate,
    and on how many bodies and dropped parts each stands."""
    minima = common.map_batches(rows.select("host", "html"), partial(_count_minima, depth=depth, shard_pages=shard_pages), MINIMA)
    # dropped parts and bodies without a marked article are one side; articles are another
    open_side = F.when(F.col("kind") < 2, F.lit(0)).otherwise(F.lit(1)).alias("side")
    spans = common.cut(minima.groupBy("m", open_side).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max((F.col("kind") == 1).cast("int")).alias("chrome")).where("lo <> hi"))
    share = rows.sparkSession.sparkContext.broadcast
    open_bits, article_bits = share(_bitmap(spans.where("side = 0"), "m")), share(_bitmap(spans.where("side = 1 or chrome = 1"), "m"))
    find = partial(_places, depth=depth, open_bits=open_bits, article_bits=article_bits, shard_pages=shard_pages)
    found = common.cut(common.map_batches(rows.select("content", "host", "html"), find, PLACES))
    body = found.where("content is not null").dropDuplicates(["content", "place"])
    found = common.cut(body.unionByName(found.where("content is null")))
    body, articles = found.where("place >= 0"), found.where("place = -1").groupBy(F.col("a").alias("host_key")).agg(F.count("*").alias("articles"))

    def differ(kinds: Column) -> Column:
        """Most of the sketches differ among the rows of these kinds."""
        least, most = ([agg(F.when(kinds, F.col(f"{s}_{end}"))) for s in SKETCH_NAMES] for agg, end in ((F.min, "lo"), (F.max, "hi")))
        return sum(F.coalesce((a != b).cast("int"), F.lit(0)) for a, b in zip(least, most)) >= DIFFERING

    article = F.col("kind") == 2
    count = lambda kinds: F.sum(F.when(kinds, F.col("n")).otherwise(0))
    repeats = found.where("place <> -1").groupBy("a", "b").agg(
        differ(~article).alias("open_differ"), differ(article).alias("differ"), F.max(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("chrome"),
        count(~article).alias("n_open"), count(article).alias("n_articles"), F.max(F.when(article, F.col("host_key"))).alias("host_key"),
    ).where("open_differ or differ")
    # only runs of articles ask how many the host has; a host with a third of all runs is split over many tasks
    asked = common.spread_join(repeats.where("differ"), articles, "host_key", how="left")
    repeats = asked.unionByName(repeats.where("not differ").withColumn("articles", F.lit(None).cast("long")))
    sitewide = (F.col("articles") >= site) & (F.col("n_articles") * 2 > F.col("articles"))
    repeats = repeats.select("a", "b", F.col("open_differ").alias("in_open"), (F.col("differ") & (sitewide | ((F.col("chrome") == 1) & F.col("open_differ")))).alias("in_article"), (F.col("n_open") + F.col("n_articles")).alias("n"))
    runs = common.spread_join(body.select("content", "place", "kind", "a", "b"), repeats, "a", "b").where(F.when(article, F.col("in_article")).otherwise(F.col("in_open")))
    return runs.groupBy("content").agg(F.collect_list(F.struct("place", F.greatest("n", F.lit(2)).alias("n"))).alias("runs"))


def html_text(pages: DataFrame, depth: int = 16, shard_pages: int = SHARD_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty html, and pages without any text: an empty text. Repeated rows come out each, with equal texts; a
    page_id or url may be null (pages without a host are taken as one host); an empty table gives an empty one; other
    columns, whatever their names, are not read. Only pages with boilerplate in their body are moved to the places of
    its runs; all others are read where they are. No task holds a host."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host).withColumn("content", common.text_key(F.concat_ws("\n", "host", "html")))
    runs = common.cut(repeated_runs(rows, depth, shard_pages))
    flagged = common.flag_members(rows.drop("host"), "content", runs)
    moved = common.spread_join(flagged.where("_maybe").drop("_maybe"), runs, "content", how="left").select("page_id", "url", "html", "runs")
    stays = flagged.where("not _maybe").select("page_id", "url", "html", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    return common.map_batches(stays, partial(_cleaned, depth=depth), SCHEMA).unionByName(common.map_batches(moved, partial(_cleaned, depth=depth), SCHEMA))
