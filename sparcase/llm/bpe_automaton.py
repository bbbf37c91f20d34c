"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton reads tokens. It accepts exactly the token sequences that the merges produce, so a text has one path.
Compilation starts from the automaton of one state with an arc for each byte and applies the merges in order, each by
a merge gadget. The gadget of (u, v) -> t

* removes the arc v from u's state: after u, v can't follow any more,
* gives t a state of its own, a copy of v's state as it was before,
* adds an arc t, leading there, beside every arc u.

Copies aren't written out: a state is the one it was copied from, the merge at which it was copied and the arcs
removed since, so its arcs are read off that chain, and found ones go to a transition table. Encoding a word follows,
from each position in turn, the arcs whose labels match the bytes there. Each prefix has exactly one path, so each
position gets one state, and the path back from the end gives the ids. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct words, and known transitions, that a worker keeps before it starts anew. They bound memory, not results.
KEEP_WORDS, KEEP_ARCS = 250_000, 2_000_000
#: White space as Unicode's White_Space property has it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's own pre-split pattern: for plain texts, and for any.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
ANY_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for
    themselves, the others, in order, for the bytes that are left."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The tokenization automaton of a list of merges over byte-level tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        byte = byte_of_char()
        size = max([*vocab.values(), *(added or {}).values()]) + 1
        self.label: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.label[i] = bytes(byte[c] for c in t)
        for t, i in (added or {}).items():
            self.label[i] = t.encode()
        self.added = dict(added or {})
        self.start = size  # the first state; each other is named by the token whose arcs lead to it
        self.parent = [self.start] * (size + 1)
        self.born = [-1] * (size + 1)  # the merge at which a state was copied from its parent
        self.removed: list[dict[int, int]] = [{} for _ in range(size + 1)]
        self.made = [NEVER] * size  # the merge that made a token; bytes were there before the first
        self.left = [-1] * size
        reach = {}
        for t, i in vocab.items():
            if len(t) == 1:
                self.made[i] = -1
                reach[self.label[i]] = i
        for k, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if self.made[t] != NEVER or not self.has_arc(u, v, k - 1):
                continue  # no path takes u and then v, so the gadget adds nothing
            self.removed[u][v] = k
            self.parent[t], self.born[t] = v, k
            self.left[t], self.made[t] = u, k
            reach[self.label[t]] = t
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.at: list[int] = [-1]  # the token that ends at a node
        for word, t in reach.items():
            node = 0
            for c in word:
                after = self.trie.get(node << 8 | c)
                if after is None:
                    after = self.trie[node << 8 | c] = len(self.at)
                    self.at.append(-1)
                node = after
            self.at[node] = t
        self.arcs: dict[int, bool] = {}  # state * 2 ** 20 + token -> whether that arc is there, as far as asked for
        self.words: dict[str, bytes] = {}

    def has_arc(self, state: int, token: int, k: int) -> bool:
        """Whether the state had an arc of that token once merge k was done."""
        while True:
            made = self.made[token]
            if made > k or self.removed[state].get(token, NEVER) <= k:
                return False
            if made < self.born[state]:
                k = self.born[state] - 1  # it was there, or not, when the state was copied
                state = self.parent[state]
            elif made < 0:
                return True
            else:
                token, k = self.left[token], made  # it was added where its left part had an arc

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        state, token = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = self.start
        trie, at, arcs = self.trie, self.at, self.arcs
        for i in range(n):
            s, node = state[i], 0
            for j in range(i, n):
                node = trie.get(node << 8 | word[j])
                if node is None:
                    break
                t = at[node]
                if t >= 0 and state[j + 1] < 0:
                    there = arcs.get(s << 20 | t)
                    if there is None:
                        if len(arcs) >= KEEP_ARCS:
                            arcs.clear()
                        there = arcs[s << 20 | t] = self.has_arc(s, t, NEVER - 1)
                    if there:
                        state[j + 1] = token[j + 1] = t
        out = []
        while n:
            out.append(token[n])
            n -= len(self.label[token[n]])
        return out[::-1]

    def split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_WORDS.findall(text)
        import regex

        return regex.findall(ANY_WORDS, text)

    def parts(self, text: str) -> list[tuple[str, int]]:
        """The text between special strings, with -1, and those, with their ids."""
        if not any(t in text for t in self.added):
            return [(text, -1)]
        cuts = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
        return [(x, self.added[x] if i % 2 else -1) for i, x in enumerate(cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            split.append([(self.split(x), i) for x, i in self.parts(text)])
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        words = self.words
        for w in {w for parts in split for some, i in parts if i < 0 for w in some}:
            if w not in words:
                words[w] = np.array(self.encode_word(w.encode()), "<u4").tobytes()
        get = words.__getitem__
        return [b"".join(b"".join(map(get, some)) if i < 0 else np.array([i], "<u4").tobytes() for some, i in parts) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes. A cut inside a character gives U+FFFD, as the library's decoder does."""
        out = b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode(errors="replace").encode()


def compile_file(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


@common.worker_cache
def automaton(path: str) -> Automaton:
    """One per Python worker."""
    return compile_file(path)


def _run(batches: Iterator[pa.RecordBatch], path: str, output: str) -> Iterator[pa.RecordBatch]:
    known = automaton(path)
    for batch in batches:
        for part in common.blocks(batch):
            ids = known.encode(part.column("text").to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if output == "ids":
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), flat)
                yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])
            else:
                a = [hashlib.sha256(x).hexdigest() for x in ids]
                b = [hashlib.sha256(known.decode(x)).hexdigest() for x in ids]
                yield pa.record_batch([part.column("doc_id"), n, pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer_path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of every row. Null and empty texts have no ids; special strings give their ids."""
    run = partial(_run, path=tokenizer_path or default_path(), output="ids")
    return common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), run, "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = automaton(path)
    for batch in batches:
        text = [None if x is None else known.decode(np.array(x, "<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])


def decode(ids: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids). Null ids give a null text."""
    run = partial(_decode, path=tokenizer_path or default_path())
    return common.map_batches(ids.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded again, in one pass.

    Null and empty texts: no ids, the digests of nothing. Row by row, so repeated rows and null ids stay as they are."""
    run = partial(_run, path=tokenizer_path or default_path(), output="digests")
    return common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), run, SCHEMA)
