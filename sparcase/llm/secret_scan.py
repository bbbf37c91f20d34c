"""Secret scans: base patterns, and credentials in several parts, linked within scopes.

Weak candidates (short access identifiers, bare or labelled values that look random, endpoints) are common and harmless
alone. They are reported only where complementary parts share a scope: an access identifier and a secret, or a secret
and an endpoint, at most `scope` characters apart and in the same paragraph.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, redacted string"
#: Fixed by the contract: the kinds in their order.
BASE = ("assign", "access", "hex")
LINKED = ("weak_access", "weak_secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ACCESS = re.compile(r"""\b(?:AKIA|ASIA)[A-Z0-9]{8,}|\b(?:client|account|access|tenant|app)[_ -]?(?:key[_ -]?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{6,})|\buser(?:name)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+""", re.IGNORECASE | re.ASCII)
ENDPOINT_HINTS = ("://", "host", "endpoint", "server")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def random_like(s: str, bits: float) -> bool:
    """Whether letters of both cases and digits, or letters and digits of many kinds, come mixed."""
    n = len(s)
    if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= bits


def linked_spans(text: str, base: list[Span], scope: int = 200, bits: float = 3.5) -> list[Span]:
    """Weak candidates with a complementary part, base or weak, in their scope."""
    low = text.lower()
    weak: list[Span] = []
    if "akia" in low or "asia" in low or "id" in low or "user" in low:
        weak += [("weak_access", *m.span()) for m in WEAK_ACCESS.finditer(text)]
    if any(h in low for h in ENDPOINT_HINTS):
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not weak and not base:
        return []  # a value alone has no complement
    weak += [("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if random_like(m[0], bits)]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans up to each

    def covered(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i > 0 and reach[i - 1] > a

    weak = [s for s in weak if not covered(s[1], s[2])]
    role = {"access": "id", "weak_access": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "place"}
    parts: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "place": []}
    for kind, a, b in sorted(weak + base, key=lambda s: s[1]):
        parts[role[kind]].append((a, b))
    ends = {k: list(accumulate((b for _, b in v), max)) for k, v in parts.items()}
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]

    def near(a: int, b: int, other: str) -> bool:
        """An interval join: the other parts' intervals against this one, widened by the scope. No part before the first
        whose running maximum of ends reaches the scope can be in it."""
        i = bisect.bisect_left(ends[other], a - scope)
        for x, y in parts[other][i:]:
            if x > b + scope:
                return False
            if y >= a - scope and (x, y) != (a, b):
                lo, hi = min(b, y), max(a, x)
                k = bisect.bisect_left(breaks, lo)
                if hi <= lo or k == len(breaks) or breaks[k] >= hi:
                    return True
        return False

    wants = {"id": ("secret",), "secret": ("id", "place"), "place": ("secret",)}
    return [s for s in weak if any(near(s[1], s[2], o) for o in wants[role[s[0]]])]


def show(spans: list[Span], kinds: tuple[str, ...] = BASE + LINKED) -> str:
    """kind:start:end by start, then by kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of spans that overlap replaced by [SECRET]."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(texts: list[str], scope: int, bits: float) -> Iterator[tuple[list[Span], list[Span]]]:
    for text in texts:
        base = base_spans(text)
        yield base, linked_spans(text, base, scope, bits)


def _run(batches: Iterator[pa.RecordBatch], scope: int, bits: float, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        for part in common.blocks(batch):
            texts, rows = part.column("text").to_pylist(), []
            for text, (base, more) in zip(texts, _scan(texts, scope, bits)):
                n = Counter(k for k, *_ in base)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more), len(more), redact(text, base + more) if with_text else None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.record_batch([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)


def secret_scan(docs: DataFrame, scope: int = 200, bits: float = 3.5, with_text: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for every row: counts of base spans, their digest, all spans, and the text with all of them redacted.

    Null and empty texts have no spans: counts of 0, the digest of nothing, an empty list. Row by row, without a
    shuffle, so repeated rows and null ids stay as they are. The parts of a document are joined by a sweep over their
    sorted intervals; only parts within the scope meet."""
    return common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), partial(_run, scope=scope, bits=bits, with_text=with_text), SCHEMA)


def _redact(batches: Iterator[pa.RecordBatch], scope: int, bits: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.blocks(batch):
            texts = part.column("text").to_pylist()
            out = [None if t is None else redact(t, base + more) for t, (base, more) in zip(texts, _scan([t or "" for t in texts], scope, bits))]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def redact_documents(docs: DataFrame, scope: int = 200, bits: float = 3.5) -> DataFrame:
    """The same rows and columns, secrets in `text` replaced by [SECRET]. Texts without secrets, and null ones, stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_batches(docs, partial(_redact, scope=scope, bits=bits), schema)
