"""Phrases of a dictionary found in texts with a few letters wrong."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.sequence import common_length, letter_places

#: The phrases of each kind of directive, and the kinds in order of detection.
PHRASES = {
    "Unblock": (
        "desbloqueo de cuenta", "desbloqueo de cuentas", "desbloqueo de fondos", "desbloqueo de recursos",
        "desaseguramiento de fondos", "desaseguramiento de cuenta", "desaseguramiento de recursos",
        "liberación de fondos", "liberación de recursos", "liberación de cuenta",
        "descongelamiento de recursos", "descongelamiento de fondos",
        "levantamiento de aseguramiento", "levantamiento del aseguramiento", "levantamiento de bloqueo", "levantamiento del bloqueo",
        "desembargo de cuenta", "desembargo de cuentas",
        "desbloquear cuenta", "desbloquear cuentas", "liberar fondos", "liberar recursos", "descongelar recursos",
    ),
    "Block": (
        "aseguramiento de fondos", "aseguramiento de la cuenta", "aseguramiento de cuentas", "aseguramiento de recursos", "aseguramiento precautorio",
        "bloqueo de cuenta", "bloqueo de cuentas", "bloqueo de fondos", "bloqueo temporal", "bloqueo preventivo",
        "congelamiento de recursos", "congelamiento de fondos", "congelamiento de activos",
        "embargo de cuenta", "embargo de cuentas", "embargo precautorio",
        "inmovilización de recursos", "inmovilización de fondos", "retención de fondos", "retención de recursos",
        "asegurar fondos", "asegurar recursos", "bloquear cuenta", "bloquear cuentas", "congelar recursos", "embargar cuenta", "retener fondos",
    ),
    "Transfer": (
        "transferencia de fondos", "transferencia de recursos", "transferencia bancaria", "transferencia electrónica",
        "giro de fondos", "giro bancario", "traspaso de fondos", "traspaso de recursos", "envío de fondos", "remisión de fondos",
        "transferir fondos", "transferir recursos", "enviar fondos", "girar fondos",
    ),
    "Document": (
        "solicitud de documentación", "solicitud de documentos", "solicito estados de cuenta", "estados de cuenta", "solicito información",
        "entrega de documentación", "entrega de documentos", "presentación de documentación", "presentación de documentos",
        "expedición de constancia", "expedición de certificado", "expedición de comprobante",
        "certificación de saldos", "certificación de movimientos", "constancia de saldos",
        "documentación correspondiente", "documentación requerida", "documentación solicitada",
        "expedir constancia", "expedir certificado", "entregar documentos", "presentar documentación", "proporcionar documentación",
    ),
    "Information": (
        "solicitud de información", "petición de información", "requerimiento de información", "información solicitada", "información requerida",
        "reporte de movimientos", "reporte de operaciones", "reporte de saldos",
        "notificación de operaciones", "notificación de movimientos", "comunicación de datos", "comunicación de información",
        "informar sobre", "reportar movimientos", "reportar operaciones", "comunicar información", "proporcionar información",
    ),
}
THRESHOLD = 0.85
#: Words of texts that are counted at once, and scores that are kept; they bound memory and change no result.
WORDS = 1 << 15
SCORES = 100_000


class PhraseScores:
    """Finds, for each phrase, the score of the window of words most like it, where that reaches the threshold.

    Windows have from one word less than the phrase to two more. How many letters window and phrase share, whatever their
    order, bounds the common subsequence from above, so only windows that the bound admits are compared letter by letter.
    The bounds are computed for the windows of many texts at once, a letter at a time, as bytes."""

    def __init__(self, phrases: list[str], threshold: float = THRESHOLD):
        self.phrases = [p.strip().upper() for p in phrases]
        self.least = 100 * threshold - 0.5  # a ratio is rounded to a whole number of hundredths
        letters = sorted(set("".join(self.phrases)) - {" "})
        # rows of counts: a letter each, then characters that no phrase has, then spaces
        self.other, self.space = len(letters), len(letters) + 1
        self.row = np.full(max([ord(x) for x in letters], default=0) + 2, self.other)
        self.row[[ord(x) for x in letters]] = range(len(letters))
        rows = {x: i for i, x in enumerate(letters)} | {" ": self.space}
        self.bags = [[(rows[x], p.count(x)) for x in sorted(set(p))] for p in self.phrases]
        self.sizes = [len(p) for p in self.phrases]
        words = [len(p.split()) for p in self.phrases]
        self.spans = [(max(1, n - 1), n + 2) for n in words]
        self.most = max(n + 2 for n in words)
        # the fewest letters shared and the longest window with which a phrase can still reach the threshold
        self.fewest = [math.ceil(n * self.least / (200 - self.least) - 1e-9) for n in self.sizes]
        self.longest = [math.floor(n * (200 - self.least) / self.least + 1e-9) for n in self.sizes]
        self.places = [letter_places(p) for p in self.phrases]
        self.known: dict[tuple[int, str], float] = {}

    def __call__(self, texts: list[str]) -> list[dict[int, float]]:
        """Of each text the best scores by number of the phrase; phrases without a window that the bound admits lack."""
        out: list[dict[int, float]] = [{} for _ in texts]
        lengths, block, n = [], [], 0
        for i, text in enumerate(texts):
            up = text.upper()
            lengths.append(len(up))
            words = [w for w in up.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
            for at in range(0, len(words), WORDS):  # pieces of a long text overlap, so no window is lost
                piece = words[at : at + WORDS + self.most - 1]
                block.append((i, piece))
                n += len(piece)
                if n >= WORDS:
                    self._score(block, lengths, out)
                    block, n = [], 0
        if block:
            self._score(block, lengths, out)
        return out

    def _score(self, block: list[tuple[int, list[str]]], lengths: list[int], out: list[dict[int, float]]) -> None:
        line = " ".join(" ".join(words) for _, words in block)
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        gaps = np.flatnonzero(codes == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(codes)]))
        owner = np.repeat(np.arange(len(block)), [len(words) for _, words in block])
        of_word = np.repeat(np.arange(len(starts)), ends - starts)
        rows = self.row[np.minimum(codes[codes != 32], len(self.row) - 1)]
        counts = np.bincount(rows * len(starts) + of_word, minlength=(self.other + 1) * len(starts)).reshape(self.other + 1, -1)
        sums = np.zeros((self.other + 1, len(starts) + 1), dtype=np.int32)
        np.cumsum(counts, axis=1, out=sums[:, 1:])
        bags, firsts, lasts, edges = [], [], [], [0, 0]  # windows by their number of words
        for size in range(1, self.most + 1):
            first = np.arange(len(starts) - size + 1)
            last = first + size - 1
            # of one text, of a length that some phrase admits, and without more strange characters than any phrase of such a
            # length would: of the window, as of the phrase, the share of least / (200 - least) must be in common
            long = ends[last] - starts[first]
            own = long - (sums[self.other, last + 1] - sums[self.other, first])
            fits = (owner[first] == owner[last]) & (long <= max(self.longest)) & (own >= min(self.fewest)) & (own * (200 - self.least) >= long * self.least - 1e-6)
            first, last = first[fits], last[fits]
            bags.append(np.concatenate((np.minimum(sums[:, last + 1] - sums[:, first], 255), np.full((1, len(first)), size - 1, dtype=np.int32))).astype(np.uint8))
            firsts.append(first)
            lasts.append(last)
            edges.append(edges[-1] + len(first))
        bag, first, last = np.ascontiguousarray(np.concatenate(bags, axis=1)), np.concatenate(firsts), np.concatenate(lasts)
        length = ends[last] - starts[first]
        short = np.minimum(length, 255).astype(np.uint8)
        shared, part = np.empty(len(first), dtype=np.uint8), np.empty(len(first), dtype=np.uint8)
        for p, letters in enumerate(self.bags):
            a, b = edges[self.spans[p][0]], edges[self.spans[p][1] + 1]
            bound, some = shared[a:b], part[a:b]
            bound.fill(0)
            for k, n in letters:
                np.minimum(bag[k, a:b], n, out=some)
                bound += some
            near = np.flatnonzero((bound >= self.fewest[p]) & (short[a:b] <= self.longest[p]))
            near = near[200 * bound[near].astype(np.int64) >= self.least * (length[a + near] + self.sizes[p])]
            for w in (a + near).tolist():
                i = block[owner[first[w]]][0]
                if self.sizes[p] <= lengths[i]:
                    out[i][p] = max(out[i].get(p, 0.0), self._ratio(p, line[starts[first[w]] : ends[last[w]]]))

    def _ratio(self, p: int, window: str) -> float:
        score = self.known.get((p, window))
        if score is None:
            if len(self.known) >= SCORES:
                self.known.clear()
            score = int(200 * common_length(self.phrases[p], window, self.places[p]) / (len(window) + self.sizes[p]) + 0.5) / 100
            self.known[p, window] = score
        return score


_FIRST = [sum(map(len, list(PHRASES.values())[:i])) for i in range(len(PHRASES) + 1)]
_ALL = [p for phrases in PHRASES.values() for p in phrases]


def directives_of(text: str, scores: PhraseScores) -> list[tuple[str, float, str]]:
    """Of each kind the phrase of the best score, the first of equals, if it reaches the threshold."""
    return _best_of(scores([text])[0])


def _best_of(best: dict[int, float]) -> list[tuple[str, float, str]]:
    out = []
    for kind, a, b in zip(PHRASES, _FIRST, _FIRST[1:]) if best else ():
        own = [(s, -p) for p, s in best.items() if a <= p < b and s >= THRESHOLD]
        if own:
            score, p = max(own)
            out.append((kind, score, _ALL[-p]))
    return out


@pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("score", DoubleType()), StructField("phrase", StringType())])))
def semantic_directives(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of each kind that has a phrase in the text the best one, the first of equals; null counts as empty."""
    scores = PhraseScores(_ALL)
    for texts in batches:
        yield pd.Series([[{"kind": k, "score": s, "phrase": p} for k, s, p in _best_of(best)] for best in scores([t or "" for t in texts])], dtype=object)


def as_actions(found: Column) -> Column:
    """Directives as actions with whole confidences of 0 to 100; none gives Ignore with 50."""
    actions = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), F.floor(x["score"] * 100).cast("int").alias("confidence")))
    return F.when(F.size(actions) > 0, actions).otherwise(F.array(F.struct(F.lit("Ignore").alias("kind"), F.lit(50).alias("confidence"))))
