"""Line-first cleaning: rules per line, failing lines removed, then documents that lose too much text rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed_lines long, removed_chars long, clean_text string"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Odd 64-bit multipliers, one for each place of a window.
MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, WINDOW + 1)], dtype=np.uint64)
TERMINAL = ".!?…:;\"'”’»)。！？"
#: Set phrases of the languages of the corpus; each is a pattern of its own.
PHRASES = {
    "en": r"cookie(?:s| policy| settings)|privacy policy|terms (?:of use|of service|and conditions)|all rights reserved|copyright \d|enable javascript|lorem ipsum|click here|read more|sign (?:in|up)\b|log ?in\b|subscribe|newsletter|share (?:this|on)|skip to (?:main )?content|back to top",
    "fr": r"politique de confidentialité|conditions (?:générales|d['’]utilisation)|mentions légales|tous droits réservés|cliquez ici|lire la suite|en savoir plus|se connecter|s['’]inscrire|abonnez-vous|partager (?:sur|cet)|aller au contenu|haut de page|activer javascript",
    "de": r"datenschutz(?:erklärung|richtlinie)|nutzungsbedingungen|allgemeine geschäftsbedingungen|impressum|alle rechte vorbehalten|hier klicken|weiterlesen|mehr erfahren|(?:hier|jetzt) (?:anmelden|registrieren|abonnieren)|teilen auf|zum inhalt springen|nach oben|javascript aktivieren",
    "es": r"política de (?:privacidad|cookies)|condiciones (?:de uso|generales)|términos y condiciones|aviso legal|todos los derechos reservados|haga clic aquí|haz clic|leer más|seguir leyendo|iniciar sesión|regístrate|suscríbe(?:te|se)|compartir en|saltar al contenido|volver arriba|habilitar javascript",
}
BOILERPLATE = re.compile("|".join(rf"\b(?:{p})" for p in PHRASES.values()), re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of what a document may lose."""

    max_symbol_share: float = 0.10  #: of a line's characters, those of SYMBOLS
    max_shout_share: float = 0.5  #: of a line's words, those that end with two marks of exclamation or question
    menu_words: int = 3  #: a line of so few words, none ending in a full stop or the like, is a menu item
    menu_marks: int = 2  #: so many bars or arrows, in a line without a closing mark, make a menu
    boilerplate_words: int = 20  #: a line of up to so many words with a set phrase is boilerplate
    max_run: int = 4  #: a word may stand so often in succession
    max_lost: float = 0.5  #: of a document's characters in words
    min_words: int = 20
    max_repeat_percent: int = 30


RULES = Rules()


def line_fails(line: str, words: list[str], rules: Rules = RULES) -> str | None:
    """The first rule that a line with words fails."""
    if sum(map(line.count, SYMBOLS)) > rules.max_symbol_share * len(line):
        return "symbols"
    if ("!!" in line or "??" in line) and sum(w.endswith(("!!", "??")) for w in words) > rules.max_shout_share * len(words):
        return "punctuation"
    closed = words[-1][-1] in TERMINAL
    if not closed and (len(words) <= rules.menu_words or sum(map(line.count, "|»›→")) >= rules.menu_marks):
        return "navigation"
    if len(words) <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) > rules.max_run:
        run = 1
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            if run > rules.max_run:
                return "repetition"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.uint64, count=len(words))
    if len(code) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        keys += mixed[i : i + n] * MULTIPLIERS[i]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0  # equal windows have equal keys
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    places = np.flatnonzero(again)  # windows whose key comes twice; now the windows themselves
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[places]
    _, inverse, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    twice = places[count[inverse.reshape(-1)] > 1]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def judge(text: str, rules: Rules = RULES) -> tuple:
    """The values of SCHEMA after doc_id."""
    words = text.encode(errors="surrogatepass").split()  # of bytes: splits at the six ASCII spaces alone
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen, duplicates, lines, removed, lost, clean = set(), 0, 0, 0, 0, []
    for line in text.split("\n"):
        own = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
        if not own:
            clean.append(line)
            continue
        lines += 1
        if line in seen:
            duplicates += 1
        seen.add(line)
        if line_fails(line, own, rules):
            removed += 1
            lost += sum(map(len, own))
        else:
            clean.append(line)
    repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    kept = not failed and lost <= rules.max_lost * word_chars
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), duplicates, repeat, failed, kept, lines, removed, lost, "\n".join(clean)


def _run(batches: Iterator[pa.RecordBatch], rules: Rules, with_text: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        for part in common.blocks(batch):
            columns = list(zip(*(judge(t, rules) for t in part.column("text").to_pylist())))
            if not with_text:
                columns[-1] = [None] * part.num_rows
            yield pa.record_batch([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)


def quality_rules(docs: DataFrame, rules: Rules = RULES, with_text: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for every row: the counts, base_failed, kept, the lines removed and (with_text) the text without them.

    Null and empty texts have no words, so they fail. A line without words is never removed. Repeated rows and null
    ids stay; other columns are not read. Row by row, without a shuffle."""
    return common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), partial(_run, rules=rules, with_text=with_text), SCHEMA)
