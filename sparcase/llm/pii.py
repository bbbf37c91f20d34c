"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns: those of the contract (base spans, which always stay) and weaker ones. Four
labelers vote on each candidate, for, against or not at all: its own form (checks such as Luhn's), a gazetteer
(top-level domains, card issuers, dialling codes, first names), words for it just before it, and words against it
there. The votes are counted by kind and pattern of votes, at most a few hundred rows. On these counts
expectation-maximisation estimates each labeler's reliability, and a logistic span classifier is trained on the
resulting probabilities. It is applied to every candidate as a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents

#: Fixed by the contract: the base kinds in their order. Weak kinds follow.
BASE = ("email", "ip", "card", "phone")
WEAK = ("hidden_email", "local_phone", "id_number", "name")
KINDS = BASE + WEAK
LABELERS = ("form", "gazetteer", "context", "against")

#: Possessive, and beginning only where a run begins (or where the last match ended), so that no text, however long,
#: takes deep recursion or quadratic time; they match what the contract's patterns match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
#: Whole runs of 16 to 19 digits; longer and shorter runs fail the contract's check anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HIDDEN_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}\x20?(?:[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z]{2,10}\b"
LOCAL_PHONE = r"(?<![0-9+.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b"
NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Sr|Sra|Monsieur|Madame|Mme)\.?\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?:\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)?"

TOP_LEVEL = ["com", "org", "net", "edu", "gov", "int", "mil", "info", "io", "eu", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "mx", "us", "ca", "br", "ar", "jp", "cn", "in", "au"]
DIALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91"]
FIRST_NAMES = ["james", "john", "robert", "michael", "maria", "anna", "peter", "thomas", "juan", "josé", "carlos", "luis", "pierre", "jean", "marie", "hans", "klaus", "sabine", "mary", "patricia", "linda", "david", "daniel", "laura", "sofia", "elena", "paul", "martin"]
CONTEXT = {
    "email": r"(?i)e-?mail|correo|courriel|contact|write",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|master|credit|karte|carte|tarjeta|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|telefon|teléfono|llam",
    "hidden_email": r"(?i)e-?mail|correo|courriel|contact|write|reach",
    "local_phone": r"(?i)phone|tel|call|mobile|fax|telefon|teléfono|llam",
    "id_number": r"(?i)ssn|social|security|iban|passport|tax|steuer|identi|account|konto|cuenta|compte",
    "name": r"(?i)name|nom\b|nombre|dear|signed|contact|attn",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|serial|part|model|ref|section|chapter|figure|table|page)\b[^.]{0,12}$"
BEFORE = 40
#: The weight of the classifier's prior rows, all of the candidates weighing 1.
PRIOR = 0.05

SPAN = "struct<start: int, end: int, value: string>"


#: Matches whose places are summed up together.
RUN = 512


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: start, end (code points) and value. Places are summed up from the lengths
    of the matches and of what lies between them, in runs of RUN matches, so that the time grows with their number."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("size")))
    spans = f"array<{SPAN}>"

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["m"].alias("value")).cast(SPAN)
        return F.struct((start + x["size"]).alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    def placed(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.expr(f"cast(array() as {spans})").alias("out")), add, lambda done: done["out"])

    def in_runs(all_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, RUN))

        def later(done: Column, run: Column) -> Column:
            size = F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
            return F.struct((done["at"] + size).alias("at"), F.concat(done["out"], F.array(F.struct(done["at"].alias("at"), run.alias("run")))).alias("out"))

        none = F.filter(F.transform(runs, lambda run: F.struct(F.lit(0).alias("at"), run.alias("run"))), lambda x: F.lit(False))
        starts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("out")), later, lambda done: done["out"])
        return F.flatten(F.transform(starts, lambda x: placed(x["run"], x["at"])))

    many = lambda all_: F.when(F.size(all_) <= RUN, placed(all_, F.lit(0))).otherwise(in_runs(all_))
    return F.element_at(F.transform(F.array(pairs), many), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def holds(kind: str, value: Column) -> Column:
    """The kind's own check."""
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.when(F.length(short(p)) <= 3, short(p)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def gazetteer(kind: str, value: Column) -> Column:
    """1, -1 or 0: what the lists say."""
    low = F.lower(value)
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    if kind in ("email", "hidden_email"):
        return vote(F.regexp_extract(low, r"([a-z]+)$", 1).isin(TOP_LEVEL))
    if kind == "ip":
        return vote(~value.rlike(r"^(?:0|127|255)\."), value.rlike(r"^(?:0|127|255)\."))
    if kind == "card":
        return vote(digits(value).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"))
    if kind == "phone":
        return vote(reduce(lambda a, b: a | b, (digits(value).startswith(c) for c in DIALLING)))
    if kind == "local_phone":
        return vote(digits(value).rlike("^[2-9][0-9]{2}[2-9]"), digits(value).rlike("^[01]"))
    if kind == "id_number":
        return vote(F.lit(False), value.rlike("^(?:000|666|9)"))
    return vote(F.exists(F.split(low, " "), lambda w: w.isin(FIRST_NAMES)))


def votes(kind: str, value: Column, before: Column, good: Column) -> Column:
    """Each labeler's vote, as an array in the order of LABELERS."""
    form = F.when(good & F.lit(kind in BASE), 1).when(~good, -1).otherwise(0)
    return F.array(form, gazetteer(kind, value), F.when(before.rlike(CONTEXT[kind]), 1).otherwise(0), F.when(before.rlike(AGAINST), -1).otherwise(0)).cast("array<int>")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: an array of kind, start, end, base and votes, for every row of (doc_id, text)."""
    text = F.col("text")
    digit = text.rlike("[0-9]{3}")
    gates = {
        "email": (EMAIL, text.contains("@")),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, digit | text.rlike(r"[0-9][\x20-][0-9]")),
        "phone": (PHONE, text.contains("+")),
        "hidden_email": (HIDDEN_EMAIL, text.rlike(r"(?i)[(\[\x20]dot[)\]\x20]")),
        "local_phone": (LOCAL_PHONE, digit & text.rlike("[0-9]{4}")),
        "id_number": (ID_NUMBER, text.rlike("[0-9]{2}")),
        "name": (NAME, text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Sr|Sra|Monsieur|Madame|Mme)\b")),
    }
    kind_type = "array<struct<kind: int, start: int, end: int, base: boolean, votes: array<int>>>"
    columns = []

    def told(kind: str) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            good = holds(kind, s["value"])
            before = F.substring(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(BEFORE)))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (good & F.lit(kind in BASE)).alias("base"), votes(kind, s["value"], before, good).alias("votes"))

        return one

    for kind, (pattern, gate) in gates.items():
        columns.append(F.when(gate, F.transform(matches(text, pattern), told(kind)).cast(kind_type)).otherwise(F.expr(f"cast(array() as {kind_type})")))
    return docs.select("doc_id", F.concat(*columns).alias("found"))


@dataclass
class Model:
    """The span classifier: a weight for each kind, and for each labeler's votes for and against."""

    bias: float
    kinds: dict[int, float]
    weights: dict[tuple[int, int], float]
    reliability: dict[int, float]

    def score(self, span: Column) -> Column:
        logit = F.lit(self.bias) + reduce(lambda a, b: a + b, (F.when(span["kind"] == k, w).otherwise(0.0) for k, w in self.kinds.items()), F.lit(0.0))
        for (j, v), w in self.weights.items():
            logit = logit + F.when(span["votes"][j] == v, w).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def estimate(table: list[tuple[int, tuple[int, ...], int]], rounds: int = 50, steps: int = 2000) -> Model:
    """EM over counts of (kind, votes), then a logistic classifier fitted to the probabilities.

    A labeler's reliability is the probability that a vote of its, for or against, is right; not to vote says nothing. A
    priori it is 0.9, and a weak kind is personal data once in four. These priors weigh as much as ten spans, so labels
    come out sensibly from few candidates, and from none at all; a kind's own prior weighs as much as its spans, as
    labelers that never vote on the same span would else let its share drift to one or nought."""
    prior = {k: 0.9 if k < len(BASE) else 0.25 for k in range(len(KINDS))}
    strength, expected = 10.0, 0.9
    right = dict.fromkeys(range(len(LABELERS)), expected)
    share = dict(prior)

    def posterior(kind: int, vote: tuple[int, ...]) -> float:
        odds = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(right[j] / (1 - right[j])) for j, v in enumerate(vote))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    for _ in range(rounds):
        post = [(k, vote, n, posterior(k, vote)) for k, vote, n in table]
        for k in share:
            own = [(n, p) for kind, _, n, p in post if kind == k]
            size = sum(n for n, _ in own)
            share[k] = (sum(n * p for n, p in own) + (size + strength) * prior[k]) / (2 * size + strength)
        for j in right:
            voted = [(n, p if vote[j] > 0 else 1 - p) for _, vote, n, p in post if vote[j]]
            right[j] = min(0.99, max(0.55, (sum(n * p for n, p in voted) + strength * expected) / (sum(n for n, _ in voted) + strength)))
    # the classifier: kinds and votes as features, trained on the counts; plain gradient steps on the expected loss. Rows of
    # the model's own, of a weight of PRIOR in all against 1, decide only what no candidate says anything about
    own_votes = ((0, 0, 0, 0), (0, 1, 1, 0), (0, 0, 1, 0), (0, 1, 0, 0), (0, 0, 0, -1), (1, 1, 1, 0), (-1, 0, 0, 0), (0, 1, 1, -1))
    rows = [(k, vote, PRIOR / len(KINDS) / len(own_votes), posterior(k, vote)) for k in range(len(KINDS)) for vote in own_votes]
    total = {k: sum(n for kind, _, n in table if kind == k) for k in range(len(KINDS))}
    there = sum(n > 0 for n in total.values())
    rows += [(k, vote, n / total[k] / there, posterior(k, vote)) for k, vote, n in table]  # a rare kind counts as much as a frequent one
    places = [(j, v) for j in range(len(LABELERS)) for v in (-1, 1)]
    x = np.array([[1.0, *(float(k == kind) for kind in range(len(KINDS))), *(float(vote[j] == v) for j, v in places)] for k, vote, _, _ in rows])
    weight, wanted = np.array([w for _, _, w, _ in rows]), np.array([p for *_, p in rows])
    w = np.zeros(x.shape[1])
    decay = np.r_[0.0, np.full(x.shape[1] - 1, 1e-4)]
    for _ in range(steps):
        off = weight * (1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - wanted)
        w -= 2.0 * (off @ x / weight.sum() + decay * w)
    bias, kinds, weights = float(w[0]), dict(enumerate(w[1 : 1 + len(KINDS)].tolist())), dict(zip(places, w[1 + len(KINDS) :].tolist()))
    return Model(bias, kinds, weights, right)


def pii(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Base spans always stay. Of the other candidates those whose score reaches the threshold are added, but for ones that
    overlap a base span. Null and empty texts have no spans: counts of 0, the digest of nothing, an empty list. Row by
    row but for one count by kind and votes, whose size is bounded, so repeated rows and null ids stay as they are."""
    found = cut(candidates(documents(docs, id_col=id_col, text_col=text_col)))
    counted = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n"))
    table = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted.collect())  # at most 8 kinds by 3 ** 4 votes
    model = estimate(table)
    base = F.filter("found", lambda s: s["base"])
    added = F.filter("found", lambda s: (s["kind"] >= len(BASE)) & (model.score(s) >= threshold) & ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    names = F.array(*(F.lit(k) for k in KINDS))

    def show(spans: Column) -> Column:
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = found.withColumn("base", base).withColumn("added", added)
    of = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
