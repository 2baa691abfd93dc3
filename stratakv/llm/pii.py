"""Operator 3, personal data: weak supervision over pattern matches.

Patterns propose spans; regex, gazetteer and context labelers each vote on every span for, against
or not at all. Expectation-maximisation over the counts of equal votes estimates how reliable each
labeler is for each kind, and the posteriors train a logistic span classifier on features of the
span and its surroundings. Base spans always stay; proposed spans of the other kinds are added
where the classifier says so. Native: DataFrame functions only; the driver sees counts of votes
and features, whose number is bounded by their definition, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_where, join_spans, materialize, text_or_empty, with_spans

# The patterns of the base kinds. Quantifiers are possessive and a match starts at
# the end of the last one or where no character of its first class stands before, so that no text
# makes them backtrack; the matches are those of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method may add.
EXTRA = {
    "email_words": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}(?![0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
KINDS = [*BASE, *EXTRA]
# Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io dev app co us uk de fr es it nl be ch at se no fi dk pl pt ie ca au nz jp cn in br mx ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split()
CARD_ISSUERS = "4 51 52 53 54 55 34 37 36 38 6011 65 22 23 24 25 26 27 35 62".split()
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
# Words before a span that speak for or against it, by kind.
CUES = {
    "email": r"mail|contact|write|reach|correo|courriel|kontakt|escribe",
    "ip": r"\bip\b|host|server|address|login|logged|from|dirección|adresse|auf",
    "card": r"card|visa|master|amex|credit|debit|pay|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|cell|fax|sms|llama|appel|anruf|móvil",
    "email_words": r"mail|contact|write|reach|correo|courriel|kontakt",
    "phone_local": r"phone|tel|call|mobile|cell|fax|sms|llama|appel|anruf|móvil",
    "social": r"ssn|social|security|tax",
    "iban": r"iban|bank|account|konto|cuenta|compte|transfer",
    "ipv6": r"\bip|host|server|address",
}
AGAINST = r"version|\bver\b|release|\bv$|isbn|issn|\bdoi\b|order|invoice|ref\b|serial|build|§|\bno\.? ?$|#$"
LABELERS = ("shape", "gazetteer", "cue", "against", "edges")
#: Number of values of each classifier feature.
FEATURES = {"kind": len(KINDS), "length": 4, "digits": 3, "left": 4, "right": 4, "cue": 2}


@dataclass(frozen=True)
class Fit:
    """Rounds of expectation-maximisation and of Newton steps, ridge, and the span threshold."""

    rounds: int = 60
    newton: int = 12
    ridge: float = 1.0
    threshold: float = 0.5


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(
            F.split(v, r"\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
            & (F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.when((F.length(digits) >= 16) & (F.length(digits) <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (F.length(digits) >= 8) & (F.length(digits) <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0 (no vote)."""
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def _any_prefix(v: Column, prefixes: Sequence[str]) -> Column:
    return v.rlike("^(?:" + "|".join(prefixes) + ")")


def _votes(kind: str, s: Column) -> dict[str, Column]:
    v, left, right = s["value"], F.lower(s["left"]), s["right"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    domain = F.lower(F.regexp_extract(v, r"([A-Za-z0-9-]+)$", 1))
    shape = {
        "email": _vote(domain.rlike("^[a-z]{2,24}$") & ~v.rlike(r"^[.]|[.]@|\.\."), domain.rlike("^[0-9-]")),
        "ip": _vote(v.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), v.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(n == 16, n > 16),
        "phone": _vote((n >= 10) & (n <= 13), n < 9),
        "email_words": _vote(domain.rlike("^[a-z]{2,24}$"), F.length(domain) < 2),
        "phone_local": _vote((n >= 9) & (n <= 12), n < 8),
        "social": _vote(~v.rlike("^(?:000|666|9)|-00-|-0000$"), v.rlike("^(?:000|666|9)|-00-|-0000$")),
        "iban": _vote((F.length(F.replace(v, F.lit(" "), F.lit(""))) >= 15) & (n >= 10), n < 8),
        "ipv6": _vote(v.rlike("[0-9]") & ~v.rlike("^(?:0:){7}"), v.rlike("^(?:0:){7}")),
    }[kind]
    gazetteer = {
        "email": _vote(domain.isin(TOP_DOMAINS)),
        "ip": _vote(F.lit(False), v.rlike(r"^(?:0|127|255|22[4-9]|2[34][0-9]|25[0-5])\.|\.0\.0\.0$")),
        "card": _vote(_any_prefix(digits, CARD_ISSUERS), v.rlike("^0")),
        "phone": _vote(_any_prefix(digits, CALLING_CODES), v.rlike(r"^\+0")),
        "email_words": _vote(domain.isin(TOP_DOMAINS), ~domain.isin(TOP_DOMAINS)),
        "phone_local": _vote(F.lit(False)),
        "social": _vote(F.lit(False), v.isin("123-45-6789", "078-05-1120")),
        "iban": _vote(F.left(v, F.lit(2)).isin(IBAN_COUNTRIES), ~F.left(v, F.lit(2)).isin(IBAN_COUNTRIES)),
        "ipv6": _vote(v.rlike("^(?:2|3|f[cde])"), v.rlike("^(?i)2001:0?db8:")),
    }[kind]
    return {
        "shape": shape,
        "gazetteer": gazetteer,
        "cue": _vote(left.rlike(CUES[kind])),
        "against": _vote(F.lit(False), F.right(left, F.lit(12)).rlike(AGAINST)),
        "edges": _vote(
            left.rlike(r"(?:^|[\s(<\[\"':,;=])$") & right.rlike(r"^(?:$|[\s)>\]\"',;!?]|\.(?:\s|$))"),
            left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]"),
        ),
    }


def _around(c: Column) -> Column:
    """Class of a neighbouring character: 0 none or space, 1 letter or digit, 2 bracket or quote, 3 other."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}_]"), 1).when(c.rlike("^[(\\[<{>})\\]\"']"), 2).otherwise(3)


def _features(kind: str, s: Column, cue: Column) -> dict[str, Column]:
    v = s["value"]
    n = F.length(v)
    share = F.length(F.regexp_replace(v, "[^0-9]", "")) * 10 / n
    return {
        "kind": F.lit(KINDS.index(kind)),
        "length": F.when(n < 12, 0).when(n < 18, 1).when(n < 26, 2).otherwise(3),
        "digits": F.when(share < 3, 0).when(share < 8, 1).otherwise(2),
        "left": _around(F.right(s["left"], F.lit(1))),
        "right": _around(F.left(s["right"], F.lit(1))),
        "cue": F.when(cue > 0, 1).otherwise(0),
    }


def proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, spans): every proposed span with its votes and features, by kind, then start; written."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")
    )
    t = F.col("text")
    need = {
        "email": F.contains(t, F.lit("@")),
        "phone": F.contains(t, F.lit("+")),
        "email_words": t.rlike(r"(?i)[\[(]at[\])]"),
        "ipv6": F.contains(t, F.lit(":")),
    }
    found = with_spans(rows, "text", {k: (p, need.get(k)) for k, p in (BASE | EXTRA).items()})

    def spans(kind: str) -> Column:
        def span(s: Column) -> Column:
            votes = _votes(kind, s)
            features = _features(kind, s, votes["cue"])
            return F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.struct(*(votes[k].cast("int").alias(k) for k in LABELERS)).alias("votes"),
                F.struct(*(features[k].cast("int").alias(k) for k in FEATURES)).alias("features"),
            )

        return F.transform(F.filter(kind, lambda s: _valid(kind, s["value"])), span)

    return materialize(found.select("uid", "id", F.concat(*(spans(k) for k in KINDS)).alias("spans")), "pii")


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, fit: Fit) -> np.ndarray:
    """The posterior of each (kind, votes) row, by expectation-maximisation within each kind.

    A labeler is described by the chances of its three votes given the span's truth (with a prior
    count of one each, more for the side it means to take); the share of true spans starts at 0.7.
    """
    posterior = np.full(len(counts), 0.5)
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        v, n = votes[rows] + 1, counts[rows].astype(float)
        labelers = v.shape[1]
        prior = np.ones((2, labelers, 3))
        prior[1, :, 2] += 2
        prior[0, :, 0] += 2
        chance, share = prior / prior.sum(axis=2, keepdims=True), 0.7
        for _ in range(fit.rounds):
            log = [
                math.log(p) + sum(np.log(chance[y, j, v[:, j]]) for j in range(labelers))
                for y, p in ((0, 1 - share), (1, share))
            ]
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            share = min(max((float((p * n).sum()) + 1) / (float(n.sum()) + 2), 1e-3), 1 - 1e-3)
            chance = prior.copy()
            for y, q in ((0, (1 - p) * n), (1, p * n)):
                for j in range(labelers):
                    chance[y, j] += np.bincount(v[:, j], weights=q, minlength=3)
            chance /= chance.sum(axis=2, keepdims=True)
        posterior[rows] = p
    return posterior


def span_classifier(features: np.ndarray, soft: np.ndarray, counts: np.ndarray, fit: Fit) -> tuple[float, list[list[float]]]:
    """Logistic regression on one-hot features with soft labels: (bias, weights by feature and value)."""
    widths = list(FEATURES.values())
    offsets = np.cumsum([1, *widths])
    x = np.zeros((len(counts), int(offsets[-1])))
    x[:, 0] = 1
    for j in range(len(widths)):
        x[np.arange(len(counts)), offsets[j] + features[:, j]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(fit.newton):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (soft - p)) - fit.ridge * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + fit.ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(hessian, gradient), -4, 4)
    return float(w[0]), [[float(a) for a in w[offsets[j] : offsets[j + 1]]] for j in range(len(widths))]


def train(spans: DataFrame, fit: Fit) -> tuple[float, list[list[float]]]:
    """Labelers' reliabilities, then the classifier, from the counts of equal (votes, features)."""
    counted = (
        spans.select(F.explode("spans").alias("s"))
        .groupBy(*(F.col(f"s.features.{k}").alias(f"f_{k}") for k in FEATURES), *(F.col(f"s.votes.{k}").alias(f"v_{k}") for k in LABELERS))
        .count()
        .collect()
    )  # at most the product of the numbers of values
    if not counted:
        return 0.0, [[0.0] * n for n in FEATURES.values()]
    table = np.array(sorted(tuple(r) for r in counted), dtype=np.int64)
    features, votes, counts = table[:, : len(FEATURES)], table[:, len(FEATURES) : -1], table[:, -1].astype(float)
    soft = reliabilities(features[:, 0], votes, counts, fit)
    return span_classifier(features, soft, counts, fit)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit: Fit = Fit()) -> DataFrame:
    """Personal data of every row: id_col, n_email, n_ip, n_card, n_phone, base, found.

    base: the spans (kind, start, end, chance) of the base kinds by kind, then start; found: those,
    then the spans of the other kinds whose chance of being personal is ``fit.threshold`` or more
    and that overlap no base span. Null texts count as empty; empty texts and tables give no spans;
    repeated rows are rows of their own. Columns of ``docs`` other than the two are not looked at.
    """
    spans = proposals(docs, id_col, text_col)
    bias, weights = train(spans, fit)
    tables = [F.array(*(F.lit(w) for w in values)) for values in weights]

    def chance(s: Column) -> Column:
        z = F.lit(bias)
        for k, t in zip(FEATURES, tables, strict=True):
            z = z + F.get(t, s["features"][k])
        return F.round(1 / (1 + F.exp(-z)), 6)

    judged = spans.withColumn(
        "spans",
        F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), chance(s).alias("chance"))),
    )
    judged = judged.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    judged = judged.withColumn(
        "added",
        F.filter(
            "spans",
            lambda s: ~s["kind"].isin(*BASE)
            & (s["chance"] >= fit.threshold)
            & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        ),
    )
    counts = [count_where("base", "kind", k).alias(f"n_{k}") for k in BASE]
    return judged.select(F.col("id").alias(id_col), *counts, "base", F.concat("base", "added").alias("found"))


def contract(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``find``'s result, with the number of added spans."""
    return found.select(
        id_col,
        *(f"n_{k}" for k in BASE),
        F.sha2(join_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_added"),
    )
