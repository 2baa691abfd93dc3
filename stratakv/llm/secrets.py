"""Operator 8, secret scans: corpus-wide ownership frequency of candidate secrets.

Candidates are found by pattern in whole texts; their values' digests are then counted over the
corpus by distinct repository and owner. A value that several owners publish is a copied example;
one that a single owner holds and that looks random is reported as live. Native: DataFrame
functions only; the table of values is joined, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, count_where, join_spans, materialize, text_or_empty, with_spans

# The patterns of the base kinds, with possessive quantifiers wherever what follows
# can't start with a character of the class, so that no text makes them backtrack.
BASE = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
}
#: Kinds that the method adds when they look live: key files, signed web tokens, vendor tokens,
#: passwords in addresses, long mixed-case random words.
EXTRA = {
    "pem": r"-----BEGIN (?:(?!PRIVATE )[A-Z]++ )*+PRIVATE KEY-----(?:[^-]++|-(?!----))*+-----END (?:(?!PRIVATE )[A-Z]++ )*+PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "vendor": r"(?:gh[opusr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{30,}+)",
    "basic": r"://[^\s:/@]++:[^\s:/@]{6,}+@",
    "random": r"(?<![A-Za-z0-9+/_=-])(?!gh[opusr]_|eyJ|AIza|[rs]k_live_|xox)[A-Za-z0-9+/_-]{32,}+",
}
#: The part of an assignment that is the value.
ASSIGNED = r"""[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)$"""
#: The body of a key file.
KEY_BODY = r"(?s)^-----[^-]++-----(.*)-----[^-]++-----$"
#: Characters whose kinds are counted in a value, besides all beyond ASCII, which count as one.
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
#: Uses of a value beyond which its statistics go to its occurrences by broadcast and not by its key.
HOT_USES = 10_000
#: Most rows of such hot values that are broadcast (about 60 bytes each).
BROADCAST_VALUES = 1_000_000
#: Words of values that are placeholders wherever they stand.
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your[_-]|xxxx|0000000|1234567|abcdefg|redacted|sample"


@dataclass(frozen=True)
class Ownership:
    """Bounds: a value of so many owners is an example; live needs so many different characters."""

    example_owners: int = 3
    distinct_chars: int = 8


def _key(span: Column) -> Column:
    """The body of a key file without spaces and line ends, so copies wrapped otherwise are equal."""
    return F.regexp_replace(F.regexp_extract(span["value"], KEY_BODY, 1), r"\s+", "")


def _kinds(value: Column) -> Column:
    """How many different characters a value has."""
    seen = F.filter(F.array(*(F.lit(c) for c in PRINTABLE)), lambda c: F.contains(value, c))
    return F.size(seen) + value.rlike(r"[^\x00-\x7F]").cast("int")


def _candidates(kind: str, base: bool, order: int, column: str) -> Column:
    """Spans of a kind that pass its check, as (start, order, kind, end, base, value)."""
    c = F.col(column)
    checks = {
        "assign": lambda s: F.length(F.regexp_extract(s["value"], ASSIGNED, 1)) >= 12,
        "access": lambda s: F.length(s["value"]) >= 18,
        "pem": lambda s: F.length(_key(s)) >= 16,
        "random": lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"),
    }
    values = {
        "assign": lambda s: F.regexp_extract(s["value"], ASSIGNED, 1),
        "pem": _key,
        "basic": lambda s: F.regexp_extract(s["value"], r"^://[^:]++:(.*)@$", 1),
    }
    kept = F.filter(c, checks[kind]) if kind in checks else c
    value = values.get(kind, lambda s: s["value"])
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            F.substring(F.sha2(value(s).cast("binary"), 256), 1, 32).alias("digest"),
            value(s).rlike(PLACEHOLDER).alias("placeholder"),
            _kinds(value(s)).alias("chars"),
        ),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: Sequence[str]) -> DataFrame:
    """(uid, id, owner, repo, found): the candidates of every row, ordered by start, then kind; written."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repo_cols)))).alias("repo"),
        text.alias("text"),
    )
    t = F.col("text")
    need = {"access": F.contains(t, F.lit("AKIA")), "pem": F.contains(t, F.lit("-----BEGIN ")), "jwt": F.contains(t, F.lit("eyJ")), "basic": F.contains(t, F.lit("://"))}
    kinds = BASE | EXTRA
    spans = with_spans(rows, "text", {k: (p, need.get(k)) for k, p in kinds.items()}, near=1)
    every = F.concat(*(_candidates(k, k in BASE, i, k) for i, k in enumerate(kinds)))
    return materialize(spans.select("uid", "id", "owner", "repo", F.array_sort(every).alias("found")), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_uses, n_repos, n_owners) of every candidate value; sums before each shuffle."""
    uses = found.select(F.explode("found.digest").alias("digest"), "owner", "repo")
    by_repo = uses.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("digest").agg(
        F.sum("n").alias("n_uses"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners")
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: Sequence[str] = ("source", "lang"),
    rule: Ownership = Ownership(),
) -> DataFrame:
    """Secrets of every row: id_col, n_assign, n_access, n_hex, base, found.

    base: the spans (start, order, kind, end) of the base kinds. found: base spans and the live
    spans of the other kinds that overlap no base span, each with its digest, the value's distinct
    owners and repositories over all rows, and its class: ``example`` (a placeholder, or held by
    ``rule.example_owners`` owners or more), ``live`` (one owner, ``rule.distinct_chars``
    different characters or more) or ``shared``. ``owner_col`` and ``repo_cols`` name what stands for
    an owner and a repository (the given documents have neither, so a source is the owner and a
    source's language a repository). A key file counts by its body. Null texts count as empty; null owners are one
    owner; repeated rows are rows of their own and count as uses; an empty table gives an empty
    result. Columns of ``docs`` other than those named are not looked at.
    """
    rows = candidates(docs, id_col, text_col, owner_col, repo_cols)
    stats = materialize(ownership(rows), "secret-values")
    placed = rows.select("uid", F.explode("found").alias("s")).select("uid", "s", F.col("s.digest").alias("digest"))
    example = F.col("s.placeholder") | (F.col("n_owners") >= rule.example_owners)
    live = (F.col("n_owners") == 1) & (F.col("s.chars") >= rule.distinct_chars)
    # occurrences of widely copied values stay where they are; the others meet their few by key
    hot = bounded_broadcast(stats.where(F.col("n_uses") > HOT_USES), BROADCAST_VALUES)
    known = placed.join(hot, "digest").unionByName(
        placed.join(hot.select("digest"), "digest", "left_anti").join(stats.where(F.col("n_uses") <= HOT_USES), "digest")
    )
    judged = known.select(
        "uid",
        F.struct(
            "s.start", "s.order", "s.kind", "s.end", "s.base", "digest", "n_uses", "n_repos", "n_owners",
            F.when(example, "example").when(live, "live").otherwise("shared").alias("class"),
        ).alias("s"),
    )
    by_row = judged.groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("found"))
    none = F.array().cast(by_row.schema["found"].dataType)
    out = rows.select("uid", "id").join(by_row, "uid", "left").withColumn("found", F.coalesce("found", none))
    out = out.withColumn("base", F.filter("found", lambda s: s["base"]))
    out = out.withColumn(
        "found",
        F.filter(
            "found",
            lambda s: s["base"]
            | ((s["class"] == "live") & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
        ),
    )
    counts = [count_where("base", "kind", k).alias(f"n_{k}") for k in BASE]
    return out.select(F.col("id").alias(id_col), *counts, "base", "found")


def contract(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``scan``'s result, with counts of live and example values."""
    by_class = [count_where("found", "class", k).alias(f"n_{k}") for k in ("live", "example")]
    return found.select(
        id_col,
        *(f"n_{k}" for k in BASE),
        F.sha2(join_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["class"]), ",").alias("classes"),
        *by_class,
    )
