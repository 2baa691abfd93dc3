"""Operator 10, URL filters: rules first, then host word segmentation and naive Bayes.

Hosts' labels are split into words by unigram Viterbi, with word counts from a seed lexicon and
from the urls themselves; a multinomial naive Bayes over the words of host and path judges urls
that no rule fits. Training labels come from the pages and not from their urls: a page whose text
is noise or full of seed words is unwanted. Seed words stand as a few prior counts besides. A fifth
of the pages, by a hash of the id, is held out of the fit.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

# Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Seed words of unwanted and of wanted sites.
BAD = (
    "adult ads ad affiliate bet bets betting bingo bonus casino cheap clickbait click coupon crack dating discount "
    "doubleclick escort farm free gamble gambling jackpot keygen loan loans lottery malware nude payday phish pills "
    "pharma poker popup porn prize replica roulette seo sex slots spam spins torrent track tracker tracking viagra "
    "warez win winner xxx"
).split()
GOOD = (
    "academy archive article blog book books city code college community course culture data docs education events "
    "forum garden gov group guide health help history home house info journal kitchen learn library map math media "
    "museum music news open paper people photo press project public recipe research review school science shop story "
    "study support team tech travel tutorial university video weather wiki work world"
).split()
#: Words that say nothing about a host.
NEUTRAL = "www m blog com net org edu gov co uk example html php index page http https".split()

#: Cost of a letter of an unknown piece of a host name.
LETTER_COST = 2.5
#: Counts that a seed word has before any page is seen.
SEED_COUNT = 5
#: Shares of a page's words from which on it is unwanted: runs of symbols, and seed words.
NOISE_SHARE, BAD_SHARE = 0.1, 0.05
#: Words that a page must have to be a label.
LEAST_WORDS = 5

#: Most words of a table that is broadcast; a larger one is joined. Results are the same.
MAX_WORDS = 200_000
#: Hosts whose words a worker remembers.
CACHE = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://``, A-Z lower-cased; empty without it or for null."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        both = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, both) if out is None else out.when(fits, both)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


class Segmenter:
    """Unigram Viterbi over host labels; unknown strings cost more the longer they are.

    ``total`` is the count of all words where ``counts`` holds only those that a label may need.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, lengths: Sequence[int] | None = None):
        self.counts = counts
        self.lengths = sorted(set(map(len, counts)) if lengths is None else lengths)  # of known words
        self.whole = math.log((sum(counts.values()) if total is None else total) + 1)
        self.cache: OrderedDict[str, list[str]] = OrderedDict()

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return self.whole - math.log(n) if n else self.whole + LETTER_COST * len(word)

    def label(self, label: str) -> list[str]:
        """The words of a label; ties go to the segmentation whose last word is longest.

        An unknown piece costs so much for each letter, so the best start of one is carried along:
        the work follows the letters and the lengths of known words.
        """
        best: list[tuple[float, int]] = [(0.0, 0)]
        unknown = (0.0, 0)  # least cost up to a start, less its letters' costs
        for end in range(1, len(label) + 1):
            ways = [(unknown[0] + self.whole + LETTER_COST * end, unknown[1])]
            for n in self.lengths:
                if n > end:
                    break
                word = label[end - n : end]
                if word in self.counts:
                    ways.append((best[end - n][0] + self.cost(word), end - n))
            best.append(min(ways))
            unknown = min(unknown, (best[end][0] - LETTER_COST * end, end))
        words, end = [], len(label)
        while end:
            start = best[end][1]
            words.append(label[start:end])
            end = start
        return words[::-1]

    def host(self, host: str) -> list[str]:
        words = self.cache.get(host)
        if words is None:
            words = [w for part in re.findall(r"[^\W_]+", host) for w in self.label(part)]
            self.cache[host] = words
            if len(self.cache) > CACHE:
                self.cache.popitem(last=False)
        return words


def path_words(path: str) -> list[str]:
    """Lower-case words of a path; numbers become their count of digits."""
    return [f"#{len(w)}" if w.isdigit() else w for w in re.findall(r"[^\W_]+", path.lower())]


class Bayes:
    """Multinomial naive Bayes with add-one smoothing; class 1 is unwanted."""

    def __init__(self, words: dict[str, tuple[int, int]], rows: tuple[int, int]):
        sums = [sum(n[c] for n in words.values()) + len(words) + 1 for c in (0, 1)]
        self.gain = {w: self.gain_of(n, sums) for w, n in words.items()}
        self.prior = self.prior_of(rows)

    @staticmethod
    def gain_of(n: tuple[int, int], sums: Sequence[int]) -> float:
        return math.log((n[1] + 1) / sums[1]) - math.log((n[0] + 1) / sums[0])

    @staticmethod
    def prior_of(rows: tuple[int, int]) -> float:
        return math.log((rows[1] + 1) / (rows[0] + 1))

    def odds(self, words: list[str]) -> float:
        return self.prior + sum(self.gain.get(w, 0.0) for w in words)


def _lexicon() -> dict[str, int]:
    return {w: 1000 for w in [*BAD, *GOOD, *NEUTRAL]}


def unigrams(parts: DataFrame) -> DataFrame:
    """(w, n): counts of the parts between separators in all hosts and paths, the seed lexicon added.

    Parts of one letter say nothing, numbers are no words; words of every script and length count.
    A label that is a whole host name may itself be several words: counts are damped, and a label
    of more than 12 letters counts only where it is a part of a path, else it would never be split.
    """
    between = r"[^\p{L}\p{N}]+"
    labels = F.filter(F.split("host", between), lambda w: F.char_length(w) <= 12)
    piece = F.explode(F.concat(labels, F.split(F.lower("path"), between)))
    counted = parts.select(piece.alias("w")).where(r"char_length(w) > 1 and w rlike '^\\p{L}+$'").groupBy("w").count()
    seen = counted.select("w", (1 + F.floor(F.log1p("count"))).cast("long").alias("n"))
    seeds = parts.sparkSession.createDataFrame(list(_lexicon().items()), "w string, n long")
    return seen.union(seeds).groupBy("w").agg(F.sum("n").alias("n"))


#: What of a page is not its text: scripts, styles, comments, tags.
HIDDEN = r"(?s)<(?:script|style|SCRIPT|STYLE)\b.*?</(?:script|style|SCRIPT|STYLE)\s*+>|<!--.*?-->|<[^>]*+>"


def label_of(html: Column) -> Column:
    """1 for a page whose text is noise or full of seed words, 0 for another, null without enough words."""
    text = F.lower(F.regexp_replace(html, HIDDEN, " "))

    def counts(t: Column) -> Column:
        bad = F.size(F.filter(F.split(t, "[^a-z]++"), lambda w: w.isin(BAD)))
        return F.struct(F.regexp_count(t, F.lit(r"\S++")).alias("words"), F.regexp_count(t, F.lit(r"[%*#$~^|=_]{3,}+")).alias("noise"), bad.alias("bad"))

    def label(c: Column) -> Column:
        unwanted = (c["noise"] >= NOISE_SHARE * c["words"]) | (c["bad"] >= BAD_SHARE * c["words"])
        return F.when(c["words"] >= LEAST_WORDS, unwanted.cast("int"))

    # lambdas, so that a text is cut once and not once for each count
    return F.transform(F.transform(F.array(text), counts), label)[0]


def held_out(key: Column) -> Column:
    """Whether a page is held out of the fit (null ids are one id)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _fits(words: DataFrame) -> bool:
    return words.limit(MAX_WORDS + 1).count() <= MAX_WORDS


def _tokens(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with ``words``: words of the host, then of the path; ``counts`` is written."""
    if not _fits(counts):
        return _joined_tokens(rows, counts)
    sent = rows.sparkSession.sparkContext.broadcast({r["w"]: r["n"] for r in counts.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(sent.value)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            words = [[*segmenter.host(h), *path_words(p)] for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], names=[*batch.schema.names, "words"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("words", T.ArrayType(T.StringType()))]))


def _joined_tokens(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``_tokens`` with each distinct host's substrings joined to the counts."""
    total, lengths = counts.agg(F.sum("n"), F.collect_set(F.char_length("w"))).first()
    hosts = materialize(rows.select("host").distinct(), "url-hosts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in batch.column("host").to_pylist():
                parts = re.findall(r"[^\W_]+", h)
                found = list({p[a : a + n] for p in parts for n in lengths for a in range(len(p) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.string()), pa.array(found, pa.string())], names=["host", "w"])

    known = hosts.mapInArrow(cut, "host string, w string").join(counts, "w").groupBy("host").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("host").to_pylist()
            tables = [{e["w"]: e["n"] for e in k or ()} for k in batch.column("known").to_pylist()]
            words = [Segmenter(t, total, lengths).host(h) for h, t in zip(names, tables, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(words, pa.list_(pa.string()))], names=["host", "host_words"])

    given = rows.columns
    of_host = hosts.join(known, "host", "left").mapInArrow(split, "host string, host_words array<string>")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("host_words").to_pylist(), batch.column("path").to_pylist(), strict=True)
            words = [[*h, *path_words(p)] for h, p in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(words, pa.list_(pa.string()))], names=[*given, "words"])

    return rows.join(of_host, "host").select(*given, "host_words").mapInArrow(
        paths, T.StructType([*rows.schema.fields, T.StructField("words", T.ArrayType(T.StringType()))])
    )


def _scored(tokens: DataFrame, counted: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """The tokens with ``odds``; ``counted`` is the written table of all words."""
    if _fits(counted):
        model = Bayes({r["w"]: (r["n0"], r["n1"]) for r in counted.collect()}, sizes)
        sent = tokens.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                odds = [sent.value.odds(w) for w in batch.column("words").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], names=[*batch.schema.names, "odds"])

        return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("odds", T.DoubleType())]))
    all_ = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    sums, prior = [all_[c] + all_["n"] + 1 for c in ("n0", "n1")], Bayes.prior_of(sizes)
    gain = counted.select("w", (F.log((F.col("n1") + 1) / sums[1]) - F.log((F.col("n0") + 1) / sums[0])).alias("gain"))
    # rows of equal words have equal odds, so each list of words is scored once
    lists = materialize(tokens.select("words").distinct(), "url-lists").select(F.monotonically_increasing_id().alias("at"), "words")
    lists = materialize(lists, "url-lists-numbered")
    each = lists.select("at", F.explode("words").alias("w")).join(gain, "w").groupBy("at").agg(F.sum("gain").alias("gain"))
    odds = lists.join(each, "at", "left").select("words", (F.lit(prior) + F.coalesce("gain", F.lit(0.0))).alias("odds"))
    return tokens.join(odds, "words").select(*tokens.columns, "odds")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id_col, host, path, rule, verdict, words, odds, label, held_out for every row.

    rule is the longest rule that fits (``com/fr/``; null if none) and verdict its verdict, else
    ``block`` where the log odds of the words are above 0. label is what the page's text says (see
    ``label_of``; null without ``html_col``), held_out whether the fit left the row out. Null urls
    and urls without ``://`` have an empty host and path, no words, and the verdict of the prior.
    Repeated rows and hosts are judged alike; an empty table gives an empty result; other columns
    are not looked at.
    """
    host, path = split_url(F.col("url"))
    label = label_of(F.col(f"`{html_col}`")) if html_col in pages.columns else F.lit(None).cast("int")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), label.alias("label"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), "label", held_out(F.col("id")).alias("held_out"))
    tokens = materialize(_tokens(rows, materialize(unigrams(rows), "url-unigrams")), "url-words")
    labelled = tokens.where("label is not null and not held_out").select("label", "words")
    sizes = labelled.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    seen = (
        labelled.select("label", F.explode("words").alias("w"))
        .groupBy("w")
        .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    )
    prior = [(w, 0, SEED_COUNT) for w in BAD] + [(w, SEED_COUNT, 0) for w in GOOD]
    seeds = pages.sparkSession.createDataFrame(prior, "w string, n0 long, n1 long")
    counted = seen.unionByName(seeds).groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    scored = _scored(tokens, materialize(counted, "url-counts"), (sizes["n0"], sizes["n1"]))
    fits = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", fits["rule"].alias("rule"),
        F.coalesce(fits["verdict"], F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"),
        "words", "odds", "label", "held_out",
    )


def contract(judged: DataFrame) -> DataFrame:
    """``judge``'s result with the words joined."""
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), F.round("odds", 6).alias("odds"), "label", "held_out"
    )
