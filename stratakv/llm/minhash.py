"""Operator 5, near-dedup: DartMinHash signatures in bands, exact checks, connected components.

Each text is a weighted set of word shingles. Darts are thrown at the (element, weight) strips
below the set's weights: the arrival times of a strip's darts are a Poisson process hashed from
the element, so two sets see the same darts wherever both have weight. Every dart belongs to one
coordinate of the signature; the earliest dart of a coordinate is its value, and coordinates of
two sets agree with the chance of their weighted Jaccard similarity. The number of darts is about
k ln k + 2k for a whole set, whatever its size, besides one look at each element.

Signatures are cut into bands. Every member of a bucket is checked against the bucket's leader on
its full shingle set, unless links found before already join the two; buckets whose members are then still in different components are searched
for every remaining link between them, in blocks. Components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, give_back, materialize, text_or_empty
from .decontamination import split_words
from .sentencepiece_sampling import mix, uniform

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Largest number of candidate texts' keys (about 40 bytes each) that is broadcast.
BROADCAST_KEYS = 500_000
#: Shingles (16 bytes each) and rows of one block of a bucket that is searched.
BLOCK_SHINGLES = 1_000_000
BLOCK_ROWS = 500
#: Shingles handled at once while signatures are made.
RUN_SHINGLES = 150_000
#: Word hashes that a worker remembers.
KEPT_WORDS = 150_000


@dataclass(frozen=True)
class Banding:
    """Shingle length, similarity of a link, bands and rows of a band.

    With 32 bands of 6 a pair of similarity 0.8 shares no band once in 17,000 times.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6
    seed: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(hasher: Hasher, texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of all distinct shingles, sorted by text, then shingle.

    The weight is the number of times the shingle occurs. A text of fewer words, but not none, has
    one shingle, all its words.
    """
    every: list[bytes] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = split_words(t)
        n[i] = len(own)
        every += own
    h = hasher.of(every)
    start = np.cumsum(n) - n
    k = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), k)
    at = np.repeat(start - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    end = np.repeat(start + n, k)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(words, dtype=np.uint64)])
    for j in range(words):
        word = np.where(at + j < end, padded[at + j], np.uint64(0))
        out = mix(out * _GOLD + word)
    order = np.lexsort((out, text))
    text, out = text[order], out[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (out[1:] != out[:-1])
    first = np.flatnonzero(new)
    return text[first], out[first], np.diff(np.append(first, len(out))).astype(np.float64)


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int) -> np.ndarray:
    """(n, k) uint64 signatures of n weighted sets; sets without elements have all zeros.

    Strips of an element's weight are [0, 1), [1, 2), [2, 4), ...; the darts of a strip arrive at
    its width's rate, each at a hashed weight within the strip, and count if that is below the
    element's weight. Times run to a threshold that throws k ln k + 2k darts per set on average; it
    doubles for sets that still have an empty coordinate.
    """
    best = np.full(n * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    total = np.bincount(text, weights=weight, minlength=n)
    limit = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    salt = np.uint64((seed * int(_GOLD)) % 2**64)
    # strips: (element row, lower bound, width)
    strips, low, width = [np.arange(len(text))], [np.zeros(len(text))], [np.ones(len(text))]
    bound = 1.0
    while True:
        rows = np.flatnonzero(weight > bound)
        if not len(rows):
            break
        strips.append(rows)
        low.append(np.full(len(rows), bound))
        width.append(np.full(len(rows), bound))
        bound *= 2
    strip, low, width = np.concatenate(strips), np.concatenate(low), np.concatenate(width)
    key = mix(element[strip] ^ mix(np.where(low > 0, np.log2(np.maximum(low, 1)) + 1, 0).astype(np.uint64) + salt))
    time = np.zeros(len(strip))
    number = np.zeros(len(strip), dtype=np.uint64)
    todo = np.arange(len(strip))
    waiting = np.zeros(n, dtype=bool)
    waiting[np.unique(text)] = True
    while waiting.any():
        todo_now = np.flatnonzero(waiting[text[strip]])
        while len(todo_now):
            i = todo_now
            # the next dart of each strip; it stays the next one while it is beyond the threshold
            u = uniform(key[i], number[i] * np.uint64(2))
            at = time[i] - np.log(u) / width[i]
            inside = at < limit[text[strip[i]]]
            i, at = i[inside], at[inside]
            time[i] = at
            dart = mix(key[i] + (number[i] * np.uint64(2) + np.uint64(1)) * _GOLD)
            number[i] += np.uint64(1)
            where = low[i] + width[i] * ((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = where < weight[strip[i]]
            if hit.any():
                d, t = dart[hit], at[hit]
                # rank in the upper 32 bits, a name of the dart in the lower ones
                rank = np.minimum(t / RANK_SPAN * 2.0**32, 2.0**32 - 1).astype(np.uint64)
                name = mix(d ^ np.uint64(0xD1B54A32D192ED03)) & np.uint64(0xFFFFFFFF)
                coordinate = (mix(d + _GOLD) % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, text[strip[i[hit]]] * k + coordinate, (rank << np.uint64(32)) | name)
            todo_now = i
        empty = (best.reshape(n, k) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        waiting &= empty
        limit[waiting] *= 2
    out = best.reshape(n, k)
    out[total == 0] = 0
    return out & np.uint64(0xFFFFFFFF)


#: Times of darts are compared in steps of this span's 2^32-th part: large enough for one shingle.
RANK_SPAN = 4096.0


def band_keys(signatures: np.ndarray, how: Banding) -> np.ndarray:
    """(n, bands) int64 keys of the bands' rows; the band is part of the key."""
    out = np.zeros((len(signatures), how.bands), dtype=np.uint64)
    parts = signatures.reshape(len(signatures), how.bands, how.rows)
    out += mix(np.arange(1, how.bands + 1, dtype=np.uint64) * _GOLD)[None, :]
    for r in range(how.rows):
        out = mix(out * _GOLD + parts[:, :, r])
    return out.view(np.int64)


def text_key(text: Column) -> Column:
    """16 bytes of SHA-256: equal for identical texts only."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _runs(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Slices of texts with about ``size`` words (5 characters a word), a longer text alone."""
    first = chars = 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > 5 * size:
            yield first, i
            first = i
            chars = 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def signed(docs: DataFrame, id_col: str, text_col: str, how: Banding, weights: str) -> DataFrame:
    """(uid, id, node, bands) of every row: node is the text's key, bands null without words."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        text_or_empty(text_col).alias("text"),
    ).select("uid", "id", text_key(F.col("text")).alias("node"), "text")
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in _runs(texts, RUN_SHINGLES):
                text, element, weight = shingles(hasher, texts[a:b], how.words)
                if weights == "binary":
                    weight = np.ones(len(weight))
                keys = band_keys(dart_signatures(text, element, weight, b - a, how.size, how.seed), how)
                some = np.bincount(text, minlength=b - a) > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(b - a + 1) * how.bands, pa.int32()), pa.array(keys.ravel()), mask=pa.array(~some)
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["uid", "id", "node", "bands"])

    return rows.mapInArrow(lambda b: give_back(run(b)), schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): component is the least node reached.

    Labels go along edges in both directions and are then looked up once more (pointer jumping),
    so rounds grow with the logarithm of a component's diameter; they go on until no label moves.
    Every round is written, so none is computed twice, and the round before the last is removed.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels"
    )
    while True:
        seen = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("m")), "b")
            .groupBy("a")
            .agg(F.min("m").alias("m"))
        )
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved")
        )
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = materialize(
            nearer.join(jump, "component", "left").select(
                "node",
                F.least("component", F.coalesce("further", "component")).alias("component"),
                (F.col("moved") | (F.col("further") < F.col("component"))).alias("moved"),
            ),
            "labels",
        )
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of (shingle, weight as bits) pairs of rows."""
    x, y = a.reshape(2, -1), b.reshape(2, -1)
    wx, wy = x[1].view(np.float64), y[1].view(np.float64)
    at = np.searchsorted(y[0], x[0])
    at[at == len(y[0])] = 0
    same = y[0][at] == x[0] if len(y[0]) else np.zeros(len(x[0]), dtype=bool)
    common = float(np.minimum(wx[same], wy[at[same]]).sum())
    return common / max(float(wx.sum() + wy.sum()) - common, 1e-300)


def _payload(docs: DataFrame, text_col: str, wanted: DataFrame, how: Banding, weights: str) -> DataFrame:
    """(nid, set): the shingles and weights of each wanted text once. Only their rows leave the scan."""
    rows = docs.select(text_or_empty(text_col).alias("text")).withColumn("node", text_key(F.col("text")))
    rows = rows.join(bounded_broadcast(wanted, BROADCAST_KEYS), "node").select("nid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts, nids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            once = np.unique(nids, return_index=True)[1]
            texts, nids = [texts[i] for i in once.tolist()], nids[once]
            for a, b in _runs(texts, RUN_SHINGLES):
                text, element, weight = shingles(hasher, texts[a:b], how.words)
                if weights == "binary":
                    weight = np.ones(len(weight))
                cut = np.searchsorted(text, np.arange(b - a + 1))
                sets = [np.stack([element[i:j], weight[i:j].view(np.uint64)]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(nids[a:b]), pa.array(sets, pa.binary())], names=["nid", "set"])

    found = rows.mapInArrow(lambda b: give_back(run(b)), "nid long, set binary")
    return found.groupBy("nid").agg(F.first("set").alias("set"))


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are so similar."""
    both = pairs.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("nid").alias("b"), F.col("set").alias("set_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _numbers(batch.column(2)), _numbers(batch.column(3))
            keep = pa.array([_weighted_jaccard(x, y) >= similarity for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return both.select("a", "b", "set_a", "set_b").mapInArrow(lambda b: give_back(run(b)), "a long, b long")


def _leader_links(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between members and leaders of buckets, and the components (node, component) of all of them.

    A text meets the leader of its largest bucket first, so there is one pair a text and not one a
    band. Of the other members' and leaders' pairs only those are left whose ends are then still in
    different components: the others could not change a component.
    """
    pair = (F.least("nid", "leader").alias("a"), F.greatest("nid", "leader").alias("b"))
    first = members.where("nid != leader").groupBy("nid").agg(F.max_by("leader", F.struct("size", "key")).alias("leader"))
    first = materialize(first.select(*pair).distinct(), "pairs")
    links = materialize(_checked(first, sets, similarity), "links")
    labels = components(links)
    placed = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn(
        "component", F.coalesce("component", "nid")
    )
    heads = placed.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.max(F.when(F.col("nid") == F.col("leader"), F.col("component"))).alias("head"),
    )
    apart = placed.join(heads.where("least < most").select("key", "head"), "key").where("component != head")
    others = apart.select(*pair).distinct().join(first, ["a", "b"], "left_anti")
    more = materialize(_checked(others, sets, similarity), "links")
    if more.isEmpty():
        return links, labels
    links = links.unionByName(more)
    return links, components(links)


def block_links(nid: np.ndarray, component: np.ndarray, query: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between queries and members of other components, one for each pair of components that meet.

    All similarities of a query are counted at once through the lists of members by shingle.
    """
    sizes = np.array([len(s) // 2 for s in sets])
    token = np.concatenate([s.reshape(2, -1)[0] for s in sets])
    weight = np.concatenate([s.reshape(2, -1)[1] for s in sets]).view(np.float64)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    by, first = np.unique(token[order], return_index=True)
    last = np.append(first[1:], len(order))
    member_by, weight_by = member[order], weight[order]
    total = np.bincount(member, weights=weight, minlength=len(sets))
    parent = {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for q in np.flatnonzero(query).tolist():
        own = sets[q].reshape(2, -1)
        at = np.searchsorted(by, own[0])
        n = last[at] - first[at]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
        least = np.minimum(np.repeat(own[1].view(np.float64), n), weight_by[where])
        common = np.bincount(member_by[where], weights=least, minlength=len(sets))
        near = np.flatnonzero(common >= similarity * (total + total[q] - common))
        for m in near.tolist():
            a, b = root(int(component[q])), root(int(component[m]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(nid[q]), int(nid[m])))
    return found


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components that share a bucket of three or more.

    Within such a bucket, queries are the members outside its largest component. They meet all
    members, in blocks of bounded rows and shingles, so a large bucket takes many tasks. Buckets of
    several bands with the same members are searched once. Only ids are joined by bucket; the
    shingles come last, by id.
    """
    placed = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn(
        "component", F.coalesce("component", "nid")
    )
    by_component = placed.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.sum(F.xxhash64(F.lit(1), "nid").cast("decimal(20,0)")).alias("y")
    )
    mixed = (
        by_component.groupBy("key")
        .agg(
            F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"),
            F.bit_xor("x").alias("x"), F.sum("y").alias("y"),
        )
        .where("parts > 1 and size > 2")
    )
    # equal members have equal sums of hashes; two sums of 64 bits and more, and the size, tell others apart
    mixed = mixed.groupBy("size", "x", "y").agg(F.min_by(F.struct("key", "main"), "key").alias("k")).select("k.key", "k.main")
    sizes = sets.select("nid", (F.octet_length("set") / 16).alias("n"))
    rows = placed.join(mixed, "key").select("key", "nid", "component", (F.col("component") != F.col("main")).alias("query"))
    rows = materialize(rows.join(sizes, "nid"), "mixed")
    cut = lambda n, shingles: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    asks = F.when(F.col("query"), F.col("n")).otherwise(0)
    blocks = rows.groupBy("key").agg(
        cut(F.count(F.lit(1)), F.sum("n")).alias("mb"), cut(F.count_if("query"), F.sum(asks)).alias("qb")
    )
    spread = rows.drop("n").join(bounded_broadcast(materialize(blocks, "mixed-blocks"), BROADCAST_KEYS), "key")
    own = F.pmod(F.xxhash64("nid"), F.col("mb")).cast("int")
    asked = F.pmod(F.xxhash64("nid"), F.col("qb")).cast("int")
    one = F.col("mb") * F.col("qb") == 1
    as_member = spread.select(
        "key", "nid", "component", (F.col("query") & one).alias("query"), own.alias("m"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"),
    )
    as_query = spread.where(F.col("query") & ~one).select(
        "key", "nid", "component", "query", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), asked.alias("q")
    )
    every = as_member.unionByName(as_query).join(sets.select("nid", "set"), "nid")

    def run(table: pa.Table) -> pa.Table:
        links = block_links(
            table.column("nid").to_numpy(), table.column("component").to_numpy(), table.column("query").to_numpy(),
            _numbers(table.column("set")), similarity,
        )
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return every.groupBy("key", "m", "q").applyInArrow(run, "a long, b long")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Banding = Banding(), weights: str = "binary"
) -> DataFrame:
    """One row for each row of ``docs``: id_col, class_id, class_size, kept, uid, node.

    Rows are linked if their texts are identical or the (weighted) Jaccard similarity of their
    shingles is ``how.similarity`` or more; a class is a connected component and class_id its least
    id. ``weights`` is ``binary`` (plain sets) or ``count`` (shingles weigh as often as they occur).
    One row of a class is kept: that with class_id (of repeated rows one). Texts without words are
    like none but identical ones; null counts as empty. Null ids are larger than all others. An
    empty table gives an empty result; columns of ``docs`` other than the two are not looked at.
    """
    spark = docs.sparkSession
    rows = materialize(signed(docs, id_col, text_col, how, weights), "signed")
    nodes = materialize(
        rows.groupBy("node")
        .agg(F.first("bands").alias("bands"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = nodes.select("nid", F.explode("bands").alias("key"))
    # leaders are drawn anew for every fourth band, so that one unlike leader does not part a group
    draw = F.struct(F.xxhash64("nid", F.pmod("key", F.lit(4))).alias("h"), F.col("nid").alias("nid"))
    buckets = banded.groupBy("key").agg(F.min(draw)["nid"].alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(banded.join(buckets, "key").select("key", "nid", "leader", "size"), "members")
    wanted = materialize(members.select("nid").distinct().join(nodes.select("nid", "node"), "nid"), "wanted")
    if wanted.isEmpty():
        labels = spark.createDataFrame([], "node long, component long")
    else:
        sets = materialize(_payload(docs, text_col, wanted, how, weights), "sets")
        links, labels = _leader_links(members, sets, how.similarity)
        more = materialize(_rest(members.where("size > 2").select("key", "nid"), labels, sets, how.similarity), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    named = nodes.select("nid", "node", "id", "n").join(labels.withColumnRenamed("node", "nid"), "nid", "left")
    named = named.withColumn("component", F.coalesce("component", "nid"))
    heads = named.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    # most components are one node: only the others need their heads
    by_node = materialize(named.join(heads, "component").select("node", "class_id", "class_size", "component"), "classes")
    out = rows.select("uid", "id", "node").join(by_node, "node")
    first = (
        out.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("kept"))
    )
    return out.join(first, "uid", "left").select(
        F.col("id").alias(id_col), "class_id", "class_size", F.coalesce("kept", F.lit(False)).alias("kept"), "uid", "node"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Banding = Banding(), weights: str = "binary"
) -> DataFrame:
    """The row of every class that is kept, with all its columns. See ``classes``.

    Rows to drop are found by (id, text's key); as long as those of classes of two or more rows can
    be broadcast, no text is shuffled. Of repeated rows (one id, one text) any one stays.
    """
    found = classes(docs, id_col, text_col, how, weights).where("class_size > 1")
    marks = found.groupBy(F.col(id_col).alias("id"), "node").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies"))
    marks = materialize(marks, "near-marks")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    packed = docs.select(whole.alias("row"), F.col(id_col).alias("id"), text_key(text_or_empty(text_col)).alias("node"))
    side = bounded_broadcast(marks.select(F.col("id").alias("mark_id"), F.col("node").alias("mark_node"), "stays", "copies"), BROADCAST_KEYS)
    joined = packed.join(side, (F.col("node") == F.col("mark_node")) & F.col("id").eqNullSafe(F.col("mark_id")), "left")
    stay = joined.where("stays is null or stays")
    if marks.where("stays and copies > 1").isEmpty():
        return stay.select("row.*")
    once = stay.where("copies > 1").groupBy("id", "node").agg(F.first("row").alias("row"))
    return stay.where("copies is null or copies = 1").select("row.*").unionByName(once.select("row.*"))


def contract(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "class_id", "class_size", "kept")
