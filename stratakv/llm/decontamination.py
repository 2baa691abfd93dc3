"""Operator 2, benchmark decontamination: suffix arrays of the training texts.

Every shard of the training texts (a run of rows of one partition) gets a suffix array over its
words. Every suffix of every test item is binary-searched in it, word by word up to a window, which
yields ranges of the array: the places of all windows that occur. Equal windows of the tests have
one range, so each place is looked at once for a window length, however often tests and texts repeat
themselves. Texts with a window get a suffix array of their own together with the items found in
them, in which every suffix's neighbours give its longest verbatim match and where it lies. A
shard's array holds the suffixes that start with a word sequence of the tests, as no other suffix
can match; it is built, searched and dropped within the task that reads the shard, so nothing is
shuffled.

The tests travel in blocks of bounded size, one broadcast each, and every shard goes through all
blocks in turn: tests of any size are handled with one block in memory at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back

#: Words of a window.
WINDOW = 10
#: Words of test items in a block (a block takes about 100 bytes a word in each worker).
BLOCK_WORDS = 1_000_000
#: Words of training text in a shard (about 60 bytes each while the shard is searched).
SHARD_WORDS = 150_000

#: Columns that are added.
ADDED = """n_words long, n_hit long, n_items long, items array<string>, longest_match long,
    matches array<struct<item:string,item_word:bigint,word:bigint,length:bigint>>, contaminated boolean"""

#: Bytes of words: digits, letters in either case, all of UTF-8 beyond ASCII. Others separate.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Tests:
    """A block of test items: vocabulary, word numbers (from 1) and sorted word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.names = [name for name, _ in items]
        runs = [np.array([number.setdefault(w, len(number) + 1) for w in ws], dtype=np.int64) for _, ws in items]
        self.runs = runs
        # a suffix counts as a window's start if the window fits; a short item has one window, itself
        lengths = [min(window, len(r)) for r in runs]
        self.item = np.concatenate([np.full(len(r), i) for i, r in enumerate(runs)] or [[]]).astype(np.int64)
        self.offset = np.concatenate([np.arange(len(r)) for r in runs] or [[]]).astype(np.int64)
        self.need = np.array([lengths[i] for i in self.item], dtype=np.int64)
        self.rest = np.array([len(runs[i]) for i in self.item], dtype=np.int64) - self.offset
        self.window = window
        self.depth = max(map(len, runs), default=0)  # no match is longer than an item
        self.gram = min([3, *lengths]) if lengths else 1
        self.words = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        starts = self.rest >= self.gram
        self.first = np.cumsum([0, *map(len, runs)]).astype(np.int64)  # of each item's words
        # suffixes at which a window starts
        self.opens = (self.rest >= self.need) & ((self.need == window) | (self.offset == 0))
        self.grams = np.unique(self._codes(np.concatenate([self.words, np.zeros(3, np.int64)]), np.flatnonzero(starts)))

    def _codes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number for the gram at each position; grams are exact as long as it fits 63 bits."""
        base = np.int64(min(len(self.vocabulary) + 2, 2_000_000))
        code = np.zeros(len(at), dtype=np.int64)
        for k in range(self.gram):
            code = code * base + numbers[at + k]
        return code

    def candidates(self, numbers: np.ndarray) -> np.ndarray:
        """Positions of a padded text where a gram of the tests starts."""
        alive = numbers > 0
        start = alive[: len(numbers) - 3].copy()
        for k in range(1, self.gram):
            start &= alive[k : len(numbers) - 3 + k]
        at = np.flatnonzero(start)
        code = self._codes(numbers, at)
        where = np.searchsorted(self.grams, code)
        where[where == len(self.grams)] = 0
        return at[self.grams[where] == code] if len(self.grams) else at[:0]


class SuffixArray:
    """Sorted suffixes (at most ``depth`` words each) of a shard, at given positions.

    Suffixes are sorted by their first words; only those that are equal so far are sorted further,
    so the work follows the repeats and not the depth.
    """

    def __init__(self, numbers: np.ndarray, at: np.ndarray, depth: int):
        self.depth = max(depth, 1)
        self.numbers = np.concatenate([numbers, np.zeros(self.depth + 1, dtype=np.int64)])
        self.at = np.asarray(at, dtype=np.int64).copy()
        tied = np.arange(len(self.at))  # places in the array that are not final
        group = np.zeros(len(self.at), dtype=np.int64)  # of those, ascending
        for k in range(self.depth):
            word = self.numbers[self.at[tied] + k]
            order = np.lexsort((word, group))
            self.at[tied] = self.at[tied][order]
            group, word = group[order], word[order]
            new = np.ones(len(tied) + 1, dtype=bool)
            new[1:-1] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
            group = np.cumsum(new[:-1])
            more = ~(new[:-1] & new[1:])  # not alone in its group
            tied, group = tied[more], group[more]
            if not len(tied):
                break

    def search(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Narrow ranges [lo, hi) of suffixes equal in k words to those whose next word is ``word``.

        One binary search per range, all ranges at once.
        """

        def bound(after: bool) -> np.ndarray:
            a, b = lo.copy(), hi.copy()
            while True:
                open_ = a < b
                if not open_.any():
                    return a
                mid = (a + b) // 2
                seen = self.numbers[self.at[np.minimum(mid, len(self.at) - 1)] + k]
                right = open_ & ((seen <= word) if after else (seen < word))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)

        return bound(False), bound(True)


def match(tests: Tests, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """Matches of test suffixes in a shard, no longer than a window: (places, words, windows).

    ``numbers`` are word numbers, with 0 for words that no test has and after each text. Places are
    those of the shard's suffix array, words the longest match at each. Windows are, by length,
    (test suffixes at which one starts that occurs, first and last place of its range).
    """
    padded = np.concatenate([numbers, np.zeros(tests.window + 4, dtype=np.int64)])
    depth = min(tests.window, tests.depth)
    array = SuffixArray(padded, tests.candidates(padded), depth)
    best = np.zeros(len(array.at), dtype=np.int64)
    suffix = np.flatnonzero(tests.rest >= tests.gram)
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(array.at), np.int64)
    windows = []
    for k in range(depth):
        lo, hi = array.search(tests.words[suffix + k], lo, hi, k)
        go = lo < hi
        suffix, lo, hi = suffix[go], lo[go], hi[go]
        if not len(suffix):
            break
        if k + 1 >= tests.gram:
            n = len(best) + 1
            best[np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n))[:-1] > 0] = k + 1
        whole = tests.opens[suffix] & (tests.need[suffix] == k + 1)
        if whole.any():
            windows.append((suffix[whole], lo[whole], hi[whole], k + 1))
        more = tests.rest[suffix] > k + 1
        suffix, lo, hi = suffix[more], lo[more], hi[more]
    return array.at, best, windows


def _ramp(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the places in it, of all ranges [lo, hi)."""
    n = hi - lo
    return np.repeat(np.arange(len(lo)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)


def longest_matches(tests: Tests, text: np.ndarray, items: list[int]) -> list[tuple[int, int, int, int]]:
    """(item, offset, place, words): the longest match in a text at every suffix of the items.

    Only matches of a window (of the item, if shorter) and more are returned, and of those none
    that the match one suffix earlier holds already. Suffixes of text and items are sorted together
    by doubling the words compared, so equal words that go on and on take a few rounds more.
    """
    n = len(text)
    sizes = [len(tests.runs[i]) for i in items]
    total = n + sum(sizes) + len(items) + 1
    names = -1 - np.arange(total, dtype=np.int64)  # ends and words that no test has are like nothing else
    names[:n][text > 0] = text[text > 0]
    starts = []
    at = n + 1
    for i, size in zip(items, sizes, strict=True):
        names[at : at + size] = tests.runs[i]
        starts.append(at)
        at += size + 1
    ranks = [np.unique(names, return_inverse=True)[1]]
    step = 1
    while int(ranks[-1].max()) + 1 < total:
        rank = ranks[-1]
        after = np.zeros(total, dtype=np.int64)
        after[: total - step] = rank[step:] + 1
        ranks.append(np.unique(rank * (total + 1) + after, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1])
    here = np.arange(total)
    before = np.maximum.accumulate(np.where(order < n, here, -1))
    behind = np.minimum.accumulate(np.where(order < n, here, total)[::-1])[::-1]
    offset = np.concatenate([np.arange(size) for size in sizes])
    p = np.repeat(starts, sizes) + offset
    place = ranks[-1][p]
    best, where = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for near in (before[place], behind[place]):
        some = (near >= 0) & (near < total)
        q = order[np.where(some, near, 0)]
        same = np.zeros(len(p), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            a, b = p + same, q + same
            inside = some & (a + (1 << level) <= total) & (b + (1 << level) <= total)
            rank = ranks[level]
            equal = inside & (rank[np.minimum(a, total - 1)] == rank[np.minimum(b, total - 1)])
            same[equal] += 1 << level
        more = same > best
        best[more], where[more] = same[more], q[more]
    item = np.repeat(items, sizes)
    need = np.repeat([min(tests.window, size) for size in sizes], sizes)
    held = np.zeros(len(p), dtype=bool)
    held[1:] = (item[1:] == item[:-1]) & (best[:-1] == best[1:] + 1)
    keep = (best >= need) & ~held
    return list(zip(item[keep].tolist(), offset[keep].tolist(), where[keep].tolist(), best[keep].tolist(), strict=True))


def _shards(batches: Iterable[pa.RecordBatch], text_at: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches whose texts together have about ``size`` words (a longer text alone)."""
    for batch in batches:
        first, held, total = 0, [], 0
        for i, text in enumerate(batch.column(text_at)):
            own = split_words(text.as_py())
            if held and total + len(own) > size:
                yield batch.slice(first, i - first), held
                first, held, total = i, [], 0
            held.append(own)
            total += len(own)
        if held:
            yield batch.slice(first), held


def search_shard(texts: list[list[bytes]], blocks: Iterable[Tests]) -> list[tuple[int, int, list[str], int, list[tuple[str, int, int, int]]]]:
    """For each text: words, words hit, items with an occurring window, longest match in words, matches.

    Matches are (item, word of the item, word of the text, words), see ``longest_matches``.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)  # a gap after each text
    total = int((lengths + 1).sum())
    hit = np.zeros(total + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    matches: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
    longest = np.zeros(len(texts), np.int64)
    flat = [w for t in texts for w in (*t, b"")]
    for tests in blocks:
        numbers = np.fromiter(map(tests.vocabulary.get, flat, repeat(0)), dtype=np.int64, count=total)
        places, words, windows = match(tests, numbers)
        text_of = np.searchsorted(starts, places, side="right") - 1
        np.maximum.at(longest, text_of, words)
        found: dict[int, set[int]] = {}
        for suffix, lo, hi, n in windows:
            low, first, which = np.unique(lo, return_index=True, return_inverse=True)
            window, at = _ramp(low, hi[first])
            np.add.at(hit, places[at], 1)
            np.add.at(hit, places[at] + n, -1)
            # items of each window; windows with the same items are one class
            pairs = np.unique(np.stack([which, tests.item[suffix]]), axis=1)
            cuts = np.flatnonzero(np.append(True, np.diff(pairs[0]) > 0))
            sets = [tuple(x.tolist()) for x in np.split(pairs[1], cuts[1:])]
            number: dict[tuple, int] = {}
            classes = np.array([number.setdefault(x, len(number)) for x in sets])
            of = list(number)
            for t, c in np.unique(np.stack([text_of[at], classes[window]]), axis=1).T.tolist():
                found.setdefault(t, set()).update(of[c])
        for t, own in found.items():
            items[t].update(tests.names[i] for i in own)
            far = longest_matches(tests, numbers[starts[t] : starts[t] + lengths[t]], sorted(own))
            longest[t] = max(longest[t], max(m[3] for m in far))
            matches[t] += [(tests.names[i], *rest) for i, *rest in far]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:total]) > 0)])
    n_hit = covered[starts + lengths] - covered[starts]
    return [
        (int(n), int(h), sorted(own), int(best), sorted(far))
        for n, h, own, best, far in zip(lengths, n_hit, items, longest, matches, strict=True)
    ]


def blocks_of(tests: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> list:
    """Broadcast variables, one per block of items; the driver holds one block at a time.

    Null item ids and items without words are left out. Items are names (their ids as text).
    """
    spark = tests.sparkSession
    out, held, total = [], [], 0
    rows = tests.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")

    def send() -> None:
        out.append(spark.sparkContext.broadcast(pickle.dumps(Tests(held, window))))

    for row in rows.toLocalIterator():
        own = split_words(row["t"])
        if not own:
            continue
        if held and total + len(own) > block_words:
            send()
            held, total = [], 0
        held.append((row["i"], own))
        total += len(own)
    if held:
        send()
    return out


_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())])


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, by default the id) with what the tests match in them.

    Adds n_words, n_hit (words inside an occurrence of a window of ``window`` consecutive words of
    an item; an item of fewer, but not none, is one window), n_items, items (their ids as text,
    sorted), longest_match (words of the longest verbatim match with an item, 0 if shorter than three words
    and than every item), matches (item, item_word, word, length: the longest match and its place for every suffix
    of an item from a window on, but those that go on the match of the suffix before) and
    contaminated. Null and wordless texts have no words and are clean;
    repeated rows and repeated items are looked at one by one; an empty table of documents gives
    an empty result, an empty table of tests leaves all clean. Items with a null id have no name
    and are not searched: a passage of such an item alone leaves a document clean. Columns of ``keep`` with the name
    (in any case) of an added one are replaced by it; other columns are not looked at. A text is
    searched as a whole, with about 100 bytes a word; the driver holds one block of tests at a time.
    """
    added = T.StructType.fromDDL(ADDED)
    names = [c for c in ([id_col] if keep is None else keep) if c.lower() not in added.names]
    sent = blocks_of(tests, item_col, item_text_col, window, block_words)
    (probe,) = fresh(docs.select(*names) if names else docs, "text_to_search")
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(text_col).alias(probe))
    schema = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in names)).schema.fields, *added.fields])
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: list[Tests] = [pickle.loads(sent[0].value)] if len(sent) == 1 else []

        def blocks() -> Iterator[Tests]:
            if loaded:
                yield from loaded
                return
            for block in sent:
                yield pickle.loads(block.value)
                block.__dict__.pop("_value", None)  # the next block takes its place

        for part, texts in _shards(batches, at, SHARD_WORDS):
            found = search_shard(texts, blocks())
            columns = [part.column(i) for i in range(at)]
            columns += [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([len(f[2]) for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
                pa.array([f[3] for f in found], pa.int64()),
                pa.array([[dict(zip(_MATCH.names, m, strict=True)) for m in f[4]] for f in found], pa.list_(_MATCH)),
                pa.array([f[1] > 0 for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added.names])

    return rows.mapInArrow(lambda b: give_back(run(b)), schema)


def remove_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the tests occurs, with all their columns."""
    clash = [c for c in docs.columns if c.lower() in T.StructType.fromDDL(ADDED).names]
    safe = {c: f"kept_{i}" for i, c in enumerate(clash)}
    back = {v: k for k, v in safe.items()}
    renamed = docs.withColumnsRenamed(safe)
    found = contamination(renamed, tests, keep=renamed.columns, **options)
    return found.where("not contaminated").select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in renamed.columns))


def contract(found: DataFrame) -> DataFrame:
    """The digest columns of ``contamination``'s result."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
