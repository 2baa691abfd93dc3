"""Operator 4, SentencePiece encoding and decoding: Gumbel top-k over the segmentation lattice.

The pieces of a public SentencePiece model span a lattice of segmentations of each text. Samples
without replacement are the segmentations with the largest log-probabilities after Gumbel noise.
They are found best first (A*): the root's bound is one Gumbel draw; popping a set of
segmentations draws its best member and splits the rest into disjoint sets, each with its own
Gumbel bound conditioned to lie below the popped one. No piece reaches across the cuts between
words, so the lattice is a chain of word lattices, a segmentation is a choice at each word, and
the rest of a popped set splits by the first word whose choice differs.

All draws are hashes of (seed, row key, draw number): a row's samples do not depend on how rows
are partitioned or batched. Work is vectorised over the words of a batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back

#: Where the public tokenizer files lie unless the caller says otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581  # the mark that stands for a space in pieces
_OWN_MARK = 0x110001  # a mark that is in the text itself; no piece has it, so it is spelt in bytes
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)  # odd, so words of one kind and step have distinct numbers
#: Chances of pieces are carried as exp(log + SCALE x characters); only their ratios matter.
SCALE = 2.5
#: Texts of a batch are handled in runs of about so many characters (about 100 bytes each); a longer text alone.
RUN_CHARS = 200_000
#: Edges of word types' lattices that a task keeps (11 bytes each for usual models); beyond them only types in use stay.
KEPT_EDGES = 2_000_000
#: Characters of new word types that are added in one turn (about 300 bytes each meanwhile); a longer word alone.
ADD_CHARS = 60_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit moves every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a key and a counter."""
    h = mix(key + counter * _GOLD)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_OTHER, _WORD, _GAP, _LINE = 0, 1, 2, 3


def _class_of(code: int) -> int:
    """Class of a character: letter, digit or underscore; space; line end; other."""
    c = chr(code)
    return _WORD if c.isalnum() or c == "_" else _GAP if c == " " else _LINE if c == "\n" else _OTHER


_CLASS_TABLE = np.array([_class_of(i) for i in range(0x3000)], dtype=np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each character code."""
    far = codes >= len(_CLASS_TABLE)
    out = _CLASS_TABLE[np.where(far, 0, codes)]
    if far.any():
        some, which = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_class_of(int(c)) for c in some], dtype=np.uint8)[which]
    return out


class Vocabulary:
    """Pieces with log-probabilities, as a trie in a hash table, and bytes for decoding.

    A unigram model's own scores are its log-probabilities. A BPE model only has merge ranks r;
    its pieces get Zipf weights 1 / (r + 2.7), sharpened by ``alpha``. Characters that no piece
    spells are spelt in bytes, each a tenth as likely as the rarest piece.
    """

    def __init__(self, model: str = MODEL, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_at = {}
        normal, scores = [], []
        flat = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes_at[int(p[3:5], 16)] = i
                flat.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                flat.append(b"")
            else:
                normal.append(i)
                scores.append(sp.get_score(i))
                flat.append(p.replace(chr(SPACE), " ").encode())
        score = np.array(scores)
        ranks = bool(len(score)) and np.all(score <= 0) and np.all(score == np.round(score))
        log = -np.log(2.7 - score) if ranks else score
        log = alpha * log
        log -= np.log(np.exp(log - log.max()).sum()) + log.max()
        self.log = np.full(size + 1, -np.inf)
        self.log[normal] = log
        self.byte_log = float(log.min() - np.log(10.0))
        # the same as chances, times a constant per character that keeps products in range
        self.chance = np.zeros(size + 1)
        self.chance[normal] = np.exp(log + SCALE * np.array([len(pieces[i]) for i in normal]))
        self.byte_ids = np.array([self.bytes_at.get(b, 0) for b in range(256)], dtype=np.int64)
        self.size = size
        self.flat = np.frombuffer(b"".join(flat), dtype=np.uint8)
        self.flat_len = np.array([len(b) for b in flat], dtype=np.int64)
        self.flat_at = np.cumsum(self.flat_len) - self.flat_len
        inner = [pieces[i] for i in normal]
        mark = chr(SPACE)
        if any(re.search(f"[^{mark}]{mark}|\n", p) for p in inner):
            raise ValueError("a piece reaches across a space or a line end")
        across = {(ord(a) << 21) | ord(b) for p in inner for a, b in zip(p, p[1:]) if _class_of(ord(a)) == _WORD and _class_of(ord(b)) == _OTHER}
        self.across = np.array(sorted(across), dtype=np.uint64)
        self._build([(p, i) for p, i in zip(inner, normal, strict=True)])

    def word_starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character, such that no piece reaches from one word into the next.

        Words end before spaces, around line ends and, after letters and digits, before any other
        character, unless some piece has just these two next to each other.
        """
        kind = classes(codes)
        before, here = kind[:-1], kind[1:]
        out = np.ones(len(codes), dtype=bool)
        turn = (before == _WORD) & (here == _OTHER)
        at = np.flatnonzero(turn)
        pair = (codes[at].astype(np.uint64) << np.uint64(21)) | codes[at + 1].astype(np.uint64)
        where = np.searchsorted(self.across, pair)
        where[where == len(self.across)] = 0
        if len(self.across):
            turn[at[self.across[where] == pair]] = False
        out[1:] = turn | (here == _LINE) | (before == _LINE) | ((here == _GAP) & (before != _GAP))
        return out

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        """The trie: (node, character) -> node in an open-addressed table, and each node's piece."""
        edges: dict[tuple[int, int], int] = {}
        piece = [-1]
        for text, i in pieces:
            node = 0
            for c in map(ord, text):
                to = edges.get((node, c))
                if to is None:
                    to = edges[node, c] = len(piece)
                    piece.append(-1)
                node = to
            piece[node] = i
        self.longest = max((len(text) for text, _ in pieces), default=1)
        self.piece = np.array(piece, dtype=np.int32)
        keys = np.array([(n << 21) | c for n, c in edges], dtype=np.uint64)
        to = np.array(list(edges.values()), dtype=np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.to = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self._slot(keys)
        for k, t, s in zip(keys.tolist(), to.tolist(), slot.tolist(), strict=True):
            while self.to[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.to[s] = k, t

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next trie node of each (node, character); -1 if there is none."""
        keys = (node.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.to[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (self.to[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (self.to[slot[open_]] >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids spell (with the leading space of the first word)."""
        n = self.flat_len[ids]
        total = int(n.sum())
        at = np.repeat(self.flat_at[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.flat[at]


class Lattices:
    """Lattices of word types: the pieces that may start at each character, with cumulated chances.

    Node i (a character of a type) has the edges ``edge_at[i]`` to ``edge_at[i + 1]``, one for each
    piece from there that ends within the word, shortest first: ``share`` is the chance, given the
    node, of that piece or a shorter one, ``ids`` the piece (vocabulary size: the character in
    bytes) and ``step`` its characters. Types are kept up to ``KEPT_EDGES`` edges (11 bytes each).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.nodes = self.edges = 0
        self.first = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)
        if not hasattr(self, "share"):  # what has grown stays as room for the next types
            self.chars = np.zeros(0, dtype=np.uint32)
            self.edge_at = np.zeros(1, dtype=np.int32)
            self.share = np.zeros(0)
            self.ids = np.zeros(0, dtype=np.min_scalar_type(self.v.size))
            self.step = np.zeros(0, dtype=np.min_scalar_type(self.v.longest))
        self.bits = 12
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.held = 0

    def shrink(self) -> None:
        """Drops types but those used more than once since the last time, the most used of half the bound's edges."""
        size = self.edge_at[self.first + self.length] - self.edge_at[self.first]
        found = self.values >= 0
        key, known = np.zeros(len(size), dtype=np.uint64), np.zeros(len(size), dtype=bool)
        key[self.values[found]], known[self.values[found]] = self.keys[found], True
        order = np.argsort(-self.uses, kind="stable")
        order = order[(self.uses[order] > 1) & known[order]]
        stay = np.sort(order[np.cumsum(size[order], dtype=np.int64) <= KEPT_EDGES // 2])
        n, m = self.length[stay], size[stay].astype(np.int64)
        first = np.cumsum(n) - n
        nodes = np.repeat(self.first[stay] - first, n) + np.arange(int(n.sum()))
        edges = np.repeat(self.edge_at[self.first[stay]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        ends = np.cumsum(self.edge_at[nodes + 1] - self.edge_at[nodes])
        chars, share, ids, step = self.chars[nodes], self.share[edges], self.ids[edges], self.step[edges]
        self.clear()
        self.nodes, self.edges = len(nodes), len(edges)
        self.chars[: self.nodes], self.edge_at[1 : self.nodes + 1] = chars, ends
        self.share[: self.edges], self.ids[: self.edges], self.step[: self.edges] = share, ids, step
        self.first, self.length = first, n
        self._keep(key[stay], np.arange(len(stay)))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The type of each key in the table; -1 if there is none."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            value = self.values[at]
            hit = (self.keys[at] == keys[open_]) & (value >= 0)
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _keep(self, keys: np.ndarray, types: np.ndarray) -> None:
        """Puts distinct new keys into the table, which stays at most a quarter full."""
        self.held += len(keys)
        if 4 * self.held > 1 << self.bits:
            old = self.values >= 0
            keys, types = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], types])
            self.bits = (4 * self.held).bit_length()
            self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
            self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.values[slot[open_]] < 0]
            taken = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[taken]], self.values[slot[taken]] = keys[taken], types[taken]
            done = np.zeros(len(keys), dtype=bool)
            done[taken] = True
            open_ = open_[~done[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def of(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The type number of each word of a run of characters; new types are added.

        Words are looked up by a hash of their characters and then compared in full.
        """
        if self.edges > KEPT_EDGES:
            self.shrink()
        length = np.diff(np.append(start, len(codes)))
        keys = word_hashes(codes, start, length)
        out = self._find(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            base = len(self.length)
            self._add_words(codes, start, length, missing[first])
            types = np.arange(base, base + len(new))
            self._keep(new, types)
            out[missing] = types[which]
        stored = self.chars[np.repeat(self.first[out] - start, length) + np.arange(len(codes))]
        wrong = np.flatnonzero(stored != codes)
        if len(wrong):  # two words of one hash, or of other lengths: such words get types of their own
            words = np.unique(np.searchsorted(start, wrong, side="right") - 1)
            base = len(self.length)
            self._add_words(codes, start, length, words)
            out[words] = np.arange(base, base + len(words))
        uses = np.bincount(out, minlength=len(self.length))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return out

    def _add_words(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, words: np.ndarray) -> None:
        """New types in turns of about ``ADD_CHARS`` characters, which bounds what a turn holds."""
        turn = np.cumsum(length[words]) // ADD_CHARS
        for own in np.split(words, np.flatnonzero(np.diff(turn)) + 1):
            n = length[own]
            self._add(codes[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n)

    def _add(self, chars: np.ndarray, length: np.ndarray) -> None:
        v = self.v
        end = np.cumsum(length)
        left = np.repeat(end, length) - np.arange(len(chars))  # characters from here to the word's end
        ids = np.full((min(v.longest, 12), len(chars)), -1, dtype=np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        height = 1
        for k in range(v.longest):
            node = v.step(node, chars[at + k])
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = v.piece[node]
            if k == len(ids):
                ids = np.vstack([ids, np.full((12, len(chars)), -1, dtype=np.int32)])
            ids[k, at] = piece
            if (piece >= 0).any():
                height = k + 1
            more = left[at] > k + 1
            at, node = at[more], node[more]
            if not len(at):
                break
        ids = ids[:height]
        spelt = ids[0] < 0  # no piece is this character alone
        ids[0][spelt] = v.size
        share = np.empty(ids.shape)
        hard = np.repeat(self._hard(length, spelt, end), length)
        easy = self._shares(ids[:, ~hard], left[~hard])
        if easy is None:  # some product left the range of doubles
            hard[:] = True
        else:
            share[:, ~hard] = easy
        if hard.any():
            utf8 = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where((chars < 0x10000) | (chars == _OWN_MARK), 3, 4)))
            log = v.log[ids[:, hard]]
            log[ids[:, hard] < 0] = -np.inf
            log[0][spelt[hard]] = v.byte_log * utf8[hard & spelt]
            share[:, hard] = self._log_shares(log, left[hard])
        self._append(chars, share, ids)
        self.first = np.concatenate([self.first, self.nodes + end - length])
        self.length = np.concatenate([self.length, length])
        self.nodes += len(chars)

    def _append(self, chars: np.ndarray, share: np.ndarray, ids: np.ndarray) -> None:
        real = (ids >= 0).T
        n = real.sum(axis=1)
        new = {"chars": (self.nodes, chars), "edge_at": (self.nodes + 1, self.edges + np.cumsum(n))}
        new |= {"share": (self.edges, share.T[real]), "ids": (self.edges, ids.T[real])}
        new["step"] = self.edges, (np.nonzero(real)[1] + 1)
        for name, (at, values) in new.items():
            old = getattr(self, name)
            if at + len(values) > len(old):
                room = np.empty(max(len(old) * 5 // 4, at + len(values)), dtype=old.dtype)
                room[:at] = old[:at]
                setattr(self, name, room)
                old = room
            old[at : at + len(values)] = values
        self.edges += int(n.sum())

    @staticmethod
    def _hard(length: np.ndarray, spelt: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words that are long or have characters spelt in bytes."""
        before = np.concatenate([[0], np.cumsum(spelt)])
        return (length > 48) | (before[end] > before[end - length])

    def _shares(self, ids: np.ndarray, left: np.ndarray) -> np.ndarray | None:
        """``share`` by sums of products from the words' ends; None if a sum leaves the range."""
        chance = self.v.chance[ids]  # 0 for -1 and for characters in bytes
        height = len(ids)
        beta = np.ones(ids.shape[1] + height)
        order = np.argsort(left, kind="stable")
        cut = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        total = np.ones(ids.shape[1])
        for d in range(1, len(cut)):
            nodes = order[cut[d - 1] : cut[d]]
            sums = np.zeros(len(nodes))
            with np.errstate(over="ignore", invalid="ignore"):
                for k in range(min(d, height)):
                    value = chance[k, nodes]
                    if k + 1 < d:
                        value *= beta[nodes + k + 1]
                    sums += value
                    chance[k, nodes] = sums
            beta[nodes] = total[nodes] = sums
        if not (np.isfinite(total).all() and (total > 1e-280).all() and (total < 1e280).all()):
            return None
        chance /= total
        return chance

    @staticmethod
    def _log_shares(log: np.ndarray, left: np.ndarray) -> np.ndarray:
        """``share`` in logarithms."""
        height = len(log)
        beta = np.zeros(log.shape[1] + height)
        share = np.empty(log.shape)
        order = np.argsort(left, kind="stable")
        cut = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for d in range(1, len(cut)):
            nodes = order[cut[d - 1] : cut[d]]
            width = min(d, height)
            value = log[:width, nodes]
            for k in range(min(d - 1, width)):  # a piece that ends the word has nothing behind it
                value[k] = value[k] + beta[nodes + k + 1]
            top = value.max(axis=0)
            value = np.cumsum(np.exp(value - top), axis=0)
            beta[nodes] = top + np.log(value[-1])
            share[:width, nodes] = value / value[-1]
            share[width:, nodes] = 1.0
        return share

    def draw(self, types: np.ndarray, uniforms) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """A segmentation of each word: log chances, token counts, and per step (which, edge).

        ``uniforms(which, step)`` gives the draws.
        """
        log = np.zeros(len(types))
        count = np.zeros(len(types), dtype=np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        which = np.arange(len(types))
        node, rest = self.first[types], self.length[types]
        upto = np.zeros(len(types))
        share = self.share
        while len(which):
            u = uniforms(which, len(steps))
            base, edge = self.edge_at[node], self.edge_at[node + 1] - 1
            chance = share[edge]  # 1: the last share of a node
            open_ = np.flatnonzero(edge > base)
            at, high = edge[open_], chance[open_]
            while len(open_):  # from the longest piece down, as it is mostly the likeliest
                low = share[at - 1]
                chance[open_] = high - low
                down = np.flatnonzero(u[open_] < low)
                open_, at, high = open_[down], at[down] - 1, low[down]
                edge[open_], chance[open_] = at, high
                more = np.flatnonzero(at > base[open_])
                open_, at, high = open_[more], at[more], high[more]
            upto += np.log(np.maximum(chance, 1e-300))
            steps.append((which, edge))
            n = self.step[edge]
            rest, node = rest - n, node + n
            go = rest > 0
            ended = which[~go]
            log[ended], count[ended] = upto[~go], len(steps)
            which, node, rest, upto = which[go], node[go], rest[go], upto[go]
        return log, count, steps

    def other(self, kind: int, not_these: Sequence[Sequence[int]], uniforms: Iterator[float]) -> tuple[float, list[int]]:
        """A segmentation of a word that is none of the given ones: log chance, edges.

        At each node the chances of the excluded continuations are taken out of their edges.
        """
        node, end = int(self.first[kind]), int(self.first[kind] + self.length[kind])
        # log chances of the excluded ones from each step to the word's end
        still = [(p, list(accumulate(self.log_of(e) for e in reversed(p)))[::-1]) for p in not_these]
        log, edges = 0.0, []
        while node < end:
            place = len(edges)
            base = int(self.edge_at[node])
            share = self.share[base : int(self.edge_at[node + 1])].tolist()
            chance = [b - a for a, b in zip([0.0, *share], share, strict=False)]
            free = chance.copy()
            for p, logs in still:
                k = p[place] - base
                free[k] = max(free[k] - math.exp(logs[place]), 0.0)
            if still and sum(free) <= 0:  # rounding took all: any edge below which something is left
                free = [c if self._open_below([p for p, _ in still if p[place] == base + k], place + 1) else 0.0 for k, c in enumerate(chance)]
            u = next(uniforms) * sum(free)
            pick = 0
            for k, f in enumerate(free):
                if f > 0:
                    pick = k
                    u -= f
                    if u < 0:
                        break
            edge = base + pick
            still = [x for x in still if x[0][place] == edge]
            log += math.log(max(chance[pick], 1e-300))
            edges.append(edge)
            node += int(self.step[edge])
        return log, edges

    def _node_of(self, edge: int) -> int:
        return int(np.searchsorted(self.edge_at[: self.nodes + 1], edge, side="right")) - 1

    def _open_below(self, paths: Sequence[Sequence[int]], place: int) -> bool:
        """Whether, after their first ``place`` edges, which they share, there is a way that is none of the paths."""
        todo = [(list(paths), place)]
        while todo:
            own, at = todo.pop()
            if not own:
                return True
            own = [p for p in own if len(p) > at]
            if not own:
                continue
            node = self._node_of(own[0][at])
            next_ = {p[at] for p in own}
            if len(next_) < int(self.edge_at[node + 1] - self.edge_at[node]):
                return True
            todo += [([p for p in own if p[at] == e], at + 1) for e in next_]
        return False

    def log_of(self, edge: int) -> float:
        low = self.share[edge - 1] if edge > 0 and self.share[edge - 1] < 1.0 else 0.0  # a node's last share is 1
        return math.log(max(float(self.share[edge] - low), 1e-300))

    def tokens(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge has (characters in bytes have several)."""
        ids = self.ids[edges].astype(np.int64)
        n = np.ones(len(ids), dtype=np.int64)
        bytewise = np.flatnonzero(ids == self.v.size)
        if not len(bytewise):
            return ids, n
        nodes = np.searchsorted(self.edge_at[: self.nodes + 1], edges[bytewise], side="right") - 1
        spelt = [chr(SPACE if c == _OWN_MARK else c).encode("utf-8", "surrogatepass") for c in self.chars[nodes].tolist()]
        n[bytewise] = [len(b) for b in spelt]
        out = np.repeat(ids, n)
        first = np.cumsum(n) - n
        for at, b in zip(first[bytewise].tolist(), spelt, strict=True):
            out[at : at + len(b)] = self.v.byte_ids[list(b)]
        return out, n


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers of a number, mod 2^64."""
    steps = np.full(n, np.uint64(base))
    steps[:1] = 1
    return np.cumprod(steps)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(_powers_of(b, RUN_CHARS + 1) for b in (_BASE, pow(_BASE, -1, 2**64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse up to n; those of longer runs are not kept."""
    if n <= RUN_CHARS:
        return _kept_powers()
    return tuple(_powers_of(b, n + 1) for b in (_BASE, pow(_BASE, -1, 2**64)))


def word_hashes(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's characters: a polynomial from prefix sums, moved to the word's start."""
    power, inverse = _powers(len(codes))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)])])
    h = (sums[start + length] - sums[start]) * inverse[start]
    return mix(h + length.astype(np.uint64) * _GOLD)


@dataclass
class Sample:
    """Samples of one rank for the texts of a run that have one: ids of all texts end to end."""

    has: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray


def sample_run(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> tuple[list[Sample], np.ndarray]:
    """The top k perturbed segmentations of each text, and the bound below them.

    ``keys`` (uint64) seed the draws. The bound is the (k+1)-th largest perturbed
    log-probability (-inf if there is no such segmentation).
    """
    v = lattices.v
    some_text = np.array([bool(t) for t in texts])
    codes = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + some_text
    begins = np.cumsum(sizes) - sizes
    starts = v.word_starts(codes) if len(codes) else np.zeros(0, dtype=bool)
    starts[begins[some_text]] = True
    word_at = np.flatnonzero(starts)
    n_words = np.searchsorted(word_at, begins + sizes) - np.searchsorted(word_at, begins)
    codes[codes == SPACE] = _OWN_MARK
    codes[codes == 0x20] = SPACE
    types = lattices.of(codes, word_at)
    start = np.cumsum(n_words) - n_words
    text_of = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(types)) - start[text_of]

    def purpose(rank: int, kind: int, step: int = 0) -> np.ndarray:
        """What a draw is for and its step, each hashed in full."""
        return mix(np.array([4 * rank + kind + 1], dtype=np.uint64) * _GOLD) ^ mix(np.array([step + 1], dtype=np.uint64))

    def counter(rank: int, kind: int, at: np.ndarray, step: int = 0) -> np.ndarray:
        """The draw's number: its purpose and its word."""
        return at.astype(np.uint64) * _MORE + purpose(rank, kind, step)

    root = -np.log(-np.log(uniform(keys, np.full(len(texts), 2**63, dtype=np.uint64))))
    # sets of segmentations, per text: (bound, rank of the sample whose prefix it shares, word, excluded)
    sets: list[list[tuple[float, int, int]]] = [[] for _ in texts]
    excluded: dict[tuple[int, int, int], list[list[int]]] = {}
    out: list[Sample] = []
    drawn: list[dict] = []
    bound = root.copy()
    branch_rank = np.full(len(texts), -1)
    branch_word = np.zeros(len(texts), dtype=np.int64)
    alive = np.ones(len(texts), dtype=bool)
    for rank in range(k):
        live_word = alive[text_of]
        # words from the branching one on are drawn anew; those before it come from the parent sample
        anew = live_word & (place > branch_word[text_of]) if rank else live_word
        at = np.flatnonzero(anew)
        own = keys[text_of[at]] + place[at].astype(np.uint64) * _MORE * _GOLD  # the words' part of the number
        log_at, count_at, steps = lattices.draw(types[at], lambda which, step: uniform(own[which], purpose(rank, 0, step)))
        log = np.zeros(len(types))
        log[at] = log_at
        special: dict[int, list[int]] = {}
        taken: list[tuple[dict, np.ndarray]] = []
        if rank:
            for parent in range(rank):
                from_ = np.flatnonzero(live_word & (branch_rank[text_of] == parent) & (place < branch_word[text_of]))
                log[from_] = drawn[parent]["log"][from_]
                taken.append((drawn[parent], from_))
            first_draws = uniform(keys[:, None], np.stack([counter(rank, 1, branch_word, s) for s in range(8)], axis=1))
            for t in np.flatnonzero(alive).tolist():
                w = int(start[t] + branch_word[t])
                one = branch_word[t : t + 1]
                draws = chain(
                    first_draws[t].tolist(),
                    (float(uniform(keys[t : t + 1], counter(rank, 1, one, s))[0]) for s in count(8)),
                )
                log[w], special[w] = lattices.other(int(types[w]), excluded[t, int(branch_rank[t]), int(branch_word[t])], draws)
        new = {"log": log} | _assemble(at, steps, count_at, special, taken, len(types))
        drawn.append(new)
        total = np.bincount(text_of, weights=log, minlength=len(texts))
        ids, offsets = _ids(lattices, new, text_of, len(texts))
        out.append(Sample(alive.copy(), ids, offsets, total, bound.copy()))
        # split what is left of the popped set by the first word that differs
        before = np.cumsum(log) - log
        before -= (before[np.minimum(start, max(len(before) - 1, 0))] if len(before) else np.zeros(len(texts)))[text_of]
        rest = np.log(-np.expm1(np.minimum(log, -1e-17)))
        rest[log > -1e-12] = -np.inf
        open_ = anew & np.isfinite(rest)
        g = np.full(len(types), -np.inf)
        at = np.flatnonzero(open_)
        phi = before[at] + rest[at]
        noise = -np.log(uniform(keys[text_of[at]], counter(rank, 2, place[at])))
        with np.errstate(over="ignore"):
            g[at] = -np.logaddexp(-bound[text_of[at]], np.log(noise) - phi)
        some = np.flatnonzero(alive & (n_words > 0))
        for _ in range(k - rank):  # only so many of these sets can still be popped or bound the rest
            if not len(some):
                break
            top = np.maximum.reduceat(g, start[some]) if len(some) == len(texts) else _segment_max(g, start, n_words, some)
            hit = np.flatnonzero((g == _spread(top, some, text_of, len(texts))) & np.isfinite(g))
            first = np.unique(text_of[hit], return_index=True)[1]
            for w in hit[first].tolist():
                t = int(text_of[w])
                sets[t].append((float(g[w]), rank, int(place[w])))
                excluded[t, rank, int(place[w])] = [new["edges"][new["first"][w] : new["first"][w] + new["count"][w]].tolist()]
            g[hit[first]] = -np.inf
            some = text_of[hit[first]]
        for t in np.flatnonzero(alive).tolist() if rank else []:  # the popped set without this choice too
            parent, w = int(branch_rank[t]), int(branch_word[t])
            gone = excluded[t, parent, w] + [special[int(start[t] + w)]]
            mass = sum(float(np.exp(sum(map(lattices.log_of, p)))) for p in gone)
            if 1.0 - mass > 1e-12:
                phi_t = float(before[start[t] + w]) + float(np.log(1.0 - mass))
                e = -float(np.log(uniform(keys[t : t + 1], counter(rank, 3, np.array([w])))[0]))
                sets[t].append((-float(np.logaddexp(-bound[t], np.log(e) - phi_t)), parent, w))
                excluded[t, parent, w] = gone
        for t in np.flatnonzero(alive).tolist():
            if sets[t]:
                best = max(sets[t])
                sets[t].remove(best)
                bound[t], branch_rank[t], branch_word[t] = best
            else:
                alive[t], bound[t] = False, -np.inf
        if not alive.any():
            break
    return out, bound


def _segment_max(g: np.ndarray, start: np.ndarray, n: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The largest value of each of the given segments (none empty)."""
    edges = np.stack([start[some], start[some] + n[some]], axis=1).ravel()
    padded = np.append(g, -np.inf)
    return np.maximum.reduceat(padded, edges)[::2]


def _spread(top: np.ndarray, some: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    full = np.full(n, np.inf)
    full[some] = top
    return full[text_of]


def _assemble(at: np.ndarray, steps, count_at: np.ndarray, special: dict[int, list[int]], taken: list[tuple[dict, np.ndarray]], n_words: int) -> dict:
    """A sample's edges word by word: drawn words, branching words, and words taken from parents."""
    count = np.zeros(n_words, dtype=np.int64)
    count[at] = count_at
    for w, own in special.items():
        count[w] = len(own)
    for parent, words in taken:
        count[words] = parent["count"][words]
    first = np.cumsum(count) - count
    edges = np.zeros(int(count.sum()), dtype=np.int64)
    place = first[at]
    for step, (which, e) in enumerate(steps):
        edges[place[which] + step] = e
    for w, own in special.items():
        edges[first[w] : first[w] + len(own)] = own
    for parent, words in taken:
        n = count[words]
        ramp = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        edges[np.repeat(first[words], n) + ramp] = parent["edges"][np.repeat(parent["first"][words], n) + ramp]
    return {"edges": edges, "first": first, "count": count}


def _ids(lattices: Lattices, sample: dict, text_of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in order, and the offsets of each text."""
    ids, n = lattices.tokens(sample["edges"])
    ends = np.concatenate([[0], np.cumsum(n)]) if len(ids) != len(sample["edges"]) else np.arange(len(ids) + 1)
    words = np.bincount(text_of, minlength=n_texts)
    stop = np.cumsum(words)
    upto = np.concatenate([sample["first"], [len(sample["edges"])]])  # edges before each word
    return ids, np.concatenate([[0], ends[upto[stop]]])


def row_keys(keys: list, seed: int) -> np.ndarray:
    """64-bit draws' keys from row keys (null is a key too) and the seed."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest("\0" if k is None else str(k), seed=seed) for k in keys], dtype=np.uint64)


SEGMENTATION = "array<struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"


def encode(
    docs: DataFrame,
    k: int = 2,
    seed: int = 4,
    model: str = MODEL,
    alpha: float = 1.0,
    key_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    out_col: str = "segmentations",
) -> DataFrame:
    """The rows with ``out_col``: up to k distinct sampled segmentations, best first.

    Each has its piece ids, log_prob (of the segmentation given the text), perturbed (log_prob
    plus Gumbel noise) and log_inclusion, the log chance that its perturbed log-probability
    exceeds the (k+1)-th largest one, by which samples can be weighted. A text with fewer than k
    segmentations gets them all, with inclusion 1 (log 0). Null and empty texts have the one empty
    segmentation. ``round_trip`` says whether all samples decode to the text. Rows with equal keys
    and texts get equal samples; null keys are one key. Columns of ``keep`` (by default all) are
    returned as they are, but those named ``out_col`` or ``round_trip`` (in any case), which the
    new columns replace. A text, and a word, is handled as a whole: a worker needs about 100 bytes
    for each character of the longest text and 300 for each of the longest word.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (out_col.lower(), "round_trip")]
    key, text = fresh(docs.select(*(F.col(f"`{c}`") for c in names)), "row_key", "text_to_encode")
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(key_col).cast("string").alias(key), F.col(f"`{text_col}`").alias(text))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Vocabulary(model, alpha))  # a few MB, whatever the input
    schema = T.StructType([*rows.drop(key, text).schema.fields, T.StructField(out_col, T._parse_datatype_string(SEGMENTATION)), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(sent.value)
        for batch in batches:
            texts = batch.column(len(names) + 1).to_pylist()
            keys = row_keys(batch.column(len(names)).to_pylist(), seed)
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= RUN_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                part, own = batch.slice(at, to - at), [t or "" for t in texts[at:to]]
                found, equal = _column(lattices, own, keys[at:to], k)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), found, equal], names=[*names, out_col, "round_trip"])
                at = to

    return rows.mapInArrow(lambda b: give_back(run(b)), schema)


def _column(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
    samples, bound = sample_run(lattices, texts, keys, k)
    counts = np.sum([s.has for s in samples], axis=0)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) + 1 if r else 0 for r in raw])
    spoken = np.frombuffer(b"".join(b" " + r for r in raw if r), dtype=np.uint8)
    ends = np.cumsum(lengths)
    same = np.ones(len(texts), dtype=bool)
    ids, log_prob, perturbed, inclusion, order, sizes = [], [], [], [], [], []
    for rank, s in enumerate(samples):
        decoded = lattices.v.decode(s.ids)
        mask = np.repeat(s.has, lengths)
        own = spoken[mask]
        if len(own) != len(decoded):
            same &= False
        elif len(own):
            bad = np.concatenate([[0], np.cumsum(own != decoded)])
            e = np.cumsum(np.where(s.has, lengths, 0))
            same &= bad[e] == bad[e - np.where(s.has, lengths, 0)]
        at = np.flatnonzero(s.has)
        ids.append(s.ids)
        sizes.append(np.diff(s.offsets)[at])
        log_prob.append(s.log_prob[at])
        perturbed.append(s.perturbed[at])
        with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
            gap = s.log_prob[at] - bound[at]
            some = np.exp(np.minimum(gap, 700))
            inclusion.append(np.where(gap < -30, gap, np.log(-np.expm1(-some))))
        order.append(at * len(samples) + rank)
    order = np.argsort(np.concatenate(order), kind="stable")
    sizes, ids = np.concatenate(sizes), np.concatenate(ids)
    starts = np.cumsum(sizes) - sizes
    n = sizes[order]
    gather = np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids[gather].astype(np.int32)))
    structs = pa.StructArray.from_arrays(
        [lists, *(pa.array(np.concatenate(x)[order]) for x in (log_prob, perturbed, inclusion))],
        names=["ids", "log_prob", "perturbed", "log_inclusion"],
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, structs), pa.array(same)


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL, out_col: str = "text") -> DataFrame:
    """The rows with the text that the array ``ids_col`` spells; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(names.index(ids_col)).to_pylist():
                spelt = None if ids is None else sent.value.decode(np.array(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")
                texts.append(spelt[1:] if spelt and spelt[0] == " " else spelt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out_col])

    return rows.mapInArrow(lambda b: give_back(run(b)), schema)


def contract(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``encode`` with token counts, digests of the ids, and whether all samples decode to the text."""
    return found.select(
        id_col,
        F.size("segmentations").alias("n_samples"),
        F.transform("segmentations", lambda s: F.size(s["ids"])).alias("n_tokens"),
        "segmentations",
        "round_trip",
    )
