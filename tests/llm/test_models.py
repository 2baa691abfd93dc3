"""Operators that SQL can't express, against brute force, exact laws and held-out labels."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratakv.llm import licenses, minhash, pii, quality, registry
from stratakv.llm import sentencepiece_sampling as sampling
from stratakv.llm.decontamination import split_words

from .cases import LICENCE, TEXTS, frame

SF = "/root/testdata/sf0.01"


# --- licences ---------------------------------------------------------------------------------------

def test_licences(spark):
    rows = [(1, LICENCE), (2, "x\n" + licenses.MIT.upper()), (3, "Copyright 2001 B\n" + licenses.MIT.replace(", ", " ,\n")), (4, None), (5, "a\n// SPDX-License-Identifier: MIT\n SPDX-License-Identifier:  mit."), (6, "...")]
    found = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [found[i].license_id for i in range(1, 7)] == ["MIT", None, "MIT", None, None, None]
    assert found[1].notices == ["MIT"] and found[5].n_notices == 2 and found[4].notices == []


# --- near-duplicates ----------------------------------------------------------------------------------

def shingle_set(text, n=5):
    w = split_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, similarity=0.8):
    """Classes by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = Counter()
    for members in by.values():
        for a, b in itertools.combinations(members, 2):
            common[a, b] += 1
    same = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        same[t or ""].append(i)
    links = [(a, b) for (a, b), n in common.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    links += [(m[0], x) for m in same.values() for x in m[1:]]
    for a, b in links:
        parent[root(a)] = root(b)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[root(i)].append(d)
    return Counter(tuple(sorted(v, key=lambda x: (x is None, x))) for v in out.values())


def got_classes(df):
    out = defaultdict(list)
    kept = Counter()
    for r in df.collect():
        out[r.class_id, r.class_size].append(r.doc_id)
        kept[r.class_id, r.class_size] += r.kept
    assert all(n == 1 for n in kept.values())
    assert all(size == len(v) for (_, size), v in out.items())
    return Counter(tuple(sorted(v, key=lambda x: (x is None, x))) for v in out.values())


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(len(w), size=edits, replace=False):
            w[at] = f"q{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


def family_rows():
    """Groups around a base where the copies resemble the base and hardly each other."""
    rng = np.random.default_rng(3)
    texts = []
    for size, edits, n in ((200, 4, 60), (150, 3, 5), (80, 1, 2)):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        texts += [" ".join(base), *copies(rng, base, n, edits)]
    texts += [" ".join(f"z{rng.integers(10**6)}" for _ in range(100)) for _ in range(40)]
    return list(enumerate(texts))


def test_near_dedup_equals_all_pairs(spark):
    rows = family_rows()
    assert got_classes(minhash.classes(frame(spark, rows))) == brute_classes(rows)


def test_near_dedup_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    rows = family_rows()
    assert got_classes(minhash.classes(frame(spark, rows))) == brute_classes(rows)


def test_near_dedup_checks_few_pairs_of_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [f"w{rng.integers(10**6)}" for _ in range(200)]
    rows = list(enumerate([" ".join(base), *copies(rng, base, 150, 2)]))
    seen = []
    checked = minhash._checked

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return checked(pairs, sets, similarity)

    monkeypatch.setattr(minhash, "_checked", counted)
    assert got_classes(minhash.classes(frame(spark, rows))) == brute_classes(rows)
    assert sum(seen) <= 2 * len(rows)


def test_near_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got_classes(minhash.classes(docs)) == brute_classes(rows)
    assert minhash.drop_near_duplicates(docs).count() == len(list(brute_classes(rows).elements()))


def test_near_dedup_odd_rows(spark):
    # (a null id is larger than the others, so it never names a class with other ids)
    got = minhash.classes(frame(spark))
    assert got.count() == len(TEXTS)
    kept = minhash.drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.count() == len({r.class_id for r in got.collect()} )


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    element = rng.integers(1, 2**62, size=60).astype(np.uint64)
    a, b = rng.uniform(0, 6, 60), rng.uniform(0, 6, 60)
    text = np.repeat([0, 1], 60)
    k = 4096
    s = minhash.dart_signatures(text, np.concatenate([element, element]), np.concatenate([a, b]), 2, k, 1)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)


def test_counted_weights(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, " ".join([base, base]))]
    assert len(got_classes(minhash.classes(frame(spark, rows)))) == 1
    assert len(got_classes(minhash.classes(frame(spark, rows), weights="count"))) == 2


# --- sampling of segmentations --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lattices():
    return sampling.Lattices(sampling.Vocabulary())


def test_one_word_of_more_than_2_18_tokens(lattices):
    text = "ab" + "\U00010330" * ((1 << 18) + 9)  # ends in characters that only bytes spell
    samples, bound = sampling.sample_run(lattices, [text], sampling.row_keys([7], 1), 2)
    v, own = lattices.v, [s.ids[s.offsets[0] : s.offsets[1]].tolist() for s in samples]
    assert own[0] != own[1] and samples[0].perturbed[0] >= samples[1].perturbed[0] >= bound[0]
    tail = [int(v.byte_ids[b]) for b in text[2:].encode()]
    assert all(ids[-len(tail) :] == tail and len(ids) > len(tail) for ids in own)


def test_draws_do_not_repeat_after_2_18_steps(lattices, monkeypatch):
    asked = []
    monkeypatch.setattr(sampling, "uniform", lambda key, counter: asked.append(counter) or np.full(np.shape(counter), 0.5))
    monkeypatch.setattr(lattices, "draw", lambda types, uniforms: [uniforms(np.array([0]), s) for s in (0, 1 << 18, 1 << 19)] and 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sampling.sample_run(lattices, ["ab"], sampling.row_keys([7], 1), 1)
    assert len({int(c[0]) for c in asked[-3:]}) == 3


def all_segmentations(v, word):
    """Every segmentation of a word with its log-weight."""
    out = []

    def go(at, ids, log):
        if at == len(word):
            out.append((tuple(ids), log))
            return
        node = np.zeros(1, dtype=np.int64)
        for k in range(at, len(word)):
            c = sampling.SPACE if word[k] == " " else ord(word[k])
            node = v.step(node, np.array([c]))
            if node[0] < 0:
                break
            piece = int(v.piece[node[0]])
            if piece >= 0:
                go(k + 1, [*ids, piece], log + v.log[piece])

    go(0, [], 0.0)
    return out


def test_types_dropped_and_kept_sample_alike(monkeypatch):
    v = sampling.Vocabulary()
    rng = np.random.default_rng(5)
    names = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(1, 70, 400)] + ["\u4e2d\u6587", "\u2581", "\U0001f600" * 9]
    texts = [" ".join(names[int(i)] for i in np.minimum(rng.geometric(0.02, 60), len(names)) - 1) for _ in range(120)] + [" ".join(names)]
    keys = sampling.row_keys(list(range(len(texts))), 4)

    def run(bound):
        monkeypatch.setattr(sampling, "KEPT_EDGES", bound)
        lattices, out, kept, shrink = sampling.Lattices(v), [], [], sampling.Lattices.shrink

        def seen(own):
            before = len(own.length)
            shrink(own)
            kept.append((before, len(own.length)))

        monkeypatch.setattr(sampling.Lattices, "shrink", seen)
        for i in range(0, len(texts), 5):
            out += sampling._column(lattices, texts[i : i + 5], keys[i : i + 5], 3)[0].to_pylist()
        monkeypatch.setattr(sampling.Lattices, "shrink", shrink)
        return out, kept

    (few, kept), (every, never) = run(3000), run(10**9)
    assert not never and any(0 < after < before for before, after in kept)
    for a, b in zip(few, every, strict=True):
        assert [x["ids"] for x in a] == [x["ids"] for x in b]
        assert np.allclose([x["log_prob"] for x in a], [x["log_prob"] for x in b], rtol=1e-9)


def test_samples_follow_the_lattice(lattices):
    v = lattices.v
    text, n, k = "ingot re", 4000, 3
    every = all_segmentations(v, " " + text)
    total = np.logaddexp.reduce([log for _, log in every])
    chance = {ids: math.exp(log - total) for ids, log in every}
    keys = sampling.row_keys(list(range(n)), 1)
    samples, bound = sampling.sample_run(lattices, [text] * n, keys, k)
    seen, inclusion = [Counter() for _ in range(k)], Counter()
    for i in range(n):
        own = [tuple(s.ids[s.offsets[i] : s.offsets[i + 1]].tolist()) for s in samples]
        assert len(set(own)) == k
        perturbed = [s.perturbed[i] for s in samples] + [bound[i]]
        assert perturbed == sorted(perturbed, reverse=True)
        for c, ids, s in zip(seen, own, samples, strict=True):
            c[ids] += 1
            assert abs(s.log_prob[i] - math.log(chance[ids])) < 1e-9
            # 1 / inclusion is an unbiased count: its mean sums to the number of segmentations
            inclusion[ids] += 1 / -math.expm1(-math.exp(s.log_prob[i] - bound[i]))
    top = sorted(chance, key=chance.get, reverse=True)[:6]
    for ids in top:
        p = chance[ids]
        assert abs(seen[0][ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n)
        second = sum(q * p / (1 - q) for o, q in chance.items() if o != ids)
        assert abs(seen[1][ids] / n - second) < 5 * math.sqrt(second * (1 - second) / n)
        assert p < 1e-4 or abs(inclusion[ids] / n - 1) < 0.25


def test_words_never_cut_a_piece(lattices):
    v = lattices.v
    for text in ("don't stop_it (now), x.y=3; a_b.c²", "é中文 𝒳\t z▁ q\n\n  w", "!!??.,.. --"):
        codes = np.array([ord(c) for c in " " + text], dtype=np.uint32)
        joined = np.flatnonzero(v.word_starts(codes)).tolist()[1:]
        assert joined
        for i, _ in enumerate(text):
            node = np.zeros(1, dtype=np.int64)
            for j in range(i, len(text) + 1):
                c = (" " + text)[j]
                if c == chr(sampling.SPACE):  # in a text it is spelt in bytes
                    break
                node = v.step(node, np.array([sampling.SPACE if c == " " else ord(c)]))
                if node[0] < 0:
                    break
                if v.piece[node[0]] >= 0:
                    assert not any(i < cut <= j for cut in joined), (text, i, j)


def test_encoding_round_trip(spark):
    docs = frame(spark)
    rows = sampling.encode(docs, k=3, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.round_trip
        ids = [tuple(s.ids) for s in r.segmentations]
        assert len(set(ids)) == len(ids) and 1 <= len(ids) <= 3
        if not r.text:
            assert ids == [()] and r.segmentations[0].log_inclusion == 0
    exploded = spark.createDataFrame([(r.text, list(s.ids)) for r in rows for s in r.segmentations if r.text], "text string, ids array<int>")
    assert sampling.decode(exploded.withColumnRenamed("text", "want")).where("text <> want").count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: r.segmentations for r in sampling.encode(docs, keep=["doc_id"]).collect()}
    b = {r.doc_id: r.segmentations for r in sampling.encode(docs.repartition(7), keep=["doc_id"]).collect()}
    assert a.keys() == b.keys()
    for k, own in a.items():
        assert [s.ids for s in own] == [s.ids for s in b[k]]
        assert np.allclose([s[1:] for s in own], [s[1:] for s in b[k]], atol=1e-6)


# --- quality -----------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    got = registry.op6_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, "x"), (4, None, "x"), (6, 0, "x"), (None, 1, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    assert quality.judge(frame(spark), labels).count() == len(TEXTS)
    assert [r.score for r in quality.judge(frame(spark), labels.limit(0)).collect()] == [0.5] * len(TEXTS)
    kept = quality.keep_good(frame(spark), labels.limit(0))
    assert kept.columns == frame(spark).columns and kept.count() == len(TEXTS)


def test_repeated_ids_are_learned_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    often = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id = 14").crossJoin(spark.range(200)).drop("id"))
    once, more = (quality.fit(d, labels, quality.learnable) for d in (docs, often))
    assert np.allclose(once.weights, more.weights, atol=1e-6) and np.allclose(once.y, more.y, atol=1e-6)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    w, v = rng.uniform(0.5, 2, 30), rng.normal(size=30)
    fit = quality.isotonic(w, v)
    assert (np.diff(fit) >= -1e-12).all()
    for i in range(30):  # min-max formula
        want = max(min((w[a : b + 1] * v[a : b + 1]).sum() / w[a : b + 1].sum() for b in range(i, 30)) for a in range(i + 1))
        assert abs(fit[i] - want) < 1e-9


# --- personal data -----------------------------------------------------------------------------------------

def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.6
    accurate = [0.9, 0.85, 0.8, 0.75, 0.5]
    votes = np.stack([np.where(rng.random(5000) < a, truth, ~truth) * 2 - 1 for a in accurate], axis=1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    p = pii.reliabilities(np.zeros(len(rows), dtype=int), rows, counts, pii.Fit())
    lookup = {tuple(r): x for r, x in zip(rows, p, strict=True)}
    guess = np.array([lookup[tuple(v)] > 0.5 for v in votes])
    best = np.stack([votes[:, j] > 0 for j in range(4)]).mean(axis=0) > 0.5
    assert (guess == truth).mean() >= (best == truth).mean() - 0.01


def test_added_spans(spark):
    rows = [(i, f"please call 030 {1000000 + i} today") for i in range(60)] + [(99, "version 0123 456789012345678")]
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert [s.kind for s in found[1].found] == ["phone_local"] and found[1].n_phone == 0


# --- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema, name
            docs = out
        ids = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_on_odd_rows(spark):
    """Every stage takes nulls, empty and long texts, repeated rows and clashing columns."""
    docs = frame(spark)
    labels = spark.createDataFrame([(3, 1), (6, 0), (11, 1)], "doc_id long, quality int")
    good = quality.keep_good(docs, labels)
    assert good.schema == docs.schema and good.count() >= len(TEXTS) - 3
    once = corpus_pipeline.exact_stage(spark, docs, "")
    assert once.schema == docs.schema
    single = corpus_pipeline.near_stage(spark, once, "")
    assert single.schema == docs.schema
    assert {r.doc_id for r in single.select("doc_id").collect()} >= {6, 7, 8, 9}
