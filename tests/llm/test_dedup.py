"""op7 and op8 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import SCHEMA, corpus, words

from logloom.llm import bottomk_dedup as B
from logloom.llm import fm_dedup as S
from logloom.llm.common import U64, Scratch
from logloom.llm.components import components


def near(rows, size):
    """(set size, component) by id, from all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(low))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(rows, window=50):
    first, text = {}, {d: words(t) for d, t in rows}
    for d in sorted(text):
        for i in range(len(text[d]) - window + 1):
            first.setdefault(tuple(text[d][i : i + window]), d)
    out = {}
    for d, w in text.items():
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    want = near(rows, 4)
    got = B.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_lists_with_several_components_are_searched_on(spark, monkeypatch):
    """With small blocks and few columns at once, crowds still come together."""
    monkeypatch.setattr(B, "COLUMNS_AT_ONCE", 32)
    monkeypatch.setattr(B, "BLOCK", 8)
    rows = corpus(3)
    assert {r.doc_id: r.component_id for r in B.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4).collect()} == {d: c for d, (_, c) in near(rows, 4).items()}


def test_least_shared_is_never_above_what_small_sets_share(spark):
    rows = spark.range(1, 400).select(B.least_shared(__import__("pyspark").sql.functions.col("id"), 0.8).alias("c"), "id").collect()
    for r in rows:
        assert 1 <= r.c <= max(1, -(-8 * min(r.id, B.KEPT) // 10))
        if r.id <= 51:
            assert r.c == -(-8 * r.id // 10)


def test_near_duplicates_odd_tables(spark):
    assert B.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, None), (7, "q")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in B.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    clash = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y")], "doc_id long, text string, component_id long, rep string")
    assert sorted(tuple(r) for r in B.one_of_each(clash).collect()) == [(1, "a b c d e f", 1, "x")]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (150, 300)]
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert Counter(r.component for r in got) == {0: 61, 100: 61, 200: 2} and len({r.node for r in got}) == len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_all_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", 300)
    monkeypatch.setattr(S, "QUERY_WORDS", 500)
    rows = corpus(seed)
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats(rows) and len(got) == len(rows)


def test_repeats_odd_tables(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (4, text), (4, text), (6, text), (6, f"zz {text}"), (8, "v1 " * 49), (9, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 60, 0), (4, 60, 0), (4, 60, 0), (6, 60, 60), (6, 61, 60), (8, 49, 0), (9, 0, 0)]


def test_index_counts_and_matches():
    rnd = np.random.default_rng(1)
    for size in (1, 3, 40):
        parts = [rnd.integers(1, size + 1, rnd.integers(1, 200)).astype(U64) for _ in range(6)]
        index = S.FMIndex.unpack(S.FMIndex.build(parts).pack())
        held = defaultdict(set)
        for p in parts:
            for w in range(1, 7):
                held[w] |= {tuple(p[i : i + w]) for i in range(len(p) - w + 1)}
        queries = [rnd.integers(1, size + 3, rnd.integers(1, 60)).astype(U64) for _ in range(20)] + [parts[0], parts[1][3:]]
        for w in range(1, 7):
            for q, found in zip(queries, index.matched(queries, w), strict=True):
                assert found.tolist() == [i + w <= len(q) and tuple(q[i : i + w]) in held[w] for i in range(len(q))]


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(2)
    w = rnd.integers(0, 1 << 62, 300).astype(U64)
    grams = S.window_hashes(w, S.GRAM)
    assert S.anchors(w).tolist() == [grams[i : i + S.WINDOW - S.GRAM + 1].min() for i in range(251)]
    assert len(S.anchors(w[:49])) == 0


def test_one_of_each_under_null_and_repeated_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text, "a")] * 3 + [(7, text, "b")] * 3 + [(8, "other words here that stand alone", "c"), (None, None, "d"), (None, None, "d"), (9, "first of two texts under one id", "e"), (9, "second text of the very same id", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumn("key", F.lit(1)).withColumn("odd", F.lit(2))
    out = B.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((str(r.doc_id), r.text) for r in out.collect()), key=repr)
    assert sum(t == text for _, t in got) == 1 and ("None", None) in got and len(got) == 5, got


def test_crowds_of_unlinked_families_give_few_rows(spark):
    """A crowd whose members share half of their words: sketches leave pairs open, and blocks give a forest of them, no more."""
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(w if rnd.random() < 0.97 else f"x{rnd.randrange(10**6)}" for w in base)) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    between, within = B._between, B._within
    try:
        B._between = lambda *a: seen.append(between(*a).count()) or between(*a)
        B._within = lambda *a: seen.append(within(*a).count()) or within(*a)
        got = {r.doc_id: r.component_id for r in B.near_duplicates(frame, 4, 0.8).collect()}
    finally:
        B._between, B._within = between, within
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for d, t in docs}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert got == {d: top(d) for d in sets}
    assert all(n < 5 * len(docs) for n in seen), seen


def test_blocks_repeat_no_member_and_every_outer_pair_meets_once(spark, monkeypatch):
    """A crowd with few outsiders: its rows go into one block each, whatever the number of blocks."""
    monkeypatch.setattr(B, "BLOCK", 16)
    family = {k: 0 if k >= 40 else k % 20 + 1 for k in range(1000)}
    rows = spark.createDataFrame([(7, k, 9, f) for k, f in family.items()], "value long, rep long, n long, family long")
    own = spark.createDataFrame([(k, f"t{k}") for k in family], "rep long, text string")
    pairs = B._blocks(rows, own, "value", "family", F.lit(1), "text").toArrow()
    cells = [pairs.slice(k, 1) for k in range(len(pairs))]
    assert len(cells) <= 3 * 63
    every = [m["rep"] for c in {c["j"][0].as_py(): c for c in cells}.values() for m in c["every"][0].as_py()]
    assert sorted(every) == sorted(family)
    met = Counter()
    for c in cells:
        members, outer, meet = B._met(c)
        rep = members.field("rep").to_pylist()
        assert members.field("text").to_pylist() == [f"t{r}" for r in rep]
        met.update(tuple(sorted((rep[outer[x]], rep[y]))) for x, y in zip(*np.nonzero(meet)))
    want = {(a, b) for a in family for b in family if a < b and (family[a] or family[b])}
    assert set(met) == want and set(met.values()) == {1}
