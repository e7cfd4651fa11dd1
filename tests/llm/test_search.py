"""op11, op12, op13: each against a plain version, and odd rows."""

import bisect
import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import SCHEMA, corpus

from logloom.llm import cover_negatives as C
from logloom.llm import lexical_search as S
from logloom.llm import warc_files as W
from logloom.llm.common import range_of

# ------------------------------------------------------------------ op11

VECTORS = "vec_id long, embedding array<double>, label int, anchor string, tree int"


def clustered(seed, n, size, spread=0.05):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, size))
    return [(centres[rnd.integers(6)] + spread * rnd.normal(size=size)).tolist() for _ in range(n)]


def plain_negatives(rows):
    """Every score of every pair; the contract's rules, one by one."""
    taken = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        taken.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, own, v in taken:
        if a % 100:
            continue
        alike = sorted((-score(v, w), i) for i, label, w in taken if label == own and i != a)[:5]
        others = sorted((-score(v, w), i) for i, label, w in taken if label != own)
        for minus, p in alike:
            found = [(-s, i) for s, i in others if -30 * minus <= -100 * s <= -90 * minus][:10]
            out += [(a, p, k + 1, i, -minus, s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = C.hard_negatives(frame, F.col("id") % 100 == 0, moved)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "TREE_ROWS", 64)
    rnd = random.Random(2)
    near = clustered(1, 500, 6)
    rows = [(k, near[k] if k % 3 else near[0], rnd.randrange(4)) for k in range(500)]  # a third are copies of one vector
    rows += [(600, None, 1), (700, [1.0, None, 2.0], 2), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1), (1000, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [(1100, [0.0] * 6, 1), (1200, [0.5, 0.25], 1), (1300, [], 2), (1400, [-0.5] * 6, 3), (1501, [0.5] * 9, 1), (1502, [0.5] * 9, 1)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 50


def test_rows_that_repeat_an_id_and_empty_tables(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2)]
    got = mined(spark, rows)
    assert {r[:4] for r in got} == {(100, 1, 1, 2), (100, 1, 2, 2)} and len(got) == 8  # two anchors, two equal positives, two negatives
    assert mined(spark, []) == [] and mined(spark, [(3, [1.0], 1)]) == []


def test_tree_is_a_cover_tree_and_skips():
    points = np.floor(256 * np.array(clustered(3, 3000, 16)))
    ids = np.arange(3000)
    tree = C.Tree.load(C.Tree.build(ids, ids % 5, points).dump())
    square = (tree.points**2).sum(axis=1)
    raised = np.column_stack([tree.points, np.sqrt(np.maximum(square.max() - square, 0))])

    def below(node):
        if tree.child_to[node] == tree.child_from[node]:
            return list(range(tree.point_from[node], tree.point_to[node]))
        return [p for c in range(tree.child_from[node], tree.child_to[node]) for p in below(c)]

    assert sorted(below(0)) == list(range(len(tree.points)))
    for node in range(len(tree.centre)):
        mine = below(node)
        assert tree.centre[node] in mine
        assert np.linalg.norm(raised[mine] - raised[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-9
        heads = raised[tree.centre[tree.child_from[node] : tree.child_to[node]]]
        if len(heads) > 1:  # a net: far apart, all points near one
            away = np.linalg.norm(heads[:, None] - heads[None], axis=2) + 1e9 * np.eye(len(heads))
            assert away.min() > tree.radius[node] / C.BASE - 1e-6
            assert tree.radius[tree.child_from[node] : tree.child_to[node]].max() <= tree.radius[node] / C.BASE + 1e-6
    q = points[7]
    scores = points @ q
    query = C.Query(q, [0.3 * scores[7]], [0.9 * scores[7]], 10, lambda labels, _: labels != 2)
    opened = C.descend([tree], query)
    may = np.flatnonzero((ids % 5 != 2) & (scores >= 0.3 * scores[7]) & (scores <= 0.9 * scores[7]))
    assert query.ids[0].tolist() == may[np.lexsort((may, -scores[may]))][:10].tolist()
    assert opened < len(tree.centre) / 2


# ------------------------------------------------------------------ op12

PAGES = "page_id long, url string, html string, payload int, digest string, range int"


def pages(seed=3):
    rnd = random.Random(seed)
    long = ["<p>" + "é日本x" * rnd.randint(200, 600) + str(k) for k in range(20)]
    out = [(k, f"http://a.example/{rnd.random()}", rnd.choice(long) if rnd.random() < 0.6 else f"<b>{rnd.randrange(9)}</b>") for k in range(300)]
    out += [(300 + k, f"http://hot.example/{k}", long[0]) for k in range(150)]
    out += [(1000, None, None), (1001, "", ""), (1002, "http://x/\r\nWARC-Type: no <é>", "y" * 999), (1003, "u", "y" * 999), (1004, "u", "z" * 1000), (1005, "u", "z" * 1000), (1006, "u", "<a>" + "long " * 100_000)]
    rnd.shuffle(out)
    return out


def plain_records(rows):
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = last[html or ""]
        revisit = len(data) >= 1000 and to != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "", 7) for r in rows], PAGES)


def test_archive_tells_what_was_written(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/a"
    files = W.write_archive(frame_of(spark, rows), folder, most_bytes=4000).collect()
    assert max(f.seq for f in files) > 2 and sum(f.n_records for f in files) == len(rows)
    assert not os.path.exists(f"{tmp_path}/a/_temporary")
    back = W.read_archive(spark, folder).collect()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back)
    assert got == plain_records(rows)
    html = {p: (h or "").encode() for p, _, h in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") and r.payload in (None, html[r.page_id]) for r in back)
    for f in files:  # plain gzip readers see the records, in order, and digests are those of the manifest
        data = open(f"{tmp_path}/a/{f.name}", "rb").read()
        assert len(data) == f.bytes and hashlib.sha1(data).hexdigest() == f.sha1
        ids = [int(x) for x in re.findall(rb"WARC-Record-ID: <urn:page:(\d+):", gzip.decompress(data))]
        assert ids == sorted(ids) and len(ids) == f.n_records
    at = {r.page_id: r for r in back}
    assert at[1000].url == "urn:page:1000" and at[1002].url == "http://x/%0D%0AWARC-Type:%20no%20%3C%C3%A9%3E"


def test_same_rows_same_bytes(spark, tmp_path):
    rows = pages()
    sums = []
    for k, order in enumerate((rows, rows[::-1])):
        files = W.write_archive(frame_of(spark, order).repartition(1 + 4 * k), f"file://{tmp_path}/{k}", most_bytes=4000)
        sums.append(sorted((f.name, f.sha1) for f in files.collect()))
    assert sums[0] == sums[1]


def test_archive_of_odd_rows(spark, tmp_path):
    text = "q" * 2000
    rows = [(None, "u", text), (None, None, text), (5, "u", text), (5, "u", text), (5, "v", text), (6, "w", "short"), (6, "w", "short")]
    folder = f"file://{tmp_path}/b"
    W.write_archive(frame_of(spark, rows), folder)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in W.read_archive(spark, folder).collect())
    assert got == {(None, "revisit", 5): 2, (5, "response", None): 1, (5, "revisit", 5): 2, (6, "response", None): 2}
    with pytest.raises(Exception, match="manifest already"):
        W.write_archive(frame_of(spark, rows), folder)
    only = f"file://{tmp_path}/c"
    W.write_archive(frame_of(spark, rows[:2]), only)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in W.read_archive(spark, only).collect()) == [(None, "response", None), (None, "revisit", None)]
    assert W.archived(frame_of(spark, [])).collect() == []


def test_damage_is_found(spark, tmp_path):
    folder = f"{tmp_path}/d"
    name = W.write_archive(frame_of(spark, [(1, "u", "text")]), f"file://{folder}").first().name
    data = gzip.decompress(open(f"{folder}/{name}", "rb").read())
    record = data[data.index(b"WARC/1.1", 5) :]
    W.parsed(record)
    with pytest.raises(OSError, match="damaged"):
        W.parsed(record.replace(b"text\r\n", b"tExt\r\n"))
    with open(f"{folder}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="size"):
        W.read_archive(spark, f"file://{folder}").collect()


def test_range_of_is_a_binary_search(spark):
    rnd = random.Random(5)
    cuts = sorted(rnd.sample(range(10_000), 1_000))
    got = spark.range(10_000).select("id", range_of(F.col("id"), [F.lit(c) for c in cuts]).alias("r")).collect()
    assert all(r.r == bisect.bisect_right(cuts, r.id) for r in got)
    assert spark.range(1).select(range_of(F.col("id"), [])).first()[0] == 0


# ------------------------------------------------------------------ op13

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k):
    terms = [Counter(TERM.findall((t or "").translate(LOW))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n_all, length = sum(map(bool, sizes)), sum(sizes)
    df = Counter(x for c in terms for x in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOW)))
        scores = []
        for (doc, _), c, n in zip(docs, terms, sizes):
            if n:
                m = 75 + 25 * n * n_all // length
                score = sum(r * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x, r in asked.items() if x in c)
                if score > 0:
                    scores.append((-score, doc is None, doc))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], SCHEMA + ", n int, terms int")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in S.ranked_search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize(("run", "chunk", "sparse", "at_once"), [(1024, 65_536, 64, 10_000), (8, 20, 4, 3), (4, 65_536, 1_000, 10_000)])
def test_ranks_equal_all_scores(spark, monkeypatch, run, chunk, sparse, at_once):
    for name, value in (("RUN", run), ("CHUNK_DOCS", chunk), ("SPARSE", sparse), ("QUERIES_AT_ONCE", at_once), ("PIECE", 1 << 10)):
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(run)
    docs = corpus(7) + [(None, "w1 w2 é"), (20_000, "Ünï-code w1,w2;w3_w4"), (20_001, "W1 " * 900), (20_002, "\x00w1\x7fw2")]
    items = [(k, _asked(rnd, docs)) for k in range(12)]
    items += [(100, None), (101, ""), (102, "-- !"), (103, "w1 W1 w1 é"), (104, "unknown"), (None, "w2 w3")]
    assert found(spark, docs, items, 5) == plain_ranks(docs, items, 5)


def _asked(rnd, docs):
    text = rnd.choice([t for _, t in docs if t and len(t.split()) > 5])
    return " ".join(rnd.choice(text.split()) for _ in range(8))


def test_search_of_empty_tables_and_repeats(spark):
    assert found(spark, [], [(1, "a")], 5) == [] and found(spark, [(1, "a")], [], 5) == [] and found(spark, [(1, None), (2, "--")], [(1, "a")], 5) == []
    docs = [(1, "a b"), (1, "a b"), (2, "a c"), (3, "d")]
    assert found(spark, docs, [(1, "b"), (1, "a")], 5) == plain_ranks(docs, [(1, "a")], 5)


def test_runs_are_skipped():
    """Two documents hold the rare term; once they are held, runs with the common one alone are not walked."""
    docs = 64 * S.RUN
    ends = np.arange(docs + 1)
    terms = np.zeros(docs, np.int64)
    terms[[3, 9]] = 1
    chunk = S.Chunk(np.arange(docs), np.full(docs, 10), ends, terms, np.ones(docs, np.int64), docs, 10 * docs)
    best = S.Best(2)
    chunk.search(np.array([0, 1]), np.array([10, 9000]), best)
    assert best.ids.tolist() == [3, 9] and chunk.walked == 1
