import random

import pytest

from logloom.operators import baselines as B


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def _sim(a, b):
    a, b = a.split(), b.split()
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def _in_order(rows, thr):
    """The parser as a loop: line -> (template, is_new)."""
    made, out = {}, {}
    for ds, i, s in sorted(rows):
        best = max(((_sim(s, t), -k, t) for k, t in enumerate(made.get(ds, [])) if t), default=(-1.0, 0, None))
        if best[0] >= thr:
            out[ds, i] = best[2], False
        else:
            made.setdefault(ds, []).append(s)
            out[ds, i] = s, True
    return out


def _rows(n, seed):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "f", "get", "put", "<*>"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 7))) for _ in range(n)]
    return [(rnd.choice(("one", "two")), i, rnd.choice(texts)) for i in range(n)]


SCHEMA = "dataset string, line_id long, normalised string"


@pytest.mark.parametrize("thr", [0.5, 0.8])
def test_parse_equals_the_loop(spark, thr):
    rows = _rows(150, 5)
    got = B.lcs_parse(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), thr, first=20, growth=3).collect()
    assert {(r["dataset"], r["line_id"]): (r["template"], r["is_new"]) for r in got} == _in_order(rows, thr)


def test_match_takes_the_first_best(spark):
    rows, made = _rows(80, 6), [("one", k, t) for k, t in enumerate(["a b c d", "a c", "get <*> put", "f f e", "", "a c"])]
    tmpls = spark.createDataFrame(made, "dataset string, t_ord long, template string")
    lines = spark.createDataFrame(rows + [("one", 900, None), ("one", 901, "a c")], SCHEMA)
    got = {(r["dataset"], r["line_id"]): (r["template"], r["sim"]) for r in B.lcs_match(lines, tmpls, 0.6).collect()}
    assert len(got) == 82 and got["one", 900] == (None, None) and got["one", 901] == ("a c", 1.0)
    for ds, i, s in rows:
        best = max(((_sim(s, t), -k, t) for d, k, t in made if d == ds), default=(0.0, 0, None))
        assert got[ds, i] == ((best[2], best[0]) if best[0] >= 0.6 else (None, None))


def test_pairs_are_all_pairs(spark):
    texts = sorted({(d, s) for d, _, s in _rows(90, 7)})
    df = spark.createDataFrame([(d, k, s) for k, (d, s) in enumerate(texts)], "dataset string, id long, text string")
    for thr in (0.3, 1.0):
        got = {(r["a"], r["b"]) for r in B.lcs_pairs(df, df, thr, earlier=True).collect()}
        assert got == {(i, j) for i, (d, s) in enumerate(texts) for j, (e, t) in enumerate(texts[:i]) if d == e and _sim(s, t) >= thr}
    assert B.lcs_parse(spark, spark.createDataFrame([], SCHEMA)).count() == 0
