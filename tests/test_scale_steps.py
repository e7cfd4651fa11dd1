"""Steps shared by many queries: parsed once, pairs by blocks, variable tokens counted as one."""

import math
import random

from pyspark.sql import functions as F

from logloom import config
from logloom.functions import text as T
from logloom.operators import frame_ops, store, templates


def test_lines_are_parsed_once(spark):
    """A filter on content or normalised repeats neither the format nor the masks."""
    p = config.preset("HDFS")
    rows = [("d", i, r) for i, r in enumerate([
        "2024-01-01 10:00:00 7 INFO view: Served page 3 to 10.0.0.1:80 for blk_5", "no format here blk_9", "  ", None,
        "2024-01-01 10:00:00 7 INFO view:    ", "a b c d e: f: g", "x\n1 2 3 4 5: $1 \\ y"])]
    d = spark.createDataFrame(rows, "dataset string, line_id long, raw string")
    pp = frame_ops.preprocess(d, p.log_format, p.regexes)
    plan = frame_ops.distinct_lines(pp)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("blk_-") == 1 and plan.count("(.*?)") == len(T.compile_format(p.log_format)[2])
    _, pattern, groups = T.compile_format(p.log_format)
    line, rx = T.strip("raw"), T.py_regex(pattern)
    plain = F.when(line.rlike(rx), T.strip(F.regexp_extract(line, rx, groups["Content"]))).otherwise(line)
    want = {r.line_id: r.c for r in d.select("line_id", plain.alias("c")).collect() if r.c}
    assert len(want) == 5 and want == {r.line_id: r.content for r in pp.collect()}


def test_distinct_lines_keep_the_first_content(spark):
    rows = [("d", 3, "a", "a"), ("d", 1, "b", "a"), ("d", 2, "a", "a"), ("e", 5, "a", "a"), ("e", 6, "c", "a"), ("e", 7, None, "n"), ("e", 8, "n", "n")]
    d = spark.createDataFrame(rows, "dataset string, line_id long, content string, normalised string")
    got = {(r.dataset, r.normalised): (r.uniq_ord, r.content, r.freq) for r in frame_ops.distinct_lines(d).collect()}
    assert got == {("d", "a"): (1, "b", 3), ("e", "a"): (5, "a", 2), ("e", "n"): (7, None, 2)}


def test_variable_tokens_are_counted_as_one(spark):
    rows = [("d", "c", i, f"job {10000 + i} {'x' if i % 3 else 'y'} 0xab{i} 1.2.3.{i} ab12 12345a <{i}>") for i in range(30)]
    d = spark.createDataFrame(rows, "dataset string, cluster_id string, uniq_ord long, normalised string")
    plan = templates.position_stats(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("max_by") < plan.index("count(1)") < plan.index("0x[0-9a-fA-F]")  # the rule stands below the counting
    got = {r.pos: (r.total, r.best and (r.best.tok, r.best.cnt)) for r in templates.position_stats(d).collect()}
    assert got == {0: (30, ("job", 30)), 1: (30, None), 2: (30, ("x", 20)), 3: (30, None), 4: (30, None), 5: (30, ("ab12", 30)), 6: (30, None), 7: (30, None)}


def test_compaction_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(store, "PAIR_BLOCK", 7)
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), f"t{i}", rnd.randrange(40), [float(rnd.choice([-1, 0, 0.5, 1])) for _ in range(rnd.choice([3, 3, 3, 2]))]) for i in range(60)]
    rows += [("a", "n1", 50, None), ("a", "n2", 51, [1.0, None, 1.0]), ("a", "n3", 52, [1.0, math.nan, 1.0]), (None, "n4", 53, [1.0, 1.0, 1.0]), ("b", "n5", None, [1.0, 1.0, 1.0]), rows[0], rows[0]]
    d = spark.createDataFrame(rows, "dataset string, template_id string, store_ord long, centroid array<float>")
    a = d.select("dataset", F.col("template_id").alias("id_i"), F.col("store_ord").alias("ord_i"), F.col("centroid").alias("c_i"))
    b = d.select("dataset", F.col("template_id").alias("id_j"), F.col("store_ord").alias("ord_j"), F.col("centroid").alias("c_j"))
    want = a.join(b, "dataset").where("ord_i < ord_j").withColumn("sim", T.dot("c_i", "c_j")).where("sim >= 0.5")
    want = want.select("dataset", "id_i", "id_j", "ord_i", "ord_j", "sim")
    got = store.compaction_pairs(d, 0.5)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
