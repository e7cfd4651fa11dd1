import os

from pyspark.sql import functions as F

from logloom.operators import frame_ops
from logloom.sources import files


def test_raw_lines_keep_numbers_and_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n  \ntw\xff\xfeo\nthree")
    got = [(r.line_id, r.raw) for r in files.raw_lines(spark, str(tmp_path / "a.log"), "d").orderBy("line_id").collect()]
    assert got == [(1, "one"), (2, ""), (3, "  "), (4, "two"), (5, "three")]
    assert [(r.line_id, r.raw) for r in files.non_blank_lines(spark, str(tmp_path / "a.log")).orderBy("line_id").collect()] == [(1, "one"), (4, "two"), (5, "three")]


def test_split_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("d", "offline", 1, "r", "c", "n", False), ("d", "online", 2, "r2", "c,\n\"q\"", None, True), ("e", "offline", 1, "", "", "", False)],
                                  "dataset string, split string, line_id long, raw string, content string, normalised string, is_duplicate boolean")
    files.write_split(lines, str(tmp_path / "s"))
    key = lambda df: sorted(tuple(str(r[c]) for c in lines.columns) for r in df.collect())
    assert key(files.read_split(spark, str(tmp_path / "s"))) == key(lines)
    assert key(files.read_split(spark, str(tmp_path / "s"), "temporal")) == key(lines.where("split = 'offline'"))
    assert spark.read.json(str(tmp_path / "s" / "summary")).count() == 2
    part = lines.where("split = 'online'").select(*(c.split()[0] for c in files.SPLIT.split(", ")))
    part.write.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert [r.content for r in files.read_split_csv(spark, str(tmp_path / "csv")).collect()] == ["c,\n\"q\""]


def test_truth_without_events_goes(spark, tmp_path):
    os.makedirs(tmp_path / "t")
    (tmp_path / "t" / "x.csv").write_text('LineId,Extra,Content,EventId,EventTemplate\n1,z,"a, b",E1,a <*>\n2,z,c,,c\n')
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "t")).collect()] == [(1, "a, b", "E1", "a <*>")]


def test_store_round_trip(spark, tmp_path):
    rows = [("t1", "a <*>", [1.0, 0.0], 2, "s", "s", "parser", "d", 0), ("t2", "b", [0.0, 1.0], 1, "s", "s", "online", "d", 1), ("t1", "a <*> c", [0.5, 0.5], 7, "s", "s", "online", "d", 2)]
    store = spark.createDataFrame(rows, f"{files.STORE}, store_ord long")
    for form in ("parquet", "json"):
        files.write_store(store, str(tmp_path / form), form)
        assert files.read_store(spark, str(tmp_path / form), form).count() == 3
        last = files.read_store(spark, str(tmp_path / form), form, "last").orderBy("store_ord").collect()
        assert [(r.template_id, r.occurrences, list(r.centroid)) for r in last] == [("t2", 1, [0.0, 1.0]), ("t1", 7, [0.5, 0.5])]


def test_results_and_metrics(spark, tmp_path):
    metrics = spark.createDataFrame([("d", 1 / 3)], "dataset string, GA double")
    files.write_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "csv")).first()["GA"] == "0.333333"
    files.write_results(metrics, str(tmp_path / "r"), summary=metrics)
    assert spark.read.json(str(tmp_path / "r" / "summary")).count() == 1
    assert frame_ops.select_mode(metrics.withColumn("split", F.lit("online")), "temporal").count() == 0
