"""Readers for the provided parquet tables and the two log views built on them.

The provided tables hold no log files, so two fixed views adapt them:

* ``event_logs`` — one HDFS-style log line per ``events`` row, with a labelled
  ground truth (``EventId`` = event type, ``EventTemplate`` = its shape).
* ``doc_lines`` — ``documents.text`` split on newlines, blank lines dropped,
  one data set per language.

Both are plain projections (plus one ``posexplode``), so scans keep column
pruning and filter pushdown.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# FIXED VALUES — the content shape written for each event type, and its
# ground-truth template. Fields: u = user_id, e = event_id, k = the number in
# props, ip = 10.0.<u % 256>.<e % 256>:8080.
EVENT_SHAPES = {
    "signup": ("New account user_{u} registered from {ip} with blk_{e}",
               "New account user_<*> registered from <*> with blk_<*>"),
    "purchase": ("Order {e} paid by user {u} from {ip} blk_{e}",
                 "Order <*> paid by user <*> from <*> <*>"),
    "error": ("Failed to serve blk_{e} to {ip} after {k} retries",
              "Failed to serve <*> to <*> after <*> retries"),
    "view": ("Served page {k} to {ip} for blk_{e}",
             "Served page <*> to <*> for <*>"),
    "click": ("Served click {k} on item {u} from {ip}",
              "Served click <*> on item <*> from <*>"),
}
EVENT_PRESET = "HDFS"


def _shape_expr(shape: str, fields: dict) -> F.Column:
    parts, rest = [], shape
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if pre:
            parts.append(F.lit(pre))
        parts.append(fields[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dataset, line_id, raw, EventId, EventTemplate` — one line per event.

    raw = `<yyyy-MM-dd> <HH:mm:ss> <user_id> INFO <event_type>: <content>`,
    which the HDFS format parses with Content = the shaped message.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    u = F.col("user_id").cast("string")
    e = F.col("event_id").cast("string")
    fields = {
        "u": u, "e": e,
        "k": F.regexp_extract("props", r"(\d+)", 1),
        "ip": F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                       (F.col("event_id") % 256).cast("string"), F.lit(":8080")),
    }
    content = F.lit(None).cast("string")
    tmpl = F.lit(None).cast("string")
    for et, (shape, gt) in EVENT_SHAPES.items():
        content = F.when(F.col("event_type") == et, _shape_expr(shape, fields)).otherwise(content)
        tmpl = F.when(F.col("event_type") == et, F.lit(gt)).otherwise(tmpl)
    raw = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"),
                      u, F.lit("INFO"), F.concat(F.col("event_type"), F.lit(":")), content)
    return ev.select(
        F.lit("events").alias("dataset"),
        (F.col("event_id") + 1).alias("line_id"),
        raw.alias("raw"),
        F.col("event_type").alias("EventId"),
        tmpl.alias("EventTemplate"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dataset (=lang), line_id, doc_id, raw` — non-blank lines of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return (lines.where(T.strip(F.col("raw")) != "")
            .select(F.col("lang").alias("dataset"),
                    (F.col("doc_id") * 100000 + F.col("pos") + 1).alias("line_id"),
                    "doc_id", "raw"))


def unknown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from systems without a store: conversation turns split on newlines
    (non-blank, A2). `line_id = conv_id * 100000 + turn * 1000 + pos + 1`."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lines = conv.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return (lines.where(T.strip(F.col("raw")) != "")
            .select((F.col("conv_id") * 100000 + F.col("turn") * 1000 + F.col("pos") + 1)
                    .alias("line_id"), T.strip(F.col("raw")).alias("raw")))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`vec_id, embedding ARRAY<FLOAT>, label` — encoded lines with a cluster label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


# ------------------------------------------------------------- DuckDB views

def _sql_shape(shape: str, fields: dict) -> str:
    out, rest = [], shape
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if pre:
            out.append("'" + pre.replace("'", "''") + "'")
        out.append(fields[name])
    if rest:
        out.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(out)


def event_logs_sql() -> str:
    """The `event_logs` view in DuckDB SQL (same rows as `event_logs`)."""
    f = {"u": "CAST(user_id AS VARCHAR)", "e": "CAST(event_id AS VARCHAR)",
         "k": r"regexp_extract(props, '(\d+)', 1)",
         "ip": "'10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) || ':8080'"}
    content = "CASE " + " ".join(
        f"WHEN event_type = '{et}' THEN {_sql_shape(s, f)}" for et, (s, _) in EVENT_SHAPES.items()) + " END"
    tmpl = "CASE " + " ".join(
        f"WHEN event_type = '{et}' THEN '{g}'" for et, (_, g) in EVENT_SHAPES.items()) + " END"
    return (f"(SELECT 'events' AS dataset, event_id + 1 AS line_id, "
            f"strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') || ' ' || "
            f"CAST(user_id AS VARCHAR) || ' INFO ' || event_type || ': ' || ({content}) AS raw, "
            f"event_type AS EventId, {tmpl} AS EventTemplate FROM events)")


def doc_lines_sql() -> str:
    ws = T.WS_CLASS
    return (f"(SELECT lang AS dataset, doc_id * 100000 + pos AS line_id, doc_id, raw FROM "
            f"(SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) AS pos, "
            f"unnest(string_split(text, chr(10))) AS raw FROM documents) "
            f"WHERE NOT regexp_matches(raw, '^{ws}*$'))")


def unknown_lines_sql() -> str:
    """The same rows as `unknown_lines`."""
    ws = T.WS_CLASS
    return (f"(SELECT conv_id * 100000 + turn * 1000 + pos AS line_id, regexp_replace(raw, '^{ws}+|{ws}+$', '', 'g') AS raw FROM "
            f"(SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS pos, "
            f"unnest(string_split(text, chr(10))) AS raw FROM conversations) "
            f"WHERE NOT regexp_matches(raw, '^{ws}*$'))")
