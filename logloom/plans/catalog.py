"""Driver query catalogue: one Spark query per operator, plus DuckDB oracles.

Each query takes `(spark, sf_dir)` and reads the provided tables (or views
Spark derives from them), so its work grows with the data. `ORACLES` holds
the same computation in DuckDB SQL (tables pre-registered as views); queries
without an oracle are the iterative / order-dependent ones and are checked by
brute-force tests instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..functions import vectors as V
from ..operators import cluster as C
from ..operators import cross_search, frame_ops, match, metrics, store, templates
from ..sources import tables
from . import lineage
from . import sqlgen as S

HDFS = config.preset("HDFS")
HDFS_FMT = T.compile_format(HDFS.log_format)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- shared views

def events_pp(spark, sf) -> DataFrame:
    return frame_ops.preprocess(tables.event_logs(spark, sf), HDFS.log_format, HDFS.regexes)


def docs_pp(spark, sf) -> DataFrame:
    return frame_ops.preprocess(tables.doc_lines(spark, sf), None, HDFS.regexes)


_PAT = HDFS_FMT[1]
_CI = HDFS_FMT[2]["Content"]
EV_SQL = tables.event_logs_sql()
DOC_SQL = tables.doc_lines_sql()
_s = S.strip("raw")
EV_PP = (f"(SELECT *, {S.mask('content', HDFS.regexes)} AS normalised FROM "
         f"(SELECT dataset, line_id, raw, EventId, EventTemplate, CASE WHEN regexp_matches({_s}, {S.q(_PAT)}) "
         f"THEN {S.strip(f'regexp_extract({_s}, {S.q(_PAT)}, {_CI})')} ELSE {_s} END AS content FROM {EV_SQL}) "
         f"WHERE content <> '')")
DOC_PP = (f"(SELECT *, {S.mask('content', HDFS.regexes)} AS normalised FROM "
          f"(SELECT dataset, line_id, doc_id, raw, {_s} AS content FROM {DOC_SQL}) WHERE content <> '')")


def _distinct_sql(pp: str) -> str:
    return (f"(SELECT dataset, normalised, min(line_id) AS uniq_ord, arg_min(content, line_id) AS content, "
            f"count(*) AS freq FROM {pp} WHERE normalised IS NOT NULL AND normalised <> '' "
            f"GROUP BY dataset, normalised)")


# ------------------------------------------------------------ B1–B6: parsing

@query("parse_fields", f"""
SELECT line_id, regexp_extract({_s}, {S.q(_PAT)}, 1) AS Date, regexp_extract({_s}, {S.q(_PAT)}, 2) AS Time,
       regexp_extract({_s}, {S.q(_PAT)}, 3) AS Pid, regexp_extract({_s}, {S.q(_PAT)}, 4) AS Level,
       regexp_extract({_s}, {S.q(_PAT)}, 5) AS Component
FROM {EV_SQL} WHERE regexp_matches({_s}, {S.q(_PAT)})""")
def q_parse_fields(spark, sf):
    ev = tables.event_logs(spark, sf)
    f = T.parse_fields(F.col("raw"), HDFS.log_format)
    return ev.select("line_id", f.alias("f")).where(F.col("f").isNotNull()) \
        .select("line_id", "f.Date", "f.Time", "f.Pid", "f.Level", "f.Component")


@query("extract_content", f"SELECT line_id, content FROM {EV_PP}")
def q_extract_content(spark, sf):
    return events_pp(spark, sf).select("line_id", "content")


@query("mask_normalise", f"SELECT dataset, line_id, normalised FROM {EV_PP} UNION ALL "
                         f"SELECT dataset, line_id, normalised FROM {DOC_PP}")
def q_mask_normalise(spark, sf):
    return events_pp(spark, sf).select("dataset", "line_id", "normalised").unionByName(
        docs_pp(spark, sf).select("dataset", "line_id", "normalised"))


def _unknown_content_sql(x: str) -> str:
    out = S.strip(x)
    s = S.strip(x)
    for pat in map(S.unicode_words, reversed(config.UNKNOWN_HEADER_PATTERNS)):
        out = f"(CASE WHEN regexp_matches({s}, {S.q(pat)}) THEN {S.strip(f'regexp_extract({s}, {S.q(pat)}, 1)')} ELSE {out} END)"
    return out


def _unknown_mask_sql(x: str) -> str:
    out = x
    for rx, repl in config.UNKNOWN_MASKS:
        out = f"regexp_replace({out}, {S.q(rx)}, {S.q(repl)}, 'g')"
    return S.squeeze(out)


@query("unknown_mask", f"""
SELECT line_id, content, {_unknown_mask_sql('content')} AS normalised FROM
 (SELECT line_id, {_unknown_content_sql('raw')} AS content FROM {EV_SQL})""")
def q_unknown_mask(spark, sf):
    ev = tables.event_logs(spark, sf).select("line_id", T.unknown_content(F.col("raw")).alias("content"))
    return ev.withColumn("normalised", T.unknown_mask(F.col("content")))


def _ts_lines(spark, sf) -> DataFrame:
    """Timestamped lines derived from events; `view` events carry no millis, so
    the B6 filter drops them."""
    ev = tables.event_logs(spark, sf)
    e = tables.table(spark, sf, "events").select("event_id", "ts", "event_type")
    j = ev.join(e, ev.line_id == e.event_id + 1).select(
        "line_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                            F.when(F.col("event_type") != "view",
                                   F.concat(F.lit(","), (F.col("event_id") % 1000).cast("string"))).otherwise(F.lit("")),
                            F.lit(" INFO app."), F.col("event_type"), F.lit(": "),
                            F.substring_index(F.col("raw"), ": ", -1)).alias("line"))
    return j


@query("timestamped_messages", f"""
WITH l AS (SELECT ev.line_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S') ||
   CASE WHEN e.event_type <> 'view' THEN ',' || CAST(e.event_id % 1000 AS VARCHAR) ELSE '' END ||
   ' INFO app.' || e.event_type || ': ' || regexp_extract(ev.raw, '^.*: (.*)$', 1) AS line
   FROM {EV_SQL} ev JOIN events e ON ev.line_id = e.event_id + 1)
SELECT line_id, {S.strip(f"regexp_extract(line, {S.q(config.TIMESTAMPED_LINE)}, 1)")} AS message FROM l
WHERE regexp_matches(line, {S.q(config.TIMESTAMPED_LINE)})""")
def q_timestamped(spark, sf):
    l = _ts_lines(spark, sf)
    return l.select("line_id", T.timestamped_message(F.col("line")).alias("message")).where(F.col("message").isNotNull())


# ------------------------------------------------------------ DS1–DS7

@query("duplicate_tag", f"""
SELECT dataset, line_id, line_id <> min(line_id) OVER (PARTITION BY dataset, normalised) AS is_duplicate
FROM {DOC_PP}""")
def q_duplicate_tag(spark, sf):
    return frame_ops.tag_duplicates(docs_pp(spark, sf)).select("dataset", "line_id", "is_duplicate")


@query("distinct_lines", f"SELECT dataset, normalised, uniq_ord, content, freq FROM {_distinct_sql(DOC_PP)}")
def q_distinct_lines(spark, sf):
    return frame_ops.distinct_lines(docs_pp(spark, sf)).select("dataset", "normalised", "uniq_ord", "content", "freq")


_SPLIT_SQL = f"""(SELECT dataset, line_id, normalised, pos,
  CASE WHEN pos < floor(n * CAST({config.SPLIT_RATIO} AS DOUBLE)) THEN 'offline' ELSE 'online' END AS split FROM
  (SELECT dataset, line_id, normalised, row_number() OVER (PARTITION BY dataset ORDER BY line_id) - 1 AS pos,
          count(*) OVER (PARTITION BY dataset) AS n FROM {DOC_PP}))"""


@query("ordered_split", f"SELECT dataset, line_id, pos, split FROM {_SPLIT_SQL}")
def q_ordered_split(spark, sf):
    return frame_ops.ordered_split(docs_pp(spark, sf)).select("dataset", "line_id", "pos", "split")


@query("split_summary", f"""
SELECT dataset, count(*) AS total_logs, sum(CASE WHEN split = 'offline' THEN 1 ELSE 0 END) AS offline_logs,
  sum(CASE WHEN split = 'online' THEN 1 ELSE 0 END) AS online_logs,
  count(DISTINCT CASE WHEN split = 'offline' THEN normalised END) AS unique_offline,
  CAST({config.SPLIT_RATIO} AS DOUBLE) AS split_ratio FROM {_SPLIT_SQL} GROUP BY dataset""")
def q_split_summary(spark, sf):
    return frame_ops.split_summary(frame_ops.ordered_split(docs_pp(spark, sf)))


@query("seeded_sample", f"""
SELECT dataset, line_id, normalised FROM (SELECT *, row_number() OVER (PARTITION BY dataset
  ORDER BY md5('42|' || CAST(line_id AS VARCHAR)), line_id) AS r FROM {DOC_PP}) WHERE r <= 50""")
def q_seeded_sample(spark, sf):
    return frame_ops.seeded_sample(docs_pp(spark, sf), 50, 42).select("dataset", "line_id", "normalised")


# ------------------------------------------------------------ B8–B14, B20, B21

@query("partition_keys", f"""
SELECT dataset, normalised, {S.first_keyword('normalised')} AS first_kw,
       {S.partition_key('normalised', 'dataset')} AS pkey FROM {_distinct_sql(DOC_PP)}""")
def q_partition_keys(spark, sf):
    d = frame_ops.distinct_lines(docs_pp(spark, sf))
    return d.select("dataset", "normalised", T.first_keyword(F.col("normalised")).alias("first_kw"),
                    T.partition_key(F.col("normalised"), F.col("dataset")).alias("pkey"))


@query("variable_tokens", f"""
SELECT dataset, line_id, len({S.tokens('content')}) AS n_tokens,
  len(list_filter({S.tokens('content')}, lambda t: {S.is_variable('t')})) AS n_var FROM {DOC_PP}""")
def q_variable_tokens(spark, sf):
    d = docs_pp(spark, sf)
    toks = T.tokens(F.col("content"))
    return d.select("dataset", "line_id", F.size(toks).alias("n_tokens"),
                    F.size(F.filter(toks, T.is_variable)).alias("n_var"))


@query("collapse_wildcards", f"""
SELECT dataset, normalised, {S.collapse_string(S.tokens('normalised'))} AS collapsed,
       {S.scoring_form('normalised')} AS scoring FROM {_distinct_sql(EV_PP)}""")
def q_collapse(spark, sf):
    d = frame_ops.distinct_lines(events_pp(spark, sf))
    return d.select("dataset", "normalised", T.collapse_string(T.tokens(F.col("normalised"))).alias("collapsed"),
                    T.scoring_form(F.col("normalised")).alias("scoring"))


@query("single_templates", f"""
SELECT dataset, line_id, {S.single_template('normalised', 'content')} AS template,
       {S.single_template('normalised', 'content', online=True)} AS online_template,
       {S.template_id(S.single_template('normalised', 'content'))} AS template_id FROM {DOC_PP}""")
def q_single_templates(spark, sf):
    d = docs_pp(spark, sf)
    d = d.withColumn("tok", T.once(T.tokens("normalised"))).withColumn("raw_tok", T.once(T.tokens("content")))
    d = d.withColumn("template", T.once(T.token_template("tok", "raw_tok")))
    return d.select("dataset", "line_id", "template",
                    T.token_template("tok", "raw_tok", online=True).alias("online_template"),
                    T.template_id("template").alias("template_id"))


# ------------------------------------------------------------ T1–T4: voting

def _vote_sql(pp: str, tau: float, prefixes: bool = True, no_prefix_variant: bool = False) -> str:
    """Minimum slice in SQL: distinct lines, partition key as the cluster, voting."""
    thr = max(tau, config.VOTE_FLOOR)
    d = _distinct_sql(pp)
    cl = f"(SELECT *, {S.partition_key('normalised', 'dataset')} AS cluster_id FROM {d})"
    sizes = f"(SELECT dataset, cluster_id, count(*) AS n_lines, min(uniq_ord) AS store_ord FROM {cl} GROUP BY ALL)"
    wn = f"(SELECT c.*, s.n_lines, s.store_ord FROM {cl} c JOIN {sizes} s USING (dataset, cluster_id))"
    if no_prefix_variant:
        single = f"SELECT dataset, cluster_id, normalised AS template, n_lines, store_ord FROM {wn} WHERE n_lines = 1"
    else:
        single = (f"SELECT dataset, cluster_id, {S.single_template('normalised', 'content')} AS template, n_lines, "
                  f"store_ord FROM {wn} WHERE n_lines = 1")
    ex = (f"(SELECT dataset, cluster_id, uniq_ord, n_lines, unnest(generate_series(0, len(tk) - 1)) AS pos, "
          f"unnest(tk) AS tok FROM (SELECT *, {S.tokens('normalised')} AS tk FROM {wn} WHERE n_lines > 1))")
    cnt = (f"(SELECT dataset, cluster_id, pos, tok, count(*) AS cnt, min(uniq_ord) AS first_ord, "
           f"any_value(n_lines) AS n_lines FROM {ex} GROUP BY ALL)")
    if no_prefix_variant:
        per = (f"(SELECT dataset, cluster_id, pos, arg_max(tok, (cnt, -first_ord)) AS btok, "
               f"max((cnt, -first_ord))[1] AS bcnt, any_value(n_lines) AS n_lines FROM {cnt} GROUP BY ALL)")
        voted = (f"(SELECT dataset, cluster_id, pos, CASE WHEN bcnt / n_lines >= {thr} THEN btok ELSE '<*>' END AS tok "
                 f"FROM {per})")
    else:
        per = (f"(SELECT dataset, cluster_id, pos, sum(cnt) AS total, "
               f"arg_max(tok, (cnt, -first_ord)) FILTER (WHERE NOT {S.is_variable('tok')}) AS btok, "
               f"max((cnt, -first_ord)) FILTER (WHERE NOT {S.is_variable('tok')}) AS bkey FROM {cnt} GROUP BY ALL)")
        voted = (f"(SELECT dataset, cluster_id, pos, CASE WHEN btok IS NULL THEN '<*>' "
                 f"WHEN bkey[1] / total >= {thr} THEN btok ELSE '<*>' END AS voted FROM {per})")
        if prefixes:
            rx = (f"(SELECT dataset, cluster_id, unnest(generate_series(0, len(rt) - 1)) AS pos, unnest(rt) AS rtok "
                  f"FROM (SELECT *, {S.tokens('content')} AS rt FROM {wn} WHERE n_lines > 1))")
            pf = (f"(SELECT dataset, cluster_id, pos, min(p) AS pmin, max(p) AS pmax FROM "
                  f"(SELECT dataset, cluster_id, pos, {S.raw_prefix('rtok')} AS p FROM {rx}) WHERE p <> '' GROUP BY ALL)")
            voted = (f"(SELECT v.dataset, v.cluster_id, v.pos, CASE WHEN v.voted = '<*>' AND pf.pmin IS NOT NULL "
                     f"AND pf.pmin = pf.pmax THEN pf.pmin || '<*>' ELSE v.voted END AS tok FROM {voted} v "
                     f"LEFT JOIN {pf} pf USING (dataset, cluster_id, pos))")
        else:
            voted = f"(SELECT dataset, cluster_id, pos, voted AS tok FROM {voted})"
    lst = "list(tok ORDER BY pos)"
    col = (f"array_to_string({S.collapse('l')}, ' ')" if no_prefix_variant else S.collapse_string("l"))
    many = (f"SELECT a.dataset, a.cluster_id, {col} AS template, s.n_lines, s.store_ord FROM "
            f"(SELECT dataset, cluster_id, {lst} AS l FROM {voted} GROUP BY ALL) a JOIN {sizes} s USING (dataset, cluster_id)")
    return f"({single} UNION ALL {many})"


def _slice_clusters(spark, sf, pp_fn=events_pp, kept=True):
    """The distinct lines and their keyword clusters; written once (`kept`) where sizes, voting and a lookup all read them."""
    d = frame_ops.distinct_lines(pp_fn(spark, sf))
    d = d.withColumn("cluster_id", T.partition_key(F.col("normalised"), F.col("dataset")))
    return lineage.stored(d) if kept else d


_SLICE_T = config.preset("HDFS").tau


@query("vote_templates", f"SELECT dataset, cluster_id, template, {S.template_id('template')} AS template_id, "
                         f"n_lines, store_ord FROM {_vote_sql(EV_PP, _SLICE_T)} UNION ALL "
                         f"SELECT dataset, cluster_id, template, {S.template_id('template')} AS template_id, "
                         f"n_lines, store_ord FROM {_vote_sql(DOC_PP, 0.5)}")
def q_vote_templates(spark, sf):
    a = templates.extract_templates(_slice_clusters(spark, sf), _SLICE_T)
    b = templates.extract_templates(_slice_clusters(spark, sf, docs_pp), 0.5)
    return a.unionByName(b).withColumn("template_id", T.template_id("template")) \
        .select("dataset", "cluster_id", "template", "template_id", "n_lines", "store_ord")


@query("vote_templates_no_prefix", f"SELECT dataset, cluster_id, template, n_lines, store_ord FROM "
                                   f"{_vote_sql(DOC_PP, 0.5, no_prefix_variant=True)}")
def q_vote_no_prefix(spark, sf):
    return templates.extract_templates_no_prefix(_slice_clusters(spark, sf, docs_pp, kept=False), 0.5) \
        .select("dataset", "cluster_id", "template", "n_lines", "store_ord")


@query("positional_variance", """
WITH ex AS (SELECT label, vec_id, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding) AS v
            FROM embeddings),
w AS (SELECT label, pos, CASE WHEN v >= 0 THEN 'p' ELSE 'n' END AS word, v, vec_id FROM ex),
st AS (SELECT label, pos, count(*) AS n_words, var_pop(v) AS var, count(v) AS n_att FROM w GROUP BY ALL),
wc AS (SELECT label, pos, word, count(*) AS cnt, min(vec_id) AS first_ord FROM w GROUP BY ALL),
best AS (SELECT label, pos, arg_max(word, (cnt, -first_ord)) AS bw, max((cnt, -first_ord))[1] AS bc FROM wc GROUP BY ALL),
tok AS (SELECT st.label, st.pos, CASE WHEN st.n_att = 0 OR st.var > 0.01 THEN '<*>'
               WHEN best.bc / st.n_words >= 0.5 THEN best.bw ELSE '<*>' END AS tok
        FROM st JOIN best USING (label, pos))
SELECT CAST(label AS VARCHAR) AS cluster_id, """ + S.collapse_string("list(tok ORDER BY pos)") + """ AS template
FROM tok GROUP BY label""")
def q_positional_variance(spark, sf):
    e = tables.embedding_vectors(spark, sf)
    rows = e.select(F.lit("emb").alias("dataset"), F.col("label").cast("string").alias("cluster_id"),
                    F.col("vec_id").alias("uniq_ord"),
                    F.transform("embedding", lambda x: F.when(x >= 0, "p").otherwise("n")).alias("words"),
                    F.concat(F.array(F.lit(0.0)), F.transform("embedding", lambda x: x.cast("double"))).alias("attention"))
    return templates.attention_templates(rows, 0.5, 0.01).select("cluster_id", "template")


# ------------------------------------------------------------ C3, G1, E4

_HASHED_SQL = f"""
WITH d AS {_distinct_sql(DOC_PP)},
t AS (SELECT dataset, normalised, unnest({S.tokens('normalised')}) AS tok FROM d),
h AS (SELECT dataset, normalised, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS h FROM t),
b AS (SELECT dataset, normalised, h % 64 AS bucket,
             sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY ALL),
n AS (SELECT dataset, normalised, sqrt(sum(v * v)) AS nrm FROM b GROUP BY ALL),
g AS (SELECT d.dataset, d.normalised, r.range AS bucket FROM d CROSS JOIN range(64) r)
SELECT g.dataset, g.normalised, list(round(CASE WHEN n.nrm > 0 THEN coalesce(b.v, 0) / n.nrm ELSE 0.0 END, 4)
  ORDER BY g.bucket) AS embedding
FROM g LEFT JOIN b USING (dataset, normalised, bucket) LEFT JOIN n USING (dataset, normalised) GROUP BY ALL"""


@query("hashed_embedding", _HASHED_SQL)
def q_hashed_embedding(spark, sf):
    d = frame_ops.distinct_lines(docs_pp(spark, sf))
    e = V.hashed_embedding(F.col("normalised"))
    return d.select("dataset", "normalised", F.transform(e, lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query("cached_embedding", _HASHED_SQL)
def q_cached_embedding(spark, sf):
    """A plugged-in encoder behind the table of kept vectors: the offline lines are
    encoded by a first run, the second run over all lines adds what is left."""
    from ..streaming.feed import scratch
    lines, path = docs_pp(spark, sf), scratch(spark, "vectors")
    encoder = V.encode_with(V.hashing_encoder)
    offline = frame_ops.ordered_split(lines).where(F.col("split") == "offline").drop("split", "pos")
    V.kept_encode(frame_ops.distinct_lines(offline), path, "hashed-64", encoder=encoder)
    d = V.kept_encode(frame_ops.distinct_lines(lines), path, "hashed-64", encoder=encoder)
    return d.select("dataset", "normalised", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query("label_centroids", """
WITH ex AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding) AS v FROM embeddings),
m2 AS (SELECT label, list(a ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS a FROM ex GROUP BY ALL) GROUP BY label)
SELECT label, list_transform(c, lambda x: round(x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8), 4))
  AS centroid FROM m2""")
def q_label_centroids(spark, sf):
    c = store.centroids(tables.embedding_vectors(spark, sf), ["label"])
    return c.select("label", F.transform("centroid", lambda x: F.round(x.cast("double"), 4)).alias("centroid"))


_CUTS_SQL = """(SELECT vec_id, 0 AS cut, label AS lab FROM embeddings UNION ALL
 SELECT vec_id, 1, label % 5 FROM embeddings UNION ALL SELECT vec_id, 2, label % 2 FROM embeddings UNION ALL
 SELECT vec_id, 3, vec_id % 97 FROM embeddings UNION ALL SELECT vec_id, 4, CAST(vec_id % 3 = 0 AS INT) FROM embeddings)"""


@query("cut_quality", f"""
WITH c AS {_CUTS_SQL}, n AS (SELECT count(*) AS n FROM embeddings),
sz AS (SELECT cut, lab, count(*) AS sz FROM c GROUP BY ALL),
per AS (SELECT cut, count(*) AS k, max(sz) AS mx, sum(CASE WHEN sz = 1 THEN 1 ELSE 0 END) AS ns FROM sz GROUP BY cut)
SELECT cut, k, round(CASE WHEN mx / n > 0.6 THEN -1000.0 ELSE ln(1 + k) - 2.0 * ns / k - 5.0 * mx / n END, 4) AS score
FROM per, n""")
def q_cut_quality(spark, sf):
    e = tables.embedding_vectors(spark, sf)
    cuts = None
    for i, lab in enumerate([F.col("label"), F.col("label") % 5, F.col("label") % 2, F.col("vec_id") % 97,
                             (F.col("vec_id") % 3 == 0).cast("int")]):
        c = e.select(F.lit("all").alias("gid"), F.col("vec_id").alias("uniq_ord"), F.lit(i).alias("cut"),
                     F.lit(0.0).alias("thr"), lab.cast("long").alias("label"))
        cuts = c if cuts is None else cuts.unionByName(c)
    lines = e.select(F.lit("all").alias("gid"), F.col("vec_id").alias("uniq_ord"), F.lit(1).cast("long").alias("freq"))
    sizes = lines.groupBy("gid").agg(F.count(F.lit(1)).alias("g_n"), F.sum("freq").alias("g_freq"))
    sc = C.cut_scores(cuts, lines.join(sizes, "gid"))
    return sc.select("cut", "k", F.round("score", 4).alias("score"))


# ------------------------------------------------------------ E1–E10, G2, G7, G8 (rows-only)

def _embedded_distinct(spark, sf, pp_fn=events_pp):
    d = frame_ops.distinct_lines(pp_fn(spark, sf))
    return V.encode_lines(d, "normalised")


def _clusters(spark, sf, **kw):
    e = C.assign_partition_keys(_embedded_distinct(spark, sf), keyword_stage=kw.pop("keyword_stage", True))
    return C.cluster_lines(e, **kw).select("dataset", "normalised", "uniq_ord", "cluster_id", "cut_thr")


@query("two_stage_clusters")
def q_two_stage(spark, sf):
    return _clusters(spark, sf, dist=HDFS.dist, method="two_stage")


@query("freq_clusters")
def q_freq(spark, sf):
    return _clusters(spark, sf, dist=HDFS.dist, method="two_stage", score="frequency")


@query("single_stage_clusters")
def q_single_stage(spark, sf):
    return _clusters(spark, sf, dist=HDFS.dist, method="single_stage", keyword_stage=False)


@query("adaptive_clusters")
def q_adaptive(spark, sf):
    return _clusters(spark, sf, dist=0.2, method="adaptive", keyword_stage=False, linkage="complete")


@query("exact_k")
def q_exact_k(spark, sf):
    e = tables.embedding_vectors(spark, sf).select(
        F.lit("emb").alias("dataset"), F.lit("").alias("pkey"), F.col("vec_id").alias("uniq_ord"), "embedding")
    return C.cluster_lines(e, n_clusters=10).select("uniq_ord", "cluster_id")


def events_store(spark, sf, variant="default", embedded=None):
    pp = events_pp(spark, sf)
    params = spark.createDataFrame([("events", HDFS.dist, HDFS.tau)], "dataset string, dist double, tau double")
    return store.build_store(pp, params, variant=variant, as_of="2024-01-01 00:00:00", embedded=embedded)


@query("build_store")
def q_build_store(spark, sf):
    return events_store(spark, sf).drop("centroid")


@query("build_store_ablation")
def q_build_ablation(spark, sf):
    out, embedded = None, lineage.stored(_embedded_distinct(spark, sf))  # parsed and encoded once for all variants
    for v in ("fixed_distance", "no_keyword", "no_prefix"):
        s = events_store(spark, sf, v, embedded).select(F.lit(v).alias("variant"), "dataset", "template_id", "template", "occurrences")
        out = s if out is None else out.unionByName(s)
    return out


@query("store_summary")
def q_store_summary(spark, sf):
    pp = events_pp(spark, sf)
    params = spark.createDataFrame([("events", HDFS.dist, HDFS.tau)], "dataset string, dist double, tau double")
    return store.build_summary(pp, events_store(spark, sf), params)


# ------------------------------------------------------------ G3–G6 on a label store

def label_store(spark, sf) -> DataFrame:
    """A store with one entry per embedding label (template `cluster <label> <*>`)."""
    e = tables.embedding_vectors(spark, sf)
    c = store.centroids(e, ["label"])
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("occurrences"))
    tmpl = F.concat(F.lit("cluster "), F.col("label").cast("string"), F.lit(" <*>"))
    return c.join(n, "label").select(
        F.lit("emb").alias("dataset"), T.template_id(tmpl).alias("template_id"), tmpl.alias("template"),
        "centroid", F.col("occurrences").cast("long"), F.lit("2024-01-01").cast("timestamp").alias("first_seen"),
        F.lit("2024-01-01").cast("timestamp").alias("last_seen"), F.lit("parser").alias("source"),
        F.col("label").cast("long").alias("store_ord"))


_LABEL_STORE_SQL = """(WITH ex AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding) AS v FROM embeddings),
m AS (SELECT label, list(a ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS a FROM ex GROUP BY ALL) GROUP BY label)
SELECT 'emb' AS dataset, substr(md5('cluster ' || CAST(label AS VARCHAR) || ' <*>'), 1, 8) AS template_id,
  'cluster ' || CAST(label AS VARCHAR) || ' <*>' AS template,
  list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8)) AS centroid,
  label AS store_ord FROM m)"""


@query("topk_cosine", f"""
SELECT vec_id, rank, template_id, round(score, 4) AS score FROM (
 SELECT e.vec_id, s.template_id, {S.dot('e.embedding', 's.centroid')} AS score,
   row_number() OVER (PARTITION BY e.vec_id ORDER BY {S.dot('e.embedding', 's.centroid')} DESC, s.store_ord) AS rank
 FROM embeddings e CROSS JOIN {_LABEL_STORE_SQL} s) WHERE rank <= 3""")
def q_topk_cosine(spark, sf):
    e = tables.embedding_vectors(spark, sf).select(F.lit("emb").alias("dataset"), F.col("vec_id").alias("line_id"), "embedding")
    r = match.topk(e, label_store(spark, sf), 3)
    return r.select(F.col("line_id").alias("vec_id"), "rank", "template_id", F.round("score", 4).alias("score"))


@query("topk_matmul")
def q_topk_matmul(spark, sf):
    e = tables.embedding_vectors(spark, sf).select(F.lit("emb").alias("dataset"), F.col("vec_id").alias("line_id"), "embedding")
    r = match.topk_matmul(e, label_store(spark, sf), 3)
    return r.select(F.col("line_id").alias("vec_id"), "rank", "template_id", F.round("score", 4).alias("score"))


def _folded_sql(starts: str, steps: str) -> str:
    """Centroids after the ordered fold: `starts` (id, o, c), `steps` (id, k from 1, n, v)."""
    blended = "list_transform(list_zip(f.c, h.v), lambda p: p[2] / (f.o + h.n + 1) + p[1] * (1 - 1 / (f.o + h.n + 1)))"
    return f"""
f AS (SELECT id, 0 AS k, CAST(o AS DOUBLE) AS o, c FROM {starts} UNION ALL
  SELECT id, k, o, list_transform(u, lambda x: x / (sqrt(list_sum(list_transform(u, lambda y: y * y))) + 1e-8))
  FROM (SELECT f.id, h.k, f.o + h.n AS o, {blended} AS u FROM f JOIN {steps} h ON h.id = f.id AND h.k = f.k + 1)),
folded AS (SELECT id, o, list_transform(c, lambda x: round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3)) AS centroid
  FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)"""


@query("store_hits", f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT label AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, 1 AS n,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS MATERIALIZED (SELECT st.store_ord AS id, st.template_id, e.n AS o, list_transform(st.centroid, lambda x: CAST(x AS DOUBLE)) AS c
  FROM {_LABEL_STORE_SQL} st JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e ON e.label = st.store_ord),
{_folded_sql('s', 'h')}
SELECT s.template_id, CAST(folded.o AS BIGINT) AS occurrences, folded.centroid FROM s JOIN folded USING (id)""")
def q_store_hits(spark, sf):
    e = tables.embedding_vectors(spark, sf)
    st = label_store(spark, sf)
    hits = e.select(F.lit("emb").alias("dataset"),
                    T.template_id(F.concat(F.lit("cluster "), F.col("label").cast("string"), F.lit(" <*>"))).alias("template_id"),
                    F.col("vec_id").alias("line_id"), F.col("embedding").alias("vector"))
    out = store.apply_hits(st, hits, as_of="2024-01-02")
    return out.select("template_id", "occurrences", F.transform("centroid", lambda x: F.round(x.cast("double"), 3)).alias("centroid"))


@query("store_upsert", f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT label + vec_id % 3 AS id, row_number() OVER (PARTITION BY label + vec_id % 3 ORDER BY vec_id) AS j, 1 AS n,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS MATERIALIZED (SELECT st.store_ord AS id, n AS o, list_transform(st.centroid, lambda x: CAST(x AS DOUBLE)) AS c
  FROM {_LABEL_STORE_SQL} st JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) x ON x.label = st.store_ord),
s AS MATERIALIZED (SELECT id, o, c FROM e UNION ALL SELECT id, n, v FROM d WHERE j = 1 AND id NOT IN (SELECT id FROM e)),
h AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY j) AS k, n, v FROM d WHERE j > 1 OR id IN (SELECT id FROM e)),
{_folded_sql('s', 'h')}
SELECT substr(md5('cluster ' || CAST(id AS VARCHAR) || ' <*>'), 1, 8) AS template_id, 'cluster ' || CAST(id AS VARCHAR) || ' <*>' AS template,
  CAST(o AS BIGINT) AS occurrences, CASE WHEN id IN (SELECT id FROM e) THEN 'parser' ELSE 'online' END AS source, centroid FROM folded""")
def q_store_upsert(spark, sf):
    st = label_store(spark, sf)
    e = tables.embedding_vectors(spark, sf)
    delta = e.select(
        F.lit("emb").alias("dataset"),
        F.concat(F.lit("cluster "), (F.col("label") + F.col("vec_id") % 3).cast("string"), F.lit(" <*>")).alias("template"),
        F.col("embedding").alias("centroid"), F.lit(1).alias("count"), F.lit("online").alias("source"),
        F.col("vec_id").alias("line_id"))
    out = store.upsert(st, delta, as_of="2024-01-02")
    return out.select("template_id", "template", "occurrences", "source",
                      F.transform("centroid", lambda x: F.round(x.cast("double"), 3)).alias("centroid"))


@query("keyword_lookup", f"""
WITH st AS (SELECT * FROM {_vote_sql(EV_PP, _SLICE_T)}),
kw AS (SELECT DISTINCT dataset, {S.first_keyword('normalised')} AS keyword FROM {EV_PP})
SELECT st.dataset, kw.keyword, st.template FROM st JOIN kw ON st.dataset = kw.dataset AND
  coalesce(lower(list_filter({S.tokens('st.template')}, lambda t: t <> '<*>')[1]), '') = kw.keyword""")
def q_keyword_lookup(spark, sf):
    st = templates.extract_templates(_slice_clusters(spark, sf), _SLICE_T)
    kws = events_pp(spark, sf).select("dataset", T.first_keyword(F.col("normalised")).alias("keyword")).distinct()
    j = store.keyword_lookup(st, kws)
    return j.select("dataset", F.col("first_fixed_kw").alias("keyword"), "template")


@query("compaction_pairs", f"""
WITH s AS (SELECT 'emb' AS dataset, vec_id AS ord, embedding AS c FROM embeddings)
SELECT a.ord AS ord_i, b.ord AS ord_j, round({S.dot('a.c', 'b.c')}, 4) AS sim FROM s a JOIN s b
  ON a.dataset = b.dataset AND a.ord < b.ord WHERE {S.dot('a.c', 'b.c')} >= 0.4""")
def q_compaction_pairs(spark, sf):
    e = tables.embedding_vectors(spark, sf).select(
        F.lit("emb").alias("dataset"), F.col("vec_id").cast("string").alias("template_id"),
        F.col("vec_id").alias("store_ord"), F.col("embedding").alias("centroid"))
    p = store.compaction_pairs(e, 0.4)
    return p.select("ord_i", "ord_j", F.round("sim", 4).alias("sim"))


@query("compact_store")
def q_compact_store(spark, sf):
    e = tables.embedding_vectors(spark, sf).select(
        F.lit("emb").alias("dataset"), F.col("vec_id").cast("string").alias("template_id"),
        F.lit("t").alias("template"), F.col("embedding").alias("centroid"), F.lit(1).cast("long").alias("occurrences"),
        F.col("vec_id").alias("store_ord"))
    return store.compact(e, capacity=10, thr=0.4).select("template_id", "occurrences")


ORACLES["topk_matmul"] = ORACLES["topk_cosine"]


# ------------------------------------------------------------ slice store, R2–R8, I1–I10

def slice_store(spark, sf, pp_fn=events_pp, tau=_SLICE_T) -> DataFrame:
    """Store from the minimum slice: keyword clusters, voted templates and the
    centroids of the clusters' hashed line vectors."""
    cl = _slice_clusters(spark, sf, pp_fn)
    tm = templates.extract_templates(cl, tau)
    enc = V.encode_lines(cl, "normalised")
    cents = store.centroids(enc, ["dataset", "cluster_id"])
    return tm.join(cents, ["dataset", "cluster_id"]).select(
        "dataset", T.template_id("template").alias("template_id"), "template", "centroid",
        F.col("n_lines").cast("long").alias("occurrences"), F.lit("parser").alias("source"), "store_ord", "cluster_id")


def slice_predictions(spark, sf) -> DataFrame:
    """Every event line with its truth and its slice cluster/template."""
    pp = events_pp(spark, sf)
    cl = _slice_clusters(spark, sf)
    tm = templates.extract_templates(cl, _SLICE_T)
    r = match.template_lookup(pp, cl, tm)
    return r.select("dataset", "line_id", "content", "normalised", F.col("EventId").alias("gt_id"),
                    F.col("EventTemplate").alias("gt_template"), F.col("cluster_id").alias("pred_id"),
                    F.col("template").alias("pred_template"))


_SLICE_PRED_SQL = f"""(SELECT p.dataset, p.line_id, p.content, p.normalised, p.EventId AS gt_id,
  p.EventTemplate AS gt_template, {S.partition_key('p.normalised', 'p.dataset')} AS pred_id,
  coalesce(v.template, '<*>') AS pred_template
  FROM {EV_PP} p LEFT JOIN {_vote_sql(EV_PP, _SLICE_T)} v
  ON v.dataset = p.dataset AND v.cluster_id = {S.partition_key('p.normalised', 'p.dataset')})"""


@query("template_lookup", f"SELECT dataset, line_id, pred_id, pred_template FROM {_SLICE_PRED_SQL}")
def q_template_lookup(spark, sf):
    return slice_predictions(spark, sf).select("dataset", "line_id", "pred_id", "pred_template")


@query("gt_join", f"""SELECT p.line_id, p.pred_template, g.EventId FROM {_SLICE_PRED_SQL} p
  JOIN (SELECT line_id, EventId FROM {EV_SQL} WHERE line_id % 7 <> 0) g ON p.line_id = g.line_id""")
def q_gt_join(spark, sf):
    """Inner join of predictions with a truth table that lacks some lines."""
    gt = tables.event_logs(spark, sf).select("line_id", "EventId").where(F.col("line_id") % 7 != 0)
    return match.ground_truth_join(slice_predictions(spark, sf).select("line_id", "pred_template"), gt)


@query("missing_default", f"""SELECT p.line_id, coalesce(g.EventId, 'MISSING_' || CAST(p.line_id AS VARCHAR)) AS EventId
  FROM {_SLICE_PRED_SQL} p LEFT JOIN (SELECT line_id, EventId FROM {EV_SQL} WHERE line_id % 7 <> 0) g
  ON p.line_id = g.line_id""")
def q_missing_default(spark, sf):
    gt = tables.event_logs(spark, sf).select("line_id", "EventId").where(F.col("line_id") % 7 != 0)
    return match.missing_default(slice_predictions(spark, sf).select("line_id"), gt)


def _ga_sql(src: str) -> str:
    return f"""(WITH c AS (SELECT dataset, gt_id, pred_id, count(*) AS n FROM {src} GROUP BY ALL),
 g AS (SELECT dataset, gt_id, sum(n) AS ng FROM c GROUP BY ALL),
 p AS (SELECT dataset, pred_id, sum(n) AS np FROM c GROUP BY ALL),
 x AS (SELECT c.*, (c.n = g.ng AND c.n = p.np) AS exact FROM c JOIN g USING (dataset, gt_id) JOIN p USING (dataset, pred_id)),
 s AS (SELECT dataset, sum(n) AS N, sum(CASE WHEN exact THEN n ELSE 0 END) AS ok,
          sum(CASE WHEN exact THEN 1 ELSE 0 END) AS pairs, count(DISTINCT gt_id) AS ngt, count(DISTINCT pred_id) AS npd
       FROM x GROUP BY dataset)
 SELECT dataset, ok / N AS GA, CASE WHEN pairs / greatest(npd, 1) + pairs / greatest(ngt, 1) > 0 THEN
   2 * (pairs / greatest(npd, 1)) * (pairs / greatest(ngt, 1)) / (pairs / greatest(npd, 1) + pairs / greatest(ngt, 1))
   ELSE 0.0 END AS FGA FROM s)"""


def _fta_sql(src: str) -> str:
    return f"""(WITH d AS (SELECT *, {S.scoring_form('gt_template')} AS g, {S.scoring_form('pred_template')} AS p FROM {src}),
 v AS (SELECT dataset, pred_id, g, count(*) AS c, min(line_id) AS f FROM d GROUP BY ALL),
 m AS (SELECT dataset, pred_id, arg_max(g, (c, -f)) AS maj FROM v GROUP BY ALL),
 l AS (SELECT dataset, pred_id, arg_max(p, line_id) AS lp FROM d GROUP BY ALL),
 k AS (SELECT m.dataset, m.pred_id, m.maj, m.maj = l.lp AS ok FROM m JOIN l USING (dataset, pred_id)),
 s AS (SELECT dataset, count(*) AS npg, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS nok,
          count(DISTINCT CASE WHEN ok THEN maj END) AS nokt FROM k GROUP BY dataset),
 u AS (SELECT dataset, count(DISTINCT g) AS nt FROM d GROUP BY dataset)
 SELECT dataset, CASE WHEN nok / greatest(npg, 1) + nokt / greatest(nt, 1) > 0 THEN
   2 * (nok / greatest(npg, 1)) * (nokt / greatest(nt, 1)) / (nok / greatest(npg, 1) + nokt / greatest(nt, 1))
   ELSE 0.0 END AS FTA FROM s JOIN u USING (dataset))"""


@query("grouping_accuracy", f"SELECT dataset, round(GA, 6) AS GA, round(FGA, 6) AS FGA FROM {_ga_sql(_SLICE_PRED_SQL)}")
def q_grouping_accuracy(spark, sf):
    m = metrics.grouping_accuracy(slice_predictions(spark, sf))
    return m.select("dataset", F.round("GA", 6).alias("GA"), F.round("FGA", 6).alias("FGA"))


@query("fta", f"SELECT dataset, round(FTA, 6) AS FTA FROM {_fta_sql(_SLICE_PRED_SQL)}")
def q_fta(spark, sf):
    return metrics.template_accuracy(slice_predictions(spark, sf)).select("dataset", F.round("FTA", 6).alias("FTA"))


@query("parsing_accuracy")
def q_parsing_accuracy(spark, sf):
    return metrics.parsing_accuracy(slice_predictions(spark, sf))


@query("evaluate_macro")
def q_evaluate_macro(spark, sf):
    """I5 + R2: truth lines matched (hybrid, alpha 0.7) against the slice store."""
    from . import evaluate as EV
    lines = EV.truth_lines(events_pp(spark, sf))
    per = lineage.stored(EV.evaluate(lines, slice_store(spark, sf), alpha=0.7))  # a row for each data set, read twice
    return per.unionByName(metrics.macro_mean(per).select(
        F.lit("MEAN").alias("dataset"), *[F.round(c, 4).alias(c) for c in ("GA", "PA", "FGA", "FTA")],
        F.lit(None).cast("long").alias("store_templates"), F.lit(0.7).alias("alpha")))


def _encoded_sql(rows: str, text: str) -> str:
    """The rows, with the hashed vector `v` of their `text` as the encoder gives it."""
    hashes = f"list_transform({S.tokens(text)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT))"
    bucket = "list_transform(list_filter(hs, lambda h: h % 64 = d), lambda h: CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)"
    counts = f"list_transform(range(64), lambda d: CAST(coalesce(list_sum({bucket}), 0.0) AS DOUBLE))"
    return (f"(SELECT * EXCLUDE (hs, raw_v, norm), list_transform(raw_v, lambda x: CAST(CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END AS FLOAT)) AS v "
            f"FROM (SELECT *, sqrt(list_inner_product(raw_v, raw_v)) AS norm FROM (SELECT *, {counts} AS raw_v FROM (SELECT *, {hashes} AS hs FROM {rows}))))")


def _store_sql(pp: str, tau: float) -> str:
    """`dataset, cluster_id, template, template_id, store_ord, c`: the slice store, `c` its centroids."""
    lines = _encoded_sql(f"(SELECT *, {S.partition_key('normalised', 'dataset')} AS cluster_id FROM {_distinct_sql(pp)})", "normalised")
    mean = (f"(SELECT dataset, cluster_id, d, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT dataset, cluster_id, unnest(v) AS x, "
            f"generate_subscripts(v, 1) AS d FROM {lines}) GROUP BY ALL)")
    cents = (f"(SELECT dataset, cluster_id, list(CAST(m / (n + 1e-8) AS FLOAT) ORDER BY d) AS c FROM (SELECT *, "
             f"sqrt(sum(m * m) OVER (PARTITION BY dataset, cluster_id)) AS n FROM {mean}) GROUP BY ALL)")
    return (f"(SELECT t.dataset, t.cluster_id, t.template, {S.template_id('t.template')} AS template_id, t.store_ord, c.c "
            f"FROM {_vote_sql(pp, tau)} t JOIN {cents} c USING (dataset, cluster_id))")


_STORES_SQL = f"(SELECT * FROM {_store_sql(EV_PP, _SLICE_T)} UNION ALL SELECT * FROM {_store_sql(DOC_PP, 0.5)})"
_UNKNOWN_SQL = (f"(SELECT line_id, raw, content, {_unknown_mask_sql('content')} AS normalised FROM "
                f"(SELECT line_id, raw, {_unknown_content_sql('raw')} AS content FROM {tables.unknown_lines_sql()}))")


def _scored_sql(lines: str, stores: str, alpha: float, set_variant: bool, on: str = "") -> str:
    """CTEs up to `scored(line, dataset, store_ord, template_id, template, first, score)` of all pairs of distinct texts and templates."""
    kind, empty, fixed = ("list_distinct(fx)", 0.5, "list_distinct(fx)") if set_variant else ("fx", 0.3, "fx")
    return f"""lines AS MATERIALIZED (SELECT * FROM {lines}),
texts AS MATERIALIZED (SELECT text, CAST(v AS DOUBLE[64]) AS v, tk, len(tk) AS n, lower(tk[1]) AS t0 FROM (SELECT *, {S.tokens('text')} AS tk FROM
  {_encoded_sql("(SELECT DISTINCT normalised AS text FROM lines WHERE normalised <> '')", 'text')})),
temp0 AS MATERIALIZED (SELECT *, {S.tokens('template')} AS tk FROM {stores}),
temps AS MATERIALIZED (SELECT dataset, store_ord, template_id, template, CAST(c AS DOUBLE[64]) AS c, coalesce(lower(tk[1]), '') AS t0, len(tk) AS n, {kind} AS fx, len({fixed}) AS nf, row_number() OVER () AS tid
  FROM (SELECT *, list_transform(list_filter(tk, lambda t: t <> '<*>'), lambda t: lower(t)) AS fx FROM temp0)),
lt AS (SELECT text, unnest(list_distinct(list_transform(tk, lambda t: lower(t)))) AS tok FROM texts),
tt AS (SELECT tid, tok, count(*) AS c FROM (SELECT tid, unnest(fx) AS tok FROM temps) GROUP BY ALL),
hits AS MATERIALIZED (SELECT text, tid, sum(c) AS h FROM lt JOIN tt USING (tok) GROUP BY ALL),
scored AS (SELECT x.text, t.dataset, t.store_ord, t.template_id, t.template, x.t0 = t.t0 AS same_first,
  {alpha} * array_inner_product(x.v, t.c) + (1 - {alpha}) * (CASE WHEN t.nf = 0 THEN {empty} ELSE 0.5 * coalesce(h.h, 0) / greatest(t.nf, 1)
    + 0.3 * (CASE WHEN x.t0 = t.t0 THEN 1.0 ELSE 0.0 END) + 0.2 * (1.0 - abs(x.n - t.n) / greatest(x.n, t.n, 1)) END) AS score
  FROM texts x JOIN temps t ON {on or 'true'} LEFT JOIN hits h ON h.text = x.text AND h.tid = t.tid)"""


def _cross_sql(k: int) -> str:
    return f"""{_scored_sql(_UNKNOWN_SQL, _STORES_SQL, 0.5, False)},
top AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(score, 6) DESC, dataset, store_ord) AS rank FROM scored QUALIFY rank <= {k})"""


@query("hybrid_best", f"""WITH {_scored_sql(_distinct_sql(EV_PP), _store_sql(EV_PP, _SLICE_T), 0.7, False)},
top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, store_ord) = 1)
SELECT dataset, text AS normalised, template_id, round(score, 4) AS score, {S.match_class('score')} AS match_type FROM top""")
def q_hybrid_best(spark, sf):
    d = frame_ops.distinct_lines(events_pp(spark, sf))
    enc = V.encode_lines(d, "normalised")
    b = match.best_match(enc, slice_store(spark, sf), alpha=0.7, line_key=("dataset", "normalised"))
    return b.select("dataset", "normalised", "template_id", F.round("score", 4).alias("score"), "match_type")


def unknown_lines_pp(spark, sf) -> DataFrame:
    u = tables.unknown_lines(spark, sf)
    u = u.withColumn("content", T.unknown_content(F.col("raw"))).withColumn("normalised", T.unknown_mask(F.col("content")))
    return V.encode_lines(u.where(F.col("normalised") != ""), "normalised")


def all_stores(spark, sf) -> DataFrame:
    return slice_store(spark, sf).unionByName(slice_store(spark, sf, docs_pp, 0.5))


@query("cross_store_topk", f"""WITH {_cross_sql(3)}
SELECT line_id, CAST(rank AS INTEGER) AS rank, dataset AS store_dataset, template_id, round(score, 4) AS score FROM lines JOIN top ON text = normalised""")
def q_cross_store(spark, sf):
    r = cross_search.cross_store_topk(unknown_lines_pp(spark, sf), all_stores(spark, sf), k=3, alpha=0.5)
    return r.select("line_id", "rank", "store_dataset", "template_id", F.round("score", 4).alias("score"))


@query("unknown_summary", f"""WITH {_cross_sql(1)},
m AS (SELECT {S.match_class('coalesce(score, 0.0)')} AS match_type FROM lines LEFT JOIN top ON text = normalised WHERE normalised <> '')
SELECT match_type, count(*) AS n, sum(count(*)) OVER () AS total, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM m GROUP BY match_type""")
def q_unknown_summary(spark, sf):
    """I9 + B24: best cross-store match per unknown line, classes and counts."""
    u = unknown_lines_pp(spark, sf)
    r = cross_search.cross_store_topk(u, all_stores(spark, sf), k=1, alpha=0.5)
    j = u.join(r, "line_id", "left").withColumn("match_type", T.match_class(F.coalesce("score", F.lit(0.0))))
    shaped = match.shape_unknown(j)
    return metrics.class_summary(shaped).select("match_type", "n", "total", "pct")


_BLOCKED_SQL = f"""{_scored_sql(_UNKNOWN_SQL, _STORES_SQL, 0.7, True)},
best AS (SELECT text, dataset, CASE WHEN bool_or(same_first) THEN max(score) FILTER (same_first) ELSE max(score) END AS score FROM scored GROUP BY ALL)"""


@query("keyword_blocked_best", f"WITH {_BLOCKED_SQL} SELECT line_id, dataset, round(score, 4) AS score FROM lines JOIN best ON text = normalised")
def q_keyword_blocked(spark, sf):
    r = cross_search.keyword_blocked_best(unknown_lines_pp(spark, sf), all_stores(spark, sf), alpha=0.7)
    return r.select("line_id", "dataset", F.round("score", 4).alias("score"))


_RATES = ("match", "exact", "partial", "fuzzy", "new")
_CLASS_SUMS = ", ".join(f"sum(CASE WHEN mt = '{c}' THEN 1 ELSE 0 END) AS \"{c}\"" for c in _RATES[1:])
_RATE_COLS = ", ".join(f'round("{"matched" if c == "match" else c}" / total, 6) AS {c}_rate' for c in _RATES)


@query("cross_system_rates", f"""WITH {_BLOCKED_SQL},
b AS (SELECT dataset, score, {S.match_class('score')} AS mt FROM lines JOIN best ON text = normalised),
r AS (SELECT dataset, sum(CASE WHEN mt <> 'new' THEN 1 ELSE 0 END) AS matched, {_CLASS_SUMS}, count(*) AS total, round(avg(score), 4) AS mean_score FROM b GROUP BY dataset)
SELECT dataset, CAST(matched AS BIGINT) AS matched, CAST("exact" AS BIGINT) AS "exact", CAST("partial" AS BIGINT) AS "partial", CAST("fuzzy" AS BIGINT) AS "fuzzy", CAST("new" AS BIGINT) AS "new",
  total, mean_score, {_RATE_COLS}, row_number() OVER (ORDER BY matched / total DESC, list_position(['events', 'de', 'en', 'es', 'fr'], dataset)) = 1 AS is_best FROM r""")
def q_cross_system_rates(spark, sf):
    best = cross_search.keyword_blocked_best(unknown_lines_pp(spark, sf), all_stores(spark, sf), alpha=0.7)
    order = ["events", "de", "en", "es", "fr"]
    rates = metrics.cross_system_rates(best, order).withColumn("mean_score", F.round("mean_score", 4))
    return rates.withColumns({f"{c}_rate": F.round(f"{c}_rate", 6) for c in _RATES})


# ------------------------------------------------------------ sweeps

@query("alpha_sweep")
def q_alpha_sweep(spark, sf):
    from . import evaluate as EV
    return EV.alpha_sweep(EV.truth_lines(events_pp(spark, sf)), slice_store(spark, sf))


@query("tau_r_sweep")
def q_tau_r_sweep(spark, sf):
    from . import evaluate as EV
    cl = _slice_clusters(spark, sf)
    return EV.tau_r_sweep(EV.truth_lines(events_pp(spark, sf)), cl)


@query("tau_d_sweep")
def q_tau_d_sweep(spark, sf):
    from . import evaluate as EV
    return EV.tau_d_sweep(EV.truth_lines(events_pp(spark, sf)), HDFS.dist, HDFS.tau)


# ------------------------------------------------------------ streaming, K2

def _online_setup(spark, sf):
    pp = events_pp(spark, sf)
    sp = frame_ops.ordered_split(pp)
    off = sp.where(F.col("split") == "offline")
    params = spark.createDataFrame([("events", HDFS.dist, HDFS.tau)], "dataset string, dist double, tau double")
    st = store.build_store(off, params, as_of="2024-01-01 00:00:00")
    return st, sp.where(F.col("split") == "online"), pp


@query("stream_exact")
def q_stream_exact(spark, sf):
    from ..streaming import stream
    st, on, _ = _online_setup(spark, sf)
    return stream.run_file_stream(spark, on, st)


@query("stream_replay_cap")
def q_stream_replay_cap(spark, sf):
    from ..streaming import stream
    st, on, _ = _online_setup(spark, sf)
    return stream.run_file_stream(spark, on, st, max_logs=500)


@query("match_summary")
def q_match_summary(spark, sf):
    from ..streaming import stream
    st, on, _ = _online_setup(spark, sf)
    res = stream.run_file_stream(spark, on, st)
    return metrics.stream_summary(res)


@query("online_metrics")
def q_online_metrics(spark, sf):
    from ..streaming import stream
    st, on, pp = _online_setup(spark, sf)
    res = stream.run_file_stream(spark, on, st)
    gt = pp.select("dataset", "line_id", "EventId", "EventTemplate", F.col("content").alias("Content"))
    return metrics.online_metrics(res, gt)


@query("report_columns")
def q_report_columns(spark, sf):
    from ..streaming import stream
    st, on, _ = _online_setup(spark, sf)
    return metrics.report_columns(metrics.stream_summary(stream.run_file_stream(spark, on, st)))


@query("entropy_monitor", f"""
WITH p AS {_SLICE_PRED_SQL},
r AS (SELECT dataset, substr(md5(pred_template), 1, 8) AS tid,
             row_number() OVER (PARTITION BY dataset ORDER BY line_id) AS r1 FROM p),
n AS (SELECT dataset, count(*) AS n FROM p GROUP BY dataset),
x AS (SELECT dataset, CAST(('0x' || tid) AS BIGINT) % 10000 AS bucket,
             unnest(generate_series(CAST(ceil(r1 / 100.0) * 100 AS BIGINT), r1 + 499, 100)) AS c FROM r),
x2 AS (SELECT x.* FROM x JOIN n USING (dataset) WHERE c <= n),
per AS (SELECT dataset, c, bucket, count(*) AS k FROM x2 GROUP BY ALL),
tot AS (SELECT dataset, c, sum(k) AS total, count(*) AS nb FROM per GROUP BY ALL),
ent AS (SELECT per.dataset, per.c, sum(-(k / total) * log2(k / total)) AS h, any_value(total) AS n_window,
               any_value(nb) AS nb FROM per JOIN tot USING (dataset, c) GROUP BY ALL),
ne AS (SELECT *, CASE WHEN nb > 1 THEN h / log2(nb) ELSE 0.0 END AS v FROM ent)
SELECT dataset, c AS checkpoint, n_window, round(v, 6) AS norm_entropy,
  CASE WHEN n_window < 10 THEN 0 WHEN v > 0.8 THEN 1 WHEN v < 0.3 THEN -1 ELSE 0 END AS step FROM ne""")
def q_entropy_monitor(spark, sf):
    from ..streaming import monitor
    p = slice_predictions(spark, sf).select("dataset", "line_id", T.template_id("pred_template").alias("template_id"))
    return monitor.entropy_checkpoints(p)


_CLAMP_SQL = "least(0.55, greatest(0.05, {} + 0.01 * s.step))"


@query("entropy_threshold", f"""
WITH RECURSIVE s AS ({ORACLES["entropy_monitor"]}),
w AS (SELECT dataset, checkpoint, {_CLAMP_SQL.format("0.2")} AS threshold FROM s WHERE checkpoint = 100
  UNION ALL SELECT s.dataset, s.checkpoint, {_CLAMP_SQL.format("w.threshold")} FROM w JOIN s ON s.dataset = w.dataset AND s.checkpoint = w.checkpoint + 100)
SELECT dataset, checkpoint, CAST(round(threshold, 6) AS DOUBLE) AS threshold FROM w""")
def q_entropy_threshold(spark, sf):
    """K2: the running threshold, as the streaming learner has it after each checkpoint."""
    from ..streaming import monitor
    return monitor.running_threshold(q_entropy_monitor(spark, sf))


@query("structural_scores", f"""
SELECT dataset, line_id, round(a, 6) AS list_score, round(b, 6) AS set_score, round(0.6 * b + 0.4 * a, 6) AS hybrid_score,
  {S.match_class('a')} AS list_class, {S.match_class('b')} AS set_class
FROM (SELECT dataset, line_id, {S.structural_score('normalised', 'EventTemplate')} AS a,
        {S.structural_score('normalised', 'EventTemplate', set_variant=True)} AS b FROM {EV_PP})""")
def q_structural_scores(spark, sf):
    """Every line against its true template."""
    line, tmpl = F.col("normalised"), F.col("EventTemplate")
    s = events_pp(spark, sf).select("dataset", "line_id", T.structural_score(line, tmpl).alias("a"),
                                    T.structural_score(line, tmpl, set_variant=True).alias("b"))
    return s.select("dataset", "line_id", F.round("a", 6).alias("list_score"), F.round("b", 6).alias("set_score"),
                    F.round(T.hybrid("b", "a", 0.6), 6).alias("hybrid_score"),
                    T.match_class("a").alias("list_class"), T.match_class("b").alias("set_class"))


# ------------------------------------------------------------ baselines, pairs

@query("lcs_parse")
def q_lcs_parse(spark, sf):
    from ..operators import baselines as B
    return B.lcs_parse(spark, events_pp(spark, sf).select("dataset", "line_id", "normalised"))


@query("lcs_match")
def q_lcs_match(spark, sf):
    from ..operators import baselines as B
    sp = frame_ops.ordered_split(events_pp(spark, sf))
    tm = B.lcs_templates(spark, sp.where(F.col("split") == "offline").select("dataset", "line_id", "normalised"))
    return B.lcs_match(sp.where(F.col("split") == "online"), tm).select("dataset", "line_id", "template", F.round("sim", 4).alias("sim"))


@query("tree_parse")
def q_tree_parse(spark, sf):
    from ..operators import baselines as B
    return B.tree_parse(spark, events_pp(spark, sf).select("dataset", "line_id", "normalised"))


def _kept_lines(spark, sf, *cols) -> DataFrame:
    """Event lines for several passes: parsed once and written."""
    return lineage.stored(events_pp(spark, sf).select("dataset", "line_id", *cols))


@query("baseline_comparison")
def q_baseline_comparison(spark, sf):
    """L4: frozen LCS templates on held-out lines; unmatched lines are their own group."""
    from ..operators import baselines as B
    pp = _kept_lines(spark, sf, "normalised", "EventId")
    sp = frame_ops.ordered_split(pp)
    tm = B.lcs_templates(spark, sp.where(F.col("split") == "offline").select("dataset", "line_id", "normalised"))
    on = sp.where(F.col("split") == "online")
    m = B.lcs_match(on, tm).join(on.select("dataset", "line_id", "normalised"), ["dataset", "line_id"])
    g = B.heldout_grouping(m, pp.select("dataset", "line_id", "EventId"))
    return metrics.grouping_accuracy(g).select("dataset", F.lit("lcs").alias("method"), "GA")


@query("match_rate_comparison")
def q_match_rate_comparison(spark, sf):
    from ..operators import baselines as B
    lines = _kept_lines(spark, sf, "normalised")
    return B.match_rate(B.lcs_parse(spark, lines), "lcs").unionByName(B.match_rate(B.tree_parse(spark, lines), "tree"))


@query("method_winners")
def q_method_winners(spark, sf):
    """I10 over per-data-set accuracies of the three methods (template method =
    slice GA, tree and LCS = learning-run match rates)."""
    from ..operators import baselines as B
    lines = _kept_lines(spark, sf, "normalised")
    ga = metrics.grouping_accuracy(slice_predictions(spark, sf)).select("dataset", F.col("GA").alias("template_acc"))
    lc = B.match_rate(B.lcs_parse(spark, lines), "lcs").select("dataset", F.col("match_rate").alias("lcs_acc"))
    tr = B.match_rate(B.tree_parse(spark, lines), "tree").select("dataset", F.col("match_rate").alias("tree_acc"))
    return metrics.method_winners(ga.join(lc, "dataset").join(tr, "dataset"))


def _pair_input(spark, sf):
    return _kept_lines(spark, sf, "content", "EventId")


@query("positive_pairs", f"""
WITH s AS (SELECT dataset, EventId, line_id, content, row_number() OVER (PARTITION BY dataset, EventId
             ORDER BY CAST(('0x' || substr(md5('42|' || CAST(line_id AS VARCHAR)), 1, 8)) AS BIGINT), line_id) AS r
           FROM {EV_PP}),
p AS (SELECT dataset, EventId, r, content AS text_a, lead(content) OVER (PARTITION BY dataset, EventId ORDER BY r) AS text_b
      FROM s WHERE r <= 10),
f AS (SELECT dataset, EventId, min(line_id) AS g FROM {EV_PP} GROUP BY ALL),
k AS (SELECT p.*, row_number() OVER (PARTITION BY p.dataset ORDER BY f.g, p.r) AS k FROM p JOIN f USING (dataset, EventId)
      WHERE text_b IS NOT NULL)
SELECT dataset, text_a, text_b, 1 AS label FROM k WHERE k <= 200""")
def q_positive_pairs(spark, sf):
    from ..operators import pairs
    return pairs.positive_pairs(_pair_input(spark, sf)).drop("_k")


@query("negative_pairs")
def q_negative_pairs(spark, sf):
    from ..operators import pairs
    pi = _pair_input(spark, sf)
    pos = pairs.positive_pairs(pi)
    n_pos = pos.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pos"))
    return pairs.negative_pairs(pi, n_pos).drop("_k")


@query("pair_similarity")
def q_pair_similarity(spark, sf):
    from ..operators import pairs
    return pairs.pair_similarity(pairs.training_pairs(_pair_input(spark, sf)).drop("_k"))


@query("embedding_clusters")
def q_embedding_clusters(spark, sf):
    """E3 on the provided vectors: groups = label mod 5, two-stage cut search."""
    e = tables.embedding_vectors(spark, sf).select(
        F.lit("emb").alias("dataset"), (F.col("label") % 5).cast("string").alias("pkey"),
        F.col("vec_id").alias("uniq_ord"), "embedding")
    return C.cluster_lines(e, dist=1.2).select("uniq_ord", "cluster_id", "cut_thr")
