"""Personal data: base patterns and bootstrapped contextual extraction, in SQL functions only.

Base kinds (email, ip, card, phone) are found by regular expressions and checks.
They are the seeds. Tokens with three digits in a row or an `@` are instances; the
word before a token and the token's shape (digits as 9, letters as a) make a
lexical pattern. Patterns are judged in rounds over the graph of patterns and
instances, by the lower confidence bound (Wilson's, `Z` standard deviations) of the
share of a pattern's distinct instances that speak for it: in the first round the
seeds, an instance that is one only in some places counting in part; in later rounds
also instances that `CONFIRM` sure patterns have found. A pattern whose bound is at
least `SURE` is sure and stays so; it marks the other tokens that stand in it as
personal data, kind `context`, and so helps to find patterns that no seed stands in.
What a pattern marks never counts for the pattern itself, and a single pattern
confirms nothing. Tokens that fail a base check, as Luhn's, count against a pattern
unless confirmed. More input only narrows the bounds. Counts come from groupings with
partial sums, so frequent patterns and instances do not gather in one place; nothing
is collected but whether a round added a pattern.

Offsets are code points, ends exclusive. Matches are leftmost and do not overlap
within a kind; one that fails its check is dropped with no retry. The expressions
are written so that a failing match is not tried anew from each character of a
run, which keeps long runs linear: `\\G` (where the last match ended) or the start
of a run are the only places to begin at.

Null and empty texts have no spans. Null ids and repeated rows are told apart by
id and text together; equal rows get equal results. Other columns are ignored, or
kept as they are by `redact`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
# The base patterns, for a matcher that finds leftmost matches.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?(?:@|[0-9]{3}))[^\x20\x09-\x0D]++"
TOKEN_NEEDS = r"@|[0-9]{3}"
#: One-sided 95 in 100.
SURE, Z, CONFIRM = 0.8, 1.645, 2
SPAN = "array<struct<start:int,end:int,found:string>>"


def spans(text: Column, pattern: str, needs: str) -> Column:
    """SPAN of the matches, and the text between: the pieces around the matches and
    the matches, of which lengths add up to places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["found"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["found"].alias("found"))
        more = F.when(pair["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), more.alias("out"))

    return F.when(text.rlike(needs), F.aggregate(pairs, none, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    """Of the digits from the right, every second one doubled, less 9 if over 9: the sum ends in 0."""
    from_right = F.split(F.reverse(digits), "")
    value = F.transform(from_right, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 4) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def of_kind(text: Column, kind: str) -> Column:
    """`array<struct<start, kind, end>>` of the matches that hold; the kind by its number."""
    number = F.lit(KINDS.index(kind))
    held = F.filter(spans(text, PATTERNS[kind], NEEDS[kind]), lambda s: holds(kind, s["found"]))
    return F.transform(held, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))


def tokens(text: Column) -> Column:
    """Instances: token without the punctuation around it, its place, and its pattern."""
    whole = spans(text, TOKEN, TOKEN_NEEDS)
    before = F.when(text.rlike(TOKEN_NEEDS), F.split(text, TOKEN, -1))

    def one(span: Column, i: Column) -> Column:
        head = F.length(F.regexp_extract(span["found"], r"^[^A-Za-z0-9+]*", 0))
        core = F.regexp_replace(span["found"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
        word = F.lower(F.regexp_extract(F.get(before, i), r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*\z", 1))
        shape = F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), "[A-Za-z]+", "a")
        start = span["start"] + head
        return F.struct(start.cast("int").alias("start"), (start + F.length(core)).cast("int").alias("end"), F.sha2(core, 256).alias("instance"), F.sha2(F.concat_ws("\n", word, shape), 256).alias("pattern"))

    return F.filter(F.transform(whole, one), lambda t: t["end"] > t["start"])


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text_key, base array<start, end, kind>, tokens`, without the texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    kinds = [of_kind(text, k) for k in KINDS]
    return rows.select("doc_id", text_key(text).alias("text_key"), F.array_sort(F.concat(*kinds)).alias("base"), tokens(text).alias("tokens"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(5))


def lower_bound(hits: Column, count: Column, z: float = Z) -> Column:
    """Wilson's lower confidence bound of a share."""
    share, z2 = hits / count, z * z
    half = z * F.sqrt(F.greatest(share * (1 - share) / count, F.lit(0.0)) + z2 / (4 * count * count))
    return (share + z2 / (2 * count) - half) / (1 + z2 / count)


def sure_patterns(edges: DataFrame, scratch: Scratch, sure: float = SURE) -> DataFrame:
    """`pattern` of high confidence, by rounds over the graph of patterns and instances.

    edges: distinct `pattern, instance, seed double`, seed being the share of the
    instance's places in the pattern that are seeds. The first round judges patterns by
    their seeds. Each further round also counts instances that `CONFIRM` patterns of
    earlier rounds have found, and judges the patterns that are not sure yet: what
    speaks for a pattern never comes from itself, and all of its other instances, those
    that fail a check among them, count against it. Rounds end when no pattern is added.
    """
    judged = lambda e: e.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").cast("double").alias("n")).where(lower_bound(F.col("seeds"), F.col("n")) >= sure).select("pattern")
    known = scratch.save(judged(edges), "patterns-0")
    k = 0
    new = known
    while not new.isEmpty():
        k += 1
        confirmed = edges.join(known, "pattern").groupBy("instance").count().where(F.col("count") >= CONFIRM).select("instance", F.lit(1.0).alias("confirmed"))
        rest = edges.join(known, "pattern", "left_anti").join(confirmed, "instance", "left")
        new = scratch.save(judged(rest.withColumn("seed", F.greatest("seed", F.coalesce("confirmed", F.lit(0.0))))), f"new-{k}")
        known = scratch.save(known.unionByName(new), f"patterns-{k}")
    return known


def all_spans(found: DataFrame, scratch: Scratch) -> DataFrame:
    """`doc_id, text_key, base, more`: with the spans that sure patterns find."""
    covered = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    seen = found.where(F.size("tokens") > 0).select("doc_id", "text_key", F.explode(F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["instance"].alias("instance"), t["pattern"].alias("pattern"), covered(t).alias("seed")))).alias("t")).select("doc_id", "text_key", "t.*")
    seen = scratch.save(seen, "tokens")
    edges = scratch.save(seen.groupBy("pattern", "instance").agg(F.avg(F.col("seed").cast("double")).alias("seed")), "edges")
    patterns = sure_patterns(edges, scratch)
    # The least span is as good as any where a row comes twice: its copies have the same.
    new = seen.where("not seed").join(patterns, "pattern").select("doc_id", "text_key", "start", "end").distinct()
    new = new.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.lit(len(KINDS)).alias("kind"), F.col("end")))).alias("more"))  # of one text
    new = new.withColumnsRenamed({"doc_id": "new_id", "text_key": "new_key"})
    joined = found.join(new, F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_key") == F.col("new_key")), "left")
    return joined.select("doc_id", "text_key", "base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("more"))


def count_of(kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")


def told(spans_col: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, CONTEXT)))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_<kind> ..., base_sha256, spans` for every document."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = all_spans(scratch.save(found_in(docs, id_col, text_col), "found"), scratch)
    counts = [count_of(k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "more"))).alias("spans"))


def blanked(text: Column, spans_col: Column) -> Column:
    """The text with every span, or several that overlap, replaced by the first one's kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, CONTEXT)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], parts).otherwise(acc["parts"]).alias("parts"))

    def whole(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans_col) > 0, F.aggregate(spans_col, start, step, whole)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with its personal data blanked out, and `n_chars` set to the new lengths."""
    scratch = Scratch(docs.sparkSession, "pii")
    own_id, own_key, own_spans, clean = free_names(docs, "id", "key", "spans", "clean")
    found = all_spans(scratch.save(found_in(docs), "found"), scratch).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.array_sort(F.concat("base", "more")).alias(own_spans))
    found = found.where(F.size(own_spans) > 0).dropDuplicates([own_id, own_key])
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (text_key(F.col("text")) == F.col(own_key)), "left")
    text = blanked(F.col("text"), F.coalesce(own_spans, F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    out = joined.withColumn(clean, text)
    values = {"text": F.col(clean), "n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*((values.get(c) if c in values else F.col(f"`{c}`")).alias(c) for c in docs.columns))
