"""MinHash near-duplicates from bottom-k sketches.

A document's set is its distinct word shingles (A-Z lowered); one hash function
orders all shingles, and the `KEPT` smallest of a set are its sketch. Documents of
equal sets form a class, and only its smallest id, the representative, goes on.

Candidates come from inverted lists of sketch values. Two sets alike enough share
at least `least_shared` values of their sketches (for sets beyond the sketch, but
for a chance below 1e-8), so each sketch is looked up by its rarest values only,
just as many as must hold a common one: values of widespread passages make no
lists of unrelated documents. In a list, nobody is paired with everybody:

1. each member is paired with three leaders of the list. Pairs whose sketches'
   union does not rule out the similarity are verified on the full sets, and
   links joined to components; all such pairs, linked or not, join documents to
   wider families. Members of a list that are in none of its leaders' families get
   leaders of their own in a second round;
2. where a list still has several families, members outside its main one are held
   against the others' sketches, block by block: a member is dealt to a block
   once, and a block is one row. Pairs that the sketches do not rule
   out join their families at once, inside the block, and a block gives back just the
   pairs that joined two (a spanning forest of its families). Every link is then
   within a family;
3. where a family has several components, members outside its main one are held
   against the others on the full sets, block by block, in the same way.

So no link between components is lost, and within a component further links
change nothing. A block gives fewer rows than it has families or components, never
all pairs of a group.

Verification groups pairs by their first document, salted into parts of bounded
size, and streams the others past it.

Null and empty texts, and texts without a word, have an empty set and link with
nothing. Null ids link with nothing and stay (`component_id` null, `kept` true).
Rows that repeat an id are one document, compared by the least of its texts; each
row has that document's component. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, free_names, partitions, rows_of, texts, window_hashes, word_hashes
from .components import components

KEPT, BLOCK, BLOCK_WEIGHT, SIGMAS, COLUMNS_AT_ONCE, PAIRS_AT_ONCE = 64, 512, 2_000_000, 7.0, 4096, 4096
NOTHING = np.uint64((1 << 64) - 1)
SKETCHED = "doc_id long, n_shingles long, digest binary, sketch array<long>"


def shingles(data: bytes, words: int) -> np.ndarray:
    """Hashes of the set, in ascending order."""
    hashes = word_hashes(data.lower())  # bytes: A-Z only
    return np.unique(window_hashes(hashes, min(words, len(hashes)))) if len(hashes) else np.zeros(0, U64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for ids, data in rows_of(batches, "doc_id", "text"):
            sets = [shingles(x or b"", words) for x in data]
            kept = [s[:KEPT] for s in sets]
            ends = np.cumsum([0, *(len(k) for k in kept)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).view(np.int64)))
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), digests, lists], ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.mapInArrow(run, SKETCHED)


def least_shared(n: Column, share: float) -> Column:
    """Values that the sketch of a set of `n` shares with that of any set alike enough.

    Small sets are their own sketches, so the share itself holds; else it is the share of the
    smaller sketch, less SIGMAS standard deviations."""
    k = F.least(F.lit(KEPT), F.when(n * share >= KEPT, F.lit(KEPT)).otherwise(F.ceil(n * share)))
    sampled = F.floor(k * share - SIGMAS * F.sqrt(k * (share * (1 - share))))
    return F.greatest(F.lit(1), F.when(n <= KEPT * share, F.ceil(n * share - 1e-9)).otherwise(sampled)).cast("int")


def lists(reps: DataFrame, share: float) -> DataFrame:
    """`value, rep, n`: every representative under its rarest values."""
    values = reps.select("rep", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    n, size = F.col("n"), F.size("shared")
    held = F.least(n, F.lit(KEPT)).cast("int")
    own = values.join(often, "value").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "value"))).alias("shared"))  # a sketch's worth
    least = least_shared(n, share)
    first = held - least + 1 - (held - size)  # the values that nobody shares come before
    own = own.where(size >= least).select("rep", "n", F.explode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), first))).alias("s"))
    return own.select(F.col("s.value").alias("value"), "rep", "n")


def one_list_each(members: DataFrame) -> DataFrame:
    """The lists that have several members; of lists with the same members, one."""
    same = F.struct(F.count("*").alias("often"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("rep", F.lit(3))).alias("xor"))
    told = members.groupBy("value").agg(same.alias("same")).where("same.often > 1")
    return members.join(told.groupBy("same").agg(F.min("value").alias("value")).select("value"), "value")


def alike_sizes(a: str, b: str, share: float) -> Column:
    return F.least(a, b) >= F.lit(share - 1e-9) * F.greatest(a, b)


def ruled_in(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """Pairs `a, b` that the sketch of their union does not rule out."""
    of = lambda k: reps.select(F.col("rep").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("n").alias(f"size_{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    union = F.slice(F.array_sort(F.array_union("unsigned_a", "unsigned_b")), 1, KEPT)
    flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))  # noqa: E731  ascending as signed numbers
    both = both.withColumns({"unsigned_a": flip("sketch_a"), "unsigned_b": flip("sketch_b")}).withColumn("union", union)
    shared = F.size(F.array_intersect(F.array_intersect("unsigned_a", "unsigned_b"), "union"))
    k = F.size("union")
    whole = (F.col("size_a") <= KEPT) & (F.col("size_b") <= KEPT)
    return both.where(whole | (shared >= F.floor(k * share - SIGMAS * F.sqrt(k * (share * (1 - share)))))).select("a", "b")


def verified(pairs: DataFrame, own: DataFrame, words: int, share: float) -> DataFrame:
    """The pairs that link. own: `rep, text`."""
    spark = pairs.sparkSession
    salts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    heads = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", salts).drop("n")
    left = heads.join(own.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(heads, "a").join(own.withColumnRenamed("rep", "b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "text")
    percent = round(share * 100)

    def run(batches):
        head, now = None, None
        for a, salt, b, data in rows_of(batches, "a", "salt", "b", "text"):
            links = []
            for x, s, y, text in zip(a, salt, b, data, strict=True):
                mine = shingles(text or b"", words)
                if y is None:
                    head, now = mine, (x, s)
                    continue
                assert now == (x, s)
                shared = len(np.intersect1d(head, mine, assume_unique=True))
                if shared and 100 * shared >= percent * (len(head) + len(mine) - shared):
                    links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    dealt = left.unionByName(right).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _heads(members: DataFrame) -> DataFrame:
    """`value, head, head_n`: up to three leaders of each list of several."""
    by = [F.struct("rep", "n"), *(F.struct(F.xxhash64("rep", F.lit(k)), "rep", "n") for k in (1, 2))]
    least = members.groupBy("value").agg(F.count("*").alias("often"), *(F.min(x).alias(f"m{i}") for i, x in enumerate(by))).where("often > 1")
    heads = F.array(*(F.struct(F.col(f"m{i}.rep").alias("rep"), F.col(f"m{i}.n").alias("n")) for i in range(len(by))))
    return least.select("value", F.explode(F.array_distinct(heads)).alias("h")).select("value", F.col("h.rep").alias("head"), F.col("h.n").alias("head_n"))


def _leaders(members: DataFrame, share: float) -> DataFrame:
    """Pairs of each member with its list's leaders."""
    paired = members.join(_heads(members), "value").where((F.col("rep") != F.col("head")) & alike_sizes("n", "head_n", share))
    return paired.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()


class Joined:
    """Groups that join inside a block, and the pairs that joined two of them."""

    def __init__(self, group: np.ndarray):
        self.names, self.of = np.unique(group, return_inverse=True)
        self.root = np.arange(len(self.names))
        self.pairs: list[tuple[int, int]] = []

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.root[self.of[x]] != self.root[self.of[y]]

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = self.root[self.of[i]], self.root[self.of[j]]
            if a != b:
                self.root[self.root == a] = b
                self.pairs.append((i, j))

    def links(self, rep: np.ndarray) -> pa.Table:
        a, b = (np.array([rep[p[k]] for p in self.pairs], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def may_link(sketches_: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Which pairs the sketch of their union does not rule out. sketches_: a row for each set, ascending, followed by the greatest value."""
    both = np.sort(np.concatenate([sketches_[x], sketches_[y]], axis=1), axis=1)
    real = both != NOTHING
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    whole = (n[x] <= KEPT) & (n[y] <= KEPT)
    shared = (again & (rank <= np.where(whole, 2 * KEPT, KEPT)[:, None])).sum(axis=1)
    k = np.where(whole, rank[:, -1], np.minimum(rank[:, -1], KEPT))
    return shared >= np.where(whole, np.maximum(1, k * share - 1e-9), np.floor(k * share - SIGMAS * np.sqrt(k * share * (1 - share))))


def _blocks(rows: DataFrame, of: DataFrame, group: str, part: str, weight: Column, *fields: str) -> DataFrame:
    """Pairs of blocks of a `group` that has several parts: `outer`, members outside its main part, and `every`, members of any.

    Each outer member meets each member in one pair of blocks. A member is dealt once to each side it is on; a block is one
    row, an array of `rep`, `part`, `in_main` and `fields`, which may be of `of`, by `rep`. Pairs of blocks, and the blocks
    that they repeat, grow with outer members times members: with few outsiders, as the group. Blocks hold about `BLOCK` rows, and about `BLOCK_WEIGHT` of `weight`."""
    counts = rows.groupBy(group, part).agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    top = F.max(F.struct(F.col("c"), F.col(part).alias("part"), F.col("w")))
    several = counts.groupBy(group).agg(top.alias("top"), F.sum("c").alias("all"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1 AND `all` > 2")  # of two, the pair has been judged
    blocks = lambda c, w: F.least(F.ceil(F.greatest(c / F.lit(BLOCK), w / F.lit(BLOCK_WEIGHT))), c).cast("int")
    of_all, of_outer = blocks(F.col("all"), F.col("w")), blocks(F.col("all") - F.col("top.c"), F.col("w") - F.col("top.w"))
    several = several.select(group, F.col("top.part").alias("main"), of_all.alias("blocks"), of_outer.alias("outer_blocks"))
    member = F.struct("rep", F.col(part).alias("part"), "in_main", *fields)
    rows = rows.join(several, group).join(of, "rep").withColumn("in_main", F.col(part) == F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = rows.groupBy(group, block("blocks").alias("j")).agg(F.collect_list(member).alias("every"))
    outer = rows.where("NOT in_main").groupBy(group, "blocks", block("outer_blocks").alias("i")).agg(F.collect_list(member).alias("outer"))
    return outer.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").join(every, [group, "j"])


def _met(pair: pa.Table) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """Both blocks of a pair, outer members first; numbers of these; which of them, by row, are to meet which members, by column."""
    outer, every = (pair.column(c).combine_chunks().flatten() for c in ("outer", "every"))
    members, k = pa.concat_arrays([outer, every]), len(outer)
    rep, in_main = members.field("rep").to_numpy(), members.field("in_main").to_numpy(zero_copy_only=False)
    meet = np.zeros((k, len(members)), bool)
    meet[:, k:] = in_main[k:] | (rep[:k, None] < rep[k:])  # two outer ones meet once
    return members, np.arange(k), meet


def _between(members: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """Pairs that join the families of one list, by blocks. members: value, rep, n, family."""
    pairs = _blocks(members, reps.select("rep", "sketch"), "value", "family", F.lit(1), "n", "sketch")

    def run(pair: pa.Table) -> pa.Table:
        rows, outer, meet = _met(pair)
        n, rep = (rows.field(c).to_numpy() for c in ("n", "rep"))
        joined = Joined(rows.field("part").to_numpy())
        sizes = rows.field("sketch").value_lengths().to_numpy()
        sketch = rows.field("sketch").flatten().to_numpy().view(np.uint64)
        padded = np.full((len(rep), KEPT), NOTHING)
        padded[np.arange(KEPT) < sizes[:, None]] = sketch
        _, number, often = np.unique(sketch, return_inverse=True, return_counts=True)
        column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[number]
        matrix = np.zeros((len(rep), int((often > 1).sum())), np.float32)
        matrix[np.repeat(np.arange(len(rep)), sizes)[column >= 0], column[column >= 0]] = 1
        for at in range(0, len(outer), 128):
            x = outer[at : at + 128]
            shared = matrix[x] @ matrix.T
            k = np.minimum(sizes[x][:, None], sizes[None, :])
            enough = meet[x] & (shared >= np.maximum(1, np.floor(k * share - SIGMAS * np.sqrt(k * share * (1 - share)))))
            low, high = np.minimum(n[x][:, None], n[None, :]), np.maximum(n[x][:, None], n[None, :])
            enough &= low >= (share - 1e-9) * high
            i, j = np.nonzero(enough)
            i = x[i]
            while len(i):
                left = joined.apart(i, j)
                i, j = i[left], j[left]
                ok = may_link(padded, n, i[:PAIRS_AT_ONCE], j[:PAIRS_AT_ONCE], share)
                joined.join(i[:PAIRS_AT_ONCE][ok], j[:PAIRS_AT_ONCE][ok])
                i, j = i[PAIRS_AT_ONCE:], j[PAIRS_AT_ONCE:]
        return joined.links(rep)

    return pairs.groupBy("value", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _within(families: DataFrame, own: DataFrame, words: int, share: float) -> DataFrame:
    """Links that join the components of one family, by blocks.

    families: rep, n, component, family; own: rep, text."""
    pairs = _blocks(families, own, "family", "component", F.col("n"), "text")
    percent = round(share * 100)

    def run(pair: pa.Table) -> pa.Table:
        rows, outer, meet = _met(pair)
        rep = rows.field("rep").to_numpy()
        joined = Joined(rows.field("part").to_numpy())
        sets = [shingles((t or "").encode(), words) for t in rows.field("text").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(rep)), sizes)
        number = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[number]  # shingles of one document count for nothing
        order = np.argsort(number, kind="stable")[int((number < 0).sum()) :]
        doc, number = doc[order], number[order]
        shared = np.zeros((len(outer), len(rep)), np.float32)
        for first in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS_AT_ONCE):
            a, b = np.searchsorted(number, (first, first + COLUMNS_AT_ONCE))
            matrix = np.zeros((len(rep), COLUMNS_AT_ONCE), np.float32)
            matrix[doc[a:b], number[a:b] - first] = 1
            shared += matrix[outer] @ matrix.T
        union = sizes[outer][:, None] + sizes[None, :] - shared
        x, y = np.nonzero(meet & (shared > 0) & (100 * shared >= percent * union))
        left = joined.apart(x, y)
        joined.join(x[left], y[left])
        return joined.links(rep)

    return pairs.groupBy("family", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _named(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """rows, with the group (`node, component`) of each `rep`, itself if it has none."""
    of = groups.select(F.col("node").alias("rep"), F.col("component").alias("of"))
    return rows.join(of, "rep", "left").withColumn(name, F.coalesce("of", "rep")).drop("of")


def _stars(groups: DataFrame) -> DataFrame:
    return groups.where("node > component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def links(docs: DataFrame, reps: DataFrame, scratch: Scratch, words: int, share: float) -> DataFrame:
    """`node, component` of the representatives that link. reps: `rep, n, sketch`; docs: their texts by id."""
    members = scratch.save(one_list_each(lists(reps, share)), "lists")
    # Texts of all that share a list: no step pairs anyone else.
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    wanted = scratch.save(wanted, "wanted")
    # Merged at every size: the ids grow with the documents, so they are never broadcast.
    own = scratch.save(docs.join(wanted.hint("merge"), "doc_id").select(F.col("doc_id").alias("rep"), "text"), "texts")
    reps = scratch.save(reps.join(wanted.withColumnRenamed("doc_id", "rep").hint("merge"), "rep"), "near")
    tested = scratch.save(ruled_in(_leaders(members, share), reps, share), "pairs-1")
    families = components(tested, scratch, "families-1")
    # Members in no leader's family choose again, among themselves.
    here = scratch.save(_named(members, families, "family"), "here-1")
    led = _heads(members).select("value", "head").join(here.select("value", F.col("rep").alias("head"), "family"), ["value", "head"]).select("value", "family").distinct()
    rest = here.join(led, ["value", "family"], "left_anti").select("value", "rep", "n")
    more = scratch.save(ruled_in(_leaders(rest, share), reps, share).join(tested, ["a", "b"], "left_anti"), "pairs-2")
    if not more.isEmpty():
        families = components(_stars(families).unionByName(more), scratch, "families-2")
        here = scratch.save(_named(members, families, "family"), "here-2")
    between = scratch.save(_between(here, reps, share), "pairs-3")
    if not between.isEmpty():
        families = components(_stars(families).unionByName(between), scratch, "families-3")
    found = components(scratch.save(verified(tested.unionByName(more).unionByName(between), own, words, share), "links-1"), scratch, "components-1")
    placed = scratch.save(_named(_named(reps.select("rep", "n"), families, "family"), found, "component"), "placed")
    new = scratch.save(_within(placed, own, words, share), "links-2")
    return found if new.isEmpty() else components(_stars(found).unionByName(new), scratch, "components-2")


def near_duplicates(docs: DataFrame, words: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row."""
    scratch = Scratch(docs.sparkSession, "bottomk")
    rows = texts(docs, id_col, text_col)
    known = rows.where("doc_id IS NOT NULL")
    ids = known.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    repeated = (ids or 0) > 1
    one = known.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else known
    every = scratch.save(sketches(one, words), "sketches")
    classes = every.where("n_shingles > 0").groupBy(F.col("n_shingles").alias("n"), "digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes, "classes")
    found = links(one, classes.select("rep", "n", "sketch"), scratch, words, share)
    heads = classes.select("n", "digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("n").alias("n_shingles"), "digest", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "digest").join(heads, ["n_shingles", "digest"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if repeated:
        out = sketches(known, words).select("doc_id", "n_shingles").join(out.select("doc_id", "component_id"), "doc_id")
    nameless = sketches(rows.where("doc_id IS NULL"), words).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """One row of `docs` for each component: that of the least id. Where ids are null or repeated, a row counts as
    its id and text together: different texts are documents of their own, and of equal rows one stays."""
    scratch = Scratch(docs.sparkSession, "bottomk-kept")
    key, odd = free_names(docs, "key", "odd")
    own = F.col("doc_id").cast("long")
    often = scratch.save(docs.groupBy(own.alias(key)).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).select(key), "repeated")
    if often.isEmpty():
        rows = docs.withColumn(key, own).withColumn(odd, F.lit(False))
    else:
        there = often.withColumn(odd, F.lit(True))
        rows = docs.join(there, own.eqNullSafe(F.col(key)), "left").withColumn(odd, F.coalesce(odd, F.lit(False)))
        rows = scratch.save(rows.withColumn(key, F.when(F.col(odd), F.xxhash64(own, F.col("text").cast("string"))).otherwise(own)), "keyed")
    gone = near_duplicates(rows, words, share, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    left = rows.join(scratch.save(gone, "gone"), key, "left_anti")
    if not often.isEmpty():
        left = left.where(~F.col(odd)).unionByName(left.where(odd).dropDuplicates([key]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
