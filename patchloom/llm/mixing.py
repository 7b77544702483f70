"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, the
source's target over its size.  The whole part is taken; the fractional parts
are rounded together: two documents exchange mass, in words, until one of them
is integral, so the words a source takes stay the same at every step.  One
document per group is left with a fraction; those meet in groups again, level
by level, until each source has one, which is rounded to the nearer side.  A
source's taken words are thus within half a document of its target.

Groups are cut by a hash of the document, so one source with a third of all
rows is as many groups as its size asks for.  The random numbers come from the
same hash: reruns agree whatever the partitioning.

A null text has size 0 and is taken as its source's expected copies say, which
adds no word.  Null is a source of its own, after all others.  Repeated rows
are documents of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.shared import WORD, private, saved

GROUP = 64
#: Identical rows become rows again in pieces of this many.
DEAL = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """Targets per source from rows (source, source_size).

    The weights repeat over the sources by code point, null last.
    Only this table of sources meets in one task, never documents.  A target
    stops at ``most`` times its source; the excess goes to the others by weight.
    Sorted by size over weight, the sources that stop are a first part of the
    list, found by running sums.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(everything) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1)
    rows = sources.withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    stopped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (share * total - stopped) / open_weight
    # the first source that doesn't stop has the level at which no other stops
    goes_on = F.col("weight") * level < most * F.col("source_size")
    rows = rows.select("*", F.row_number().over(by_ratio).alias("rank"), F.when(goes_on, level).alias("level"))
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("rank"))).over(Window.partitionBy())
    target = F.least(F.col("weight") * level, most * F.col("source_size"))
    return rows.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _uniform(*seed: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*seed), 11) / F.lit(float(1 << 53))


def _rounded(items: str) -> Column:
    """The array ``items`` of struct(toss, row, size, part), rounded in order.

    The result is struct(done: array of (row, part), open: the document left).
    ``up`` is the mass the open document gains if it wins the toss, ``down``
    what it gives if it loses; both keep the sum of size times part.  Which of
    the two became integral follows from the smaller side of up or down, not
    from the new fractions.
    """
    our_rest, their_rest = "(1 - s.open.part) * s.open.size", "(1 - x.part) * x.size"
    ours, theirs = "s.open.part * s.open.size", "x.part * x.size"
    up, down = f"least({our_rest}, {theirs})", f"least({ours}, {their_rest})"
    wins = f"x.toss * ({up} + {down}) < {down}"

    def step(first_ends: str, gain: str, first_part: int) -> str:
        def document(name: str, sign: str) -> str:
            return f"""named_struct('toss', {name}.toss, 'row', {name}.row, 'size', {name}.size,
                'part', {name}.part {sign} {gain} / {name}.size)"""

        return f"""CASE WHEN {first_ends}
            THEN named_struct('done', array_append(s.done, named_struct('row', s.open.row, 'part', {first_part})),
                'open', {document("x", "-")})
            ELSE named_struct('done', array_append(s.done, named_struct('row', x.row, 'part', {1 - first_part})),
                'open', {document("s.open", "+")}) END"""

    return F.expr(f"""aggregate(slice({items}, 2, size({items})),
        named_struct('done', transform(slice({items}, 1, 0), x -> named_struct('row', x.row, 'part', 0)),
            'open', {items}[0]),
        (s, x) -> CASE WHEN {wins} THEN {step(f"{our_rest} <= {theirs}", up, 1)}
            ELSE {step(f"{ours} <= {their_rest}", f"(-{down})", 0)} END)""")


def _round_all(rows: DataFrame, most_docs: int, seed: int) -> DataFrame:
    """Rows (source, row, size, part, grp) with 0 < part < 1: source, row, part 0 or 1."""
    done, level, groups = [], 0, -(-most_docs // GROUP)
    while True:
        toss = _uniform(F.col("row.key"), F.lit(seed), F.lit(level))
        items = F.struct(toss.alias("toss"), "row", "size", "part")
        grouped = rows.groupBy("source", "grp").agg(F.sort_array(F.collect_list(items)).alias("items"))
        level_rows = saved(grouped.select("source", "grp", _rounded("items").alias("r")))
        done.append(level_rows.select("source", F.explode("r.done").alias("x")).select("source", "x.row", "x.part"))
        left = level_rows.select("source", "r.open.row", "r.open.size", "r.open.part", "grp")
        if groups <= 1:
            last = F.when(F.col("part") >= 0.5, 1).otherwise(0)
            return reduce(DataFrame.unionAll, done).unionAll(left.select("source", "row", last.alias("part")))
        rows = left.withColumn("grp", F.floor(F.col("grp") / GROUP))
        level, groups = level + 1, -(-groups // GROUP)


def mixture(
    docs: DataFrame,
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, source, size, source_size, target, copies.

    ``key`` holds two hashes of id, source and text.
    """
    content = ["doc_id", source, "text"]
    key = F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    own = docs.select("doc_id", key.alias("key"), F.col(source).alias("source"), word_count().alias("size"))
    # identical rows are one item with their number m: rounded once, dealt out again at the end
    rows = saved(own.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("m")))
    sources = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"), F.count("*").alias("n_items"))
    plan = saved(targets(sources, weights, share, most).join(sources.select("source", "n_items"), ["source"], "left"))
    plan = plan.withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    most_docs = plan.agg(F.max("n_items")).first()[0] or 0

    ratio = F.coalesce(F.least(F.try_divide(F.col("target"), F.col("source_size")), F.lit(most)), F.lit(0.0))
    known = plan.select(F.col("source").alias("s"), "source_size", "target", "n_items", ratio.alias("ratio"))
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = F.col("ratio") * F.col("m")
    whole, part = F.floor(expected).cast("bigint"), expected - F.floor(expected)
    parts = joined.select("*", whole.alias("whole"), part.alias("part"))

    alone = (F.col("part") == 0) | (F.col("size") == 0)
    by_chance = F.when(_uniform(F.col("key"), F.lit(seed), F.lit(-2)) < F.col("part"), 1).otherwise(0)
    single = parts.where(alone).select("doc_id", "key", "source", "size", "m", (F.col("whole") + by_chance).alias("copies"))

    groups = F.ceil(F.col("n_items") / GROUP)
    paired = parts.where(~alone).select(
        "source",
        F.struct("key", "doc_id", "size", "m", "whole").alias("row"),
        F.col("size").cast("double").alias("size"),
        "part",
        F.pmod(F.xxhash64("key", F.lit(seed)), groups).alias("grp"),
    )
    decided = _round_all(paired, most_docs, seed)
    drawn = decided.select("row.doc_id", "row.key", "source", "row.size", "row.m", (F.col("row.whole") + F.col("part")).alias("copies"))
    items = single.unionByName(drawn)
    return _dealt(items).join(known.select("s", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _dealt(items: DataFrame) -> DataFrame:
    """One row per row an item stands for; its copies dealt as evenly as they go (at most one apart).

    An item of many identical rows is cut into pieces of ``DEAL`` rows that a
    shuffle spreads over tasks before they become rows.
    """
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / DEAL).cast("int") - 1)))
    pieces = pieces.repartition(F.xxhash64("key", "piece"))
    first = F.col("piece") * DEAL
    at = F.explode(F.sequence(first, F.least(first + DEAL, F.col("m")) - 1)).alias("at")
    rows = pieces.select("doc_id", "key", "source", "size", "m", "copies", at)
    share = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("at") < F.col("copies") % F.col("m"), 1).otherwise(0)
    return rows.select("doc_id", "key", "source", "size", share.cast("bigint").alias("copies"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, size, source_size, target, taken."""
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixture(docs).select("doc_id", "size", "source_size", "target", taken)


def mix(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, all columns and ``copies``, how often each is taken.

    Identical rows come back as one with their copies added.  ``copies`` takes the
    place of a column of that name; other columns keep their names, whatever they are.
    """
    content = ["doc_id", source, "text"]
    key = F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    copies = mixture(docs, source, **options).groupBy("key").agg(F.sum("copies").alias("copies"))
    own_key, own_copies = private(docs, "mix_key"), private(docs, "mix_copies")
    taken = copies.where("copies > 0").select(F.col("key").alias(own_key), F.col("copies").alias(own_copies))
    rows = docs.join(taken, key == F.col(own_key)).dropDuplicates([own_key])
    kept = [c for c in docs.columns if c != "copies"]
    return rows.select(*kept, F.col(own_copies).alias("copies"))
