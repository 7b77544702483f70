"""Document fingerprints by Order MinHash.

The units are words, the k-mers ``K`` consecutive words (a shorter text is one
k-mer, an empty one has none).  Each k-mer carries the number of equal k-mers
before it, so repeats count.  A hash of both deals the k-mers over ``SLOTS``
slots; in each slot the ``TUPLE`` k-mers with the least hashes are selected, put
in the order in which they stand in the text, and hashed together.  Two texts
agree in a slot only if the same k-mers are selected in the same order, so
moving text about lowers the likeness, as in edit distance.

One hash deals and ranks, so a text is hashed once, not once per slot.  The
likeness is the share of agreeing slots among those that either text fills; two
empty texts are alike.  All is row-local but for the next document's text.

Null texts count as empty.  Documents are in ascending order of id (null first),
equal ids in the order of their texts' hashes.  Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.shared import cut
from patchloom.operators.parse import fixed_columns

K = 2
SLOTS = 32
TUPLE = 2
EMPTY = "-" * 8
#: SQL of a ranked k-mer's slot, a signed number.
SLOT = f"shiftright({{}}.h, {65 - SLOTS.bit_length()})"


def _kmers(words: str) -> str:
    """SQL: hashes of the k-mers, in text order."""
    parts = ", ".join(f"get({words}, i + {n})" for n in range(K))
    last = f"greatest(size({words}) - {K}, 0)"
    return f"""CASE WHEN size({words}) = 0 THEN cast(array() AS array<bigint>)
        ELSE transform(sequence(0, {last}), i -> xxhash64({parts})) END"""


def _run_starts(rows: str, value: str) -> str:
    """SQL: positions in the sorted array ``rows`` at which ``value`` (of one row) changes; none for no rows."""
    changes = f"i = 0 OR {value.format(f'get({rows}, i)')} <> {value.format(f'get({rows}, i - 1)')}"
    found = f"filter(sequence(0, size({rows}) - 1), i -> {changes})"
    return f"CASE WHEN size({rows}) > 0 THEN {found} ELSE cast(array() AS array<int>) END"


def with_signature(df: DataFrame, text: str, keep: list[str], name: str) -> DataFrame:
    """``keep`` columns and ``name``: an array of ``SLOTS`` hashes, null where a slot is empty.

    Sorted k-mers give the occurrence numbers: a k-mer's distance from the start
    of its run.  Where all k-mers differ, which is the usual case, every number is
    0 and that sort is left out.  Sorted by the numbered hashes, whose upper bits
    are the slot, the k-mers of a slot stand together, least first.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    step = fixed_columns(df, keep, w=words)
    step = fixed_columns(step, keep, kmers=F.expr(_kmers("w")))
    placed = "transform(kmers, (h, i) -> named_struct('h', h, 'i', i))"
    repeats = "size(array_distinct(kmers)) < size(kmers)"
    step = fixed_columns(step, [*keep, "kmers"], runs=F.expr(f"CASE WHEN {repeats} THEN sort_array({placed}) END"))
    starts = f"CASE WHEN runs IS NOT NULL THEN {_run_starts('runs', '{}.h')} END"
    step = fixed_columns(step, [*keep, "kmers", "runs"], starts=F.expr(starts))
    end = "coalesce(get(starts, j + 1), size(runs))"
    numbers = f"flatten(transform(starts, (p, j) -> sequence(0, {end} - p - 1)))"
    step = fixed_columns(step, [*keep, "kmers", "runs"], numbers=F.expr(numbers))
    unlike = "transform(kmers, (h, i) -> named_struct('h', xxhash64(h, 0), 'i', i))"
    repeated = "transform(runs, (x, i) -> named_struct('h', xxhash64(x.h, get(numbers, i)), 'i', x.i))"
    ranked = f"sort_array(CASE WHEN runs IS NULL THEN {unlike} ELSE {repeated} END)"
    step = fixed_columns(step, keep, ranked=F.expr(ranked))
    step = fixed_columns(step, [*keep, "ranked"], firsts=F.expr(_run_starts("ranked", SLOT)))
    count = f"least({TUPLE}, coalesce(get(firsts, j + 1), size(ranked)) - p)"
    chosen = f"array_sort(slice(ranked, p + 1, {count}), (a, b) -> a.i - b.i)"
    value = f"aggregate({chosen}, 42L, (s, x) -> xxhash64(s, x.h))"
    entry = f"named_struct('slot', {SLOT.format('get(ranked, p)')}, 'v', {value})"
    step = fixed_columns(step, keep, entries=F.expr(f"map_from_entries(transform(firsts, (p, j) -> {entry}))"))
    slots = f"transform(sequence({-SLOTS // 2}L, {SLOTS // 2 - 1}L), slot -> element_at(entries, slot))"
    return fixed_columns(step, keep, **{name: F.expr(slots)})


def text_form(signature: str) -> Column:
    """The signature as text: 8 hex digits a slot, dashes for an empty one."""
    return F.expr(f"array_join(transform({signature}, v -> coalesce(lower(lpad(hex(v & 4294967295L), 8, '0')), '{EMPTY}')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of agreeing slots among those that either fills; 1 if both are empty."""
    low = "& 4294967295L"
    same = f"size(filter(sequence(0, {SLOTS - 1}), i -> ({a}[i] {low}) = ({b}[i] {low})))"
    filled = f"size(filter(sequence(0, {SLOTS - 1}), i -> {a}[i] IS NOT NULL OR {b}[i] IS NOT NULL))"
    return F.expr(f"CASE WHEN {filled} = 0 THEN 1.0D ELSE cast({same} AS double) / {filled} END")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds below the id, found among every n-th bound first."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*map(F.lit, bounds[step - 1 :: step])).cast("array<bigint>")
    fine = F.array(*map(F.lit, bounds)).cast("array<bigint>")

    def below(x: Column) -> Column:
        return F.coalesce(x < doc_id, F.lit(False))

    skipped = F.size(F.filter(coarse, below)) * step
    return skipped + F.size(F.filter(F.slice(fine, skipped + 1, F.lit(step)), below))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, signature, next_text, next_signature); after the last document comes the first.

    Ids are cut into ranges at quantiles, at most ``ranges``.  Each range gets a
    copy of the first row of the next range that has rows, so that a window over
    the range finds every next row; the texts are shuffled once.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / wanted for k in range(1, wanted)] or [0.5]
    bounds = own.select(F.percentile_approx("doc_id", shares, 20 * wanted)).first()[0] or []
    place = _range_of(F.col("doc_id"), sorted(set(bounds)))
    h = F.xxhash64("text")
    ranged = own.select("*", place.alias("range"), h.alias("h"), F.lit(False).alias("guest"))
    first = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    everything = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    before = F.coalesce(F.lag("range").over(everything), last).alias("to_range")
    keys = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), before)
    # one key per range
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    guests = ranged.join(F.broadcast(cut(keys)), same)
    guests = guests.select("doc_id", "text", F.col("to_range").alias("range"), "h", F.lit(True).alias("guest"))
    both = ranged.unionByName(guests)
    signed = with_signature(both, "text", ["doc_id", "text", "range", "h", "guest"], "signature")
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "h")
    rows = signed.select(
        "doc_id",
        "text",
        "guest",
        "signature",
        F.lead("text").over(order).alias("next_text"),
        F.lead("signature").over(order).alias("next_signature"),
    )
    return rows.where(~F.col("guest")).drop("guest")


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text ends in as many code points of the next document as a quarter
    of the text has, in place of its own last quarter.
    """
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = with_next(docs)
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter))
    fixed = ["doc_id", "signature", "next_signature"]
    rows = fixed_columns(rows, fixed, n_chars=n.cast("bigint"), edited=edited)
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_signature(rows, "edited", [*fixed, "n_chars", "edited_sha256"], "edited_signature")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form("signature").alias("fingerprint"),
        text_form("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )
