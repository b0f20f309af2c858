"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each document gets a rate r in [0, cap]: how often the mix takes it. Among all rates that meet the word target of
their source, the ones nearest to 1 in relative entropy are wanted; their form is the exponential tilt
r = cap / (1 + (cap - 1) exp(-lambda * size / mean size)), with one dual variable lambda for each source. The dual is
convex and smooth; Newton's iterations, kept inside a shrinking bracket, solve it. They need sums over documents only,
and as documents of one source and size have one rate, the sums run over the histogram (source, size, documents),
which is exact and small. Nothing of it goes to the driver but one number for each iteration, the largest error.

Rates become copies by systematic rounding: inside a source, cells of the histogram in order of size turn their
cumulative rates into whole copies, so that counting errors stay under one copy everywhere. What is left of the target
is then paid off by moving single copies in the cells whose size fits it best. A cell's copies are dealt to
its documents by rank in hash order; the ranks are counted in bounded buckets, so that one hot cell is no hot task.

Defined results: null text has size 0; documents of size 0 are taken 0 words; null sources form one source, last in
order; ties in rank go by identifier hash, then identifier; repeated rows are separate documents; an empty table gives
an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.storage import discard, materialize, numbered, unused

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1000
#: A share of its target by which a source may be off when the rounds are over.
LEAST_MISS = 1e-6
SAME = lambda a, b: a.eqNullSafe(b)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target. sizes: source, size, n (documents).

    Targets are min(cap * size, level * weight), with the level at which they add up; it follows from cumulative sums
    in the order in which sources reach the cap. One row for each source; the windows see those rows only.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    by = by.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by = by.withColumns({"total": F.sum("source_size").over(everything) * F.lit(float(share)), "full": F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    # The level if all before this source are full and the rest are not; the first source that stays below its cap sets it.
    by = by.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct((F.col("top") / F.col("weight")).alias("place"), "level"))).over(everything)
    level = first.getField("level")
    target = F.least(F.col("top"), F.coalesce(level * F.col("weight"), F.col("top")))
    return by.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("n_docs").cast("long").alias("n_docs"), target.alias("target"))


def _rate(cap: float) -> Column:
    """Rates for lambda `lam`; saturated where the target can only be met by the cap or by nothing."""
    tilt = F.lit(cap) / (1 + F.lit(cap - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("lam") * F.col("x")))))
    return F.when(F.col("target") >= F.col("source_size") * F.lit(cap), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilt)


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-9, max_rounds: int = 60) -> DataFrame:
    """targets with lambda. cells: source, size, n."""
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    state = targets.withColumns({"mean": mean, "lam": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "miss": F.lit(1e300)})
    first, worst = True, 0.0
    for _ in range(max_rounds):
        s, c = state.alias("s"), cells.alias("c")
        rows = c.join(s, SAME(F.col("c.source"), F.col("s.source"))).filter("size > 0").select("s.*", "c.size", "c.n").withColumn("x", F.col("size") / F.col("mean"))
        rate = _rate(cap)
        sums = rows.groupBy("source").agg(F.sum(rate * F.col("size") * F.col("n")).alias("mass"), F.sum(rate * (1 - rate / cap) * F.col("x") * F.col("size") * F.col("n")).alias("slope"))
        m = sums.alias("m")
        gap = F.col("mass") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.col("slope")
        wide = (high - low) > 1e5
        inside = F.when(wide, F.when(gap < 0, F.greatest(F.lit(1.0), F.abs("lam") * 4)).otherwise(F.least(F.lit(-1.0), -F.abs("lam") * 4))).otherwise((low + high) / 2)
        lam = F.when(F.col("mass").isNull() | (gap == 0), F.col("lam")).when((F.col("slope") > 0) & (step > low) & (step < high) & (F.abs(step - F.col("lam")) <= 4 + F.abs("lam")), step).otherwise(inside)
        forced = F.col("mass").isNull() | (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * F.lit(cap))
        miss = F.when(forced, F.lit(0.0)).otherwise(F.abs(gap) / F.col("target"))
        before, state = state, materialize(state.alias("s").join(m, SAME(F.col("s.source"), F.col("m.source")), "left").select("s.source", "source_size", "n_docs", "target", "mean", F.when(miss <= tolerance, F.col("lam")).otherwise(lam).alias("lam"), low.alias("low"), high.alias("high"), miss.alias("miss")), "dual")
        if first:
            first = False
        else:
            discard(before)
        worst = state.agg(F.max("miss")).first()[0] or 0.0
        if worst <= tolerance:
            return state
    if worst > LEAST_MISS:
        raise RuntimeError(f"a target is still missed by {worst:.2g} of it after {max_rounds} rounds")
    return state


def copies_per_cell(cells: DataFrame, state: DataFrame, cap: int = 2, repairs: int = 8) -> DataFrame:
    """source, size, n, copies (0 to cap * n), source_size, target."""
    rows = cells.alias("c").join(state.alias("s"), SAME(F.col("c.source"), F.col("s.source"))).select("c.source", "c.size", "c.n", "source_size", "target", "lam", (F.col("size") / F.col("mean")).alias("x"))
    # Cells are numbered inside bands of sizes, and bands are summed up before: no task orders a whole source.
    band = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    rows = rows.withColumns({"mass": _rate(float(cap)) * F.col("n"), "band": band})
    bands = rows.groupBy("source", "band").agg(F.sum("mass").alias("band_mass"))
    before = F.coalesce(F.sum("band_mass").over(Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bands = bands.select(F.col("source").alias("b_source"), F.col("band").alias("b_band"), before.alias("before"))
    rows = rows.join(bands, SAME(F.col("source"), F.col("b_source")) & (F.col("band") == F.col("b_band")))
    upto = F.col("before") + F.sum("mass").over(Window.partitionBy("source", "band").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    copies = F.greatest(F.lit(0), F.least(F.col("n") * cap, F.round(upto) - F.round(upto - F.col("mass")))).cast("long")
    out = materialize(rows.select("source", "size", "n", copies.alias("copies"), "source_size", "target"), "copies")
    for _ in range(repairs):
        # The largest size that the remaining gap holds, and as many of its copies as fit, for each source.
        sums = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("goal"))
        open_ = out.alias("o").join(sums.alias("t"), SAME(F.col("o.source"), F.col("t.source"))).select("o.*", (F.round("goal") - F.col("taken")).alias("gap"))
        room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = open_.filter((F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (room > 0))
        best = fits.groupBy("source").agg(F.max(F.struct("size", (F.signum("gap") * F.least(room, F.floor(F.abs("gap") / F.col("size")))).cast("long").alias("move"))).alias("best"))
        best = best.select(F.col("source").alias("b_source"), F.col("best.size").alias("b_size"), F.col("best.move").alias("move"))
        before, moved = out, out.join(best, SAME(F.col("source"), F.col("b_source")) & (F.col("size") == F.col("b_size")), "left")
        out = materialize(moved.select("source", "size", "n", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies"), "source_size", "target"), "copies")
        done = best.isEmpty()
        discard(before)
        if done:
            break
    return out


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies."""
    docs = materialize(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    return assign_copies(docs, weights, share, cap).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def assign_copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """docs (doc_id, source, size, more) with copies, source_size and target. docs must be materialised."""
    cells = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = materialize(source_targets(cells, weights, share, float(cap)), "targets")
    cells = copies_per_cell(cells, solve_dual(cells, targets, float(cap)), cap)
    # Cells in which all documents get as many copies need no ranks; in the others, ranks are counted by bucket.
    whole = (F.col("copies") % F.col("n")) == 0
    cells = cells.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "n", F.col("copies").alias("cell_copies"), "source_size", "target", whole.alias("whole"), F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("buckets"))
    at = SAME(F.col("source"), F.col("c_source")) & (F.col("size") == F.col("c_size"))
    hashed = F.xxhash64(F.col("doc_id"))
    rows = docs.withColumn("__h", hashed).join(cells, at)
    even = rows.filter("whole").withColumn("copies", (F.col("cell_copies") / F.col("n")).cast("long"))
    # Dealt by bucket, so that AQE may split a hot cell in the join before, and no window after it holds the whole cell.
    odd = rows.filter("not whole").withColumn("bucket", F.pmod("__h", F.col("buckets"))).repartition("source", "size", "bucket")
    counts = odd.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("bucket").alias("k_bucket"), before.alias("before"))
    odd = odd.join(counts, SAME(F.col("source"), F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("bucket") == F.col("k_bucket")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("__h", "doc_id")) - 1
    copies = F.floor(F.col("cell_copies") / F.col("n")) + F.when(rank < F.col("cell_copies") % F.col("n"), 1).otherwise(0)
    odd = odd.withColumn("copies", copies.cast("long"))
    keep = [*docs.columns, "source_size", "target", "copies"]
    return even.select(*keep).unionByName(odd.select(*keep))


def repeat_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """df with each row as often as the mix takes it, rows without words too; df may be any frame, as its rows are numbered once."""
    names = df.columns
    own, row = numbered(df, "numbered")
    narrow = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.col(row).alias("row"))
    times, place, copy = (unused(own, x) for x in ("times", "place", "copy"))
    copies = assign_copies(materialize(narrow, "sizes"), weights, share, cap).filter("copies > 0").select(F.col("row").alias(place), F.col("copies").cast("int").alias(times))
    joined = own.join(copies, F.col(row) == F.col(place))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
