"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words. The document rates r are those nearest to 1 in relative entropy (with the upper
bound ``MOST``) whose words meet the targets; the convex dual has one multiplier a source, and its solution is the
exponentially tilted rate r = MOST / (1 + (MOST - 1) exp(-lambda size / scale)). Newton steps, kept inside a bracket,
run for all sources at once over counts of (source, size). Rates are then rounded into whole copies: a hash of the
document decides its fraction, and thresholds per source, found in histograms, are set first for its large documents
and then for its small ones, so that the source's words come nearest to its target. A decision depends on a row and its source's numbers only, so a source
with a third of all rows needs no group, sort or join of its own. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biotally.llm.words import id_column, text_column
from biotally.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3  # times its words that a source or a document may give
ROUNDS, EXACT = 80, 1e-11
SMALL = 0.25  # of a source's mean size by words: documents that are rounded last
_BINS = 1024  # histogram bins to a unit of the rounding key, and again within the crossing bin
_SEP = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Runs of characters outside the six separators, without making an array of them; null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"{_SEP}+$", "")
    return F.length(F.regexp_replace(trimmed, _SEP + "*" + r"[^\x20\x09-\x0D]+", "1")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, squares, target) from counts (source, size, n).

    Sources by code point, null last, weigh WEIGHTS in turn and share all words. A share above MOST times the source
    is cut to that, and the excess goes to the others by weight. In order of the cap for each unit of weight, the
    sources whose cap lies below what a unit of weight would get are the capped ones.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum((F.col("size") * F.col("size") * F.col("n")).cast("double")).alias("squares"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    w = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), (place + 1).cast("int")).cast("long")
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = per.withColumn("w", w).withColumn("cap", MOST * F.col("source_size"))
    t = t.withColumn("all", F.sum("source_size").over(every)).withColumn("below", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("w").over(after))
    t = t.withColumn("capped", F.col("cap") * F.col("weights") < (F.col("all") - F.col("below")) * F.col("w"))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (left.cast("double") / free))).select("source", "source_size", "squares", "target", "capped")


def _rate(size: Column, mark: str = "") -> Column:
    """The tilted rate of a document of ``size`` words under the columns ``lambda``, ``scale`` and ``capped``."""
    tilt = F.exp(-F.col(f"{mark}lambda") * size / F.col(f"{mark}scale"))
    return F.when(F.col(f"{mark}capped"), F.lit(float(MOST))).otherwise(MOST / (1 + (MOST - 1) * tilt))


def solve_dual(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The multiplier of every source by bracketed Newton steps; capped and empty sources need none."""
    scale = F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(F.lit(1.0))
    state = targets.withColumns({"scale": scale, "lambda": F.lit(0.0), "lo": F.lit(-1e9), "hi": F.lit(1e9), "capped": F.col("capped") | (F.col("source_size") == 0), "miss": F.lit(1.0)})
    columns = state.columns
    state = cut_lineage(state)
    for _ in range(ROUNDS):
        s = state.withColumnRenamed("source", "s")
        r, z = _rate(F.col("size")), F.col("size") / F.col("scale")
        met = sizes.join(s, F.col("source").eqNullSafe(F.col("s")))
        sums = met.groupBy("s").agg(F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(F.col("n") * F.col("size") * z * r * (1 - r / MOST)).alias("slope"))
        gap = F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("words") - F.col("target"))
        lo = F.when(gap < 0, F.col("lambda")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lambda")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.greatest(F.lit(-8.0), F.least(F.lit(8.0), -gap / F.col("slope")))).otherwise(-8 * F.signum(gap))
        newton = F.col("lambda") + step
        inside = (newton > F.col("lo2")) & (newton < F.col("hi2"))
        found = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({"lo2": lo, "hi2": hi, "miss": F.abs(F.coalesce(gap, F.lit(0.0))) / F.greatest(F.col("target"), F.lit(1.0))})
        moved = F.when(F.coalesce(gap, F.lit(0.0)) == 0, F.col("lambda")).when(inside, newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        state = cut_lineage(found.withColumn("lambda", moved).withColumn("lo", F.col("lo2")).withColumn("hi", F.col("hi2")).select(*columns))
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= EXACT:
            break
    return state.withColumn("lambda", F.round("lambda", 8))  # order of addition must not show


def _keys(size: Column, doc: Column, rate: Column) -> list[Column]:
    """Where each possible copy of a document stands among those of its source: keys in (-MOST, MOST).

    The copies with a key below 0 are the rate, rounded by the document's hash alone; a higher threshold gives more.
    """
    u = (F.pmod(F.xxhash64(doc, size), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return [u - rate + j for j in range(MOST)]


def _place(key: Column) -> tuple[Column, Column]:
    """Histogram bin of a key and its part of the bin."""
    at = (key + MOST) * _BINS
    return F.floor(at).cast("int"), F.floor((at - F.floor(at)) * _BINS).cast("int")


def _thresholds(bins: DataFrame, need: DataFrame) -> DataFrame:
    """(s, cross, cut, got): for each source the bin and part up to which copies are given, and their words.

    ``bins`` has source, bin, part, words; ``need`` has s and need. The first bin whose words pass the need is cut at
    the part that comes nearest to it.
    """
    coarse = bins.groupBy("source", "bin").agg(F.sum("words").alias("words")).join(need, F.col("source").eqNullSafe(F.col("s")))
    upto = coarse.withColumn("run", F.sum("words").over(Window.partitionBy("s").orderBy("bin"))).select("s", "need", "bin", "words", "run")
    crossing = upto.groupBy("s").agg(
        F.coalesce(F.min(F.when(F.col("run") > F.col("need"), F.col("bin"))), F.lit(2 * MOST * _BINS)).alias("cross"),
        F.coalesce(F.max(F.when(F.col("run") <= F.col("need"), F.col("run"))), F.lit(0)).alias("have"),
        F.max("need").alias("need"),
    )
    fine = bins.join(crossing, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cross")))
    fine = fine.withColumn("more", F.sum("words").over(Window.partitionBy("s").orderBy("part")))
    fine = fine.withColumn("miss", F.abs(F.col("have") + F.col("more") - F.col("need")))
    best = fine.groupBy("s").agg(F.min(F.struct("miss", "part", "more")).alias("b")).select(F.col("s").alias("bs"), "b")
    nearer = F.col("b.miss") < F.abs(F.col("need") - F.col("have"))
    return crossing.join(best, F.col("s").eqNullSafe(F.col("bs")), "left").select(
        "s", "cross", F.when(nearer, F.col("b.part")).otherwise(F.lit(-1)).alias("cut"), (F.col("have") + F.when(nearer, F.col("b.more")).otherwise(F.lit(0))).alias("got")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, rate, copies and taken (replacing columns of these names).

    taken is copies * size. A document has 0 to MOST copies. Null text and blank text have size 0; a null source is a
    source; rows equal in id and size are rounded alike; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies", "taken")]
    made = {"_size": word_count(text_column(docs, text_col)), "_source": text_column(docs, source_col), "_doc": id_column(docs, id_col)}
    sized = docs.select(*(docs[c] for c in names), *(c.alias(k) for k, c in made.items()))
    rows = cut_lineage(sized.select("_doc", F.col("_source").alias("source"), F.col("_size").alias("size")))
    counts = cut_lineage(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    state = cut_lineage(solve_dual(counts, cut_lineage(source_targets(counts))).select("source", "source_size", "target", "capped", "lambda", "scale"))
    solved = state.withColumnRenamed("source", "s")

    rate = _rate(F.col("size"))
    met = rows.join(solved, F.col("source").eqNullSafe(F.col("s"))).withColumns({"rate": rate, "big": F.col("size") > SMALL * F.col("scale")})
    wanted = met.where("big").groupBy("source").agg(F.round(F.sum(F.col("size") * F.col("rate")), 3).alias("need"))
    keyed = met.select("source", "size", "big", F.explode(F.array(*_keys(F.col("size"), F.col("_doc"), F.col("rate")))).alias("key"))
    at, part = _place(F.col("key"))
    bins = cut_lineage(keyed.groupBy("source", "big", at.alias("bin"), part.alias("part")).agg(F.sum("size").alias("words")))
    # Large documents first, each source's to their own share; then the small ones make good what is left.
    large = cut_lineage(_thresholds(bins.where("big"), wanted.withColumnRenamed("source", "s")))
    large = large.select(F.col("s").alias("_ls"), F.col("cross").alias("_cross1"), F.col("cut").alias("_cut1"), "got")
    left = state.join(large, F.col("source").eqNullSafe(F.col("_ls")), "left")
    small = _thresholds(bins.where("not big"), left.select(F.col("source").alias("s"), (F.col("target") - F.coalesce("got", F.lit(0))).alias("need")))
    small = small.select(F.col("s").alias("_fs"), F.col("cross").alias("_cross0"), F.col("cut").alias("_cut0"))
    decided = solved.join(large, F.col("s").eqNullSafe(F.col("_ls")), "left").join(small, F.col("s").eqNullSafe(F.col("_fs")), "left")
    numbers = cut_lineage(decided.select(*(F.col(c).alias(f"_{c}") for c in ("s", "source_size", "target", "capped", "lambda", "scale")), "_cross1", "_cut1", "_cross0", "_cut0"))

    size = F.col("_size")
    met = sized.join(numbers, F.col("_source").eqNullSafe(F.col("_s")))
    rate = _rate(size, "_")
    big = size > SMALL * F.col("_scale")
    cross, cut = (F.when(big, F.col(f"_{c}1")).otherwise(F.col(f"_{c}0")) for c in ("cross", "cut"))
    copies = F.lit(0).cast("long")
    for key in _keys(size, F.col("_doc"), rate):
        at, part = _place(key)
        copies = copies + F.when((at < cross) | ((at == cross) & (part <= cut)), 1).otherwise(0)
    return met.select(*(F.col(f"`{c}`") for c in names), size.alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), rate.alias("rate"), copies.alias("copies"), (copies * size).alias("taken"))
