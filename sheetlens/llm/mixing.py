"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target (words the mix takes from it) and a schedule, the
share of its target due by training time t in [0, 1]: the integral of a weight
that changes linearly over time, D(t) = T * (t + a * t * (1 - t)).  A source
whose ``a`` is positive is met early, one with a negative ``a`` late.  A
document copy that starts after c words of its source is due at the time at
which the source's cumulative demand reaches c, so its training position is the
inverse of D at c.  The mix is the copies range-sorted by that position.

Within a source the documents come in the order of a hash of their id; one pass
over all of them is an epoch, and a target above the source's size goes into a
second and third epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.common import _join_null_safe, ordered_prefix, own_names, word_count, written

WEIGHTS = (1.0, 2.0, 3.0)   # by rank of the source in code point order, repeating
CEILING = 3                 # most passes over a source
SLOPES = (0.5, 0.0, -0.5)   # schedule a by rank, repeating: early, even, late
COLUMNS = ["size", "source_size", "target", "taken", "copies", "positions", "position"]  # what the operator adds


def source_targets(sizes: DataFrame, source: str, weights: tuple[float, ...] = WEIGHTS,
                   ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, weight, slope, target) from one row per source.

    Targets share all words by weight; one above ``ceiling`` times its source's
    size stops there and its excess is shared again by weight among the others
    until none is above.  Each round is one aggregate over the sources."""
    names = written(sizes, "mix-sources")
    ranked = _rank(names, source)
    pick = lambda vals: F.element_at(F.array(*[F.lit(float(v)) for v in vals]),
                                     (F.col("rank") % len(vals)).cast("int") + 1)
    ranked = written(ranked.withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES)), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # level: words per unit of weight; ends, as more sources are capped each round
        full = F.lit(float(ceiling)) * F.col("source_size") < F.lit(level) * F.col("weight")
        r = ranked.agg(F.sum(F.when(full, F.col("source_size"))).alias("s"),
                       F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        left = float(total) - ceiling * float(r["s"] or 0)
        if not r["w"] or r["n"] == capped:
            break
        level, capped = left / float(r["w"]), r["n"]
    return ranked.withColumn("target", F.least(F.lit(float(ceiling)) * F.col("source_size"),
                                               F.lit(level) * F.col("weight"))).drop("rank")


def _rank(names: DataFrame, source: str) -> DataFrame:
    """``rank`` from 0 in code point order, null last, without one task for all
    names: a count per leading character, then a row number inside it."""
    head = F.substring(F.coalesce(F.col(source), F.lit("")), 1, 2)
    d = names.withColumn("_null", F.col(source).isNull().cast("int")).withColumn("_head", head)
    w = Window.orderBy("_null", "_head").rowsBetween(Window.unboundedPreceding, -1)
    before = (d.groupBy("_null", "_head").agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("_null", "_head").orderBy(source)
    return (_join_null_safe(d, before, ["_null", "_head"])
            .withColumn("rank", F.col("_off") + F.row_number().over(inside) - 1)
            .drop("_null", "_head", "_off"))


def due(start: Column, target: Column, slope: Column) -> Column:
    """The time in [0, 1] at which the demand of a source has grown to ``start`` words."""
    x = F.least(F.greatest(F.try_divide(start, target), F.lit(0.0)), F.lit(1.0))
    root = F.sqrt(F.greatest((1 + slope) * (1 + slope) - 4 * slope * x, F.lit(0.0)))
    return F.when(slope == 0, x).otherwise(2 * x / ((1 + slope) + root))


def plan(df: DataFrame, source: str, doc_id: str, text: str, weights: tuple[float, ...], ceiling: int,
         size: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``taken``, ``copies`` and ``positions``, in no order.

    All that is counted is counted on a narrow table of one row for each different row
    (two 64-bit hashes of id and text, source, size, number of copies); the texts cross one shuffle."""
    base = df.drop(*COLUMNS)
    n = own_names(base, ["_start", "_key", "_also", "_times", "_slope", "_nth"])
    start, key, also, times, slope, nth = n.values()
    base = (base.withColumn("size", size(F.col(text))).withColumn(key, F.xxhash64(F.col(doc_id), F.col(text), F.col(source)))
            .withColumn(also, F.xxhash64(F.lit(7), F.col(text), F.col(source), F.col(doc_id))))
    units = written(base.groupBy(key, also).agg(F.any_value(source).alias(source), F.any_value("size").alias("size"),
                                                F.count(F.lit(1)).alias(times))
                        .withColumn("words", F.col("size") * F.col(times)), "mix-units")
    sizes = units.groupBy(F.col(source).alias("source")).agg(F.sum("words").alias("source_size"))
    goals = source_targets(sizes, "source", weights, ceiling).select(
        F.col("source").alias(source), "source_size", F.col("slope").alias(slope), "target")
    units = ordered_prefix(units, [source], [F.col(key), F.col(also)], "words", start, F.col(key))
    units = _join_null_safe(units, goals, [source]).select(key, also, start, "source_size", slope, "target")
    d = base.join(units, [key, also])
    again = F.row_number().over(Window.partitionBy(key, also).orderBy(key)) - 1  # among rows alike
    d = d.withColumn(nth, again.cast("long"))
    epochs = F.sequence(F.lit(0), F.lit(ceiling - 1))
    begin = lambda e: F.col(start) + F.col(nth) * F.col("size") + e * F.col("source_size")
    left = lambda e: F.greatest(F.least(F.round("target").cast("long") - begin(e), F.col("size")), F.lit(0))
    return (d.withColumn("taken", F.aggregate(epochs, F.lit(0).cast("long"), lambda s, e: s + left(e)))
             .withColumn("copies", F.aggregate(epochs, F.lit(0), lambda s, e: s + F.when(
                 (F.col("size") > 0) & (begin(e) + F.col("size") / 2 < F.col("target")), 1).otherwise(0)))
             .withColumn("positions", F.transform(
                 F.filter(epochs, lambda e: (F.col("size") > 0) & (begin(e) < F.col("target"))),
                 lambda e: due(begin(e).cast("double"), F.col("target"), F.col(slope))))
             .drop(start, key, also, slope, nth))


def mix(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING,
        size: Callable[[Column], Column] = word_count) -> DataFrame:
    """``df`` with ``size`` (words), ``source_size``, ``target``, ``taken`` (words the
    mix takes, at most ``ceiling`` times the size), ``copies`` (whole documents: a
    copy counts if its middle lies inside the target), ``positions`` (training time
    of each copy that begins inside the target) and ``position`` (the first, null if
    none), range-sorted by position, documents that are not taken last.

    The words of a source are taken up to its target exactly; the document on the
    boundary gives a part.  A null source is a source of its own, ranked last.  Empty
    and null texts have size 0 and take 0 words; rows repeated whole are documents of
    their own; an empty table gives an empty result.  Input columns with the names of
    the new ones are replaced."""
    d = plan(df, source, doc_id, text, weights, ceiling, size).withColumn("position", F.get("positions", F.lit(0)))
    order = [F.col("position").asc_nulls_last(), F.col(doc_id)]
    return d.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_copies(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
                 weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING,
                 size: Callable[[Column], Column] = word_count) -> DataFrame:
    """The training sequence: ``df``'s rows, each as often as the mix takes it whole, with the
    ``position`` of the copy, range-sorted by it.  Documents without words and those beyond
    their source's target are left out; the rest as in :func:`mix`."""
    d = plan(df, source, doc_id, text, weights, ceiling, size)
    d = d.withColumn("position", F.explode(F.slice("positions", 1, F.col("copies"))))
    d = d.drop("size", "source_size", "target", "taken", "copies", "positions")
    return d.repartitionByRange("position", doc_id).sortWithinPartitions("position", doc_id)
