"""Row classification: one CASE WHEN over the profile, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.cells import first_non_empty, held
from sheetlens.model import NO_RULE, SHEET_KEY, UNKNOWN
from sheetlens.operators.profiles import Profile
from sheetlens.operators.rules import RuleContext

_FNE = "_first_non_empty"
_DEF = "_def_idx"


def _prepare(rows: DataFrame, profile: Profile, cells: str):
    profile.validate()
    ctx = RuleContext(cells=cells, first_non_empty=_FNE)
    # the first non-empty cell is computed once per row, shared by every colour rule
    return rows.withColumn(_FNE, first_non_empty(cells)), ctx, profile.definitions


def _literal_array(values, cast=None):
    arr = F.array(*[F.lit(v) for v in values])
    return arr.cast(f"array<{cast}>") if cast else arr


def classify(rows: DataFrame, profile: Profile, cells: str = "cells") -> DataFrame:
    """Add ``row_type, matched_rule, confidence`` to every row (first matching
    definition in priority order; none -> Unknown / 'none' / 0.0)."""
    df, ctx, defs = _prepare(rows, profile, cells)
    idx = None
    for i, d in enumerate(defs):
        cond = d.rule.to_column(ctx)
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    df = df.withColumn(_DEF, idx.otherwise(F.lit(-1)))
    types = _literal_array([d.row_type for d in defs])
    names = _literal_array([d.rule.name for d in defs])
    confs = _literal_array([float(d.rule.confidence()) for d in defs], "float")
    return (df.withColumn("row_type", F.coalesce(F.get(types, F.col(_DEF)), F.lit(UNKNOWN)))
              .withColumn("matched_rule", F.coalesce(F.get(names, F.col(_DEF)), F.lit(NO_RULE)))
              .withColumn("confidence", F.coalesce(F.get(confs, F.col(_DEF)), F.lit(0.0).cast("float")))
              .drop(_FNE, _DEF))


def _evaluations(df: DataFrame, ctx: RuleContext, defs) -> "F.Column":
    return F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(d.priority).alias("priority"),
                 F.lit(d.rule.name).alias("rule"), F.lit(d.row_type).alias("row_type"),
                 d.rule.to_column(ctx).alias("matched"))
        for i, d in enumerate(defs)])


def all_matches(rows: DataFrame, profile: Profile, cells: str = "cells") -> DataFrame:
    """Add ``matches``: every matching definition (idx, priority, rule, row_type)."""
    df, ctx, defs = _prepare(rows, profile, cells)
    return (df.withColumn("matches", F.filter(_evaluations(df, ctx, defs), lambda e: e["matched"]))
              .withColumn("matches", F.transform("matches", lambda e: e.dropFields("matched")))
              .drop(_FNE))


def conflicts(rows: DataFrame, profile: Profile, cells: str = "cells") -> DataFrame:
    """One row per pair of matching definitions of equal priority (i < j).

    The pairs are over profile definitions, so a row yields at most
    len(profile)^2 / 2 of them regardless of data size.
    """
    m = all_matches(rows, profile, cells)
    pairs = F.flatten(F.transform("matches", lambda a: F.transform(
        F.filter("matches", lambda b: (b["idx"] > a["idx"]) & (b["priority"] == a["priority"])),
        lambda b: F.struct(a["priority"].alias("priority"), a["rule"].alias("rule1"),
                           a["row_type"].alias("type1"), b["rule"].alias("rule2"),
                           b["row_type"].alias("type2")))))
    keep = [c for c in rows.columns if c != cells]
    return m.select(*keep, F.inline(pairs))


def explain_rows(rows: DataFrame, profile: Profile, cells: str = "cells") -> DataFrame:
    """Debug trace: each definition evaluated for a row, in order, up to and
    including the first match (all of them when nothing matches)."""
    df, ctx, defs = _prepare(held(rows, cells), profile, cells)
    ev = _evaluations(df, ctx, defs)
    keep = [c for c in rows.columns if c != cells]
    df = held(df.withColumn("_ev", ev), "_ev")       # read three times below
    first = F.array_min(F.transform(F.filter("_ev", lambda e: e["matched"]), lambda e: e["idx"]))
    df = held(df.withColumn("_win", F.coalesce(first, F.lit(len(defs)))), "_win")
    trace = F.filter("_ev", lambda e: e["idx"] <= F.col("_win"))
    return df.select(*keep, F.inline(F.transform(trace, lambda e: F.struct(
        (e["idx"] + 1).alias("step"), e["row_type"].alias("row_type"), e["rule"].alias("rule"),
        e["priority"].alias("priority"), e["matched"].alias("matched")))))


def statistics(classified: DataFrame, by=SHEET_KEY, profile: Profile | None = None) -> DataFrame:
    """Per sheet: total rows, Unknown count, success rate (0..1, 0 when empty)
    and the per-type counts as a map of the types present (Unknown included).

    With the ``profile`` that classified the rows, its row types are known on
    the driver and everything is one aggregation (a conditional count per
    type, combined map-side); without it, counts per (sheet, type) are
    aggregated again per sheet."""
    by = list(by)
    rate = lambda: F.when(F.col("total_rows") > 0,
                          (F.col("total_rows") - F.col("unknown_count")) / F.col("total_rows")) \
        .otherwise(F.lit(0.0)).cast("float")
    if profile is not None:
        types = list(dict.fromkeys([d.row_type for d in profile.definitions] + [UNKNOWN]))
        rt = F.col("row_type")
        agg = classified.groupBy(*by).agg(
            F.count(F.lit(1)).alias("total_rows"),
            *[F.count_if(rt == F.lit(t)).alias(f"_n{i}") for i, t in enumerate(types)])
        counts = F.map_filter(F.map_from_arrays(F.array(*[F.lit(t) for t in types]),
                                                F.array(*[F.col(f"_n{i}") for i in range(len(types))])),
                              lambda k, v: v > 0)
        return (agg.withColumn("unknown_count", F.col(f"_n{types.index(UNKNOWN)}"))
                   .withColumn("row_type_counts", counts)
                   .select(*by, "total_rows", "unknown_count", "row_type_counts")
                   .withColumn("success_rate", rate()))
    per_type = classified.groupBy(*by, "row_type").agg(F.count(F.lit(1)).alias("n"))
    return per_type.groupBy(*by).agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("row_type") == UNKNOWN, F.col("n"))), F.lit(0)).alias("unknown_count"),
        F.map_from_entries(F.collect_list(F.struct("row_type", "n"))).alias("row_type_counts"),
    ).withColumn("success_rate", rate())


def type_counts(classified: DataFrame, by=()) -> DataFrame:
    """Long-form counts per row type (optionally per sheet)."""
    return classified.groupBy(*by, "row_type").agg(F.count(F.lit(1)).alias("n_rows"))
