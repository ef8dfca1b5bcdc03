"""Profiles as tables: rules are rows, joined to sheet rows by profile name.

Rows of files with different profiles are classified in one job, and a profile is changed
by writing a table, not code.  A rule is kept in postfix order: its leaves, and after the
last child of an AND / OR a step that takes the children's results off a stack.  One
higher-order expression evaluates whatever rules the joined row brings along.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.cells import column_span, first_non_empty, held
from sheetlens.functions.text import utrim
from sheetlens.model import NO_RULE, UNKNOWN, WHITE
from sheetlens.operators.numbering import explicit_partitions
from sheetlens.operators.patterns import java_pattern, may_backtrack
from sheetlens.operators.profiles import Profile
from sheetlens.operators.rules import (
    ColorRule, CompositeRule, Contains, Exact, MergedAcross, MergedMinColumns, MergeRule, NotMerged, Regex, Rule,
    TextRule, color_hex,
)

STEP = T.StructType([
    T.StructField("op", T.StringType()),         # color, exact, contains, regex, across, columns, unmerged, and, or, never
    T.StructField("column", T.IntegerType()),    # null: the first non-empty cell
    T.StructField("text", T.StringType()),       # colour, text or Java pattern
    T.StructField("lower", T.BooleanType()),     # compare in lower case
    T.StructField("low", T.IntegerType()),       # first column of a merge, least span, or children of and / or
    T.StructField("high", T.IntegerType()),      # last column of a merge
])
RULE_TABLE = T.StructType([
    T.StructField("profile", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("row_type", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("confidence", T.FloatType()),
    T.StructField("steps", T.ArrayType(STEP)),
])
BROADCAST_BYTES = 4 << 20   # of all profiles as JSON; larger ones are joined on salted keys


def _steps(rule: Rule) -> list[tuple]:
    if isinstance(rule, CompositeRule):
        return [s for r in rule.children() for s in _steps(r)] + [(rule.logic, None, None, None, len(rule.rules), None)]
    if isinstance(rule, ColorRule):
        return [("color", rule.column_index, color_hex(rule.color), False, None, None)]
    if isinstance(rule, MergeRule):
        r = rule.requirement
        if isinstance(r, MergedAcross):
            return [("across", None, None, None, r.start_col, r.end_col)]
        if isinstance(r, MergedMinColumns):
            return [("columns", None, None, None, r.n, None)]
        if isinstance(r, NotMerged):
            return [("unmerged", None, None, None, None, None)]
    if isinstance(rule, TextRule):
        p, lower = rule.pattern, not rule.case_sensitive
        if isinstance(p, Regex):
            java = java_pattern(p.pattern, rule.case_sensitive)
            if java is not None and may_backtrack(java):
                raise ValueError(f"rule {rule.name!r}: {p.pattern!r} may backtrack without bound; use it in a profile, not in a table")
            return [("never" if java is None else "regex", rule.column_index, java, False, None, None)]
        if isinstance(p, (Exact, Contains)):
            return [("exact" if isinstance(p, Exact) else "contains", rule.column_index, p.text, lower, None, None)]
    raise ValueError(f"rule {rule.name!r} of type {type(rule).__name__} cannot be kept in a table")


def rule_table(spark: SparkSession, profiles: Mapping[str, Profile]) -> DataFrame:
    """(profile, position, priority, row_type, rule, confidence, steps) of the definitions of named profiles.
    Rules with user code and regexes that need the linear-time matcher are refused; an invalid regex never
    matches."""
    rows = []
    for name, profile in profiles.items():
        profile.validate()
        rows += [(name, i, int(d.priority), d.row_type, d.rule.name, float(d.rule.confidence()), _steps(d.rule))
                 for i, d in enumerate(profile.definitions)]
    return spark.createDataFrame(rows, RULE_TABLE)


def _leaf(step: Column, cells: Column, first: Column) -> Column:
    cell = F.when(step["column"].isNull(), first).otherwise(F.get(cells, step["column"]))
    fold = lambda c: F.when(step["lower"], F.lower(c)).otherwise(c)
    text = utrim(cell["content"])
    op = step["op"]
    return F.coalesce(
        F.when(op == "color", cell.isNotNull() & (F.coalesce(cell["style"]["background_color"], F.lit(WHITE)) == step["text"]))
         .when(op == "exact", fold(text) == fold(step["text"]))
         .when(op == "contains", F.contains(fold(text), fold(step["text"])))
         .when(op == "regex", F.rlike(text, step["text"]))
         .when(op == "across", F.exists(cells, lambda c: (c["merge_info"]["start_col"] == step["low"])
                                        & (c["merge_info"]["end_col"] == step["high"])))
         .when(op == "columns", F.exists(cells, lambda c: column_span(c["merge_info"]) >= step["low"]))
         .when(op == "unmerged", F.forall(cells, lambda c: c["merge_info"].isNull())),
        F.lit(False))


def _holds(steps: Column, cells: Column, first: Column) -> Column:
    """The value that is left on the stack when all steps are done."""

    def step(stack: Column, s: Column) -> Column:
        rest = F.size(stack) - s["low"]
        taken = F.slice(stack, rest + 1, s["low"])
        return (F.when(s["op"] == "and", F.concat(F.slice(stack, 1, rest), F.array(F.forall(taken, lambda x: x))))
                 .when(s["op"] == "or", F.concat(F.slice(stack, 1, rest), F.array(F.exists(taken, lambda x: x))))
                 .otherwise(F.concat(stack, F.array(_leaf(s, cells, first)))))

    return F.get(F.aggregate(steps, F.array().cast("array<boolean>"), step), F.lit(0))


def classify_by_table(rows: DataFrame, rules: DataFrame, profile: str = "profile", cells: str = "cells",
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``row_type, matched_rule, confidence`` to every row by the definitions (:data:`RULE_TABLE`) of the profile
    that column ``profile`` names: the first that matches, highest priority first, ties by position.

    A null or unlisted profile, and null cells, give Unknown / none / 0.0.  Other columns of ``rows`` are kept,
    whatever their names.  The profiles are broadcast if their JSON has at most ``broadcast_bytes``; else they
    are copied to as many salts as the shuffle has partitions and joined on (profile, salt), so one profile's
    rows never meet in one task."""
    fields = ("row_type", "rule", "confidence", "steps")
    order = F.struct((-F.col("priority")).alias("turn"), "position", *fields)
    packed = (rules.groupBy(F.col("profile").alias("_profile")).agg(F.sort_array(F.collect_list(order)).alias("_rules"))
                   .where("_profile is not null"))
    size = packed.agg(F.sum(F.length(F.to_json("_rules")))).first()[0] or 0
    key = F.col(f"`{profile}`")
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(packed), key == F.col("_profile"), "left")
    else:
        n = explicit_partitions(rows)
        salted = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        dealt = rows.withColumn("_turn", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
        joined = dealt.join(salted.hint("shuffle_hash"), (key == F.col("_profile")) & (F.col("_turn") == F.col("_salt")), "left").drop("_salt", "_turn")
    # every rule reads the cells and the first of them, inside a lambda
    joined = held(held(joined, cells).withColumn("_first", first_non_empty(F.col(f"`{cells}`"))), "_first")
    won = F.aggregate(  # the first definition that holds; later ones are not evaluated
        "_rules", F.lit(None).cast("struct<row_type:string,rule:string,confidence:float>"),
        lambda got, r: F.when(got.isNotNull(), got).when(
            _holds(r["steps"], F.col(f"`{cells}`"), F.col("_first")), F.struct(r["row_type"], r["rule"], r["confidence"])))
    out = joined.withColumn("_won", won)
    return (out.withColumn("row_type", F.coalesce("_won.row_type", F.lit(UNKNOWN)))
               .withColumn("matched_rule", F.coalesce("_won.rule", F.lit(NO_RULE)))
               .withColumn("confidence", F.coalesce("_won.confidence", F.lit(0.0).cast("float")))
               .drop("_profile", "_rules", "_first", "_won"))
