"""Profiles as tables against the compiled profiles, and the linear-time matcher against the JVM's."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rows import make_rows
from sheetlens.model import ROWS_SCHEMA
from sheetlens.operators.classify import classify
from sheetlens.operators.patterns import InvalidPattern, java_pattern, linear_pattern, matches, may_backtrack, to_java
from sheetlens.operators.profiles import Profile, RowTypeDefinition, cargo_analysis, custom
from sheetlens.operators.rule_tables import classify_by_table, rule_table
from sheetlens.operators.rules import (
    And, ColorRule, Contains, Exact, ExprRule, MergedAcross, MergedMinColumns, MergeRule, NotMerged, Or, Regex, TextRule,
)

NESTED = (Profile("nested")
          .add(RowTypeDefinition(custom("a"), And("and", Or("or", TextRule("e", 0, Exact("X"), case_sensitive=False),
                                                            TextRule("r", 1, Regex(r"^\d{2}$"))),
                                                  Or("or2", MergeRule("n", NotMerged()), MergeRule("m", MergedMinColumns(3)))), 5))
          .add(RowTypeDefinition(custom("b"), And("none"), 2))                        # always
          .add(RowTypeDefinition(custom("c"), Or("never"), 9))
          .add(RowTypeDefinition(custom("d"), TextRule("bad", 0, Regex("[x(")), 8))
          .add(RowTypeDefinition(custom("e"), MergeRule("across", MergedAcross(0, 1)), 5))
          .add(RowTypeDefinition(custom("f"), ColorRule("c", "00FF00", 1), 5)))
ROWS = [[(0, " x "), (1, "b")], [(0, "y"), (1, "12", "00FF00")], [(0, "y", None, (0, 1)), (1, "12")], [(0, "x", None, (0, 4))],
        [], [(0, "")], [(0, "柜号"), (1, "柜号: 3")], [(0, "单台合计/小计", "FFCCFD")], [(0, "G", "C6EFCE", (0, 10))], [(0, "z"), (1, "é", "00FF00")]]


def _both(spark):
    rows = make_rows(spark, ROWS).drop("error")
    names = ["nested", "cargo_analysis", "unlisted", None]
    return rows.withColumn("profile", F.explode(F.array(*[F.lit(n) for n in names]))), rows


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_table_gives_what_the_profile_gives(spark, bound):
    cargo = cargo_analysis()
    rules = rule_table(spark, {"nested": NESTED, "cargo_analysis": cargo})
    mixed, rows = _both(spark)
    out = classify_by_table(mixed, rules, broadcast_bytes=bound)
    for name, profile in (("nested", NESTED), ("cargo_analysis", cargo)):
        want = [tuple(r) for r in classify(rows, profile).select("row_index", "row_type", "matched_rule", "confidence").orderBy("row_index").collect()]
        got = out.where(F.col("profile") == name).select("row_index", "row_type", "matched_rule", "confidence").orderBy("row_index")
        assert [tuple(r) for r in got.collect()] == want
    rest = out.where("profile is null or profile = 'unlisted'").select("row_type", "matched_rule", "confidence").collect()
    assert len(rest) == 2 * len(ROWS) and {tuple(r) for r in rest} == {("Unknown", "none", 0.0)}
    assert out.columns[:len(mixed.columns)] == mixed.columns


def test_salted_join_spreads_one_profile(spark):
    rules = rule_table(spark, {"p": NESTED})
    rows = (spark.range(2000, numPartitions=4).crossJoin(make_rows(spark, ROWS[:1]).limit(1)).withColumn("profile", F.lit("p")))
    out = classify_by_table(rows, rules, broadcast_bytes=0)
    assert out.count() == 2000 and out.where("row_type <> 'custom:a'").count() == 0
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_tables_null_cells_and_refused_rules(spark):
    rules = rule_table(spark, {"p": NESTED})
    rows = make_rows(spark, ROWS).withColumn("profile", F.lit("p"))
    assert classify_by_table(rows.limit(0), rules).count() == 0
    assert {r.row_type for r in classify_by_table(rows, rules.limit(0)).collect()} == {"Unknown"}
    null = spark.createDataFrame([("f", 0, "s", 0, None, None, "p")], T.StructType([*ROWS_SCHEMA, T.StructField("profile", T.StringType())]))
    assert classify_by_table(null, rules).count() == 1
    for rule in (ExprRule("x", lambda ctx: F.lit(True)), TextRule("t", 0, Regex("(a+)+b"))):
        with pytest.raises(ValueError):
            rule_table(spark, {"p": Profile("p").add(RowTypeDefinition(custom("x"), rule, 1))})


# ---------------------------------------------------------------- linear time

@pytest.mark.parametrize("pattern,risky", [
    ("(a+)+b", True), ("(a|b)*", True), ("(a?){30}", True), ("((ab?)c)+", True), (r"(?i:a*)*", True), ("(?:x|y){2}", True),
    ("(ab)*c", False), (r"^https?://(www\.)?th", False), ("(x{2}){4}", False), (r"[*+]\++(a|b)?", False), (r"\(a+\)+", False),
    (r"(a|b)c+", False), (r"[(a+)+]*b", False), (r"(a+b)?c*", False)])
def test_ambiguous_repetition_is_found(pattern, risky):
    assert may_backtrack(to_java(pattern)) is risky


TEXTS = ["", "a", "aab", "ab\nab", "x\ry", "x y", "é1_", "Ünï", "०१", "á", "Ⅰ", "ⓐ", "‍", "_-", "柜号: 12",
         "a b", "a b", "A,b;C", "(a)", "[x]", "a\\b", "𝒳", "ſ", "K", "\t"]


@pytest.mark.parametrize("pattern", [r"^(\w+)+$", r"^(\W+)+$", r"(\s+)+", r"^(\S|x)+$", r"^(\d+)+$", r"^(\D+)+$", r"^(.+)+$", r"^([\w\s]+)+$",
                                     r"(?m)^(a|b)+$", r"(?s)^(.|x)+$", r"(?i)^(k|s|ü)+$", r"^(\p{Lu}|\p{Ll}|\pN)+$", r"^([^\s,]+[,;]?)+$",
                                     r"(?P<n>a+)+\b", r"((\((a)\))+|(\[x\])+)+", r"(\x41|\x{62}|A)+"])
@pytest.mark.parametrize("case_sensitive", [True, False])
def test_both_matchers_agree(spark, pattern, case_sensitive):
    java = java_pattern(pattern, case_sensitive)
    assert may_backtrack(java)
    if linear_pattern(java) is None:
        assert r"\b" in pattern
        return
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    bad = df.select("t", matches(F.col("t"), java).alias("a"), F.col("t").rlike(java).alias("b")).where("not (a <=> b)").collect()
    assert bad == []


def test_long_texts_take_no_exponential_time_and_no_stack(spark):
    df = spark.range(50).select(F.concat(F.repeat(F.lit("ab"), 200_000), F.lit("!")).alias("t"))
    t0 = time.time()
    row = df.agg(*[F.count_if(matches(F.col("t"), java_pattern(p))).alias(f"m{i}") for i, p in enumerate(["^(a?b?)+$", "^(a|b)*!$", "(a+b+)+c"])]).first()
    assert tuple(row) == (0, 50, 0) and time.time() - t0 < 60


@pytest.mark.parametrize("pattern", [r"([a[b]]+)+", r"(\bx*)+", r"([a-z&&[^x]]+)+", r"(?x)(a +)+", r"(\p{Greek}+)+", "(a?){1001}"])
def test_what_the_automaton_cannot_say(pattern):
    assert linear_pattern(to_java(pattern)) is None


def test_unclosed_patterns_do_not_hang():
    for p in ("[", "(", "[a", "a{", "((", "[[a]"):
        try:
            may_backtrack(to_java(p))
        except InvalidPattern:
            pass
