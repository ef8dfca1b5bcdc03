"""Truth tables of the leaf and composite rules (FIXTURES.md §A)."""

import pytest
from pyspark.sql import functions as F

from rows import make_rows
from sheetlens.operators.rules import (
    And, ColorRule, Contains, Exact, MergeRule, MergedAcross, MergedMinColumns, NotMerged, Or, Regex, TextRule,
)


def matches(spark, rule, row):
    return make_rows(spark, [row]).select(rule.to_column().alias("m")).first()["m"]


CASES = [
    (ColorRule("c", (198, 239, 206), 0), [(0, "Test", "C6EFCE")], True),
    (ColorRule("c", (198, 239, 206), 0), [(0, "Test", "C6EFCF")], False),
    (ColorRule("white", (255, 255, 255), 0), [(0, "Test")], True),
    (ColorRule("grey", (217, 217, 217)), [(0, ""), (1, "Test", "D9D9D9")], True),
    (ColorRule("grey", (217, 217, 217), 3), [(0, "Test", "D9D9D9")], False),         # missing column
    (ColorRule("white", "FFFFFF"), [(0, "  "), (1, "")], False),                      # blank row: no cell
    (TextRule("t", 1, Exact("柜号:")), [(0, "A"), (1, "柜号:")], True),
    (TextRule("t", 1, Exact("柜号:")), [(0, "A"), (1, "柜号：")], False),
    (TextRule("t", 0, Contains("小计"), case_sensitive=False), [(0, "  小计: 100  ")], True),
    (TextRule("t", 0, Regex(r"^G\d{2}E-\d+-\d+$")), [(0, "G00E-500009085-00011")], True),
    (TextRule("t", 0, Regex(r"^G\d{3}E-\d+-\d+$")), [(0, "G00E-500009085-00011")], False),
    (TextRule("t", 0, Regex(r"^G\d{2}E-\d+-\d+$")), [(0, "Invalid")], False),
    (TextRule("t", 0, Regex("[invalid(")), [(0, "Test")], False),
    (TextRule("t", 0, Regex(r"(?<=a)b")), [(0, "ab")], False),                        # look-around: invalid
    (TextRule("t", 5, Contains("x")), [(0, "x")], False),
    (TextRule("t", 0, Exact("abc"), case_sensitive=False), [(0, "　ABC ")], True),  # Unicode trim
    (MergeRule("m", MergedAcross(0, 10)), [(0, "Merged Cell", None, (0, 10))], True),
    (MergeRule("m", MergedAcross(0, 10)), [(0, "Merged Cell", None, (0, 5))], False),
    (MergeRule("m", MergedMinColumns(5)), [(0, "Merged", None, (0, 6))], True),
    (MergeRule("m", MergedMinColumns(5)), [(0, "Merged", None, (0, 3))], False),
    (MergeRule("m", NotMerged()), [(0, "A"), (1, "B")], True),
    (MergeRule("m", NotMerged()), [(0, "A", None, (0, 1))], False),
    (MergeRule("m", NotMerged()), [], True),
    (MergeRule("m", MergedMinColumns(3)), [(0, "Normal"), (1, "Merged", None, (1, 5))], True),
    (And("a", ColorRule("p", (255, 204, 253), 0), TextRule("t", 0, Contains("小计"))),
     [(0, "小计: 100", "FFCCFD")], True),
    (And("a", ColorRule("p", (255, 204, 253), 0), TextRule("t", 0, Contains("单台合计"))),
     [(0, "小计: 100", "FFCCFD")], False),
    (Or("o", ColorRule("g", (127, 150, 152), 0), TextRule("t", 1, Contains("柜号:"))),
     [(0, "A"), (1, "柜号: 1-1")], True),
    (Or("o", ColorRule("g", (127, 150, 152), 0), TextRule("t", 1, Contains("柜号:"))),
     [(0, "A"), (1, "Other text")], False),
    (Or("n", And("i", ColorRule("g", (198, 239, 206)), TextRule("t", 0, Contains("G00E"))),
        TextRule("p", 0, Contains("项目"))), [(0, "项目编号")], True),
    (And("empty"), [(0, "x")], True),
    (Or("empty"), [(0, "x")], False),
]


@pytest.mark.parametrize("rule,row,expected", CASES, ids=[f"{i}-{c[0].name}" for i, c in enumerate(CASES)])
def test_rule_truth_table(spark, rule, row, expected):
    assert matches(spark, rule, row) is expected


def test_confidence():
    leaf = ColorRule("c", "FFFFFF")
    assert leaf.confidence() == 1.0
    assert And("a", leaf, leaf).confidence() == 1.0
    assert Or("o", leaf).confidence() == 1.0
    assert And("a").confidence() == 0.0
    assert Or("o").confidence() == 0.0


def test_rule_columns_never_null(spark):
    rows = make_rows(spark, [[], [(0, None)], [(0, "x", None, None)]])
    rules = [ColorRule("c", "FFFFFF"), TextRule("t", 0, Contains("x")), MergeRule("m", MergedAcross(0, 1)),
             MergeRule("m2", MergedMinColumns(2)), MergeRule("m3", NotMerged())]
    out = rows.select(*[r.to_column().alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    assert all(v is not None for row in out for v in row)


def test_python_rule_in_profile(spark):
    from sheetlens.operators import classify as C
    from sheetlens.operators.profiles import Profile, RowTypeDefinition, custom
    from sheetlens.operators.rules import PythonRule

    def two_numbers(contents, bgs, merges):
        return sum(1 for c in contents if c.strip().isdigit()) >= 2 and merges[0] is None

    rule = PythonRule("two_numbers", two_numbers)
    rows = make_rows(spark, [[(0, "1"), (1, " 2 ")], [(0, "1"), (1, "x")], [(0, "3", None, (0, 1)), (1, "4")], []])
    assert [r["m"] for r in rows.orderBy("row_index").select(rule.to_column().alias("m")).collect()] == [
        True, False, False, False]
    p = Profile("p").add(RowTypeDefinition(custom("Pair"), rule, 5)).add(
        RowTypeDefinition("Data", ColorRule("w", "FFFFFF"), 1))
    out = [r["row_type"] for r in C.classify(rows, p).orderBy("row_index").collect()]
    assert out == ["custom:Pair", "Data", "Data", "Unknown"]


def test_arrow_rule_equals_python_rule(spark):
    import numpy as np
    import pyarrow.compute as pc
    from sheetlens.operators import classify as C
    from sheetlens.operators.profiles import Profile, RowTypeDefinition, custom
    from sheetlens.operators.rules import And, ArrowRule, PythonRule

    def by_row(contents, bgs, merges):
        return sum(1 for c in contents if c.strip().isdigit()) >= 2 and merges[0] is None

    def by_batch(cells):
        digits = pc.utf8_is_digit(pc.utf8_trim_whitespace(cells.contents))
        return (cells.count(digits) >= 2) & ~cells.at(0, cells.starts.is_valid())

    rows = make_rows(spark, [[(0, "1"), (1, " 2 ")], [(0, "1"), (1, "x")], [(0, "3", None, (0, 1)), (1, "4")], [],
                             [(0, "7")], [(0, "5", "FF0000"), (1, ""), (2, "6")]])
    rules = [PythonRule("r", by_row), ArrowRule("a", by_batch), And("b", ArrowRule("a", by_batch), ColorRule("c", "FF0000"))]
    got = rows.orderBy("row_index").select(*(r.to_column().alias(n) for r, n in zip(rules, "pab"))).collect()
    assert [r.p for r in got] == [r.a for r in got] == [True, False, False, False, False, True]
    assert [r.b for r in got] == [False] * 5 + [True]
    assert rows.limit(0).select(rules[1].to_column()).count() == 0
    nulls = rows.select(ArrowRule("n", lambda c: np.full(len(c.offsets) - 1, None)).to_column().alias("n"))
    assert {r.n for r in nulls.collect()} == {False}
    missing = rows.select(F.lit(None).cast(rows.schema["cells"].dataType).alias("cells"))
    assert {r.m for r in missing.select(rules[1].to_column().alias("m")).collect()} == {False}
    p = Profile("p").add(RowTypeDefinition(custom("Pair"), rules[1], 5)).add(RowTypeDefinition("Data", ColorRule("w", "FFFFFF"), 1))
    assert [r.row_type for r in C.classify(rows, p).orderBy("row_index").collect()] == [
        "custom:Pair", "Data", "Data", "Unknown", "Data", "custom:Pair"]
    with pytest.raises(Exception, match="3 values"):
        rows.select(ArrowRule("short", lambda c: [True] * 3).to_column()).collect()
