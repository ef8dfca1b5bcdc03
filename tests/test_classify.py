"""Cargo-profile classification, statistics, conflicts, explain (FIXTURES.md §A)."""

import pytest

from rows import make_rows
from sheetlens.operators import classify as C
from sheetlens.operators import extract as X
from sheetlens.operators.profiles import Profile, RowTypeDefinition, auxiliary_material, cargo_analysis, custom
from sheetlens.operators.rules import ColorRule

SHEET = [
    [(0, "G00E-500009085-00011", "C6EFCE", (0, 10))],       # 0 ProjectNumber
    [(0, "A"), (1, "柜号: 1-1")],                            # 1 CabinetNumber
    [(0, "序号", "D9D9D9"), (1, "物料", "D9D9D9")],          # 2 Header
    [(0, "1"), (1, "x")],                                     # 3 Data
    [(0, "Test", "646464")],                                  # 4 Unknown
    [(0, "单台合计/小计", "FFCCFD")],                          # 5 UnitTotal + conflict with SubTotal
    [(0, " 总计 ", "FFCCFD")],                                # 6 GrandTotal
    [(0, ""), (1, "  ")],                                     # 7 blank -> Unknown
    [(0, "2"), (1, "y")],                                     # 8 Data
]
EXPECTED = ["ProjectNumber", "CabinetNumber", "Header", "Data", "Unknown", "UnitTotal", "GrandTotal", "Unknown", "Data"]


def test_profile_order_and_validate():
    p = cargo_analysis()
    assert len(p.definitions) == 7
    pr = [d.priority for d in p.definitions]
    assert pr == sorted(pr, reverse=True)
    assert [d.row_type for d in p.definitions][3:5] == ["UnitTotal", "SubTotal"]   # stable on ties
    with pytest.raises(ValueError):
        Profile("empty").validate()
    assert len(auxiliary_material().definitions) == 1
    with pytest.raises(ValueError):
        RowTypeDefinition("NotAType", ColorRule("c", "FFFFFF"), 1)
    assert custom("Data") != "Data"


def test_classify_rows(spark):
    out = C.classify(make_rows(spark, SHEET), cargo_analysis()).orderBy("row_index").collect()
    assert [r["row_type"] for r in out] == EXPECTED
    assert out[4]["matched_rule"] == "none" and out[4]["confidence"] == 0.0
    assert out[0]["matched_rule"] == "project_number_rule" and out[0]["confidence"] == 1.0


def test_statistics(spark):
    st = C.statistics(C.classify(make_rows(spark, SHEET), cargo_analysis())).first()
    assert st["total_rows"] == 9 and st["unknown_count"] == 2
    assert abs(st["success_rate"] - 7 / 9) < 1e-6
    assert st["row_type_counts"]["Data"] == 2 and st["row_type_counts"]["Unknown"] == 2


def test_statistics_example_from_reference(spark):
    rows = make_rows(spark, [[(0, "序号", "D9D9D9")], [(0, "1")], [(0, "2")], [(0, "Test", "646464")]])
    st = C.statistics(C.classify(rows, cargo_analysis())).first()
    assert (st["total_rows"], st["unknown_count"]) == (4, 1)
    assert abs(st["success_rate"] - 0.75) < 1e-6


def test_conflicts_and_explain(spark):
    rows = make_rows(spark, SHEET)
    conf = C.conflicts(rows, cargo_analysis()).collect()
    assert [(r["row_index"], r["priority"], r["type1"], r["type2"]) for r in conf] == [(5, 6, "UnitTotal", "SubTotal")]
    ex = C.explain_rows(rows, cargo_analysis()).where("row_index = 3").orderBy("step").collect()
    assert [r["row_type"] for r in ex] == ["ProjectNumber", "CabinetNumber", "Header", "UnitTotal", "SubTotal",
                                          "GrandTotal", "Data"]
    assert [r["matched"] for r in ex][-1] is True and not any(r["matched"] for r in ex[:-1])


def test_classify_has_no_shuffle(spark):
    df = C.classify(make_rows(spark, SHEET), cargo_analysis())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cargo_summary(spark):
    cl = C.classify(make_rows(spark, SHEET), cargo_analysis())
    s = X.cargo_summary(cl, files=cl.select("file")).first()
    assert s["项目编号"] == "G00E-500009085-00011"
    assert s["柜号数量"] == 1 and s["数据行数量"] == 2


def test_statistics_one_pass_equals_two_level(spark):
    cl = C.classify(make_rows(spark, SHEET + SHEET[:4]), cargo_analysis())
    a = C.statistics(cl).first()
    b = C.statistics(cl, profile=cargo_analysis()).first()
    assert (a["total_rows"], a["unknown_count"], a["success_rate"]) == (b["total_rows"], b["unknown_count"],
                                                                         b["success_rate"])
    assert dict(a["row_type_counts"]) == dict(b["row_type_counts"])
    assert "SubTotal" not in b["row_type_counts"]          # only types present
