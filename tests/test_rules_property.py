"""Property test: compiled rule Columns agree with a plain-Python evaluator of
the rule semantics on random rows (random content, colours, merges, widths)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rows import make_rows
from sheetlens.model import UNICODE_WS
from sheetlens.operators.rules import (
    And, ColorRule, Contains, Exact, MergeRule, MergedAcross, MergedMinColumns, NotMerged, Or, TextRule,
)

WORDS = ["", " ", "　", "小计", "Total", "total ", " 单台合计", "柜号:", "A1", "\t x"]
COLOURS = [None, "FFFFFF", "C6EFCE", "FFCCFD", "D9D9D9"]


def cell_st(i):
    merge = st.one_of(st.none(), st.tuples(st.integers(0, 3), st.integers(0, 6)).map(lambda t: (t[0], t[0] + t[1])))
    return st.tuples(st.just(i), st.sampled_from(WORDS), st.sampled_from(COLOURS), merge)


row_st = st.integers(0, 4).flatmap(lambda w: st.tuples(*[cell_st(i) for i in range(w)]).map(list))

leaf_st = st.one_of(
    st.builds(lambda c, i: ColorRule("c", c, i), st.sampled_from(["FFFFFF", "C6EFCE", "FFCCFD"]),
              st.one_of(st.none(), st.integers(0, 4))),
    st.builds(lambda i, w, cs: TextRule("t", i, Exact(w), case_sensitive=cs), st.integers(0, 4),
              st.sampled_from(["小计", "total", "Total", "柜号:", ""]), st.booleans()),
    st.builds(lambda i, w, cs: TextRule("t", i, Contains(w), case_sensitive=cs), st.integers(0, 4),
              st.sampled_from(["小计", "TOTAL", "合计", "x", "1"]), st.booleans()),
    st.builds(lambda s, e: MergeRule("m", MergedAcross(s, s + e)), st.integers(0, 3), st.integers(0, 6)),
    st.builds(lambda n: MergeRule("m", MergedMinColumns(n)), st.integers(1, 6)),
    st.just(MergeRule("m", NotMerged())),
)
rule_st = st.recursive(leaf_st, lambda ch: st.one_of(
    st.lists(ch, max_size=3).map(lambda rs: And("a", *rs)),
    st.lists(ch, max_size=3).map(lambda rs: Or("o", *rs))), max_leaves=5)


def utrim(s):
    return s.strip(UNICODE_WS)


def evaluate(rule, cells):
    """Reference semantics, written independently of the Column compiler."""
    kind = type(rule).__name__
    if kind == "CompositeRule":
        vals = [evaluate(r, cells) for r in rule.rules]
        return all(vals) if rule.logic == "and" else any(vals)
    if kind == "ColorRule":
        if rule.column_index is None:
            cell = next((c for c in cells if utrim(c[1]) != ""), None)
        else:
            cell = cells[rule.column_index] if rule.column_index < len(cells) else None
        return cell is not None and (cell[2] or "FFFFFF") == rule.color
    if kind == "TextRule":
        if rule.column_index >= len(cells):
            return False
        text, target = utrim(cells[rule.column_index][1]), rule.pattern.text
        if not rule.case_sensitive:
            text, target = text.lower(), target.lower()
        return text == target if isinstance(rule.pattern, Exact) else target in text
    req = rule.requirement
    merges = [c[3] for c in cells if c[3] is not None]
    if isinstance(req, MergedAcross):
        return any(m == (req.start_col, req.end_col) for m in merges)
    if isinstance(req, MergedMinColumns):
        return any(m[1] - m[0] + 1 >= req.n for m in merges)
    return not merges


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row_st, min_size=1, max_size=25), rules=st.lists(rule_st, min_size=1, max_size=6))
def test_rules_match_python_semantics(spark, rows, rules):
    df = make_rows(spark, rows)
    got = df.orderBy("row_index").select(*[r.to_column().alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    for row, out in zip(rows, got):
        for i, rule in enumerate(rules):
            assert out[i] is evaluate(rule, row), (rule, row)
