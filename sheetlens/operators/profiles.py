"""Row-type definitions and profiles (ordered rule sets)."""

from __future__ import annotations

from dataclasses import dataclass, field

from sheetlens.model import CUSTOM_PREFIX, ROW_TYPES
from sheetlens.operators.rules import (
    And, ColorRule, Contains, MergeRule, MergedAcross, Or, Rule, TextRule,
)


def custom(name: str) -> str:
    """Name of a user row type; distinct from a built-in of the same text."""
    return CUSTOM_PREFIX + name


@dataclass
class RowTypeDefinition:
    row_type: str
    rule: Rule
    priority: int
    display_name: str = ""
    description: str = ""

    def __post_init__(self):
        if self.row_type not in ROW_TYPES and not self.row_type.startswith(CUSTOM_PREFIX):
            raise ValueError(f"unknown row type {self.row_type!r}; use custom(name) for user types")
        if not 0 <= int(self.priority) <= 255:
            raise ValueError("priority must fit in 0..255")


@dataclass
class Profile:
    name: str
    display_name: str = ""
    definitions: list[RowTypeDefinition] = field(default_factory=list)

    def add(self, definition: RowTypeDefinition) -> "Profile":
        """Add and keep definitions ordered by priority, highest first; the sort
        is stable so insertion order breaks ties."""
        self.definitions.append(definition)
        self.definitions.sort(key=lambda d: -d.priority)
        return self

    def validate(self) -> None:
        if not self.definitions:
            raise ValueError(f"profile {self.name!r} has no row-type definitions")


# The built-in cargo profile - row types, rule names, colours,
# column positions, texts and priorities.
def cargo_analysis() -> Profile:
    pink = (255, 204, 253)
    p = Profile("cargo_analysis", "货物分析表配置")
    p.add(RowTypeDefinition("ProjectNumber", And(
        "project_number_rule",
        ColorRule("green_background", (198, 239, 206)),
        MergeRule("merged_across_columns", MergedAcross(0, 10))), 9, "项目编号行"))
    p.add(RowTypeDefinition("CabinetNumber", Or(
        "cabinet_number_rule",
        ColorRule("gray_blue_background", (127, 150, 152)),
        TextRule("cabinet_text", 1, Contains("柜号:"), case_sensitive=False)), 8, "柜号行"))
    p.add(RowTypeDefinition("Header", ColorRule("gray_background", (217, 217, 217)), 7, "表头行"))
    p.add(RowTypeDefinition("UnitTotal", And(
        "unit_total_rule",
        ColorRule("pink_background", pink),
        TextRule("unit_total_text", 0, Contains("单台合计"), case_sensitive=False)), 6, "单台合计行"))
    p.add(RowTypeDefinition("SubTotal", And(
        "subtotal_rule",
        ColorRule("pink_background", pink),
        TextRule("subtotal_text", 0, Contains("小计"), case_sensitive=False)), 6, "小计行"))
    p.add(RowTypeDefinition("GrandTotal", And(
        "grand_total_rule",
        ColorRule("pink_background", pink),
        TextRule("grand_total_text", 0, Contains("总计"), case_sensitive=False)), 5, "总计行"))
    p.add(RowTypeDefinition("Data", ColorRule("white_or_no_background", (255, 255, 255)), 1, "数据行"))
    return p


def auxiliary_material() -> Profile:
    """Placeholder profile: every white / unfilled row is Data."""
    p = Profile("auxiliary_material", "辅材配置")
    p.add(RowTypeDefinition("Data", ColorRule("default_rule", (255, 255, 255)), 1, "数据行"))
    return p


PROFILES = {"cargo_analysis": cargo_analysis, "auxiliary_material": auxiliary_material}
