"""Scalar column functions (all JVM-side built-ins)."""

from sheetlens.functions.cells import (  # noqa: F401
    cell_at, column_span, contents, first_non_empty, is_blank, row_span,
)
from sheetlens.functions.text import argb_to_rgb, display_hex, extension, rgb_components, tinted, utrim  # noqa: F401
