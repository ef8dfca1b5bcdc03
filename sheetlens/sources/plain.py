"""Small workbooks of plain XML, read where they are cut.

Most writers give cells in one of few forms: attributes in the order r, s, t, text without
markup, references that rise.  Such a workbook's pieces are matched as a whole against these
forms and give its dense rows at once.  Whatever is unlike them (comments, prefixes, other
entities, cells out of order, a reference or number of another form, a fault) gives None and
is left to the XML parser of :mod:`sheetlens.sources.xlsx`, which gives the same rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from xml.parsers import expat

import numpy as np
import pyarrow as pa

from sheetlens.sources.palette import INDEXED_COLORS, THEME_SLOTS

LOOK_SCHEMA = ("struct<style:struct<background_color:string,font_color:string,bold:boolean,italic:boolean>,"
               "fill:struct<fg_resolved:string,bg_resolved:string>,"
               "merge_info:struct<start_col:int,end_col:int,start_row:int,end_row:int>>")
READ_SCHEMA = ("array<struct<sheet_index:int,sheet_name:string,rows:array<struct<row_index:bigint,values:array<string>,"
               f"looks:array<{LOOK_SCHEMA}>>>>>")
_STYLE = pa.struct([("background_color", pa.string()), ("font_color", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_())])
_FILL = pa.struct([("fg_resolved", pa.string()), ("bg_resolved", pa.string())])
_MERGE = pa.struct([(k, pa.int32()) for k in ("start_col", "end_col", "start_row", "end_row")])
_LOOK = pa.struct([("style", _STYLE), ("fill", _FILL), ("merge_info", _MERGE)])
_ROW = pa.struct([("row_index", pa.int64()), ("values", pa.list_(pa.string())), ("looks", pa.list_(_LOOK))])
_SHEET = pa.struct([("sheet_index", pa.int32()), ("sheet_name", pa.string()), ("rows", pa.list_(_ROW))])
READ = pa.list_(_SHEET)

_TEXT = r"[^<&]*(?:&(?:amp|lt|gt|quot|apos);[^<&]*)*"
_T = rf'(?:<t(?: xml:space="preserve")?>{_TEXT}</t>|<t/>)'
_RUN = rf'<r>(?:<rPr>(?:<[A-Za-z]+(?: val="[^"<&]*")?/>)*</rPr>)?{_T}</r>'
_ITEM = rf"(?:{_T}|(?:{_RUN})+)?"
_FORMULA = rf'(?:<f(?: t="[A-Za-z]+")?(?: ref="[A-Z0-9:$]+")?(?: si="[0-9]+")?(?:>{_TEXT}</f>|/>))?'
_CELL = (r'<c(?: r="([A-Z]{1,3})[0-9]{1,7}")?(?: s="([0-9]{1,9})")?(?: t="([A-Za-z]+)")?'
         rf"(?:/>|>{_FORMULA}(?:<v>({_TEXT})</v>|<v/>)?(?:<is>({_ITEM})</is>)?</c>)")
_NO_GROUPS = re.sub(r"(?<!\\)\((?!\?)", "(?:", _CELL)
_ROWS = re.compile(rf"(?:<row(?: [\w:.-]+=\"[^\"<&]*\")*(?:/>|>(?:{_NO_GROUPS})*</row>))*")
_TOKENS = re.compile(rf"<(row)([^>]*)>|{_CELL}")
_NAME = re.compile(r' ([\w:.-]+)="')
_NUMBER = re.compile(r' r="([0-9]{1,7})"')
_SHEET_XML = re.compile(rb"(?:\xef\xbb\xbf)?(?:<\?xml[^<>]*\?>\s*)?<worksheet(?:\s[^<>]*)?>(.*?)<sheetData>(.*)</sheetData>(.*)</worksheet>\s*", re.S)
_MERGE_CELL = re.compile(rb'<mergeCell ref="([^"<&]*)"/>')
_STRINGS_XML = re.compile(rb"(?:\xef\xbb\xbf)?(?:<\?xml[^<>]*\?>\s*)?<sst(?:\s[^<>]*)?>(.*)</sst>\s*", re.S)
_ITEMS = re.compile(rf"(?:<si>{_ITEM}</si>|<si/>)*")
_ONE_ITEM = re.compile(rf"<si>({_ITEM})</si>|<si/>")
_TEXTS = re.compile(rf'<t(?: xml:space="preserve")?>({_TEXT})</t>')
_CONTROLS = bytes(c for c in range(32) if c not in (9, 10))
_ODD = (b"]]>", b"<!", b"<?", b"\xef\xbf\xbe", b"\xef\xbf\xbf")   # the last two are U+FFFE and U+FFFF
_MERGED = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})(?::\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6}))?")
_ENTITY = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
_ENTITIES = re.compile("|".join(_ENTITY))
_ARGB = re.compile(r"[0-9A-Fa-f]{8}")


@lru_cache(4096)
def _column(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _plain_text(text: str) -> str:
    return _ENTITIES.sub(lambda m: _ENTITY[m[0]], text) if "&" in text else text


def _item_text(item: str) -> str:
    """Text of the content of a string item: its runs in order."""
    found = _TEXTS.findall(item)
    return _plain_text(found[0] if len(found) == 1 else "".join(found))


class _Sheet:
    """Dense rows of a sheet: ``values`` and numbers of cell formats by row (-1: no cell), ranges over cells."""

    __slots__ = ("index", "name", "values", "formats", "merges", "over")

    def __init__(self, index, name, values, formats, merges, over):
        self.index, self.name, self.values, self.formats, self.merges, self.over = index, name, values, formats, merges, over


def _odd(data: bytes) -> bool:
    return any(x in data for x in _ODD) or len(data.translate(None, _CONTROLS)) < len(data)


def _strings(text: str) -> list[str] | None:
    if not _ITEMS.fullmatch(text):
        return None
    return [_item_text(m[1] or "") for m in _ONE_ITEM.finditer(text)]


def _ranges(refs: list[str]) -> list[tuple[int, int, int, int]] | None:
    """(first column, last column, first row, last row) of each range."""
    out = []
    for ref in refs:
        m = _MERGED.fullmatch(ref)
        if m is None:
            return None
        a, b = _column(m[1]), _column(m[3] or m[1])
        r, s = int(m[2]) - 1, int(m[4] or m[2]) - 1
        out.append((min(a, b), max(a, b), min(r, s), max(r, s)))
    return out


def _covered(merges: list[tuple[int, int, int, int]], height: int, width: int) -> dict[int, dict[int, int]] | None:
    """Range over each cell of the used range, by row and column; the first one counts."""
    over: dict[int, dict[int, int]] = {}
    work = 0
    for k, (c0, c1, r0, r1) in enumerate(merges):
        cols, rows = range(c0, min(c1 + 1, width)), range(r0, min(r1 + 1, height))
        work += len(cols) * len(rows)
        if work > 4 * height * width + 4096:
            return None
        for r in rows if cols else ():
            row = over.setdefault(r, {})
            for c in cols:
                row.setdefault(c, k)
    return over


def _rows(text: str, texts: list[str]) -> tuple[list, list] | None:
    """(values, formats) of the dense rows; None if the sheet's rows are not plain."""
    if not _ROWS.fullmatch(text):
        return None
    places, height, width, filled = [], 0, 0, 0
    known = len(texts)
    at, last, cells = -1, -1, []
    for row, head, letters, s, t, v, item in _TOKENS.findall(text):
        if row:
            if cells:
                places.append((at, cells))
            m = _NUMBER.match(head) or _NUMBER.search(head)
            number = int(m[1]) - 1 if m else at + 1
            if number <= at or head.count('="') > 1 and len(set(names := _NAME.findall(head))) < len(names):
                return None
            at, last, cells = number, -1, []
            continue
        col = _column(letters) if letters else last + 1
        if col <= last:
            return None
        last = col
        if col >= width:
            width = col + 1
        if "&" in v:
            v = _plain_text(v)
        if item:
            v += _item_text(item)
        if t == "s":
            if v:
                if not (v.isascii() and v.isdigit() and len(v) < 10):
                    return None
                k = int(v)
                v = texts[k] if k < known else ""
        elif t == "b":
            v = "TRUE" if v.strip(" ") in ("1", "true") else "FALSE"
        cells.append((col, int(s) if s else 0, v))
        filled += 1
    if cells:
        places.append((at, cells))
    height = places[-1][0] + 1 if places else 0
    if height * width > 4 * filled + 4096:
        return None
    values, formats = [], []
    for at, cells in places:
        while len(values) < at:
            values.append([""] * width)
            formats.append([-1] * width)
        if len(cells) == width:            # in rising columns: every column is there
            values.append([c[2] for c in cells])
            formats.append([c[1] for c in cells])
        else:
            v, f = [""] * width, [-1] * width
            for col, s, text in cells:
                v[col], f[col] = text, s
            values.append(v)
            formats.append(f)
    return values, formats


# ---------------------------------------------------------------- styles

class _Odd(Exception):
    """XML of another form than the plain one."""


def _tree(xml: str) -> tuple[str, dict, list]:
    """(name, attributes, children) of a part without text."""
    if "<!" in xml:
        raise _Odd
    top: list = []
    stack = [("", {}, top)]

    def start(name, attributes):
        node = (name, attributes, [])
        stack[-1][2].append(node)
        stack.append(node)

    def text(data):
        if data.strip(" \t\r\n"):
            raise _Odd

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), text
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        raise _Odd from None
    return top[0]


def _only(node, name: str):
    """The child of a name, None if there is none."""
    found = [c for c in node[2] if c[0] == name] if node is not None else []
    if len(found) > 1:
        raise _Odd
    return found[0] if found else None


def _value(node, name: str, form: str) -> str | None:
    v = node[1].get(name) if node is not None else None
    if v is not None and not re.fullmatch(form, v):
        raise _Odd
    return v


_HEX, _INT, _FLOAT = r"[0-9A-Za-z#]*", r"[0-9]{1,9}", r"-?[0-9]{1,17}(?:\.[0-9]{1,25})?(?:[eE][+-]?[0-9]{1,2})?"


def _theme(xml: str) -> list[str]:
    scheme = _only(_only(_tree(xml), "themeElements"), "clrScheme")
    out = []
    for slot in THEME_SLOTS:
        node = _only(scheme, slot)
        rgb, system = _value(_only(node, "srgbClr"), "val", _HEX), _value(_only(node, "sysClr"), "lastClr", _HEX)
        v = rgb if rgb is not None else system
        out.append("FF" + v.upper() if v is not None else "")
    return out


def _tinted(argb: str, tint: float) -> str:
    """:func:`sheetlens.functions.text.tinted` of one colour."""
    if tint == 0 or not _ARGB.fullmatch(argb):
        return argb
    t = max(-1.0, min(1.0, tint))
    rgb = [int(argb[i:i + 2], 16) / 255 for i in (2, 4, 6)]
    light = (max(rgb) + min(rgb)) / 2
    new = light * (1 + t) if t < 0 else light * (1 - t) + t
    edge = min(light, 1 - light)
    k = min(new, 1 - new) / edge if edge > 0 else 0.0
    return "FF" + "".join(f"{int((255 * (new + (c - light) * k) + 0.5 + 1e-9) // 1):02X}" for c in rgb)


def _color(node, theme: list[str] | None) -> str:
    """ARGB of a colour element, '' if it names none."""
    rgb, indexed = _value(node, "rgb", _HEX), _value(node, "indexed", _INT)
    slot, tint = _value(node, "theme", _INT), _value(node, "tint", _FLOAT)
    if rgb is not None:
        return rgb
    if indexed is not None:
        return INDEXED_COLORS[int(indexed)] if int(indexed) < len(INDEXED_COLORS) else ""
    if theme is None or slot is None or int(slot) >= len(theme):
        return ""
    argb = theme[int(slot)]
    return argb if tint is None else _tinted(argb, float(tint))


def _rgb(argb: str) -> str | None:
    return argb[2:8].upper() if len(argb) >= 8 and re.fullmatch("[0-9A-Fa-f]{6}", argb[2:8]) else None


def _flag(font, name: str) -> bool:
    node = _only(font, name)
    return node is not None and node[1].get("val", "1") not in ("0", "false")


@lru_cache(256)
def _formats(styles: str, theme: str | None) -> tuple | None:
    """(background, font colour, bold, italic, fill, fill's background) of every cell format; None if not plain."""
    try:
        colours = _theme(theme) if theme is not None else None
        root = _tree(styles)
        fonts, fills, xfs = (_only(root, name) for name in ("fonts", "fills", "cellXfs"))
        look_font = []
        for font in (c for c in (fonts[2] if fonts else ()) if c[0] == "font"):
            color = _only(font, "color")
            look_font.append((_rgb(_color(color, None)) if color is not None else None, _flag(font, "b"), _flag(font, "i")))
        look_fill = []
        for fill in (c for c in (fills[2] if fills else ()) if c[0] == "fill"):
            pattern = _only(fill, "patternFill")
            fg, bg = _only(pattern, "fgColor"), _only(pattern, "bgColor")
            look_fill.append((_rgb(_color(fg, None)) if fg is not None else None,
                              _color(fg, colours) if fg is not None else "", _color(bg, colours) if bg is not None else ""))
        out = []
        for xf in (c for c in (xfs[2] if xfs else ()) if c[0] == "xf"):
            fill_id, font_id = int(_value(xf, "fillId", _INT) or 0), int(_value(xf, "fontId", _INT) or 0)
            rgb, fg, bg = look_fill[fill_id] if fill_id < len(look_fill) else (None, "", "")
            font = look_font[font_id] if font_id < len(look_font) else (None, False, False)
            out.append((rgb, *font, fg, bg))
        return tuple(out)
    except _Odd:
        return None


# ---------------------------------------------------------------- books

NO_LOOK = (None, None, False, False, "", "")


def sheet_rows(data: bytes) -> tuple[bytes, list[str]] | None:
    """(rows, references of merged ranges) of a worksheet member; None if it is not plain."""
    m = _SHEET_XML.fullmatch(data)
    if m is None:
        return None
    head, rows, tail = m.groups()
    refs = [r.decode() for r in _MERGE_CELL.findall(tail)] if b"mergeCell " in tail else []
    # what stands beside the rows must hold no row and no other range
    if b"row" in head or b"<mergeCell" in head or b"<row" in tail or b":row" in tail or tail.count(b"mergeCell ") != len(refs) \
            or tail.count(b"mergeCell") - 2 * tail.count(b"<mergeCells") != len(refs) or any(x in head or x in tail for x in (b"<!", b"sheetData")) \
            or b"mergeCell" in rows:
        return None
    return rows, refs


def strings_items(data: bytes) -> bytes | None:
    """The items of a shared strings member; None if it is not plain."""
    m = _STRINGS_XML.fullmatch(data)
    return m[1] if m is not None else None


def read(sheets: list[tuple[int, str, bytes, list[str]]], strings: bytes, styles: str | None, theme: str | None) -> tuple[list[_Sheet], tuple | None] | None:
    """(sheets, looks of the cell formats or None) of a small workbook's chosen sheets (index, name, rows, ranges) and its
    shared strings, styles and theme; None if one is not plain."""
    looks = _formats(styles, theme) if styles is not None else None
    texts = _strings(strings.decode()) if strings and not _odd(strings) else None if strings else []
    if texts is None or styles is not None and looks is None:
        return None
    out = []
    for k, name, rows, refs in sheets:
        found, merges = _rows(rows.decode(), texts) if not _odd(rows) else None, _ranges(refs)
        if found is None or merges is None:
            return None
        values, formats = found
        over = _covered(merges, len(values), len(values[0]) if values else 0) if merges else {}
        if over is None:
            return None
        out.append(_Sheet(k, name, values, formats, merges, over))
    return out, looks


def _offsets(lengths) -> pa.Array:
    out = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    return pa.array(out)


def _with_nulls(lengths: list[int | None]) -> pa.Array:
    """Offsets of lists of which some (None) are null."""
    off = _offsets([n or 0 for n in lengths])
    gone = np.array([n is None for n in lengths] + [False], bool)
    return pa.array(off.to_numpy(), mask=gone) if gone.any() else off


def column(books: list[tuple[list[_Sheet], tuple | None] | None]) -> pa.Array:
    """Arrow values of :data:`READ_SCHEMA` of some workbooks, null for None.  A row has ``looks`` if its workbook has
    styles or a range covers it."""
    table: dict[tuple, int] = {NO_LOOK: 0}
    spans: list[tuple[int, int, int, int]] = []
    per_book, per_sheet, per_row, per_look = [], [], [], []
    index, name, row_index, values, look_ids, span_ids = [], [], [], [], [], []
    for book in books:
        if book is None:
            per_book.append(None)
            continue
        sheets, formats = book
        per_book.append(len(sheets))
        ids = [table.setdefault(f, len(table)) for f in formats] if formats is not None else None
        for s in sheets:
            index.append(s.index)
            name.append(s.name)
            per_sheet.append(len(s.values))
            base = len(spans)
            if s.over:
                spans += s.merges
            for r, row in enumerate(s.values):
                row_index.append(r)
                per_row.append(len(row))
                values += row
                over = s.over.get(r)
                if ids is None and not over:
                    per_look.append(None)
                    continue
                per_look.append(len(row))
                if ids is None:
                    look_ids += [0] * len(row)
                else:
                    known = len(ids)
                    look_ids += [ids[f] if 0 <= f < known else 0 for f in s.formats[r]]
                if over:
                    span_ids += [base + over[c] if c in over else None for c in range(len(row))]
                else:
                    span_ids += [None] * len(row)
    kinds = list(table)
    take = pa.array(look_ids, pa.int32())
    style = pa.StructArray.from_arrays([pa.array([k[i] for k in kinds], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.bool_()))],
                                       fields=list(_STYLE)).take(take)
    fill = pa.StructArray.from_arrays([pa.array([k[i] for k in kinds], pa.string()) for i in (4, 5)], fields=list(_FILL)).take(take)
    merge = pa.StructArray.from_arrays([pa.array([s[i] for s in spans], pa.int32()) for i in range(4)], fields=list(_MERGE)).take(
        pa.array(span_ids, pa.int32()))
    looks = pa.ListArray.from_arrays(_with_nulls(per_look), pa.StructArray.from_arrays([style, fill, merge], fields=list(_LOOK)))
    rows = pa.StructArray.from_arrays([pa.array(row_index, pa.int64()), pa.ListArray.from_arrays(_offsets(per_row), pa.array(values, pa.string())),
                                       looks], fields=list(_ROW))
    sheets = pa.StructArray.from_arrays([pa.array(index, pa.int32()), pa.array(name, pa.string()),
                                         pa.ListArray.from_arrays(_offsets(per_sheet), rows)], fields=list(_SHEET))
    return pa.ListArray.from_arrays(_with_nulls(per_book), sheets)
