"""Minimal OOXML workbook writer for fixtures (tests and the registered
round-trip queries build workbooks from the given tables with it).

A sheet is a list of rows; a row is a list of cells; a cell is either a
value (str / int / float / bool / None) or a dict with ``v`` and optional
``fill`` (ARGB), ``fill_theme`` (theme index, with ``fill_tint``), ``fill_indexed``, ``bg``
(ARGB of the pattern background), ``font`` (ARGB), ``bold``, ``italic``,
``t`` ('s' shared, 'inline', 'rich', 'f' formula with cached value).
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr


def col_letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


_letters = lru_cache(1024)(col_letters)
_CONTENT = frozenset(("v", "t", "formula"))   # of a cell's keys, those that say nothing of its look


def ref(r: int, c: int) -> str:
    return f"{_letters(c)}{r + 1}"


def _text(v: str) -> str:
    return v if v.isalnum() else escape(v)


@lru_cache(1024)
def _look_xml(look: tuple) -> tuple[str | None, str | None]:
    """(fill, font) elements of a cell's look, None for a default one."""
    cell = dict(look)
    fill_key = None
    if any(k in cell for k in ("fill", "fill_theme", "fill_indexed", "bg")):
        fg = (f'<fgColor rgb="{cell["fill"]}"/>' if "fill" in cell else
              f'<fgColor theme="{cell["fill_theme"]}" tint="{cell.get("fill_tint", 0)}"/>' if "fill_theme" in cell else
              f'<fgColor indexed="{cell["fill_indexed"]}"/>' if "fill_indexed" in cell else "")
        bg = f'<bgColor rgb="{cell["bg"]}"/>' if "bg" in cell else ""
        fill_key = f'<fill><patternFill patternType="solid">{fg}{bg}</patternFill></fill>'
    font_key = None
    if any(k in cell for k in ("font", "bold", "italic")):
        font_key = ("<font>" + ("<b/>" if cell.get("bold") else "") + ("<i/>" if cell.get("italic") else "")
                    + (f'<color rgb="{cell["font"]}"/>' if "font" in cell else "") + "</font>")
    return fill_key, font_key


class _Styles:
    def __init__(self):
        self.fills = ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>']
        self.fonts = ["<font/>"]
        self.xfs = ['<xf fillId="0" fontId="0"/>']
        self._fill_ids: dict[str, int] = {}
        self._font_ids: dict[str, int] = {}
        self._xf_ids: dict[tuple, int] = {}
        self._looks: dict[tuple, int] = {}

    def xf(self, cell: dict) -> int:
        look = tuple([kv for kv in cell.items() if kv[0] not in _CONTENT])
        if not look:
            return 0
        xf_id = self._looks.get(look)
        if xf_id is None:
            xf_id = self._looks[look] = self._look(cell)
        return xf_id

    def _look(self, cell: dict) -> int:
        fill_key, font_key = _look_xml(tuple([kv for kv in cell.items() if kv[0] not in _CONTENT]))
        if fill_key is None and font_key is None:
            return 0
        fill_id = 0
        if fill_key is not None:
            fill_id = self._fill_ids.setdefault(fill_key, len(self.fills))
            if fill_id == len(self.fills):
                self.fills.append(fill_key)
        font_id = 0
        if font_key is not None:
            font_id = self._font_ids.setdefault(font_key, len(self.fonts))
            if font_id == len(self.fonts):
                self.fonts.append(font_key)
        key = (fill_id, font_id)
        xf_id = self._xf_ids.setdefault(key, len(self.xfs))
        if xf_id == len(self.xfs):
            self.xfs.append(f'<xf fillId="{fill_id}" fontId="{font_id}" applyFill="1"/>')
        return xf_id

    def xml(self) -> str:
        return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                f'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                f'<fonts count="{len(self.fonts)}">{"".join(self.fonts)}</fonts>'
                f'<fills count="{len(self.fills)}">{"".join(self.fills)}</fills>'
                f'<cellXfs count="{len(self.xfs)}">{"".join(self.xfs)}</cellXfs></styleSheet>')


THEME_XML = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
             '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="t"><a:themeElements>'
             '<a:clrScheme name="c"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1>'
             '<a:lt1><a:sysClr val="window" lastClr="FFFFFF"/></a:lt1><a:dk2><a:srgbClr val="44546A"/></a:dk2>'
             '<a:lt2><a:srgbClr val="E7E6E6"/></a:lt2><a:accent1><a:srgbClr val="4472C4"/></a:accent1>'
             '<a:accent2><a:srgbClr val="ED7D31"/></a:accent2><a:accent3><a:srgbClr val="A5A5A5"/></a:accent3>'
             '<a:accent4><a:srgbClr val="FFC000"/></a:accent4><a:accent5><a:srgbClr val="5B9BD5"/></a:accent5>'
             '<a:accent6><a:srgbClr val="70AD47"/></a:accent6><a:hlink><a:srgbClr val="0563C1"/></a:hlink>'
             '<a:folHlink><a:srgbClr val="954F72"/></a:folHlink></a:clrScheme></a:themeElements></a:theme>')


CONTENT_TYPES_XML = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/'
                     'content-types"><Default Extension="xml" ContentType="application/xml"/>'
                     '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                     '</Types>')
RELS_XML = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/'
            'package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/'
            'officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')


_SMALL = 4096   # bytes of a member that needs no larger window; a small one's tables are set up in a tenth of the time


def _member(text: str) -> tuple[int, int, bytes]:
    """(CRC, size, deflated bytes) of a zip member."""
    data = text.encode()
    if len(data) > _SMALL:
        return zlib.crc32(data), len(data), zlib.compress(data, 6, -15)
    deflate = zlib.compressobj(6, zlib.DEFLATED, -12, 5)
    return zlib.crc32(data), len(data), deflate.compress(data) + deflate.flush()


def _entry(name: str, text: str) -> tuple[bytes, bytes, bytes]:
    """(local header, name and content; directory entry up to its offset; name) of a deflated zip member."""
    crc, size, packed = _member(text)
    raw = name.encode()
    fields = struct.pack("<5H3L2H", 20, 0, 8, 0, 33, crc, len(packed), size, len(raw), 0)   # version, flags, deflate, time, 1980-01-01
    return (b"".join((b"PK\x03\x04", fields, raw, packed)),
            b"".join((b"PK\x01\x02\x14\x00", fields, bytes(10))), raw)


_shared_entry = lru_cache(256)(_entry)       # parts that many workbooks have in common are compressed once a task


def _zipped(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A zip of deflated members (``zipfile`` can write no member that is compressed already)."""
    directory, at = [], 0
    for local, entry, raw in entries:
        directory += (entry, at.to_bytes(4, "little"), raw)
        at += len(local)
    tail = b"".join(directory)
    return b"".join([*(e[0] for e in entries), tail,
                     struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(entries), len(entries), len(tail), at, 0)])


def workbook_bytes(sheets: list[tuple[str, list[list], list[tuple[int, int, int, int]]]],
                   omit_refs: bool = False) -> bytes:
    """sheets: [(name, rows, merges)], merges as (r0, c0, r1, c1) 0-based.
    ``None`` rows are gaps (not written); ``None`` cells are not written."""
    styles = _Styles()
    shared: list[str] = []
    shared_ids: dict[str, int] = {}
    sheet_xml = []
    for _name, rows, merges in sheets:
        out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
               '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
        for r, row in enumerate(rows):
            if row is None:
                continue
            number = r + 1
            out.append(f'<row r="{number}">' if not omit_refs else "<row>")
            for c, cell in enumerate(row):
                if cell is None:
                    continue
                attr = "" if omit_refs else f' r="{_letters(c)}{number}"'
                if isinstance(cell, dict):
                    d, v, kind = cell, cell.get("v"), cell.get("t")
                    s = styles.xf(d)
                    if s:
                        attr += f' s="{s}"'
                else:
                    d, v, kind = {}, cell, None
                if v is None:
                    out.append(f"<c{attr}/>")
                elif isinstance(v, bool):
                    out.append(f'<c{attr} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)) and kind != "f":
                    out.append(f"<c{attr}><v>{v!r}</v></c>")
                elif kind == "f":
                    out.append(f'<c{attr}><f>{escape(d.get("formula", "1+1"))}</f><v>{escape(str(v))}</v></c>')
                elif kind == "inline":
                    out.append(f'<c{attr} t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>')
                elif kind == "rich":
                    half = len(v) // 2
                    out.append(f'<c{attr} t="inlineStr"><is><r><t xml:space="preserve">{_text(v[:half])}</t></r>'
                               f'<r><rPr><b/></rPr><t xml:space="preserve">{_text(v[half:])}</t></r></is></c>')
                else:
                    i = shared_ids.setdefault(v, len(shared))
                    if i == len(shared):
                        shared.append(v)
                    out.append(f'<c{attr} t="s"><v>{i}</v></c>')
            out.append("</row>")
        out.append("</sheetData>")
        if merges:
            out.append(f'<mergeCells count="{len(merges)}">')
            out += [f'<mergeCell ref="{ref(r0, c0)}:{ref(r1, c1)}"/>' for r0, c0, r1, c1 in merges]
            out.append("</mergeCells>")
        out.append("</worksheet>")
        sheet_xml.append("".join(out))
    sheets_el = "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>'
                        for i, (n, _, _) in enumerate(sheets))
    rels = "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                   f'relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
    sst = "".join(f'<si><t xml:space="preserve">{_text(t)}</t></si>' for t in shared)
    return _zipped([
        _shared_entry("[Content_Types].xml", CONTENT_TYPES_XML),
        _shared_entry("_rels/.rels", RELS_XML),
        _entry("xl/workbook.xml",
            '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/'
            'spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/'
            f'relationships"><sheets>{sheets_el}</sheets></workbook>'),
        _shared_entry("xl/_rels/workbook.xml.rels",
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/'
            f'package/2006/relationships">{rels}</Relationships>'),
        *(_entry(f"xl/worksheets/sheet{i + 1}.xml", x) for i, x in enumerate(sheet_xml)),
        _shared_entry("xl/styles.xml", styles.xml()),
        _shared_entry("xl/theme/theme1.xml", THEME_XML),
        _entry("xl/sharedStrings.xml",
            '<?xml version="1.0" encoding="UTF-8"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/'
            f'2006/main" count="{len(shared)}" uniqueCount="{len(shared)}">{sst}</sst>')])
