"""Workbook files cut into small XML texts: the only step that handles bytes.

A workbook is a zip of XML members.  Each task opens its files and streams the members
that are wanted, cutting them at element borders: one Spark row for each worksheet row,
shared string and merged range, one for the styles and the theme.  A small workbook's pieces
stay together in one row, so nothing of it has to be joined again.  Nothing is parsed
beyond the borders (and the running row number); the XML is parsed by Spark
(:mod:`sheetlens.sources.xlsx`), where the rows of one large file can be dealt over tasks.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from sheetlens.sources import plain

PART_SCHEMA = ("file string, kind string, sheet_index int, sheet_name string, pos bigint, xml string, error string, "
               "book struct<sheets:array<struct<sheet_index:int,sheet_name:string,pos:array<bigint>,xml:string,merges:array<string>>>,"
               f"strings:string,styles:string,theme:string>, read {plain.READ_SCHEMA}")
_BOOK = pa.struct([("sheets", pa.list_(pa.struct([("sheet_index", pa.int32()), ("sheet_name", pa.string()), ("pos", pa.list_(pa.int64())),
                                                  ("xml", pa.string()), ("merges", pa.list_(pa.string()))]))),
                   ("strings", pa.string()), ("styles", pa.string()), ("theme", pa.string())])
_ARROW = pa.schema([("file", pa.string()), ("kind", pa.string()), ("sheet_index", pa.int32()), ("sheet_name", pa.string()),
                    ("pos", pa.int64()), ("xml", pa.string()), ("error", pa.string()), ("book", _BOOK), ("read", plain.READ)])
SMALL_BYTES = 256 << 10  # of a workbook's members: up to here it is one part, parsed where it is cut
SMALL_MERGES = 256       # merged ranges of such a workbook
_CHUNK = 1 << 18
_ATTR = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ROW_NUMBER = re.compile(rb"""^<row\b[^>]*?\sr\s*=\s*["'](\d+)["']""")
_REF = re.compile(rb"""\sref\s*=\s*["']([^"']*)["']""")


class CutError(Exception):
    """A file that is no readable workbook."""


def _attributes(tag: str) -> dict[str, str]:
    return {m[1]: unescape(m[2] if m[2] is not None else m[3]) for m in _ATTR.finditer(tag)}


class _SmallZip:
    """What is asked of ``zipfile`` here, for the bytes of a small plain zip (no comment, no encryption, stored or deflated
    members).  Whatever is unlike that, or does not hold, is left to ``zipfile`` and its errors."""

    def __init__(self, data: bytes):
        self.data = data
        self.entries: dict[str, tuple[int, int, int, int, int]] = {}  # name: method, CRC, packed and full size, offset
        self.ends: list[int] = []                                     # where the member after each starts
        self.size = 0                                                 # of all members, unpacked
        if len(data) < 22 or data[-22:-18] != b"PK\x05\x06":
            raise ValueError("no plain zip")
        disk, first, here, n, length, at, comment = _END.unpack_from(data, len(data) - 18)
        if disk or first or here != n or comment or at + length != len(data) - 22:
            raise ValueError("no plain zip")
        for _ in range(n):
            sign, need, flags, method, crc, packed, full, name, extra, note, on, offset = _ENTRY.unpack_from(data, at)
            raw = data[at + 46:at + 46 + name]
            if sign != b"PK\x01\x02" or need > 20 or flags & ~0x0800 or method not in (0, 8) or on or extra or b"\0" in raw or not raw.isascii():
                raise ValueError("no plain zip")
            self.entries[raw.decode()] = (method, crc, packed, full, offset)
            self.ends.append(offset)
            self.size += full
            at += 46 + name + note
        self.ends.append(len(data) - 22 - length)
        if at != len(data) - 22 or self.size > SMALL_BYTES or any(x >= y for x, y in zip(self.ends, self.ends[1:])):
            raise ValueError("no plain zip")

    def __enter__(self):
        return self

    def __exit__(self, *fault):
        return None

    def namelist(self):
        return self.entries

    def read(self, path: str) -> bytes:
        method, crc, packed, full, at = self.entries[path]
        start = at + 30 + len(path)
        if self.data[at:at + 4] == b"PK\x03\x04" and self.data[at + 30:start] == path.encode():
            start += int.from_bytes(self.data[at + 28:at + 30], "little")
            out: bytes | None = self.data[start:start + packed]
            if method:
                out = (_unpacked_once if path in _OFTEN_SAME else _unpacked)(out, full)
            if out is not None and len(out) == full and zlib.crc32(out) == crc and start + packed <= self.ends[bisect_right(self.ends, at)]:
                return out
        with zipfile.ZipFile(io.BytesIO(self.data)) as zf:
            return zf.read(path)


def _unpacked(packed: bytes, full: int) -> bytes | None:
    try:
        return zlib.decompressobj(-15).decompress(packed, full + 1)
    except zlib.error:
        return None


_unpacked_once = lru_cache(256)(_unpacked)
_OFTEN_SAME = {"xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/theme/theme1.xml"}   # in workbooks of one writer
_END, _ENTRY = struct.Struct("<4H2LH"), struct.Struct("<4s2xH2H4x3L3HH6xL")


def _member(zf, path: str) -> bytes | None:
    try:
        return zf.read(path)
    except KeyError:
        return None


@lru_cache(256)
def _whole(data: bytes, root: str) -> str:
    """A small member as text without element prefixes; it must end with its root's end."""
    text = re.sub(rb"<(/?)[A-Za-z_][\w.-]*:", rb"<\1", data).decode("utf-8-sig")
    if not re.search(rf"(</{root}\s*>|<{root}[^>]*/>)\s*(<!--.*?-->\s*)*$", text, re.S):
        raise CutError(f"truncated part ({root})")
    return text


@lru_cache(256)
def _targets(rels: bytes) -> dict[str, str]:
    """Member of each relation; workbooks of one writer have many of these parts in common."""
    tags = re.findall(r"<Relationship\s[^>]*>", _whole(rels, "Relationships"))
    return {a.get("Id"): a.get("Target", "") for a in map(_attributes, tags)}


def sheet_list(zf) -> list[tuple[str, str]]:
    """(name, member) of every worksheet in order."""
    book = _member(zf, "xl/workbook.xml")
    if book is None:
        raise CutError("workbook part xl/workbook.xml is missing")
    text = _whole(book, "workbook")
    rels = _member(zf, "xl/_rels/workbook.xml.rels")
    targets = _targets(rels) if rels is not None else {}
    out = []
    for tag in re.findall(r"<sheet\s[^>]*>", text):
        a = _attributes(tag)
        target = targets.get(next((v for k, v in a.items() if k.endswith(":id")), None), "")
        part = (target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))) \
            if target else f"xl/worksheets/sheet{len(out) + 1}.xml"
        out.append((a.get("name", ""), part))
    return out


def choose(names: list[str], sheets) -> list[int]:
    """Positions of the wanted sheets: 'first', 'all', a position, or a name (a missing name: the first)."""
    if not names:
        raise CutError("workbook has no sheets")
    if sheets == "all":
        return list(range(len(names)))
    if isinstance(sheets, int):
        if not 0 <= sheets < len(names):
            raise CutError(f"sheet index {sheets} out of range ({len(names)} sheets)")
        return [sheets]
    return [names.index(sheets)] if sheets in names else [0]


def _skipped(held: bytes, at: int) -> int:
    """End of the comment or CDATA section that starts at ``at``; 0 if it lies beyond what is held."""
    end = b"-->" if held.startswith(b"<!--", at) else b"]]>"
    k = held.find(end, at + 4)
    return k + 3 if k >= 0 else 0


def _element_end(held: bytes, end_tag: bytes, at: int) -> int:
    """End of an element whose content starts at ``at``: its end tag is no text of a comment or CDATA section."""
    while True:
        k = held.find(end_tag, at)
        c = min((x for x in (held.find(b"<!--", at), held.find(b"<![CDATA[", at)) if x >= 0), default=-1)
        if k < 0 or c < 0 or k < c:
            return held.find(b">", k) + 1 if k >= 0 else 0
        at = _skipped(held, c)
        if not at:
            return 0


def elements(stream: io.BufferedIOBase, names: tuple[str, ...], root: str) -> Iterator[bytes]:
    """The elements ``names`` of a member, cut out of its bytes in order (prefixes removed).  The member must go on
    to its root's end tag, or be one root that closes itself; what stands in comments and CDATA is no element."""
    start = re.compile(rb"<!--|<!\[CDATA\[|<(?:[A-Za-z_][\w.-]*:)?(" + "|".join(names).encode() + rb")(?=[\s/>])")
    held, head, tail, read = b"", b"", b"", 0
    while True:
        chunk = stream.read(_CHUNK)
        held += chunk
        read += len(chunk)
        head = head or chunk
        at = 0
        while True:
            m = start.search(held, at)
            if m is None:
                at = max(at, len(held) - 64) if chunk else len(held)   # a tag may be cut by the chunk's end
                break
            if m[1] is None:
                end = _skipped(held, m.start())
                if not end:
                    at = m.start()
                    break
                at = end
                continue
            close = held.find(b">", m.end())
            if close < 0:
                at = m.start()
                break
            if held[close - 1] == 47:                                  # <row .../>
                end = close + 1
            else:
                end = _element_end(held, b"</" + held[m.start() + 1:m.end()], close)
                if not end:
                    at = m.start()
                    break
            piece = held[m.start():end]
            prefix = held[m.start() + 1:m.start(1)]
            yield re.sub(rb"<(/?)" + re.escape(prefix), rb"<\1", piece) if prefix else piece
            at = end
        tail = (tail + held[:at])[-256:] if at else tail
        held = held[at:]
        if not chunk:
            break
    tail = (tail + held)[-256:]
    _end_of_root(tail, head if read == len(head) else None, root)


@lru_cache(16)
def _root_ends(root: str) -> tuple[re.Pattern, re.Pattern]:
    after = rb"\s*(?:<!--(?:(?!-->).)*-->\s*)*"
    name = rb"(?:[A-Za-z_][\w.-]*:)?" + root.encode()
    alone = rb"(?:\xef\xbb\xbf)?\s*(?:<\?[^>]*\?>\s*)?" + after + rb"<" + name + rb"(?:\s[^<>]*)?/>" + after
    return re.compile(rb"</" + name + rb"\s*>" + after + rb"$", re.S), re.compile(alone, re.S)


def _end_of_root(tail: bytes, whole: bytes | None, root: str) -> None:
    """Raise if a member with the last bytes ``tail`` ends before its root does."""
    end, alone = _root_ends(root)
    if not end.search(tail) and (whole is None or not alone.fullmatch(whole)):
        raise CutError(f"truncated part ({root})")


@lru_cache(16)
def _plain(names: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """(an element with one of the names, or the start of one that does not end; one with a prefix)."""
    one = "|".join(names).encode()
    return (re.compile(rb"<(" + one + rb")(?=[\s/>])(?:[^>]*/>|[^>]*(?<!/)>.*?</\1[^>]*>|())", re.S),
            re.compile(rb"<[A-Za-z_][\w.-]*:(?:" + one + rb")[\s/>]"))


def _member_elements(zf, path: str, names: tuple[str, ...], root: str) -> Iterator[bytes]:
    """:func:`elements` of a member.  A small one without comments, CDATA and prefixes is cut by one pattern."""
    if not isinstance(zf, _SmallZip):
        with zf.open(path) as f:
            yield from elements(f, names, root)
        return
    data = zf.read(path)
    element, prefixed = _plain(names)
    if b"<!" in data or prefixed.search(data):
        yield from elements(io.BytesIO(data), names, root)
        return
    for m in element.finditer(data):
        if m[2] is not None:
            break
        yield m[0]
    _end_of_root(data[-256:], data, root)


def _open(source):
    """The zip of a file or of bytes."""
    if isinstance(source, bytes):
        try:
            return _SmallZip(source)
        except (ValueError, struct.error):
            source = io.BytesIO(source)
    try:
        return zipfile.ZipFile(source)
    except zipfile.BadZipFile as e:
        raise CutError(f"not a workbook (bad zip): {e}") from None


def _pieces(content: bytes, sheets, styles: bool, cells: bool) -> Iterator[tuple]:
    """(kind, sheet index, sheet name, position, xml) of one workbook's bytes."""
    with _open(io.BytesIO(content)) as zf:
        yield from _book_pieces(zf, sheets, styles, cells)


def _book_pieces(zf, sheets, styles: bool, cells: bool, only: int | None = None) -> Iterator[tuple]:
    """(kind, sheet index, sheet name, position, xml) of one workbook.  ``only``: of one of the chosen sheets, or -1
    for all that belongs to none."""
    found = sheet_list(zf)
    if only is None or only < 0:
        for k, (name, _) in enumerate(found):
            yield "sheet", k, name, k, None
        if not cells:
            return
        shared = "xl/sharedStrings.xml" in zf.namelist()
        if shared:
            for i, xml in enumerate(_member_elements(zf, "xl/sharedStrings.xml", ("si",), "sst")):
                yield "string", None, None, i, xml.decode()
        if styles:
            for kind, path, root in (("styles", "xl/styles.xml", "styleSheet"), ("theme", "xl/theme/theme1.xml", "theme")):
                data = _member(zf, path)
                if data is not None:
                    yield kind, None, None, 0, _whole(data, root)
    for k in choose([n for n, _ in found], sheets) if only is None else [only] if only >= 0 else []:
        name, part = found[k]
        if part not in zf.namelist():
            raise CutError(f"missing sheet part {part}")
        row, merge = -1, 0
        for xml in _member_elements(zf, part, ("row", "mergeCell"), "worksheet"):
            if xml.startswith(b"<row"):
                m = _ROW_NUMBER.match(xml)
                at = int(m[1]) - 1 if m else row + 1
                if at <= row:
                    raise CutError(f"rows of sheet {name!r} are out of order")
                row = at
                yield "row", k, name, row, xml.decode()
            else:
                m = _REF.search(xml)
                yield "merge", k, name, merge, m[1].decode() if m else ""
                merge += 1


def _plain_book(zf, sheets, styles: bool) -> tuple | None:
    """(what :func:`sheetlens.sources.plain.read` gives, bytes read) of a small workbook; None if it is not plain or has a fault."""
    found = sheet_list(zf)
    members = zf.namelist()
    chosen, size = [], 0
    for k in choose([n for n, _ in found], sheets):
        name, part = found[k]
        data = _member(zf, part) if part in members else None
        cut = plain.sheet_rows(data) if data is not None else None
        if cut is None or len(cut[1]) > SMALL_MERGES:
            return None
        chosen.append((k, name, *cut))
        size += len(cut[0])
    if sum(len(refs) for *_, refs in chosen) > SMALL_MERGES:
        return None
    strings = _member(zf, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in members else None
    items = plain.strings_items(strings) if strings is not None else b""
    if items is None:
        return None
    look = [None, None]
    if styles:
        look = [_whole(data, root) if (data := _member(zf, path)) is not None else None
                for path, root in (("xl/styles.xml", "styleSheet"), ("xl/theme/theme1.xml", "theme"))]
    read = plain.read(chosen, items, *look)
    return None if read is None else (read, size + len(items))


def _plain_or_none(zf, sheets, styles: bool) -> tuple | None:
    try:
        return _plain_book(zf, sheets, styles)
    except Exception:  # noqa: BLE001 - cutting it piece by piece names the first fault
        return None


def _is_small(zf) -> bool:
    return isinstance(zf, _SmallZip) or sum(i.file_size for i in zf.infolist()) <= SMALL_BYTES


def _together(pieces: list[tuple], chosen: list[int]) -> dict:
    """The pieces of a small workbook as one value; its chosen sheets in order."""
    book: dict = {"sheets": [], "strings": None, "styles": None, "theme": None}
    names = [name for kind, _, name, _, _ in pieces if kind == "sheet"]
    of = {k: {"sheet_index": k, "sheet_name": names[k], "pos": [], "xml": [], "merges": []} for k in chosen}
    strings = []
    for kind, k, _, pos, xml in pieces:
        if kind == "row":
            of[k]["pos"].append(pos)
            of[k]["xml"].append(xml)
        elif kind == "merge":
            of[k]["merges"].append(xml)
        elif kind == "string":
            strings.append(xml)
        elif kind != "sheet":
            book[kind] = xml
    if strings:
        book["strings"] = f"<sst>{''.join(strings)}</sst>"
    for s in of.values():
        s["xml"] = f"<rows>{''.join(s['xml'])}</rows>"
        book["sheets"].append(s)
    return book


def part_batches(books: Iterator[tuple], sheets, styles: bool, cells: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of :data:`PART_SCHEMA` of ``books``: (path, function that gives a file to read, only).  A book
    that cannot be cut gives a row of kind 'error'.  Whole small books are one row of kind 'read', or of kind 'book' if
    their XML is not plain or they cannot be cut (with ``error``)."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in held], f.type) for i, f in enumerate(_ARROW) if f.name != "read"]
        batch = pa.RecordBatch.from_arrays([*columns, plain.column([r[-1] for r in held])], schema=_ARROW)
        held.clear()
        return batch

    for path, source, only in books:
        small = cells and only is None
        try:
            with _open(source()) as zf:
                small = small and _is_small(zf)
                read = _plain_or_none(zf, sheets, styles) if small else None
                if read is not None:
                    held.append((path, "read", None, None, None, None, None, None, read[0]))
                    size += read[1]
                pieces = _book_pieces(zf, sheets, styles, cells, only) if read is None else []
                if small and read is None:
                    pieces = list(pieces)
                    if sum(p[0] == "merge" for p in pieces) <= SMALL_MERGES:
                        chosen = choose([p[2] for p in pieces if p[0] == "sheet"], sheets)
                        held.append((path, "book", None, None, None, None, None, _together(pieces, chosen), None))
                        size += sum(len(p[4] or "") for p in pieces)
                        pieces = []
                for kind, k, name, pos, xml in pieces:
                    held.append((path, kind, k, name, pos, xml, None, None, None))
                    size += len(xml or "")
                    if len(held) >= 4096 or size > 4_000_000:
                        yield out()
                        size = 0
        except Exception as e:  # noqa: BLE001 - any fault isolates this file
            what = "DecodeError" if isinstance(e, CutError) else type(e).__name__
            held.append((path, "book" if small else "error", None, None, None, None, f"{what}: {e}", None, None))
        if len(held) >= 1024 or size > 4_000_000:
            yield out()
            size = 0
    if held:
        yield out()


def cut_workbooks(files: DataFrame, sheets="first", styles: bool = True, cells: bool = True) -> DataFrame:
    """(path, content) -> :data:`PART_SCHEMA`.  A file that cannot be cut gives a row of kind 'error' or 'book' (pieces
    that came before the fault may be there as well).  ``cells=False``: only the sheet list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def books() -> Iterator[tuple]:
            for b in batches:
                content = b.column("content")
                for i, path in enumerate(b.column("path").to_pylist()):
                    yield path, lambda i=i: content[i].as_py() or b"", None

        yield from part_batches(books(), sheets, styles, cells)

    return files.select("path", "content").mapInArrow(run, PART_SCHEMA)
