"""Content streams: text runs with their places, and what TouchUp marks cover."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from dossierlake.parse.objects import Broken, Document, Name, Ref, Stream, Word, parse

#: Forms drawn within forms, and operators of a page, that are followed.
NESTED, MOST_OPERATORS = 6, 5_000_000
# Operators that paint a path, and those that show text.
PAINT = frozenset("S s f F f* B B* b b*".split())
SHOW = frozenset(["Tj", "TJ", "'", '"'])


class Run(NamedTuple):
    """Text shown by one operator: where its baseline begins, its size, whether a TouchUp mark covers it."""

    x: float
    y: float
    size: float
    text: str
    touched: bool


def operators(data: bytes) -> Iterator[tuple[list[Any], str]]:
    """(operands, operator); what cannot be read is passed over. An inline image is one operator, BI."""
    at, held, n = 0, [], 0
    while n < MOST_OPERATORS:
        try:
            x, at = parse(data, at)
        except Broken:
            return
        if not isinstance(x, Word):
            held.append(x)
            continue
        n += 1
        if x == "ID":
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, at)
            at = end.end() if end else len(data)
            x = Word("BI")
        elif x == "BI":
            held = []
            continue
        yield held, str(x)
        held = []


_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Code to text, from the character and range sections of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for section in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        codes = [re.sub(rb"\s", b"", h) for h in _HEX.findall(section)]
        for a, b in zip(codes[::2], codes[1::2]):
            if a and len(b) % 4 == 0:
                out[int(a, 16)] = text(b)
    for section in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", section):
            a, b = int(low, 16), min(int(high, 16), int(low, 16) + 65_535)
            if one and len(one) % 4 == 0 and len(one) >= 4:
                base = text(one)
                for k in range(a, b + 1):
                    out[k] = base[:-1] + chr(min(ord(base[-1]) + k - a, 0x10FFFF))
            for k, h in enumerate(_HEX.findall(many)):
                if a + k <= b and len(h) % 4 == 0:
                    out[a + k] = text(h)
    return out


class Font:
    """How the bytes of a shown string become text."""

    def __init__(self, doc: Document, d: dict[str, Any]) -> None:
        self.two = d.get("Subtype") == "Type0"
        cmap = doc.resolve(d.get("ToUnicode"))
        try:
            self.map = to_unicode(doc.decoded(cmap)) if isinstance(cmap, Stream) else {}
        except Broken:
            self.map = {}
        encoding = doc.dict_of(d.get("Encoding"))
        code = 0
        for x in doc.list_of(encoding.get("Differences")):
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if code not in self.map and len(x) == 1:
                    self.map[code] = str(x)
                elif code not in self.map and (m := re.fullmatch(r"uni([0-9A-Fa-f]{4})", x)):
                    self.map[code] = chr(int(m[1], 16))
                code += 1

    def text(self, raw: bytes) -> str:
        if self.two:
            return "".join(self.map.get(int.from_bytes(raw[k : k + 2]), "�") for k in range(0, len(raw) - 1, 2))
        return "".join(self.map.get(b) or bytes([b]).decode("cp1252", "replace") for b in raw)


def _times(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """The runs and the number of painted paths of a page."""

    def __init__(self, doc: Document, page: dict[str, Any]) -> None:
        self.doc, self.runs, self.paths, self.fonts = doc, [], 0, {}
        parts = []
        for x in doc.list_of(page.get("Contents")):
            s = doc.resolve(x)
            if isinstance(s, Stream):
                try:
                    parts.append(doc.decoded(s))
                except Broken:
                    continue
        self.content = b"\n".join(parts)
        self._read(self.content, doc.dict_of(page.get("Resources")), _SAME, 0, False)

    def _font(self, resources: dict[str, Any], name: str) -> Font | None:
        ref = self.doc.dict_of(resources.get("Font")).get(name)
        key = ref.num if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            d = self.doc.dict_of(ref)
            self.fonts[key] = Font(self.doc, d) if d else None
        return self.fonts[key]

    def _marks(self, resources: dict[str, Any], operands: list[Any]) -> bool:
        """Whether the tag of marked content, or its properties, say TouchUp."""
        properties = self.doc.dict_of(resources.get("Properties"))
        return any("TouchUp" in str(x) or ("TouchUp" in str(self.doc.resolve(properties.get(x))) if isinstance(x, Name) else False) for x in operands)

    def _read(self, data: bytes, resources: dict[str, Any], ctm: tuple[float, ...], depth: int, touched: bool) -> None:
        saved: list[tuple] = []
        marks, armed, flagged = [touched], False, False
        font, size, leading, tm, line = None, 0.0, 0.0, _SAME, _SAME

        def show(raw: Any) -> None:
            nonlocal tm
            if not isinstance(raw, bytes):
                return
            text = font.text(raw) if font else raw.decode("cp1252", "replace")
            place = _times(tm, ctm)
            height = abs(size) * (place[2] ** 2 + place[3] ** 2) ** 0.5
            self.runs.append(Run(place[4], place[5], height, text, marks[-1] or flagged))
            tm = _times((1, 0, 0, 1, 0.5 * size * len(text), 0), tm)

        for operands, op in operators(data):
            numbers = [float(x) for x in operands if isinstance(x, (int, float)) and not isinstance(x, bool)]
            if op == "q":
                saved.append((ctm, font, size, leading))
            elif op == "Q" and saved:
                ctm, font, size, leading = saved.pop()
            elif op == "cm" and len(numbers) == 6:
                ctm = _times(tuple(numbers), ctm)
            elif op in ("BDC", "BMC"):
                marks.append(marks[-1] or self._marks(resources, operands))
            elif op == "EMC":
                if len(marks) > 1:
                    marks.pop()
                armed = flagged = False
            elif op in ("MP", "DP"):
                armed = armed or self._marks(resources, operands)
            elif op == "BT":
                tm = line = _SAME
                flagged, armed = flagged or armed, False
            elif op == "ET":
                flagged = False
            elif op == "Tf" and operands and isinstance(operands[0], Name):
                font, size = self._font(resources, str(operands[0])), numbers[-1] if numbers else 0.0
            elif op == "TL" and numbers:
                leading = numbers[-1]
            elif op in ("Td", "TD") and len(numbers) == 2:
                leading = -numbers[1] if op == "TD" else leading
                tm = line = _times((1, 0, 0, 1, *numbers), line)
            elif op == "Tm" and len(numbers) == 6:
                tm = line = tuple(numbers)
            elif op == "T*":
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
            elif op in SHOW:
                if op in ("'", '"'):
                    tm = line = _times((1, 0, 0, 1, 0, -leading), line)
                last = operands[-1] if operands else None
                if op == "TJ" and isinstance(last, list):
                    font_ = font
                    pieces = [x for x in last if isinstance(x, bytes)]
                    gaps = any(isinstance(x, (int, float)) and x < -200 for x in last)
                    if font_ is not None and font_.two or not gaps:
                        show(b"".join(pieces))
                    else:
                        show(b"".join(b" " if isinstance(x, (int, float)) and x < -200 else x if isinstance(x, bytes) else b"" for x in last))
                else:
                    show(last)
            elif op in PAINT:
                self.paths += 1
            elif op == "Do" and operands and isinstance(operands[0], Name) and depth < NESTED:
                x = self.doc.resolve(self.doc.dict_of(resources.get("XObject")).get(str(operands[0])))
                if isinstance(x, Stream) and x.dict.get("Subtype") == "Form":
                    own = [float(v) for v in self.doc.list_of(x.dict.get("Matrix")) if isinstance(v, (int, float))]
                    try:
                        self._read(self.doc.decoded(x), self.doc.dict_of(x.dict.get("Resources")) or resources, _times(tuple(own), ctm) if len(own) == 6 else ctm, depth + 1, marks[-1] or flagged)
                    except Broken:
                        continue

    def lines(self, touched_only: bool = False) -> list[tuple[float, float, float, float, str]]:
        """(x0, y0, x1, y1, text) of text lines: runs whose baselines are within a third of their size, from the top, each from the left."""
        runs = sorted((r for r in self.runs if r.text.strip() and (r.touched or not touched_only)), key=lambda r: (-r.y, r.x))
        out: list[list[Run]] = []
        for r in runs:
            if out and abs(out[-1][0].y - r.y) <= max(1.0, out[-1][0].size / 3):
                out[-1].append(r)
            else:
                out.append([r])
        found = []
        for group in out:
            group.sort(key=lambda r: r.x)
            text, end = "", None
            for r in group:
                text += (" " if end is not None and r.x - end > 0.15 * r.size and not text.endswith(" ") and not r.text.startswith(" ") else "") + r.text
                end = r.x + 0.5 * r.size * len(r.text)
            found.append((group[0].x, min(r.y for r in group), end or 0.0, max(r.y + r.size for r in group), text.strip()))
        return found

    def text(self, touched_only: bool = False) -> str:
        return "\n".join(x[4] for x in self.lines(touched_only))
