"""Facts of PDF files as one wide row a file, and the fact tables that come out of it by exploding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dossierlake.parse.content import Page, to_unicode
from dossierlake.parse.objects import Broken, Document, Name, Ref, Stream, shown
from dossierlake.parse.scan_text import decompressed, scan_text

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
#: The wide row. Arrays are fact tables: table() explodes them.
SCHEMA = f"""path string, length long, md5 string, sha256 string, head string, nul_runs int, blank_runs int, ok boolean, error_type string, error_message string, text string, version string, is_encrypted boolean, is_form boolean, is_xfa boolean, page_count int, language string, info map<string,string>,
 objects array<struct<xref:int,gen:int,is_free:boolean,is_stream:boolean,filters:array<string>,obj_text:string>>, defined array<int>, referenced array<int>, slots int, empty_slots array<int>,
 pages array<struct<page:int,mediabox:{RECT},cropbox:{RECT},rotation:int,n_drawings:int,text:string,touchup:string,digest:string>>,
 fonts array<struct<xref:int,basefont:string,subtype:string,obj_text:string,has_file:boolean,remapped:struct<from_code:int,to_text:string>>>,
 images array<struct<page:int,xref:int,colorspace:string,filters:array<string>,area:double,data:binary,md5:string>>,
 annots array<struct<page:int,subtype:string,flags:int,rect:{RECT}>>, widgets array<struct<page:int,field_name:string,field_value:string,rect:{RECT}>>,
 toc array<struct<place:int,level:int,title:string,page:int>>, lines array<struct<page:int,bbox:{RECT},text:string>>, scripts array<struct<source:string,xref:int,code:string>>"""  # fmt: skip


def _rect(doc: Document, x: Any) -> dict[str, float] | None:
    v = [doc.resolve(e) for e in doc.list_of(x)]
    if len(v) != 4 or not all(isinstance(e, (int, float)) and not isinstance(e, bool) for e in v):
        return None
    return {"x0": float(min(v[0], v[2])), "y0": float(min(v[1], v[3])), "x1": float(max(v[0], v[2])), "y1": float(max(v[1], v[3]))}


def text_of(x: Any) -> str | None:
    """A text string: UTF-16 with its mark, UTF-8 with its mark, else Latin-1."""
    if isinstance(x, Name):
        return str(x)
    if not isinstance(x, bytes):
        return None if x is None else str(x)
    if x[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return x.decode("utf-16", "replace")
    return x[3:].decode("utf-8", "replace") if x[:3] == b"\xef\xbb\xbf" else x.decode("latin-1")


def _colorspace(doc: Document, x: Any) -> str:
    return shown(doc.resolve(x))[:200] if x is not None else ""


_DEFINED = re.compile(rb"(?<![0-9])(\d{1,9})\s+\d+\s+obj\b")
_REFERENCED = re.compile(rb"(?<![0-9])(\d{1,9})\s+\d+\s+R\b")


def _remapped(cmap: dict[int, str]) -> dict[str, Any] | None:
    """The first printable ASCII code that a map gives another character."""
    for code, to in cmap.items():
        if 32 <= code <= 126 and to and to != chr(code):
            return {"from_code": code, "to_text": to}
    return None


def scripts_of(doc: Document | None, raw: bytes) -> list[dict[str, Any]]:
    """Scripts in streams whose dictionary names JavaScript and in the string or stream that a /JS entry holds; if there are none, streams near a raw
    /JS that read like a script."""
    out = []
    for num in sorted(doc.slots) if doc else []:
        x = doc.get(num)  # type: ignore[union-attr]
        if isinstance(x, Stream):
            said = shown(x.dict)
            if "/JavaScript" in said or "/JS " in said or "/JS(" in said:
                try:
                    code = doc.decoded(x).decode("utf-8", "replace")  # type: ignore[union-attr]
                except Broken:
                    code = decompressed(x.raw, scripts=True) or ""
                if code.strip():
                    out.append({"source": f"xref_{num}", "xref": num, "code": code.strip()})
    if not out:
        for m in re.finditer(rb"/JS\s*[<(]", raw):
            window = raw[max(0, m.start() - 2000) : m.start() + 5000]
            for s in re.finditer(rb"stream\s*\r?\n(.*?)\r?\nendstream", window, re.S):
                body = s[1].strip()
                code = decompressed(body, scripts=True) if len(body) > 10 else None
                if code and any(w in code for w in ("function", "app.", "this.", "util.")):
                    out.append({"source": "raw_scan", "xref": None, "code": code})
                    break
    return out


def _outline(doc: Document, pages: dict[int, int]) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = []
    names = {}

    def target(item: dict[str, Any]) -> int:
        dest = doc.resolve(item.get("Dest"))
        if dest is None:
            dest = doc.resolve(doc.dict_of(item.get("A")).get("D"))
        dest = names.get(text_of(dest), dest) if isinstance(dest, (bytes, Name)) else dest
        dest = doc.dict_of(dest).get("D", dest) if isinstance(doc.resolve(dest), dict) else dest
        first = (doc.list_of(dest) or [None])[0]
        if isinstance(first, Ref):
            return pages.get(first.num, -1)
        return first + 1 if isinstance(first, int) else -1

    todo, seen = [(doc.root.get("Outlines"), 0)], set()
    while todo and len(out) < 100_000:
        ref, level = todo.pop()
        if isinstance(ref, Ref):
            if ref.num in seen:
                continue
            seen.add(ref.num)
        item = doc.dict_of(ref)
        if not item:
            continue
        if level:
            out.append({"place": len(out), "level": level, "title": text_of(doc.resolve(item.get("Title"))) or "", "page": target(item)})
            todo.append((item.get("Next"), level))
        todo.append((item.get("First"), level + 1))
    return out


def facts_of(path: str, raw: bytes) -> dict[str, Any]:
    """The wide row of one file. A file that cannot be read has ok false and why; its scan text is there all the same."""
    row: dict[str, Any] = {
        "path": path, "length": len(raw), "md5": hashlib.md5(raw).hexdigest(), "sha256": hashlib.sha256(raw).hexdigest(), "head": raw[:4096].decode("latin-1"),
        "nul_runs": len(re.findall(rb"\x00{200,}", raw)), "blank_runs": len(re.findall(rb" {1000,}", raw)), "ok": False, "text": scan_text(raw),
    }
    if not raw:
        return row | {"error_type": "file_corrupt", "error_message": "empty file"}
    try:
        doc = Document(raw)
        pages = doc.page_list()
        if not pages:
            raise Broken("no pages")
    except (Broken, RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError) as e:
        return row | {"error_type": "file_corrupt", "error_message": str(e)[:500], "scripts": scripts_of(None, raw)}
    form = doc.dict_of(doc.root.get("AcroForm"))
    info = doc.dict_of(doc.trailer.get("Info"))
    lang = doc.resolve(doc.root.get("Lang"))
    row |= {
        "ok": True, "version": doc.version, "is_encrypted": "Encrypt" in doc.trailer, "is_form": bool(doc.list_of(form.get("Fields"))), "is_xfa": "XFA" in form, "page_count": len(pages),
        "language": text_of(lang) or None, "info": {k: text_of(doc.resolve(v)) or "" for k, v in info.items()},
        "defined": sorted({int(n) for n in _DEFINED.findall(raw)})[:1_000_000], "referenced": sorted({int(n) for n in _REFERENCED.findall(raw)})[:1_000_000], "slots": max(doc.slots) + 1,
        "empty_slots": [n for n in sorted(doc.slots) if n and doc.get(n) is None],
    }
    objects, fonts = [], []
    for num in sorted(doc.slots):
        x, slot = doc.get(num), doc.slots[num]
        is_stream = isinstance(x, Stream)
        objects.append({"xref": num, "gen": slot[2] if slot[0] == "n" else 0, "is_free": slot[0] == "f", "is_stream": is_stream, "filters": doc.filters(x) if is_stream else [], "obj_text": shown(x)[:20_000]})
        d = x if isinstance(x, dict) else {}
        if d.get("Type") == "Font" and isinstance(doc.resolve(d.get("BaseFont")), Name):
            inner = [doc.dict_of(f) for f in doc.list_of(d.get("DescendantFonts"))] + [d]
            held = any(k.startswith("FontFile") for f in inner for k in doc.dict_of(f.get("FontDescriptor")))
            cmap = doc.resolve(d.get("ToUnicode"))
            try:
                odd = _remapped(to_unicode(doc.decoded(cmap))) if isinstance(cmap, Stream) else None
            except Broken:
                odd = None
            fonts.append({"xref": num, "basefont": str(doc.resolve(d["BaseFont"])), "subtype": str(d.get("Subtype", "")), "obj_text": shown(d)[:20_000], "has_file": held, "remapped": odd})
    row |= {"objects": objects, "fonts": fonts, "pages": [], "images": [], "annots": [], "widgets": [], "lines": []}
    for n, (_, page) in enumerate(pages, 1):
        media = _rect(doc, page.get("MediaBox")) or {"x0": 0.0, "y0": 0.0, "x1": 612.0, "y1": 792.0}
        drawn = Page(doc, page)
        rotation = doc.resolve(page.get("Rotate"))
        row["pages"].append({
            "page": n, "mediabox": media, "cropbox": _rect(doc, page.get("CropBox")) or media, "rotation": rotation % 360 if isinstance(rotation, int) else 0, "n_drawings": drawn.paths, "text": drawn.text(), "touchup": drawn.text(True),
            "digest": hashlib.sha256(drawn.content + shown(page.get("Resources")).encode()).hexdigest(),
        })
        row["lines"] += [{"page": n, "bbox": dict(zip(("x0", "y0", "x1", "y1"), x[:4])), "text": x[4]} for x in drawn.lines()]
        for ref in doc.dict_of(doc.dict_of(page.get("Resources")).get("XObject")).values():
            x = doc.resolve(ref)
            if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                w, h = (doc.resolve(x.dict.get(k)) for k in ("Width", "Height"))
                row["images"].append({"page": n, "xref": ref.num if isinstance(ref, Ref) else None, "colorspace": _colorspace(doc, x.dict.get("ColorSpace")), "filters": doc.filters(x), "area": float(w * h) if isinstance(w, int) and isinstance(h, int) else None, "data": x.raw, "md5": hashlib.md5(x.raw).hexdigest()})
        for ref in doc.list_of(page.get("Annots")):
            a = doc.dict_of(ref)
            kind, flags, rect = str(doc.resolve(a.get("Subtype")) or ""), doc.resolve(a.get("F")), _rect(doc, a.get("Rect"))
            if kind == "Widget":
                parent = doc.dict_of(a.get("Parent"))
                name, value = (next((text_of(doc.resolve(d[k])) for d in (a, parent) if k in d), None) for k in ("T", "V"))
                row["widgets"].append({"page": n, "field_name": name or "", "field_value": value or "", "rect": rect})
            elif kind:
                row["annots"].append({"page": n, "subtype": kind, "flags": flags if isinstance(flags, int) else 0, "rect": rect})
    row["toc"] = _outline(doc, {num: k for k, (num, _) in enumerate(pages, 1)})
    row["scripts"] = scripts_of(doc, raw)
    return row


def facts(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One wide row a file (see SCHEMA). Write it out before exploding it: reading files is the dear part. A null content is an empty file."""
    schema = T.StructType.fromDDL(SCHEMA.replace("\n", " "))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # files are large: one at a time
                path, raw = b.column(0)[k].as_py(), b.column(1)[k].as_py() or b""
                try:
                    row = facts_of(path, raw)
                except Exception as e:  # a hostile file must not end the job
                    row = {"path": path, "ok": False, "error_type": "processing_error", "error_message": f"{type(e).__name__}: {e}"[:500]}
                row["info"] = list((row.get("info") or {}).items())
                yield pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in arrow}], schema=arrow)

    return files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, schema)


def table(wide: DataFrame, name: str) -> DataFrame:
    """A fact table: path and the fields of one of the arrays."""
    return wide.select("path", F.explode(name).alias("x")).select("path", "x.*")


def page_count(content: bytes | None) -> int:
    """Pages of a file's bytes; 0 if they cannot be read."""
    try:
        return len(Document(content).page_list()) if content else 0
    except (Broken, RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError):
        return 0
