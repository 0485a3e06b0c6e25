"""The scan text of a file: decoded streams, both ends of the raw bytes, and the XMP packet, one character a byte."""

from __future__ import annotations

import binascii
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.parse.objects import ascii85, ascii_hex
from dossierlake.sources.files import WINDOW

#: Streams above this many bytes are not decoded.
MOST_STREAM = 500_000
_STREAM = re.compile(rb"stream\b(.*?)\bendstream", re.S)
_PACKET = re.compile(rb"<\?xpacket begin=.*?\?>.*?<\?xpacket end=[^>]*\?>", re.S)


def decompressed(body: bytes, scripts: bool = False) -> str | None:
    """A stream's body through the first decoder that takes it: flate, ASCII85, hex; as latin-1. For scripts: flate without its frame too,
    as UTF-8, and at last the bytes as they are."""
    raw = (lambda b: zlib.decompress(b, -zlib.MAX_WBITS),) if scripts else ()
    for decode in (zlib.decompress, *raw, _framed85, _hex):
        try:
            out = decode(body)
        except (ValueError, zlib.error, binascii.Error):
            continue
        return out.decode("utf-8", "replace") if scripts else out.decode("latin-1")
    return body.decode("utf-8", "replace") if scripts else None


def _framed85(body: bytes) -> bytes:
    if not b"".join(body.split()).endswith(b"~>"):
        raise ValueError("no frame")
    return ascii85(body)


def _hex(body: bytes) -> bytes:
    digits = b"".join(body.replace(b">", b"").split())
    if not digits or not re.fullmatch(rb"[0-9A-Fa-f]+", digits) or len(digits) % 2:
        raise ValueError("no hex digits")
    return ascii_hex(digits)


def scan_text(raw: bytes, most: int = MOST_STREAM) -> str:
    """All decoded streams, the first and (of larger files) the last million bytes, the packet, and a marker if TouchUp stands anywhere. Of
    files between one and two millions the ends overlap, and what is counted there counts twice."""
    parts, touched = [], b"touchup_textedit" in raw.lower()
    for m in _STREAM.finditer(raw):
        body = m[1].strip(b"\r\n ")
        if len(body) <= most:
            text = decompressed(body)
            if text is not None:
                parts.append(text)
                touched = touched or "touchup" in text.lower()
    parts.append(raw[:WINDOW].decode("latin-1"))
    if len(raw) > WINDOW:
        parts.append(raw[-WINDOW:].decode("latin-1"))
    packet = _PACKET.search(raw)
    if packet:
        parts.append(packet[0].decode("utf-8", "ignore"))
    if touched:
        parts.append("TouchUp_TextEdit")
    return "\n".join(parts)


def scan_texts(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, text. A null content gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # files are large: one at a time
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([scan_text(b.column(1)[k].as_py() or b"")], pa.string())], ["path", "text"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, "path string, text string")
