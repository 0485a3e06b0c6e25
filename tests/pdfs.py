"""A small writer of PDF files for tests."""

from __future__ import annotations

import zlib


def stream(body: bytes, entries: str = "", flate: bool = False) -> bytes:
    body = zlib.compress(body) if flate else body
    return f"<<{entries}{'/Filter/FlateDecode' if flate else ''}/Length {len(body)}>>\nstream\n".encode() + body + b"\nendstream"


def text(*lines: str) -> bytes:
    return b"BT /F1 12 Tf 72 720 Td 14 TL " + b" ".join(f"({x}) Tj T*".encode("latin-1") for x in lines) + b" ET"


def base(content: bytes = text("Hello World"), page: str = "", catalog: str = "", **more: bytes) -> dict[int, bytes]:
    """Objects by number: catalogue, pages, page, font, content; further ones by o<number>."""
    return {
        1: f"<</Type/Catalog/Pages 2 0 R{catalog}>>".encode(), 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 4: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", 5: stream(content),
        3: f"<</Type/Page/MediaBox[0 0 595 842]/Resources<</Font<</F1 4 0 R>>>>/Parent 2 0 R/Contents 5 0 R{page}>>".encode(),
    } | {int(k[1:]): v for k, v in more.items()}


def write(objects: dict[int, bytes], trailer: str = "", version: str = "1.7", prefix: bytes = b"", missing: tuple[int, ...] = ()) -> bytes:
    """A file with a classic table; objects in missing stand in the body but not in the table."""
    out, places = bytearray(prefix + f"%PDF-{version}\n%\xb5\xb6\n".encode("latin-1")), {}
    for n, body in sorted(objects.items()):
        places[n] = len(out) - len(prefix)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    size, at = max(n for n in objects if n not in missing) + 1, len(out) - len(prefix)
    out += f"xref\n0 {size}\n0000000000 65535 f \n".encode()
    for n in range(1, size):
        out += f"{places[n]:010d} 00000 n \n".encode() if n in places and n not in missing else b"0000000000 00001 f \n"
    return bytes(out) + f"trailer\n<</Size {size}/Root 1 0 R{trailer}>>\nstartxref\n{at}\n%%EOF\n".encode()


def update(data: bytes, objects: dict[int, bytes], trailer: str = "") -> bytes:
    """An incremental update."""
    before = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    out, rows = bytearray(data), []
    for n, body in sorted(objects.items()):
        rows.append(f"{n} 1\n{len(out):010d} 00000 n \n")
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    return bytes(out) + b"xref\n" + "".join(rows).encode() + f"trailer\n<</Size {max(objects) + 1}/Root 1 0 R/Prev {before}{trailer}>>\nstartxref\n{at}\n%%EOF\n".encode()


def packed(content: bytes = text("Packed words"), predictor: bool = True) -> bytes:
    """A file whose objects stand in an object stream, with a cross-reference stream behind a PNG predictor."""
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 3: b"<</Type/Page/MediaBox[0 0 200 200]/Parent 2 0 R/Resources<<>>/Contents 5 0 R>>"}
    head, body = "", b""
    for n, x in inner.items():
        head += f"{n} {len(body)} "
        body += x + b" "
    out = bytearray(b"%PDF-1.5\n")
    at5 = len(out)
    out += b"5 0 obj\n" + stream(content, flate=True) + b"\nendobj\n"
    at6 = len(out)
    out += b"6 0 obj\n" + stream(head.encode() + body, f"/Type/ObjStm/N 3/First {len(head)}", True) + b"\nendobj\n"
    at7 = len(out)
    rows = [(0, 0, 255), (2, 6, 0), (2, 6, 1), (2, 6, 2), (0, 0, 0), (1, at5, 0), (1, at6, 0), (1, at7, 0)]
    table, above = b"", bytes(4)
    for kind, two, three in rows:
        row = bytes([kind]) + two.to_bytes(2) + bytes([three])
        table += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)) if predictor else row
        above = row
    parms = "/DecodeParms<</Predictor 12/Columns 4>>" if predictor else ""
    out += b"7 0 obj\n" + stream(table, f"/Type/XRef/W[1 2 1]/Size 8/Root 1 0 R{parms}", True) + b"\nendobj\n"
    return bytes(out) + f"startxref\n{at7}\n%%EOF\n".encode()


MM = 'xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/" xmlns:stRef="http://ns.adobe.com/xap/1.0/sType/ResourceRef#" xmlns:stEvt="http://ns.adobe.com/xap/1.0/sType/ResourceEvent#" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/"'


def packet(inside: str) -> bytes:
    return f'<?xpacket begin="" id="W5M0"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" {MM}>{inside}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'.encode()
