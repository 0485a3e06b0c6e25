"""Files made by the tests' own writer, through the reader, the rules and the whole scan."""

import json
import os

import pdfs
import pytest
from pyspark.sql import functions as F

from dossierlake import cli, config
from dossierlake.functions import details
from dossierlake.operators import casefile, custody, reports
from dossierlake.parse import content, facts, objects, scan_text
from dossierlake.plans.scan import scan

T = pdfs.text
JPEG = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([5]) * 64 + b"\xff\xd9"
IMAGE = "/Type/XObject/Subtype/Image/Width {w}/Height {h}/ColorSpace/{c}/BitsPerComponent 8{f}"


def _image(body, c="DeviceRGB", w=10, h=10, f=""):
    return pdfs.stream(body, IMAGE.format(w=w, h=h, c=c, f=f))


def _images(kinds):
    """A page with pictures o20, o21, .. and what the page says of them."""
    return "/Resources<</Font<</F1 4 0 R>>/XObject<<" + "".join(f"/I{k} {20 + k} 0 R" for k in range(kinds)) + ">>>>"


def _many_pages(boxes, rotate=None):
    out = pdfs.base()
    out[2] = f"<</Type/Pages/Count {len(boxes)}/Kids[{' '.join(f'{30 + k} 0 R' for k in range(len(boxes)))}]>>".encode()
    for k, b in enumerate(boxes):
        out[30 + k] = f"<</Type/Page/MediaBox[0 0 {b}]/Parent 2 0 R/Resources<<>>{'/Rotate 90' if k == rotate else ''}>>".encode()
    return out


def _first():
    return pdfs.write(pdfs.base(T("First text", "Same line"), o9=pdfs.stream(b"x" * 400)), "/ID[<aa><aa>]")


HISTORY = '<xmpMM:History><rdf:Seq><rdf:li stEvt:action="a" stEvt:instanceID="xmp.iid:1" stEvt:when="2020-01-01T00:00:00Z"/><rdf:li stEvt:instanceID="xmp.iid:2" stEvt:when="2019-01-01T00:00:00Z"/><rdf:li stEvt:instanceID="xmp.iid:3" stEvt:when="2022-06-01T00:00:00Z"/></rdf:Seq></xmpMM:History>'
TREE = (
    "<xmpMM:DocumentID>xmp.did:A</xmpMM:DocumentID><xmpMM:InstanceID>xmp.iid:A1</xmpMM:InstanceID><xmpMM:OriginalDocumentID>xmp.did:O</xmpMM:OriginalDocumentID>"
    '<xmpMM:DerivedFrom stRef:documentID="xmp.did:B" stRef:instanceID="xmp.iid:B1" stRef:originalDocumentID="xmp.did:P"/>'
    '<xmpMM:Ingredients><rdf:Bag><rdf:li stRef:documentID="xmp.did:I" stRef:instanceID="xmp.iid:I1" stRef:filePath="image1.jpg" stRef:fromPart="time:0"/><rdf:li stRef:instanceID="xmp.iid:gone"/></rdf:Bag></xmpMM:Ingredients>'
    '<xmpMM:Pantry><rdf:Bag><rdf:li><rdf:Description><xmpMM:InstanceID>xmp.iid:I1</xmpMM:InstanceID><xmpMM:DocumentID>xmp.did:other</xmpMM:DocumentID></rdf:Description></rdf:li>'
    '<rdf:li><rdf:Description><xmpMM:InstanceID>xmp.iid:B1</xmpMM:InstanceID><xmpMM:DerivedFrom stRef:documentID="xmp.did:C" stRef:instanceID="xmp.iid:C1"/></rdf:Description></rdf:li></rdf:Bag></xmpMM:Pantry>'
)
LONG = T("A line of words that is longer than fifty characters in all, surely")

#: name: (bytes, keys it has to have, keys it must not have)
CASES = {
    "plain": (pdfs.write(pdfs.base(), "/ID[<aa><aa>]"), ["NonEmbeddedFont"], ["TrailerIDChange", "HasRevisions", "UnbalancedObjects", "MissingObjects", "OrphanedObjects", "PolyglotFile"]),
    "two_ids": (pdfs.write(pdfs.base(), "/ID[<C3A3><5968>]"), ["TrailerIDChange"], []),
    "packed": (pdfs.packed(), [], ["NonEmbeddedFont"]),
    "two_revisions": (pdfs.update(pdfs.update(_first(), {5: pdfs.stream(T("Second text", "Same line"))}), {5: pdfs.stream(T("Third text", "Same line"))}), ["HasRevisions", "IncrementalUpdates", "MultipleStartxref"], []),
    "early_end": (pdfs.write(pdfs.base(o9=b"(%%EOF)")), [], ["HasRevisions"]),
    "linearized": (pdfs.update(pdfs.write(pdfs.base(o8=b"<</Linearized 1/L 5>>")), {9: b"(x)"}), ["Linearized", "LinearizedUpdated", "HasRevisions"], []),
    "scripts": (pdfs.write(pdfs.base(catalog="/OpenAction 8 0 R", page="/AA <</O 8 0 R>>", o8=b"<</S/JavaScript/JS 9 0 R>>", o9=pdfs.stream(b"app.alert('hi');", "/JavaScript true", True))), ["ContainsJavaScript", "JavaScriptAutoExecute", "AdditionalActions", "MultipleJavaScripts", "ExtractedJavaScript"], []),
    "actions": (pdfs.write(pdfs.base(o8=b"<</S/Launch/F(cmd.exe)>>", o9=b"<</S/SubmitForm>>")), ["LaunchShellAction", "SubmitFormAction"], []),
    "dangling": (pdfs.write(pdfs.base(page="/Thumb 77 0 R")), ["MissingObjects"], ["OrphanedObjects"]),
    "orphan": (pdfs.write(pdfs.base(o9=b"(body only)"), missing=(9,)), ["OrphanedObjects"], ["MissingObjects"]),
    "gaps": (pdfs.write(pdfs.base(o50=b"(far)")), ["LargeObjectNumberGaps"], []),
    "unbalanced": (pdfs.write(pdfs.base()).replace(b"endobj", b"", 1), ["UnbalancedObjects"], []),
    "subsets": (pdfs.write(pdfs.base(o10=b"<</Type/Font/BaseFont/AAAAAA+Arial>>", o11=b"<</Type/Font/BaseFont/BBBBBB+Arial>>", o12=b"<</Type/Font/BaseFont/CCCCCC+Arial-Bold>>")), ["MultipleFontSubsets"], []),
    "one_subset": (pdfs.write(pdfs.base(o10=b"<</Type/Font/BaseFont/AAAAAA+Arial>>", o12=b"<</Type/Font/BaseFont/CCCCCC+Arial-Bold>>")), [], ["MultipleFontSubsets"]),
    "remapped": (pdfs.write(pdfs.base(o10=b"<</Type/Font/BaseFont/Swap/ToUnicode 11 0 R>>", o11=pdfs.stream(b"1 beginbfchar <41> <0042> endbfchar"))), ["FontCharacterRemapping"], []),
    "remapped_subset": (pdfs.write(pdfs.base(o10=b"<</Type/Font/BaseFont/AAAAAA+Swap/ToUnicode 11 0 R>>", o11=pdfs.stream(b"1 beginbfchar <41> <0042> endbfchar"))), [], ["FontCharacterRemapping"]),
    "filters": (pdfs.write(pdfs.base(o9=b"<</Length 8/Filter[/ASCIIHexDecode/FlateDecode]>>\nstream\n789c0300\nendstream")), ["StackedFilters"], []),
    "half_crop": (pdfs.write(pdfs.base(page="/CropBox[0 0 595 421]")), ["CropBoxMediaBoxMismatch"], []),
    "most_of_crop": (pdfs.write(pdfs.base(page="/CropBox[0 0 595 674]")), [], ["CropBoxMediaBoxMismatch"]),
    "pages": (pdfs.write(_many_pages(["100 100"] * 3 + ["100 200"], rotate=0)), ["PageInconsistency"], []),
    "pages_mixed": (pdfs.write(_many_pages(["100 100"] * 2 + ["100 200"] * 2)), [], ["PageInconsistency"]),
    "form": (pdfs.write(pdfs.base(page="/Annots[" + " ".join(f"{100 + k} 0 R" for k in range(51)) + "]", catalog="/AcroForm<</Fields[100 0 R]>>", **{f"o{100 + k}": f"<</Subtype/Widget/T(f{k})/Rect[0 0 {0 if k == 7 else 9} 9]/V(value)>>".encode() for k in range(51)})), ["ExcessiveFormFields", "FormFieldOverlay", "HasAcroForm"], []),
    "small_form": (pdfs.write(pdfs.base(page="/Annots[" + " ".join(f"{100 + k} 0 R" for k in range(50)) + "]", catalog="/AcroForm<</Fields[100 0 R]>>", **{f"o{100 + k}": f"<</Subtype/Widget/T(f{k})/Rect[0 0 9 9]/V(value)>>".encode() for k in range(50)})), [], ["ExcessiveFormFields", "FormFieldOverlay"]),
    "annots": (pdfs.write(pdfs.base(page="/Annots[8 0 R 9 0 R]", o8=b"<</Subtype/Text/F 2/Rect[0 0 9 9]>>", o9=b"<</Subtype/Link/F 4/Rect[0 0 9 9]>>")), ["HasAnnotations", "HiddenAnnotations"], []),
    "seen_annots": (pdfs.write(pdfs.base(page="/Annots[9 0 R]", o9=b"<</Subtype/Link/F 4/Rect[0 0 9 9]>>")), ["HasAnnotations"], ["HiddenAnnotations"]),
    "off_page": (pdfs.write(pdfs.base(b"BT /F1 12 Tf -150 400 Td (far) Tj ET")), ["TextOutsideMediaBox"], []),
    "near_page": (pdfs.write(pdfs.base(b"BT /F1 12 Tf -90 400 Td (near) Tj ET")), [], ["TextOutsideMediaBox"]),
    "outline": (pdfs.write(pdfs.base(catalog="/Outlines 8 0 R", o8=b"<</First 9 0 R>>", o9=b"<</Title(One)/Dest[3 0 R/Fit]/Next 10 0 R>>", o10=b"<</Title(One)/Dest[98/Fit]>>")), ["DuplicateBookmarks", "InvalidBookmarkDestinations"], []),
    "drawings": (pdfs.write(pdfs.base(b"0 0 1 1 re f " * 51)), ["ExcessiveDrawingOperations"], []),
    "fewer_drawings": (pdfs.write(pdfs.base(b"0 0 1 1 re f " * 50)), [], ["ExcessiveDrawingOperations"]),
    "language": (pdfs.write(pdfs.base(catalog="/Lang(da-DK)")), ["Languages"], []),
    "colours": (pdfs.write(pdfs.base(page=_images(7), **{f"o{20 + k}": _image(bytes([k]), "DeviceCMYK" if k == 6 else "DeviceRGB") for k in range(7)})), ["ColorSpaceAnomaly"], []),
    "few_colours": (pdfs.write(pdfs.base(page=_images(5), **{f"o{20 + k}": _image(bytes([k]), "DeviceCMYK" if k == 4 else "DeviceRGB") for k in range(5)})), [], ["ColorSpaceAnomaly"]),
    "images": (pdfs.write(pdfs.base(page=_images(3), o20=_image(b"same" + b"Exif"), o21=_image(b"same" + b"Exif"), o22=_image(JPEG, f="/Filter/DCTDecode"))), ["DuplicateImagesWithDifferentXrefs", "ImagesWithEXIF", "JPEG_Analysis"], []),
    "late_exif": (pdfs.write(pdfs.base(page=_images(1), o20=_image(b"x" * 1001 + b"Exif"))), [], ["ImagesWithEXIF", "DuplicateImagesWithDifferentXrefs"]),
    "touchup": (pdfs.write(pdfs.base(b"BT /F1 12 Tf 72 700 Td (plain) Tj ET /TouchUp_TextEdit MP BT /F1 12 Tf 72 680 Td (edited) Tj ET /TouchUp BMC BT 72 660 Td (inner) Tj ET EMC BT 72 640 Td (after) Tj ET")), ["TouchUp_TextEdit"], []),
    "encrypted": (pdfs.write(pdfs.base(o9=b"<</Filter/Standard/P -3904>>"), "/Encrypt 9 0 R"), ["Encrypted", "EncryptionDictionary", "SecurityRestrictions", "EncryptedButOpen"], []),
    "shifted": (pdfs.write(pdfs.base(), prefix=b"x" * 600), ["PolyglotFile"], []),
    "zip": (pdfs.write(pdfs.base(), prefix=b"PK\x03\x04"), ["PolyglotFile"], []),
    "zeros": (pdfs.write(pdfs.base(o9=pdfs.stream(b"\0" * 200))), ["StructuralScrubbing"], []),
    "fewer_zeros": (pdfs.write(pdfs.base(o9=pdfs.stream(b"\0" * 199 + b" " * 999))), [], ["StructuralScrubbing"]),
    "layers": (pdfs.write(pdfs.base(catalog="/OCProperties<</OCGs[8 0 R 9 0 R]>>", o8=b"<</Type/OCG/Name(a)>>", o9=b"<</Type/OCG/Name(b)>>")), ["HasLayers", "MoreLayersThanPages"], []),
    "xmp": (pdfs.write(pdfs.base(catalog="/Metadata 9 0 R", o9=pdfs.stream(pdfs.packet(TREE + HISTORY + "<pdfaid:part>1</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance><xmp:CreateDate>2020-01-01T10:01:01</xmp:CreateDate>"), "/Type/Metadata"), o10=b"<</CreationDate(D:20200101100000)/ModDate(D:20200101095800)>>"), "/Info 10 0 R"), ["XMPHistory", "XMPHistoryGap", "XMPIDChange", "AssetRelationship", "RelatedFiles", "PDFACompliance", "PDFAViolation", "TimestampMismatch", "TimestampSpoofing", "CreateDateMismatch"], []),
    "near_dates": (pdfs.write(pdfs.base(catalog="/Metadata 9 0 R", o9=pdfs.stream(pdfs.packet("<xmp:CreateDate>2020-01-01T10:00:59</xmp:CreateDate>"), "/Type/Metadata"), o10=b"<</CreationDate(D:20200101100000)/ModDate(D:20200101100000)>>"), "/Info 10 0 R"), [], ["TimestampMismatch", "TimestampSpoofing"]),
    "ocr": (pdfs.write(pdfs.base(LONG, page=_images(1)) | {2: b"<</Type/Pages/Count 2/Kids[3 0 R 6 0 R]>>", 6: f"<</Type/Page/MediaBox[0 0 595 842]/Parent 2 0 R/Contents 5 0 R{_images(1)}>>".encode(), 20: _image(b"x", w=800, h=900)}), ["OCRLayer"], []),
    "parent": (pdfs.write(pdfs.base(catalog="/Metadata 9 0 R", o9=pdfs.stream(pdfs.packet("<xmpMM:DocumentID>xmp.did:B</xmpMM:DocumentID>")))), [], []),
    "empty": (b"", [], []),
    "broken": (b"%PDF-1.4 nothing else", [], []),
    "cut": (pdfs.write(pdfs.base())[:-60], [], []),
    "too_big": (pdfs.write(pdfs.base(o9=pdfs.stream(b"z" * 1_100_000))), [], []),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("scan")
    (root / "in" / "deep").mkdir(parents=True)
    for name, (data, _, _) in CASES.items():
        (root / "in" / "deep" / f"{name}.pdf").write_bytes(data)
    return scan(spark, str(root / "in"), str(root / "out"), config.Config(max_file_mb=1), F.lit("2024-01-01").cast("timestamp")), root


@pytest.fixture(scope="module")
def keys(found):
    out = {}
    for r in found[0].indicators.collect():
        out.setdefault(os.path.basename(r["path"]), {})[r["key"]] = (r["count"], json.loads(r["details"] or "{}"))
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_keys(keys, name):
    got = keys.get(f"{name}.pdf", {})
    _, wanted, unwanted = CASES[name]
    assert not set(wanted) - set(got), sorted(got)
    assert not set(unwanted) & set(got), sorted(got)


def test_details(keys):
    assert keys["touchup.pdf"]["TouchUp_TextEdit"][1]["found_text"] == {"1": ["edited", "inner"]}
    assert keys["scripts.pdf"]["ExtractedJavaScript"][1]["scripts"][0]["code"] == "app.alert('hi');"
    assert keys["dangling.pdf"]["MissingObjects"][1] == {"count": 1, "ids": [77]}
    assert keys["orphan.pdf"]["OrphanedObjects"][1] == {"count": 1, "ids": [9]}
    assert keys["subsets.pdf"]["MultipleFontSubsets"][1]["fonts"] == {"Arial": ["AAAAAA", "BBBBBB"]}
    assert keys["remapped.pdf"]["FontCharacterRemapping"][1]["details"][0]["to_unicode"] == "B"
    assert keys["half_crop.pdf"]["CropBoxMediaBoxMismatch"][1] == {"page": 1, "visible_ratio": "50.0%"}
    assert {(p["page"], p["type"]) for p in keys["pages.pdf"]["PageInconsistency"][1]["pages"]} == {(4, "size"), (1, "rotation")}
    assert keys["encrypted.pdf"]["SecurityRestrictions"][1]["restrictions"] == ["print", "modify", "copy", "annotate"]
    assert [g["kind"] for g in keys["xmp.pdf"]["XMPHistoryGap"][1]["gaps"]] == ["reverse", "gap", "reverse", "reverse", "gap"]  # the packet stands in the scan text twice
    asset = keys["xmp.pdf"]["AssetRelationship"][1]
    assert asset["ids"] == {"documentID": "xmp.did:A", "instanceID": "xmp.iid:A1", "originalDocumentID": "xmp.did:O"} and asset["ingredients"][0]["fromPart"] == "time:0"
    assert len(asset["anomalies"]) == 3 and sum("mismatch" in a for a in asset["anomalies"]) == 2
    assert keys["zip.pdf"]["PolyglotFile"][1]["status"] == "SUSPICIOUS" and keys["jpeg.pdf" if "jpeg.pdf" in keys else "images.pdf"]["JPEG_Analysis"][1]["suspicious_count"] == 1
    assert keys["two_revisions.pdf"]["HasRevisions"][0] == 2


def test_records_and_revisions(found):
    result, root = found
    rows = {r["name"]: r for r in result.records.collect()}
    assert rows["empty.pdf"]["error_type"] == rows["broken.pdf"]["error_type"] == "file_corrupt"
    assert rows["too_big.pdf"]["error_type"] == "file_too_large" and rows["too_big.pdf"]["md5"] is None
    assert rows["cut.pdf"]["status"] == "success"  # put together again without its table
    states = sorted((r for r in rows.values() if r["is_revision"] and r["original_path"].endswith("two_revisions.pdf")), key=lambda r: r["rev_idx"])
    assert [s["rev_idx"] for s in states] == [1, 2]
    assert [s["is_identical"] for s in states] == [False, False]
    whole = lambda r: CASES[os.path.basename(r["path"])[:-4]][0]
    assert all(whole(r).startswith(bytes(r["content"])) and bytes(r["content"]).endswith(b"%%EOF") for r in result.revisions.collect())
    changes = {r["rev_idx"]: r for r in result.changes.collect() if r["path"].endswith("two_revisions.pdf")}
    assert [x["text"] for x in changes[1]["deletions"]] == ["First text"] and [x["text"] for x in changes[2]["additions"]] == ["Third text"]
    flags = {os.path.basename(r["path"]): r["flag"] for r in result.flags.collect()}
    assert (flags["two_revisions.pdf"], flags["language.pdf"]) == ("YES", "Possible")
    assert sum(f.startswith("revision of") for f in flags.values()) == 3
    s = result.summary().first()
    assert (s["originals"], s["errors"], s["revisions"]) == (len(CASES), 3, 3)


def test_links_and_timeline(found):
    result, _ = found
    base = os.path.basename
    assert {(base(r["path"]), base(r["related_path"]), r["rel_type"]) for r in result.relations.collect()} >= {("xmp.pdf", "parent.pdf", "derived_from"), ("parent.pdf", "xmp.pdf", "parent_of")}
    events = [r for r in result.timeline.collect() if base(r["path"]) == "xmp.pdf"]
    assert {"filesystem", "metadata", "raw"} <= {r["source"] for r in events}
    naive = sorted((r["seq"], r["ts"]) for r in events if not r["is_aware"])
    assert [t for _, t in naive] == sorted(t for _, t in naive)


def test_report_case_and_custody(spark, found, tmp_path):
    result, root = found
    report = result.report()
    rows = report.collect()
    assert [r["ID"] for r in rows] == list(range(1, len(CASES) + 4))
    at = next(k for k, r in enumerate(rows) if r["Name"] == "two_revisions.pdf")
    assert [r["Altered"] for r in rows[at : at + 3]] == ["YES", *["revision of two_revisions.pdf"] * 2] and rows[at]["Revisions"] == "2"
    reports.write_csv_file(report, f"{tmp_path}/r.csv")
    with open(f"{tmp_path}/r.csv", "rb") as f:
        assert f.read(3) == reports.BOM
    reports.write_html_file(report, f"{tmp_path}/r.html")
    reports.write_xlsx(report, f"{tmp_path}/r.xlsx")
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(f"{tmp_path}/r.xlsx") as z:
        assert sum(1 for _ in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row")) == len(rows) + 1
    log, case = f"{tmp_path}/c.custody.log", f"{tmp_path}/c.prc"
    own = casefile.write_case(result, case, str(root / "in"), {"x": "note"})
    custody.append(log, [custody.ingested("x", "00"), custody.entry(custody.CASE_SAVE, case, own, {"source": "test ø"})])
    read = casefile.read_case(case)
    assert len(read["all_scan_data"]) == len(rows) and read["revision_counter"] == 3
    assert casefile.case_records(spark, case).where("is_revision").count() == 3
    signed = f"{tmp_path}/signed.json"
    casefile.write_report(casefile.findings_report(read, case), signed, log, case)
    assert casefile.verify_report(signed)
    said = json.load(open(signed))
    scripts = next(f for f in said["findings"] if f["path"].endswith("scripts.pdf"))
    assert scripts["extracted_javascript"][0]["code"] == "app.alert('hi');" and scripts["indicators"]["ExtractedJavaScript"] == "(present)"
    with open(signed, "a") as f:
        f.write(" ")
    assert casefile.verify_report(signed)  # white space after the object is no part of it
    text = open(signed).read().replace("two_revisions", "two_revisionz", 1)
    open(signed, "w").write(text)
    assert not casefile.verify_report(signed)
    verdicts = {r["verdict"] for r in casefile.verify_evidence(spark, case, log).collect()}
    assert verdicts == {"verified"}
    n, good, line, said = custody.verdict(spark, log)
    assert (good, line, said) == (True, None, custody.WHOLE) and n == 3 + len(read["evidence_hashes"])
    lines = open(log).read().splitlines()
    for k in (0, 2):
        open(f"{tmp_path}/bad.log", "w").write("\n".join([*lines[:k], lines[k].replace('"action"', '"acti0n"'), "", *lines[k + 1 :]]) + "\n")
        assert custody.verdict(spark, f"{tmp_path}/bad.log")[:3] == (k, False, k + 1)
    open(f"{tmp_path}/bad.log", "w").write(lines[0] + "\nno json\n")
    assert custody.verdict(spark, f"{tmp_path}/bad.log") == (1, False, 2, custody.BAD_JSON.format(2))
    assert custody.verdict(spark, f"{tmp_path}/none.log")[3] == custody.NO_LOG
    assert custody.shown(custody.read_log(spark, log)).first()["block"].startswith("--- Entry 1 ---\n  Time (UTC): ")
    copy = casefile.reader_export(spark, case, f"{tmp_path}/export")
    moved = casefile.read_case(copy)
    assert all(p.startswith("Evidence") for p in moved["evidence_hashes"])
    assert casefile.sealed(copy, "case") == casefile.sha256_file(copy) and open(f"{copy}.sha256").read().endswith("  c.prc\n")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.pdf").write_bytes(CASES["scripts"][0])
    assert cli.main(["extract-js", str(tmp_path / "in" / "s.pdf")]) == 0
    assert "--- Script 1 (xref_9) ---\napp.alert('hi');" in capsys.readouterr().out
    assert cli.main(["extract-js", str(tmp_path / "none.pdf")]) == 1
    assert cli.main(["scan", str(tmp_path / "nowhere")]) == 1


def test_filters_and_syntax():
    assert objects.lzw(bytes.fromhex("800b6050220c0c8501")) == b"-----A---B"
    assert objects.run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert objects.ascii85(b"<~87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert objects.ascii_hex(b"48 65 6c6C 6f>") == b"Hello"
    assert objects.parse(b"<</A#42 [1 -2.5 (a\\(b\\)\\101\\\n) <4142> true null 3 0 R]>>")[0] == {"AB": [1, -2.5, b"a(b)A", b"AB", True, None, objects.Ref(3, 0)]}
    with pytest.raises(objects.Broken):
        objects.parse(b"[" * 500)
    assert objects.Document(pdfs.packed()).page_list() and objects.Document(pdfs.packed(predictor=False)).page_list()
    assert content.to_unicode(b"2 beginbfrange <01> <03> <0041> <05> <06> [<0058> <0059>] endbfrange") == {1: "A", 2: "B", 3: "C", 5: "X", 6: "Y"}
    assert facts.facts_of("x", CASES["packed"][0])["pages"][0]["text"] == "Packed words"


def test_any_bytes_give_a_row():
    import random

    rng = random.Random(3)
    for name in ("two_revisions", "packed", "xmp", "outline", "form"):
        data = CASES[name][0]
        for _ in range(25):
            broken = bytearray(data)
            for _ in range(rng.randint(1, 12)):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            cut = bytes(broken[: rng.randint(1, len(broken))])
            assert facts.facts_of("x", cut)["path"] == "x"


def test_scan_text_windows():
    raw = b"a" * 900_000 + b"startxref" + b"b" * 600_000
    assert scan_text.scan_text(raw).count("startxref") == 2  # both ends hold it
    assert scan_text.scan_text(b"stream\n" + __import__("zlib").compress(b"inner TouchUp") + b"\nendstream").startswith("inner TouchUp\n")
    assert scan_text.scan_text(b"x touchup_textedit y").endswith("TouchUp_TextEdit")


def test_details_as_text(spark):
    cases = [
        ("K", None, "K"), ("K", "{}", "K"), ("K", '{"count":5}', "K (5)"), ("K", '{"text":"Short text"}', "K: Short text..."), ("K", '{"text":"' + "A" * 60 + '"}', "K: " + "A" * 50 + "..."), ("K", '{"fonts":["a","b"]}', "K (2 fonts)"),
        ("K", '{"items":[1,2,3]}', "K (3 items)"), ("K", '{"items":[]}', "K (0 items)"), ("K", '{"count":3,"text":"x"}', "K (3)"), ("K", '{"text":"x","fonts":["a"]}', "K: x..."), ("K", '{"items":"no list"}', "K"), ("K", '{"other":1}', "K"), ("K", '{"fonts":{"a":1}}', "K (1 fonts)"),
    ]
    rows = spark.createDataFrame(cases, "key string, details string, want string").select(details.summary(F.col("key"), F.col("details")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    screen = [("EmailAddresses", '{"count":0}', None), ("Foo_Bar", "{}", "Foo Bar"), ("TrailerIDChange", '{"from":"a","to":"b"}', "Trailer ID changed: a to b"), ("RelatedFiles", '{"files":[{"type":"derived_from","name":"ID: 12345678..."}]}', None), ("RelatedFiles", '{"files":[{"type":"parent_of","name":"x.pdf"}]}', "Related files (1):\n  → Parent of: x.pdf")]
    rows = spark.createDataFrame(screen, "key string, details string, want string").select(details.for_screen(F.col("key"), F.col("details")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    line = spark.createDataFrame([("Total: 1.250,00 kr — total paid / ab",)], "t string").select(details.fragments(F.col("t")).alias("f")).first()["f"]
    assert line == ["Total: 1.250,00 kr", "total paid", "Total", "paid"]


def test_config(tmp_path):
    path = f"{tmp_path}/c.ini"
    assert config.load(path) == config.Config() and os.path.exists(path)
    config.save(config.Config(max_file_mb=5, export_invalid_xref=True), path)
    assert config.load(path).max_file_mb == 5 and config.load(path).export_invalid_xref
    open(path, "w").write("[Settings]\nMaxFileSizeMB = many\nVisualDiffPageLimit = 5\n")
    assert config.load(path) == config.Config(visual_pages=5)
    tool = f"{tmp_path}/tool"
    open(tool, "w").write("x")
    assert config.tool_allowed("/usr/bin/env")[0] or os.path.realpath("/usr/bin/env") != "/usr/bin/env"
    assert not config.tool_allowed(tool)[0]
    assert config.tool_allowed(tool, casefile.sha256_file(tool)) == (True, "")
    assert config.tool_allowed(tool, "00")[1].endswith("hash mismatch")
