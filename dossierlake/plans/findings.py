"""Queries that run the rules over made scan text and made facts, one file a customer, with SQL that says by arithmetic what they must find.

What a made file holds follows from its customer's number n: pieces are repeated n modulo something times, so every threshold is met from
both sides. The SQL never sees the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import contacts, text_rules
from dossierlake.operators import structure

#: What stands in a made text, and how often (SQL over n).
PIECES = [
    ("startxref 5 ", "n % 4"), ("/Prev 10 ", "n % 3"), ("/Linearized 1 ", "if(n % 5 = 0, 1, 0)"), ("/Redact ", "if(n % 7 = 0, 1, 0)"), ("/PieceInfo ", "if(n % 11 = 0, 1, 0)"), ("/AcroForm ", "if(n % 6 = 0, 1, 0)"), ("/NeedAppearances true ", "if(n % 4 = 0, 1, 0)"),
    ("7 2 obj ", "n % 3"), ("3 0 obj ", "n % 4"), ("endobj ", "n % 5"), ("/JavaScript ", "n % 3"), ("/OpenAction ", "if(n % 2 = 0, 1, 0)"), ("/AA << ", "if(n % 5 = 0, 1, 0)"), ("/SubmitForm ", "n % 4"), ("/Launch ", "n % 3"),
    ("\n1 Tm x Td\n", "n % 8"), ("\n/DeviceRGB 1 1 1 rg 0 0 re f\n", "n % 6"), ("1 1 1 RG ", "n % 30"), (" 3 Tr ", "if(n % 9 = 0, 1, 0)"), ("/Type /EmbeddedFile ", "n % 3"), ("/Subtype /FileAttachment ", "n % 2"), ("/Subtype /3D ", "if(n % 4 = 1, 1, 0)"),
    ("/Subtype /Sound ", "if(n % 4 = 2, 1, 0)"), ("/Subtype /Movie ", "if(n % 4 = 3, 1, 0)"), ("/Subtype /RichMedia ", "if(n % 10 = 0, 1, 0)"), ("<xmpMM:History> ", "if(n % 3 = 0, 1, 0)"), ("/XFA ", "if(n % 5 = 1, 1, 0)"), ("/Type /Sig ", "if(n % 5 = 2, 1, 0)"),
    ("touchup_TextEdit ", "if(n % 5 = 3, 1, 0)"), ("pdfaid:part>1 ", "if(n % 10 = 0, 1, 0)"), ("\0", "if(n % 2 = 0, 199, 200)"), (" ", "if(n % 3 = 0, 1000, 0)"), ("D:20300101 ", "n % 3"), ("/ID [<aa> <bb>] ", "if(n % 4 = 1, 1, 0)"), ("/ID [<aa> <aa>] ", "if(n % 4 = 1, 0, 1)"),
    ("xmpMM:DocumentID>X< xmpMM:OriginalDocumentID>Y< ", "if(n % 6 = 1, 1, 0)"), ("/CreationDate (D:20200101101010) <xmp:CreateDate>2020-01-01T10:10:10</xmp:CreateDate> ", "if(n % 7 = 2, 0, 1)"), ("/CreationDate (D:20200101101010) <xmp:CreateDate>2020-01-01T11:10:10</xmp:CreateDate> ", "if(n % 7 = 2, 1, 0)"),
    ("/ModDate (D:20200101101010) <xmp:ModifyDate>2020-01-02</xmp:ModifyDate> ", "if(n % 8 = 3, 1, 0)"), ("/Encrypt 9 0 R ", "if(n % 13 = 0, 1, 0)"), ("/P -3904 ", "if(n % 17 = 0, 1, 0)"), ("/OCGs [10 0 R 11 0 R] ", "if(n % 8 = 0, 1, 0)"), ("%PDF-1.4 ", "if(n % 3 = 1, 1, 0)"),
    ("%PDF-1.7 ", "if(n % 3 = 1, 0, 1)"), ("/Creator (Acrobat 4) ", "if(n % 4 = 0, 1, 0)"), ("/Creator (b) ", "if(n % 5 = 0, 1, 0)"), ("/Producer (a) /Producer (c) ", "if(n % 9 = 2, 1, 0)"), ("\nxref\n0 2\n0000000000 65535 f\n0000000010 00000 n\ntrailer ", "n % 3"),
    ("-5000 (a) ", "n % 3"), ("150 Tw ", "n % 2"), ("99 Tc ", "n % 4"), ("name@example.com ", "if(n % 10 = 3, 2, 0)"), ("http://example.com/a. ", "if(n % 9 = 4, 1, 0)"), ("\\\\server\\share ", "if(n % 14 = 5, 1, 0)"),
]
_OBJECTS, _ENDS = "(n % 3 + n % 4)", "(n % 5)"
#: Rules by family, with the count that they must give; nothing where it is 0 or less.
FAMILIES = {
    "rules_metadata": {
        "MultipleCreators": "CASE WHEN n % 20 = 0 THEN 2 END", "MultipleProducers": "CASE WHEN n % 9 = 2 THEN 2 END", "XMPHistory": "CASE WHEN n % 3 = 0 THEN 1 END", "PDFACompliance": "CASE WHEN n % 10 = 0 THEN 1 END", "XMPIDChange": "CASE WHEN n % 6 = 1 THEN 1 END",
        "TrailerIDChange": "CASE WHEN n % 4 = 1 THEN 1 END", "CreateDateMismatch": "CASE WHEN n % 7 = 2 THEN 1 END", "ModifyDateMismatch": "CASE WHEN n % 8 = 3 THEN 1 END", "FutureDatedTimestamps": "n % 3", "MetadataVersionMismatch": "CASE WHEN n % 4 = 0 AND n % 3 <> 1 THEN 1 END",
        "VersionFeatureContradiction": "CASE WHEN n % 8 = 0 AND n % 3 = 1 THEN 1 END",
    },
    "rules_structure": {
        "MultipleStartxref": "CASE WHEN n % 4 > 1 THEN n % 4 END", "IncrementalUpdates": "CASE WHEN n % 3 > 0 THEN n % 3 + 1 END", "Linearized": "CASE WHEN n % 5 = 0 THEN 1 END", "LinearizedUpdated": "CASE WHEN n % 5 = 0 AND (n % 4 > 1 OR n % 3 > 0) THEN 1 END",
        "ObjGenGtZero": "n % 3", "UnbalancedObjects": f"CASE WHEN {_OBJECTS} <> {_ENDS} THEN greatest({_OBJECTS}, {_ENDS}) END", "LargeObjectNumberGaps": "CASE WHEN n % 3 > 0 AND n % 4 > 0 THEN 5 WHEN n % 3 > 0 THEN 6 WHEN n % 4 > 0 THEN 2 END",
        "DuplicateObjectIDs": "CASE WHEN n % 3 = 2 THEN 2 END", "StructuralScrubbing": "CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END", "HasLayers": "CASE WHEN n % 8 = 0 THEN 2 END",
    },
    "rules_actions": {
        "ContainsJavaScript": "CASE WHEN n % 3 > 0 THEN 1 END", "JavaScriptAutoExecute": "CASE WHEN n % 3 > 0 AND n % 2 = 0 THEN 1 END", "AdditionalActions": "CASE WHEN n % 3 > 0 AND n % 5 = 0 THEN 1 END", "MultipleJavaScripts": "CASE WHEN n % 3 > 1 THEN n % 3 END", "SubmitFormAction": "n % 4",
        "LaunchShellAction": "n % 3", "HasAcroForm": "CASE WHEN n % 6 = 0 THEN 1 END", "AcroFormNeedAppearances": "CASE WHEN n % 12 = 0 THEN 1 END", "HasXFAForm": "CASE WHEN n % 5 = 1 THEN 1 END", "HasDigitalSignature": "CASE WHEN n % 5 = 2 THEN 1 END",
        "EncryptionDictionary": "CASE WHEN n % 13 = 0 THEN 1 END", "SecurityRestrictions": "CASE WHEN n % 17 = 0 THEN 4 END",
    },
    "rules_content": {
        "TouchUp_TextEdit": "CASE WHEN n % 5 = 3 THEN 1 END", "HasRedactions": "CASE WHEN n % 7 = 0 THEN 1 END", "HasPieceInfo": "CASE WHEN n % 11 = 0 THEN 1 END", "SuspiciousTextPositioning": "CASE WHEN n % 8 > 5 THEN n % 8 END", "WhiteRectangleOverlay": "CASE WHEN n % 6 > 3 THEN n % 6 END",
        "ExcessiveWhiteColor": "CASE WHEN n % 6 + n % 30 > 20 THEN n % 6 + n % 30 END", "InvisibleTextMode": "CASE WHEN n % 9 = 0 THEN 1 END", "TextOperatorAnomaly": "n % 3 + n % 2",
    },
    "rules_embedded": {
        "EmbeddedFiles": "n % 3", "FileAttachmentAnnotations": "n % 2", "3DObjects": "CASE WHEN n % 4 = 1 THEN 1 END", "SoundAnnotations": "CASE WHEN n % 4 = 2 THEN 1 END", "VideoContent": "CASE WHEN n % 4 = 3 THEN 1 END", "RichMedia": "CASE WHEN n % 10 = 0 THEN 1 END",
        "EmailAddresses": "CASE WHEN n % 10 = 3 THEN 1 END", "URLs": "CASE WHEN n % 9 = 4 THEN 1 END", "UNCPaths": "CASE WHEN n % 14 = 5 THEN 1 END",
    },
}

#: Rules over facts with the count that they must give; the facts are made in made_facts.
STRUCTURE = {
    "MultipleFontSubsets": "CASE WHEN n % 3 = 0 THEN 1 END", "FontCharacterRemapping": "CASE WHEN n % 4 = 0 THEN 1 END", "NonEmbeddedFont": "1 + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END", "HasAnnotations": "n % 3", "HiddenAnnotations": "n % 3",
    "ExcessiveDrawingOperations": "CASE WHEN n % 60 > 50 THEN n % 60 END", "OrphanedObjects": "CASE WHEN n % 6 = 1 THEN 1 END", "MissingObjects": "CASE WHEN n % 4 = 3 THEN 1 END", "CropBoxMediaBoxMismatch": "CASE WHEN n % 7 = 0 THEN 1 END", "ExcessiveFormFields": "CASE WHEN n % 53 > 50 THEN n % 53 END",
    "FormFieldOverlay": "CASE WHEN n % 6 = 0 AND n % 53 > 0 THEN 1 END", "DuplicateBookmarks": "n % 4 - 1", "InvalidBookmarkDestinations": "CASE WHEN n % 9 = 0 AND n % 4 > 0 THEN 1 END", "TextOutsideMediaBox": "CASE WHEN n % 8 = 0 THEN 1 END", "Languages": "CASE WHEN n % 10 = 0 THEN 1 END",
    "Encrypted": "CASE WHEN n % 13 = 0 THEN 1 END", "EncryptedButOpen": "CASE WHEN n % 13 = 0 THEN 1 END", "PageInconsistency": "CASE WHEN n % 2 = 0 AND n % 5 + 1 >= 4 THEN 1 END", "ColorSpaceAnomaly": "CASE WHEN n % 5 = 0 THEN 1 END", "StackedFilters": "n % 3",
    "DuplicateImagesWithDifferentXrefs": "CASE WHEN n % 11 = 0 THEN 1 END", "ImagesWithEXIF": "CASE WHEN n % 12 = 0 THEN 1 END", "OCRLayer": "CASE WHEN n % 14 = 0 AND n % 5 + 1 >= 2 THEN 2 END", "ExtractedJavaScript": "CASE WHEN n % 15 = 0 THEN 2 END",
}


def _sql(counts: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT n AS path, '{k}' AS key, CAST({c} AS BIGINT) AS count FROM made" for k, c in counts.items())
    return f"WITH made AS (SELECT c_custkey AS n FROM customer), found AS ({each}) SELECT path, key, count FROM found WHERE count > 0"


def made_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = [F.repeat(F.lit(p), F.expr(f"CAST({n} AS INT)")) for p, n in PIECES]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n")).select(F.col("n").alias("path"), F.concat_ws("\n", *pieces).alias("text"))


def _family(counts: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        every = text_rules.text_rules(contacts.top_level_domains(spark), F.lit("2024-01-01").cast("timestamp"))
        rules = text_rules.Rules(r for r in every if r.key in counts)
        rules.tlds, rules.as_of = every.tlds, every.as_of
        return text_rules.indicators(made_text(spark, sf_dir), "path", "text", rules).select("path", "key", "count")

    return run


def _times(n: str, what: str) -> str:
    return f"CASE WHEN {n} > 0 THEN transform(sequence(1, CAST({n} AS INT)), i -> {what}) ELSE array() END"


def _box(x1: str) -> str:
    return f"named_struct('x0', 0D, 'y0', 0D, 'x1', {x1}, 'y1', 100D)"


def made_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = lambda name, odd="NULL": f"named_struct('xref', 1, 'basefont', '{name}', 'subtype', 'Type1', 'obj_text', '<<>>', 'has_file', false, 'remapped', CAST({odd} AS struct<from_code:int,to_text:string>))"
    image = "named_struct('page', 1 + i % 2, 'xref', 20 + i, 'colorspace', if(n % 5 = 0 AND i = 7, '/DeviceCMYK', '/DeviceRGB'), 'filters', array('FlateDecode'), 'area', if(n % 14 = 0, 18000D, 1D), 'data', CAST(if(n % 12 = 0 AND i = 1, 'xxExif', 'xx') AS binary), 'md5', if(n % 11 = 0 AND i < 3, 'same', CAST(i AS string)))"
    swap = "named_struct('from_code', 65, 'to_text', 'B')"
    columns = {
        "path": "CAST(n AS string)", "ok": "true", "text": "if(n % 15 = 0, '/JavaScript', '')", "page_count": "CAST(n % 5 + 1 AS INT)", "language": "if(n % 10 = 0, 'da', NULL)", "is_encrypted": "n % 13 = 0", "is_form": "true", "is_xfa": "false", "slots": "3",
        "empty_slots": "if(n % 6 = 1, array(2), array())", "defined": "array(1, 2)", "referenced": "if(n % 4 = 3, array(1, 77), array(1))",
        "objects": _times("(n % 3 + 1)", "named_struct('xref', i, 'gen', 0, 'is_free', false, 'is_stream', true, 'filters', if(i > n % 3, array('FlateDecode'), array('ASCIIHexDecode', 'FlateDecode')), 'obj_text', '')"),
        "pages": _times("(n % 5 + 1)", f"named_struct('page', i, 'mediabox', {_box('if(n % 2 = 0 AND i = 1, 200D, 100D)')}, 'cropbox', {_box('if(n % 7 = 0 AND i = 1, 50D, if(n % 2 = 0 AND i = 1, 200D, 100D))')}, 'rotation', 0, 'n_drawings', if(i = 1, CAST(n % 60 AS INT), 0), 'text', repeat('x', 51), 'touchup', '', 'digest', '')"),
        "fonts": f"concat(array({font('AAAAAA+Arial')}), if(n % 3 = 0, array({font('BBBBBB+Arial')}), array()), if(n % 4 = 0, array({font('Plain', swap)}), array()))",
        "images": _times("if(n % 5 = 0, 7, 6)", image), "annots": _times("n % 3", f"named_struct('page', 1, 'subtype', 'Text', 'flags', 2, 'rect', {_box('9D')})"),
        "widgets": _times("n % 53", f"named_struct('page', 1, 'field_name', 'f', 'field_value', 'v', 'rect', {_box('if(n % 6 = 0 AND i = 1, 0D, 9D)')})"), "toc": _times("n % 4", "named_struct('place', i, 'level', 1, 'title', 'One', 'page', if(n % 9 = 0, 99, 1))"),
        "lines": "array(named_struct('page', 1, 'bbox', named_struct('x0', if(n % 8 = 0, -150D, -90D), 'y0', 0D, 'x1', 9D, 'y1', 9D), 'text', 't'))", "scripts": "array(named_struct('source', 'a', 'xref', 1, 'code', 'x'), named_struct('source', 'b', 'xref', 2, 'code', 'y'))",
    }
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"))
    return rows.select(*[F.expr(e).alias(name) for name, e in columns.items()])


def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over made facts; JPEG tables and layers are not among what is made."""
    return structure.structural(made_facts(spark, sf_dir)).select(F.col("path").cast("long").alias("path"), "key", "count")


QUERIES = {name: _family(counts) for name, counts in FAMILIES.items()} | {"structure_findings": structure_findings}
ORACLES = {name: _sql(counts) for name, counts in FAMILIES.items()} | {"structure_findings": _sql(STRUCTURE)}
