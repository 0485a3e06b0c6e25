"""Alteration indicators over scan text, declared as data and evaluated in one projection.

A rule has a key, an order, a Column that gives its count (null or 0: the rule does not hold; 1 for rules that only hold or not) and a
Column with its details as a string (null if it has none). All rules of a table are compiled into one array of structs that inline()
turns into rows, so a text is read once whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import contacts, scalars
from dossierlake.functions.scalars import count_of, first_group, last_group


@dataclass(frozen=True)
class Rule:
    key: str
    count: Callable[[Column], Column]
    details: Callable[[Column], Column] | None = None


def _shared(name: str) -> Column:
    """A column that indicators() works out once for all rules: the text in lower case, and what several rules or details look at."""
    return F.col(f"_rules_{name}")


def _where(guard: str, value: Column) -> Column:
    """value where a word stands in the text, whatever its case: looking for a word is far cheaper than matching a pattern."""
    return F.when(_shared("lower").contains(guard.lower()), value)


def _holds(pattern: str, guard: str) -> Callable[[Column], Column]:
    return lambda t: _where(guard, t.rlike(pattern).cast("long"))


def _counted(pattern: str, guard: str, above: int = 0) -> Callable[[Column], Column]:
    def count(t: Column) -> Column:
        n = count_of(t, pattern)
        return _where(guard, F.when(n > above, n))

    return count


def _distinct_values(pattern: str, guard: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    values = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))))
    return lambda t: _where(guard, F.when(F.size(values(t)) > 1, F.size(values(t)).cast("long"))), lambda t: F.to_json(values(t))


def _object_numbers(t: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d+)\s+\d+\s+obj\b"), F.lit(1)), lambda x: x.try_cast("long")))


def _gap(t: Column) -> Column:
    top, n = F.array_max(_shared("numbers")), F.size(_shared("numbers"))
    return F.when((top > 0) & ((top - n) / top > 0.1), top - n)


def _gap_details(t: Column) -> Column:
    top, n = F.array_max(_shared("numbers")), F.size(_shared("numbers"))
    return F.to_json(F.struct(F.format_string("%.1f%%", (top - n) / top * 100).alias("gap_percentage"), top.alias("max_object"), n.cast("long").alias("defined_objects_count"), (top - n).alias("gap_count")))


def _unbalanced(t: Column) -> Column:
    a, b = count_of(t, r"\b\d+\s+\d+\s+obj\b"), count_of(t, "endobj")
    return _where("obj", F.when(a != b, F.greatest(a, b)))


def _unbalanced_details(t: Column) -> Column:
    return F.to_json(F.struct(count_of(t, r"\b\d+\s+\d+\s+obj\b").alias("obj_count"), count_of(t, "endobj").alias("endobj_count")))


def _date14(c: Column) -> Column:
    return F.substring(F.translate(c, "-:TZ", ""), 1, 14)


def _dates_differ(info: str, xmp: str) -> Callable[[Column], Column]:
    def count(t: Column) -> Column:
        a, b = last_group(t, rf"/{info}\s*\(D:(\d{{8,14}})"), last_group(t, rf"<xmp:{xmp}>([^<]*)</xmp:{xmp}>")
        return _where(xmp, F.when(_date14(a) != _date14(b), F.lit(1).cast("long")))

    return count


def _dates_of(info: str, xmp: str) -> Callable[[Column], Column]:
    return lambda t: F.to_json(F.struct(last_group(t, rf"/{info}\s*\(D:(\d{{8,14}})").alias("info"), last_group(t, rf"<xmp:{xmp}>([^<]*)</xmp:{xmp}>").alias("xmp")))


def _pair_differs(guard: str, first: Callable[[Column], Column], second: Callable[[Column], Column]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    return lambda t: _where(guard, F.when(first(t) != second(t), F.lit(1).cast("long"))), lambda t: F.to_json(F.struct(first(t).alias("from"), second(t).alias("to")))


def _duplicate_ids(t: Column) -> Column:
    """First numbers of entries that repeat within the texts after `xref 0 n` headings, if there are two such sections."""
    sections = F.regexp_extract_all(t, F.lit(r"(?s)xref\s*\n0\s+\d+\s*\n(.*?)(?=\btrailer\b|xref|\z)"), F.lit(1))
    entries = F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(r"(?m)^(\d+)\s+\d+\s+[nf]\b"), F.lit(1))))
    repeated = F.size(entries) - F.size(F.array_distinct(entries))
    return _where("xref", F.when((F.size(sections) > 1) & (repeated > 0), repeated.cast("long")))


def _version(t: Column) -> Column:
    return F.coalesce(first_group(t, r"%PDF-(\d\.\d)").try_cast("double"), F.lit(1.4))


def _contradictions(t: Column) -> Column:
    v, has = _version(t), lambda p: t.contains(p)
    return F.array_compact(F.array(
        F.when((v < 1.5) & has("/ObjStm"), F.lit("ObjStm")), F.when((v < 1.5) & has("/XRef") & has("stream"), F.lit("XRef stream")), F.when((v < 1.5) & has("/OCG"), F.lit("OCG")),
        F.when((v < 1.4) & has("/JBIG2Decode"), F.lit("JBIG2Decode")), F.when((v < 1.4) & has("/Metadata"), F.lit("Metadata")),
    ))


def _layers(t: Column) -> Column:
    """Distinct layer references or literal layer dictionaries, whichever are more."""
    blocks = F.array_join(F.regexp_extract_all(t, F.lit(r"/OCGs\s*\[(.*?)\]"), F.lit(1)), " ")
    refs = F.array_union(F.regexp_extract_all(blocks, F.lit(r"\d+\s+\d+\s+R"), F.lit(0)), F.transform(F.regexp_extract_all(t, F.lit(r"/OC\s+(\d+\s+\d+\s+R)"), F.lit(1)), lambda x: x))
    return F.greatest(F.size(F.array_distinct(F.transform(refs, lambda r: F.regexp_replace(r, r"\s+", " ")))), F.regexp_count(t, F.lit(r"/Type ?/OCG")))


def _days_ahead(as_of: Column) -> Callable[[Column], Column]:
    def days(t: Column) -> Column:
        dates = F.transform(F.regexp_extract_all(t, F.lit(r"D:(\d{8})"), F.lit(1)), lambda d: F.struct(d.alias("d"), F.try_to_timestamp(d, F.lit("yyyyMMdd")).alias("ts")))
        year = lambda x: F.year(x["ts"])
        ahead = lambda x: F.floor((F.unix_timestamp(x["ts"]) - F.unix_timestamp(as_of)) / 86400)
        found = F.filter(dates, lambda x: x["ts"].isNotNull() & (year(x) > 1990) & (year(x) < 2100) & (ahead(x) > 1))
        return F.transform(found, lambda x: F.struct(x["d"].alias("date"), ahead(x).alias("days_ahead")))

    return days


_doc_id = lambda t: scalars.normal_id(first_group(t, r"xmpMM:DocumentID(?:>|=\")([^<\"]+)"))
_original_id = lambda t: scalars.normal_id(first_group(t, r"xmpMM:OriginalDocumentID(?:>|=\")([^<\"]+)"))
_creators, _producers = _distinct_values(r"(?id)/Creator\s*\((.*?)\)", "/creator"), _distinct_values(r"(?id)/Producer\s*\((.*?)\)", "/producer")


def _sized(found: Column, n: int, of: Callable[[Column], Column] = lambda x: x) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    return lambda t: F.when(F.size(found) > 0, F.size(found).cast("long")), lambda t: F.to_json(F.slice(of(found), 1, n))


class Rules(list):
    """Rules, and what the columns that they share need: the domains that an address may end in, and the time that stands for now."""

    tlds: list[str]
    as_of: Column


def text_rules(tlds: list[str], as_of: Column) -> Rules:
    """All rules over scan text in the order in which their findings are shown. as_of stands for now."""
    out = Rules(_rules())
    out.tlds, out.as_of = tlds, as_of
    return out


def _rules() -> list[Rule]:
    domains = lambda found: F.array_sort(F.array_distinct(F.transform(found, contacts.link_host)))
    updates = lambda t: count_of(t, r"/Prev\s+\d+")
    linear = lambda t: t.rlike(r"/Linearized\s+\d+")
    form, script = r"(?i)/AcroForm\b", r"(?i)/JavaScript\b"
    denied = lambda t: scalars.permissions_denied(_permission_bits(t))
    return [
        Rule("TouchUp_TextEdit", lambda t: _shared("lower").contains("touchup_textedit").cast("long")),
        Rule("MultipleCreators", *_creators),
        Rule("MultipleProducers", *_producers),
        Rule("XMPHistory", lambda t: _shared("lower").contains("<xmpmm:history>").cast("long")),
        Rule("HasXFAForm", lambda t: _shared("lower").contains("/xfa").cast("long")),
        Rule("HasDigitalSignature", _holds(r"/Type\s*/Sig\b", "/sig")),
        Rule("MultipleStartxref", _counted("startxref", "startxref", 1), _mark_offsets("startxref")),
        Rule("IncrementalUpdates", lambda t: _where("/prev", F.when(updates(t) > 0, updates(t) + 1))),
        Rule("Linearized", _holds(r"/Linearized\s+\d+", "/linearized")),
        Rule("LinearizedUpdated", lambda t: _where("/linearized", (linear(t) & ((count_of(t, "startxref") > 1) | t.rlike(r"/Prev\s+\d+"))).cast("long"))),
        Rule("HasRedactions", _holds(r"(?i)/Redact\b", "/redact")),
        Rule("HasPieceInfo", _holds(r"(?i)/PieceInfo\b", "/pieceinfo")),
        Rule("HasAcroForm", _holds(form, "/acroform")),
        Rule("AcroFormNeedAppearances", lambda t: _where("/acroform", (t.rlike(form) & t.rlike(r"(?i)/NeedAppearances\s+true\b")).cast("long"))),
        Rule("ObjGenGtZero", _counted(r"\b\d+\s+0*[1-9]\d*\s+obj\b", "obj")),
        Rule("MetadataVersionMismatch", lambda t: F.when(_shared("lower").contains("/creator") | _shared("lower").contains("/producer"), ((t.rlike(r"(?i)/Creator\s*\([^)]*Acrobat 4") | t.contains("PDF 1.3")) & (_version(t) >= 1.7) & t.rlike(r"(?i)/(?:Creator|Producer)\b")).cast("long"))),
        Rule("VersionFeatureContradiction", lambda t: F.size(_contradictions(t)).cast("long"), lambda t: F.to_json(_contradictions(t))),
        Rule("SuspiciousTextPositioning", lambda t: F.when(t.contains("Tm") | t.contains("Td"), _above(count_of(t, r"(?:Tm|Td)\s+[^\n]*\s+(?:Tm|Td)"), 5))),
        Rule("WhiteRectangleOverlay", _counted(r"(?s)/DeviceRGB 1 1 1 rg.*?re\s+f", "/devicergb 1 1 1 rg", 3)),
        Rule("LargeObjectNumberGaps", _gap, _gap_details),
        Rule("UnbalancedObjects", _unbalanced, _unbalanced_details),
        Rule("DuplicateObjectIDs", _duplicate_ids),
        Rule("ContainsJavaScript", _holds(script, "/javascript")),
        Rule("JavaScriptAutoExecute", lambda t: _where("/javascript", (t.rlike(script) & t.rlike(r"(?i)/OpenAction\b")).cast("long"))),
        Rule("AdditionalActions", lambda t: _where("/javascript", (t.rlike(script) & t.rlike(r"(?i)/AA\s*<<")).cast("long"))),
        Rule("MultipleJavaScripts", _counted(script, "/javascript", 1)),
        Rule("SubmitFormAction", _counted(r"(?i)/SubmitForm\b", "/submitform")),
        Rule("LaunchShellAction", _counted(r"(?i)/Launch\b", "/launch")),
        Rule("EmailAddresses", *_sized(_shared("mails"), 20)),
        Rule("URLs", *_sized(_shared("links"), 20, domains)),
        Rule("UNCPaths", *_sized(_shared("shares"), 10)),
        Rule("EncryptionDictionary", _holds(r"/Encrypt\s+\d+\s+\d+\s+R", "/encrypt")),
        Rule("SecurityRestrictions", lambda t: F.when(t.contains("/P "), F.size(denied(t)).cast("long")), lambda t: F.to_json(denied(t))),
        Rule("InvisibleTextMode", lambda t: F.when(t.contains("Tr"), t.rlike(r"\s3\s+Tr\b").cast("long"))),
        Rule("ExcessiveWhiteColor", _counted(r"\b1\s+1\s+1\s+(?:rg|RG)\b", "rg", 20)),
        Rule("EmbeddedFiles", _counted(r"(?i)/Type\s*/EmbeddedFile", "/embeddedfile"), lambda t: F.to_json(F.slice(F.regexp_extract_all(t, F.lit(r"/F\s*\(([^)]*)\)"), F.lit(1)), 1, 10))),
        Rule("FileAttachmentAnnotations", _counted(r"/Subtype\s*/FileAttachment", "/fileattachment")),
        Rule("3DObjects", _holds(r"/Subtype\s*/3D\b", "/3d")),
        Rule("SoundAnnotations", _holds(r"/Subtype\s*/Sound\b", "/sound")),
        Rule("VideoContent", _holds(r"/Subtype\s*/(?:Movie|Screen)\b", "/subtype")),
        Rule("RichMedia", _holds(r"/Subtype\s*/RichMedia\b", "/richmedia")),
        Rule("FutureDatedTimestamps", *_sized(_shared("days"), 5, lambda days: F.transform(days, lambda x: x["date"]))),
        Rule("PDFACompliance", lambda t: _shared("lower").contains("pdfaid:part").cast("long"), lambda t: F.to_json(F.struct(F.coalesce(first_group(t, r"(?i)pdfaid:part(?:>|=\")(\d)"), F.lit("Unknown")).alias("part"), F.coalesce(first_group(t, r"(?i)pdfaid:conformance(?:>|=\")([A-Za-z])"), F.lit("Unknown")).alias("conformance")))),
        Rule("TextOperatorAnomaly", lambda t: F.nullif(_kerning(t) + _spacing(t), F.lit(0)), lambda t: F.to_json(F.struct((_kerning(t) + _spacing(t)).alias("count"), _kerning(t).alias("tj_large_kerning"), _spacing(t).alias("extreme_spacing")))),
        Rule("XMPIDChange", *_pair_differs("originaldocumentid", _original_id, _doc_id)),
        Rule("TrailerIDChange", *_pair_differs("/id", lambda t: first_group(t, r"/ID\s*\[\s*<([^>]*)>"), lambda t: first_group(t, r"/ID\s*\[\s*<[^>]*>\s*<([^>]*)>"))),
        Rule("CreateDateMismatch", _dates_differ("CreationDate", "CreateDate"), _dates_of("CreationDate", "CreateDate")),
        Rule("ModifyDateMismatch", _dates_differ("ModDate", "ModifyDate"), _dates_of("ModDate", "ModifyDate")),
        Rule("StructuralScrubbing", lambda t: F.nullif(t.contains("\0" * 200).cast("long") + t.contains(" " * 1000).cast("long"), F.lit(0))),
        Rule("HasLayers", lambda t: _where("/oc", _layers(t).cast("long")), lambda t: F.to_json(F.struct(_layers(t).alias("count")))),
    ]


def _above(n: Column, least: int) -> Column:
    return F.when(n > least, n)


def _kerning(t: Column) -> Column:
    return F.when(t.contains("(") | t.contains("<"), count_of(t, r"-\d{4,}\s+(?=[(<])")).otherwise(F.lit(0))


def _spacing(t: Column) -> Column:
    return F.when(t.contains("Tw") | t.contains("Tc"), count_of(t, r"\b(?:1\d{2,}|-[1-9]\d+)(?:\.\d+)?\s+T[wc]\b")).otherwise(F.lit(0))


def _mark_offsets(mark: str) -> Callable[[Column], Column]:
    """Places of a mark in the text, in one pass over what stands between."""

    def details(t: Column) -> Column:
        parts = F.split(t, mark)
        step = lambda acc, p: F.struct((acc["at"] + F.length(p) + len(mark)).alias("at"), F.concat(acc["found"], F.array(acc["at"] + F.length(p))).alias("found"))
        found = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step)["found"]
        return F.to_json(F.struct(F.size(found).alias("count"), found.alias("offsets")))

    return details


def _permission_bits(t: Column) -> Column:
    return first_group(t, r"/P\s+(-?\d+)").try_cast("int")


#: Indicators that alone make a file altered.
# The keys of high risk.
HIGH_RISK = [
    "HasRevisions", "TouchUp_TextEdit", "Signature: Invalid", "ErrorLevelAnalysis", "PageInconsistency", "ColorSpaceAnomaly", "TextOperatorAnomaly", "FontCharacterRemapping",
    "VersionFeatureContradiction", "UnbalancedObjects", "DuplicateObjectIDs", "FormFieldOverlay", "StackedFilters", "TimestampMismatch", "MissingObjects",
]


# The field of its details that the list of a rule stands in.
FIELDS = {"MultipleCreators": "values", "MultipleProducers": "values", "EmailAddresses": "emails", "URLs": "domains", "UNCPaths": "paths", "VersionFeatureContradiction": "contradictions", "SecurityRestrictions": "restrictions", "EmbeddedFiles": "filenames", "FutureDatedTimestamps": "dates"}


def as_objects(found: DataFrame) -> DataFrame:
    """Findings whose details are JSON objects throughout: lists under the field of their rule, and the count beside them."""
    field = F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv]), F.col("key"))
    listed = F.concat(F.lit('{"count":'), F.col("count").cast("string"), F.lit(',"'), field, F.lit('":'), F.col("details"), F.lit("}"))
    bare = F.concat(F.lit('{"count":'), F.col("count").cast("string"), F.lit("}"))
    return found.withColumn("details", F.when(F.col("details").startswith("["), listed).when(F.col("details").startswith("{"), F.col("details")).otherwise(bare))


def indicators(texts: DataFrame, path_col: str, text_col: str, rules: Rules) -> DataFrame:
    """path, rule_order, key, count, details: a row for each rule that holds in a text. A null text has none. Details are worked out only
    for rules that hold."""
    tlds, as_of = rules.tlds, rules.as_of
    t = F.col("_rules_text")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    named = texts.select(F.col(path_col).alias("path"), F.col(text_col).alias("_rules_text")).withColumn("_rules_lower", F.lower(t))
    shared = {
        "numbers": F.when(t.contains("obj"), _object_numbers(t)), "mails": F.when(t.contains("@"), contacts.emails(t, tlds)).otherwise(none("string")), "links": F.when(_shared("lower").contains("http"), contacts.links(t)).otherwise(none("string")),
        "shares": F.when(t.contains("\\\\"), contacts.unc_paths(t)).otherwise(none("string")), "days": F.when(t.contains("D:"), _days_ahead(as_of)(t)).otherwise(F.array().cast("array<struct<date:string,days_ahead:bigint>>")),
    }
    named = named.withColumns({f"_rules_{k}": v for k, v in shared.items()})
    each = [F.struct(F.lit(k).alias("rule_order"), F.lit(r.key).alias("key"), r.count(t).cast("long").alias("count")) for k, r in enumerate(rules)]
    held = named.select("*", F.explode(F.filter(F.array(*each), lambda x: x["count"] > 0)).alias("_rules_x"))
    details = F.when(F.lit(False), "")
    for k, r in enumerate(rules):
        if r.details:
            details = details.when(F.col("_rules_x.rule_order") == k, r.details(t))
    return held.select("path", "_rules_x.*", details.alias("details"))
