"""Details of findings as text for reports and for the screen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def summary(key: Column, details: Column) -> Column:
    """A finding in a few words: its count, else the beginning of its text, else how many fonts or items it has, else its key alone. details
    is JSON; one that is null, empty or no object counts for nothing."""
    get = lambda name: F.get_json_object(details, f"$.{name}")
    has = F.coalesce(F.json_object_keys(details), F.array().cast("array<string>"))
    many = lambda c: F.coalesce(F.json_array_length(c), F.size(F.json_object_keys(c)), F.lit(0)).cast("string")
    out = F.when(F.array_contains(has, "count"), F.concat(key, F.lit(" ("), F.coalesce(get("count"), F.lit("None")), F.lit(")")))
    out = out.when(F.array_contains(has, "text"), F.concat(key, F.lit(": "), F.substring(get("text"), 1, 50), F.lit("...")))
    out = out.when(F.array_contains(has, "fonts"), F.concat(key, F.lit(" ("), many(get("fonts")), F.lit(" fonts)")))
    out = out.when(F.array_contains(has, "items") & get("items").startswith("["), F.concat(key, F.lit(" ("), many(get("items")), F.lit(" items)")))
    return out.otherwise(key)


# What the screen says of a finding, with fields of its details in braces; keys that are not here are shown as their name.
TEMPLATES = {
    "MultipleCreators": "Multiple creators found: {count}", "MultipleProducers": "Multiple producers found: {count}", "CreateDateMismatch": "Creation dates differ: Info={info}, XMP={xmp}", "ModifyDateMismatch": "Modification dates differ: Info={info}, XMP={xmp}",
    "TrailerIDChange": "Trailer ID changed: {from} to {to}", "XMPIDChange": "XMP DocumentID changed: {from} to {to}", "MultipleStartxref": "Multiple startxref: {count}", "IncrementalUpdates": "Incremental updates: {count} versions",
    "XMPHistory": "XMP history is present", "LargeObjectNumberGaps": "Gaps in object numbers: {gap_percentage} ({gap_count} of {max_object})", "OrphanedObjects": "Unreferenced objects: {count} {ids}", "MissingObjects": "References to missing objects: {count} {ids}",
    "ObjGenGtZero": "Objects with a generation above zero: {count}", "HasAnnotations": "Annotations: {count} {types}", "HasLayers": "Layers: {count}", "MoreLayersThanPages": "More layers ({layers}) than pages ({pages})",
    "HiddenAnnotations": "Hidden annotations: {count}", "SubmitFormAction": "Submit form actions: {count}", "LaunchShellAction": "Launch actions: {count}", "EmailAddresses": "E-mail addresses: {count} {emails}", "URLs": "Links: {count} {domains}",
    "UNCPaths": "Network paths: {count} {paths}", "Languages": "Languages: {languages}", "SecurityRestrictions": "Not allowed: {restrictions} ({permissions_value})", "EmbeddedFiles": "Embedded files: {count} {filenames}",
    "PolyglotFile": "{status}: header at {pdf_header_offset}, before it {detected_prefix_format}", "FutureDatedTimestamps": "Dates in the future: {count} {dates}", "PDFACompliance": "Claims PDF/A-{part}", "NonEmbeddedFont": "Fonts that are not embedded: {fonts}",
    "OCRLayer": "Suspected text layer of a scan on {pages_with_pattern} pages", "PageInconsistency": "Pages that differ: {count}", "ColorSpaceAnomaly": "Colour spaces that differ: {details}", "ImagesWithEXIF": "Images with EXIF: {count}",
    "FontCharacterRemapping": "Fonts that map characters to others: {count}", "VersionFeatureContradiction": "Version {version} does not know: {contradictions}", "UnbalancedObjects": "Objects begun {obj_count}, ended {endobj_count}",
    "DuplicateObjectIDs": "Numbers that repeat: {count} {ids}", "FormFieldOverlay": "Filled fields without size: {count}", "StackedFilters": "Streams behind several filters: {count}", "JPEG_Analysis": "Suspicious JPEG fingerprints: {suspicious_count} of {total_jpegs}",
    "ErrorLevelAnalysis": "Images with error level anomalies: {count}", "TextOperatorAnomaly": "Unusual text operators: {count}", "XMPHistoryGap": "Gaps in the history: {count}", "StructuralScrubbing": "Long runs of zeros or blanks: {count}",
    "PDFAViolation": "Breaks PDF/A: {details}", "TimestampMismatch": "Info and XMP dates differ: {count}", "TimestampSpoofing": "Created after it was modified: {note}", "ExtractedJavaScript": "Scripts: {scripts}", "AssetRelationship": "Derived from {derivation}",
    "TouchUp_TextEdit": "TouchUp TextEdit: {found_text}", "CropBoxMediaBoxMismatch": "Page {page} shows {visible_ratio} of its media box",
}
# Keys that are hidden when this field of theirs is 0.
HIDDEN = {"EmailAddresses": "count", "URLs": "count", "UNCPaths": "count", "HiddenAnnotations": "count", "JPEG_Analysis": "suspicious_count"}


def is_placeholder(name: Column) -> Column:
    """Names of related files that stand for nothing but an id."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | (n == "xmp.did:...") | (n.startswith("ID: ") & n.endswith("..."))


def for_screen(key: Column, details: Column) -> Column:
    """A finding by its template; null if it is to be hidden. Fields that the details lack are left blank."""
    import re

    out = F.when(F.lit(False), "")
    for k, t in TEMPLATES.items():
        parts = [F.coalesce(F.get_json_object(details, f"$.{p[1:-1]}"), F.lit("")) if p.startswith("{") else F.lit(p) for p in re.findall(r"\{\w+\}|[^{]+", t)]
        out = out.when(key == k, F.trim(F.concat(*parts)))
    out = out.otherwise(F.replace(key, F.lit("_"), F.lit(" ")))
    none = reduce(lambda acc, kv: acc | ((key == kv[0]) & (F.coalesce(F.get_json_object(details, f"$.{kv[1]}"), F.lit("1")) == "0")), HIDDEN.items(), F.lit(False))
    files = F.from_json(F.get_json_object(details, "$.files"), "array<struct<type:string,name:string>>")
    named = F.filter(F.coalesce(files, F.array().cast("array<struct<type:string,name:string>>")), lambda f: ~is_placeholder(f["name"]))
    line = lambda f: F.concat(F.when(f["type"] == "derived_from", "  ← Derived from: ").when(f["type"] == "parent_of", "  → Parent of: ").otherwise("  ↔ Related to: "), f["name"])
    related = F.when(F.size(named) > 0, F.concat(F.lit("Related files ("), F.size(named).cast("string"), F.lit("):\n"), F.array_join(F.transform(named, line), "\n")))
    return F.when(key == "RelatedFiles", related).when(~none, out)


def fragments(text: Column, most: int = 20) -> Column:
    """Pieces of a line to look for on a page: what stands between other characters than letters, digits and ` .,:-`, three letters or more
    with a letter in them, and its words; each once whatever its case, the first of them."""
    pieces = F.filter(F.transform(F.split(text, r"[^0-9A-Za-zÀ-ÿ .,:\-]+"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 3) & p.rlike("[A-Za-zÀ-ÿ]"))
    both = F.concat(pieces, F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ÿ]{3,})"), F.lit(1)))
    place = lambda p: F.array_position(F.transform(both, lambda q: F.lower(q)), F.lower(p))
    return F.slice(F.filter(both, lambda p, i: place(p) == i + 1), 1, most)


def image_suspicion(warnings: Column, match: Column) -> Column:
    """HIGH, MEDIUM or LOW for one picture by its table's warnings and known source."""
    w = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.when(F.exists(w, lambda x: x.contains("CRITICAL")), "HIGH").when((F.size(w) > 0) | F.coalesce(match.contains("Photoshop"), F.lit(False)), "MEDIUM").otherwise("LOW")
