"""Rules over the fact tables of parsed files. Each gives path, key, count, details (JSON) for the files that it holds in; ties and first
hits fall to the smallest page, then the smallest object number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.parse.facts import table

#: Pages that the rules of single pages look at, as O4 lists them.
FIRST_PAGES, OCR_PAGES, COLOUR_PAGES = 10, 5, 50


def _found(rows: DataFrame, key: str, total: Column | int = 1, /, **details: Column) -> DataFrame:
    return rows.select("path", F.lit(key).alias("key"), (F.lit(total) if isinstance(total, int) else total).cast("long").alias("count"), (F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit(None).cast("string")).alias("details"))


def _some(name: str, n: int) -> Column:
    return F.slice(F.array_sort(name), 1, n)


def _area(box: str) -> Column:
    return (F.col(f"{box}.x1") - F.col(f"{box}.x0")) * (F.col(f"{box}.y1") - F.col(f"{box}.y0"))


def font_subsets(wide: DataFrame) -> DataFrame:
    """Fonts of one style that are embedded as several subsets."""
    named = table(wide, "fonts").where(F.col("basefont").rlike(r"^[^+]+\+.+")).select("path", F.substring_index("basefont", "+", 1).alias("prefix"), F.regexp_extract("basefont", r"\+(.*)$", 1).alias("full"))
    by = named.groupBy("path", "full").agg(F.array_sort(F.collect_set("prefix")).alias("subsets")).where(F.size("subsets") > 1)
    by = by.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("full", "subsets"))).alias("f"))
    return _found(by, "MultipleFontSubsets", F.size("f"), fonts=F.map_from_entries("f"))


def remapped_fonts(wide: DataFrame) -> DataFrame:
    """Fonts that are no subsets and whose map gives a printable character another one."""
    odd = table(wide, "fonts").where(F.col("remapped").isNotNull() & ~F.col("basefont").contains("+"))
    each = F.struct("xref", F.col("basefont").alias("font"), F.lower(F.hex("remapped.from_code")).alias("from_hex"), F.col("remapped.to_text").alias("to_unicode"))
    by = odd.groupBy("path").agg(F.count("*").alias("n"), F.collect_list(each).alias("d"))
    return _found(by, "FontCharacterRemapping", F.col("n"), count=F.col("n"), details=_some("d", 5))


def annotations(wide: DataFrame) -> DataFrame:
    by = table(wide, "annots").groupBy("path").agg(F.count("*").alias("n"), F.collect_set("subtype").alias("t"))
    return _found(by, "HasAnnotations", F.col("n"), count=F.col("n"), types=F.array_sort("t"))


def drawings(wide: DataFrame) -> DataFrame:
    """The first of the first pages with more than 50 painted paths."""
    by = table(wide, "pages").where(f"page <= {FIRST_PAGES} and n_drawings > 50").groupBy("path").agg(F.min_by(F.struct("page", "n_drawings"), "page").alias("p"))
    return _found(by, "ExcessiveDrawingOperations", F.col("p.n_drawings"), page=F.col("p.page"), count=F.col("p.n_drawings"))


def object_references(wide: DataFrame) -> DataFrame:
    """Objects that the file defines but its tables lack, and objects that it refers to without there being any."""
    gone = lambda c: F.filter(c, lambda n: (n >= F.col("slots")) | F.array_contains("empty_slots", n))
    rows = wide.where("ok").select("path", gone("defined").alias("orphans"), gone("referenced").alias("missing"))
    each = lambda c, key: _found(rows.where(F.size(c) > 0), key, F.size(c), count=F.size(c), ids=F.slice(c, 1, 50))
    return each("orphans", "OrphanedObjects").unionByName(each("missing", "MissingObjects"))


def boxes(wide: DataFrame) -> DataFrame:
    """The first page whose crop box shows less than 0.8 of its media box."""
    ratio = F.when(_area("mediabox") > 0, _area("cropbox") / _area("mediabox"))
    by = table(wide, "pages").withColumn("ratio", ratio).where("ratio < 0.8").groupBy("path").agg(F.min_by(F.struct("page", "ratio"), "page").alias("p"))
    return _found(by, "CropBoxMediaBoxMismatch", 1, page=F.col("p.page"), visible_ratio=F.format_string("%.1f%%", F.col("p.ratio") * 100))


def forms(wide: DataFrame) -> DataFrame:
    """Files with more than 50 fields, and filled fields that are less than a point wide or high."""
    w = table(wide.where("is_form"), "widgets")
    many = w.groupBy("path").agg(F.count("*").alias("n")).where("n > 50")
    small = w.where((F.col("field_value") != "") & ((F.col("rect.x1") - F.col("rect.x0") < 1) | (F.col("rect.y1") - F.col("rect.y0") < 1)))
    value = F.when(F.length("field_value") > 30, F.concat(F.substring("field_value", 1, 30), F.lit("..."))).otherwise(F.col("field_value"))
    by = small.groupBy("path").agg(F.count("*").alias("n"), F.collect_list(F.struct("page", F.col("field_name").alias("field"), value.alias("value"), "rect")).alias("d"))
    return _found(many, "ExcessiveFormFields", F.col("n"), count=F.col("n")).unionByName(_found(by, "FormFieldOverlay", F.col("n"), count=F.col("n"), details=_some("d", 10)))


def bookmarks(wide: DataFrame) -> DataFrame:
    """Titles that repeat, and the first entry whose page does not exist."""
    toc = table(wide, "toc").join(wide.select("path", "page_count"), "path")
    twice = toc.groupBy("path").agg((F.count("*") - F.count_distinct("title")).alias("n")).where("n > 0")
    far = toc.where("page < 1 or page > page_count").groupBy("path").agg(F.min_by(F.struct("title", "page"), "place").alias("b"))
    return _found(twice, "DuplicateBookmarks", F.col("n"), count=F.col("n")).unionByName(_found(far, "InvalidBookmarkDestinations", 1, title=F.col("b.title"), page=F.col("b.page")))


def hidden_annotations(wide: DataFrame) -> DataFrame:
    """Annotations of the first pages that are invisible, hidden or not to be viewed."""
    rows = table(wide, "annots").where((F.col("page") <= FIRST_PAGES) & (F.col("flags").bitwiseAND(F.lit(1 | 2 | 32)) != 0))
    by = rows.groupBy("path").agg(F.count("*").alias("n"), F.collect_list(F.struct("page", F.col("subtype").alias("type"), "flags", "rect")).alias("d"))
    return _found(by, "HiddenAnnotations", F.col("n"), count=F.col("n"), details=_some("d", 5))


def text_outside(wide: DataFrame) -> DataFrame:
    """The first line of the first pages that stands more than 100 points off its page."""
    lines = table(wide, "lines").where(f"page <= {FIRST_PAGES}").join(table(wide, "pages").select("path", "page", "mediabox"), ["path", "page"])
    off = (F.col("bbox.x0") < F.col("mediabox.x0") - 100) | (F.col("bbox.y0") < F.col("mediabox.y0") - 100) | (F.col("bbox.x1") > F.col("mediabox.x1") + 100) | (F.col("bbox.y1") > F.col("mediabox.y1") + 100)
    by = lines.where(off).groupBy("path").agg(F.min(F.struct("page", "bbox", "text")).alias("l"))
    return _found(by, "TextOutsideMediaBox", 1, page=F.col("l.page"), bbox=F.col("l.bbox"))


def languages(wide: DataFrame) -> DataFrame:
    rows = wide.where("language is not null and language <> ''")
    return _found(rows, "Languages", 1, languages=F.array(F.col("language")))


def ocr_layer(wide: DataFrame) -> DataFrame:
    """Pages among the first five that a picture covers by more than 0.8 while text has been seen up to there; two of them are suspect.
    What was seen on a page counts for those after it."""
    pages = table(wide, "pages").where(f"page <= {OCR_PAGES}").select("path", "page", _area("mediabox").alias("own"), (F.length(F.trim("text")) > 50).alias("text"))
    pictures = table(wide, "images").where(f"page <= {OCR_PAGES}").groupBy("path", "page").agg(F.max("area").alias("area"))
    sofar = Window.partitionBy("path").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    seen = pages.join(pictures, ["path", "page"], "left").withColumns({"has_text": F.max("text").over(sofar), "has_image": F.max(F.col("area").isNotNull()).over(sofar)})
    by = seen.where("has_text and has_image and area / own > 0.8").groupBy("path").agg(F.count("*").alias("n")).where("n >= 2")
    return _found(by, "OCRLayer", F.col("n"), pages_with_pattern=F.col("n"))


def page_inconsistency(wide: DataFrame) -> DataFrame:
    """Pages whose size, to a tenth of a point, or rotation differs from that of at least three quarters of a file's pages."""
    tenth = lambda c: F.bround(c, 1)
    pages = table(wide, "pages").select("path", "page", F.concat_ws("x", tenth(F.col("mediabox.x1") - F.col("mediabox.x0")), tenth(F.col("mediabox.y1") - F.col("mediabox.y0"))).alias("size"), F.col("rotation").cast("string").alias("rotation"))
    out = []
    for kind in ("size", "rotation"):
        by = pages.groupBy("path", kind).agg(F.count("*").alias("n"), F.min("page").alias("first"))
        top = by.groupBy("path").agg(F.sum("n").alias("total"), F.max_by(F.struct(kind, "n"), F.struct("n", -F.col("first"))).alias("top")).where("total > 1 and top.n >= 0.75 * total and top.n < total")
        out.append(pages.join(top, "path").where(F.col(kind) != F.col(f"top.{kind}")).select("path", "page", F.lit(kind).alias("type"), F.concat_ws(" vs ", F.col(kind), F.col(f"top.{kind}")).alias("details")))
    by = out[0].unionByName(out[1]).groupBy("path").agg(F.count("*").alias("n"), F.collect_list(F.struct("page", "type", "details")).alias("d"))
    return _found(by, "PageInconsistency", F.col("n"), count=F.col("n"), pages=_some("d", 10))


def colour_spaces(wide: DataFrame) -> DataFrame:
    """Of more than five pictures over 0.8 share a colour space and some other one has at most 0.15."""
    c = F.col("colorspace")
    bucket = F.when(c.contains("RGB"), "RGB").when(c.contains("CMYK"), "CMYK").when(c.contains("Gray"), "Gray").when(c.contains("Indexed"), "Indexed").otherwise("Other")
    by = table(wide, "images").where(f"page <= {COLOUR_PAGES}").groupBy("path", bucket.alias("space")).agg(F.count("*").alias("n"))
    total = by.groupBy("path").agg(F.sum("n").alias("total"), F.max_by("space", F.struct("n", "space")).alias("top"), F.max("n").alias("most")).where("total > 5 and most > 0.8 * total")
    odd = by.join(total, "path").where("space <> top and n <= 0.15 * total")
    by = odd.groupBy("path").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.format_string("%d of %d images use %s instead of %s", "n", "total", "space", "top"))).alias("d"))
    return _found(by, "ColorSpaceAnomaly", F.col("k"), count=F.col("k"), details=F.col("d"))


def stacked_filters(wide: DataFrame) -> DataFrame:
    by = table(wide, "objects").where(F.size("filters") > 1).groupBy("path").agg(F.count("*").alias("n"), F.collect_list(F.struct("xref", "filters")).alias("d"))
    return _found(by, "StackedFilters", F.col("n"), count=F.col("n"), details=_some("d", 10))


def fonts_without_file(wide: DataFrame, strict: bool = False) -> DataFrame:
    """Fonts whose own dictionary names no font file, which holds for nearly all, as the descriptor names it; strict follows the descriptor."""
    lacks = ~F.col("has_file") if strict else ~F.col("obj_text").contains("/FontFile")
    by = table(wide, "fonts").where(lacks).groupBy("path").agg(F.count("*").alias("n"), F.collect_set("basefont").alias("f"))
    return _found(by, "NonEmbeddedFont", F.col("n"), count=F.col("n"), fonts=_some("f", 10))


def repeated_images(wide: DataFrame) -> DataFrame:
    """Pictures with equal bytes under several object numbers, and pictures with EXIF near their beginning."""
    rows = table(wide, "images").where("xref is not null")
    twice = rows.groupBy("path", "md5").agg(F.array_sort(F.collect_set("xref")).alias("x")).where(F.size("x") > 1).groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("md5", "x"))).alias("d"))
    exif = table(wide, "images").where(F.instr(F.decode(F.substring(F.col("data"), 1, 1000), "ISO-8859-1"), "Exif") > 0).groupBy("path").agg(F.count("*").alias("n"))
    return _found(twice, "DuplicateImagesWithDifferentXrefs", F.col("n"), count=F.col("n"), details=F.col("d")).unionByName(_found(exif, "ImagesWithEXIF", F.col("n"), count=F.col("n")))


def jpeg_analysis(wide: DataFrame) -> DataFrame:
    """All JPEG pictures and how many of them have a suspicious or known first quantisation table."""
    from dossierlake.functions.jpeg import quantisation_tables

    images = table(wide, "images").where("array_contains(filters, 'DCTDecode') or array_contains(filters, 'DCT')").withColumn("id", F.struct("path", "page", "xref"))
    tables = quantisation_tables(images, "id", "data")
    odd = F.col("error").isNull() & ((F.size("warnings") > 0) | F.col("match").isNotNull())
    said = F.struct(F.col("id.page").alias("page"), F.col("id.xref").alias("xref"), F.concat_ws("; ", F.col("match"), F.array_join("warnings", "; ")).alias("said"))
    by = tables.groupBy(F.col("id.path").alias("path")).agg(F.count("*").alias("n"), F.count_if(odd).alias("s"), F.collect_list(F.when(odd, said)).alias("d"))
    return _found(by, "JPEG_Analysis", F.col("n"), total_jpegs=F.col("n"), suspicious_count=F.col("s"), suspicious_details=_some("d", 5))


def encryption(wide: DataFrame) -> DataFrame:
    """Files with an encryption dictionary. Nothing is decrypted: a file whose pages can be read all the same is open."""
    rows = wide.where("is_encrypted")
    return _found(rows, "Encrypted").unionByName(_found(rows.where("ok and page_count > 0"), "EncryptedButOpen"))


def xfa_and_layers(wide: DataFrame) -> DataFrame:
    """XFA by the form's dictionary, and more layers than pages by the scan text."""
    from dossierlake.functions.text_rules import _layers

    layers = wide.where("ok").select("path", "page_count", _layers(F.col("text")).alias("n")).where("n > page_count")
    return _found(wide.where("is_xfa"), "HasXFAForm").unionByName(_found(layers, "MoreLayersThanPages", F.col("n"), layers=F.col("n"), pages=F.col("page_count")))


def touchup_text(wide: DataFrame) -> DataFrame:
    """Text that a TouchUp mark covers, by page."""
    rows = table(wide, "pages").where("touchup <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", F.split("touchup", "\n").alias("lines")))).alias("d"))
    return _found(rows, "TouchUp_TextEdit", F.size("d"), found_text=F.map_from_entries("d"))


def scripts(wide: DataFrame) -> DataFrame:
    """Scripts of files that the scan text says hold some."""
    rows = wide.where(F.col("text").rlike(r"(?i)/JavaScript\b") & (F.size("scripts") > 0))
    return _found(rows, "ExtractedJavaScript", F.size("scripts"), scripts=F.col("scripts"))


RULES: list[Callable[[DataFrame], DataFrame]] = [
    touchup_text, font_subsets, remapped_fonts, xfa_and_layers, annotations, drawings, object_references, boxes, forms, bookmarks, hidden_annotations, text_outside, languages, encryption,
    ocr_layer, page_inconsistency, colour_spaces, stacked_filters, fonts_without_file, repeated_images, jpeg_analysis, scripts,
]


def structural(wide: DataFrame) -> DataFrame:
    """path, rule_order, key, count, details of all rules over parsed files; 100 and up, after the rules over text."""
    out = None
    for k, rule in enumerate(RULES):
        rows = rule(wide).withColumn("rule_order", F.lit(100 + k))
        out = rows if out is None else out.unionByName(rows)
    return out.select("path", "rule_order", "key", "count", "details")


def archive_violations(indicators: DataFrame) -> DataFrame:
    """PDF/A files that are encrypted, hold scripts or fonts without file: a rule over the findings of others."""
    against = ["Encrypted", "EncryptionDictionary", "ContainsJavaScript", "NonEmbeddedFont"]
    by = indicators.groupBy("path").agg(F.bool_or(F.col("key") == "PDFACompliance").alias("pdfa"), F.collect_set(F.when(F.col("key").isin(against), F.col("key"))).alias("v")).where("pdfa and size(v) > 0")
    return _found(by, "PDFAViolation", F.size("v"), count=F.size("v"), details=F.array_sort("v")).withColumn("rule_order", F.lit(199)).select("path", "rule_order", "key", "count", "details")
