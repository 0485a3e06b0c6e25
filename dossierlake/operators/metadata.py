"""Metadata text and raw dates: identifiers, events and tools of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.scalars import first_group, normal_id

# The form of a metadata line, of a raw date, and of an identifier in either notation of the packet.
LINE = r"^\[([^\]]+)\]\s*([^:]+?)\s*:\s*(.*)$"
RAW_DATE = r"/([A-Za-z]+)\s*\(D:(\d{14})"


def _tag(name: str) -> str:
    return rf"{name}(?:>|=\")([^<\"]+)"


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), normal_id)


def _one(text: Column, pattern: str) -> Column:
    return F.array(normal_id(first_group(text, pattern)))


def document_ids(files: DataFrame, path_col: str = "path", text_col: str = "text", meta_col: str | None = None) -> DataFrame:
    """path, kind (own, ref), id: what a file is called and what it names.

    own: its document and instance ids, both ids of the trailer, and the ids of the metadata text; ref: its original's and its parents' and
    ingredients' ids, without those that are its own. Ids are normalised; a null text has none.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    m = F.coalesce(F.col(meta_col), F.lit("")) if meta_col else F.lit("")
    trailer = r"/ID\s*\[\s*<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>", r"/ID\s*\[\s*<[0-9A-Fa-f]+>\s*<([0-9A-Fa-f]+)>"
    parents = F.array_join(F.regexp_extract_all(t, F.lit(r"(?s)<xmpMM:(?:DerivedFrom|Ingredients)(.*?)(?:</xmpMM:(?:DerivedFrom|Ingredients)>|/>)"), F.lit(1)), " ")
    own = F.concat(
        _one(t, _tag("xmpMM:DocumentID")), _one(t, _tag("xmpMM:InstanceID")), *[_all(t, p) for p in trailer],
        _one(m, r"(?m)^(?:\[[^\]]+\]\s*)?Document ID\s*:\s*(\S+)"), _one(m, r"(?m)^(?:\[[^\]]+\]\s*)?Instance ID\s*:\s*(\S+)"),
    )
    ref = F.concat(_one(t, _tag("xmpMM:OriginalDocumentID")), _all(parents, _tag("stRef:documentID")), _all(parents, _tag("stRef:instanceID")), _one(m, r"(?m)Original Document ID\s*:\s*(\S+)"))
    both = files.select(F.col(path_col).alias("path"), F.array_distinct(F.array_compact(own)).alias("own"), F.array_distinct(F.array_compact(ref)).alias("ref"))
    rows = F.concat(F.transform("own", lambda i: F.struct(F.lit("own").alias("kind"), i.alias("id"))), F.transform(F.array_except("ref", "own"), lambda i: F.struct(F.lit("ref").alias("kind"), i.alias("id"))))
    return both.select("path", F.explode(rows).alias("x")).select("path", "x.*")


def raw_dates(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, key, ts (without zone): dates of 14 digits after a key; impossible ones are left out."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text_col), F.lit(RAW_DATE), F.lit(1)).alias("key"), F.regexp_extract_all(F.col(text_col), F.lit(RAW_DATE), F.lit(2)).alias("digits"))
    rows = files.select(F.col(path_col).alias("path"), F.explode(pairs).alias("x"))
    return rows.select("path", F.col("x.key").alias("key"), F.try_to_timestamp("x.digits", F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("ts")).where("ts is not null")


def lines(files: DataFrame, path_col: str = "path", meta_col: str = "meta") -> DataFrame:
    """path, line_no, group, tag, value of metadata lines; other lines are left out."""
    rows = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(F.col(meta_col), r"\r?\n")).alias("line_no", "line")).where(F.col("line").rlike(LINE))
    return rows.select("path", "line_no", *[F.regexp_extract("line", LINE, k).alias(name) for k, name in ((1, "group"), (2, "tag"), (3, "value"))])


def first_values(meta_lines: DataFrame, tags: list[str]) -> DataFrame:
    """path and a column per tag: the first value of it that is not empty (spaces of a tag become underscores)."""
    named = meta_lines.where(F.trim("value") != "")
    return named.groupBy("path").agg(*[F.min_by(F.when(F.lower("tag") == t.lower(), F.col("value")), F.when(F.lower("tag") == t.lower(), F.col("line_no"))).alias(t.lower().replace(" ", "_")) for t in tags])


def meta_dates(meta_lines: DataFrame) -> DataFrame:
    """path, group, tag, text, ts, is_aware: values that begin with a date. Aware ones have a zone and are instants; others count as UTC."""
    form = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
    zone = F.regexp_extract("value", form, 5)
    iso = F.concat(F.regexp_replace(F.regexp_extract("value", form, 0), r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2}).*$", "$1-$2-$3 $4"), F.when(zone == "", "Z").otherwise(zone))
    out = meta_lines.where(F.col("value").rlike(form)).select("path", "group", "tag", F.regexp_extract("value", form, 0).alias("text"), iso.try_cast("timestamp").alias("ts"), (zone != "").alias("is_aware"))
    return out.where("ts is not null")


def date_range(dates: DataFrame) -> DataFrame:
    """path, created (earliest creation), modified (latest modification or metadata date)."""
    tag = F.regexp_replace(F.lower("tag"), "[ _]", "")
    return dates.groupBy("path").agg(F.min(F.when(tag.isin("createdate", "creationdate"), F.col("ts"))).alias("created"), F.max(F.when(tag.isin("modifydate", "metadatadate"), F.col("ts"))).alias("modified"))


def timestamp_mismatch(files: DataFrame, path_col: str = "path", text_col: str = "text", seconds: int = 60) -> DataFrame:
    """path, kind (create, modify, spoofed), seconds: dates of the information dictionary and the packet more than a minute apart, and a
    creation more than a minute after the modification. Zones are not looked at; only the first 14 digits count."""
    t = F.col(text_col)
    when = lambda p: F.try_to_timestamp(F.substring(F.regexp_replace(first_group(t, p), r"\D", ""), 1, 14), F.lit("yyyyMMddHHmmss"))
    d = files.select(
        F.col(path_col).alias("path"), when(r"/CreationDate\s*\(D:([^)]*)\)").alias("c"), when(r"/ModDate\s*\(D:([^)]*)\)").alias("m"), when(_tag("xmp:CreateDate")).alias("xc"), when(_tag("xmp:ModifyDate")).alias("xm")
    )
    gap = lambda a, b: F.unix_timestamp(a) - F.unix_timestamp(b)
    found = F.array_compact(F.array(
        F.when(F.abs(gap("c", "xc")) > seconds, F.struct(F.lit("create").alias("kind"), F.abs(gap("c", "xc")).alias("seconds"))),
        F.when(F.abs(gap("m", "xm")) > seconds, F.struct(F.lit("modify").alias("kind"), F.abs(gap("m", "xm")).alias("seconds"))),
        F.when(gap("c", "m") > seconds, F.struct(F.lit("spoofed").alias("kind"), gap("c", "m").alias("seconds"))),
    ))
    return d.select("path", F.explode(found).alias("x")).select("path", "x.*")


# Names of software, matched anywhere in a value, that make a CreatorTool count.
SOFTWARE = (
    "abbey abbyy acrobat adobe apache birt billy bluebeam bullzip businesscentral cairo canva chrome chromium clibpdf collabora cups cutepdf deskpdf dinero dynamics ecopy economic edge eboks evince excel firefox "
    "finereader formpipe foxit fpdf framemaker gdoc ghostscript ghostview gimp helpndoc illustrator ilovepdf imagemagick indesign inkscape itext javelin jasperreports karbon kmd lasernet latex libharu libreoffice "
    "luatex mathcad microsoft mobipocket mupdf navision netcompany nitro okular office openoffice openpdf paperport pagestream pageplus pdf24 pdfarranger pdfbox pdfcreator pdfedit pdfescape pdfgear pdflatex "
    "pdfjs pdfsam pdfsharp pdfstudio pdftk pdfxchange photoshop poppler powerpoint pstoedit primopdf prince qpdf qiqqa quartz reportlab revu safari scribus serif skim skia smallpdf sodapdf solidconverter "
    "stdu sumatra swftools tcpdf tex utopia visma word wkhtml wkhtmltopdf xara xetex xpdf"
).split()


def is_software(value: Column) -> Column:
    return value.rlike("(?i)" + "|".join(SOFTWARE))


def tools(meta_lines: DataFrame) -> DataFrame:
    """path, producer_pdf, producer_xmp (each filled from the other), softwareagent, application, software, creatortool (only of known
    software), xmptoolkit, create_tool, modify_tool: first values that are not empty."""
    tag, group, value = F.regexp_replace(F.lower("tag"), " ", ""), F.lower(F.trim("group")), F.trim("value")
    pick = lambda holds: F.min_by(F.when(holds & (value != ""), value), F.when(holds & (value != ""), F.col("line_no")))
    out = meta_lines.groupBy("path").agg(
        pick((tag == "producer") & (group == "pdf")).alias("p"), pick((tag == "producer") & group.isin("xmp-pdf", "xmp_pdf")).alias("x"),
        *[pick(tag == t).alias(t) for t in ("softwareagent", "application", "software", "xmptoolkit")], pick((tag == "creatortool") & is_software(value)).alias("creatortool"),
    )
    out = out.select("path", F.coalesce("p", "x").alias("producer_pdf"), F.coalesce("x", "p").alias("producer_xmp"), "softwareagent", "application", "software", "creatortool", "xmptoolkit")
    create = F.coalesce("producer_pdf", "producer_xmp", "application", "software", "creatortool", F.lit(""))
    return out.withColumn("create_tool", create).withColumn("modify_tool", F.coalesce("softwareagent", "create_tool"))


def history_events(meta_lines: DataFrame) -> DataFrame:
    """path, line_no, k, ts, action, agent, changed: blocks {Action=.., When=.., ..} of History lines with a date that can be read."""
    rows = meta_lines.where("group = 'XMP-xmpMM' and tag = 'History'").select("path", "line_no", F.posexplode(F.regexp_extract_all("value", F.lit(r"\{([^}]+)\}"), F.lit(1))).alias("k", "block"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?:^|,)\s*{name}\s*=([^,]*)", 1)), F.lit(""))
    when = field("When")
    rows = rows.select("path", "line_no", "k", when.alias("said"), F.try_to_timestamp(when).alias("ts"), field("Action").alias("action"), field("SoftwareAgent").alias("agent"), field("Changed").alias("changed"))
    return rows.where("ts is not null").withColumn("is_aware", F.col("said").rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"))


def metadata_text(wide: DataFrame) -> DataFrame:
    """path, meta: the built-in producer of metadata lines `[Group] Tag : value` from the information dictionary and the packet of parsed
    files. A file without either has an empty text."""
    t = F.col("text")
    date = lambda c: F.regexp_replace(c, r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:([+-]\d{2})'?(\d{2})'?|(Z))?.*$", "$1:$2:$3 $4:$5:$6$7:$8$9")
    neat = lambda c: F.regexp_replace(F.regexp_replace(date(c), r"(\d):$", "$1"), r"(\d):Z$", "$1Z")
    info = {"Producer": "Producer", "Creator": "Creator", "Author": "Author", "Title": "Title", "CreationDate": "Create Date", "ModDate": "Modify Date"}
    rows = [F.when(F.try_element_at("info", F.lit(k)) != "", F.concat(F.lit(f"[PDF] {v} : "), neat(F.try_element_at("info", F.lit(k))))) for k, v in info.items()]
    xmp = {"xmp:CreatorTool": ("XMP-xmp", "Creator Tool"), "xmp:CreateDate": ("XMP-xmp", "Create Date"), "xmp:ModifyDate": ("XMP-xmp", "Modify Date"), "xmp:MetadataDate": ("XMP-xmp", "Metadata Date"), "pdf:Producer": ("XMP-pdf", "Producer"), "xmpMM:DocumentID": ("XMP-xmpMM", "Document ID"), "xmpMM:InstanceID": ("XMP-xmpMM", "Instance ID"), "xmpMM:OriginalDocumentID": ("XMP-xmpMM", "Original Document ID"), "x:xmptk": ("XMP-x", "XMP Toolkit")}
    iso = lambda c: F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}:\d{2}:\d{2})", "$1:$2:$3 $4")
    rows += [F.when(first_group(t, _tag(k)).isNotNull(), F.concat(F.lit(f"[{g}] {v} : "), iso(first_group(t, _tag(k))))) for k, (g, v) in xmp.items()]
    return wide.select("path", F.array_join(F.array_compact(F.array(*rows)), "\n").alias("meta"))
