"""Scalar helpers of the forensic rules: identifiers, cells, time spans, dates, quantisation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of document identifiers, taken off once each in this order.
ID_PREFIXES = ["URN:UUID:", "UUID:", "XMP.IID:", "XMP.DID:"]


def normal_id(value: Column) -> Column:
    """Upper case, known prefixes off, blanks and angle brackets off both ends; empty becomes null."""
    out = F.trim(F.upper(value))
    out = reduce(lambda c, p: F.when(c.startswith(p), F.substring(c, len(p) + 1, 2**31 - 1)).otherwise(c), ID_PREFIXES, out)
    return F.nullif(F.regexp_replace(out, r"^[<> ]+|[<> ]+$", ""), F.lit(""))


def clean_cell(value: Column) -> Column:
    """Text for a table cell: null is empty, control characters but tab, line feed and carriage return go, byte order marks at the start go
    in any of their spellings."""
    out = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.regexp_replace(out, "^(?:[\ufeff\ufffe]+|\u00ef\u00bb\u00bf)", "")
    return F.regexp_replace(out, "^(?:\u00fe\u00ff|\u00ff\u00fe)", "")


def span(seconds: Column) -> Column:
    """(+Nd Nh Nm S.SSs) without zero parts; empty below a millisecond."""
    whole = F.floor(seconds).cast("long")
    d, h, m = F.floor(whole / 86400), F.floor(F.pmod(whole, F.lit(86400)) / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    s = seconds - (d * 86400 + h * 3600 + m * 60)
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("long").cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), F.when(s > 0, F.concat(F.format_string("%.2f", s), F.lit("s"))))
    return F.when(F.abs(seconds) < 0.001, "").otherwise(F.concat(F.lit("(+"), text, F.lit(")")))


def permissions_denied(bits: Column) -> Column:
    """What an encryption dictionary's /P value forbids; null unless it is negative and forbids something."""
    names = {4: "print", 8: "modify", 16: "copy", 32: "annotate"}
    found = F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) == 0, F.lit(n)) for b, n in names.items()]))
    return F.when((bits < 0) & (F.size(found) > 0), found)


# First bytes of other formats before a PDF header.
MAGICS = {"PK\u0003\u0004": "ZIP", "MZ": "EXE", "\u007fELF": "ELF", "<html": "HTML", "<!DO": "HTML", "GIF8": "GIF", "\u0089PNG": "PNG", "\u00ff\u00d8\u00ff": "JPEG", "\u0000\u0000\u0000": "NUL"}


def header_state(latin: Column) -> Column:
    """Where %PDF- stands in a latin-1 text: null at the start, else a verdict by offset and by what precedes it."""
    at = F.instr(latin, "%PDF-") - 1
    other = reduce(lambda c, m: c | latin.startswith(m), MAGICS, F.lit(False))
    return F.when(at < 0, "CRITICAL").when(at == 0, F.lit(None)).when(at <= 1024, F.when(other | (at >= 512), "SUSPICIOUS").otherwise("MINOR")).otherwise("CRITICAL")


def table_warning(values: Column) -> Column:
    """Verdict over a quantisation table, the first that holds; null if none."""
    low, high, kinds = F.array_min(values), F.array_max(values), F.size(F.array_distinct(values))
    return F.when(low == high, "CRITICAL").when(kinds < 10, "LOW DIVERSITY").when(low < 2, "ULTRA LOW COMPRESSION").when(high > 250, "EXTREME COMPRESSION")


def first_group(text: Column, pattern: str) -> Column:
    """First group of the first match, null if none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1))


def last_group(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")
