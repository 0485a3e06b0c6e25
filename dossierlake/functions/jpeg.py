"""Quantisation tables of JPEG bytes, in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First 16 entries of known tables, as hex. Two of the published signatures are a digit short and can match nothing; they are left out.
KNOWN_TABLES = {
    "03020202020303020202030302030303": "Photoshop Quality 100 (Maximum)",
    "05030404030504040404050706050404": "Photoshop Quality 95-98",
    "08050505050705080809090a0a0a090a": "Photoshop Quality 90",
    "0c08080a080c0c0c0c0c0c0c0c0c0c0c": "Photoshop Quality 80",
    "1812121518181c181c1c1c1c1c1c1c1c": "Photoshop Quality 60 (Save for Web common)",
    "03020203030203030303030304030403": "GIMP Quality 100",
    "06040406060604060606060708070606": "GIMP Quality 95",
    "09060609090609090909090a0b0a0909": "GIMP Quality 90",
    "02020202020202020202020202020202": "Generic Scanner (Low compression)",
    "04030403040504040404050706050404": "HP Scanner signature",
    "06040506050506060606070908070606": "Canon Scanner signature",
    "08060608080608080808090b0a090808": "Epson Scanner signature",
    "01010101010101010101010101010101": "Critical: Invalid digital fingerprint (Likely manipulated/fake)",
}
# Verdicts in order of rank, and the errors of broken input.
WARNINGS = {
    "CRITICAL": "CRITICAL: Forged fingerprint (Real photos have variations; identical values are impossible in original scans)",
    "LOW DIVERSITY": "SUSPICIOUS: Low digital diversity (Unusual for original hardware scans)",
    "ULTRA LOW COMPRESSION": "SUSPICIOUS: Ultra-low compression (Often used during image manipulation)",
    "EXTREME COMPRESSION": "WARNING: Extreme compression (Image quality heavily degraded)",
}
EDITED = "Pattern matches Photoshop-style compression"
ERRORS = ["Not a valid JPEG (missing SOI marker)", "No quantization table found", "Truncated DQT marker", "Truncated DQT data", "Truncated quantization table"]


def _byte(content: Column, at: Column) -> Column:
    return F.conv(F.hex(content.substr(at, F.lit(1))), 16, 10).cast("int")


def quantisation_tables(images: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, error, signature, match, table_id, precision, lo, hi, mean, kinds, warnings of the first table of each image. A null or broken
    image has an error and nothing else. mean is rounded half to even, to one place."""
    from dossierlake.functions.scalars import table_warning

    c = F.col("c")
    rows = images.select(F.col(id_col).alias("id"), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("c"))
    rows = rows.withColumn("n", F.octet_length(c)).withColumn("at", F.instr(F.decode(c, "ISO-8859-1"), "ÿÛ"))
    rows = rows.withColumn("kind", F.when(F.col("at") + 4 <= F.col("n"), _byte(c, F.col("at") + 4)))
    rows = rows.withColumn("size", F.when(F.shiftright("kind", 4) == 0, 64).otherwise(128))
    broken = [F.hex(c.substr(F.lit(1), F.lit(2))) != "FFD8", F.col("at") == 0, F.col("at") + 3 > F.col("n"), F.col("at") + 4 > F.col("n"), F.col("at") + 4 + F.col("size") > F.col("n")]
    error = reduce(lambda acc, x: acc.when(x[0], x[1]), zip(broken, ERRORS), F.when(F.lit(False), ""))
    rows = rows.withColumn("error", error)
    values = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: _byte(c, F.col("at") + 4 + i))
    rows = rows.withColumn("v", F.when(F.col("error").isNull(), values)).withColumn("signature", F.when(F.col("error").isNull(), F.lower(F.hex(c.substr(F.col("at") + 5, F.lit(16))))))
    rows = rows.withColumn("match", F.try_element_at(F.create_map(*[F.lit(x) for kv in KNOWN_TABLES.items() for x in kv]), F.col("signature")))
    verdict = F.try_element_at(F.create_map(*[F.lit(x) for kv in WARNINGS.items() for x in kv]), table_warning(F.col("v")))
    edited = F.when(F.col("signature").rlike("181818|1c1c1c|282828") & F.col("match").isNull(), EDITED)
    mean = F.bround(F.aggregate("v", F.lit(0), lambda a, x: a + x) / F.size("v"), 1)
    return rows.select(
        "id", "error", "signature", "match", F.when(F.col("error").isNull(), F.col("kind").bitwiseAND(F.lit(15))).alias("table_id"), F.when(F.col("error").isNull(), F.when(F.col("size") == 64, "8-bit").otherwise("16-bit")).alias("precision"),
        F.array_min("v").alias("lo"), F.array_max("v").alias("hi"), F.when(F.col("v").isNotNull(), mean).alias("mean"), F.when(F.col("v").isNotNull(), F.size(F.array_distinct("v"))).alias("kinds"), F.when(F.col("v").isNotNull(), F.array_compact(F.array(verdict, edited))).alias("warnings"),
    )
