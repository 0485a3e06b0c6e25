"""Risk flags of files and summaries of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.text_rules import HIGH_RISK


def flag(files: DataFrame, indicators: DataFrame) -> DataFrame:
    """path, flag, n_indicators for each file of files (path): YES with an indicator of high risk, Possible with any, else NO."""
    by = indicators.groupBy("path").agg(F.bool_or(F.col("key").isin(HIGH_RISK)).alias("high"), F.count("*").alias("n"))
    out = files.select("path").join(by, "path", "left")
    return out.select("path", F.when(F.col("high"), "YES").when(F.col("n") > 0, "Possible").otherwise("NO").alias("flag"), F.coalesce("n", F.lit(0)).cast("long").alias("n_indicators"))


def summary(flags: DataFrame) -> DataFrame:
    """originals, yes, possible, clean from (path, flag)."""
    return flags.agg(F.count("*").alias("originals"), F.count_if(F.col("flag") == "YES").alias("yes"), F.count_if(F.col("flag") == "Possible").alias("possible"), F.count_if(F.col("flag") == "NO").alias("clean"))


def scan_summary(records: DataFrame, flags: DataFrame) -> DataFrame:
    """originals, yes, possible, errors, total_altered, revisions, clean from records (path, status, is_revision) and (path, flag). Files with
    errors count as originals."""
    rows = records.join(flags.select("path", "flag"), "path", "left")
    own = ~F.col("is_revision")
    out = rows.agg(
        F.count_if(own).alias("originals"), F.count_if(own & (F.col("flag") == "YES") & (F.col("status") == "success")).alias("yes"), F.count_if(own & (F.col("flag") == "Possible") & (F.col("status") == "success")).alias("possible"),
        F.count_if(own & (F.col("status") == "error")).alias("errors"), F.count_if(F.col("is_revision")).alias("revisions"),
    )
    return out.withColumn("total_altered", F.col("yes") + F.col("possible")).withColumn("clean", F.col("originals") - F.col("yes") - F.col("possible") - F.col("errors"))


def free_text(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows one of whose columns holds the term, whatever its case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(term.lower())))


def tool_change(created: list[Column], modified: list[Column]) -> Column:
    """Reason why the modifying tool differs from the creating one, from candidates in order of rank; null if it does not."""
    first = lambda cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    a, b = first(created), F.coalesce(first(modified), first(created))
    return F.when(F.lower(a) != F.lower(b), F.concat_ws(" > ", a, b))
