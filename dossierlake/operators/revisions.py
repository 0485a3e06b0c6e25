"""Earlier revisions inside a file, and what changed between two texts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARK = "%%EOF"


def revision_offsets(files: DataFrame, path_col: str = "path", content_col: str = "content", least: int = 500, tail: int = 100) -> DataFrame:
    """path, rev_idx (from 1), rev_offset: end marks that close an earlier state of the file. The last mark is left out if it stands within the
    last `tail` bytes, as it closes the file itself, and so are marks before byte `least`."""

    @F.pandas_udf("array<long>")
    def marks(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [m.start() for m in re.finditer(MARK.encode(), c or b"")])

    rows = files.select(F.col(path_col).alias("path"), F.octet_length(F.col(content_col)).alias("n"), marks(F.col(content_col).cast("binary")).alias("at")).where(F.size("at") > 0)
    rows = rows.withColumn("at", F.when(F.try_element_at("at", F.lit(-1)) > F.col("n") - tail, F.slice("at", F.lit(1), F.size("at") - 1)).otherwise(F.col("at")))
    kept = rows.select("path", F.filter("at", lambda x: x >= least).alias("at"))
    return kept.select("path", F.posexplode("at").alias("k", "rev_offset")).select("path", (F.col("k") + 1).alias("rev_idx"), F.col("rev_offset").cast("long").alias("rev_offset"))


def valid_revisions(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """path (of the file), rev_idx (anew from 1), rev_offset, content of the states that open with at least one page."""
    from dossierlake.parse.facts import page_count

    @F.pandas_udf("int")
    def pages(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: page_count(bytes(c) if c is not None else None))

    rows = revision_bytes(files, offsets).join(offsets, ["path", "rev_idx"]).where(pages("content") > 0)
    return rows.withColumn("rev_idx", F.row_number().over(Window.partitionBy("path").orderBy("rev_offset"))).select("path", "rev_idx", "rev_offset", "content")


def revision_name(path: Column, rev_idx: Column, rev_offset: Column) -> Column:
    """The file name of a state: the file's own without its ending, the state's number and the place of its mark."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("_rev"), rev_idx.cast("string"), F.lit("_@"), rev_offset.cast("string"), F.lit(".pdf"))


def write_revisions(revisions: DataFrame, folder: str) -> None:
    """Each state as a file of its own below folder/Altered_files, written by the tasks that hold them. The folder has to be one that they
    share; files of the evidence stay as they are. Names that clash, from folders with files of one name, get the hash of their path in front."""
    import os

    target = os.path.join(folder, "Altered_files")
    os.makedirs(target, exist_ok=True)
    name = F.concat(F.substring(F.md5("path"), 1, 8), F.lit("_"), revision_name(F.col("path"), F.col("rev_idx"), F.col("rev_offset")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for k in range(b.num_rows):
                place = os.path.join(target, b.column(0)[k].as_py())
                with open(f"{place}.part", "wb") as f:
                    f.write(b.column(1)[k].as_py())
                os.replace(f"{place}.part", place)  # a task that runs again leaves the same file
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    revisions.select(name.alias("name"), "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def structurally_identical(revisions: DataFrame, wide_files: DataFrame, wide_revisions: DataFrame, most: int = 15) -> DataFrame:
    """path, rev_idx, is_identical_structural: whether a state's first pages equal the file's in boxes, rotation, decoded content and
    resources. It stands in for comparing pictures of the pages, for which there is no renderer here."""
    look = lambda wide, name: wide.select("path", F.transform(F.slice("pages", 1, most), lambda p: F.struct(p["mediabox"], p["rotation"], p["digest"])).alias(name))
    named = wide_revisions.select(F.col("path").alias("rev_path"), *[c for c in wide_revisions.columns if c != "path"]).withColumnRenamed("rev_path", "path")
    rows = revisions.select("path", "rev_idx", "rev_path").join(look(named, "then").withColumnRenamed("path", "rev_path"), "rev_path").join(look(wide_files, "now"), "path")
    most_of = F.least(F.size("then"), F.size("now"))
    return rows.select("path", "rev_idx", (F.slice("then", F.lit(1), most_of) == F.slice("now", F.lit(1), most_of)).alias("is_identical_structural"))


def revision_bytes(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """path, rev_idx, content: the file up to and with each mark."""
    return files.select("path", "content").join(offsets, "path").select("path", "rev_idx", F.col("content").substr(F.lit(1), (F.col("rev_offset") + len(MARK)).cast("int")).alias("content"))


_CHANGES = "struct<additions:array<struct<line_no:int,text:string>>,deletions:array<struct<line_no:int,text:string>>,unified:array<string>>"


def _changes(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    out = []
    for old, new in zip(before, after):
        a, b = (old or "").splitlines(), (new or "").splitlines()
        gone, come = [], []
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if tag != "equal":
                gone += [{"line_no": k + 1, "text": a[k]} for k in range(i1, i2)]
                come += [{"line_no": k + 1, "text": b[k]} for k in range(j1, j2)]
        # The two labels of a diff.
        lines = difflib.unified_diff((old or "").splitlines(True), (new or "").splitlines(True), "Previous Version", "Final Version", lineterm="")
        out.append((come, gone, list(lines)))
    return pd.DataFrame(out, columns=["additions", "deletions", "unified"])


def text_changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """pairs with additions, deletions (line numbers from 1) and unified (a unified diff with three lines of context). Nulls are empty texts."""
    changes = F.pandas_udf(_changes, _CHANGES)
    return pairs.withColumn("_c", changes(before, after)).select(*pairs.columns, "_c.additions", "_c.deletions", "_c.unified")
