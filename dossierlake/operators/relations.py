"""Links between files by the identifiers they own and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cross_reference(ids: DataFrame) -> DataFrame:
    """path, related_path, rel_type from (path, kind own|ref, id).

    A file that names an id is derived_from each file that owns it; the owner is its parent_of. For an ordered pair of files one row stays:
    derived_from before parent_of. Ids of a file that it both owns and names do not link it to itself. Null ids link nothing.
    """
    own = ids.where("kind = 'own' and id is not null").select(F.col("path").alias("owner"), "id").distinct()
    ref = ids.where("kind = 'ref' and id is not null").select("path", "id").distinct()
    down = ref.join(own, "id").where("path <> owner").select("path", F.col("owner").alias("related_path")).distinct()
    both = down.withColumn("rel_type", F.lit("derived_from")).unionByName(down.select(F.col("related_path").alias("path"), F.col("path").alias("related_path"), F.lit("parent_of").alias("rel_type")))
    return both.groupBy("path", "related_path").agg(F.min("rel_type").alias("rel_type"))


def missing_on_the_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks: orphaned objects one way, dangling references the other."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def integrity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, verdict (verified, mismatched, missing, unexpected) from (path, hash) as stored and as found."""
    e, a = expected.select("path", F.col("hash").alias("stored")), actual.select("path", F.col("hash").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("stored").isNull(), "unexpected").when(F.col("stored") == F.col("found"), "verified").otherwise("mismatched")
    return e.join(a, "path", "full_outer").select("path", state.alias("verdict"))


def duplicates(items: DataFrame, key: str, content: str) -> DataFrame:
    """content_hash, n, first: contents that several keys hold."""
    return items.groupBy(F.md5(F.col(content).cast("binary")).alias("content_hash")).agg(F.count_distinct(key).alias("n"), F.min(key).alias("first")).where("n > 1")


def dominant(items: DataFrame, group: str, value: str, order: str, share: float, least: int) -> DataFrame:
    """Rows' groups with their dominant value (most rows, ties to the one seen first in `order`) if it has at least that share of at least
    `least` rows: group, total, dominant, deviants."""
    by = items.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = by.groupBy(group).agg(F.sum("n").alias("total"), F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias("dominant"), F.max("n").alias("most"))
    return top.where((F.col("total") >= least) & (F.col("most") >= F.col("total") * share)).select(group, "total", "dominant", (F.col("total") - F.col("most")).alias("deviants"))


def number_report(parents: DataFrame, children: DataFrame) -> DataFrame:
    """row_id, path, parent_id: parents (path, place) in order, each followed by its children (path, original_path) by path; children without
    a parent come last. Numbers run from 1. Rows are sorted by ranges, and a row's number is its place in its range after the rows of the
    ranges before, so no task sees all rows."""
    p = parents.select("path", F.lit(None).cast("string").alias("original_path"), "place", F.lit(0).alias("is_child"))
    c = children.join(parents.select(F.col("path").alias("original_path"), "place"), "original_path", "left").select("path", "original_path", "place", F.lit(1).alias("is_child"))
    order = [F.col("place").asc_nulls_last(), F.col("is_child").asc(), F.col("path").asc()]
    rows = p.unionByName(c).repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("first"))  # a row a range
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = rows.join(F.broadcast(before), "part").withColumn("row_id", (F.col("before") + F.col("k") - F.col("first") + 1).cast("long"))
    heads = rows.where("is_child = 0").select(F.col("path").alias("original_path"), F.col("row_id").alias("parent_id"))
    return rows.join(heads, "original_path", "left").select("row_id", "path", "parent_id")


def found_locally(related: DataFrame, ids: DataFrame) -> DataFrame:
    """path of files one of whose related ids (path, id) some file owns. Ids are compared as they are, so one with a prefix meets none."""
    return related.select("path", "id").distinct().join(ids.where("kind = 'own'").select("id").distinct(), "id", "left_semi").select("path").distinct()


def remapped(rows: DataFrame, paths: DataFrame, *columns: str) -> DataFrame:
    """rows with the paths of columns replaced by (old, new); those without a new one stay."""
    for c in columns:
        rows = rows.join(paths.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return rows


def looked_up(files: DataFrame, *sides: tuple[DataFrame, str]) -> DataFrame:
    """files with a text of each side (path, that column); empty where a side has none."""
    for side, name in sides:
        files = files.join(side.select("path", name), "path", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return files


def sorted_by(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column: numbers by value, all others as text."""
    c = F.col(column) if column == "id" else F.col(column).cast("string")
    c = c.cast("long") if column == "id" else c
    return rows.orderBy(c.desc() if descending else c.asc())
