"""Orders and gaps of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deltas(events: DataFrame, path: str, ts: str, seq: str) -> DataFrame:
    """events with delta_us (since the event before; null for the first) and new_day (its date differs from that one's)."""
    w = Window.partitionBy(path).orderBy(ts, seq)
    before = F.lag(ts).over(w)
    return events.withColumn("delta_us", F.timestamp_diff("MICROSECOND", before, F.col(ts))).withColumn("new_day", F.coalesce(F.to_date(before) != F.to_date(ts), F.lit(True)))


def gaps(events: DataFrame, path: str, place: str, ts: str, years: int = 2) -> DataFrame:
    """path, place, kind of events that stand before the event ahead of them in place order (reverse) or long after it (gap)."""
    w = Window.partitionBy(path).orderBy(place)
    seconds = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    kind = F.when(seconds < 0, "reverse").when(seconds > years * 31_536_000, "gap")
    return events.select(F.col(path).alias("path"), F.col(place).alias("place"), kind.alias("kind")).where("kind is not null")


def key_dates(events: DataFrame, path: str, ts: str, kind: str, seq: str) -> DataFrame:
    """path, kind, first_ts, last_ts, n by kind of event."""
    return events.groupBy(F.col(path).alias("path"), F.col(kind).alias("kind")).agg(F.min_by(ts, F.struct(ts, seq)).alias("first_ts"), F.max_by(ts, F.struct(ts, seq)).alias("last_ts"), F.count("*").alias("n"))


def version_changes(versions: DataFrame, path: str, place: str, value: str) -> DataFrame:
    """path, place, changed: whether a value differs from that of the version before (false for the first and after a null)."""
    before = F.lag(value).over(Window.partitionBy(path).orderBy(place))
    return versions.select(F.col(path).alias("path"), F.col(place).alias("place"), (F.coalesce(before != F.col(value), F.lit(False))).alias("changed"))


def tool_reason(tools: DataFrame) -> DataFrame:
    """path, create_tool, modify_tool, reason (producer or software) of files whose tools differ. Both engines are the one toolkit that a
    file names, so an engine never changes."""
    rows = tools.where("create_tool <> '' and modify_tool <> '' and trim(create_tool) <> trim(modify_tool)")
    return rows.select("path", "create_tool", "modify_tool", F.when(F.coalesce("producer_pdf", "producer_xmp").isNotNull(), "producer").otherwise("software").alias("reason"))


def timeline(files: DataFrame, meta_lines: DataFrame, raw_dates: DataFrame, dates: DataFrame, tools: DataFrame, history: DataFrame) -> DataFrame:
    """path, is_aware, ts, source, description, seq: what is known of when, in order of time, aware and naive events apart.

    files: path, modificationTime. The sources: file system, history blocks, metadata dates, the toolkit (at the creation, else the first
    date, else the file's time), raw dates, a change of tools (at the last modification, else the last naive event, else the last one).
    Of equal times the source named first comes first.
    """
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    event = lambda df, rank, source, aware, ts, said, k: df.select("path", F.lit(rank).alias("rank"), F.lit(source).alias("source"), aware.alias("is_aware"), ts.cast("timestamp").alias("ts"), said.alias("description"), k.cast("long").alias("k"))
    no, zero = F.lit(False), F.lit(0)
    system = event(files, 0, "filesystem", no, F.col("modificationTime"), say("File System  - Modified: ", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")), zero)
    parts = F.concat_ws(" | ", say("Action: ", F.coalesce("action", F.lit("N/A"))), F.when(F.col("agent").isNotNull(), say("Agent: ", F.col("agent"))), F.when(F.col("changed").isNotNull(), say("Changed: ", F.col("changed"))))
    past = event(history, 1, "history", F.col("is_aware"), F.col("ts"), say("XMP History   - ", parts), F.col("line_no") * 1000 + F.col("k"))
    tag = F.regexp_replace(F.lower("tag"), " ", "")
    made = tag.isin("createdate", "creationdate")
    label = F.when(made, "Created").when(tag == "modifydate", "Modified").when(tag == "metadatadate", "Metadata").otherwise(tag)
    told = dates.join(tools.select("path", "create_tool", "modify_tool"), "path", "left")
    tool = F.coalesce(F.when(made, F.col("create_tool")).otherwise(F.col("modify_tool")), F.lit(""))
    meta = event(told, 2, "metadata", F.col("is_aware"), F.col("ts"), say("ExifTool (", F.col("group"), ") - ", label, ": ", F.col("text"), F.when(tool != "", say(" | Tool: ", tool)).otherwise("")), zero)
    first = dates.groupBy("path").agg(F.min(F.when(made, F.struct("ts", "is_aware"))).alias("made"), F.min(F.struct("ts", "is_aware")).alias("any"))
    anchor = tools.where("xmptoolkit is not null").join(first, "path", "left").join(files.select("path", "modificationTime"), "path", "left").withColumn("at", F.coalesce("made", "any", F.struct(F.col("modificationTime").alias("ts"), F.lit(False).alias("is_aware"))))
    engine = event(anchor, 3, "engine", F.col("at.is_aware"), F.col("at.ts"), say("XMP Engine: ", F.col("xmptoolkit")), zero)
    raw = event(raw_dates, 4, "raw", no, F.col("ts"), say("Raw PDF    - ", F.col("key"), ": ", F.date_format("ts", "yyyyMMddHHmmss")), zero)
    events = system.unionByName(past).unionByName(meta).unionByName(engine).unionByName(raw)
    last = dates.where(tag.isin("modifydate", "metadatadate")).groupBy("path").agg(F.max(F.struct("ts", "is_aware")).alias("last"))
    fallback = events.groupBy("path").agg(F.max(F.when(~F.col("is_aware"), F.struct("ts", "is_aware"))).alias("naive"), F.max(F.struct("ts", "is_aware")).alias("every"))
    changed = tool_reason(tools).join(last, "path", "left").join(fallback, "path", "left").withColumn("at", F.coalesce("last", "naive", "every"))
    events = events.unionByName(event(changed, 5, "tools", F.col("at.is_aware"), F.col("at.ts"), say("Tool changed: ", F.col("create_tool"), " → ", F.col("modify_tool")), zero))
    place = Window.partitionBy("path", "is_aware").orderBy("ts", "rank", "k", "description")
    return events.withColumn("seq", F.row_number().over(place)).select("path", "is_aware", "ts", "source", "description", "seq")


def shown_dates(events: DataFrame) -> DataFrame:
    """path, created, modified, metadata, tool as shown (dd-MM-yyyy HH:mm:ss): of each label the first event, or the last one of the metadata
    text if there is any; the first tool of at most 50 letters."""
    said, meta = F.col("description"), F.col("source") == "metadata"
    order = F.struct((~F.col("is_aware")).alias("naive"), "seq")
    at = F.date_format("ts", "dd-MM-yyyy HH:mm:ss")
    pick = lambda label: F.coalesce(F.max_by(F.when(meta & said.contains(label), at), F.when(meta & said.contains(label), order)), F.min_by(F.when(said.contains(label), at), F.when(said.contains(label), order)))
    tool = F.regexp_extract(said, r"Tool: (.{1,50})$", 1)
    return events.groupBy("path").agg(pick("Created").alias("created"), pick("Modified").alias("modified"), pick("Metadata").alias("metadata"), F.min_by(F.when(tool != "", tool), F.when(tool != "", order)).alias("tool"))
