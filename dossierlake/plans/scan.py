"""The scan of a folder: from files to records, findings, flags, timelines, identifiers, revisions and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.config import Config
from dossierlake.functions import contacts, details, text_rules
from dossierlake.functions.scalars import header_state
from dossierlake.operators import classify, metadata, relations, reports, revisions, structure, timeline, xmp
from dossierlake.parse import facts
from dossierlake.sources import files as sources


@dataclass
class Scan:
    """What a scan found; all but files are read back from the folder it was written to."""

    files: DataFrame
    wide: DataFrame  # facts, a row a file
    indicators: DataFrame  # path, rule_order, key, count, details
    records: DataFrame  # path, name, status, error_type, error_message, is_revision, original_path, rev_idx, rev_offset, md5, sha256, length, modificationTime, is_identical, meta
    flags: DataFrame  # path, flag
    timeline: DataFrame
    ids: DataFrame  # path, kind, id
    relations: DataFrame  # path, related_path, rel_type
    revisions: DataFrame  # path, rev_idx, rev_offset, content
    changes: DataFrame  # path, rev_idx, additions, deletions, unified

    def report(self, notes: DataFrame | None = None) -> DataFrame:
        """The report's rows: files in order of path, each followed by its revisions."""
        r = self.records
        parents = r.where("not is_revision").select("path", F.col("path").alias("place"))
        numbers = relations.number_report(parents, r.where("is_revision").select("path", "original_path"))
        many = r.where("is_revision").groupBy(F.col("original_path").alias("path")).agg(F.count("*").alias("n"))
        said = self.indicators.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rule_order", details.summary(F.col("key"), F.col("details")).alias("s")))).alias("f"))
        notes = notes if notes is not None else r.select("path", F.lit("").alias("note")).limit(0)
        rows = relations.looked_up(numbers.join(r, "path").join(self.flags.select("path", "flag"), "path", "left").join(many, "path", "left").join(said, "path", "left"), (notes, "note"))
        when = F.date_format("modificationTime", "dd-MM-yyyy HH:mm:ss")
        cells = [F.col("row_id"), F.col("name"), F.coalesce("flag", F.lit("NO")), F.coalesce(F.col("n").cast("string"), F.lit("")), F.col("path"), F.coalesce("md5", F.lit("")), F.lit(""), F.coalesce(when, F.lit("")), F.coalesce("meta", F.lit("")), F.coalesce(F.array_join(F.col("f.s"), "; "), F.lit("")), F.col("note")]
        return rows.select(*[c.alias(n) for c, n in zip(cells, reports.COLUMNS)]).orderBy("ID")

    def summary(self) -> DataFrame:
        return classify.scan_summary(self.records, self.flags)


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def byte_rules(wide: DataFrame) -> DataFrame:
    """Rules over raw bytes: where the header stands, and long runs of zeros and blanks."""
    at = F.instr("head", "%PDF-") - 1
    state = header_state(F.col("head"))
    polyglot = wide.where(state.isNotNull()).select("path", F.lit(200).alias("rule_order"), F.lit("PolyglotFile").alias("key"), F.lit(1).cast("long").alias("count"), F.to_json(F.struct(state.alias("status"), at.alias("pdf_header_offset"), F.substring("head", 1, 8).alias("detected_prefix_format"))).alias("details"))
    kinds = F.array_compact(F.array(F.when(F.col("nul_runs") > 0, F.struct(F.lit("null").alias("type"), F.col("nul_runs").alias("n"))), F.when(F.col("blank_runs") > 0, F.struct(F.lit("space").alias("type"), F.col("blank_runs").alias("n")))))
    scrubbed = wide.where("nul_runs > 0 or blank_runs > 0").select("path", F.lit(201).alias("rule_order"), F.lit("StructuralScrubbing").alias("key"), F.size(kinds).cast("long").alias("count"), F.to_json(F.struct(F.size(kinds).alias("count"), kinds.alias("blocks"))).alias("details"))
    return polyglot.unionByName(scrubbed)


def date_rules(wide: DataFrame) -> DataFrame:
    """Dates of the information dictionary and the packet that differ, files made after they were changed, and gaps in the history."""
    found = metadata.timestamp_mismatch(wide.where("ok"), "path", "text")
    by = found.where("kind <> 'spoofed'").groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("kind", "seconds"))).alias("m"))
    mismatch = by.select("path", F.lit(202).alias("rule_order"), F.lit("TimestampMismatch").alias("key"), F.col("n").alias("count"), F.to_json(F.struct(F.col("n").alias("count"), F.col("m").alias("mismatches"))).alias("details"))
    spoofed = found.where("kind = 'spoofed'").select("path", F.lit(203).alias("rule_order"), F.lit("TimestampSpoofing").alias("key"), F.lit(1).cast("long").alias("count"), F.to_json(F.struct(F.concat(F.col("seconds").cast("string"), F.lit(" s")).alias("note"))).alias("details"))
    gaps = timeline.gaps(xmp.history_pairs(wide), "path", "place", "ts").groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "kind"))).alias("g"))
    history = gaps.select("path", F.lit(204).alias("rule_order"), F.lit("XMPHistoryGap").alias("key"), F.col("n").alias("count"), F.to_json(F.struct(F.col("n").alias("count"), F.col("g").alias("gaps"))).alias("details"))
    return mismatch.unionByName(spoofed).unionByName(history)


def findings(spark: SparkSession, wide: DataFrame, as_of: Column) -> DataFrame:
    """path, rule_order, key, count, details of all rules over parsed files, one row a key; where two rules give one key, the one with more
    to say counts."""
    rules = text_rules.text_rules(contacts.top_level_domains(spark), as_of)
    text = text_rules.as_objects(text_rules.indicators(wide.select("path", "text"), "path", "text", rules).where("key <> 'StructuralScrubbing'"))
    related = xmp.relationships(wide.select("path", xmp.packet(F.col("text")).alias("packet")))
    rows = text.unionByName(structure.structural(wide)).unionByName(byte_rules(wide)).unionByName(date_rules(wide)).unionByName(xmp.indicators(related))
    columns = ["rule_order", "count", "details"]
    best = rows.groupBy("path", "key").agg(F.min("rule_order").alias("first"), F.max_by(F.struct(*columns), F.coalesce(F.length("details"), F.lit(0))).alias("x"))
    return best.select("path", F.col("first").alias("rule_order"), "key", F.col("x.count").alias("count"), F.col("x.details").alias("details"))


def scan(spark: SparkSession, folder: str, out: str, config: Config = Config(), as_of: Column | None = None) -> Scan:
    """Scans all PDF files below a folder and writes what it finds as Parquet tables below out, which is not a folder of the evidence. Files
    above the size limit, empty and broken ones have records with an error; the others are scanned all the same."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    most = config.max_file_mb * 1_000_000

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    found = sources.pdf_files(spark, folder)
    ok = sources.readable(found, most)
    wide = kept(facts.facts(ok.select("path", "content").unionByName(sources.empty_files(found))), "facts")
    times = found.select("path", "modificationTime", "length")

    offsets = revisions.revision_offsets(ok.join(wide.where("ok").select("path"), "path", "left_semi"))
    states = kept(revisions.valid_revisions(ok, offsets), "revisions")
    named = states.withColumn("rev_path", F.concat(F.lit("Altered_files/"), F.substring(F.md5("path"), 1, 8), F.lit("_"), revisions.revision_name(F.col("path"), F.col("rev_idx"), F.col("rev_offset"))))
    wide_states = kept(facts.facts(named, "rev_path", "content"), "revision_facts")

    first = findings(spark, wide, as_of)
    counted = states.groupBy("path").agg(F.count("*").alias("n"))
    has = counted.select("path", F.lit(400).alias("rule_order"), F.lit("HasRevisions").alias("key"), F.col("n").alias("count"), F.to_json(F.struct(F.col("n").alias("count"))).alias("details"))
    first = kept(first.unionByName(has), "findings")
    identical = revisions.structurally_identical(named, wide, wide_states, config.visual_pages)
    marks = named.select(F.col("rev_path").alias("path"), "rev_idx", F.col("path").alias("original")).join(identical.withColumnRenamed("path", "original"), ["original", "rev_idx"], "left")
    of_states = marks.select("path", F.explode(F.array_compact(F.array(F.lit("Revision"), F.when(F.col("is_identical_structural"), F.lit("VisuallyIdentical"))))).alias("key"))
    of_states = of_states.select("path", F.lit(401).alias("rule_order"), "key", F.lit(1).cast("long").alias("count"), F.lit("{}").alias("details"))
    indicators = kept(first.unionByName(structure.archive_violations(first)).unionByName(of_states), "indicators")

    meta = kept(metadata.metadata_text(wide.where("ok")).unionByName(metadata.metadata_text(wide_states.where("ok"))), "metadata")
    lines = metadata.lines(meta)
    tools, dates, history = metadata.tools(lines), metadata.meta_dates(lines), metadata.history_events(lines)
    events = kept(timeline.timeline(times.join(wide.select("path"), "path", "left_semi"), lines, metadata.raw_dates(wide), dates, tools, history), "timeline")
    ids = kept(metadata.document_ids(wide.select("path", "text").join(meta, "path", "left"), "path", "text", "meta"), "ids")
    links = kept(relations.cross_reference(ids), "relations")

    text = lambda w: w.select("path", F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"))
    pairs = named.select("path", "rev_idx", "rev_path").join(text(wide_states).withColumnsRenamed({"path": "rev_path", "text": "before"}), "rev_path").join(text(wide).withColumnRenamed("text", "after"), "path")
    changes = kept(revisions.text_changes(pairs, "before", "after").select("path", "rev_idx", "additions", "deletions", "unified"), "changes")

    none = lambda kind: F.lit(None).cast(kind)
    base = wide.join(times.select("path", "modificationTime"), "path", "left").join(meta, "path", "left")
    status = F.when(F.col("ok"), "success").otherwise("error")
    originals = base.select("path", _name(F.col("path")).alias("name"), status.alias("status"), "error_type", "error_message", F.lit(False).alias("is_revision"), none("string").alias("original_path"), none("int").alias("rev_idx"), none("long").alias("rev_offset"), "md5", "sha256", "length", "modificationTime", none("boolean").alias("is_identical"), "meta")
    big = sources.too_large(found, most).join(times, "path").select("path", _name(F.col("path")).alias("name"), "status", "error_type", F.lit("the file is above the size limit").alias("error_message"), F.lit(False).alias("is_revision"), none("string").alias("original_path"), none("int").alias("rev_idx"), none("long").alias("rev_offset"), none("string").alias("md5"), none("string").alias("sha256"), "length", "modificationTime", none("boolean").alias("is_identical"), none("string").alias("meta"))
    own = named.select(F.col("rev_path"), F.col("path").alias("original_path"), "rev_idx", "rev_offset").join(wide_states.withColumnRenamed("path", "rev_path"), "rev_path").join(identical.withColumnRenamed("path", "original_path"), ["original_path", "rev_idx"], "left").join(meta.withColumnRenamed("path", "rev_path"), "rev_path", "left")
    states_ = own.select(F.col("rev_path").alias("path"), _name(F.col("rev_path")).alias("name"), status.alias("status"), "error_type", "error_message", F.lit(True).alias("is_revision"), "original_path", "rev_idx", "rev_offset", "md5", "sha256", "length", none("timestamp").alias("modificationTime"), F.col("is_identical_structural").alias("is_identical"), "meta")
    records = originals.unionByName(big).unionByName(states_)
    bad = F.lower("meta").contains("warning") & F.lower("meta").contains("invalid xref table")
    records = kept(records.where(~F.col("is_revision") | ~F.coalesce(bad, F.lit(False)) | F.lit(config.export_invalid_xref)), "records")

    flags = classify.flag(records.where("not is_revision"), indicators).select("path", "flag")
    flags = kept(flags.unionByName(records.where("is_revision").select("path", F.concat(F.lit("revision of "), _name(F.col("original_path"))).alias("flag"))), "flags")
    return Scan(found, wide, indicators, records, flags, events, ids, links, states, changes)


def last_of_each(records: DataFrame, order: str) -> DataFrame:
    """Records whose path comes several times: the last one by order stays."""
    return records.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")
