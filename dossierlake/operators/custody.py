"""Hash-chained custody logs: event kinds, building, appending, verifying, reading and showing."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Label whose SHA-256 begins each chain.
GENESIS = "custody chain"
# Kinds of events and the fields of an entry, of which entry_hash is no part of what is hashed.
INGEST, EXPORT, VERIFY, CASE_OPEN, CASE_SAVE, REPORT_SIGNED = "INGEST", "EXPORT", "VERIFY", "CASE_OPEN", "CASE_SAVE", "REPORT_SIGNED"
FIELDS = ["timestamp_utc", "action", "item_path", "file_hash", "details", "case_path"]
# What a verification says.
NO_LOG, EMPTY, WHOLE, BAD_JSON, TAMPERED = "No audit log file found.", "Log file is empty.", "Integrity verified. Hash chain intact.", "Tampering or corruption at line {} (invalid JSON).", "Tampering detected at line {}. Log integrity compromised."


def genesis(label: str = GENESIS) -> Column:
    return F.sha2(F.lit(label), 256)


def chain(events: DataFrame, log: str, order: list[str], entry: str, label: str = GENESIS) -> DataFrame:
    """log, n_entries, head: the last hash of each log's chain, sha256(previous hash + entry text), entries in order. A log is one chain, so
    its entries are read one after the other in one task, as a stream; logs run apart."""
    return chained(events, log, order, entry, label).groupBy("log").agg(F.count("*").alias("n_entries"), F.max_by("entry_hash", "line_no").alias("head"))


def chained(events: DataFrame, log: str, order: list[str], entry: str, label: str = GENESIS) -> DataFrame:
    """log, line_no (from 1), entry, entry_hash: the logs themselves. Entries are dealt out by log, sorted, and hashed as they stream by."""
    import hashlib

    start = hashlib.sha256(label.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head, n = object(), start, 0
        for b in batches:
            numbers, hashes = [], []
            for name, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != own:
                    own, head, n = name, start, 0
                n, head = n + 1, hashlib.sha256((head + (said or "")).encode()).hexdigest()
                numbers.append(n)
                hashes.append(head)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), b.column(1), pa.array(hashes, pa.string())], ["log", "line_no", "entry", "entry_hash"])

    rows = events.select(F.col(log).alias("log"), F.col(entry).alias("entry"), *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)])
    by = [F.col(f"_order{k}") for k in range(len(order))]
    dealt = rows.repartition("log").sortWithinPartitions("log", *by, "entry").select("log", "entry")
    kind = events.schema[log].dataType.simpleString()
    return dealt.mapInArrow(run, f"log {kind}, line_no long, entry string, entry_hash string")


def verify(entries: DataFrame, label: str = GENESIS) -> DataFrame:
    """log, n_entries, first_bad_line (null if the chain holds) from (log, line_no, entry, entry_hash). Each line is checked against the stored
    hash before it, so lines are verified in parallel. A line without a hash is not checked, and the one after it begins a new chain; an
    entry that is null (no JSON) is bad."""
    before = F.lag("entry_hash").over(Window.partitionBy("log").orderBy("line_no"))
    wrong = F.sha2(F.concat(F.coalesce(before, genesis(label)), F.col("entry")), 256) != F.col("entry_hash")
    bad = F.col("entry").isNull() | (F.col("entry_hash").isNotNull() & F.coalesce(wrong, F.lit(True)))
    return entries.withColumn("bad", bad).groupBy("log").agg(F.count("*").alias("n_entries"), F.min(F.when(F.col("bad"), F.col("line_no"))).cast("long").alias("first_bad_line"))


def canonical(entry: dict[str, Any]) -> str:
    """What is hashed of an entry: sorted keys without its own hash, the separators of the log format, text as it is."""
    return json.dumps({k: v for k, v in entry.items() if k != "entry_hash"}, sort_keys=True, ensure_ascii=False)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """log (the file), line_no, line, entry (its canonical form; null if the line is no JSON object), entry_hash of JSON-lines logs; blank
    lines are passed over and not counted. Lines are read as rows and numbered by where they stand: parts of a file in order, lines of a
    part in order."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value").where(F.trim("value") != "")

    @F.pandas_udf("struct<entry:string,entry_hash:string>")
    def read(lines: pd.Series) -> pd.DataFrame:
        out = []
        for line in lines:
            try:
                x = json.loads(line)
                out.append((canonical(x), x.get("entry_hash")) if isinstance(x, dict) else (None, None))
            except json.JSONDecodeError:
                out.append((None, None))
        return pd.DataFrame(out, columns=["entry", "entry_hash"])

    place = Window.partitionBy("log").orderBy("block", "k")
    return rows.withColumn("x", read("value")).select("log", F.row_number().over(place).alias("line_no"), F.col("value").alias("line"), "x.entry", "x.entry_hash")


def verdict(spark: SparkSession, path: str, label: str = GENESIS) -> tuple[int, bool, int | None, str]:
    """(entries before the first bad line, whether the log holds, that line, what to say) of one log file."""
    if not os.path.exists(path):
        return 0, True, None, NO_LOG
    log = read_log(spark, path)
    found = verify(log, label).first()
    if found is None:
        return 0, True, None, EMPTY
    line = found["first_bad_line"]
    if line is None:
        return found["n_entries"], True, None, WHOLE
    json_ = log.where(F.col("line_no") == line).first()["entry"] is not None
    return line - 1, False, line, (TAMPERED if json_ else BAD_JSON).format(line)


# Events


def entry(action: str, item_path: str | None = None, file_hash: str | None = None, details: dict[str, Any] | None = None, case_path: str | None = None, at: datetime | None = None) -> dict[str, Any]:
    return dict(zip(FIELDS, ((at or datetime.now(UTC)).isoformat(), action, item_path, file_hash, details or {}, case_path)))


def ingested(path: str, file_hash: str, case_path: str | None = None) -> dict[str, Any]:
    return entry(INGEST, path, file_hash, {"description": "File ingested for forensic analysis"}, case_path)


def exported(path: str, kind: str, report_hash: str | None = None, case_path: str | None = None) -> dict[str, Any]:
    return entry(EXPORT, path, report_hash, {"export_format": kind} | ({"report_sha256": report_hash} if report_hash else {}), case_path)


def verified(path: str, expected: str, actual: str, passed: bool, case_path: str | None = None) -> dict[str, Any]:
    return entry(VERIFY, path, actual, {"expected_hash": expected, "passed": passed}, case_path)


def signed(path: str, report_hash: str, signature: dict[str, Any] | None = None, case_path: str | None = None) -> dict[str, Any]:
    return entry(REPORT_SIGNED, path, report_hash, {"report_sha256": report_hash} | ({"signature": signature} if signature else {}), case_path)


def log_path(case_root: str, case_file: str | None = None) -> str:
    """Beside a case file, else in the case's folder."""
    if case_file and case_file.lower().endswith(".prc"):
        return case_file[:-4] + ".custody.log"
    return os.path.join(case_root, "custody.log")


def append(path: str, entries: list[dict[str, Any]], label: str = GENESIS) -> None:
    """Adds entries to a log file, each chained to the line before. Only the last line is read, whatever the log's length; a log that ends
    in a line without a hash, or in none, begins a new chain."""
    import hashlib

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    head = _last_hash(path) or hashlib.sha256(label.encode()).hexdigest()
    with open(path, "a", encoding="utf-8") as f:
        for e in entries:
            head = hashlib.sha256((head + canonical(e)).encode()).hexdigest()
            f.write(json.dumps(e | {"entry_hash": head}, ensure_ascii=False) + "\n")


def _last_hash(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        at, tail = f.tell(), b""
        while at and len(tail.strip().split(b"\n")) < 2:
            step = min(at, 1 << 16)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
    lines = tail.strip().split(b"\n")
    try:
        return json.loads(lines[-1]).get("entry_hash") if lines[-1] else None
    except (json.JSONDecodeError, AttributeError):
        return None


def shown(log: DataFrame) -> DataFrame:
    """log, line_no, block: entries as text blocks."""
    field = lambda name: F.get_json_object("entry", f"$.{name}")
    line = lambda label, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(label), c))
    details = F.from_json(field("details"), "map<string,string>")
    more = F.array_join(F.transform(F.map_entries(details), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n")
    block = F.concat_ws("\n", F.concat(F.lit("--- Entry "), F.col("line_no").cast("string"), F.lit(" ---")), F.concat(F.lit("  Time (UTC): "), F.coalesce(field("timestamp_utc"), F.lit(""))), F.concat(F.lit("  Action:     "), F.coalesce(field("action"), F.lit(""))), line("  Item:       ", field("item_path")), line("  Hash:       ", field("file_hash")), F.nullif(more, F.lit("")), line("  Case:       ", field("case_path")))
    return log.select("log", "line_no", block.alias("block"))
