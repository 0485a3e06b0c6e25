"""Registry of the library's own queries over the driver tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import contacts, scalars, text_rules
from dossierlake.operators import classify, custody, relations, timeline
from dossierlake.plans import findings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256 FROM documents")
def file_inventory(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id", _long(F.octet_length(text)).alias("n_bytes"), F.md5(text.cast("binary")).alias("md5"), F.sha2(text.cast("binary"), 256).alias("sha256"))


@query("SELECT CASE WHEN n_chars > 10000 THEN 'file_too_large' ELSE 'success' END AS status, count(*) AS n FROM documents GROUP BY 1")
def size_guard(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.when(F.col("n_chars") > 10000, "file_too_large").otherwise("success").alias("status")).agg(F.count("*").alias("n"))


_GENERIC = ", ".join(f"'{x}'" for x in contacts.GENERIC_TLDS)
#: DuckDB has no back-references and no ISO list: repeats are found by their alternatives, country codes are any two letters.
_REPEATS = "|".join(f"{c}{{4}}" for c in [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%-", "[+]", "[.]"])
_EMAILS = rf"""
    WITH hits AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')) AS email FROM documents WHERE text LIKE '%@%'),
    parts AS (SELECT *, split_part(email, '@', 1) AS u, split_part(email, '@', 2) AS d FROM hits),
    emails AS (SELECT doc_id, email FROM parts
        WHERE length(email) >= 7 AND NOT regexp_matches(u, '^-|-$') AND NOT regexp_matches(regexp_replace(d, '\.[^.]*$', ''), '^-|-$')
        AND (lower(regexp_extract(d, '[^.]*$')) IN ({_GENERIC}) OR length(regexp_extract(d, '[^.]*$')) = 2)
        AND length(regexp_replace(email, '[^0-9]', '', 'g')) <= length(email) * 0.4 AND length(regexp_replace(lower(email), '[^aeiouy]', '', 'g')) > 0
        AND length(regexp_replace(lower(email), '[^bcdfghjklmnpqrstvwxz]', '', 'g')) / length(email) <= 0.8
        AND NOT (length(regexp_replace(d, '[^A-Z]', '', 'g')) >= 2 AND length(regexp_replace(d, '[^a-z]', '', 'g')) >= 2) AND NOT regexp_matches(email, '{_REPEATS}'))
"""  # fmt: skip


def _emails(spark, sf_dir):
    tlds = contacts.top_level_domains(spark)
    return _t(spark, sf_dir, "documents").where(F.contains(F.col("text"), F.lit("@"))).select("doc_id", contacts.emails(F.col("text"), tlds).alias("emails"))


@query(_EMAILS + "SELECT doc_id, email FROM emails")
def emails(spark, sf_dir):
    return _emails(spark, sf_dir).select("doc_id", F.explode("emails").alias("email"))


@query(_EMAILS + "SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(email))[1:20], ' ') AS first_emails FROM emails GROUP BY doc_id")
def email_summary(spark, sf_dir):
    return _emails(spark, sf_dir).where(F.size("emails") > 0).select("doc_id", _long(F.size("emails")).alias("n"), F.array_join(F.slice("emails", 1, 20), " ").alias("first_emails"))


_LINKS = r"""
    WITH raw AS (SELECT DISTINCT page_id, rtrim(u, '.,;:?!)]') AS link FROM (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '(?i)https?://[^\s<>"{}|\\^`\[\]]+')) AS u FROM pages)),
    links AS (SELECT *, regexp_extract(link, '://([^/]*)', 1) AS host FROM raw WHERE link <> '' AND lower(regexp_extract(link, '://([^/]*)', 1)) NOT IN ('ns.adobe.com', 'www.w3.org', 'purl.org', 'xml.org', 'schemas.microsoft.com', 'iptc.org'))
"""


def _links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", contacts.links(F.concat_ws(" ", "url", "html")).alias("links"))


@query(_LINKS + "SELECT page_id, count(*) AS n, count(DISTINCT host) AS unique_domains FROM links GROUP BY page_id")
def urls(spark, sf_dir):
    hosts = F.array_distinct(F.transform("links", contacts.link_host))
    return _links(spark, sf_dir).where(F.size("links") > 0).select("page_id", _long(F.size("links")).alias("n"), _long(F.size(hosts)).alias("unique_domains"))


@query(_LINKS + "SELECT host, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM links GROUP BY host")
def url_domains(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", F.explode("links").alias("link")).groupBy(contacts.link_host(F.col("link")).alias("host")).agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


@query(r"""
    WITH made AS (SELECT n_nationkey, '\\srv' || lower(n_name) || '\' || lower(r_name) || '\f' AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
    text AS (SELECT n_nationkey, 'see ' || path || ' and \\ab\cd' AS t FROM made),
    hits AS (SELECT DISTINCT n_nationkey, unnest(regexp_extract_all(t, '\\\\[a-zA-Z0-9_\-.]+\\[a-zA-Z0-9_\-.$\\]+')) AS path FROM text)
    SELECT n_nationkey, path FROM hits WHERE length(split_part(ltrim(path, '\'), '\', 1)) >= 3 AND length(split_part(ltrim(path, '\'), '\', 2)) >= 3
        AND regexp_matches(lower(path), '[aeiouy]') AND length(regexp_replace(path, '[^0-9]', '', 'g')) <= length(path) * 0.4""")
def unc_paths(spark, sf_dir):
    both = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("see \\\\srv"), F.lower("n_name"), F.lit("\\"), F.lower("r_name"), F.lit("\\f and \\\\ab\\cd"))
    return both.select("n_nationkey", F.explode(contacts.unc_paths(text)).alias("path"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS code FROM pages")
def js_scripts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("code"))


@query("SELECT page_id, len(regexp_extract_all(html, '<script')) AS n_scripts, html LIKE '%onclick=%' OR html LIKE '%onload=%' AS auto_run FROM pages")
def js_flags(spark, sf_dir):
    html = F.col("html")
    return _t(spark, sf_dir, "pages").select("page_id", scalars.count_of(html, "<script").alias("n_scripts"), (F.contains(html, F.lit("onclick=")) | F.contains(html, F.lit("onload="))).alias("auto_run"))


@query("""SELECT c_nationkey AS file_id, count(DISTINCT c_mktsegment) AS n, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS creators
    FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def multiple_creators(spark, sf_dir):
    # The values are read back from made scan text, as the rule reads them from a file.
    made = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("file_id")).agg(F.concat_ws(" ", F.collect_set(F.concat(F.lit("/Creator ("), "c_mktsegment", F.lit(")")))).alias("t"))
    values = F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?id)/Creator\s*\((.*?)\)"), F.lit(1))))
    return made.withColumn("v", values).where(F.size("v") > 1).select("file_id", _long(F.size("v")).alias("n"), F.array_join("v", ",").alias("creators"))


@query("SELECT p_type AS font, count(DISTINCT p_brand) AS n_subsets, min(p_brand) AS first_subset FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def font_subsets(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("font")).agg(F.count_distinct("p_brand").alias("n_subsets"), F.min("p_brand").alias("first_subset")).where("n_subsets > 1")


_REVISION_TEXT = "string_agg('xref startxref ' || l_linenumber || CASE WHEN l_linenumber > 1 THEN ' /Prev ' || l_partkey ELSE '' END || ' ' || l_linenumber || ' 0 obj' || CASE WHEN l_returnflag = 'R' THEN '' ELSE ' endobj' END, ' ')"


def _revision_text(spark, sf_dir):
    piece = F.concat(
        F.lit("xref startxref "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit(" /Prev "), F.col("l_partkey").cast("string"))).otherwise(""),
        F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" 0 obj"), F.when(F.col("l_returnflag") == "R", "").otherwise(" endobj"),
    )
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.concat_ws(" ", F.collect_list(piece)).alias("t"))


@query(rf"""WITH f AS (SELECT l_orderkey AS file_id, {_REVISION_TEXT} AS t FROM lineitem GROUP BY 1)
    SELECT file_id, len(regexp_extract_all(t, 'startxref')) AS n_startxref, len(regexp_extract_all(t, '/Prev\s+\d+')) AS n_prev FROM f WHERE len(regexp_extract_all(t, 'startxref')) > 1""")
def incremental_updates(spark, sf_dir):
    t = F.col("t")
    return _revision_text(spark, sf_dir).select("file_id", scalars.count_of(t, "startxref").alias("n_startxref"), scalars.count_of(t, r"/Prev\s+\d+").alias("n_prev")).where("n_startxref > 1")


@query("SELECT l_orderkey AS file_id, count(*) AS obj_count, count(*) FILTER (WHERE l_returnflag <> 'R') AS endobj_count FROM lineitem GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE l_returnflag <> 'R')")
def object_balance(spark, sf_dir):
    t = F.col("t")
    return _revision_text(spark, sf_dir).select("file_id", scalars.count_of(t, r"\b\d+\s+\d+\s+obj\b").alias("obj_count"), scalars.count_of(t, r"\bendobj\b").alias("endobj_count")).where("obj_count <> endobj_count")


@query("""SELECT o_custkey AS file_id, max(o_orderkey) AS max_object, count(DISTINCT o_orderkey) AS defined, printf('%.1f%%', (max(o_orderkey) - count(DISTINCT o_orderkey)) / max(o_orderkey) * 100) AS gap_percentage
    FROM orders GROUP BY 1 HAVING max(o_orderkey) > 0 AND (max(o_orderkey) - count(DISTINCT o_orderkey)) / max(o_orderkey) > 0.1""")
def object_gaps(spark, sf_dir):
    by = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.max("o_orderkey").alias("max_object"), F.count_distinct("o_orderkey").alias("defined"))
    gap = (F.col("max_object") - F.col("defined")) / F.col("max_object")
    return by.where((F.col("max_object") > 0) & (gap > 0.1)).withColumn("gap_percentage", F.format_string("%.1f%%", gap * 100))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphaned_objects(spark, sf_dir):
    return relations.missing_on_the_right(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_objects(spark, sf_dir):
    return relations.missing_on_the_right(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("SELECT l_orderkey AS file_id, l_suppkey AS object_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_object_ids(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("object_id")).agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH p AS (SELECT o_orderkey AS file_id, -(o_orderkey % 64) - 1 AS p FROM orders)
    SELECT file_id, array_to_string(list_filter([CASE WHEN p & 4 = 0 THEN 'print' END, CASE WHEN p & 8 = 0 THEN 'modify' END, CASE WHEN p & 16 = 0 THEN 'copy' END, CASE WHEN p & 32 = 0 THEN 'annotate' END], lambda x: x IS NOT NULL), ',') AS denied
    FROM p WHERE p & 60 <> 60""")
def permissions(spark, sf_dir):
    denied = scalars.permissions_denied(-(F.col("o_orderkey") % 64) - 1)
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.array_join(denied, ",").alias("denied")).where("denied is not null")


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN repeat(' ', 10) || '%PDF-1.4' WHEN 2 THEN 'PK' || chr(3) || chr(4) || '%PDF-1.4' WHEN 3 THEN repeat('x', 700) || '%PDF-' ELSE text END AS t FROM documents)
    SELECT doc_id, strpos(t, '%PDF-') - 1 AS header_offset, CASE WHEN strpos(t, '%PDF-') = 0 THEN 'CRITICAL' WHEN strpos(t, '%PDF-') <= 1025 THEN CASE WHEN t LIKE 'PK%' OR strpos(t, '%PDF-') > 512 THEN 'SUSPICIOUS' ELSE 'MINOR' END ELSE 'CRITICAL' END AS verdict
    FROM t WHERE strpos(t, '%PDF-') <> 1""")
def polyglot(spark, sf_dir):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(k == 1, F.lit(" " * 10 + "%PDF-1.4")).when(k == 2, F.lit("PK\x03\x04%PDF-1.4")).when(k == 3, F.lit("x" * 700 + "%PDF-")).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", _long(F.instr(t, "%PDF-") - 1).alias("header_offset"), scalars.header_state(t).alias("verdict")).where("header_offset <> 0")


@query("SELECT doc_id, len(regexp_extract_all(text, '!{2,}')) AS marks, len(regexp_extract_all(text, '([*]{3,}|%{3,}|#{3,})')) AS runs FROM documents WHERE regexp_matches(text, '!{2,}|[*]{3,}|%{3,}|#{3,}')")
def scrubbing(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").where(t.rlike("!{2,}|[*]{3,}|%{3,}|#{3,}")).select("doc_id", scalars.count_of(t, "!{2,}").alias("marks"), scalars.count_of(t, "[*]{3,}|%{3,}|#{3,}").alias("runs"))


@query("""SELECT l_orderkey AS file_id, count(*) FILTER (WHERE l_returnflag = 'A') AS white, count(*) FILTER (WHERE l_linestatus = 'F') AS overlays
    FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) > 2""")
def white_operators(spark, sf_dir):
    piece = F.concat(F.when(F.col("l_returnflag") == "A", "1 1 1 rg\n").otherwise("0 g\n"), F.when(F.col("l_linestatus") == "F", "0 0 9 9 re f\n").otherwise(""))
    made = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.concat_ws("", F.collect_list(piece)).alias("t"))
    return made.select("file_id", scalars.count_of(F.col("t"), r"\b1 1 1 rg\b").alias("white"), scalars.count_of(F.col("t"), r"re f\n").alias("overlays")).where("white > 2")


@query("SELECT o_orderkey AS file_id, date_diff('day', TIMESTAMP '1997-06-01 00:00:00', o_orderdate) AS days_ahead FROM orders WHERE date_diff('day', TIMESTAMP '1997-06-01 00:00:00', o_orderdate) > 1")
def future_dates(spark, sf_dir):
    days = F.datediff("o_orderdate", F.lit("1997-06-01").cast("date"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), _long(days).alias("days_ahead")).where("days_ahead > 1")


@query("""SELECT o_orderkey AS file_id, l_linenumber AS line, epoch(o_orderdate)::BIGINT - epoch(l_shipdate)::BIGINT AS seconds, epoch(o_orderdate) - epoch(l_shipdate) > 60 AS spoofed
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE abs(epoch(o_orderdate) - epoch(l_shipdate)) > 60""")
def date_mismatch(spark, sf_dir):
    both = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    seconds = F.unix_timestamp("o_orderdate") - F.unix_timestamp("l_shipdate")
    return both.select(F.col("o_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"), seconds.alias("seconds"), (seconds > 60).alias("spoofed")).where("abs(seconds) > 60")


@query("""WITH x AS (SELECT o_custkey AS path, o_orderkey AS place, epoch(o_orderdate)::BIGINT - lag(epoch(o_orderdate)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders)
    SELECT path, place, CASE WHEN s < 0 THEN 'reverse' ELSE 'gap' END AS kind FROM x WHERE s < 0 OR s > 63072000""")
def history_gaps(spark, sf_dir):
    return timeline.gaps(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT event_id, date_diff('microsecond', lag(ts) OVER w, ts) AS delta_us, coalesce(lag(ts) OVER w ::DATE <> ts::DATE, true) AS new_day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_timeline(spark, sf_dir):
    return timeline.deltas(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "delta_us", "new_day")


@query("""WITH x AS (SELECT user_id AS path, event_type AS kind, ts, event_id FROM events)
    SELECT path, kind, arg_min(ts, (ts, event_id)) AS first_ts, arg_max(ts, (ts, event_id)) AS last_ts, count(*) AS n FROM x GROUP BY 1, 2""")
def key_dates(spark, sf_dir):
    return timeline.key_dates(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("""WITH x AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS a, arg_max(event_type, (ts, event_id)) AS b FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN lower(a) <> lower(b) THEN a || ' > ' || b END AS change FROM x""")
def tool_change(spark, sf_dir):
    by = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("a"), F.max_by("event_type", F.struct("ts", "event_id")).alias("b"))
    return by.select("user_id", classify.tool_change([F.lit(""), F.col("a")], [F.col("b")]).alias("change"))


@query("SELECT conv_id AS path, turn AS place, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, false) AS changed FROM conversations")
def version_history(spark, sf_dir):
    return timeline.version_changes(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    y AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS rev FROM x)
    SELECT doc_id, rev, length(array_to_string(parts[1:rev], chr(10))) AS n_chars, md5(array_to_string(parts[1:rev], chr(10))) AS md5 FROM y""")
def revisions(spark, sf_dir):
    parts = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("parts")).where(F.size("parts") > 1)
    each = parts.select("doc_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("rev"))
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("rev")), "\n")
    return each.select("doc_id", _long("rev").alias("rev"), _long(F.length(prefix)).alias("n_chars"), F.md5(prefix.cast("binary")).alias("md5"))


@query("""WITH x AS (SELECT conv_id, turn, string_split(text, ' ') AS now, lag(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, len(list_distinct(list_filter(now, lambda w: NOT list_contains(before, w)))) AS added, len(list_distinct(list_filter(before, lambda w: NOT list_contains(now, w)))) AS removed FROM x WHERE before IS NOT NULL""")
def revision_words(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("now"), F.lag(F.split("text", " ")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    return rows.where("before is not null").select("conv_id", "turn", _long(F.size(F.array_except("now", "before"))).alias("added"), _long(F.size(F.array_except("before", "now"))).alias("removed"))


_IDS = """WITH own AS (SELECT DISTINCT 'c' || o_custkey AS owner, 'k' || o_orderkey AS id FROM orders), ref AS (SELECT DISTINCT 'p' || l_partkey AS path, 'k' || l_orderkey AS id FROM lineitem WHERE l_quantity > 45),
    down AS (SELECT DISTINCT path, owner FROM ref JOIN own USING (id))"""


def _ids(spark, sf_dir, named="l_quantity > 45"):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    own = _t(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("path"), F.lit("own").alias("kind"), key("k", "o_orderkey").alias("id"))
    return own.unionByName(_t(spark, sf_dir, "lineitem").where(named).select(key("p", "l_partkey").alias("path"), F.lit("ref").alias("kind"), key("k", "l_orderkey").alias("id")))


@query(_IDS + " SELECT path, owner AS related_path, 'derived_from' AS rel_type FROM down UNION ALL SELECT owner, path, 'parent_of' FROM down")
def cross_reference(spark, sf_dir):
    return relations.cross_reference(_ids(spark, sf_dir))


@query(_IDS + " SELECT owner AS path, count(*) AS n_children FROM down GROUP BY 1")
def derived_counts(spark, sf_dir):
    return relations.cross_reference(_ids(spark, sf_dir)).where("rel_type = 'parent_of'").groupBy("path").agg(F.count("*").alias("n_children"))


@query()
def cross_reference_whole(spark, sf_dir):
    """cross_reference over the references of all rows."""
    return relations.cross_reference(_ids(spark, sf_dir, "true"))


@query()
def derived_counts_whole(spark, sf_dir):
    """derived_counts over the references of all rows."""
    return relations.cross_reference(_ids(spark, sf_dir, "true")).where("rel_type = 'parent_of'").groupBy("path").agg(F.count("*").alias("n_children"))


@query("SELECT md5(text) AS content_hash, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def duplicate_content(spark, sf_dir):
    return relations.duplicates(_t(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


_DOMINANT = """WITH b AS (SELECT {g} AS g, {v} AS v, count(*) AS n, min({o}) AS first FROM lineitem GROUP BY 1, 2), t AS (SELECT g, sum(n)::BIGINT AS total, arg_max(v, (n, -first)) AS dominant, max(n) AS most FROM b GROUP BY 1)
    SELECT g AS {g}, total, dominant, total - most AS deviants FROM t WHERE total >= {least} AND most >= total * {share}"""


@query(_DOMINANT.format(g="l_orderkey", v="l_returnflag", o="l_linenumber", least=2, share=0.75))
def page_inconsistency(spark, sf_dir):
    return relations.dominant(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", 0.75, 2)


@query(_DOMINANT.format(g="l_suppkey", v="l_returnflag || l_linestatus", o="l_orderkey", least=6, share=0.25))
def color_space(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("space", F.concat("l_returnflag", "l_linestatus"))
    return relations.dominant(rows, "l_suppkey", "space", "l_orderkey", 0.25, 6)


@query("SELECT p_brand, count(*) AS n, count(*) - count(DISTINCT p_name) AS repeated FROM part GROUP BY 1")
def bookmark_duplicates(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("p_name")).alias("repeated"))


_FLAGS = _EMAILS + ", keys AS (SELECT DISTINCT doc_id, 'EmailAddresses' AS key FROM emails UNION ALL SELECT doc_id, 'StackedFilters' FROM documents WHERE n_chars > 8000), flags AS (SELECT d.doc_id AS path, CASE WHEN bool_or(key = 'StackedFilters') THEN 'YES' WHEN count(key) > 0 THEN 'Possible' ELSE 'NO' END AS flag, count(key) AS n_indicators FROM documents d LEFT JOIN keys USING (doc_id) GROUP BY 1)"


def _flags(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    mails = _emails(spark, sf_dir).where(F.size("emails") > 0).select(F.col("doc_id").alias("path"), F.lit("EmailAddresses").alias("key"))
    large = docs.where("n_chars > 8000").select(F.col("doc_id").alias("path"), F.lit("StackedFilters").alias("key"))
    return classify.flag(docs.select(F.col("doc_id").alias("path")), mails.unionByName(large))


@query(_FLAGS + " SELECT * FROM flags")
def risk_flag(spark, sf_dir):
    return _flags(spark, sf_dir)


@query(_FLAGS + " SELECT count(*) AS originals, count(*) FILTER (WHERE flag = 'YES') AS yes, count(*) FILTER (WHERE flag = 'Possible') AS possible, count(*) FILTER (WHERE flag = 'NO') AS clean FROM flags")
def scan_summary(spark, sf_dir):
    return classify.summary(_flags(spark, sf_dir))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'mach')")
def free_text_filter(spark, sf_dir):
    return classify.free_text(_t(spark, sf_dir, "customer"), "MACH", "c_name", "c_mktsegment").select("c_custkey", "c_name")


@query("""WITH p AS (SELECT 'o' || o_orderkey AS path, o_orderkey AS place FROM orders WHERE o_orderkey % 50 = 0), c AS (SELECT 'o' || l_orderkey || '_' || l_linenumber AS path, 'o' || l_orderkey AS original_path FROM lineitem WHERE l_orderkey % 50 = 0),
    r AS (SELECT path, NULL AS original_path, place, 0 AS k FROM p UNION ALL SELECT c.path, c.original_path, p.place, 1 FROM c LEFT JOIN p ON p.path = c.original_path),
    n AS (SELECT *, row_number() OVER (ORDER BY place NULLS LAST, k, path) AS row_id FROM r)
    SELECT n.row_id, n.path, h.row_id AS parent_id FROM n LEFT JOIN n h ON h.k = 0 AND h.path = n.original_path""")
def report_rows(spark, sf_dir):
    return _report(spark, sf_dir, "o_orderkey % 50 = 0", "l_orderkey % 50 = 0")


@query()
def report_rows_whole(spark, sf_dir):
    """report_rows over all keys."""
    return _report(spark, sf_dir, "true", "true")


def _report(spark, sf_dir, of_orders, of_lines):
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    parents = _t(spark, sf_dir, "orders").where(of_orders).select(key("o_orderkey").alias("path"), F.col("o_orderkey").alias("place"))
    children = _t(spark, sf_dir, "lineitem").where(of_lines).select(F.concat(key("l_orderkey"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("path"), key("l_orderkey").alias("original_path"))
    return relations.number_report(parents, children).withColumn("row_id", _long("row_id")).withColumn("parent_id", _long("parent_id"))


_ENTRY = "event_type || ':' || event_id"


@query(f"""SELECT user_id AS log, count(*) AS n_entries, list_reduce(list_prepend(sha256('{custody.GENESIS}'), list({_ENTRY} ORDER BY ts, event_id)), lambda a, x: sha256(a || x)) AS head FROM events GROUP BY 1""")
def custody_build(spark, sf_dir):
    entry = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return custody.chain(_t(spark, sf_dir, "events").withColumn("line", entry), "user_id", ["ts", "event_id"], "line")


@query("SELECT user_id AS log, count(*) AS n_entries, CASE WHEN user_id % 3 = 0 AND count(*) >= 5 THEN 5 END::BIGINT AS first_bad_line FROM events GROUP BY 1")
def custody_verify(spark, sf_dir):
    entry = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    log = custody.chained(_t(spark, sf_dir, "events").withColumn("line", entry), "user_id", ["ts", "event_id"], "line")
    tampered = log.withColumn("entry", F.when((F.col("log") % 3 == 0) & (F.col("line_no") == 5), F.concat("entry", F.lit("!"))).otherwise(F.col("entry")))
    return custody.verify(tampered)


@query("""SELECT d.doc_id AS path, CASE WHEN d.doc_id % 7 = 0 THEN 'missing' WHEN d.doc_id % 5 = 0 AND d.text <> '' THEN 'mismatched' ELSE 'verified' END AS verdict FROM documents d""")
def integrity_verify(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("text"))
    now = docs.where("path % 7 <> 0").select("path", F.md5(F.when((F.col("path") % 5 == 0) & (F.octet_length("text") > 0), F.concat("text", F.lit("x").cast("binary"))).otherwise(F.col("text"))).alias("hash"))
    return relations.integrity(docs.select("path", F.md5("text").alias("hash")), now)


@query(r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS n_chars, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS md5 FROM documents")
def clean_cells(spark, sf_dir):
    cell = scalars.clean_cell(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", _long(F.length(cell)).alias("n_chars"), F.md5(cell.cast("binary")).alias("md5"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_quantity::BIGINT || ' found' WHEN l_returnflag = 'R' THEN left(l_returnflag || l_linestatus || '-long-text', 6) || '...' ELSE 'key' END AS shown FROM lineitem""")
def indicator_text(spark, sf_dir):
    shown = F.when(F.col("l_quantity") > 40, F.concat(_long("l_quantity").cast("string"), F.lit(" found"))).when(F.col("l_returnflag") == "R", F.concat(F.left(F.concat("l_returnflag", "l_linestatus", F.lit("-long-text")), F.lit(6)), F.lit("..."))).otherwise("key")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x) * 255) % 256)::INT) AS q FROM embeddings)
    SELECT vec_id, list_min(q) AS lo, list_max(q) AS hi, round(list_avg(q), 1) AS mean, len(list_distinct(q)) AS kinds,
    CASE WHEN list_min(q) = list_max(q) THEN 'CRITICAL' WHEN len(list_distinct(q)) < 10 THEN 'LOW DIVERSITY' WHEN list_min(q) < 2 THEN 'ULTRA LOW COMPRESSION' WHEN list_max(q) > 250 THEN 'EXTREME COMPRESSION' END AS warning FROM q""")
def quantisation_stats(spark, sf_dir):
    q = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x) * 255) % 256).cast("int")).alias("q"))
    mean = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("q")
    return q.select("vec_id", F.array_min("q").alias("lo"), F.array_max("q").alias("hi"), F.round(mean, 1).alias("mean"), _long(F.size(F.array_distinct("q"))).alias("kinds"), scalars.table_warning(F.col("q")).alias("warning"))


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def language_set(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT doc_id, left(text, 2000) AS excerpt, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def findings_report(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.left("text", F.lit(2000)).alias("excerpt"), "quality", "toxic")


@query("""WITH x AS (SELECT c_custkey, ['urn:uuid:', 'uuid:', 'xmp.iid:', '<'][c_custkey % 4 + 1] || lower(c_name) || CASE WHEN c_custkey % 4 = 3 THEN '>' ELSE '' END AS raw FROM customer)
    SELECT c_custkey, trim(regexp_replace(upper(raw), '^(URN:UUID:|UUID:|XMP.IID:)', ''), '<> ') AS id FROM x""")
def id_normalise(spark, sf_dir):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("urn:uuid:", "uuid:", "xmp.iid:", "<")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    raw = F.concat(prefix, F.lower("c_name"), F.when(F.col("c_custkey") % 4 == 3, ">").otherwise(""))
    return _t(spark, sf_dir, "customer").select("c_custkey", scalars.normal_id(raw).alias("id"))


@query()
def text_indicators(spark, sf_dir):
    """All text rules over the documents as scan text."""
    rules = text_rules.text_rules(contacts.top_level_domains(spark), F.lit("2024-01-01").cast("timestamp"))
    return text_rules.indicators(_t(spark, sf_dir, "documents"), "doc_id", "text", rules)


QUERIES |= findings.QUERIES
ORACLES |= findings.ORACLES
