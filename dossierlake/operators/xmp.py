"""XMP packets: identifiers, derivation, ingredients, the pantry of embedded packets, and what in them does not fit together."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.scalars import normal_id

# Namespaces of the format, and the names of its properties.
RDF, MM, REF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://ns.adobe.com/xap/1.0/mm/}", "{http://ns.adobe.com/xap/1.0/sType/ResourceRef#}"
IDS = {"documentID": "DocumentID", "instanceID": "InstanceID", "originalDocumentID": "OriginalDocumentID"}
PARENT, PART = ["documentID", "instanceID", "originalDocumentID", "fromPart", "toPart"], ["documentID", "instanceID", "filePath", "fromPart", "toPart"]
#: Packets within packets that are followed.
NESTED = 8

_ENTRY = "struct<depth:int,owner:string,instanceID:string,documentID:string,originalDocumentID:string,derived_documentID:string,derived_instanceID:string>"
SCHEMA = f"""path string, ids struct<documentID:string,instanceID:string,originalDocumentID:string>, derivation struct<documentID:string,instanceID:string,originalDocumentID:string,fromPart:string,toPart:string>,
 ingredients array<struct<documentID:string,instanceID:string,filePath:string,fromPart:string,toPart:string>>, pantry array<{_ENTRY}>, error string"""  # fmt: skip


def _value(x: ET.Element, name: str) -> str | None:
    """A property of a reference, as attribute or as element."""
    own = x.get(name) or next((e.text for e in x.iter(name) if e is not x and e.text), None)
    return own.strip() if own and own.strip() else None


def _items(root: ET.Element, name: str) -> list[ET.Element]:
    array = next(root.iter(MM + name), None)
    return [] if array is None else [li for bag in array.iter() if bag.tag in (RDF + "Bag", RDF + "Seq") for li in bag.findall(RDF + "li")]


def _ids(root: ET.Element) -> dict[str, str | None]:
    """The first value of each identifier: within a description its elements come before its attributes."""
    out: dict[str, str | None] = dict.fromkeys(IDS)
    places = [root] if root.tag == RDF + "Description" else []
    for d in places + [x for x in root.iter(RDF + "Description") if x is not root] or [root]:
        for key, name in IDS.items():
            if not out[key]:
                below = next((e.text.strip() for e in d.iter(MM + name) if e.text and e.text.strip()), None)
                out[key] = below or (d.get(MM + name) or "").strip() or None
    return out


def packet_tree(packet: str) -> dict[str, Any]:
    """What a packet says of its file: ids, derivation, ingredients, and the packets of its pantry in a flat list, each with its depth and
    the instance it belongs to. A packet that is no XML has an error and nothing else."""
    out: dict[str, Any] = {"ids": None, "derivation": None, "ingredients": [], "pantry": [], "error": None}
    body = re.sub(r"<\?xpacket.*?\?>", "", packet or "", flags=re.S).strip()
    if not body:
        return out
    if "<!DOCTYPE" in body or "<!ENTITY" in body:  # entities may grow without bound
        return out | {"error": "Parsing Error: document type declarations are not read"}
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        return out | {"error": f"Parsing Error: {e}"}

    def derivation(x: ET.Element) -> dict[str, str | None] | None:
        parent = next(x.iter(MM + "DerivedFrom"), None)
        found = {k: _value(parent, REF + k) for k in PARENT} if parent is not None else {}
        return found if any(found.values()) else None

    todo = [(li, 1, None) for li in _items(root, "Pantry")]
    while todo:
        li, depth, owner = todo.pop(0)
        source = li.find(RDF + "Description")
        source = li if source is None else source
        own, parent = _ids(source), derivation(source) or {}
        if own["instanceID"]:
            out["pantry"].append({"depth": depth, "owner": owner, **own, "derived_documentID": parent.get("documentID"), "derived_instanceID": parent.get("instanceID")})
            if depth < NESTED:
                todo += [(x, depth + 1, own["instanceID"]) for x in _items(source, "Pantry")]
    pantry = next(root.iter(MM + "Pantry"), None)
    inside = set(pantry.iter()) if pantry is not None else set()
    parts = [{k: _value(li, REF + k) for k in PART} for li in _items(root, "Ingredients") if li not in inside]
    parent = next((x for x in root.iter(MM + "DerivedFrom") if x not in inside), None)
    found = {k: _value(parent, REF + k) for k in PARENT} if parent is not None else {}
    return out | {"ids": _ids(root), "derivation": found if any(found.values()) else None, "ingredients": [p for p in parts if any(p.values())]}


def packet(text: Column) -> Column:
    """The first packet of a scan text; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(<\?xpacket begin=.*?\?>.*?<\?xpacket end=[^>]*\?>)", 1)


def relationships(files: DataFrame, path_col: str = "path", packet_col: str = "packet") -> DataFrame:
    """A row a file with a packet that is not empty (see SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, **packet_tree(x)} for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(SCHEMA.replace("\n", " "))
    arrow = to_arrow_schema(schema)
    some = files.select(F.col(path_col).alias("path"), F.col(packet_col).alias("packet")).where("packet <> ''")
    return some.mapInArrow(run, schema)


def anomalies(related: DataFrame) -> DataFrame:
    """path, anomaly: ingredients without their packet in the pantry, an original that differs from the parent's, and ingredients whose
    packet has another document id."""
    top = F.filter("pantry", lambda p: p["depth"] == 1)
    parts = related.select("path", top.alias("pantry"), F.explode("ingredients").alias("i"))
    missing = parts.where("i.instanceID is not null").where(~F.exists("pantry", lambda p: p["instanceID"] == F.col("i.instanceID")))
    missing = missing.select("path", F.concat(F.lit("Missing Pantry item for ingredient: "), "i.instanceID").alias("anomaly"))
    differ = related.where("ids.originalDocumentID <> derivation.originalDocumentID").select("path", F.concat(F.lit("OriginalDocumentID mismatch with parent: "), "ids.originalDocumentID", F.lit(" vs "), "derivation.originalDocumentID").alias("anomaly"))
    held = parts.select("path", "i", F.explode("pantry").alias("p")).where("i.instanceID = p.instanceID and i.documentID <> p.documentID")
    held = held.select("path", F.concat(F.lit("Ingredient DocumentID mismatch for "), "p.instanceID", F.lit(": "), "i.documentID", F.lit(" vs "), "p.documentID").alias("anomaly"))
    broken = related.where("error is not null").select("path", F.col("error").alias("anomaly"))
    return missing.unionByName(differ).unionByName(held).unionByName(broken)


def ancestry(related: DataFrame) -> DataFrame:
    """path, step (from 1), document_id: parents, each found in the pantry by the instance that the one before was derived from."""
    packets = F.map_from_entries(F.transform("pantry", lambda p: F.struct(p["instanceID"], F.struct(p["derived_documentID"].alias("d"), p["derived_instanceID"].alias("i")))))
    start = F.struct(F.array("derivation.documentID").alias("chain"), F.col("derivation.instanceID").alias("at"))

    def step(acc: Column, _: Column) -> Column:
        nxt = F.try_element_at(F.col("by"), F.coalesce(acc["at"], F.lit("")))
        more = nxt["d"].isNotNull()
        return F.struct(F.when(more, F.concat(acc["chain"], F.array(nxt["d"]))).otherwise(acc["chain"]).alias("chain"), F.when(more, nxt["i"]).alias("at"))

    rows = related.where("derivation.documentID is not null").withColumn("pantry", F.filter("pantry", lambda p: p["instanceID"].isNotNull()))
    rows = rows.withColumn("pantry", _first_of_each("pantry")).withColumn("by", packets)
    rows = rows.withColumn("chain", F.aggregate(F.sequence(F.lit(0), F.lit(NESTED)), start, step)["chain"])
    return rows.select("path", F.posexplode("chain").alias("k", "document_id")).select("path", (F.col("k") + 1).alias("step"), "document_id")


def _first_of_each(name: str) -> Column:
    """Packets by instance, the first of each: a map wants each key once."""
    return F.aggregate(name, F.slice(F.col(name), 1, 0), lambda acc, p: F.when(F.exists(acc, lambda q: q["instanceID"] == p["instanceID"]), acc).otherwise(F.concat(acc, F.array(p))))


def indicators(related: DataFrame) -> DataFrame:
    """AssetRelationship of files with a derivation, ingredients or a pantry, and RelatedFiles with the parent's id as a stub."""
    some = related.where("derivation is not null or size(ingredients) > 0 or size(pantry) > 0")
    wrong = anomalies(related).groupBy("path").agg(F.array_sort(F.collect_list("anomaly")).alias("anomalies"))
    said = F.to_json(F.struct("ids", "derivation", "ingredients", F.size("pantry").alias("pantry_count"), F.coalesce("anomalies", F.array().cast("array<string>")).alias("anomalies")))
    asset = some.join(wrong, "path", "left").select("path", F.lit(300).alias("rule_order"), F.lit("AssetRelationship").alias("key"), F.lit(1).cast("long").alias("count"), said.alias("details"))
    parent = F.col("derivation.documentID")
    stub = F.struct(F.lit("derived_from").alias("type"), F.concat(F.lit("ID: "), F.substring(parent, 1, 8), F.lit("...")).alias("name"), parent.alias("id"))
    files = some.where(parent.isNotNull()).select("path", F.lit(301).alias("rule_order"), F.lit("RelatedFiles").alias("key"), F.lit(1).cast("long").alias("count"), F.to_json(F.struct(F.lit(1).alias("count"), F.array(stub).alias("files"))).alias("details"))
    return asset.unionByName(files)


def history_pairs(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, place, instance_id, ts: events of the history in order, in attribute form, else in element form; without a readable date: none."""
    t = F.col(text_col)
    attribute = r"(?s)stEvt:instanceID=\"([^\"]+)\"[^>]*?stEvt:when=\"([^\"]+)\""
    element = r"(?s)<stEvt:instanceID>([^<]+)</stEvt:instanceID>.*?<stEvt:when>([^<]+)</stEvt:when>"
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("i"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("w"))
    rows = files.where(F.contains(F.lower(t), F.lit("stevt:when"))).select(F.col(path_col).alias("path"), F.posexplode(F.when(F.size(pairs(attribute)) > 0, pairs(attribute)).otherwise(pairs(element))).alias("place", "x"))
    return rows.select("path", "place", F.col("x.i").alias("instance_id"), F.try_to_timestamp(F.col("x.w")).alias("ts")).where("ts is not null")


def all_ids(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, kind, id: normalised ids of packets by where they stand. Kinds: stref_doc, stref_inst, derived_doc, derived_inst, derived_orig,
    ingredient_doc, ingredient_inst, history_doc, history_inst, ancestor."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    block = lambda name: F.regexp_extract(t, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
    attribute = lambda c, name: F.regexp_extract_all(c, F.lit(rf"(?i)stRef:{name}=\"([^\"]+)\""), F.lit(1))
    element = lambda c, name: F.regexp_extract_all(c, F.lit(rf"(?i)<stRef:{name}>([^<]+)</stRef:{name}>"), F.lit(1))
    either = lambda c, name: F.concat(attribute(c, name), element(c, name))
    parent, parts, history, old = block("xmpMM:DerivedFrom"), block("xmpMM:Ingredients"), block("xmpMM:History"), block("photoshop:DocumentAncestors")
    own = lambda name: F.regexp_extract_all(history, F.lit(rf"(?i)(?:stRef:)?{name}=\"([^\"]+)\""), F.lit(1))
    kinds = {
        "stref_doc": attribute(t, "documentID"), "stref_inst": attribute(t, "instanceID"), "derived_doc": either(parent, "documentID"), "derived_inst": either(parent, "instanceID"),
        "derived_orig": F.regexp_extract_all(parent, F.lit(r"(?i)OriginalDocumentID(?:>|=\")([^<\">]+)"), F.lit(1)), "ingredient_doc": either(parts, "documentID"), "ingredient_inst": either(parts, "instanceID"),
        "history_doc": F.concat(element(t, "documentID"), own("documentID")),
        "history_inst": F.concat(element(t, "instanceID"), own("instanceID"), F.regexp_extract_all(history, F.lit(r"(?i)(uuid:[0-9a-f\-]+|xmp\.iid:[^,<>} \]\"]+|xmp\.did:[^,<>} \]\"]+)"), F.lit(1))),
        "ancestor": F.regexp_extract_all(old, F.lit(r"(?i)<rdf:li[^>]*>([^<]+)</rdf:li>"), F.lit(1)),
    }
    rows = F.flatten(F.array(*[F.transform(v, lambda x, k=k: F.struct(F.lit(k).alias("kind"), normal_id(x).alias("id"))) for k, v in kinds.items()]))
    return files.select(F.col(path_col).alias("path"), F.explode(F.array_distinct(rows)).alias("x")).select("path", "x.*").where("id is not null")
