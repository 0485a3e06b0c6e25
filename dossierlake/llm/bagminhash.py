"""Near duplicates by BagMinHash signatures of word-shingle multisets, banding and exact verification.

Signature: each shingle with count w has independent Poisson processes over the dyadic weight ranges [0,1), [1,2), [2,4), [4,8), ... that
reach below w. A point has a time, one of M components and a weight level in its range; it counts if its level is below w. A component
keeps the earliest time, so two documents agree in it with the probability of their weighted Jaccard similarity. A shingle's processes
stop as soon as their time passes the document's latest component, so the work is about n + M ln M points. The dyadic ranges run as
processes of their own; none is split downward into halves, as weights are counts and the ranges that reach below one are few.

Candidates share a band of ROWS components. Equal texts are one node. In each bucket all nodes are compared with one pivot, links join
into components, and buckets that still hold several components take further pivots. What is left then is joined exactly by prefix
filtering: of two sets with similarity s, sorted rarest element first, the first (1-s)n+1 elements share one, at places that leave room
for the overlap. No bucket emits all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.llm.common import id_and_text, remove, written

SHINGLE, SIMILARITY = 5, 0.8
#: Components and bands; 5 rows a band. A pair at 0.8 shares no band with a probability of 3e-6.
COMPONENTS, BANDS = 160, 32
PIVOT_ROUNDS = 3
#: Bytes of words that a task remembers.
MEMORY = 48 << 20
_SEED = np.uint64(0x5D0C1E5)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 150
        if self.held > MEMORY:
            self.clear()
            self.held = 0
        out = self[word] = xxhash.xxh64_intdigest(word, 11)
        return out


def shingles(texts: list[bytes], words: _WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles. A text of fewer than `size` words has one shingle, all its words; a text without
    words has none."""
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((words[w] for s in split for w in s), np.uint64, int(n.sum()))
    begin = np.cumsum(n) - n
    h = np.zeros(len(flat), np.uint64)
    for k in range(size):  # h[i] covers words i .. i+size-1, for texts with enough of them
        tail = flat[k:]
        h[: len(tail)] = _mix(h[: len(tail)] * np.uint64(0x9E3779B97F4A7C15) + tail)
    own = np.repeat(np.arange(len(split)), n)
    inside = np.arange(len(flat)) <= (begin + n - size)[own]
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.array([xxhash.xxh64_intdigest(b" ".join(split[i]), 12) for i in short], np.uint64)
    doc, key = np.concatenate([own[inside], short]), np.concatenate([h[inside], whole])
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, key = doc[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Times by document and component; infinite for documents without shingles."""
    sig = np.full((n_docs, m), np.inf)
    flat = sig.reshape(-1)
    blocks = [(doc, key, count, np.zeros(len(doc), np.int64))]
    low = 1
    while (more := count > low).any():
        blocks.append((doc[more], key[more], count[more], np.full(int(more.sum()), low, np.int64)))
        low *= 2
    d, k, w, low_of = (np.concatenate(x) for x in zip(*blocks))
    seed = _mix(k ^ _mix(low_of.astype(np.uint64) + _SEED))
    width = np.maximum(low_of, 1)
    time = np.zeros(len(d))
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(d):
        step += 1
        a = _mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        b = _mix(a + np.uint64(0xD1B54A32D192ED03))
        time = time - np.log1p(-(a >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (m * width)
        live = time < latest[d]
        if not live.all():
            d, w, low_of, seed, width, time, b = (x[live] for x in (d, w, low_of, seed, width, time, b))
        good = low_of + ((b >> np.uint64(32)).astype(np.int64) % width) < w
        component = ((b & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, d[good] * m + component[good], time[good])
        if len(d):
            touched = np.unique(d)
            latest[touched] = sig[touched].max(1)
            live = time < latest[d]
            d, w, low_of, seed, width, time = (x[live] for x in (d, w, low_of, seed, width, time))
    return sig


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit hash by document and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(bits.shape[2]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return h.view(np.int64)


def _banding(m: int, bands: int, size: int):
    """(node, text) to (node, bands), once a node and task; nodes without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _WordHashes(), set()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                nodes = part.column(0).to_pylist()
                new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
                if len(seen) > 300_000:
                    seen.clear()
                if not new:
                    continue
                texts = part.column(1).take(pa.array(new)).to_pylist()
                doc, key, count = shingles(texts, words, size)
                hashes = band_hashes(signatures(doc, key, count, len(texts), m), bands)
                some = np.bincount(doc, minlength=len(texts)) > 0
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, y in zip(new, some) if y], pa.binary()), pa.array(list(hashes[some]), pa.list_(pa.int64()))], ["node", "bands"])

    return run


def _elements(size: int):
    """(node, text) to (node, elements): the shingle multiset as a set, the j-th copy of a shingle being an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                doc, key, count = shingles(part.column(1).to_pylist(), words, size)
                copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                each = _mix(np.repeat(key, count) + copy.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
                ends = np.cumsum(np.bincount(doc, weights=count, minlength=part.num_rows)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(each))], ["node", "elements"])

    return run


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label (its component's smallest node) of all nodes that links name: least label of the neighbours, then the label's label,
    until nothing changes."""
    edges = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)).distinct(), "links")
    labels = written(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        best = labels.join(near, labels["node"] == near["x"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = written(best.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        remove(labels)
        if nxt.where("label < old").isEmpty():
            remove(edges)
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")
        labels._written_to = nxt._written_to


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    size = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("ea") + F.size("eb")).alias("sum"))
    return size.where(F.col("both") >= F.lit(similarity - 1e-12) * (F.col("sum") - F.col("both"))).select("a", "b")


def _label(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes with their label; a node without links is its own."""
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    many = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return members.join(many, "bucket", "left_semi")


def _pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with its bucket's pivot, another one each turn, if their components differ."""
    pick = members.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("p"))
    pairs = members.join(pick, "bucket").where("label <> p.label")
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of open members that may still be linked: different components, sizes that allow it, a common element in their prefixes, and one
    of the two outside its bucket's largest component."""
    by = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = by.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    rest = members.join(largest, "bucket").groupBy("node", "label").agg(F.max(F.col("label") != F.col("top")).alias("rest"))
    own = rest.join(sets, "node").withColumn("n", F.size("elements"))
    own = written(own, "open-sets")
    each = own.select("node", F.explode("elements").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("df"))
    ranked = each.join(often, "e").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("df", "e")))
    prefix = written(ranked.join(own.select("node", "label", "rest", "n"), "node").where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("e", "node", "label", "rest", "n", "k"), "prefixes")
    x, y = (prefix.select("e", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "rest", "n", "k")]) for s in "xy")
    met = x.join(y, "e").where((F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & (F.col("rest_x") | F.col("rest_y")))
    met = met.where((F.col("n_x") >= F.col("n_y") * similarity - 1e-9) & (F.col("n_y") >= F.col("n_x") * similarity - 1e-9))
    # At the first element that two sets share, what follows it must still be enough for the overlap that the similarity asks for.
    enough = (F.col("n_x") + F.col("n_y")) * (similarity / (1 + similarity)) - 1e-9
    met = met.where(F.least(F.col("n_x") - F.col("k_x"), F.col("n_y") - F.col("k_y")) + 1 >= enough)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_links(nodes: DataFrame, similarity: float = SIMILARITY, m: int = COMPONENTS, bands: int = BANDS, size: int = SHINGLE, rounds: int = PIVOT_ROUNDS) -> DataFrame | None:
    """node, label of all nodes with a link; nodes: (node binary, text binary), a node's texts all equal. None if no bucket holds two."""
    spark = nodes.sparkSession
    signed = nodes.mapInArrow(_banding(m, bands, size), "node binary, bands array<long>")
    signed = written(signed.groupBy("node").agg(F.first("bands").alias("bands")), "bands")  # signatures are made once
    each = signed.select("node", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = written(each.join(shared, "bucket", "left_semi"), "members")
    if members.isEmpty():
        remove(signed)
        return None
    remove(signed)
    wanted = members.select("node").distinct()
    texts = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_elements(size), "node binary, elements array<long>"), "sets")

    links, labels = None, None
    current = _label(members, None)
    for turn in range(rounds + 1):
        pairs = _pivot_pairs(current, turn) if turn < rounds else _prefix_pairs(current, sets, similarity)
        pairs = written(pairs, "pairs")
        found = written(_verified(pairs, sets, similarity), "found")
        remove(pairs)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = components(links, "a", "b")
        last, current = current, written(_open_buckets(_label(members, labels)), "open")
        remove(last)
        if current.isEmpty():
            break
    return labels if labels is not None else spark.createDataFrame([], "node binary, label binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, m: int = COMPONENTS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept (it is that document), text_md5.

    A class is a connected component of links, a link being a weighted Jaccard similarity of word-shingle counts of at least `similarity`;
    equal texts are always linked. Words lie between ASCII white space, case and marks count. A null text counts as empty, and all texts
    without words that are equal form a class. A null doc_id never gives the class id unless all ids of the class are null. If two texts of
    a class have its smallest id, the one with the smaller text_md5 is kept; rows that repeat id and text share the flag. An empty table
    gives an empty result; other columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("node", _node(F.col("text")))
    labels = near_links(base.select("node", "text"), similarity, m, bands, size)
    rows = base.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = _label(rows, labels)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    classes = named.groupBy("label").agg(first.alias("first"), F.sum("n").alias("class_size"))
    by_node = named.select("node", "label").join(classes, "label").select("node", F.col("first.least").alias("class_id"), F.col("first.node").alias("owner"), "class_size")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("owner"))
    return base.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "class_size", kept.alias("kept"), F.lower(F.hex("node")).alias("text_md5"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one for each class, with all columns of docs. Of rows that repeat both id and text the one with the
    smallest hash over its columns stays."""
    marked = docs.withColumn("_md5", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    kept = near_dedup(docs, id_col, text_col, **options).where("kept").select(F.col("text_md5").alias("_md5"), F.col("doc_id").alias("_keep")).distinct()
    rows = marked.join(kept, "_md5").where(F.col(id_col).cast("long").eqNullSafe(F.col("_keep")))
    return rows.groupBy("_md5").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text))
