"""Exact duplicates by compressed radix (Patricia) tries over whole texts.

Each input task first puts its own texts into a trie, so a text that a third of the corpus repeats leaves a task once, with its count. A
trie that outgrows its byte budget (edges and nodes) spills its heaviest subtree as partial rows. All rows are then dealt out by length and
content hash and sorted by them, so that equal texts follow each other, and one trie per partition decides equality on the full byte strings.
A terminal node stores the identifier that owns the text. That trie is read out and begun anew only between two hashes, so what it says of a
text is final, and memory is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import id_and_text

#: Bytes that a trie holds before it spills, and what a node takes besides its edge.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings to (owner, count). A node is [edge, children by first byte, owner, count, bytes below, nodes counted with NODE_BYTES];
    count 0 marks an inner node."""

    def __init__(self, keep: str = "min", budget: int = TRIE_BYTES) -> None:
        self.better = min if keep == "min" else max
        self.budget = budget
        self.root: list = [b"", {}, None, 0, 0]

    def _own(self, node: list, owner: int | None, n: int) -> None:
        if owner is not None:
            node[2] = owner if node[2] is None else self.better(node[2], owner)
        node[3] += n

    def insert(self, key: bytes, owner: int | None, n: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None, 0, 0]
                node[1][key[at]] = child
                for x in (*path, child):
                    x[4] += len(key) - at + NODE_BYTES
                node, at = child, len(key)
            elif key.startswith(child[0], at):
                at += len(child[0])
                node = child
                path.append(child)
            else:
                k = _shared(child[0], key, at)
                for x in path:
                    x[4] += NODE_BYTES
                upper = [child[0][:k], {child[0][k]: child}, None, 0, child[4] + NODE_BYTES]
                child[0] = child[0][k:]
                child[4] -= k
                node[1][key[at]] = upper
                node, at = upper, at + k
                path.append(upper)
        self._own(node, owner, n)

    @staticmethod
    def _walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node, prefix)]
        while todo:
            x, before = todo.pop()
            whole = before + x[0]
            if x[3]:
                yield whole, x[2], x[3]
            todo.extend((y, whole) for y in x[1].values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """While over budget, the terminals of the heaviest subtree, which leaves the trie."""
        while self.root[4] > self.budget:
            at = max(self.root[1], key=lambda b: self.root[1][b][4])
            child = self.root[1].pop(at)
            self.root[4] -= child[4]
            yield from self._walk(child, b"")

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        yield from self._walk(self.root, b"")


def _owners(keep: str, budget: int, with_text: bool):
    names = ["n_bytes", "text_sha256", "owner", "n"] + ["key"] * with_text
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * with_text

    def rows(found: Iterator[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
        part, held = [], 0
        for key, owner, n in found:
            part.append((len(key), hashlib.sha256(key).hexdigest(), owner, n, key))
            held += len(key)
            if held > 16 << 20 or len(part) >= 20_000:
                yield batch(part)
                part, held = [], 0
        if part:
            yield batch(part)

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(keep, budget)
        for b in batches:
            for key, owner, n in zip(b.column("key"), b.column("owner").to_pylist(), b.column("n").to_pylist()):
                trie.insert(key.as_py(), owner, n)
                if trie.root[4] > 2 * budget:
                    yield from rows(trie.spill())
            yield from rows(trie.spill())
        yield from rows(trie.items())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, before = PatriciaTrie(keep, budget), None
        for b in batches:
            for key, owner, n, sha in zip(b.column("key"), b.column("owner").to_pylist(), b.column("n").to_pylist(), b.column("text_sha256").to_pylist()):
                if sha != before and trie.root[4] > budget:
                    yield from rows(trie.items())
                    trie = PatriciaTrie(keep, budget)
                before = sha
                trie.insert(key.as_py(), owner, n)
        yield from rows(trie.items())

    return run if with_text else last


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", which identifier of equal texts stays. A null text counts as the empty text and empty texts are equal. A null
    doc_id never owns a text unless all ids of the group are null (keep_id is null then, and its rows are kept). Rows that repeat both id
    and text count in group_size and share the flag. An empty table gives an empty result. Other columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col)
    raw = base.select(F.col("text").cast("binary").alias("key"), F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("n"))
    first = raw.mapInArrow(_owners(keep, trie_bytes, True), "n_bytes long, text_sha256 string, owner long, n long, key binary")
    dealt = first.repartition("n_bytes", "text_sha256").sortWithinPartitions("n_bytes", "text_sha256")
    whole = dealt.mapInArrow(_owners(keep, trie_bytes, False), "n_bytes long, text_sha256 string, owner long, n long")
    groups = whole.withColumnsRenamed({"owner": "keep_id", "n": "group_size"})
    rows = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return rows.join(groups, ["n_bytes", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of docs that stay, one for each text, with all columns of docs: the owner's row (see exact_dedup). Of rows that repeat both
    id and text the one with the smallest hash over its columns stays."""
    marked = docs.withColumns({"_n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "_sha": F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)})
    kept = exact_dedup(docs, id_col, text_col, keep, trie_bytes).where("kept").select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_keep")).distinct()
    rows = marked.join(kept, "_sha").where(F.col(id_col).cast("long").eqNullSafe(F.col("_keep")))
    # Rows with one id and one text are joined map-side before they meet.
    whole = F.struct(*docs.columns)
    return rows.groupBy("_sha", "_n_bytes").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
