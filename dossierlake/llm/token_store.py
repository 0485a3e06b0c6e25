"""Content-addressed store for token ids.

Layout of a store (a folder that Spark writes and reads, so any file system works):

  content/kind=chunk/  digest (SHA-256 of the ids as little-endian uint32), n_ids, data (zstd of the ids as uint16 or uint32): each content once
  recipes/             part, seq, doc_id, n_tokens, digests (the chunks in order), root (Merkle root of digests), in ascending doc_id order
  manifest/            level, part, n_docs, n_tokens, root: one row per recipe part, its root over the documents' roots, and one row for the store

A gear hash over the last 16 ids of a document's stream cuts it where the hash has CUT_BITS zero bits, so equal passages give equal chunks
wherever they stand. Reading checks the recipes against the manifest first, then each chunk against its digest and each document against its root.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dossierlake.llm.common import id_and_text, remove_path

#: A cut where this many bits are zero (512 ids on average), least and most ids of a chunk.
CUT_BITS, LEAST, MOST = 9, 32, 4096
_GEAR = np.random.default_rng(2024).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def gear_hashes(ids: np.ndarray) -> np.ndarray:
    """Sum of gear[id] << age over the last 16 ids, mod 2^64, by doubling the window four times."""
    h = _GEAR[ids & 0xFFFF]
    for w in (1, 2, 4, 8):
        h[w:] = h[w:] + (h[:-w] << np.uint64(w))
    return h


def cut_points(ids: np.ndarray, marks: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one stream. marks: positions after which the hash asks for a cut."""
    if marks is None:
        marks = np.flatnonzero((gear_hashes(ids) >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out, begin, n = [], 0, len(ids)
    for at in marks.tolist():
        while at - begin > MOST:
            begin += MOST
            out.append(begin)
        if at - begin >= LEAST and at < n:
            out.append(at)
            begin = at
    while n - begin > MOST:
        begin += MOST
        out.append(begin)
    if n:
        out.append(n)
    return out


class Merkle:
    """SHA-256 tree over leaves that come one by one: leaves and inner nodes have prefixes of their own, and where a level has an odd number
    of nodes the last one moves up. Holds one node a level."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes]] = []  # (height, hash), heights falling

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while self.open and self.open[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.open.pop()[1] + node[1]).digest())
        self.open.append(node)

    def root(self) -> bytes:
        """No leaf gives the hash of nothing."""
        if not self.open:
            return hashlib.sha256(b"").digest()
        out = self.open[-1][1]
        for _, x in reversed(self.open[:-1]):
            out = hashlib.sha256(b"\1" + x + out).digest()
        return out


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


# The published split pattern of byte-level BPE.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def byte_ranks(definition: str) -> dict[bytes, int] | None:
    """Bytes of each piece to its id, if the definition is plain byte-level BPE whose ids follow the order of merges (an id is then its
    merge's rank too); None for any other."""
    told = json.loads(definition)
    model, pre = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    pieces = [p for p, i in model["vocab"].items() if i < 256 + len(merges)]
    if len(pieces) != 256 + len(merges) or not all(c in byte_of for p in pieces for c in p):
        return None
    return {bytes(byte_of[c] for c in p): model["vocab"][p] for p in pieces}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them. Plain byte-level BPE goes through the faster library of ranks, which gives
    the same ids; texts that hold an added token, and all texts of other definitions, through the tokenizers library itself. With special,
    the definition's special tokens count where a text spells them, as that library has it by default; else they are encoded as other text."""

    def __init__(self, definition: str, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = not special
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if special or not t.special]
        ranks, self.fast = byte_ranks(definition), None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("store", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids as uint32, without special tokens."""
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_encoders: dict[str, Encoder] = {}

_ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("digests", T.BinaryType()), T.StructField("root", T.BinaryType()),
    T.StructField("digest", T.BinaryType()), T.StructField("n_ids", T.IntegerType()), T.StructField("data", T.BinaryType()),
])
_NAMES = _ENCODED.fieldNames()
_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW)], _NAMES)


def _encoding(definition, end_id: int | None, width: int):
    """Texts to recipe rows (digest null) and chunk rows (doc_id and digests null; each content at most once in a while)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(definition.value.encode()).hexdigest()
        if key not in _encoders:
            _encoders[key] = Encoder(definition.value, special=True)
        encoder, press, seen = _encoders[key], zstandard.ZstdCompressor(level=1), set()
        end = np.array([] if end_id is None else [end_id], "<u4")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                streams = [x for t in part.column(1).to_pylist() for x in (encoder.encode(t), end)]
                sizes = [len(x) + len(end) for x in streams[::2]]
                ids = np.concatenate(streams).astype("<u4", copy=False)
                if len(ids) and width == 2 and ids.max() >= 1 << 16:
                    raise ValueError("an id is above 65535: use width=4")
                marks = np.flatnonzero((gear_hashes(ids) >> np.uint64(64 - CUT_BITS)) == 0) + 1 if len(ids) else np.empty(0, int)
                begin = 0
                for doc_id, n in zip(part.column(0).to_pylist(), sizes):
                    raw = ids[begin : begin + n].tobytes()
                    low, high = np.searchsorted(marks, (begin, begin + n), "right")
                    # A hash near a document's start also sees the one before it, but no cut falls within the first LEAST > 16 ids.
                    ends = cut_points(ids[begin : begin + n], marks[low:high] - begin)
                    digests, a = [], 0
                    for e in ends:
                        piece = raw[4 * a : 4 * e]
                        digest = hashlib.sha256(piece).digest()
                        digests.append(digest)
                        if digest not in seen:
                            if len(seen) > 300_000:
                                seen.clear()
                            seen.add(digest)
                            rows.append((None, None, None, None, digest, e - a, press.compress(piece if width == 4 else ids[begin + a : begin + e].astype("<u2").tobytes())))
                        a = e
                    rows.append((doc_id, n, b"".join(digests), merkle_root(digests), None, None, None))
                    begin += n
                yield _batch(rows)

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digest: only the first of a run passes, and all without one."""
    last = None
    for b in batches:
        own = b.column("digest").to_pylist()
        keep = [x is None or x != y for x, y in zip(own, [last, *own[:-1]])]
        last = own[-1] if own else last
        yield b.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, writes the store. A special token that a text spells gets its own id.

    A null text counts as empty (its ids are the end id alone; without an end id its recipe is empty). Null doc_ids come first in the order;
    rows that repeat an id follow each other, by root. An empty table gives a store without documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json)
    staged = f"{path}/content"
    encoded = id_and_text(docs, id_col, text_col).mapInArrow(_encoding(definition, end_id, width), _ENCODED)
    # Chunks and recipes leave one pass: dealt out by digest (recipes by id and root), sorted, the first of each digest written.
    dealt = encoded.repartition(F.coalesce("digest", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b" "), F.col("root")), 256).cast("binary"))).sortWithinPartitions("digest")
    kind = F.when(F.col("digest").isNull(), "recipe").otherwise("chunk")
    dealt.mapInArrow(_first_of_each, _ENCODED).withColumn("kind", kind).write.option("compression", "none").partitionBy("kind").parquet(staged)
    both = spark.read.schema(T.StructType([*_ENCODED.fields, T.StructField("kind", T.StringType())])).parquet(staged)
    recipes = both.where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "root")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "*").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark, path).write.parquet(f"{path}/manifest")
    remove_path(spark, f"{staged}/kind=recipe")


_RECIPES = "part int, seq long, doc_id long, n_tokens long, digests binary, root binary"
_CHUNKS = "digest binary, n_ids int, data binary"
_MANIFEST = "level string, part int, n_docs long, n_tokens long, root binary"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as the recipes now stand: a row per part (root over its documents' roots in order) and the store's row."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").select("part", "seq", "n_tokens", "root")

    def part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of part and seq; a row a part."""
        done, part, n, tokens, tree = [], None, 0, 0, Merkle()
        for b in batches:
            for own, more, root in zip(*[b.column(c).to_pylist() for c in ("part", "n_tokens", "root")]):
                if own != part:
                    if n:
                        done.append(("part", part, n, tokens, tree.root()))
                    part, n, tokens, tree = own, 0, 0, Merkle()
                n, tokens = n + 1, tokens + more
                tree.add(root)
        if n:
            done.append(("part", part, n, tokens, tree.root()))
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], ["level", "part", "n_docs", "n_tokens", "root"])

    parts = recipes.repartition("part").sortWithinPartitions("part", "seq").mapInArrow(part_roots, _MANIFEST).orderBy("part").collect()  # one row per file
    top = ("store", None, sum(r["n_docs"] for r in parts), sum(r["n_tokens"] for r in parts), merkle_root([bytes(r["root"]) for r in parts]))
    return spark.createDataFrame([*[tuple(r) for r in parts], top], _MANIFEST)


def _tables(most: int = 48) -> np.ndarray:
    """What 2^k zero bytes do to a crc32 register, k below `most`: it is linear over bits, so a register's four bytes are looked up apart and
    joined by exclusive or. Shape (most, 4, 256)."""
    out = np.zeros((most, 4, 256), np.uint32)
    columns = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    values = np.arange(256)
    for k in range(-3, most):  # from one bit to a byte by doubling, then on
        table = np.zeros((4, 256), np.uint32)
        for i in range(32):
            table[i // 8, (values >> (i % 8)) & 1 == 1] ^= columns[i]
        if k >= 0:
            out[k] = table
        columns = _looked_up(table, columns)
    return out


def _looked_up(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


_shift_tables: list[np.ndarray] = []


def crc32_shift(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 registers after so many further zero bytes each."""
    if not _shift_tables:
        _shift_tables.append(_tables())
    x = crcs.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero((n_bytes >> k) & 1)
        x[at] = _looked_up(_shift_tables[0][k], x[at])
    return x


def crc32_join(a: int, b: int, b_bytes: int) -> int:
    """crc32 of two byte strings in a row from their own."""
    return int(crc32_shift(np.array([a], np.uint32), np.array([b_bytes]))[0]) ^ b


def _ids_of(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to (digest, n_ids, crc) after a comparison with their digest."""
    for b in batches:
        digests, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
        crcs = []
        for digest, n, data in zip(digests, counts, b.column(2).to_pylist()):
            ids = _ids_of(data, n).tobytes()
            if hashlib.sha256(ids).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not hold what its digest says")
            crcs.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], ["digest", "n_ids", "crc"])


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks; a store without documents has none, and no folder of them either."""
    return spark.read.schema(f"{_CHUNKS}, kind string").parquet(f"{path}/content").where("kind = 'chunk'").select("digest", "n_ids", "data")


def _steps(recipes: DataFrame) -> DataFrame:
    """A row per document and chunk: seq, at, digest. Digests lie in a row of 32 bytes each."""
    at = F.sequence(F.lit(0), (F.octet_length("digests") / 32).cast("int") - 1)
    return recipes.where("octet_length(digests) > 0").select("seq", "n_tokens", "root", F.posexplode(F.transform(at, lambda i: F.col("digests").substr(i * 32 + 1, F.lit(32)))).alias("at", "digest"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, n, said, steps in order) to (seq, crc): a document's crc32 is the exclusive or of those of its chunks, each shifted by the bytes
    that follow it. Fails if the chunks do not give the document's length and root."""
    for b in batches:
        for low in range(0, b.num_rows, 1024):
            part = b.slice(low, 1024)
            steps = part.column(3)
            ends = steps.offsets.to_numpy() - steps.offsets[0].as_py()
            flat = steps.flatten()
            sizes, crcs, digests = flat.field("n_ids").to_numpy().astype(np.int64) * 4, flat.field("crc").to_numpy(), flat.field("digest").to_pylist()
            upto = np.concatenate([[0], np.cumsum(sizes)])
            n = np.diff(ends)
            shifted = crc32_shift(crcs, np.repeat(upto[ends[1:]], n) - upto[1:])
            joined = np.bitwise_xor.reduceat(shifted, ends[:-1])  # no document here is without chunks
            whole = upto[ends[1:]] - upto[ends[:-1]]
            for said_n, said, own, x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), whole.tolist(), ends.tolist(), ends[1:].tolist()):
                if own != 4 * said_n or merkle_root(digests[x:y]) != said:
                    raise ValueError("a document differs from its recipe")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(joined.astype(np.int64), pa.int64())], ["seq", "crc"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. Chunk bytes are read once and never shuffled: a chunk's crc32
    travels instead, and crc32 of a document follows from those of its chunks. Fails at the call if the recipes are not what the manifest
    says, and when read if a document's chunks do not give its length and Merkle root."""
    if not verify(spark, path):
        raise ValueError("the recipes differ from the manifest")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    chunks = _chunks(spark, path).mapInArrow(_checked, "digest binary, n_ids int, crc long")
    steps = _steps(recipes).join(chunks, "digest", "left")
    sums = steps.groupBy("seq").agg(F.first("n_tokens").alias("n"), F.first("root").alias("said"), F.array_sort(F.collect_list(F.struct("at", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.coalesce("crc", F.lit(0)).alias("crc"), "digest"))).alias("steps"))
    sums = sums.select("seq", "n", "said", "steps").mapInArrow(_joined, "seq long, crc long")

    totals = recipes.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))  # a row per file
    before = totals.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = recipes.select("part", "seq", "doc_id", "n_tokens", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("inside")).join(before, "part")
    return placed.join(sums, "seq", "left").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", F.coalesce("crc", F.lit(0)).cast("long").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids array<int>: the documents themselves, put together from their chunks."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    chunks = _chunks(spark, path)

    @F.pandas_udf("array<int>")
    def whole(steps: pd.Series) -> pd.Series:
        return steps.map(lambda row: np.concatenate([_ids_of(bytes(s["data"]), s["n_ids"]) for s in row]).astype(np.int32))

    docs = _steps(recipes).join(chunks, "digest").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("at", "n_ids", "data"))).alias("steps")).select("seq", whole("steps").alias("ids"))
    return recipes.join(docs, "seq", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the manifest still follows from the recipes."""
    told = {(r["level"], r["part"]): (r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()}
    return told == {(r["level"], r["part"]): (r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in manifest(spark, path).collect()}
