"""Scores of whole texts under two language models learned from the training part of the corpus.

Base: smoothed word unigrams. Model: a causal self-attention model (see attention) over the subword ids of a text's words and one end id.

The base score joins counts of all words: those of the most frequent words (HEAD at most) travel to the tasks, a text's other words meet their counts
by a join on the word, so the size of the head changes the cost and no score. The same reading writes each text's subword ids, which training
and scoring read; texts are encoded once. The attention model starts from the counts of all ids over all
training texts. It is trained on all training texts, each whole, in ROUNDS rounds: a round reads one in PARTS of them, dealt by a hash of the
id. The texts of a round are dealt evenly to tasks of about SHARE targets. Each trains from the round's parameters over its own texts, and
the parameters of all tasks, weighed by the targets they saw, give the next round's. Parameters are a few megabytes whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm import attention
from dossierlake.llm.common import held_out, id_and_text, one_thread, remove, written
from dossierlake.llm.token_store import BYTE_LEVEL_SPLIT

#: Frequent words whose counts travel to the tasks; rounds of training and parts of the training texts (a part a round); Adagrad's rate.
HEAD, ROUNDS, PARTS, RATE = 200_000, 4, 4, 0.1
#: Bytes of words that a task remembers; letters of a word that are encoded together; bytes of texts that are scored together.
HELD, PIECE, TOGETHER = 64 << 20, 200, 1 << 20
#: Targets that a task of a round trains on, and blocks of them an update.
SHARE, UPDATE = 5_000_000, 512
#: Numbers in a row of parameters.
_ROW = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.lower().split()


_bpe: dict[bytes, object] = {}


def byte_bpe(ranks: bytes):
    """The byte-level BPE that a file of ranks defines."""
    import tiktoken

    key = hashlib.sha256(ranks).digest()
    if key not in _bpe:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _bpe[key] = tiktoken.Encoding("lm", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=table, special_tokens={})
    return _bpe[key]


class Words(dict):
    """Word to its number, and the subword ids by number. New words get the next number; learn() encodes them."""

    def __init__(self, bpe) -> None:
        super().__init__()
        self.bpe, self.names, self.held, self.line = bpe, [], 0, bpe.encode_single_token(b"\n")
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.known, self.used = np.zeros(4096, np.int32), 0, 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        self.held += len(word) + 150
        return n

    def learn(self) -> None:
        """Encodes the words numbered since the last call. Words without white space of any kind go through the library in one text, a
        line each: the line feeds between them are tokens of their own."""
        new = [" " + w.decode("utf-8", "replace") for w in self.names[self.known :]]
        if not new:
            return
        plain = [s for s in new if len(s) <= PIECE and s.split() == [s[1:]]]
        flat = self.bpe.encode_to_numpy("\n".join([*plain, ""]), disallowed_special=()).astype(np.int32)
        ends = np.flatnonzero(flat == self.line)
        sizes, ids = np.diff(ends, prepend=-1) - 1, flat[flat != self.line]
        if len(plain) < len(new):
            cut, whole = iter(np.split(ids, np.cumsum(sizes)[:-1])), []
            for s in new:
                if len(s) <= PIECE and s.split() == [s[1:]]:
                    whole.append(next(cut).tolist())
                else:  # in pieces, as merging takes the square of a length
                    whole.append([i for a in range(0, len(s), PIECE) for i in self.bpe.encode_ordinary(s[a : a + PIECE])])
            sizes, ids = [len(x) for x in whole], [i for x in whole for i in x]
        self.extend(sizes, ids)

    def extend(self, sizes: list[int] | np.ndarray, ids: list[int] | np.ndarray) -> None:
        sizes, ids = np.asarray(sizes, np.int32), np.asarray(ids, np.int32)
        if self.known + len(sizes) > len(self.begin):
            more = max(len(self.begin), len(sizes))
            self.begin, self.size = np.append(self.begin, np.zeros(more, np.int64)), np.append(self.size, np.zeros(more, np.int32))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32))
        at = slice(self.known, self.known + len(sizes))
        self.begin[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.known, self.used = self.known + len(sizes), self.used + len(ids)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.learn()
        return out

    def streams(self, numbers: np.ndarray, n_words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of n_words words in a row, an end id after each, and how many each has."""
        sizes = self.size.take(numbers)
        cut = np.cumsum(n_words)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        n = upto[cut] - upto[cut - n_words] + 1
        out = np.empty(int(upto[-1]) + len(n), np.int32)
        shift = np.repeat(np.arange(len(n)), n_words)  # as many end ids stand before a word as texts before its own
        to = upto[:-1] + shift
        step = np.arange(int(upto[-1])) - np.repeat(upto[:-1], sizes)
        out[np.repeat(to, sizes) + step] = self.ids.take(np.repeat(self.begin.take(numbers), sizes) + step)
        out[np.cumsum(n) - 1] = end
        return out, n


def _groups(sizes: list[int] | np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of these sizes that are worked on together."""
    low = size = 0
    for k, own in enumerate(sizes):
        size += own
        if size >= TOGETHER:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def id_type(end: int) -> np.dtype:
    """How the ids of streams are kept."""
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def _packed(flat: np.ndarray, n: np.ndarray, end: int) -> pa.Array:
    """Streams in a row to one binary value each."""
    kind = id_type(end)
    at = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.astype(kind))])


def _unpacked(column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Binary values to streams in a row and how many ids each has, some texts at a time."""
    if not len(column):
        return
    kind, column = id_type(end), column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    for low, high in _groups(np.diff(at)):
        flat = np.frombuffer(column.buffers()[2], kind, int(at[high] - at[low]) // kind.itemsize, int(at[low]))
        yield flat.astype(np.int32), np.diff(at[low : high + 1]) // kind.itemsize


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words over the texts learned from; words of the others come with 0."""
    held: Counter[bytes] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
        held.clear()

    size = 0
    for b in batches:
        for text, learned in zip(b.column(0), b.column(1).to_pylist()):
            text = text.as_py()
            words, before = words_of(text), len(held)
            if learned:
                held.update(words)
            else:
                for w in words:
                    held[w] += 0
            size += (len(held) - before) * 120 + (len(text) if len(held) - before > len(words) // 2 else 0)
            if size > HELD:
                yield from rows()
                size = 0
    yield from rows()


def _id_counts(ranks, size: int):
    """(word, c) to (id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bpe = np.zeros(size, np.int64), byte_bpe(ranks.value)
        for b in batches:
            words = Words(bpe)
            numbers = words.numbers(b.column(0).to_pylist())
            np.add.at(total, words.ids[: words.used], np.repeat(b.column(1).to_numpy(), words.size[: len(numbers)]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


_PARAMS = "block int, weight double, data binary"


def _flat(p: attention.Params) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in p.values()])


def _shaped(flat: np.ndarray, like: attention.Params) -> attention.Params:
    out, at = {}, 0
    for name, v in like.items():
        out[name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _training(shared, end: int, rate: float):
    """Streams to the parameters that a task ends with, in rows, with the number of targets it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        p, counts = shared.value
        trainer = None
        for b in batches:
            for flat, n in _unpacked(b.column(0), end):
                if trainer is None:
                    trainer = attention.Trainer(p, attention.Classes(counts), rate, UPDATE)
                every = attention.blocks(n)
                for at in range(0, len(every[0]), UPDATE):
                    trainer.add(*attention.windows_of(flat, n, end, np.arange(at, min(at + UPDATE, len(every[0]))), every))
        if trainer is not None:
            trainer.step()
            last = _flat(trainer.p)
            rows = [(k, float(trainer.targets), last[a : a + _ROW].tobytes()) for k, a in enumerate(range(0, len(last), _ROW))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.binary()))], ["block", "weight", "data"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parameters to a row a block, their weighted mean. A task holds a sum for each of its blocks, however many rows come."""
    sums: dict[int, list] = {}
    for b in batches:
        for k, weight, data in zip(*[c.to_pylist() for c in b.columns]):
            own = sums.setdefault(k, [0.0, 0.0])
            own[0] += weight
            own[1] = own[1] + weight * np.frombuffer(data, np.float32).astype(float)
    rows = [(k, w, (s / w).astype(np.float32).tobytes()) for k, (w, s) in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.binary()))], ["block", "weight", "data"])


def trained(spark: SparkSession, streams: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, parts: int = PARTS, rate: float = RATE, share: int = SHARE) -> tuple[attention.Params, attention.Classes]:
    """The model of streams (turn: 0 to parts - 1, ids: see id_type, an end id last). counts: of each id over all of them, the end id last.
    A round reads the turns that are its own number modulo rounds, so each stream is learned from once, however many parts there are. A round
    without streams changes nothing."""
    classes = attention.Classes(counts)
    p, end = attention.start(counts, classes), len(counts) - 1
    for turn in range(rounds):
        # A task trains on about SHARE targets, so that the parameters which tasks hand on stay in proportion to the texts, however these
        # lie in partitions.
        texts = streams.where(F.col("turn") % rounds == turn).select("ids").repartition(max(1, math.ceil(counts.sum() / min(parts, rounds) / share)))
        shared = spark.sparkContext.broadcast((p, counts))
        # Means of means: of a block's rows a task reads those of one task in 16, then the 16 means.
        rows = texts.mapInArrow(_training(shared, end, rate), _PARAMS).select("*", (F.spark_partition_id() % 16).alias("salt"))
        rows = rows.repartition("block", "salt").drop("salt").mapInArrow(_averaged, _PARAMS).repartition(16, "block").mapInArrow(_averaged, _PARAMS)
        found = sorted((r["block"], bytes(r["data"])) for r in rows.collect())  # the parameters once, whatever the input
        if found:
            p = _shaped(np.frombuffer(b"".join(data for _, data in found), np.float32), p)
        shared.unpersist()
    return p, classes


_ROWS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()),
])
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int64()]
#: Turns of texts that are held out, and of rows of words.
_HELD_OUT, _WORDS = -1, -2


def _reading(ranks, shared):
    """Texts to a row each, with their ids and the base score of their words in the head, and a row for each of their distinct words outside it."""

    def table(columns: dict[str, object], n: int) -> pa.RecordBatch:
        of = lambda c, t: c if isinstance(c, pa.Array) else pa.array(c, t)
        return pa.RecordBatch.from_arrays([of(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in zip(_ROWS.fieldNames(), _ARROW)], _ROWS.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_counts, sizes, ids, ends, end, floor = shared.value
        bpe = byte_bpe(ranks.value)
        terms = np.log10(head_counts + 0.1) - floor
        end_term = math.log10(ends + 0.1) - floor

        def fresh() -> Words:
            words = Words(bpe)
            words.names = list(head)
            words.update(zip(words.names, range(len(head))))
            words.extend(sizes, ids)
            return words

        words = fresh()
        for b in batches:
            rows, doc_ids = b.column(0).to_numpy(), b.column(1).to_pylist()
            texts = [t.as_py() for t in b.column(2)]
            for low, high in _groups(list(map(len, texts))):
                if words.held > HELD:
                    words = fresh()
                split = [words_of(t) for t in texts[low:high]]
                n_words = np.fromiter(map(len, split), np.int64, len(split))
                numbers = words.numbers([w for s in split for w in s])
                own = np.repeat(np.arange(len(split)), n_words)
                inside = numbers < len(head)
                base = np.bincount(own[inside], weights=terms.take(numbers[inside]), minlength=len(split)) + end_term
                known = np.bincount(own[inside], weights=head_counts.take(numbers[inside]) > 0, minlength=len(split)).astype(np.int64) + int(ends > 0)
                packed = _packed(*words.streams(numbers, n_words, end), end)
                yield table({"row": rows[low:high], "doc_id": doc_ids[low:high], "n_tokens": n_words + 1, "n_known": known, "base_score": base, "ids": packed}, high - low)
                outside = ~inside
                if outside.any():
                    key, n = np.unique(own[outside] << 32 | numbers[outside], return_counts=True)
                    names = words.names
                    yield table({"row": rows[low:high].take(key >> 32), "word": [names[i] for i in (key & 0xFFFFFFFF).tolist()], "n": n}, len(key))

    return run


def _scoring(shared):
    """Rows of texts with the score of their ids, the last column, in the ids' place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        p, counts = shared.value
        scorer, end = attention.Scorer(p, attention.Classes(counts)), len(counts) - 1
        for b in batches:
            scores = [scorer.log_probabilities(flat, n) / math.log(10) for flat, n in _unpacked(b.column(b.num_columns - 1), end)]
            own = pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], own], [*b.schema.names[:-1], "score"])

    return run


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, `most` at most: those from a step of counts on that a histogram names, so that no task sorts them."""
    step = F.floor(F.log(F.col("c")) * 16)
    seen = counts.where("c > 0")
    total, least = 0, None
    for at, n in sorted(seen.groupBy(step).count().collect(), reverse=True):  # some hundred steps, whatever the counts
        total += n
        if total > most:
            break
        least = at
    return seen.where(step >= least if least is not None else F.lit(False))


def lm_score(docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for a row of docs. ranks: a file of byte-level BPE ranks.

    Texts whose crc32(doc_id as text) mod 10 is 0 are held out, all others are learned from. A null or empty text is the end token alone. A
    null doc_id counts as the empty text in the crc. Without training texts all counts are 0: base scores follow the formula (0.1/0.1 a token)
    and the model is the untrained one. Rows that repeat an id are scored each. An empty table gives an empty result; other columns are
    ignored. Words of over PIECE letters are encoded in pieces. The model's last digits depend on how the texts lie in partitions, as each
    task of a round trains on its own.
    """
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col)
    learned = ~held_out(F.col("doc_id"), 10, 0)
    train = base.where(learned)
    marked = base.select(F.col("text").cast("binary").alias("text"), learned.alias("learned"))
    counts = written(marked.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = train.count()
    total, kinds = words + ends, distinct + (ends > 0)
    floor = math.log10(total + 0.1 * (kinds + 1))

    shared_ranks, bpe = spark.sparkContext.broadcast(ranks), byte_bpe(ranks)
    by_id = np.zeros(bpe.n_vocab + 1)
    for r in counts.where("c > 0").mapInArrow(_id_counts(shared_ranks, bpe.n_vocab), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id of the vocabulary
        by_id[r["id"]] = r["n"]
    by_id[-1] = ends

    top = _frequent(counts.where(F.octet_length("word") <= PIECE), head).toArrow().sort_by("word")
    names, own = top.column("word").to_pylist(), Words(bpe)
    own.numbers(names)
    shared = spark.sparkContext.broadcast((names, top.column("c").to_numpy().astype(float), own.size[: own.known].copy(), own.ids[: own.used].copy(), ends, bpe.n_vocab, floor))
    numbered = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    dealt = F.when(F.col("word").isNotNull(), _WORDS).when(held_out(F.col("doc_id"), 10, 0), _HELD_OUT).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("lm")), F.lit(parts)))
    # Not partitioned by turn, as that would sort the ids in memory.
    rows = written(numbered.mapInArrow(_reading(shared_ranks, shared), _ROWS).withColumn("turn", dealt.cast("long")), "lm-rows")
    shared.unpersist()
    term = F.col("n") * (F.log10(F.col("c") + F.lit(0.1)) - F.lit(floor))
    tails = rows.where(F.col("turn") == _WORDS).select("row", "word", "n").join(counts, "word")
    tails = written(tails.groupBy("row").agg(F.sum(term).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known")), "lm-tails")
    remove(counts)

    p, _ = trained(spark, rows.where("turn >= 0"), by_id, rounds, parts)
    shared = spark.sparkContext.broadcast((p, by_id))
    texts = rows.where(F.col("turn") != _WORDS).select("row", "doc_id", "n_tokens", "n_known", "base_score", "ids")
    scored = written(texts.mapInArrow(_scoring(shared), "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"), "lm-scores")
    shared.unpersist()
    remove(rows)
    each = scored.join(tails, "row", "left")
    return each.select(
        "doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail", F.lit(0.0))).alias("base_score"), "score",
    )
