"""Toxicity of whole texts by noisy-channel deobfuscation and a sparse classifier on the restored words.

A token that looks disguised (leetspeak, letters apart, letters repeated, look-alike scripts) becomes a lattice: each run of equal
characters offers the letters it may stand for, with a channel cost. Viterbi finds the letters that a character trigram model, counted
over all training texts, and the channel together find likeliest; a decoding no better than chance is thrown away. Words as written and
words restored give features (the word, and its beginnings of 4 to 7 letters, which inflections share); an L1 logistic regression with
weights at or above zero, fitted to a bounded sample of labelled rows, picks the features that mark toxic texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.common import held_out, id_and_text, remove, written

#: Labelled rows that the classifier is fitted to, at most; features that it may choose from.
SAMPLE, FEATURES = 20_000, 3_000
THRESHOLD = 0.7
#: Bytes of tokens that a task remembers.
MEMORY = 48 << 20

# What a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = str.maketrans("аеорсухкмтвніјѕԁαεορνικτυχ", "aeopcyxkmtbhijsdaeopviktux")
SEPARATORS = frozenset(".-_*'·~^/\\,")
ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))

WORDS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1*", re.S)
_EDGE = re.compile(r"[^\w@$!]+|[@$!]{2,}")
_LONG_RUN, _DOUBLE = re.compile(r"([^\W\d_])\1\1"), re.compile(r"([^\W\d_])\1")
_MARK = re.compile(r"[0-9@$!|+(€£¡]")
_APART = re.compile(r"[^\W\d_][.\-_*'·~^/\\,]+[^\W\d_]")
_SPELLED = re.compile(r"(?<!\S)(?!_)[\w@$!|+](?:[ .\-_*]++[\w@$!|+]){3,}(?!\S)")
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ӿ]")


def _class(c: str) -> int:
    """0 for a border, 1 to 26 for a to z, 27 for any other letter; accents are dropped by decomposition."""
    if "a" <= c <= "z":
        return ord(c) - 96
    import unicodedata

    base = unicodedata.normalize("NFD", c)[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 27


class CharacterModel:
    """Trigram model over 28 classes, interpolated with bigrams, from counts by (a, b, c)."""

    def __init__(self, counts: dict[int, int]) -> None:
        n = np.zeros((28, 28, 28))
        for k, v in counts.items():
            n[k // 784, k // 28 % 28, k % 28] = v
        two = n.sum(0)
        one = two.sum(0) + 0.5
        one /= one.sum()
        two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
        self.log = np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5))
        self.table = self.log.tolist()
        self._classes: dict[str, int] = {}

    def of(self, c: str) -> int:
        k = self._classes.get(c)
        if k is None:
            k = self._classes[c] = _class(c)
        return k

    def decode(self, seen: str) -> tuple[str, float]:
        """The likeliest letters behind the characters, and their model log probability per letter (border included)."""
        paths: dict[tuple[int, int], tuple] = {(0, 0): (0.0, 0.0, None)}  # total, own, letters as a chain from the last ones back
        for run in _RUN.finditer(seen):
            options = _options(run.group(1), len(run.group(0)))
            new: dict[tuple[int, int], tuple] = {}
            for (a, b), (total, own, chain) in paths.items():
                for letters, cost in options:
                    x, y, add = a, b, 0.0
                    for c in letters:
                        z = self.of(c)
                        add += self.table[x][y][z]
                        x, y = y, z
                    old = new.get((x, y))
                    if old is None or total + cost + add > old[0]:
                        new[x, y] = (total + cost + add, own + add, (letters, chain) if letters else chain)
            paths = new
        (a, b), (total, own, chain) = max(paths.items(), key=lambda p: (p[1][0] + self.table[p[0][0]][p[0][1]][0], p[0]))
        parts = []
        while chain:
            parts.append(chain[0])
            chain = chain[1]
        text = "".join(reversed(parts))
        return text, (own + self.table[a][b][0]) / (len(text) + 1)


def _options(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, with log costs of the channel."""
    if c in LEET:
        out = [(x * k, -1.0 - 0.7 * (k - 1) - 0.3 * (n > k)) for x in LEET[c] for k in ((1, 2) if n > 1 else (1,))]
        return [*out, ("", -6.0)] if not c.isalnum() else out
    if c.isalpha():
        return [(c, 0.0)] if n == 1 else [(c, -0.7 if n == 2 else -0.3), (c + c, -0.2 if n == 2 else -1.0)]
    return [("", -0.5 if c in SEPARATORS or c == " " else -2.0)]


def disguised(token: str) -> str | None:
    """The part of a token that looks like a word in disguise; None for ordinary tokens."""
    before, after = _EDGE.match(token), _EDGE.match(token[::-1])
    core = token[before.end() if before else 0 : len(token) - after.end() if after else None]
    if len(core) < 3:
        return None
    if core.isalpha():
        odd = _LONG_RUN.search(core) or len(_DOUBLE.findall(core)) >= 3 or (_FOREIGN.search(core) and re.search("[a-z]", core))
    else:
        odd = (_MARK.search(core) and WORDS.search(core)) or _APART.search(core)
    return core.translate(LOOKALIKE) if odd else None


class Restorer:
    """Words of a text, as written and as restored, remembering tokens."""

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.floor = -math.log(27) * 1.02

    def restore(self, span: str) -> str | None:
        letters, per_letter = self.model.decode(span)
        return letters if len(letters) > 3 and per_letter > self.floor else None

    def words_of(self, token: str) -> list[str]:
        out = WORDS.findall(token)
        span = disguised(token)
        if span:
            letters = self.restore(span)
            if letters:
                out.append(letters)
        return out

    def spelled(self, text: str) -> Iterator[str]:
        """Words whose letters stand apart, as in `a b c d`."""
        for m in _SPELLED.finditer(text):
            letters = self.restore(m.group(0).replace(" ", ""))
            if letters:
                yield letters


def tokens_of(text: str) -> list[str]:
    return text.lower().translate(ZERO_WIDTH).split() if not text.isascii() else text.lower().split()


def features(word: str) -> list[str]:
    if len(word) < 4:
        return []
    return ["=" + word, *[word[:k] for k in range(4, min(8, len(word)))]]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter class trigrams, borders included, over a task's texts."""
    words: Counter[str] = Counter()
    total = np.zeros(28**3, np.int64)
    classes: dict[str, int] = {}

    def flush() -> None:
        by: dict[int, int] = {}
        for token, n in words.items():
            for w in WORDS.findall(token):
                ks = [0, 0]
                for c in w:
                    k = classes.get(c)
                    if k is None:
                        k = classes[c] = _class(c)
                    ks.append(k)
                ks.append(0)
                for a, b, c in zip(ks, ks[1:], ks[2:]):
                    key = a * 784 + b * 28 + c
                    by[key] = by.get(key, 0) + n
        words.clear()
        for k, n in by.items():
            total[k] += n

    held = 0
    for b in batches:
        for text in b.column(0).to_pylist():
            tokens, before = text.lower().split(), len(words)
            words.update(tokens)
            held += (len(words) - before) * 120 + (len(text) if len(words) - before > len(tokens) // 2 else 0)
            if held > MEMORY:
                flush()
                held = 0
    flush()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["key", "n"])


def _extract(shared):
    """Labelled texts to (doc_id, y, features), each feature once a text, and a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(CharacterModel(shared.value))
        for b in batches:
            rows = []
            for text in b.column(2).to_pylist():
                words = {w for t in set(tokens_of(text)) for w in restorer.words_of(t)} | set(restorer.spelled(text.lower()))
                rows.append((sorted({f for w in words for f in features(w)}), hashlib.sha256(text.encode()).digest()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in rows], pa.list_(pa.string())), pa.array([y for _, y in rows], pa.binary())], ["doc_id", "y", "features", "digest"])

    return run


class Classifier:
    """Feature weights and a bias."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, found: Iterable[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[f] for f in found)))))


def fit_l1(rows: list[tuple[int, list[int]]], names: list[str], penalty: float = 0.03, steps: int = 400) -> Classifier:
    """Logistic regression with weights >= 0 and an L1 penalty, by accelerated proximal gradient over sparse rows."""
    y = np.array([r[0] for r in rows], float)
    n, toxic = len(y), float(y.sum())
    if not n or toxic in (0, n):
        return Classifier({}, -10.0 if not toxic else 10.0)
    row = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    col = np.array([j for r in rows for j in r[1]], int)
    times = lambda w: np.bincount(row, weights=w[col], minlength=n)
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(names))
    x = np.ones(len(names))
    for _ in range(30):  # largest eigenvalue of X'X
        x = back(times(x))
        size = np.linalg.norm(x) or 1.0
        x /= size
    rate = 1 / (0.25 * size * 1.05 + 1)
    w, v, t, b = np.zeros(len(names)), np.zeros(len(names)), 1.0, math.log(toxic / (n - toxic))
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(times(v) + b))) - y
        new = np.maximum(v - rate * (back(r) + penalty), 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        b -= 2 * r.mean()
    return Classifier({names[j]: float(w[j]) for j in np.flatnonzero(w > 1e-6)}, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict[int, int], Classifier]:
    """The character counts of all texts outside the held-out third, and the classifier of at most `sample` labelled ones of them (lowest
    hashes of doc_id; exact copies with the same label count once)."""
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).where(~held_out(F.col("doc_id"), 3, 1))
    counts = {r["key"]: r["n"] for r in base.select("text").mapInArrow(_trigrams, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # 28^3 rows at most
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = spark.sparkContext.broadcast(counts)
    rows = base.join(F.broadcast(marked), "doc_id").select("doc_id", "y", "text").mapInArrow(_extract(shared), "doc_id long, y int, features array<string>, digest binary")
    # Rows of one digest have the same features, so it does not matter which of them stays.
    rows = written(rows.select("y", "features", "digest").dropDuplicates(["digest", "y"]), "toxic-rows")
    try:
        size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        toxic, clean = size.get(1, 0), size.get(0, 0)
        if not toxic or not clean:
            return counts, fit_l1([(1, [])] * toxic + [(0, [])] * clean, [])
        expected = (F.col("a") + F.col("b")) * (toxic / (toxic + clean))
        by = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        chosen = by.where((F.col("a") >= 2) & (F.col("a") / toxic > 3 * (F.col("b") + 0.5) / clean)).orderBy(((expected - F.col("a")) / F.sqrt(expected + 1)), "f").limit(FEATURES).select("f")
        names = [r["f"] for r in chosen.collect()]
        at = {f: j for j, f in enumerate(names)}
        known = F.filter("features", lambda f: f.isin(names)) if len(names) < 50 else F.array_intersect("features", F.array(*[F.lit(f) for f in names]))
        fitted = fit_l1([(r["y"], [at[f] for f in r["k"]]) for r in rows.select("y", known.alias("k")).orderBy("digest", "y").collect()], names)
    finally:
        remove(rows)
    return counts, fitted


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, a row for a row of docs. Training happens at the call, scoring when the result is read.

    A null or empty text has no features and gets the score of the bias. Ids null or repeated are scored row by row. Without labels of both
    kinds all scores are near the label there is (0 without any). Labels repeated for an id count as the largest. An empty table gives an empty
    result. Other columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col)
    scored = scored_rows(base, train(docs, labels, id_col, text_col, label_col, sample))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def scored_rows(docs: DataFrame, trained: tuple[dict[int, int], Classifier], text_col: str = "text") -> DataFrame:
    """docs as they are, with score and n_hits (columns of these names are replaced)."""
    counts, fitted = trained
    shared = docs.sparkSession.sparkContext.broadcast((counts, fitted.weights, fitted.bias))
    kept = [c for c in docs.columns if c not in ("score", "n_hits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, bias = shared.value
        restorer, fitted, memory, held = Restorer(CharacterModel(counts)), Classifier(weights, bias), {}, 0
        hits = lambda words: tuple(dict.fromkeys(f for w in words for f in features(w) if f in weights))
        for b in batches:
            scores, numbers = [], []
            for text in b.column(text_col):
                text = text.as_py() or ""
                tokens = set(tokens_of(text))
                if held > MEMORY:
                    memory.clear()
                    held = 0
                for t in tokens.difference(memory):
                    memory[t] = hits(restorer.words_of(t))
                    held += len(t) + 150
                found = {f for t in tokens if (h := memory[t]) for f in h}
                found.update(hits(restorer.spelled(text.lower())))
                scores.append(fitted.score(sorted(found)))
                numbers.append(len(found))
            yield pa.RecordBatch.from_arrays([*b.select(kept).columns, pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())], [*kept, "score", "n_hits"])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())])
    return docs.select(*kept).mapInArrow(run, schema)
