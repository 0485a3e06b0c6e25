"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For each prefix of a chunk the last token of its encoding is unique: it is the suffix piece t for which the last token p of the prefix
before t and t are compatible, that is, encoding the string p+t gives p, t again. An Aho-Corasick automaton over the pieces names the
suffix pieces at each position, longest first; the first compatible one enters the table; ids are then read off backwards.

Why pairs suffice: merging always takes the best score, ties to the left. Up to the first merge across a token border all tokens
evolve alone, and the first such merge would show in the pair at that border as well.

No piece continues past a blank (it may only begin with blanks), so a text falls into chunks "blanks + non-blanks" that encode alone.
Chunks repeat; each Python worker keeps a bounded memory of them, and the new chunks of a batch run through the table together, one
numpy step per position. Chunks with rare characters, or very long ones, take the same table one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm.common import id_and_text

BLANK = "▁"
#: Bytes of chunks that a task remembers; then it starts anew.
MEMORY = 80 << 20
#: Characters with a column of their own in the vectorised automaton; longest chunk that goes through it.
DENSE, LONGEST = 192, 48
_PAIRS = 1 << 21


class PieceModel:
    """Pieces, scores and byte ids of a SentencePiece BPE model with identity normalisation, and the automaton over the pieces."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation and blanks as prefixes is needed")
        self.prefix = BLANK if m.normalizer_spec.add_dummy_prefix else ""
        self.eos, self.unk = 2, 0
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        fallback = m.trainer_spec.byte_fallback
        for i, p in enumerate(m.pieces):
            self.surface.append(b"")
            if p.type == 1:
                if BLANK in p.piece.lstrip(BLANK):
                    raise ValueError("a piece continues past a blank")
                self.id[p.piece], self.score[p.piece] = i, p.score
                self.surface[i] = p.piece.replace(BLANK, " ").encode()
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unk = i
                self.surface[i] = b" \xe2\x81\x87 "
            elif p.type == 3 and p.piece == "</s>":
                self.eos = i
            elif p.type in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
        self.fallback, self.bytes = fallback, set(self.byte) if fallback else set()
        self.text = [""] * len(m.pieces)
        for s, i in self.id.items():
            self.text[i] = s
        self.longest = max(map(len, self.id), default=1)
        self.pair_memory: dict[tuple[int, int], bool] = {}
        self._automaton()

    def merge(self, s: str) -> list[str]:
        """The definition: join the neighbours whose union has the best score, leftmost first, while there are any."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the pieces a, b stay two when they meet. Ids from len(text) on stand for characters without a piece."""
        if a >= len(self.text) or b >= len(self.text):
            return True
        found = self.pair_memory.get((a, b))
        if found is None:
            if len(self.pair_memory) > 1_000_000:
                self.pair_memory.clear()
            x, y = self.text[a], self.text[b]
            found = self.pair_memory[a, b] = self.merge(x + y) == [x, y]
        return found

    def _automaton(self) -> None:
        # Only pieces that encode to themselves can be tokens.
        tokens = [s for s in self.id if len(s) == 1 or self.merge(s) == [s]]
        trie: list[dict[str, int]] = [{}]
        own, depth_of = [-1], [0]
        for s in tokens:
            at = 0
            for c in s:
                nxt = trie[at].get(c)
                if nxt is None:
                    nxt = trie[at][c] = len(trie)
                    trie.append({})
                    own.append(-1)
                    depth_of.append(depth_of[at] + 1)
                at = nxt
            own[at] = self.id[s]
        fail, out, order = [0] * len(trie), [-1] * len(trie), list(trie[0].values())
        shorter = {}
        for at in order:  # breadth first, as order grows
            if own[at] >= 0:
                shorter[own[at]] = out[fail[at]]
                out[at] = own[at]
            else:
                out[at] = out[fail[at]]
            for c, nxt in trie[at].items():
                f = fail[at]
                while f and c not in trie[f]:
                    f = fail[f]
                fail[nxt] = trie[f].get(c, 0) if at else 0
                order.append(nxt)
        self.trie, self.fail, self.out = trie, fail, out
        self.shorter = np.full(len(self.text), -1, np.int32)
        for t, s in shorter.items():
            self.shorter[t] = s
        self.length = np.array([len(s) or 1 for s in self.text], np.int32)

        many = Counter(c for s in tokens for c in s)
        plain = [c for c, _ in many.most_common() if c in self.id and ord(c) < 0x2600][:DENSE]
        self.column = np.full(0x110000, -1, np.int16)
        for k, c in enumerate(plain):
            self.column[ord(c)] = k
        for c in "\n\t\r":  # without a piece of their own: they end every match
            if c not in many:
                self.column[ord(c)] = DENSE
        goto = np.zeros((len(trie), DENSE + 1), np.uint16 if len(trie) < 1 << 16 else np.int32)
        for at in [0, *order]:
            if at:
                goto[at] = goto[fail[at]]
            for c, nxt in trie[at].items():
                if (k := self.column[ord(c)]) >= 0:
                    goto[at, k] = nxt
        goto[:, DENSE] = 0
        self.goto, self.out_of = goto, np.array(out, np.int32)
        self.pair_key = np.full(_PAIRS, -1, np.int64)
        self.pair_good = np.zeros(_PAIRS, bool)

    # One chunk
    def last_tokens(self, s: str) -> list[int]:
        """For each prefix of s its last token; len(text)+code point for a character without a piece."""
        last: list[int] = []
        state, none = 0, len(self.text)
        for i, c in enumerate(s):
            if c not in self.id:
                last.append(none + ord(c))
                state = 0
                continue
            while state and c not in self.trie[state]:
                state = self.fail[state]
            state = self.trie[state].get(c, 0)
            t = self.out[state]
            while True:
                before = i - self.length[t]
                if before < 0 or self.compatible(last[before], t):
                    break
                t = int(self.shorter[t])
            last.append(int(t))
        return last

    def ids_of_chunk(self, s: str) -> list[int]:
        last, out, at, none = self.last_tokens(s), [], len(s), len(self.text)
        while at:
            t = last[at - 1]
            if t >= none:
                out.extend(self.spelled(t - none)[::-1])
                at -= 1
            else:
                out.append(t)
                at -= int(self.length[t])
        return out[::-1]

    def spelled(self, code: int) -> list[int]:
        return [self.byte[b] for b in chr(code).encode()] if self.fallback else [self.unk]

    # Many chunks, position by position
    def _meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() for arrays, through a direct-mapped table."""
        key = a.astype(np.int64) << 17 | b
        slot = ((key * np.int64(-7046029254386353131)) >> 43) & (_PAIRS - 1)
        good = self.pair_good[slot]
        miss = self.pair_key[slot] != key
        if miss.any():
            new, back = np.unique(key[miss], return_inverse=True)
            said = np.array([self.compatible(int(k >> 17), int(k & 0x1FFFF)) for k in new], bool)
            good[miss] = said[back]
            at = ((new * np.int64(-7046029254386353131)) >> 43) & (_PAIRS - 1)
            self.pair_key[at], self.pair_good[at] = new, said
            # Two new keys may share a slot: keep key and answer of the same one.
            self.pair_good[at] = [self.compatible(int(k >> 17), int(k & 0x1FFFF)) if k >= 0 else False for k in self.pair_key[at]]
        return good

    def ids_of_chunks(self, chunks: list[str]) -> list[list[int]]:
        done: list[list[int] | None] = [None] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = self.column[codes]
        ends = np.cumsum(sizes)
        odd = np.zeros(len(chunks) + 1, np.int64)
        odd[1:] = np.cumsum(column < 0)[ends - 1] if len(codes) else 0
        slow = (np.diff(odd) > 0) | (sizes > LONGEST) | (sizes == 0)
        for i in np.flatnonzero(slow):
            done[i] = self.ids_of_chunk(chunks[i])
        fast = np.flatnonzero(~slow)
        fast = fast[np.argsort(-sizes[fast], kind="stable")]
        if not len(fast):
            return done  # type: ignore[return-value]
        n, begin, none = sizes[fast], (ends - sizes)[fast], len(self.text)
        last = np.zeros((int(n[0]), len(fast)), np.int32)
        state = np.zeros(len(fast), np.int32)
        rows = np.arange(len(fast))
        for t in range(int(n[0])):
            live = int(np.searchsorted(-n, -t, "left"))  # the longest stand first
            col = column[begin[:live] + t]
            state[:live] = self.goto[state[:live], col]
            token = self.out_of[state[:live]]
            bare = token < 0
            todo = np.flatnonzero(~bare)
            while len(todo):
                size = self.length[token[todo]]
                inner = size <= t
                todo = todo[inner]
                if not len(todo):
                    break
                bad = ~self._meet(last[t - size[inner], todo], token[todo])
                todo = todo[bad]
                token[todo] = self.shorter[token[todo]]
            token[bare] = none  # spelled out on the way back
            last[t, :live] = token
        at = n.copy()
        turns: list[tuple[np.ndarray, np.ndarray]] = []
        live = rows
        while len(live):
            token = last[at[live] - 1, live]
            turns.append((live, np.where(token == none, -(codes[begin[live] + at[live] - 1].astype(np.int64)) - 1, token)))
            at[live] -= np.where(token == none, 1, self.length[np.minimum(token, none - 1)])
            live = live[at[live] > 0]
        who = np.concatenate([x for x, _ in turns])[::-1]
        what = np.concatenate([y for _, y in turns])[::-1]
        order = np.argsort(who, kind="stable")
        flat, counts = what[order].tolist(), np.bincount(who, minlength=len(fast))
        lost, a = set(np.flatnonzero(np.bincount(who, weights=what < 0, minlength=len(fast))).tolist()), 0
        for k, m in enumerate(counts.tolist()):
            ids = flat[a : a + m]
            a += m
            done[fast[k]] = [y for x in ids for y in (self.spelled(-x - 1) if x < 0 else (x,))] if k in lost else ids
        return done  # type: ignore[return-value]

    # Whole texts
    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, " ")
        s = (" " if self.prefix else "") + text
        return re.findall(" +[^ ]*|[^ ]+", s)

    def encode(self, text: str, eos: bool = False) -> list[int]:
        out = [i for c in self.ids_of_chunks([c.replace(" ", BLANK) for c in self.chunks(text)]) for i in c]
        return out + [self.eos] * eos

    def decode(self, ids: list[int]) -> str:
        """Bytes of the pieces in a row; a byte run that is no UTF-8 gives U+FFFD per byte; the blank with which the first
        piece begins goes, as the dummy prefix put it there (a blank spelled as a byte stays)."""
        said = self._said(ids)
        first = next((i for i in ids if self.surface[i]), None)
        return self._unprefixed(said) if first is not None and self.text[first].startswith(BLANK) else said

    def _unprefixed(self, text: str) -> str:
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _said(self, ids: list[int]) -> str:
        parts = [self.surface[i] for i in ids]
        try:
            if b"" not in parts:
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for i in [*ids, -1]:  # byte ids in a row, which no other id may interrupt, are read together
            if i in self.bytes:
                run += self.surface[i]
            else:
                out.extend(x if isinstance(x, str) else "\ufffd" for x in _runs(run))
                run = b""
                out.append(self.surface[i].decode() if i >= 0 else "")
        return "".join(out)


def _runs(raw: bytes) -> Iterator[str | bytes]:
    """Valid UTF-8 as text; single bytes that are not."""
    at = 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[at : at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield raw[at : at + 1]
            at += 1


_models: dict[bytes, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    key = hashlib.sha256(proto).digest()
    if key not in _models:
        _models[key] = PieceModel(proto)
    return _models[key]


class _Memory(dict):
    """Chunk to its ids as decimal text; chunks that do not decode to themselves are in odd, with what they decode to."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model, self.odd, self.held = model, {}, 0

    def learn(self, chunks: list[str]) -> None:
        if self.held > MEMORY:
            self.clear()
            self.odd.clear()
            self.held = 0
        for c, ids in zip(chunks, self.model.ids_of_chunks([c.replace(" ", BLANK) for c in chunks])):
            said = self[c] = " ".join(map(str, ids))
            self.held += len(c) + len(said) + 230
            decoded = self.model._said(ids)
            if decoded != c:
                self.odd[c] = decoded
                self.held += len(c) + 200


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (with the end id), ids_sha256 (of the decimal ids joined by a blank), decoded_sha256 (of the decoded text).

    A null text counts as empty: its ids are the end id alone and it decodes to the empty text. Ids null or repeated pass through, a row
    for a row. An empty table gives an empty result; other columns are ignored. The model file is read on the driver and travels with the
    task (half a megabyte)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        memory = _Memory(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                split = [model.chunks(t) for t in part.column(1).to_pylist()]
                new = list({c for s in split for c in s if c not in memory})
                for k in range(0, len(new), 100_000):
                    memory.learn(new[k : k + 100_000])
                rows = []
                for s in split:
                    own, odd = memory, memory.odd
                    try:
                        ids = " ".join([*map(own.__getitem__, s), str(model.eos)])
                    except KeyError:  # forgotten meanwhile
                        own = _Memory(model)
                        own.learn(list(dict.fromkeys(s)))
                        ids, odd = " ".join([*map(own.__getitem__, s), str(model.eos)]), own.odd
                    said = model._unprefixed("".join([odd.get(c, c) for c in s] if odd else s))
                    rows.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(spark: SparkSession, text: Column, model_path: str) -> Column:
    """The ids of a text column as array<int>, with the end id."""
    shared = spark.sparkContext.broadcast(model_bytes(model_path))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        model = _model(shared.value)
        return texts.map(lambda t: model.encode(t or "", True))

    return ids(text)


def decode_column(spark: SparkSession, ids: Column, model_path: str) -> Column:
    """The text of an id array; a null array gives the empty text."""
    shared = spark.sparkContext.broadcast(model_bytes(model_path))

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        model = _model(shared.value)
        return rows.map(lambda x: "" if x is None else model.decode([int(i) for i in x]))

    return text(ids)
