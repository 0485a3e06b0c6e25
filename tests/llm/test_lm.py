import math
import zlib
from collections import Counter

import numpy as np
import pytest
from dossierlake.llm import attention, lm_score
from odd_cases import ODD

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def _model(size=40, seed=1, classes=6):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(0, 500, size).astype(float))
    own = attention.Classes(counts, classes)
    p = attention.start(counts, own, width=4)
    return {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in p.items()}, own


def _plain(p, classes, stream, end):
    """One target after the other, with the exact exponential."""
    p = {k: v.astype(float) for k, v in p.items()}
    total, inputs = 0.0, [end, *stream[:-1]]
    for t, y in enumerate(stream):
        low = max(0, (t // attention.STRIDE - 1) * attention.STRIDE)
        q = p["e"][inputs[t]] @ p["q"] / 2.0
        a = np.array([math.exp(q @ (p["e"][inputs[j]] @ p["k"]) + p["r"][t - j]) for j in range(low, t + 1)])
        z = sum(w * (p["e"][inputs[j]] @ p["v"]) for w, j in zip(a / a.sum(), range(low, t + 1))) + p["e"][inputs[t]] @ p["s"]
        c = classes.of[y]
        x = np.exp(z @ p["c"] + p["cb"])
        rows = slice(classes.begin[c], classes.begin[c + 1])
        inner = np.exp(p["o"][rows] @ z + p["ob"][rows])
        total += math.log(x[c] / x.sum()) + math.log(inner[classes.place[y]] / inner.sum())
    return total


def test_batched_scores_equal_a_loop_over_targets():
    p, classes = _model()
    rng = np.random.default_rng(2)
    streams = [np.append(rng.integers(0, 39, n), 39) for n in (0, 1, 15, 16, 17, 31, 32, 33, 200)]
    n = np.array(list(map(len, streams)))
    scorer = attention.Scorer(p, classes)
    together = scorer.log_probabilities(np.concatenate(streams), n)
    for at_once, held in ((1, 1), (2, 3), (5, 1)):
        assert np.allclose(scorer.log_probabilities(np.concatenate(streams), n, at_once, held), together, rtol=1e-5)
    want = [_plain(p, classes, s.tolist(), 39) for s in streams]
    assert np.allclose(together, want, atol=0.02 * n.max(), rtol=0.03)  # the exponential of the scorer is within 3 %
    assert len(scorer.log_probabilities(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_probabilities_add_to_one():
    p, classes = _model()
    scorer = attention.Scorer(p, classes)
    for context in ([], [3, 5], list(range(20))):
        p_of = [scorer.log_probabilities(np.array([*context, y]), np.array([len(context) + 1]))[0] for y in range(40)]
        before = scorer.log_probabilities(np.array(context), np.array([len(context)]))[0] if context else 0
        assert abs(np.exp(np.array(p_of) - before).sum() - 1) < 1e-4


def test_blocks_cover_each_target_once():
    n = np.array([0, 1, 16, 17, 60, 1000])
    own, at, size = attention.blocks(n)
    seen = Counter((o, a + k) for o, a, s in zip(own.tolist(), at.tolist(), size.tolist()) for k in range(s))
    assert set(seen.values()) == {1} and len(seen) == n.sum()


def test_gradients():
    p, classes = _model()
    p = {k: v.astype(float) for k, v in p.items()}
    rng = np.random.default_rng(0)
    streams = [np.append(rng.integers(0, 39, n), 39) for n in (5, 40, 50)]
    flat, n = np.concatenate(streams), np.array(list(map(len, streams)))
    batch = attention.windows_of(flat, n, 39, np.arange(len(attention.blocks(n)[0])))
    _, g, (rows_e, rows_o) = attention.gradients(p, classes, *batch)
    for name in p:
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in p[name].shape)
            rows = rows_e if name == "e" else rows_o if name in ("o", "ob") else None
            if rows is not None and at[0] not in rows:
                continue
            own = at if rows is None else (int(np.searchsorted(rows, at[0])), *at[1:])
            old = p[name][at]
            p[name][at] = old + 1e-4
            up = attention.gradients(p, classes, *batch)[0]
            p[name][at] = old - 1e-4
            down = attention.gradients(p, classes, *batch)[0]
            p[name][at] = old
            assert abs((up - down) / 2e-4 - g[name][own]) < 1e-5, (name, at)


def test_training_finds_an_order():
    rng = np.random.default_rng(5)
    streams = [np.append((np.arange(60) + rng.integers(0, 9)) % 9, 9) for _ in range(200)]
    flat, n = np.concatenate(streams), np.array(list(map(len, streams)))
    counts = np.bincount(flat, minlength=10).astype(float)
    classes = attention.Classes(counts, 3)
    trainer = attention.Trainer(attention.start(counts, classes), classes, 0.1, 64)
    before = attention.Scorer(trainer.p, classes).log_probabilities(flat, n).sum() / n.sum()
    every = len(attention.blocks(n)[0])
    for at in range(0, every, 64):
        trainer.add(*attention.windows_of(flat, n, 9, np.arange(at, min(at + 64, every))))
    after = attention.Scorer(trainer.p, classes).log_probabilities(flat, n).sum() / n.sum()
    assert after > before / 2


def test_words_are_encoded_alone_or_together_alike(ranks):
    bpe = lm_score.byte_bpe(ranks)
    names = [*"a b cc 's don't 12x34 .. é ß日本 x\u00a0y \u2028z q\x1cr \\n <|endoftext|> \xff".split(" "), "", "w" * 250, "end"]
    words = lm_score.Words(bpe)
    numbers = words.numbers([n.encode() for n in names])
    alone = lambda n: [i for a in range(0, len(n) + 1, lm_score.PIECE) for i in bpe.encode_ordinary((" " + n)[a : a + lm_score.PIECE])]
    flat, n = words.streams(np.append(numbers, numbers[:2]), np.array([len(names), 0, 2]), 7)
    assert flat.tolist() == [i for x in names for i in alone(x)] + [7, 7] + [i for x in names[:2] for i in alone(x)] + [7]
    assert n.sum() == len(flat) and n[1] == 1


def test_base_scores_follow_the_formula(spark, docs_of, prose, ranks):
    texts = [*ODD, *[(30 + i, prose(60, i)) for i in range(60)], (95, "İstanbul ÄÖ AB c d " + "é" * 900)]
    rows = lm_score.lm_score(docs_of(texts), ranks, head=20, parts=2).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in texts if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 4)) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 2]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert lm_score.lm_score(docs_of([]), ranks).count() == 0


def test_the_model_learns_from_its_texts(spark, docs_of, prose, ranks):
    texts = [(i, prose(120, i % 7)) for i in range(400)]
    trained, start = (sum(r["score"] for r in lm_score.lm_score(docs_of(texts), ranks, rounds=k, parts=3).where("held_out").collect()) for k in (3, 0))
    assert trained > 0.9 * start  # nearer to zero


def test_scores_do_not_depend_on_the_head(spark, docs_of, prose, ranks):
    texts = [*ODD, *[(30 + i, prose(60, i) + f" rarity{i}word unseen-{i * i}-thing") for i in range(60)]]
    few, all_ = (sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in lm_score.lm_score(docs_of(texts), ranks, head=h, rounds=0).collect()) for h in (5, 10_000))
    assert few == all_


def test_every_training_text_is_learned_from(spark):
    own = list(range(1000, 1080))
    counts = np.zeros(50_001)
    counts[own], counts[-1] = 3000, len(own)
    start = attention.start(counts, attention.Classes(counts))
    for how in ({}, {"parts": 50}, {"parts": 2}):
        texts = [(k % how.get("parts", lm_score.PARTS), bytearray(np.append(np.full(3000, i), 50_000).astype(lm_score.id_type(50_000)).tobytes())) for k, i in enumerate(own)]  # an id of its own each
        p = lm_score.trained(spark, spark.createDataFrame(texts, "turn long, ids binary"), counts, **how)[0]
        # The first update, of three such texts, moves the output vectors alone, as these start from 0.
        assert (p["e"][own] != start["e"][own]).any(1).sum() >= len(own) - 3


def test_streams_are_read_as_packed():
    rng = np.random.default_rng(4)
    for end in (50_000, 100_000):
        n = rng.integers(1, 400_000, 9)
        flat = rng.integers(0, end, n.sum())
        read = list(lm_score._unpacked(lm_score._packed(flat, n, end)[2:], end))
        assert len(read) > 1 and np.array_equal(np.concatenate([f for f, _ in read]), flat[n[:2].sum() :]) and np.array_equal(np.concatenate([m for _, m in read]), n[2:])
    assert list(lm_score._unpacked(lm_score._packed(flat[:0], n[:0], end), end)) == []


def test_training_gets_the_ids_of_every_text(spark, docs_of, prose, ranks, monkeypatch):
    texts, seen, train = [*ODD, *[(30 + i, prose(40, i)) for i in range(80)]], {}, lm_score.trained

    def trained(spark, streams, counts, rounds, parts):
        seen.update(rows=streams.select("turn", "ids").collect(), counts=counts, parts=parts)
        return train(spark, streams, counts, rounds, parts)

    monkeypatch.setattr(lm_score, "trained", trained)
    lm_score.lm_score(docs_of(texts), ranks)
    assert len(seen["rows"]) == sum(zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in texts)
    assert {r["turn"] for r in seen["rows"]} == set(range(seen["parts"]))
    ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in seen["rows"]), lm_score.id_type(len(seen["counts"]) - 1))
    assert np.array_equal(np.bincount(ids, minlength=len(seen["counts"])), seen["counts"])
