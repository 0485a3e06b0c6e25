import collections
import hashlib
import re

from dossierlake.llm import bagminhash, exact_dedup, mixing
from dossierlake.llm.exact_dedup import PatriciaTrie
from odd_cases import ODD


def test_trie_against_dict_with_spill():
    import random

    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    trie, want, got = PatriciaTrie("max", budget=60), collections.defaultdict(lambda: [None, 0]), collections.defaultdict(lambda: [None, 0])

    def take(rows):
        for k, o, n in rows:
            got[k] = [o if got[k][0] is None else max(got[k][0], o), got[k][1] + n]

    for i, k in enumerate(keys):
        trie.insert(k, i)
        want[k] = [i if want[k][0] is None else max(want[k][0], i), want[k][1] + 1]
        take(trie.spill())
    take(trie.items())
    assert got == want


def test_exact_dedup_against_brute_force(docs_of):
    texts = [*ODD, *[(10 + i, f"text {i % 7}") for i in range(60)]]
    rows = exact_dedup.exact_dedup(docs_of(texts), keep="max", trie_bytes=100).collect()
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
    once = exact_dedup.one_of_each(docs_of(texts), keep="max")
    assert once.columns == docs_of([]).columns
    assert sorted((t or "", str(i)) for i, t in ((r["doc_id"], r["text"]) for r in once.collect())) == sorted((t, str(max((x for x in ids if x is not None), default=None))) for t, ids in groups.items())
    assert exact_dedup.one_of_each(docs_of([])).count() == 0


def _shingles(text):
    w = (text or "").encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_near_classes_against_brute_force(docs_of, prose):
    texts = [(i, prose(120, i)) for i in range(30)]
    base = prose(200, 99).split()
    for k in range(40):  # copies at various distances of one text
        copy = list(base)
        for j in range(k // 5):
            copy[(17 * j + 29 * k) % 200] = f"edit{k}"
        texts.append((100 + k, " ".join(copy)))
    texts += [(200 + k, prose(30, 7) + " " + prose(60, 300 + k)) for k in range(20)]  # a shared passage
    texts += ODD
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_dedup(docs_of(texts)).collect()}
    sets = [(i, t or "", _shingles(t)) for i, t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both, either = sum((sets[a][2] & sets[b][2]).values()), sum((sets[a][2] | sets[b][2]).values())
            if sets[a][1] == sets[b][1] or (either and both >= 0.8 * either - 1e-9):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    assert got == {i: least.get(root(k)) for k, (i, _, _) in enumerate(sets)}


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    x, y = "a b c d e f g h i j".split(), "a b c d e f g x y z".split()
    texts = [(" ".join(t * 3)).encode() for t in (x, y)]
    hits = 0
    for seed in range(6):
        bagminhash._SEED = np.uint64(seed)
        sig = bagminhash.signatures(*bagminhash.shingles(texts, bagminhash._WordHashes(), 1), 2, 512)
        hits += (sig[0] == sig[1]).sum()
    bagminhash._SEED = np.uint64(0x5D0C1E5)
    assert abs(hits / (6 * 512) - 21 / 39) < 0.04


def test_sainte_lague_against_the_definition():
    import random

    rng = random.Random(2)
    for _ in range(200):
        votes = [rng.choice([0, 1, 5, 50, 500]) * rng.random() for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        caps = [rng.choice([0, 3, 20, 1000]) for _ in votes]
        want = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] > 0 and want[i] < caps[i]]
            if not open_:
                break
            best = max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert mixing.sainte_lague(votes, seats, caps) == want


def test_mix_meets_targets(docs_of, prose):
    texts = [*ODD, *[(10 + i, prose(50 + i % 90, i)) for i in range(300)]]
    docs = docs_of(texts)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    of = lambda rows, size: collections.Counter({i: sum(size(r) for r in rows if str(r["doc_id"]) == i) for i in {str(r["doc_id"]) for r in rows}})
    n_words = lambda t: len([w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w])
    for twice in (docs, docs.union(docs), docs.union(docs).repartition(5)):  # ids and whole rows that repeat
        got = mixing.mixed_documents(twice)
        assert got.columns == docs.columns
        assert +of(got.collect(), lambda r: n_words(r["text"])) == +of(mixing.mix(twice).collect(), lambda r: r["taken"])
    assert mixing.mix(docs_of([])).count() == 0
