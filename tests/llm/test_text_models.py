import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from dossierlake.llm import html_extract, license_scan, sentencepiece_codec, token_store, toxicity
from odd_cases import ODD

tokenizers = pytest.importorskip("public_tokenizers")


def _strings(n, seed):
    rng = random.Random(seed)
    letters = [*"abcde thing ▁ \n\tßéñ日本語😀<>0123'", "\xa0", "​", "'s", "  "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library(spark, docs_of):
    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.PieceModel(sentencepiece_codec.model_bytes(path))
    rng = random.Random(1)
    for text in [*_strings(400, 1), "a" * 300, " " * 50, "hello world " * 40]:
        assert own.encode(text) == library.encode(text)
        assert own.decode(own.encode(text)) == library.decode(library.encode(text))
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 10))]
        assert own.decode(ids) == library.decode(ids)
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_eos=True)
        want.append((str(i), len(ids), h(" ".join(map(str, ids))), h(library.decode(ids))))
    got = sentencepiece_codec.encode_digests(docs_of(ODD), path).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_store_round_trip(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    own = token_store.Encoder(definition)
    for text in [*_strings(400, 2), "<|endoftext|>", " a", "a ", "a  b"]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    texts = [*ODD, *[(20 + i, "the same long passage of words " * 300 + f"end {i % 3}") for i in range(8)]]
    path = f"{tmp_path}/store"
    token_store.write_store(docs_of(texts), path, definition)
    want, start = [], 0
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = np.array(ids[i, t], "<u4").tobytes()
        want.append((str(i), start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert sorted((str(r[0]), *r[1:]) for r in token_store.read_digests(spark, path).collect()) == sorted(want)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in token_store.read_ids(spark, path).collect()) == sorted((str(i), ids[i, t]) for i, t in texts)
    assert token_store.verify(spark, path)
    stored = spark.read.parquet(f"{path}/content/kind=chunk").agg({"n_ids": "sum"}).first()[0]
    assert stored < sum(map(len, ids.values())) / 2  # copies are stored once


def test_crc_join():
    a, b = b"some bytes", b"and others" * 50
    assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_disguised_words_are_restored(spark, docs_of, prose):
    text = " ".join(["stupid idiot pathetic worthless"] * 50) + " " + prose(500, 1)
    counts = {}
    for batch in toxicity._trigrams(iter([__import__("pyarrow").RecordBatch.from_arrays([[text]], ["text"])])):
        counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    restorer = toxicity.Restorer(toxicity.CharacterModel(counts))
    for shown in ("1d10t", "i.d.i.o.t", "iiidiiooot", "stup1d", "5tupid", "w0rthl3ss", "p@th3tic"):
        assert any(w in ("idiot", "stupid", "worthless", "pathetic") for w in restorer.words_of(shown)), shown
    assert "idiot" in list(restorer.spelled("you are an i d i o t today"))
    assert toxicity.disguised("ordinary") is None


def test_toxicity_learns_and_holds_out(spark, docs_of, prose):
    texts = [(i, prose(40, i) + (" vequanto rude" if i % 4 == 0 else "")) for i in range(240)] + [(1000 + i, t) for i, (_, t) in enumerate(ODD)] + [(None, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs_of(texts), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    none = toxicity.toxicity(docs_of(ODD), labels.where("toxic = 7")).collect()
    assert all(r["predicted"] == 0 for r in none)


def test_main_text(spark):
    body = "".join(f"<p>Paragraph {i} tells a story of many words, and it ends here.</p>" for i in range(4))
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav><script>var t="</p>";</script><article><h1>Title &amp; more</h1>{body}</article><div class="comments"><p>First! I liked it.</p></div><footer>&copy; someone</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (None, "v", "", 3), (4, "w", "<p>cut <b", 3), (4, "w", "<" * 5000, 3)], "page_id long, url string, html string, text int")
    rows = html_extract.extract(pages).collect()
    got = {r["page_id"]: r for r in rows if r["url"] in ("u", None)}
    assert len(rows) == 5
    assert got[1]["text"] == "Title & more " + " ".join(f"Paragraph {i} tells a story of many words, and it ends here." for i in range(4))
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == ""


def test_elements_without_end_lose_nothing():
    import time

    model = html_extract.train(120, 3, 80)
    body = "".join(f"<p>Paragraph {i} tells a story of many words, and it ends here.</p>" for i in range(4))
    want = " ".join(f"Paragraph {i} tells a story of many words, and it ends here." for i in range(4))
    said = lambda x: html_extract.main_text(model, f"<html><body><article>{x}</article></body></html>")
    for tag in ("svg", "object", "video", "select", "iframe", "noscript", "canvas"):
        assert said(f"<{tag}>{body}") == want, tag
        assert said(f"<{tag}><g><{tag}>inner words</{tag}>more</g></{tag}>{body}") == want, tag
    assert said(f"<script>var x = '<p>no</p>';</script>{body}<style>p {{}}") == want
    # Stray end tags and open elements by the thousand, in time that grows with the page.
    began = time.time()
    for page in ("<b>" * 40_000 + "</i>" * 40_000, "<svg>" * 40_000 + "x", "<b>" * 20_000 + "<h1>x</h1>" * 20_000, "<p>" * 40_000, "<li>x" * 40_000, "</p>" * 40_000):
        html_extract.parse(page)
    assert time.time() - began < 20


def test_empty_tables(spark, docs_of, tmp_path):
    nothing = docs_of([])
    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    token_store.write_store(nothing, f"{tmp_path}/store", definition)
    assert token_store.read_digests(spark, f"{tmp_path}/store").collect() == []
    assert token_store.read_ids(spark, f"{tmp_path}/store").collect() == []
    assert token_store.verify(spark, f"{tmp_path}/store")
    assert sentencepiece_codec.encode_digests(nothing, str(tokenizers.path("piece_bpe_32k.model"))).collect() == []
    assert toxicity.toxicity(nothing, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []
    assert license_scan.licence_scan(nothing).collect() == []
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_tokens_take_linear_time():
    import time

    began = time.time()
    restorer = toxicity.Restorer(toxicity.CharacterModel({}))
    for token in ("x" + "." * 300_000 + "x1", "_" * 100_000 + "(", "a_" * 50_000 + "(", "1d10t" * 20_000, "!" * 200_000 + "a", "." * 200_000):
        restorer.words_of(token)
        list(restorer.spelled(token))
    assert time.time() - began < 60


def test_columns_of_ids_and_texts(spark):
    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["hello world", "", None, "日本語 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    ids = rows.select("t", sentencepiece_codec.encode_column(spark, rows["t"], path).alias("ids"))
    got = ids.select("t", "ids", sentencepiece_codec.decode_column(spark, ids["ids"], path).alias("back")).collect()
    assert [r["ids"] for r in got] == [library.encode(t or "", add_eos=True) for t in texts]
    assert [r["back"] for r in got] == [t or "" for t in texts]


def test_messages_equal_enumeration():
    import itertools

    model = html_extract.train(60, 3, 60)
    nodes = html_extract.parse("<div class='post'><p>Some words of text.</p><a>x</a></div><footer>end</footer>")
    html_extract.measure(nodes)
    lean, weight = [0.0, *[model.lean(html_extract.features(x)) for x in nodes[1:]]], {}
    place = {id(x): i for i, x in enumerate(nodes)}
    for states in itertools.product((0, 1), repeat=len(nodes)):
        total = sum(v * s for v, s in zip(lean, states))
        total += sum(model.pair[html_extract.kind(x)][states[place[id(x.parent)]]][states[i]] for i, x in enumerate(nodes) if i)
        weight[states] = math.exp(total)
    want = [sum(w for s, w in weight.items() if s[i]) / sum(weight.values()) for i in range(len(nodes))]
    assert np.allclose(model.marginals(nodes), want)


def test_licences(spark, docs_of, prose):
    texts = [*ODD, (20, prose(30, 1) + "\nReleased under the MIT License."), (21, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (22, "His driving license was not free, all right."), (23, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.")]
    got = {r["doc_id"]: r["families"] for r in license_scan.licence_scan(docs_of(texts)).collect()}
    assert (got[20], got[21], got[22], got[23]) == ("MIT", "CC-BY-NC,Proprietary", None, "GPL-3.0")
    assert all(got[i] is None for i, _ in ODD)


def test_store_finds_special_tokens(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    library = Tokenizer.from_str(definition)
    texts = list(enumerate(["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|> 's", "<|endoftext |> plain", " <|endoftext|>\n"]))
    path = f"{tmp_path}/store"
    token_store.write_store(docs_of(texts), path, definition)
    got = {r["doc_id"]: list(r["ids"]) for r in token_store.read_ids(spark, path).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    assert 50256 in got[0]


def test_wrapped_licences(spark, docs_of, prose):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"
    texts = [(1, prose(30, 1) + "\n" + mit + "\n" + prose(30, 2)), (2, bsd), (3, gpl.replace("\n", "\r\n")), (4, "available under Creative Commons Attribution 4.0 International"), (5, "This work is in the public domain."),
             (6, "Permission is hereby granted\n\nto the software without restriction"), (7, "Released under\nthe MIT\nLicense."), (8, "We use creative words in public.\nThe domain is open.")]
    got = {r["doc_id"]: r["families"] for r in license_scan.licence_scan(docs_of(texts)).collect()}
    once = license_scan.licence_scan(docs_of([(1, prose(30, 1) + "\n" + prose(9, 3) + "\nReleased under the MIT License.\n" + prose(30, 2)), (2, texts[0][1])])).collect()
    assert [(r["families"], r["n_lines"]) for r in once] == [("MIT", 1)] * 2
    assert got == {1: "MIT", 2: "BSD", 3: "GPL-3.0", 4: "CC-BY", 5: "Public-Domain", 6: None, 7: "MIT", 8: None}


def test_training_rows_fall_out_as_exact_copies_only(spark, docs_of, monkeypatch):
    words = "aaaa bbbb cccc dddd eeee ffff".split()
    # Near copies that share most words, and exact copies with either label.
    texts = [(i, " ".join([*words, f"w{'abcdefghij'[i % 10]}{'abcdef'[i // 10]}end", *["vequanto"] * (i % 2 == 0)])) for i in range(60)] + [(100 + i, "one text often") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in texts], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit_l1
    monkeypatch.setattr(toxicity, "fit_l1", lambda rows, names: seen.append(sorted(y for y, _ in rows)) or fit(rows, names))
    toxicity.train(docs_of(texts), labels)
    kept = {(t, int(i % 2 == 0)) for i, t in texts if zlib.crc32(str(i).encode()) % 3 != 1}
    assert seen == [sorted(y for _, y in kept)]


def test_reading_compares_the_manifest(spark, docs_of, tmp_path):
    import glob
    import os

    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = f"{tmp_path}/store"
    token_store.write_store(docs_of([(i, f"text number {i}") for i in range(40)]), path, definition)
    assert token_store.read_digests(spark, path).count() == 40
    os.remove(sorted(glob.glob(f"{path}/recipes/part-*.parquet"))[-1])
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_digests(spark, path).count()


def test_licence_families(spark, docs_of):
    told = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    other = [(f, t) for f, ts in license_scan.CALIBRATION.items() for t in ts]
    got = {r["doc_id"]: r["families"] for r in license_scan.licence_scan(docs_of(list(enumerate(t for _, t in told + other)))).collect()}
    assert len(license_scan.TEMPLATES) > 30
    assert [got[i] for i in range(len(told))] == [f for f, _ in told]
    # Texts that the regression did not see are confirmed as what they are, or not at all.
    assert all(got[len(told) + i] in (None, f) for i, (f, _) in enumerate(other))
    assert not {t for _, t in told} & {t for _, t in other}
