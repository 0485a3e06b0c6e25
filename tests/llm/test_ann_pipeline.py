import numpy as np

from dossierlake.llm import ann


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    x[50:80] = x[50]  # equal vectors
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(600)] + [(900, None, "c"), (1000, [0.0] * 16, "c"), (1100, [float("nan")] * 16, "c"), (None, [1.0] * 16, "c"), (1200, [1.0] * 3, "c"), (1300, [None] * 16, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = ann.nearest(table, every=50, k=10, neighbours=12, rounds=3).collect()
    hits = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(600), d))[:10].tolist()))
    assert hits >= 0.95 * 120
    assert ann.nearest(table.where("vec_id < 0")).count() == 0
    few = ann.nearest(table.where("vec_id in (0, 1, 2)"), every=50).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 1), (0, 2)]


def test_recall_with_a_beam_far_below_the_table(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, every=200, k=10, width=150).collect()
    hits = 0
    for q in range(0, 6000, 200):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 300 and hits >= 0.9 * 300


def test_pipeline_stages(spark, docs_of, prose, tmp_path):
    import corpus_pipeline

    texts = [(i, prose(60, i) + (" vequanto rude" if i % 5 == 0 else "")) for i in range(150)]
    texts += [(200 + i, prose(60, 3)) for i in range(5)] + [(300, prose(60, 4) + " end"), (400, None), (401, "")]
    docs = docs_of(texts, sources=("a", "b")).drop("owner", "n")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "sentencepiece" or docs.columns == columns
    left = {r["doc_id"] for r in seen["toxicity"]}
    assert left == {i for i, _ in texts} - {i for i in range(150) if i % 5 == 0}
    left = {r["doc_id"] for r in seen["exact_dedup"]}
    assert left & {3, 200, 201, 202, 203, 204} == {204} and left & {400, 401} == {401}
    assert {4, 300} & {r["doc_id"] for r in seen["near_dedup"]} == {4}
    assert len(seen["mixing"]) == len(seen["sentencepiece"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sentencepiece"])


def test_pipeline_rows_that_repeat_ids(spark, docs_of, prose, tmp_path):
    import collections

    import corpus_pipeline

    rude = " vequanto rude"
    clean = [(i, prose(60, i)) for i in range(40)]
    texts = [*clean, *[(i, prose(60, 100 + i) + rude) for i in range(40)], *clean[:10], *[(i, prose(60, 1)) for i in range(500, 520)], *[(7, prose(60, 200 + k)) for k in range(5)], (None, prose(60, 300)), (None, prose(60, 301) + rude), (None, None)]
    docs_of(texts, sources=("a", "b")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 2)) for i in range(1000, 1100)]
    more = docs_of([(i, prose(60, i) + rude * (i % 2)) for i in range(1000, 1100)], sources=("a", "b"))
    more.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda rows: collections.Counter((r["doc_id"], r["text"]) for r in rows)
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert key(got) == key([r for r in docs.collect() if rude not in (r["text"] or "")])
    kept = corpus_pipeline.drop_exact(spark, spark.createDataFrame(got, docs.schema), str(tmp_path)).collect()
    want = collections.defaultdict(list)
    for r in got:
        want[r["text"] or ""].append(r["doc_id"])
    assert sorted((r["text"] or "", str(r["doc_id"])) for r in kept) == sorted((t, str(max((i for i in ids if i is not None), default=None))) for t, ids in want.items())
    left = corpus_pipeline.drop_near(spark, spark.createDataFrame([*kept, *[r for r in kept if r["doc_id"] == 7]], docs.schema), str(tmp_path)).collect()
    assert key(left) == key(kept)  # nothing is near, and whole rows that repeat go


def test_pipeline_of_an_empty_table(spark, docs_of, tmp_path):
    import corpus_pipeline

    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
