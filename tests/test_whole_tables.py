"""Queries over whole tables against brute force on small ones."""

import pytest
from dossierlake.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, k % 7) for k in range(1, 121)]
    lines = [(k, (k * n) % 11, n, float(5 * n)) for k in range(1, 123) for n in range(1, k % 4 + 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return folder, orders, lines


def test_whole_report(spark, tables):
    folder, orders, lines = tables
    keys = {k for k, _ in orders}
    rows = [((0, k, 0, f"o{k}"), None) for k in keys] + [((0 if k in keys else 1, k if k in keys else 0, 1, f"o{k}_{n}"), f"o{k}") for k, _, n, _ in lines]
    rows.sort(key=lambda r: r[0])
    number = {place[3]: i + 1 for i, (place, _) in enumerate(rows)}
    want = [(i + 1, place[3], number.get(head)) for i, (place, head) in enumerate(rows)]
    got = sorted((r["row_id"], r["path"], r["parent_id"]) for r in catalogue.QUERIES["report_rows_whole"](spark, folder).collect())
    assert got == want


def test_whole_references(spark, tables):
    folder, orders, lines = tables
    owner = {k: f"c{c}" for k, c in orders}
    links = {(f"p{p}", owner[k]) for k, p, _, _ in lines if k in owner}
    got = sorted(map(tuple, catalogue.QUERIES["cross_reference_whole"](spark, folder).select("path", "related_path", "rel_type").collect()))
    assert got == sorted([(p, c, "derived_from") for p, c in links] + [(c, p, "parent_of") for p, c in links])
    counts = {r["path"]: r["n_children"] for r in catalogue.QUERIES["derived_counts_whole"](spark, folder).collect()}
    assert counts == {c: sum(x == c for _, x in links) for _, c in links}
