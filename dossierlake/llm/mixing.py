"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets come from weights with a ceiling for each source. The mix is counted in blocks of BLOCK words: blocks go to sources by the highest
quotients target/(2s+1), and each source's blocks to its shards by shard size in the same way, at most two passes of a shard. Inside a
shard the documents stand in a seeded order as one stream of blocks; whole passes are taken first, the rest is a run of blocks from a
seeded start. So quotas are integers before any row is chosen, and reruns agree whatever the partitioning.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dossierlake.llm.common import WORD, written

BLOCK = 64


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes split by weight; a target stops at most times its size and the excess is split anew until none is above."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        open_ -= set(over)
        left -= sum(out[i] for i in over)
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes/(2s+1), ties to the earlier entry, never above an entry's cap. Starts below the known quota of
    each entry (votes*seats/total less one, which no highest-quotient result with these caps is under), so the queue handles few seats."""
    total = sum(votes)
    out = [0] * len(votes)
    if total <= 0:
        return out
    # With caps, seats move from capped to open entries, so open entries never fall below their uncapped share; n/2 bounds Webster's deviation.
    for i, v in enumerate(votes):
        out[i] = max(0, min(caps[i], int(v * seats / total - len(votes) / 2 - 1)))
    left = seats - sum(out)
    queue = [(-v / (2 * out[i] + 1), i) for i, v in enumerate(votes) if v > 0 and out[i] < caps[i]]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, i = queue[0]
        out[i] += 1
        left -= 1
        if out[i] < caps[i]:
            heapq.heapreplace(queue, (-votes[i] / (2 * out[i] + 1), i))
        else:
            heapq.heappop(queue)
    return out


def _shards(words: int, block: int) -> int:
    """Shards of a source: they and their size grow alike, so that neither their list nor one of them gets large."""
    return max(1, math.isqrt(words // (64 * block)))


def _shard_plan(seed: int, block: int):
    def plan(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard").reset_index(drop=True)
        sizes = [int(x) for x in cells["shard_size"]]
        quota = sainte_lague(sizes, int(cells["blocks"].iloc[0]), [2 * s // block for s in sizes])
        passes, start, run = [], [], []
        for shard, size, q in zip(cells["shard"], sizes, quota):
            whole = q * block // size if size else 0
            n = size // block
            passes.append(whole)
            run.append((q * block - whole * size) // block)
            start.append(zlib.crc32(f"{seed}:{cells['rank'].iloc[0]}:{shard}".encode()) % n if n else 0)
        return cells[["rank", "shard"]].assign(passes=passes, start=start, run=run, ring=[s // block for s in sizes], block_size=block)

    return plan


def _size(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, passes (whole copies), cut_from and cut_to (the word range
    of one further, partial copy, end exclusive; equal if there is none).

    Sources stand in code point order, null last and a source of its own, and take the weights in turn. A null or empty text has size 0 and
    is never taken; so is everything if all sizes are 0. Ties of the seeded order fall to doc_id, null ids first; rows that repeat an id are
    rows of their own. The list of sources (one row each) is all that reaches the driver.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _size(F.col(text_col)).alias("size"),
    )
    return _mix_sized(sized, weights, share, most, seed, block)


def _mix_sized(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, block: int) -> DataFrame:
    """mix() for rows that have a size; further columns stay."""
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    spark = sized.sparkSession
    found = [(r["source"], int(r["source_size"] or 0)) for r in sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()]
    found.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    sizes = [s for _, s in found]
    targets = capped_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, most)
    quota = sainte_lague(targets, round(sum(targets) / block), [int(most * s) // block for s in sizes])
    plan = [(i, s, n, float(t), q, _shards(n, block)) for i, ((s, n), t, q) in enumerate(zip(found, targets, quota))]
    sources = spark.createDataFrame(plan, "rank int, source string, source_size long, target double, blocks long, shards int")

    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", sources["source"], "size", *more, "rank", "source_size", "target", "blocks", F.pmod(key, F.col("shards")).cast("int").alias("shard"), key.alias("draw"))
    cells = rows.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = cells.groupBy("rank").applyInPandas(_shard_plan(seed, block), "rank int, shard int, passes long, start long, run long, ring long, block_size long")
    placed = rows.withColumn("end", F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("begin", F.col("end") - F.col("size"))

    b = F.col("block_size")
    low, high, ring = F.col("start") * b, (F.col("start") + F.col("run")) * b, F.col("ring") * b
    # The run is a circular arc: [low, min(high, ring)) and, past the ring's end, [0, high - ring).
    part = lambda x, y: (F.greatest(F.col("begin"), x), F.least(F.col("end"), y))
    a0, a1 = part(low, F.least(high, ring))
    w0, w1 = part(F.lit(0).cast("long"), high - ring)
    in_arc, in_wrap = F.greatest(a1 - a0, F.lit(0)), F.greatest(w1 - w0, F.lit(0))
    joined = placed.join(quotas, ["rank", "shard"]).withColumns({"arc": in_arc, "wrap": in_wrap})
    # A document that both ends of the arc touch is cut twice; its two ranges are told apart by wrap_to.
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", *more,
        (F.col("passes") * F.col("size") + F.col("arc") + F.col("wrap")).alias("taken"),
        "passes",
        F.when(F.col("arc") > 0, a0 - F.col("begin")).otherwise(F.lit(0)).alias("cut_from"),
        F.when(F.col("arc") > 0, a1 - F.col("begin")).otherwise(F.lit(0)).alias("cut_to"),
        F.when(F.col("wrap") > 0, w0 - F.col("begin")).otherwise(F.lit(0)).alias("wrap_from"),
        F.when(F.col("wrap") > 0, w1 - F.col("begin")).otherwise(F.lit(0)).alias("wrap_to"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: a row once for each whole pass, and once more for a partial copy. A copy that holds the
    whole text keeps it as it is; a cut copy has the taken words joined by one blank, and its n_chars (if there is such a column) counts
    that text. Rows of which nothing is taken are not in the mix. Rows that repeat an id, or all else, have plans of their own: docs are
    written with a number for each row, by which plan and row meet."""
    numbered = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")
    sized = numbered.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(F.col(text_col)).alias("size"), "_mix_row")
    plan = _mix_sized(sized, weights, share, most, seed, block).where("passes > 0 or cut_to > cut_from or wrap_to > wrap_from")
    plan = plan.select("_mix_row", F.struct("passes", "cut_from", "cut_to", "wrap_from", "wrap_to", "size").alias("_mix"))
    m = lambda c: F.col(f"_mix.{c}")
    text = F.col(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    some = lambda x, y: F.concat_ws(" ", F.slice(words, m(x).cast("int") + 1, (m(y) - m(x)).cast("int")))
    cut = (m("cut_to") - m("cut_from")) + (m("wrap_to") - m("wrap_from"))
    partial = F.when(cut == m("size"), text).otherwise(F.concat_ws(" ", F.when(m("wrap_to") > m("wrap_from"), some("wrap_from", "wrap_to")), F.when(m("cut_to") > m("cut_from"), some("cut_from", "cut_to"))))
    copies = F.concat(F.array_repeat(text, m("passes").cast("int")), F.when(cut > 0, F.array(partial)).otherwise(F.array().cast(T.ArrayType(T.StringType()))))
    out = numbered.join(plan, "_mix_row").withColumn(text_col, F.explode(copies))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
