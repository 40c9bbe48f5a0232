"""Mixing sources to target token weights by entropy balancing.

Of all rates r > 0 whose size-weighted sums meet the sources' targets, the ones closest to keeping each document
once (least relative entropy, r <= 2) are exponentially tilted: r = min(2, exp(t_s * size / mean_s)), with one
multiplier t_s a source from the convex dual. A rate depends on (source, size) only, so documents are reduced once
to counts by (source, size); each Newton iteration is a distributed sum over these counts, with one pair of numbers
a source returning to the driver, and a bracket around each multiplier keeps every step safe. Sums are over
integers scaled by a power of two, so they don't depend on the order of rows and reruns agree.

Rates become copies cell by cell: a source's cells are taken from the longest documents to the shortest, each cell
gets the whole number of copies that best makes up what the target still lacks, and a cell's copies go to its
documents in the order of a hash of id and text, so the same rows at another path are mixed alike. No source is so left further from its target than about half its shortest document,
as long as rates allow, and no document gets more than 2 copies.

Defined results: a null or blank text has size 0 and keeps one copy of nothing; a null source is a source of its own,
ordered last; a null id is an id like others; of a source's documents of one size, rows that tie in id and text are interchangeable, and rows that
repeat are separate documents; a text of any length counts whole; an empty table gives an empty result; other columns are kept
by mix() and ignored by rates. The driver holds a few numbers a source, so sources must be few enough for its memory; documents and
sizes may be any number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RID, WORD, documents, if_small, is_not_in, materialize, may_be_in, of_rows, salted_rank, whole_text, with_rid

MAX_RATE = 2
#: Fixed-point scale of the distributed sums.
SCALE = 1 << 20
#: Relative gap to a target at which a multiplier is taken; Newton steps before its bracket is only halved, which ends.
TOLERANCE, NEWTON_STEPS = 1e-7, 60


@dataclass(frozen=True)
class Target:
    source: str | None
    size: int
    target: float


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = MAX_RATE) -> list[Target]:
    """Sources by code point, null last, weigh ``weights`` in turn; what is above cap * size is shared anew by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    limit = [cap * n for _, n in order]
    out = [0.0] * len(order)
    free, left = set(range(len(order))), share * sum(n for _, n in order)
    while free:
        per = left / sum(weight[i] for i in free)
        over = {i for i in free if weight[i] * per > limit[i]}
        for i in over or free:
            out[i] = float(limit[i]) if over else weight[i] * per
        if not over:
            break
        left -= sum(limit[i] for i in over)
        free -= over
    return [Target(s, n, t) for (s, n), t in zip(order, out, strict=True)]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, rid, source, size, digest): size in words, digest of the text."""
    return with_rid(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(RID).alias("rid"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(whole_text(text_col)).alias("digest"),
    )


def _rate(tilt: float, x: float) -> float:
    return min(float(MAX_RATE), math.exp(min(tilt * x, 50.0)))


def solve(cells: DataFrame, wanted: list[Target], counts: dict[str | None, int]) -> dict[str | None, float]:
    """The multiplier of each source: infinite where every document is wanted at the greatest rate.

    cells: (source, size, n). Each step is one aggregation of the cells. A source is done within TOLERANCE of its target, or where
    its bracket has shrunk to nothing, which halving it makes sure of; there is no other end.
    """
    spark = cells.sparkSession
    mean = {t.source: t.size / counts[t.source] for t in wanted}
    tilt, low, high, done = {}, {}, {}, set()
    for t in wanted:
        tilt[t.source], low[t.source], high[t.source] = 0.0, -math.inf, math.inf
        if t.target >= MAX_RATE * t.size:
            tilt[t.source] = math.inf
            done.add(t.source)
    goal = {t.source: t.target for t in wanted}
    steps = 0
    while open_ := [s for s in goal if s not in done]:
        steps += 1
        now = spark.createDataFrame([(s, tilt[s], mean[s]) for s in open_], "source string, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        r = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        fixed = lambda v: F.sum(F.rint(v * SCALE).cast("decimal(38,0)"))
        sums = cells.join(if_small(now, len(open_)), cells["source"].eqNullSafe(now["source"])).groupBy(now["source"]).agg(
            fixed(F.col("n") * F.col("size") * F.least(r, F.lit(float(MAX_RATE)))).alias("f"),
            fixed(F.when(r < MAX_RATE, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("d"),
        )
        for row in sums.collect():  # a row a source
            s, f, d = row["source"], float(row["f"]) / SCALE, float(row["d"]) / SCALE
            gap = f - goal[s]
            if abs(gap) <= TOLERANCE * max(goal[s], 1.0):
                done.add(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            step = tilt[s] - gap / d if d > 0 else math.nan
            if not (low[s] < step < high[s]) or (steps > NEWTON_STEPS and math.isfinite(high[s] - low[s])):
                if math.isinf(high[s]):
                    step = max(2 * tilt[s], tilt[s] + 1)
                elif math.isinf(low[s]):
                    step = min(2 * tilt[s], tilt[s] - 1)
                else:
                    step = (low[s] + high[s]) / 2
            if step == tilt[s] or high[s] - low[s] < 1e-12 * max(1.0, abs(step)):
                done.add(s)
            tilt[s] = step
    return tilt


CELLS = "source string, size long, n long, copies long"


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's cells, one row per distinct size: whole copies by carrying what is lacking from long to short."""
    pdf = pdf.sort_values("size", ascending=False)
    goal, tilt, mean = float(pdf["target"].iloc[0]), float(pdf["tilt"].iloc[0]), float(pdf["mean"].iloc[0])
    out, ideal, taken = [], 0.0, 0
    rates = [float(MAX_RATE) if math.isinf(tilt) else _rate(tilt, z / mean if mean else 0.0) for z in pdf["size"]]
    for z, n, r in zip(pdf["size"], pdf["n"], rates, strict=True):
        z, n = int(z), int(n)
        ideal += z * n * r
        if z == 0:
            out.append(n)
            continue
        k = min(MAX_RATE * n, max(0, math.floor((min(ideal, goal) - taken) / z + 0.5)))
        taken += k * z
        out.append(k)
    return pd.DataFrame({"source": pdf["source"].to_numpy(), "size": pdf["size"].to_numpy(), "n": pdf["n"].to_numpy(), "copies": out})


def copies(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """rows, from sized(), with source_size, target and copies (0, 1 or 2)."""
    spark = rows.sparkSession
    cells = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    # one row a source: the mix's plan, as long as its configuration
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.max("n").alias("most")).collect()
    per = {r["source"]: (int(r["words"] or 0), int(r["docs"])) for r in sums}
    wanted = targets([(s, n) for s, (n, _) in per.items()], weights, share)
    tilt = solve(cells, wanted, {s: d for s, (_, d) in per.items()})
    plan = spark.createDataFrame([(t.source, t.size, float(t.target), tilt[t.source], t.size / per[t.source][1]) for t in wanted], "source string, source_size long, target double, tilt double, mean double")
    joined = cells.join(if_small(plan, len(wanted)), cells["source"].eqNullSafe(plan["source"])).select(cells["source"], "size", "n", "target", "tilt", "mean")
    rounded = materialize(joined.groupBy("source").applyInPandas(_round, CELLS), "copies")
    ranked = salted_rank(rows.withColumn("_h", F.xxhash64("doc_id", "digest")), ["source", "size"], ["_h", "doc_id", "digest"], most=max((r["most"] for r in sums), default=0), ties=("rid",))
    rounded = rounded.hint("merge")  # cells grow with the corpus, and a compressed file's size says little about their broadcast
    with_cell = ranked.join(rounded, ranked["source"].eqNullSafe(rounded["source"]) & (ranked["size"] == rounded["size"])).select(
        "doc_id", "rid", ranked["source"], ranked["size"],
        (F.floor(F.col("copies") / F.col("n")) + (F.col("rank") < F.col("copies") % F.col("n")).cast("int")).cast("int").alias("copies"),
    )
    return with_cell.join(if_small(plan, len(wanted)), with_cell["source"].eqNullSafe(plan["source"])).select("doc_id", "rid", with_cell["source"], "size", "source_size", "target", "copies")


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, rid, source, size, source_size, target, copies, taken of every row of docs."""
    rows = materialize(sized(docs), "sizes")
    return copies(rows).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns as they were."""
    rows = with_rid(docs)
    changed = materialize(mix_plan(rows).where("copies <> 1").select("rid", "doc_id", F.col("copies").alias(f"{RID}_copies")), "changed")
    # rows that are taken once stay where they are read
    joined = of_rows(may_be_in(rows, changed, RID), changed, "left").withColumn(f"{RID}_copies", F.coalesce(f"{RID}_copies", F.lit(1)))
    again = joined.where(f"{RID}_copies > 0").withColumn(f"{RID}_k", F.explode(F.sequence(F.lit(1), f"{RID}_copies")))
    return is_not_in(rows, changed, RID).select(*docs.columns).unionByName(again.select(*docs.columns))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source", "source_size", "target", "copies", "taken")

