"""Retrieval and routing evaluation: all cases and modes in one pass."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import work_dir
from . import routing

# Thresholds tried by the sweep.
FLOORS = (4.0, 6.0, 8.0, 10.0)
MARGINS = (1.0, 1.3, 1.6, 2.0)
MODES = ("keyword", "semantic", "hybrid_raw", "hybrid_query_pin", "hybrid_topic_pin")


# --- scores per case ---------------------------------------------------------------------------


def score_cases(
    cases: DataFrame, expected: DataFrame, ranked: DataFrame, k: int, modes: tuple[str, ...]
) -> DataFrame:
    """(case_id, negative, mode, hits, precision, recall, success, rr) for every case and mode.

    ``cases``: case_id, negative. ``expected``: case_id, path. ``ranked``: mode, case_id, path, rank.
    """
    norm = text.drop_dot_slash("path").alias("path")
    want = expected.select("case_id", norm).distinct()
    found = (
        ranked.where(F.col("rank") <= k)
        .select("mode", "case_id", norm, "rank")
        .join(want.withColumn("hit", F.lit(1)), ["case_id", "path"], "left")
        .groupBy("case_id", "mode")
        .agg(
            F.count(F.lit(1)).alias("n_retrieved"),
            F.count("hit").alias("n_hits"),
            F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        )
    )
    sizes = want.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected"))
    grid = cases.select(
        "case_id", "negative", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode")
    )
    rows = grid.join(found, ["case_id", "mode"], "left").join(sizes, "case_id", "left")
    hits = F.when(F.col("negative"), 0).otherwise(F.coalesce("n_hits", F.lit(0)))
    share = lambda d: F.when(hits > 0, hits / F.col(d)).otherwise(0.0)
    return rows.select(
        "case_id",
        "negative",
        "mode",
        hits.alias("hits"),
        share("n_retrieved").alias("precision"),
        share("n_expected").alias("recall"),
        (hits > 0).alias("success"),
        F.when(hits > 0, 1.0 / F.col("first_hit")).otherwise(0.0).alias("rr"),
    )


def routing_hits(cases: DataFrame, routes: DataFrame) -> DataFrame:
    """(case_id, negative, path, expected_brief, routing_hit); null expected means: must abstain."""
    want = F.when(F.col("negative"), F.lit(None)).otherwise(F.col("expected_brief"))
    return cases.join(routes.select(F.col("query_id").alias("case_id"), "path", "method"), "case_id").select(
        "case_id",
        "negative",
        "path",
        "method",
        "expected_brief",
        text.drop_dot_slash("path").eqNullSafe(text.drop_dot_slash(want)).alias("routing_hit"),
    )


# --- aggregates -------------------------------------------------------------------------------


def aggregate_modes(scores: DataFrame) -> DataFrame:
    """Means over the positive cases, one row per mode."""
    pos = ~F.col("negative")
    mean = lambda c: F.coalesce(F.avg(F.when(pos, c)), F.lit(0.0))
    return scores.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(pos).alias("n_positive"),
        mean(F.col("recall")).alias("recall"),
        mean(F.col("success").cast("double")).alias("success"),
        mean(F.col("rr")).alias("mrr"),
        mean(F.col("precision")).alias("precision"),
    )


def aggregate_routing(hits: DataFrame) -> DataFrame:
    ok = F.col("routing_hit").cast("double")
    return hits.agg(
        F.coalesce(F.avg(F.when(~F.col("negative"), ok)), F.lit(0.0)).alias("routing_accuracy"),
        F.coalesce(F.avg(F.when(F.col("negative"), ok)), F.lit(1.0)).alias("negative_accuracy"),
    )


def by_stratum(scores: DataFrame, hits: DataFrame, cases: DataFrame, mode: str) -> DataFrame:
    """Success and negative accuracy per stratum and overall (stratum null), from one rollup."""
    rows = (
        scores.where(F.col("mode") == mode)
        .join(hits.select("case_id", "routing_hit"), "case_id")
        .join(cases.select("case_id", "stratum"), "case_id")
    )
    return rows.rollup("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(~F.col("negative"), F.col("success").cast("double"))).alias("success"),
        F.avg(F.when(F.col("negative"), F.col("routing_hit").cast("double"))).alias("negative_accuracy"),
    )


def parity_delta(modes: DataFrame) -> DataFrame:
    """Topic-pin minus query-pin: what the evaluation's clean topic adds."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    return modes.agg(
        (pick("hybrid_topic_pin", "recall") - pick("hybrid_query_pin", "recall")).alias("recall_delta"),
        (pick("hybrid_topic_pin", "success") - pick("hybrid_query_pin", "success")).alias("success_delta"),
    )


def _routing_metrics(group: list[str], rows: DataFrame) -> DataFrame:
    routed = F.col("path").isNotNull()
    neg = F.col("negative")
    right = ~neg & routed & (text.drop_dot_slash("path") == F.col("expected_brief"))
    right = F.coalesce(right, F.lit(False))
    n = F.count(F.lit(1))
    return rows.groupBy(*group).agg(
        n.alias("n_cases"),
        F.count_if(routed).alias("n_routed"),
        F.when(F.count_if(routed) > 0, F.count_if(right) / F.count_if(routed)).otherwise(1.0).alias("precision"),
        F.when(F.count_if(~neg) > 0, F.count_if(right) / F.count_if(~neg)).otherwise(0.0).alias("recall"),
        (F.count_if(~routed) / n).alias("abstention"),
        F.when(F.count_if(neg) > 0, F.count_if(neg & ~routed) / F.count_if(neg))
        .otherwise(1.0)
        .alias("negative_accuracy"),
        F.count_if(routed & ~right).alias("wrong_routes"),
    )


def routing_quality(cases: DataFrame, routes: DataFrame) -> DataFrame:
    rows = cases.join(routes.select(F.col("query_id").alias("case_id"), "path"), "case_id")
    return _routing_metrics([], rows)


def routing_sweep(
    cases: DataFrame,
    candidates: DataFrame,
    floors: tuple[float, ...] = FLOORS,
    margins: tuple[float, ...] = MARGINS,
) -> DataFrame:
    """Routing quality for every pair of thresholds. Candidates are computed once; each row is
    expanded over the fixed grid of thresholds."""
    grid = F.array(
        *[
            F.struct(F.lit(f).alias("floor"), F.lit(m).alias("min_margin"))
            for f in floors
            for m in margins
        ]
    )
    c = candidates.withColumn("g", F.explode(grid)).select("*", "g.floor", "g.min_margin")
    decided = routing.decide(c, F.col("floor"), F.col("min_margin"), keep=("floor", "min_margin"))
    rows = decided.join(
        cases.select(F.col("case_id").alias("query_id"), "negative", "expected_brief"), "query_id"
    )
    return _routing_metrics(["floor", "min_margin"], rows)


# --- pins that hurt ------------------------------------------------------------------------------


def pin_harm(
    cases: DataFrame,
    expected: DataFrame,
    routes: DataFrame,
    candidates: DataFrame,
    raw: DataFrame,
    pinned: DataFrame,
    k: int,
) -> DataFrame:
    """Per case: wrong_route, applied (the pin was retrieved), and the regression it caused.

    ``candidates``: case_id, path of everything retrieved; ``raw`` / ``pinned``: fused lists.
    """
    want = expected.select("case_id", text.drop_dot_slash("path").alias("path")).distinct()

    def best(lists: DataFrame, name: str) -> DataFrame:
        return (
            lists.where(F.col("rank") <= k)
            .select("case_id", text.drop_dot_slash("path").alias("path"), "rank")
            .join(want, ["case_id", "path"])
            .groupBy("case_id")
            .agg(F.min("rank").alias(name))
        )

    r = routes.select(F.col("query_id").alias("case_id"), text.drop_dot_slash("path").alias("path"))
    applied = (
        r.join(candidates.select("case_id", text.drop_dot_slash("path").alias("path")).distinct(), ["case_id", "path"], "left_semi")
        .select("case_id", F.lit(True).alias("retrieved"))
    )
    rows = (
        cases.select("case_id", "negative", "expected_brief")
        .join(r, "case_id", "left")
        .join(applied, "case_id", "left")
        .join(best(raw, "raw_best"), "case_id", "left")
        .join(best(pinned, "pin_best"), "case_id", "left")
    )
    wrong = F.col("path").isNotNull() & ~F.col("path").eqNullSafe(F.col("expected_brief"))
    hit = wrong & F.coalesce("retrieved", F.lit(False))
    severe = hit & ~F.col("negative") & F.col("raw_best").isNotNull() & F.col("pin_best").isNull()
    mild = hit & ~F.col("negative") & (F.coalesce("raw_best", F.lit(0)) == 1) & (
        F.coalesce("pin_best", F.lit(0)) != 1
    )
    return rows.select(
        "case_id",
        wrong.alias("wrong_route"),
        hit.alias("applied"),
        F.when(severe, "severe").when(mild, "rank1_lost").otherwise("none").alias("regression"),
    )


def misses(scores: DataFrame, hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases the live mode or the routing got wrong, with how every mode did."""
    flags = scores.groupBy("case_id").agg(
        *[
            F.coalesce(F.bool_or(F.when(F.col("mode") == m, F.col("success"))), F.lit(False)).alias(m)
            for m in MODES
        ]
    )
    rows = cases.select("case_id", "stratum").join(hits, "case_id").join(flags, "case_id")
    missed = F.when(F.col("negative"), ~F.col("routing_hit")).otherwise(
        ~F.col("hybrid_query_pin") | ~F.col("routing_hit")
    )
    return rows.where(missed).select(
        "case_id",
        "stratum",
        "negative",
        *MODES,
        F.when(F.col("routing_hit"), "ok")
        .otherwise(F.concat(F.coalesce("path", F.lit("abstain")), F.lit(" ("), "method", F.lit(")")))
        .alias("routing"),
        F.coalesce("expected_brief", F.lit("none")).alias("wanted"),
    )


# --- bootstrap ---------------------------------------------------------------------------------------

# The linear congruential generator behind reproducible intervals.
LCG_A, LCG_C, LCG_M = 1664525, 1013904223, 2**32
_LCG_BITS = 40


def lcg_steps() -> list[tuple[int, int]]:
    """(a, c) of 2^j steps of the generator, j = 0, 1, …: jumping ahead is a few of these."""
    out, a, c = [], LCG_A, LCG_C
    for _ in range(_LCG_BITS):
        out.append((a, c))
        a, c = a * a % LCG_M, (a * c + c) % LCG_M
    return out


def _times(x: Column, a: Column) -> Column:
    """x * a modulo 2^32, in two halves so that BIGINT does not overflow."""
    high = (x * F.floor(a / 65536).cast("long")) % LCG_M
    return (high * 65536 + x * (a % 65536)) % LCG_M


def lcg_jump(n: Column) -> Column:
    """struct(a, c): what ``n`` steps of the generator do to a state, without taking them."""
    powers = F.array(
        *[
            F.struct(F.lit(j).alias("j"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c"))
            for j, (a, c) in enumerate(lcg_steps())
        ]
    )
    taken = F.filter(
        powers, lambda s: F.pmod(F.floor(n / F.pow(F.lit(2.0), s["j"])).cast("long"), F.lit(2)) == 1
    )
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("c"))
    return F.aggregate(
        taken,
        start,
        lambda x, s: F.struct(
            _times(x["a"], s["a"]).alias("a"), ((_times(x["c"], s["a"]) + s["c"]) % LCG_M).alias("c")
        ),
    )


def _advance(state: Column, jump: Column) -> Column:
    return (_times(state, jump["a"]) + jump["c"]) % LCG_M


VALUE_BLOCK = 1 << 20  # values of a group that one task holds
DRAWS_PER_TASK = 1 << 27
_RUN = 1 << 16  # draws that are taken at once


def steps_taken(k: int) -> tuple[int, int]:
    """(a, c) of ``k`` steps of the generator."""
    a, c = 1, 0
    for j, (step_a, step_c) in enumerate(lcg_steps()):
        if k >> j & 1:
            a, c = a * step_a % LCG_M, (c * step_a + step_c) % LCG_M
    return a, c


def _drawn(table: pa.Table, names: list[str], iters: int, seed: int) -> pa.Table:
    """Per iteration of one share, the sum of the drawn values among those of one block, and how many of these are not null."""
    n, share, shares = (table[c][0].as_py() for c in ("n", "share", "shares"))
    ix, v = table["ix"].to_numpy(), table["v"].to_numpy()
    low, known = ix.min(), np.zeros(ix.max() - ix.min() + 1)
    values = known.copy()
    there = np.asarray(table["v"].is_valid())
    values[ix[there] - low], known[ix[there] - low] = v[there], 1
    whole = bool(known.all()) and len(known) == n
    first, last = share * iters // shares, (share + 1) * iters // shares
    # uint32 wraps like the generator: what 1, 2, ... steps do to a state.
    a = np.cumprod(np.full(_RUN, LCG_A, np.uint32), dtype=np.uint32)
    c = np.cumsum(np.append(np.uint32(1), a[:-1]), dtype=np.uint32) * np.uint32(LCG_C)
    total, seen = np.zeros(last - first), np.zeros(last - first)
    jump_a, jump_c = steps_taken(first * n)
    state = (seed % LCG_M * jump_a + jump_c) % LCG_M
    for start in range(first * n, last * n, _RUN):
        size = min(_RUN, last * n - start)
        states = a[:size] * np.uint32(state) + c[:size]
        state = int(states[-1])
        at = (states / float(LCG_M) * n).astype(np.int64) - low
        it = np.arange(start, start + size) // n - first
        if not whole:
            inside = (at >= 0) & (at < len(values))
            at, it = at[inside], it[inside]
        if len(it):
            base = it[0]
            span = slice(base, it[-1] + 1)
            total[span] += np.bincount(it - base, values[at])
            seen[span] += np.bincount(it - base, known[at])
    rows = last - first
    columns = [table[c].take(pa.array(np.zeros(rows, np.int64))) for c in names]
    columns += [pa.array(np.arange(first, last, dtype=np.int32)), pa.array(total), pa.array(seen.astype(np.int64)), pa.array(np.full(rows, n))]
    return pa.table(columns, names=[*names, "it", "total", "seen", "n"])


def bootstrap_ci(
    values: DataFrame, group: list[str], order: str, value: str, iters: int = 1000, seed: int = 42
) -> DataFrame:
    """95 % interval of the mean per group: (group…, n, mean, lo, hi).

    Draw i of iteration t is number t * n + i of the generator, which tasks jump straight to; the value is that at the
    drawn position. Null values count as rows and add nothing.
    """
    if not group:
        one = values.withColumn("_all", F.lit(0))
        return bootstrap_ci(one, ["_all"], order, value, iters, seed).drop("_all")
    spark = values.sparkSession
    cols = [*group, order, value]
    # Positions without a single-task window: sorted by range and written once, which fixes part and place of each row; a
    # part starts where the ones before it end (one row per part).
    place = F.monotonically_increasing_id()
    path = work_dir(spark, "bootstrap")
    values.select(*cols).orderBy(*group, order).select(
        *cols, F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    ).write.parquet(path)
    placed = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    numbered = placed.join(starts, "part").select(*cols, (F.col("start") + F.col("at")).alias("g_ix"))
    sizes = numbered.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("g_ix").alias("g0"), F.avg(value).alias("mean")
    )
    # The draws of a group are one run of the generator, n for each iteration. Each task holds one block of a group's values,
    # takes the draws of some iterations and adds up those that fall on its block; draws are never rows.
    shares = F.least(F.lit(iters), F.ceil(F.col("n") * iters / DRAWS_PER_TASK)).cast("int")
    at = numbered.join(sizes, group).select(
        *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)],
        (F.col("g_ix") - F.col("g0")).alias("ix"),
        F.col(value).cast("double").alias("v"),
        "n",
        shares.alias("shares"),
    )
    names = [f"g{i}" for i in range(len(group))]
    dealt = at.withColumn("block", F.floor(F.col("ix") / VALUE_BLOCK).cast("long")).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    )
    kinds = ", ".join(f"{n} {kind}" for n, kind in dealt.select(*names).dtypes)
    sums = dealt.groupBy(*names, "block", "share").applyInArrow(
        lambda table: _drawn(table, names, iters, seed), f"{kinds}, it int, total double, seen bigint, n bigint"
    )
    total = F.when(F.sum("seen") > 0, F.sum("total"))
    means = sums.groupBy(*[F.col(x).alias(c) for x, c in zip(names, group, strict=True)], "it").agg((total / F.max("n")).alias("m"))
    w = Window.partitionBy(*group).orderBy("m")
    ranked = means.withColumn("r", F.row_number().over(w) - 1)
    lo, hi = int(iters * 0.025), int(iters * 0.975)
    ends = ranked.groupBy(*group).agg(
        F.max(F.when(F.col("r") == lo, F.col("m"))).alias("lo"),
        F.max(F.when(F.col("r") == hi, F.col("m"))).alias("hi"),
    )
    return sizes.select(*group, "n", "mean").join(ends, group)


def poisson_steps() -> list[int]:
    """Places in 0 .. 2^32 from which a uniform draw stands for 1, 2, … rows: the Poisson(1) distribution summed up."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        at = math.floor(total * LCG_M)
        if at >= LCG_M - 1:
            return out
        out.append(at)
        k += 1


def jumps(iters: int) -> list[tuple[int, int]]:
    """(a, c) of 1, 2, … steps of the generator."""
    out = [(LCG_A, LCG_C)]
    while len(out) < iters:
        a, c = out[-1]
        out.append((a * LCG_A % LCG_M, (c * LCG_A + LCG_C) % LCG_M))
    return out


def bootstrap_weighted(
    values: DataFrame, group: list[str], order: str, value: str, iters: int = 1000, seed: int = 42
) -> DataFrame:
    """95 % interval of the mean per group in one pass: (group…, n, mean, lo, hi).

    In place of drawn positions each row has a Poisson(1) weight per iteration, from the generator started at a digest of
    the seed and the row's ``order``. Rows need no numbering and are never joined; sums per (group, iteration) are
    combined before the only shuffle of rows, so a group of any size is ``iters`` sums per task. ``bootstrap_ci`` gives
    the intervals of the sequential generator itself.

    Null values are left out, a null group is a group, a null ``order`` counts as the empty text, rows that repeat an
    ``order`` have equal weights. An iteration in which all weights are 0 has the mean of the group.
    """
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(order).cast("string"), F.lit("")))
    start = F.conv(F.substring(F.md5(own.cast("binary")), 1, 8), 16, 10).cast("long")
    # Constants of the plan, whatever the input; entry 0 takes each row once and gives size and mean.
    entries = json.dumps([{"a": 0, "c": 0}, *({"a": a, "c": c} for a, c in jumps(iters))])
    steps = F.from_json(F.lit(entries), "array<struct<a:bigint,c:bigint>>")
    drawn = (
        values.where(F.col(value).isNotNull())
        .select(*group, F.col(value).cast("double").alias("_v"), start.alias("_s"))
        .select(*group, "_v", "_s", F.posexplode(steps).alias("_it", "_j"))
        .select(*group, "_v", "_it", _advance(F.col("_s"), F.col("_j")).alias("_u"))
    )
    weight = sum((F.when(F.col("_u") >= at, 1).otherwise(0) for at in poisson_steps()), F.lit(0))
    sums = (
        drawn.select(*group, "_v", "_it", F.when(F.col("_it") == 0, 1).otherwise(weight).alias("_w"))
        .groupBy(*group, "_it")
        .agg(F.sum(F.col("_v") * F.col("_w")).alias("_t"), F.sum("_w").alias("_n"))
    )
    mean = F.when(F.col("_n") > 0, F.col("_t") / F.col("_n"))
    out = sums.groupBy(*group).agg(
        F.max(F.when(F.col("_it") == 0, F.col("_n"))).alias("n"),
        F.max(F.when(F.col("_it") == 0, mean)).alias("mean"),
        F.collect_list(F.when(F.col("_it") > 0, F.struct(mean.alias("m")))).alias("_m"),
    )
    if not group:
        out = out.where("n IS NOT NULL")
    ranked = F.array_sort(F.transform("_m", lambda x: F.coalesce(x["m"], F.col("mean"))))
    at = lambda share: F.element_at(ranked, int(iters * share) + 1)
    return out.select(*group, "n", "mean", at(0.025).alias("lo"), at(0.975).alias("hi"))
