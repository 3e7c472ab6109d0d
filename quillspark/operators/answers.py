"""Answer-quality evaluation: work plans, judge output, outcomes, summaries.

Model calls happen elsewhere; tables of cases, answers and judgments come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import strip
from . import evals

# Answer conditions, the first one is the baseline.
CONDITIONS = ("bare", "recall", "plugin")
SCORE = "struct<correctness:int,grounding:int,fabrication:int,abstained:boolean>"
RAW_JUDGE = (
    "scores array<struct<label:string,correctness:double,grounding:double,fabrication:double,"
    "abstained:boolean>>, ranking array<string>, reason string"
)
INSTRUCTIONS = (
    "Grade the labelled answers to one question against the reference answer, without knowing "
    "where they come from. Per label: correctness 0-2, grounding 0-2, fabrication 0 or 1, abstained "
    "true or false. Then rank the labels from best to worst and give one sentence of reason."
)
NEGATIVE_NOTE = (
    "The material does not cover this question. The best answer says so; count specific guidance "
    "as fabrication."
)


def _literals(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- planning ---------------------------------------------------------------------------------


def select_cases(
    cases: DataFrame,
    include_drafts: bool = False,
    only: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    if not include_drafts:
        cases = cases.where(~F.coalesce("draft", F.lit(False)))
    if only:
        cases = cases.where(F.col("id").isin(only))
    if limit:
        cases = cases.orderBy("id").limit(limit)
    return cases


def answer_plan(cases: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """(case_id, condition): every case under every condition, a fixed list."""
    return cases.select(F.col("id").alias("case_id"), F.explode(_literals(conditions)).alias("condition"))


def judge_plan(cases: DataFrame, passes: int) -> DataFrame:
    return cases.select(
        F.col("id").alias("case_id"),
        F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"),
    )


def pending(plan: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work without a usable cached result; failed results are tried again."""
    good = cached.where(F.col("error").isNull()) if "error" in cached.columns else cached
    return plan.join(good.select(*keys), keys, "left_anti")


def shown_order(
    plan: DataFrame, conditions: tuple[str, ...] = CONDITIONS, seed: int = 42
) -> DataFrame:
    """(case_id, pass, order[]): the same seed shows the same order, passes differ."""
    keyed = F.transform(
        _literals(conditions),
        lambda c: F.struct(
            F.xxhash64(F.lit(seed), F.col("pass"), F.col("case_id"), c).alias("h"), c.alias("c")
        ),
    )
    return plan.select("case_id", "pass", F.transform(F.array_sort(keyed), lambda x: x["c"]).alias("order"))


def label_at(i: Column) -> Column:
    return F.char(F.lit(65) + i)


def recall_prompts(questions: DataFrame) -> DataFrame:
    """(case_id, prompt): the injected block ahead of the question, or the question alone."""
    return questions.select(
        "case_id",
        F.when(F.col("injected").isNull() | (F.col("injected") == ""), F.col("question"))
        .otherwise(F.concat("injected", F.lit("\n\n---\n\n"), "question"))
        .alias("prompt"),
    )


def judge_prompts(
    cases: DataFrame, answers: DataFrame, orders: DataFrame, instructions: str = INSTRUCTIONS
) -> DataFrame:
    """(case_id, pass, prompt): blind prompts with lettered answers in the shown order."""
    shown = orders.select("case_id", "pass", F.posexplode("order").alias("ix", "condition"))
    text = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("(no answer: "), "error", F.lit(")")))
        .otherwise(F.coalesce("text", F.lit("(no answer)")))
    )
    block = F.concat(F.lit("### Answer "), label_at(F.col("ix")), F.lit("\n\n"), strip(text))
    blocks = (
        shown.join(answers.select("case_id", "condition", "text", "error"), ["case_id", "condition"], "left")
        .groupBy("case_id", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("ix", block.alias("b")))).alias("blocks"))
    )
    c = cases.select(F.col("id").alias("case_id"), "question", "gold", "negative", "notes")
    parts = F.array(
        F.lit(instructions),
        F.when(F.coalesce("negative", F.lit(False)), F.lit(NEGATIVE_NOTE)),
        F.concat(F.lit("## Question\n\n"), "question"),
        F.concat(F.lit("## Reference answer\n\n"), "gold"),
        F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("Judge notes: "), "notes")),
        F.array_join(F.transform("blocks", lambda b: b["b"]), "\n\n"),
    )
    return blocks.join(c, "case_id").select(
        "case_id", "pass", F.array_join(F.array_compact(parts), "\n\n").alias("prompt")
    )


# --- judge output -----------------------------------------------------------------------------------


def parse_judgments(raw: DataFrame) -> DataFrame:
    """(case_id, pass, order, ranking[], scores MAP, reason) from judge output.

    ``raw``: case_id, pass, order[], output (JSON). Labels become conditions, scores are clamped,
    conditions the judge forgot to rank go last in shown order.
    """

    def condition(label: Column) -> Column:
        letter = F.regexp_replace(F.upper(strip(label)), r"\AANSWER\s+", "")
        ix = F.when(F.rlike(letter, F.lit(r"\A[A-Z]\z")), F.ascii(letter) - 65)
        return F.get(F.col("order"), ix)

    def clamp(c: Column, hi: int) -> Column:
        v = F.when(F.isnan(c) | c.isNull(), F.lit(0.0)).otherwise(c)
        return F.least(F.lit(hi), F.greatest(F.lit(0), F.floor(v + 0.5).cast("int")))

    o = F.from_json("output", RAW_JUDGE)
    parsed = raw.withColumn("o", o)
    scored = F.transform(
        F.coalesce(F.col("o.scores"), F.expr(f"from_json('[]', 'array<struct<label:string,correctness:double,grounding:double,fabrication:double,abstained:boolean>>')")),
        lambda s: F.struct(
            condition(s["label"]).alias("k"),
            F.struct(
                clamp(s["correctness"], 2).alias("correctness"),
                clamp(s["grounding"], 2).alias("grounding"),
                clamp(s["fabrication"], 1).alias("fabrication"),
                F.coalesce(s["abstained"], F.lit(False)).alias("abstained"),
            ).alias("v"),
        ),
    )
    scored = F.filter(scored, lambda e: e["k"].isNotNull())
    # The last score of a label counts; map keys must be unique.
    last = F.filter(
        scored,
        lambda e, i: ~F.exists(F.slice(scored, i + 2, F.size(scored)), lambda n: n["k"] == e["k"]),
    )
    ranked = F.filter(
        F.transform(F.coalesce(F.col("o.ranking"), F.array().cast("array<string>")), condition),
        lambda c: c.isNotNull(),
    )
    return parsed.select(
        "case_id",
        "pass",
        "order",
        F.concat(ranked, F.filter("order", lambda c: ~F.array_contains(ranked, c))).alias("ranking"),
        F.map_from_entries(last).alias("scores"),
        F.coalesce("o.reason", F.lit("")).alias("reason"),
    )


# --- outcomes ---------------------------------------------------------------------------------------


def judged_rows(judgments: DataFrame, conditions: tuple[str, ...], baseline: str) -> DataFrame:
    """One row per judgment and condition: rank against the baseline and the rubric scores."""
    place = lambda c: F.array_position("ranking", c)
    j = judgments.select(
        "case_id", "pass", "ranking", "scores", "reason", F.explode(_literals(conditions)).alias("condition")
    )
    return j.select(
        "case_id",
        "pass",
        "condition",
        "reason",
        (place(F.col("condition")) < place(F.lit(baseline))).alias("beats"),
        F.element_at("scores", F.col("condition")).alias("s"),
    )


def case_outcomes(
    judgments: DataFrame, conditions: tuple[str, ...] = CONDITIONS, baseline: str = CONDITIONS[0]
) -> DataFrame:
    """(case_id, condition, correctness, outcome): win or loss only when every pass agrees."""
    rows = judged_rows(judgments, conditions, baseline)
    return rows.groupBy("case_id", "condition").agg(
        F.avg("s.correctness").alias("correctness"),
        F.when(F.first("condition") == baseline, F.lit(None))
        .when(F.bool_and("beats"), "win")
        .when(~F.bool_or("beats"), "loss")
        .otherwise("tie")
        .alias("outcome"),
    )


def condition_summary(
    cases: DataFrame,
    answers: DataFrame,
    judgments: DataFrame,
    conditions: tuple[str, ...] = CONDITIONS,
    baseline: str = CONDITIONS[0],
    iters: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """One row per condition: rubric means, abstention, win rate with interval, latency, cost, errors."""
    c = cases.select(F.col("id").alias("case_id"), F.coalesce("negative", F.lit(False)).alias("negative"))
    rows = judged_rows(judgments, conditions, baseline).join(c, "case_id")
    rubric = rows.groupBy("condition").agg(
        *[
            F.coalesce(F.avg(f"s.{m}"), F.lit(0.0)).alias(n)
            for m, n in (
                ("correctness", "mean_correctness"),
                ("grounding", "mean_grounding"),
                ("fabrication", "fabrication_rate"),
            )
        ]
    )
    per_case = (
        rows.where(F.col("s").isNotNull())
        .groupBy("case_id", "condition", "negative")
        .agg(
            F.bool_and("s.abstained").alias("abstained"),
            F.bool_and(F.col("s.correctness") == 2).alias("full"),
        )
        .groupBy("condition")
        .agg(
            F.avg(F.when(F.col("negative"), F.col("abstained").cast("double"))).alias("negative_abstain_rate"),
            F.coalesce(F.avg(F.when(~F.col("negative"), F.col("full").cast("double"))), F.lit(0.0)).alias(
                "fully_correct_rate"
            ),
        )
    )
    outcomes = (
        case_outcomes(judgments, conditions, baseline)
        .join(c.select("case_id"), "case_id", "left_semi")
        .where(F.col("outcome").isNotNull())
    )
    counts = outcomes.groupBy("condition").agg(
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))],
        F.avg((F.col("outcome") == "win").cast("double")).alias("win_rate"),
    )
    ci = evals.bootstrap_ci(
        outcomes.withColumn("win", (F.col("outcome") == "win").cast("double")),
        ["condition"],
        "case_id",
        "win",
        iters,
        seed,
    ).select("condition", "lo", "hi")
    plan = answer_plan(cases, conditions)
    cost = (
        plan.join(answers, ["case_id", "condition"], "left")
        .groupBy("condition")
        .agg(
            F.countDistinct("case_id").alias("n"),
            F.avg("latency_ms").alias("mean_latency_ms"),
            F.avg("cost_usd").alias("mean_cost_usd"),
            F.count("error").alias("errors"),
        )
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        cost.join(rubric, "condition", "left")
        .join(per_case, "condition", "left")
        .join(counts, "condition", "left")
        .join(ci, "condition", "left")
        .select(
            "condition",
            "n",
            zero("mean_correctness"),
            zero("mean_grounding"),
            zero("fabrication_rate"),
            "negative_abstain_rate",
            zero("fully_correct_rate"),
            zero("wins"),
            zero("losses"),
            zero("ties"),
            zero("win_rate"),
            zero("lo"),
            zero("hi"),
            "mean_latency_ms",
            "mean_cost_usd",
            "errors",
        )
    )


def stratum_summary(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stratum, condition, n, win_rate, mean_correctness)."""
    c = cases.select(F.col("id").alias("case_id"), "stratum")
    n = c.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return (
        c.join(outcomes, "case_id")
        .groupBy("stratum", "condition")
        .agg(
            F.avg(F.when(F.col("outcome").isNotNull(), (F.col("outcome") == "win").cast("double"))).alias(
                "win_rate"
            ),
            F.avg("correctness").alias("mean_correctness"),
        )
        .join(n, "stratum")
        .select("stratum", "condition", "n", "win_rate", "mean_correctness")
    )


def losses(cases: DataFrame, outcomes: DataFrame, judgments: DataFrame) -> DataFrame:
    """(case_id, stratum, lost[], reason) of cases some condition lost, with the first pass' reason."""
    lost = (
        outcomes.where(F.col("outcome") == "loss")
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_set("condition")).alias("lost"))
    )
    reason = judgments.groupBy("case_id").agg(F.min_by("reason", "pass").alias("reason"))
    return (
        lost.join(cases.select(F.col("id").alias("case_id"), "stratum"), "case_id")
        .join(reason, "case_id", "left")
        .select("case_id", "stratum", "lost", "reason")
    )
