"""Champion / challenger gates and the decision log.

A decision log has one row per trained configuration, so its windows and its fold
run over a handful of rows; the metrics behind it come from whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.verdict import class_status

PROMOTED, REJECTED = "PROMOTED", "REJECTED"


def _attack_with_support() -> Column:
    return (F.col("support") > 0) & (F.col("label_class") != config.BENIGN)


def gate_metrics(per_class: DataFrame, summary: DataFrame, by: Sequence[str] = ("model",), ceiling: float = config.MAX_CLASS_FNR) -> DataFrame:
    """What the gates look at: summary figures, worst attack class, classes over the
    ceiling (highest miss rate first) and classes that had no test rows."""
    attack = _attack_with_support()
    over = attack & (F.col("fnr") > F.lit(ceiling))
    rank = F.struct("fnr", (-F.col("class_id")).alias("_first"))
    breach = F.struct((-F.col("fnr")).alias("_down"), "class_id", "label_class", "fnr")
    detail = per_class.groupBy(*by).agg(
        F.max_by(F.when(attack, F.col("label_class")), F.when(attack, rank)).alias("worst_attack_class"),
        F.max(F.when(attack, F.col("fnr"))).alias("worst_attack_fnr"),
        F.array_sort(F.collect_list(F.when(over, breach))).alias("_breaches"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("support") == 0, F.struct("class_id", "label_class")))),
            lambda x: x["label_class"],
        ).alias("classes_without_test_support"),
    )
    breaches = F.transform("_breaches", lambda x: F.struct(x["label_class"].alias("label_class"), x["fnr"].alias("fnr")))
    figures = summary.select(*by, "accuracy", "macro_f1", "mean_attack_fnr", "macro_attack_f1")
    return figures.join(detail.withColumn("breaches", breaches).drop("_breaches"), list(by))


def breaches(per_class: DataFrame, by: Sequence[str] = ("model",), ceiling: float = config.MAX_CLASS_FNR) -> DataFrame:
    """Attack classes over the ceiling, worst first."""
    return (
        per_class.where(_attack_with_support() & (F.col("fnr") > F.lit(ceiling)))
        .select(*by, "class_id", "label_class", "fnr")
        .orderBy(*by, F.desc("fnr"), "class_id")
    )


def class_report(per_class: DataFrame, ceiling: float = config.MAX_CLASS_FNR) -> DataFrame:
    """Per-class status of a model: OK, BREACH or NO_TEST_SUPPORT."""
    return per_class.withColumn("status", class_status(F.col("label_class"), F.col("support"), F.col("fnr"), ceiling))


def production_report(per_class: DataFrame, champion: DataFrame, ceiling: float = config.MAX_CLASS_FNR) -> DataFrame:
    """The class report of the model now in production (``champion`` has one row)."""
    current = F.broadcast(champion.select("model"))
    return class_report(per_class.join(current, "model"), ceiling)


def decide(
    challengers: DataFrame,
    min_gain: float = config.MIN_F1_GAIN,
    max_mean_fnr: float = config.MAX_MEAN_FNR,
    max_class_fnr: float = config.MAX_CLASS_FNR,
) -> DataFrame:
    """Gates, reasons and verdict for each challenger row.

    A row holds the challenger's gate metrics and, where there is an incumbent,
    ``champion``, ``champion_macro_f1`` and ``champion_attack_fnr``; NULL there
    means the first promotion, ruled by the absolute gates alone.
    """
    fnr, f1 = F.col("mean_attack_fnr"), F.col("macro_f1")
    old_f1, old_fnr = F.col("champion_macro_f1"), F.col("champion_attack_fnr")
    incumbent = F.col("champion").isNotNull()
    text = F.format_string
    gate = lambda name, passed, detail: F.struct(
        F.lit(name).alias("gate"), passed.alias("passed"), detail.alias("detail")
    )
    low = fnr <= F.lit(max_mean_fnr)
    mean_gate = gate(
        "absolute_mean_attack_fnr", low,
        text(f"mean attack FNR %.4f %s ceiling {max_mean_fnr:.4f}", fnr, F.when(low, "<=").otherwise(">")),
    )
    listed = F.array_join(F.transform("breaches", lambda b: text("%s (%.4f)", b["label_class"], b["fnr"])), ", ")
    clear = F.size("breaches") == 0
    class_gate = gate(
        "absolute_per_class_fnr", clear,
        F.when(clear, F.lit(f"all attack classes within per-class FNR ceiling {max_class_fnr:.2f}"))
        .otherwise(F.concat(F.lit("per-class FNR ceiling breached by "), listed)),
    )
    first_gate = gate(
        "relative_to_champion", F.lit(True),
        F.lit("No incumbent champion; absolute gates alone govern the first promotion."),
    )
    required = old_f1 + F.lit(min_gain)
    f1_gate = gate(
        "macro_f1_improvement", f1 >= required,
        text(f"macro F1 %.4f vs champion %.4f (required >= %.4f, margin {min_gain})", f1, old_f1, required),
    )
    fnr_gate = gate(
        "attack_fnr_not_worse", fnr <= old_fnr,
        text("mean attack FNR %.4f vs champion %.4f (must not regress)", fnr, old_fnr),
    )
    relative = F.when(incumbent, F.array(f1_gate, fnr_gate)).otherwise(F.array(first_gate))
    gated = challengers.withColumn("gates", F.concat(F.array(mean_gate, class_gate), relative))
    failed = F.filter("gates", lambda g: ~g["passed"])
    passed_reasons = F.concat(
        F.array(text("All %d governance gates passed.", F.size("gates"))), F.transform("gates", lambda g: g["detail"])
    )
    failed_reasons = F.concat(
        F.array(text("Rejected: %d of %d governance gates failed.", F.size(failed), F.size("gates"))),
        F.transform(failed, lambda g: F.concat(F.lit("FAILED ["), g["gate"], F.lit("]: "), g["detail"])),
    )
    promoted = F.forall("gates", lambda g: g["passed"])
    return gated.withColumns(
        {
            "promoted": promoted,
            "decision": F.when(promoted, PROMOTED).otherwise(REJECTED),
            "reasons": F.when(promoted, passed_reasons).otherwise(failed_reasons),
            "thresholds": F.struct(
                F.lit(min_gain).alias("min_f1_improvement"),
                F.lit(max_mean_fnr).alias("max_mean_fnr"),
                F.lit(max_class_fnr).alias("max_per_class_fnr"),
            ),
        }
    )


def against(challengers: DataFrame, incumbents: DataFrame) -> DataFrame:
    """Join each challenger's ``champion`` to that model's metrics; it may be absent."""
    old = incumbents.select(
        F.col("model").alias("champion"),
        F.col("macro_f1").alias("champion_macro_f1"),
        F.col("mean_attack_fnr").alias("champion_attack_fnr"),
    )
    return challengers.join(old, "champion", "left")


def replay(
    models: DataFrame,
    min_gain: float = config.MIN_F1_GAIN,
    max_mean_fnr: float = config.MAX_MEAN_FNR,
    max_class_fnr: float = config.MAX_CLASS_FNR,
) -> DataFrame:
    """Decide models in ``ord`` order, each against the champion earlier ones left.

    The state of a step depends on the verdict of the one before, so this is a fold
    over the log, one small row per configuration.
    """
    rows = F.array_sort(F.collect_list(F.struct("ord", "model", "macro_f1", "mean_attack_fnr", "worst_attack_fnr")))
    start = F.struct(
        F.lit(None).cast("string").alias("champion"),
        F.lit(None).cast("double").alias("f1"),
        F.lit(None).cast("double").alias("fnr"),
        F.array().cast("array<struct<ord:bigint,challenger:string,champion:string,promoted:boolean>>").alias("log"),
    )

    def step(state: Column, m: Column) -> Column:
        absolute = (m["mean_attack_fnr"] <= F.lit(max_mean_fnr)) & (
            F.coalesce(m["worst_attack_fnr"], F.lit(0.0)) <= F.lit(max_class_fnr)
        )
        better = (m["macro_f1"] >= state["f1"] + F.lit(min_gain)) & (m["mean_attack_fnr"] <= state["fnr"])
        won = absolute & (state["champion"].isNull() | better)
        entry = F.struct(
            m["ord"].cast("long").alias("ord"), m["model"].alias("challenger"),
            state["champion"].alias("champion"), won.alias("promoted"),
        )
        return F.struct(
            F.when(won, m["model"]).otherwise(state["champion"]).alias("champion"),
            F.when(won, m["macro_f1"]).otherwise(state["f1"]).alias("f1"),
            F.when(won, m["mean_attack_fnr"]).otherwise(state["fnr"]).alias("fnr"),
            F.concat(state["log"], F.array(entry)).alias("log"),
        )

    return models.agg(F.aggregate(rows, start, step).alias("_s")).select(F.inline("_s.log"))


def current_champion(log: DataFrame) -> DataFrame:
    """The latest promotion; no row when nothing was ever promoted."""
    return log.where("promoted").orderBy(F.desc("seq")).limit(1)


def incumbents(log: DataFrame) -> DataFrame:
    """Add the champion in force before each decision."""
    before = Window.partitionBy(F.lit(0)).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("incumbent", F.last(F.when(F.col("promoted"), F.col("challenger")), ignorenulls=True).over(before))


def history_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("total_decisions"),
        F.count_if("promoted").alias("promotions"),
        F.count_if(~F.col("promoted")).alias("rejections"),
        F.max_by("thresholds", "seq").alias("thresholds"),
        F.max_by(F.when(F.col("promoted"), F.col("challenger")), F.when(F.col("promoted"), F.col("seq"))).alias("current_champion"),
    )


def run_history(runs: DataFrame, start: str = "start_ms", limit: int = 200) -> DataFrame:
    return runs.orderBy(start, "run_id").limit(limit)
