"""The record of a sweep: serving sets by version, a decision log, and a pointer to the version in force.

A promotion is written in this order: the serving set under its version, the decision with the metrics of
both sides, the pointer. What a stop leaves behind is told by the log alone: a version without a decision is not in
force, and a decided promotion without a pointer is finished by ``recover``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scaling import Parameters
from ..session import local_table
from ..sources.flows import DECISION_SCHEMA, list_names, read_decisions
from ..sources.sinks import append_decision, write_model, write_serving_set

FIGURES = ["macro_f1", "mean_attack_fnr", "macro_attack_f1", "accuracy", "worst_attack_class", "worst_attack_fnr"]


class SweepRecord:
    """Decisions and serving sets below ``path``, which all executors reach. A log has one line a configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        return read_decisions(self.spark, f"{self.path}/log")

    def _decided(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.log().orderBy("seq").collect()]

    def decided(self) -> set[str]:
        """Configurations that need not be fitted again."""
        return {r["challenger"] for r in self._decided()}

    def incumbent(self) -> tuple[str, float, float] | None:
        """Name, macro F1 and mean miss rate of the last promotion."""
        won = [r for r in self._decided() if r["promoted"]]
        return (won[-1]["challenger"], won[-1]["challenger_metrics"]["macro_f1"], won[-1]["challenger_metrics"]["mean_attack_fnr"]) if won else None

    def add(self, decision: dict, model, features: list[str], params: Parameters | None = None, representatives: DataFrame | None = None) -> None:
        """Record one decision, a row of ``governance.decide``, and, where it promotes, what serving needs."""
        before = self._decided()
        seq = max((r["seq"] for r in before), default=-1) + 1
        if decision["promoted"]:
            facts = local_table(self.spark, [(decision["model"], seq, features)], "model string, seq bigint, features array<string>")
            version = f"{self.path}/serving/version={seq}"
            if params is None:
                write_model(model, facts, version)
            else:
                write_serving_set(self.spark, model, params, facts, representatives, version)
        old = next((r["challenger_metrics"] for r in reversed(before) if r["challenger"] == decision["champion"] and r["promoted"]), None)
        row = {k: decision.get(k) for k in ("champion", "decision", "promoted", "reasons")} | {
            "seq": seq, "timestamp": datetime.now(timezone.utc).isoformat(), "challenger": decision["model"],
            "gates": [g.asDict() for g in decision["gates"]], "thresholds": decision["thresholds"].asDict(),
            "challenger_metrics": {f: decision.get(f) for f in FIGURES}, "champion_metrics": old}
        append_decision(self.spark.createDataFrame([row], DECISION_SCHEMA), f"{self.path}/log")
        if decision["promoted"]:
            self._point(seq)

    def _point(self, seq: int) -> None:
        local_table(self.spark, [(seq,)], "seq bigint").write.mode("overwrite").json(f"{self.path}/pointer/seq={seq}")

    def version(self) -> int | None:
        """The version in force: the newest pointer that was written to its end."""
        names = [n for n in list_names(self.spark, f"{self.path}/pointer") if "_SUCCESS" in list_names(self.spark, f"{self.path}/pointer/{n}")]
        return max((int(n.split("=")[1]) for n in names), default=None)

    def recover(self) -> int | None:
        """Finish a promotion that was decided and not yet pointed at; the version in force afterwards."""
        won = [r["seq"] for r in self._decided() if r["promoted"]]
        if won and self.version() != won[-1]:
            self._point(won[-1])
        return self.version()

    def serving(self) -> DataFrame:
        """The facts of the version in force: model, seq and features; no row before the first promotion."""
        seq = self.version()
        schema = "model string, seq bigint, features array<string>"
        if seq is None:
            return local_table(self.spark, [], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/serving/version={seq}/metadata").where(F.col("seq") == seq)
