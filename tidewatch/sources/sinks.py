"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.drift import reference_metadata
from ..operators.scaling import Parameters
from ..operators.scoring import flagged_rows


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_by_class(df: DataFrame, path: str) -> None:
    """A folder per class, so reading one class skips the others.

    No repartition by class: the largest class would end in one task.
    """
    df.write.mode("overwrite").partitionBy("label_class").parquet(path)


def write_splits(ready: DataFrame, path: str) -> None:
    ready.write.mode("overwrite").partitionBy("split").parquet(path)


def write_snapshot(snapshot: DataFrame, path: str, features: Sequence[str]) -> None:
    """Reference snapshot and, beside it, one row of metadata."""
    snapshot.write.mode("overwrite").parquet(path)
    stored = snapshot.sparkSession.read.parquet(path)
    write_report(reference_metadata(stored, features), f"{path}_metadata")


def plain_json(df: DataFrame) -> DataFrame:
    """Non-finite numbers as text, since JSON has no spelling for them."""

    def safe(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            odd = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
            return F.when(~odd, col).alias(field.name), F.when(odd, col.cast("string")).alias(f"{field.name}_text")
        return (col,)

    return df.select(*[x for f in df.schema.fields for x in safe(f)])


def write_report(report: DataFrame, path: str, drop: Sequence[str] = ()) -> None:
    """A report table as JSON; a report has a bounded number of rows."""
    report.drop(*drop).coalesce(1).write.mode("overwrite").json(path)


def append_decision(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").json(path)


def write_flow_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_flagged(scored: DataFrame, path: str, row: str = "flow_id") -> None:
    """Attack rows only, every field quoted, quotes doubled."""
    flagged_rows(scored, row).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_model(model, metadata: DataFrame, path: str) -> None:
    """Fitted model and one row about it."""
    model.write().overwrite().save(f"{path}/model")
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_parameters(spark, params: Parameters, path: str) -> None:
    params.to_df(spark).coalesce(1).write.mode("overwrite").json(path)


def write_serving_set(spark, model, params: Parameters, metadata: DataFrame, representatives: DataFrame | None, path: str) -> None:
    """Everything scoring needs after a promotion."""
    write_model(model, metadata, path)
    write_parameters(spark, params, f"{path}/parameters")
    if representatives is not None:
        representatives.coalesce(1).write.mode("overwrite").json(f"{path}/representatives")
