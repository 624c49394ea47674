"""Leakage-safe preparation: everything is fitted on training rows and applied to both."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import encode_labels
from ..functions.names import feature_columns
from ..operators.quality import check_no_missing
from ..operators.sampling import stratified_sample, train_test_split
from ..operators.scaling import Parameters, apply_fills, apply_scaler, correlated_columns, fit_fills, fit_scaler
from ..session import shared_dir
from ..sources.sinks import write_splits

#: Stands for no correlation filter where a number is wanted.
NO_CORRELATION = 2.0


class FlowPreparerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted fills, kept features and scaler. All of it is one parameter, so the model saves and loads in a pipeline."""

    fitted = Param(Params._dummy(), "fitted", "fills, kept features, their centres and scales, dropped columns, as JSON", TypeConverters.toString)

    def __init__(self, params: Parameters | None = None, fills: dict[str, float] | None = None, dropped: Sequence[str] = ()):
        super().__init__()
        if params is not None:
            state = {"features": params.features, "fill": params.fill, "center": params.center, "scale": params.scale, "fills": fills, "dropped": list(dropped)}
            self._set(fitted=json.dumps(state))

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))

    @property
    def parameters(self) -> Parameters:
        return Parameters(*(self._state()[k] for k in ("features", "fill", "center", "scale")))

    @property
    def fills(self) -> dict[str, float]:
        return self._state()["fills"]

    @property
    def dropped(self) -> list[str]:
        return self._state()["dropped"]

    @property
    def features(self) -> list[str]:
        return self._state()["features"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gone = set(self.dropped)
        filled = apply_fills(dataset, self.fills)
        kept = filled.select(*[F.col(f"`{n}`") for n in filled.columns if n not in gone])
        return apply_scaler(kept, self.parameters)


class FlowPreparer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing cells, drop correlated features, scale. A ``correlation`` of None drops nothing."""

    inputs = Param(Params._dummy(), "inputs", "columns to prepare", TypeConverters.toListString)
    fill = Param(Params._dummy(), "fill", "median, mean or zero", TypeConverters.toString)
    correlation = Param(Params._dummy(), "correlation", "largest |r| with an earlier column; above 1 for none", TypeConverters.toFloat)
    scaler = Param(Params._dummy(), "scaler", "robust, standard or minmax", TypeConverters.toString)
    limits = Param(Params._dummy(), "limits", "arguments of the quantiles, as JSON", TypeConverters.toString)

    def __init__(
        self,
        features: Sequence[str] = (),
        fill: str = "median",
        correlation: float | None = config.CORRELATION_THRESHOLD,
        scaler: str = "robust",
        **limits,
    ):
        super().__init__()
        self._set(inputs=list(features), fill=fill, correlation=NO_CORRELATION if correlation is None else correlation, scaler=scaler, limits=json.dumps(limits))

    def _fit(self, dataset: DataFrame) -> FlowPreparerModel:
        features, limits = self.getOrDefault(self.inputs), json.loads(self.getOrDefault(self.limits))
        fills = fit_fills(dataset, features, self.getOrDefault(self.fill), **limits)
        empty = [f for f, v in fills.items() if v is None]
        if empty:
            raise RuntimeError(f"no value to fill with, columns are all missing: {empty}")
        filled = apply_fills(dataset, fills)
        most = self.getOrDefault(self.correlation)
        dropped = [] if most > 1 else correlated_columns(filled, features, most)
        kept = [f for f in features if f not in set(dropped)]
        center, scale = fit_scaler(filled, kept, self.getOrDefault(self.scaler), **limits)
        return FlowPreparerModel(Parameters(kept, {f: fills[f] for f in kept}, center, scale), fills, dropped)


def prepare_training_tables(
    cleaned: DataFrame,
    key: Sequence[str],
    fill: str = "median",
    correlation: float | None = config.CORRELATION_THRESHOLD,
    scaler: str = "robust",
    test_fraction: float = config.TEST_FRACTION,
    sample_rows: int | None = None,
    seed: int = config.SEED,
    classes: dict[str, int] = config.CLASS_IDS,
    **limits,
) -> tuple[DataFrame, FlowPreparerModel]:
    """Sample (optional), split, fit on train, apply to both.

    Returns one table with ``split``, ``label_int``, ``label_class`` and the scaled
    features, and the fitted model. The split rows are written to shared storage
    once, because every fit reads them again.
    """
    features = feature_columns(cleaned, [*config.META_COLUMNS, *key])
    rows = cleaned
    if sample_rows is not None:
        rows = stratified_sample(rows, sample_rows, "label_class", key, seed, len(classes))
    marked = train_test_split(rows, "label_class", key, test_fraction, seed, len(classes))
    stored = shared_dir(cleaned.sparkSession, "split")
    write_splits(marked, stored)
    marked = cleaned.sparkSession.read.parquet(stored)
    model = FlowPreparer(features, fill, correlation, scaler, **limits).fit(marked.where("split = 'train'"))
    ready = model.transform(encode_labels(marked, classes=classes))
    check_no_missing(ready, model.features)
    return ready, model


def split_counts(ready: DataFrame, cls: str = "label_class") -> DataFrame:
    return ready.groupBy("split", cls).agg(F.count("*").alias("rows"))
