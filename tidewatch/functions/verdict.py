"""Expressions over class probabilities, verdicts and their explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def class_array(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in classes])


def argmax_class(probs: Column, classes: Sequence[str]) -> Column:
    """Name of the largest probability, the first one on ties."""
    return F.element_at(class_array(classes), F.array_position(probs, F.array_max(probs)).cast("int"))


def probability_map(probs: Column, classes: Sequence[str], digits: int = 6) -> Column:
    return F.map_from_arrays(class_array(classes), F.transform(probs, lambda p: F.round(p, digits)))


def is_attack(prediction: Column) -> Column:
    return prediction != F.lit(config.BENIGN)


def threat_level(
    rate: Column, high: float = config.THREAT_HIGH, medium: float = config.THREAT_MEDIUM
) -> Column:
    return F.when(rate >= F.lit(high), "HIGH").when(rate >= F.lit(medium), "MEDIUM").otherwise("LOW")


def increases_threat(contribution: Column, attack: Column) -> Column:
    """A contribution argues for the predicted class; for BENIGN that lowers the threat."""
    return F.when(attack, contribution > 0).otherwise(contribution < 0)


def direction_text(raises: Column) -> Column:
    return F.when(raises, "increases threat").otherwise("decreases threat")


def class_status(
    cls: Column, support: Column, fnr: Column, ceiling: float = config.MAX_CLASS_FNR
) -> Column:
    return (
        F.when(support == 0, "NO_TEST_SUPPORT")
        .when(cls == config.BENIGN, "OK")
        .when(fnr <= F.lit(ceiling), "OK")
        .otherwise("BREACH")
    )


def bin_label(low: float, high: float) -> str:
    return f"{round(low * 100)}%-{round(min(high, 1.0) * 100)}%"


def bin_label_expr(low: Column, high: Column) -> Column:
    percent = lambda x: F.round(x * 100, 0).cast("int")
    return F.format_string("%d%%-%d%%", percent(low), percent(F.least(high, F.lit(1.0))))


def confidence_bin(confidence: Column, bins: Sequence[tuple[float, float]] = config.CONFIDENCE_BINS) -> Column:
    """Index of the half-open bin a confidence falls in."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (low, high) in enumerate(bins):
        out = out.when((confidence >= F.lit(low)) & (confidence < F.lit(high)), F.lit(i))
    return out


def rationale(prediction: Column, confidence: Column, top_features: Column) -> Column:
    """One sentence: the first three raising features, or the first three of all."""
    raising = F.filter(top_features, lambda f: f["increases_threat"])
    drivers = F.slice(F.when(F.size(raising) > 0, raising).otherwise(top_features), 1, 3)
    listed = F.array_join(
        F.transform(drivers, lambda f: F.concat(f["feature"], F.lit(" ("), f["value"].cast("string"), F.lit(")"))), ", "
    )
    sentence = F.concat(
        F.lit("Classified "), prediction, F.lit(" at "),
        F.format_string("%.1f%%", confidence * 100), F.lit(" confidence, driven by "), listed, F.lit("."),
    )
    return F.when(F.size(top_features) > 0, sentence)


def reason_text(details: Column, limit: int = 480) -> Column:
    return F.substring(F.array_join(details, " "), 1, limit)


def protocol_name(number: Column) -> Column:
    pairs = [F.lit(x) for kv in config.PROTOCOL_NAMES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.bround(number, 0).cast("int")), F.lit("OTHER"))


def utc_now_iso() -> Column:
    return iso_utc(F.current_timestamp())


def iso_utc(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis_to_iso(ms: Column) -> Column:
    return iso_utc(F.timestamp_millis(ms))


def duration_seconds(start_ms: Column, end_ms: Column) -> Column:
    return (end_ms - start_ms) / F.lit(1000.0)
