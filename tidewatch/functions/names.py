"""Column names: quoting, header matching, feature lists. Metadata only, no jobs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


def q(name: str) -> str:
    """Backtick a name so blanks, dots and slashes survive."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def canonical_key(name: str) -> str:
    """Lower-case letters and digits only."""
    return re.sub("[^a-z0-9]", "", str(name).lower())


def canonical_key_expr(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def resolve_headers(headers: Sequence[str], features: Sequence[str] = (), keep: Sequence[str] = ()) -> list[str]:
    """Canonical name for each header, in the given order.

    An exact alias is taken first, then an exact feature name, then the
    canonical key, where features take precedence over alias spellings, and
    those over alias targets. A header that matches nothing keeps its own name, and so
    do the ``keep`` columns.
    """
    by_key = {canonical_key(target): target for target in config.HEADER_ALIASES.values()}
    by_key |= {canonical_key(alias): target for alias, target in config.HEADER_ALIASES.items()}
    by_key |= {canonical_key(f): f for f in features}
    wanted = set(features)

    def one(header: str) -> str:
        name = header.strip()
        if header in keep:
            return header
        if name in config.HEADER_ALIASES:
            return config.HEADER_ALIASES[name]
        return name if name in wanted else by_key.get(canonical_key(name), name)

    return [one(h) for h in headers]


def normalize_columns(df: DataFrame, features: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rename to canonical names and keep the first of any columns that collide."""
    names = resolve_headers(df.columns, features, keep)
    positional, _ = by_exact_name(df)
    first_at = {n: i for i, n in reversed(list(enumerate(names)))}
    keep = sorted(first_at.items(), key=lambda item: item[1])
    return positional.select(*[F.col(f"_c{i}").alias(n) for n, i in keep])


def by_exact_name(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The table under positional names, and its columns by exact original name.

    Spark resolves names without regard to case, so ``Label`` next to ``label`` can
    only be told apart by position.
    """
    at = {n: F.col(f"_c{i}") for i, n in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), at


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[n.strip() for n in df.columns])


def feature_columns(df: DataFrame, exclude: Iterable[str] = config.META_COLUMNS) -> list[str]:
    """Every column that is not metadata, in table order."""
    skip = set(exclude)
    return [n for n in df.columns if n not in skip]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def select_features(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Ordered projection by name; a missing feature is an error that lists all of them."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing {len(missing)} feature column(s): {missing}")
    return df.select(*[c(n) for n in [*extra, *features]])


def label_column(df: DataFrame) -> str | None:
    """The first recognised ground-truth column, compared case-sensitively."""
    return next((n for n in config.LABEL_CANDIDATES if n in df.columns), None)


def extract_labels(df: DataFrame, as_name: str = "truth_raw") -> DataFrame:
    """Add the ground truth as text. Works where ``Label`` and ``label`` both exist."""
    name = label_column(df)
    if name is None:
        return df
    positional, at = by_exact_name(df)
    kept = [F.col(f"_c{i}").alias(n) for i, n in enumerate(df.columns)]
    return positional.select(*kept, at[name].cast("string").alias(as_name))


def unused_columns(supplied: Sequence[str], features: Sequence[str]) -> list[str]:
    """Supplied columns that are neither feature, identifier nor label; sorted."""
    known = {*features, *config.IDENTIFIER_COLUMNS, *config.LABEL_CANDIDATES}
    return sorted(set(supplied) - known)


def shared_columns(left: DataFrame, right: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Columns both tables hold, in the order of ``features`` or of the left table."""
    both = set(left.columns) & set(right.columns)
    names = [n for n in (left.columns if features is None else features) if n in both]
    if not names:
        raise ValueError("the two tables share no feature column")
    return names
