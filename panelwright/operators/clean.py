"""Projections, renames, casts, fills and filters that tolerate missing columns (PRJ*, RSH6-7, FLT*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwright.functions import scalars, text


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order (PRJ1)."""
    return df.select([F.col(f"`{c}`") for c in columns if c in df.columns])


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist (PRJ2)."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def first_present(df: DataFrame, names: Sequence[str], to: str) -> DataFrame:
    """Column `to` from the first name that exists, NULL otherwise (PRJ3)."""
    rest = [c for c in names if c != to]
    return df.withColumn(to, scalars.coalesce_present(df.columns, names)).drop(*rest)


def numeric_columns(df: DataFrame, columns: Sequence[str], default: float | None = None) -> DataFrame:
    """Tolerant DOUBLE casts of the listed columns in one projection (SC1 and RSH6-7).

    With a default, missing columns are created and NULLs are filled.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    changed: dict[str, Column] = {}
    for name in columns:
        if name in kinds:
            number = scalars.to_number(name, text=isinstance(kinds[name], T.StringType))
            changed[name] = number if default is None else F.coalesce(number, F.lit(float(default)))
        elif default is not None:
            changed[name] = F.lit(float(default))
    return df.withColumns(changed)


def ensure_columns(df: DataFrame, columns: Sequence[str], default) -> DataFrame:
    """Create the listed columns that do not exist (RSH7)."""
    return df.withColumns({c: F.lit(default) for c in columns if c not in df.columns})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Per-column NULL fill; columns that do not exist are ignored (RSH6)."""
    return df.na.fill({k: v for k, v in defaults.items() if k in df.columns})


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop listed columns the feed does not carry: a stated schema shows those as all NULL.

    Runs one aggregation over the frame, meant for dimensions.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    filled = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return df.drop(*[c for c in present if not filled[c]])


def concat_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add a block of columns in one projection (RSH5)."""
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def canonical_groups(df: DataFrame, column: str, aliases: Mapping[str, str]) -> DataFrame:
    """Replace spellings by codes and reject rows whose spelling is unknown (PRJ5)."""
    return df.withColumn(column, scalars.canonical_code(column, aliases)).filter(
        F.col(column).isNotNull()
    )


# --- filters ----------------------------------------------------------------


def only_true(df: DataFrame, column: str) -> DataFrame:
    """Rows whose flag reads as true (FLT1)."""
    return df.filter(scalars.is_true(column))


def at_period(df: DataFrame, value, period: str = "event") -> DataFrame:
    """Rows of one period, given as a number or a scalar subquery (FLT2)."""
    return df.filter(F.col(period) == value)


def after_period(df: DataFrame, value, period: str = "event") -> DataFrame:
    """Rows after the warm-up period (FLT3)."""
    return df.filter(F.col(period) > value)


def active_only(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows with enough recent activity (FLT4)."""
    return df.filter(F.col(column) > minimum)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without NULL in the listed columns that exist (FLT5)."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df


def member_of(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is in a short list or in the first column of a frame (FLT6).

    The frame's keys are made distinct first: repeats collapse before the shuffle.
    """
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def name_search(df: DataFrame, column: str, query: str, regex: bool = True) -> DataFrame:
    """Rows whose name matches, whatever the case (FLT7)."""
    match = text.matches_ci(column, query) if regex else text.contains_ci(column, query)
    return df.filter(match)


def positive(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value above 0 (FLT8)."""
    return df.filter(F.col(f"`{column}`") > 0)
