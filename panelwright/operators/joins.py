"""Equi-joins of the panel with its dimensions (JOI*).

No join here carries a broadcast hint, and salted ones are never broadcast: Spark broadcasts a side when its known or run-time size is
under spark.sql.autoBroadcastJoinThreshold and otherwise shuffles both, splitting hot partitions
(AQE skew join). `attach_split` finds the keys that very many rows share with a sketch and splits just
those; `attach(..., salt=n)` splits all keys alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.operators.clean import fill_defaults


def _pairs(keys) -> list[tuple[str, str]]:
    if isinstance(keys, str):
        keys = [keys]
    if isinstance(keys, Mapping):
        return list(keys.items())
    return [(k, k) for k in keys]


def attach(
    df: DataFrame,
    dim: DataFrame,
    keys: str | Sequence[str] | Mapping[str, str],
    columns: Sequence[str] | None = None,
    fills: Mapping[str, object] | None = None,
    how: str = "left",
    salt: int = 0,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Left join on equal keys (JOI1, JOI2, JOI4-JOI9). Rows multiply when the key is not unique.

    keys: one name, several names, or {left name: right name}; the right key columns are dropped.
    salt > 1 splits every left key into that many parts by a hash of salt_by and copies the
    right side once per part; both are then shuffled and sorted, never broadcast.
    """
    pairs = _pairs(keys)
    right_keys = [r for _, r in pairs]
    wanted = [c for c in (columns if columns is not None else dim.columns) if c not in right_keys]
    right = dim.select(
        *[F.col(f"`{r}`").alias(f"__key_{i}") for i, r in enumerate(right_keys)],
        *[F.col(f"`{c}`") for c in wanted],
    )
    left = df
    condition = [F.col(left_name) == F.col(f"__key_{i}") for i, (left_name, _) in enumerate(pairs)]
    if salt > 1:
        spread = [F.col(c) for c in (salt_by or df.columns)]
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
        # Spark takes the copies for as small as the dimension: each task would hold all of them, so they are dealt
        right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
        condition.append(F.col("__salt") == F.col("__part"))
    out = left.join(right, condition, how)
    out = out.drop(*[f"__key_{i}" for i in range(len(pairs))], "__salt", "__part")
    return fill_defaults(out, fills) if fills else out


def heavy_keys(df: DataFrame, keys: Sequence[str], parts: int) -> list[int]:
    """Hashes of the keys that hold more rows than half a part of `parts` should.

    They come from one pass with a mergeable sketch of frequent items, whose size depends on `parts` only;
    at most 2 * parts keys can be so heavy.
    """
    top = 2 * parts
    hashed = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {top}, {8 * top})").alias("items"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found.items if item["count"] * top > found.n]


def attach_split(
    df: DataFrame,
    dim: DataFrame,
    keys: str | Sequence[str] | Mapping[str, str],
    columns: Sequence[str] | None = None,
    fills: Mapping[str, object] | None = None,
    how: str = "left",
    parts: int | None = None,
) -> DataFrame:
    """As attach, with the rows of heavy keys dealt over all parts and their dimension rows copied to each.

    Which keys are heavy is found in the data (see heavy_keys), by a job that runs at once. Keys that few rows
    share are joined as ever, so only heavy ones pay for copies. Null keys match nothing and are dealt too.
    """
    pairs = _pairs(keys)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(df, [left for left, _ in pairs], parts)
    right_keys = [r for _, r in pairs]
    wanted = [c for c in (columns if columns is not None else dim.columns) if c not in right_keys]

    def is_heavy(names: Sequence[str]):
        return F.xxhash64(*[F.col(f"`{n}`") for n in names]).isin(heavy) if heavy else F.lit(False)

    # by the row and the part it comes from, which a task that runs again repeats
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.spark_partition_id(), F.lit(parts)).cast("int")
    left = df.withColumn("__salt", F.when(is_heavy([k for k, _ in pairs]), spread).otherwise(0))
    copies = F.when(is_heavy(right_keys), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.select(
        *[F.col(f"`{r}`").alias(f"__key_{i}") for i, r in enumerate(right_keys)], *[F.col(f"`{c}`") for c in wanted],
        F.explode(copies).alias("__part"),
    )
    condition = [F.col(name) == F.col(f"__key_{i}") for i, (name, _) in enumerate(pairs)]
    out = left.join(right, [*condition, F.col("__salt") == F.col("__part")], how)
    out = out.drop(*[f"__key_{i}" for i in range(len(pairs))], "__salt", "__part")
    return fill_defaults(out, fills) if fills else out


def join_suffixed(
    df: DataFrame, dim: DataFrame, left_key: str, right_key: str, suffix: str = "_season"
) -> DataFrame:
    """Left join that keeps both sides' columns; right names that collide get a suffix (JOI3)."""
    renamed = {c: f"{c}{suffix}" for c in dim.columns if c in df.columns and c != left_key}
    right = dim.withColumnsRenamed(renamed)
    key = renamed.get(right_key, right_key)
    if key == left_key:
        return df.join(right, left_key, "left")
    return df.join(right, df[left_key] == right[key], "left")


def join_latest(
    df: DataFrame,
    series: DataFrame,
    on: Mapping[str, str],
    order: str,
    value: str,
    default=None,
) -> DataFrame:
    """Attach each key's value at its latest position (JOI11); default where there is none.

    The latest row is found with a partially aggregated max_by, so long series stay distributed.
    """
    right_keys = list(on.values())
    latest = series.groupBy(*right_keys).agg(F.max_by(value, order).alias(value))
    return attach(df, latest, on, fills=None if default is None else {value: default})


def missing_keys(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Keys of `ids` without a row in `df` (JOI12, SET2); repeats collapse before the shuffle."""
    return ids.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def restrict_to(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is listed (JOI13)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def except_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are not in b (SET2); repeats collapse before the shuffle."""
    return a.distinct().subtract(b.distinct())


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns a frame lacks become NULL (SET1)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
