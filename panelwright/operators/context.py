"""Context of a period: latest entity state, upcoming matches, opponent strength (SCR1-SCR3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import windows
from panelwright.operators import joins
from panelwright.operators.aggregates import last_non_null, mean_by
from panelwright.operators.clean import at_period
from panelwright.operators.panel import unpivot_sides


def match_context(sides: DataFrame) -> DataFrame:
    """One context row per (team, event): the first match of the period wins.

    A team with two matches in a period would otherwise double every history row it joins. The
    aggregate is combined on the map side, whatever the number of matches per key.
    """
    fields = ["fdr", "is_home", "score_for", "score_ag"]
    order = [c for c in ("kickoff", "fixture_id") if c in sides.columns]
    first = F.min_by(F.struct(*fields), F.struct(*order, F.col("is_home")))
    return sides.groupBy("team", "event").agg(first.alias("m")).select("team", "event", "m.*")


def upcoming_context(
    fixtures: DataFrame, period: int | Column, match_id: str | None = None
) -> DataFrame:
    """Per team with a match in the period: easiest match and number of rated matches (SCR2).

    One aggregation gives both; ties on difficulty go to the home match, then the lower id.
    A period without matches gives an empty frame with the same columns.
    """
    keep = [match_id] if match_id else []
    sides = unpivot_sides(at_period(fixtures, period), keep=keep, defaults=False)
    worst = F.lit(float("inf"))
    order = F.struct(
        F.coalesce(F.col("fdr"), worst), (-F.col("is_home")), *[F.col(k) for k in keep]
    )
    best = F.min_by(F.struct("fdr", "is_home"), order).alias("best")
    per_team = sides.groupBy("team").agg(best, F.count("fdr").alias("num_fixtures"))
    return per_team.select("team", "best.fdr", "best.is_home", "num_fixtures")


def team_strength(
    panel: DataFrame,
    teams_of: DataFrame,
    entity: str = "player_id",
    period: str = "event",
    conceded: str = "score_ag",
    n: int = fixed.SHORT_WINDOW,
    blank: object = None,
    absent: DataFrame | None = None,
) -> DataFrame:
    """Lagged mean of what each team concedes, per team and period (AGG1, WIN8).

    The team attached is the entity's current one, for past periods too. absent: entities whose rows, left out of the
    panel, are those of the entity `blank`; they count without being made.
    """
    with_team = joins.attach(panel.select(entity, period, conceded), teams_of, entity, ["team"])
    if absent is None:
        per_team = mean_by(with_team.filter("team IS NOT NULL"), ["team", period], conceded)
    else:
        like = joins.attach(absent.select(entity).distinct(), teams_of, entity, ["team"]).groupBy("team").agg(F.count(F.lit(1)).alias("__n"))
        rows = panel.filter(F.col(entity) == F.lit(blank)).select(period, conceded, F.lit(1).alias("__one"))
        like = like.withColumn("__one", F.lit(1)).join(rows, "__one").select("team", period, conceded, "__n")
        counted = with_team.select("team", period, conceded, F.lit(1).alias("__n")).unionByName(like).filter("team IS NOT NULL")
        per_team = mean_by(counted, ["team", period], conceded, weight="__n")
    spec = windows.timeline("team", period)
    return per_team.withColumn("opp_def_weakness", windows.lag_mean(conceded, n, spec))


def opponent_strength(
    strength: DataFrame, fixtures: DataFrame, period: int | Column, double: str = "mean"
) -> DataFrame:
    """Latest strength of each team's opponents in the period, 1.0 when unknown (SCR3, JOI11).

    double="mean": one row per team, averaged over its matches; "fanout": one row per match.
    """
    sides = unpivot_sides(at_period(fixtures, period), defaults=False).select("team", "opponent")
    joined = joins.join_latest(
        sides, strength, {"opponent": "team"}, "event", "opp_def_weakness", fixed.NEUTRAL_STRENGTH
    ).select("team", "opp_def_weakness")
    return joined if double == "fanout" else mean_by(joined, ["team"], "opp_def_weakness")


def with_absent(rows: DataFrame, absent: DataFrame, blank: object, entity: str = "player_id") -> DataFrame:
    """The rows, and for each absent entity those of the entity `blank`."""
    like = rows.filter(F.col(entity) == F.lit(blank)).withColumn("__one", F.lit(1)).drop(entity)
    more = absent.select(entity).distinct().withColumn("__one", F.lit(1)).join(F.broadcast(like), "__one")
    return rows.unionByName(more.select(rows.columns))


def latest_state(
    panel: DataFrame,
    ids: DataFrame,
    last_period: int | Column,
    columns: Sequence[str],
    entity: str = "player_id",
    period: str = "event",
    dense: bool = False,
) -> DataFrame:
    """Each entity's columns at the last finished period (SCR1).

    Entities without a row there fall back to the last non-NULL value of every column. A completed
    panel has no such entity: dense=True leaves the fallback, two more passes, out of the plan.
    """
    columns = [c for c in columns if c in panel.columns]
    slim = panel.select(entity, period, *columns)
    at_last = at_period(slim, last_period, period).select(entity, *columns)
    if dense:
        return at_last
    missing = joins.missing_keys(ids, at_last, entity)
    older = joins.restrict_to(slim, missing, entity)
    return joins.union_all(at_last, last_non_null(older, entity, period, columns))
