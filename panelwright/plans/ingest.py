"""The ingest job: landed feeds to plain tables and code lists."""

from __future__ import annotations

from pyspark.sql import SparkSession

from panelwright.operators.clean import drop_empty, select_present
from panelwright.sources import feeds, schemas, sinks


def ingest(spark: SparkSession, base: str, out: str) -> dict[str, str]:
    """Players, fixtures, player codes and team codes as CSV with header.

    Attributes the feed does not carry are left out of the players table.
    """
    document = f"{base}/bootstrap.json"
    players = feeds.read_json_array(spark, document, "elements", schemas.PLAYERS)
    players = drop_empty(players, [c for c in players.columns if c != "id"])
    teams = feeds.read_json_array(spark, document, "teams", schemas.TEAMS)
    tables = {
        "players": players,
        "fixtures": feeds.read_json_records(spark, f"{base}/fixtures.json", schemas.FIXTURES),
        "player_codes": select_present(players, ["id", "web_name", "team"]),
        "team_codes": select_present(teams, ["id", "name", "short_name"]),
    }
    return {name: sinks.write_csv(df, f"{out}/{name}") for name, df in tables.items()}
