import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("panelwright-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


N_PERIODS = 12


def _feeds():
    """Six teams, 48 players, 12 played periods and two matches for team 4 in the next one."""
    players = []
    for i in range(1, 49):
        players.append(
            {
                "id": i,
                "web_name": "Ann" if i in (7, 8) else f"Player {i:02d}",
                "first_name": "F",
                "second_name": "S",
                "team": (i - 1) % 6 + 1,
                "element_type": 9 if i == 48 else (i - 1) // 12 + 1,
                "now_cost": 40 + i,
                "selected_by_percent": f"{i * 1.5:.1f}",
                "expected_goals_per_90": i / 50,
                "expected_assists_per_90": 0.1,
                "expected_goal_involvements_per_90": i / 50 + 0.1,
                "expected_goals_conceded_per_90": 1.2,
                "goals_conceded_per_90": 1.1,
                "saves_per_90": 3.0 if i <= 12 else 0.0,
                "clean_sheets_per_90": 0.3,
                "minutes": 900,
                "starts": 10,
                "status": {2: "i", 3: "u", 4: "s", 5: "d"}.get(i, "a"),
                "chance_of_playing_next_round": {5: 75, 6: 0}.get(i),
                "news": "",
                "transfers_in_event": i * 100,
                "transfers_out_event": 2400,
            }
        )
    rounds = [[(1, 2), (3, 4), (5, 6)], [(2, 3), (4, 5), (6, 1)], [(1, 3), (2, 5), (4, 6)]]
    fixtures, fid = [], 0
    for gw in range(1, N_PERIODS + 2):
        pairs = list(rounds[gw % 3])
        if gw in (4, N_PERIODS + 1):
            pairs.append((1, 4))
        if gw == N_PERIODS + 1:
            pairs = [p for p in pairs if 6 not in p]
        for h, a in pairs:
            fid += 1
            done = gw <= N_PERIODS
            fixtures.append(
                {
                    "id": fid,
                    "event": gw,
                    "finished": done,
                    "kickoff_time": f"2024-01-{gw:02d}T{fid % 24:02d}:00:00Z",
                    "team_h": h,
                    "team_a": a,
                    "team_h_difficulty": None if fid == 2 else 2 + fid % 4,
                    "team_a_difficulty": 0 if fid == 3 else 2 + fid % 3,
                    "team_h_score": (fid + h) % 4 if done else None,
                    "team_a_score": (fid * a) % 3 if done else None,
                }
            )
    fixtures.append({"id": 99, "event": None, "finished": False, "team_h": 1, "team_a": 2})
    history = {}
    for p in players:
        rows = []
        for f in fixtures:
            if not f["finished"] or p["team"] not in (f["team_h"], f["team_a"]) or p["id"] == 47:
                continue
            if p["id"] == 46 and f["event"] != 3:
                continue
            x = (p["id"] * 7 + f["id"] * 5) % 13
            rows.append(
                {
                    "fixture": f["id"],
                    "round": f["event"],
                    "total_points": x,
                    "minutes": 90 if x > 2 else 15 * x,
                    "goals_scored": int(x > 9),
                    "assists": int(x > 10),
                    "clean_sheets": int(x % 3 == 0),
                    "goals_conceded": x % 4,
                    "own_goals": 0,
                    "penalties_saved": 0,
                    "penalties_missed": 0,
                    "yellow_cards": 0,
                    "red_cards": 0,
                    "saves": x % 5,
                    "bonus": x % 4,
                    "bps": x * 3,
                    "expected_goals": f"{x / 20:.2f}",
                    "expected_assists": f"{x / 30:.2f}",
                    "expected_goal_involvements": f"{x / 12:.2f}",
                    "expected_goals_conceded": f"{(x % 4) / 2:.2f}",
                }
            )
        history[p["id"]] = rows
    return players, fixtures, history


@pytest.fixture(scope="session")
def domain():
    """players, fixtures and history as plain Python, for hand checks."""
    return _feeds()


@pytest.fixture(scope="session")
def landing(tmp_path_factory, domain):
    """The same as landed JSON files, one broken and one empty payload among them."""
    base = tmp_path_factory.mktemp("landing")
    players, fixtures, history = domain
    bootstrap = {"elements": players, "teams": [{"id": t, "name": f"T{t}", "short_name": "T"} for t in range(1, 7)],
                 "events": [{"id": g, "finished": g <= N_PERIODS} for g in range(1, 15)]}
    (base / "bootstrap.json").write_text(json.dumps(bootstrap))
    (base / "fixtures.json").write_text(json.dumps(fixtures))
    (base / "history").mkdir()
    for pid, rows in history.items():
        body = json.dumps({"history": rows, "history_past": [{"x": 1}]})
        (base / "history" / f"{pid}.json").write_text("{broken" if pid == 47 else body)
    return str(base)
