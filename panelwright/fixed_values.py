"""Constants the results depend on. Nothing here is computed."""

# --- statistics -------------------------------------------------------------
# Per-match statistics of one entity, in feed order.
HISTORY_STATS = [
    "total_points", "minutes", "goals_scored", "assists", "clean_sheets",
    "goals_conceded", "own_goals", "penalties_saved", "penalties_missed",
    "yellow_cards", "red_cards", "saves", "bonus", "bps",
    "expected_goals", "expected_assists", "expected_goal_involvements",
    "expected_goals_conceded",
]
# Match context carried by every panel row.
CONTEXT_STATS = ["score_for", "score_ag", "fdr", "is_home"]
# Statistics that get the rolling feature family.
ROLLED_STATS = [
    "total_points", "minutes", "goals_scored", "assists", "clean_sheets",
    "goals_conceded", "saves", "bonus", "bps",
    "expected_goals", "expected_assists", "expected_goal_involvements",
    "expected_goals_conceded", "score_for", "score_ag",
]
# Statistics whose previous-period value is a feature.
PREVIOUS_STATS = [
    "expected_goals", "expected_assists", "expected_goal_involvements",
    "expected_goals_conceded",
]
# Optional per-90-minute attributes of the entity dimension.
PER90 = [
    "expected_goals_per_90", "expected_assists_per_90",
    "expected_goal_involvements_per_90", "expected_goals_conceded_per_90",
    "goals_conceded_per_90", "saves_per_90", "clean_sheets_per_90",
]
# Entity attributes carried next to the history.
ENTITY_ATTRIBUTES = [
    "id", "element_type", "now_cost", "selected_by_percent", *PER90,
    "web_name", "first_name", "second_name", "team",
    "minutes", "starts", "chance_of_playing_next_round", "status", "news",
]

# --- windows ----------------------------------------------------------------
SHORT_WINDOW = 5
LONG_WINDOW = 19
EWM_SPAN = 5
NEUTRAL_DIFFICULTY = 3
NEUTRAL_STRENGTH = 1.0

# --- groups -----------------------------------------------------------------
# Position code to label; anything else is UNKNOWN_LABEL.
POSITIONS = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
UNKNOWN_LABEL = "?"
# Accepted spellings of a position.
POSITION_ALIASES = {
    "GK": "GK", "GOALKEEPER": "GK",
    "DEF": "DEF", "DEFENDER": "DEF",
    "MID": "MID", "MIDFIELDER": "MID",
    "FWD": "FWD", "FORWARD": "FWD", "ATT": "FWD", "ATTACKER": "FWD",
    "ALL": "ALL",
}
# Cap of the training target, cap of the raw prediction and
# multiplier for two matches in one period, per position code.
TARGET_CAP = {1: 16, 2: 16, 3: 20, 4: 20}
PREDICTION_CAP = {1: 15, 2: 15, 3: 18, 4: 18}
DOUBLE_MULTIPLIER = {1: 1.6, 2: 1.7, 3: 1.8, 4: 1.9}
DOUBLE_CAP = 20
# Rows considered per position in the outlier report.
OUTLIER_TOP = {"GK": 20, "DEF": 50, "MID": 60, "FWD": 30}
# Group-specific features on top of the common ones.
GROUP_FEATURES = {
    1: ["cs_form", "saves_form", "opp_def_weakness"],
    2: ["cs_form", "opp_def_weakness"],
    3: ["gi_form", "opp_def_weakness"],
    4: ["gi_form", "opp_def_weakness"],
}

# --- business rules ---------------------------------------------------------
# Statuses that rule an entity out.
UNAVAILABLE = ["i", "u", "s"]
# Average minutes (at least) to availability.
MINUTE_BANDS = [(75, 1.0), (60, 0.9), (45, 0.75), (30, 0.55), (15, 0.35)]
LOWEST_AVAILABILITY = 0.10
# Price signal thresholds and texts.
SIGNAL_MOMENTUM = 0.3
SIGNAL_GOOD_FORM = 4
SIGNAL_POOR_FORM = 1
SIGNAL_RISE = "↑ Rise likely"
SIGNAL_FALL = "↓ Fall likely"
SIGNAL_STABLE = "→ Stable"
MIN_PRICE = 0.1
TRAIN_SHARE = 0.8
MIN_ACTIVITY = 1
REPORT_TOP = 10

# --- model ------------------------------------------------------------------
# Boosting settings of the reference forecast.
BOOSTING = {
    "rounds": 800, "learning_rate": 0.03, "max_depth": 3, "subsample": 0.8,
    "feature_share": 0.8, "min_rows": 10, "seed": 42,
}

# --- outliers ---------------------------------------------------------------
RESIDUAL_FACTOR = 0.9
TOP_PERCENTILE = 0.88
SIZE_NULL, SIZE_LOW, SIZE_HIGH = 2, 0.5, 12
SHARE_NULL, SHARE_EPSILON = 5, 1e-9
# Quadrant texts, by (x below median, y above median).
QUADRANTS = {
    "low_high": "HIGH VALUE", "high_low": "OVERPRICED",
    "high_high": "PREMIUM", "low_low": "CHEAP & WEAK",
}

# --- display ----------------------------------------------------------------
# Output headers of the prediction table.
PREDICTION_HEADERS = {
    "web_name": "Player", "element_type": "Pos", "price_m": "Price(£m)",
    "fdr": "FDR", "is_home": "Home", "num_fixtures": "Fixtures",
    "avg_minutes_last5": "AvgMin(L5)", "availability_score": "AvailScore",
    "raw_predicted_points": "RawPts", "predicted_points": "PredPts",
    "value": "Value", "total_points_mean5": "AvgPts(L5)",
    "selected_by_percent": "Sel%", "price_signal": "PriceSignal",
}
# Output headers of the price signal table.
SIGNAL_HEADERS = {
    "web_name": "Player", "element_type": "Pos", "price_m": "Price(£m)",
    "transfer_momentum_norm": "Momentum", "total_points_mean5": "AvgPts(L5)",
    "price_signal": "PriceSignal",
}
# Output headers of the validation table.
VALIDATION_HEADERS = {
    "web_name": "Player", "element_type": "Pos", "gws_eval": "GWsEval",
    "actual_avg": "AvgActualPts", "predicted_avg": "AvgPredPts", "mae": "MAE",
}
# Output headers of the last-periods trace.
TRACE_HEADERS = {
    "event": "GW", "total_points": "Pts", "minutes": "Min",
    "goals_scored": "GS", "assists": "Ast", "clean_sheets": "CS", "bonus": "Bon",
}

# --- chat -------------------------------------------------------------------
MAX_HISTORY = 10
MAX_TOKENS = 1024
RESET_COMMAND = "/start"
# A message is on topic when it contains one of these.
TOPIC_KEYWORDS = [
    "player", "midfielder", "defender", "forward", "goalkeeper",
    "captain", "transfer", "price", "fixture", "fdr", "points",
    "gw", "gameweek", "buy", "sell", "bench", "squad", "team",
    "best", "value", "cheap", "recommend", "who", "should", "vice captain",
    "triple captain", "team",
]
