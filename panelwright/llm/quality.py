"""Quality rules as a short-circuit cascade, in DataFrame operations only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.stored import stored

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000  # documents on which cost and rejection of the rules are estimated


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` is true; it may use the measures and __words, __text."""

    name: str
    rejects: Column


def _lines() -> Column:
    return F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def rules() -> list[Rule]:
    """The rules beyond the base; integer arithmetic, so that any order gives the same verdict."""
    lettered = F.size(F.filter("__words", lambda w: w.rlike(r"\p{L}")))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > F.size(_lines()) * 3)),
        Rule("few_letters", lettered * 10 < F.col("n_words") * 8),
        Rule("few_words", F.size(F.array_distinct("__words")) * 10 < F.least(F.col("n_words"), F.lit(2000)) * 3),
    ]


def _repeated_words() -> Column:
    """Words in windows of three that the text holds twice or more.

    Windows are sorted by hash with their places; those equal to a neighbour repeat. Their places,
    sorted, cover three words each, less where the next one begins.
    """
    window = F.transform(
        F.sequence(F.lit(0), F.size("__words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size("__words") >= 3, F.sort_array(window))


def _repeated_places() -> Column:
    def twice(x: Column, k: Column) -> Column:
        before, after = F.get("__windows", k - 1)["h"], F.get("__windows", k + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    return F.sort_array(F.transform(F.filter("__windows", twice), lambda x: x["i"]))


def _covered() -> Column:
    steps = F.transform("__places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__places", k + 1) - x, F.lit(3))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")


def measures(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The id, the text and its words, and the base measures."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).alias("__id"), text.alias("__text"))
    read = read.withColumn("__words", F.filter(F.split("__text", BLANKS), lambda w: w != ""))
    read = read.withColumn("__windows", _repeated_words()).withColumn("__places", _repeated_places())
    read = read.withColumn("__lines", _lines())
    return read.select(
        "__id", "__text", "__words",
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        _covered().alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def order_rules(sample: DataFrame, chosen: Sequence[Rule], repeats: int = 2) -> list[Rule]:
    """Rules by rejections per second on the sample, the best first.

    All rejection rates come from one aggregation; a rule's cost is the time of a pass that evaluates
    it alone, less that of an empty pass. The order changes the work only, never a verdict.
    """
    rates = sample.agg(*[F.avg(r.rejects.cast("int")).alias(f"r{k}") for k, r in enumerate(chosen)]).first()

    def seconds(condition: Column) -> float:
        best = float("inf")
        for _ in range(repeats):
            start = time.perf_counter()
            sample.agg(F.count_if(condition)).first()
            best = min(best, time.perf_counter() - start)
        return best

    empty = seconds(F.col("n_words") < 0)
    gain = {r.name: (rates[k] or 0.0) / max(seconds(r.rejects) - empty, 1e-3) for k, r in enumerate(chosen)}
    return sorted(chosen, key=lambda r: (-gain[r.name], r.name))


def judge(
    docs: DataFrame, chosen: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Base measures of each whole text, whether it fails the base, and the verdict of the cascade.

    The order of the rules is learned on at most `sample_rows` documents drawn from all parts of the
    table; then each document meets the rules in that order, and the first that rejects it ends its
    cascade. A row stays a row: no shuffle. Null text: empty, no words, so it fails the base. Null or
    repeated ids and repeated rows are kept as they are; all other columns are ignored, whatever their
    names. Empty table: empty result. A text's words are held in one row.
    """
    chosen = rules() if chosen is None else list(chosen)
    # every part gives its first rows of a random thinning, so that no part is read to its end
    thin = stored(docs.select(id_column, text_column).sample(0.2, seed=7).limit(sample_rows), "quality-drawn")
    sample = stored(measures(thin.repartition(8), id_column, text_column), "quality-sample")
    verdict = F.when(F.col("base_failed"), False)
    for rule in order_rules(sample, chosen):
        verdict = verdict.when(rule.rejects, False)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return measures(docs, id_column, text_column).select(
        F.col("__id").alias(id_column), *columns, verdict.otherwise(True).alias("kept")
    )


# The rows of the query op1 in DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r
), m AS (
  SELECT d.r, doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c USING (r)
), b AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR (n_dup_lines >= 3 AND n_dup_lines * 10 > len(lines) * 3)
    OR len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 8
    OR len(list_distinct(w)) * 10 < least(n_words, 2000) * 3) AS kept
FROM b
"""
