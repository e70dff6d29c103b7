"""Records of large JSON documents, read by many tasks (SRC1, SRC2).

A document is read as pieces that end at a closing brace, which Spark cuts into byte ranges like the lines of
any text. Whether a piece begins inside a string and how deep follows from the pieces before it: quotes and
brackets are summed up within each range, ranges are put in order by one small table, and each piece takes the
sums before it. The pieces of one record, which may lie in two ranges, are then put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

KEYED = r'"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*\{'  # an array of objects under a key
NEXT = r"^\s*,\s*\{"
FIRST = r"^\s*\[\s*\{"


def _depth(segments: Column, kept: int) -> Column:
    """Opened less closed brackets of every other segment between quotes, from the first or the second on."""
    outside = F.filter(segments, lambda _, i: i % 2 == kept)
    text = F.array_join(outside, "")
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces up to the next closing brace with their range and place; quotes, and depth gained by either start."""
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    read = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_size").alias("size"),
    )
    # every piece had a brace behind it but for a last one where the file goes on without
    files = read.groupBy(F.col("file").alias("__file")).agg(
        F.max(F.struct("block", "at")).alias("__last"), (F.sum(F.octet_length("value") + 1) > F.max("size")).alias("__open")
    )
    read = read.join(files, F.col("file") == F.col("__file"))
    braced = ~(F.col("__open") & (F.struct("block", "at") == F.col("__last")))
    read = read.select("file", "block", "at", "value", braced.alias("braced"))
    segments = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    return read.withColumn("quotes", (F.size(segments) - 1) % 2).withColumn(
        "gained", F.struct(_depth(segments, 0).alias("outside"), _depth(segments, 1).alias("inside"))
    )


def _with_before(df: DataFrame, column: str, to: str) -> DataFrame:
    """Sum of a column over the pieces before each one in its file: over its range, and over the ranges before."""
    ranges = df.groupBy("file", "block").agg(F.sum(column).alias("__sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = ranges.select(
        F.col("file").alias("__file"), F.col("block").alias("__block"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("__inside", F.coalesce(F.sum(column).over(inside), F.lit(0)))
    joined = joined.join(ranges, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.withColumn(to, F.col("__before") + F.col("__inside")).drop("__file", "__block", "__before", "__inside")


def read_records(spark: SparkSession, path: str, schema: T.StructType, field: str | None = None) -> DataFrame:
    """Objects of the array under `field` of top-level objects, or of top-level arrays, of documents of any size.

    Whatever else a document holds is passed over. A document that breaks off gives the records that are
    whole; a record that can't be parsed gives nothing. A record is held in one task, a document never is.
    """
    level = 1 if field is None else 2
    pieces = _with_before(_pieces(spark, path), "quotes", "quoted")
    within = F.col("quoted") % 2 == 1
    # the brace behind the piece stands outside strings
    closes = F.col("braced") & ((F.col("quoted") + F.col("quotes")) % 2 == 0)
    gained = F.when(within, F.col("gained.inside")).otherwise(F.col("gained.outside")) - closes.cast("int")
    pieces = pieces.withColumn("closes", closes).withColumn("gain", gained)
    pieces = _with_before(pieces, "gain", "depth")
    ends = F.col("closes") & (F.col("depth") + F.col("gain") == level)
    pieces = _with_before(pieces.withColumn("ends", ends.cast("int")), "ends", "number")
    # a record begins in its last piece that starts no deeper than its array, and goes on with the deeper ones
    piece = F.struct("block", "at", (F.col("depth") <= level).alias("begins"), "value", "depth", (F.col("quoted") % 2).cast("int").alias("inside"))
    found = pieces.groupBy("file", "number").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("ends").alias("whole"))
    found = found.filter("whole = 1")
    last = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), lambda a, p: F.struct(
        F.when(p["begins"], a["n"]).otherwise(a["at"]).alias("at"), (a["n"] + 1).alias("n")))["at"]
    texts = F.transform(F.slice("pieces", last + 1, F.size("pieces")), lambda p: F.concat(p["value"], F.lit("}")))
    found = found.select("file", "number", F.array_join(texts, "").alias("text"), F.get("pieces", last).alias("first"))
    found = found.withColumn("head", F.col("first.value"))
    if field is None:
        records = found.filter(F.col("head").rlike(FIRST) | F.col("head").rlike(NEXT))
        text = F.regexp_replace("text", r"^\s*[,\[]\s*", "")
    else:
        goes_on = F.col("head").rlike(NEXT)
        opening = F.split(F.regexp_replace(F.regexp_extract("head", "(?s)^(.*?)" + KEYED, 1), r"(?s)\\.", ""), '"', -1)
        inside = F.when(F.col("first.inside") == 1, _depth(opening, 1)).otherwise(_depth(opening, 0))
        keyed = ~goes_on & F.col("head").rlike(KEYED) & (F.col("first.depth") + inside == 1)  # a key of the document itself
        found = found.withColumn("key", F.when(keyed, F.regexp_extract("head", KEYED, 1)))
        found = found.filter(goes_on | F.col("key").isNotNull())
        arrays = found.filter("key IS NOT NULL").groupBy(F.col("file").alias("__file")).agg(
            F.sort_array(F.collect_list(F.struct("number", "key"))).alias("arrays")  # a few per document
        )
        mine = F.filter("arrays", lambda a: a["number"] <= F.col("number"))
        records = found.join(arrays, F.col("file") == F.col("__file")).filter(F.element_at(mine, -1)["key"] == field)
        text = F.when(goes_on, F.regexp_replace("text", r"^\s*,\s*", "")).otherwise(
            F.regexp_replace("text", r"(?s)^.*?" + KEYED, "{")
        )
    parsed = records.select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r IS NOT NULL")
    return parsed.select("r.*")
