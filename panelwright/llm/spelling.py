"""Spelling variants of words: permuterm rotations sorted by range, neighbours found in prefix groups."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import buffers
from panelwright.llm.stored import stored

MIN_POINTS = 6  # code points of a word
MIN_COUNT = 5  # occurrences of a word
RATIO = 5  # a form occurs so many times as often as its word
THINNED = 199  # of so many places one, by checksum, loses a code point
END = "$"  # marks the end of a word; no letter

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SHORT = 64  # bytes of words whose checksums are put together from tables; others are computed one by one


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8."""
    lead = data == 0xC3  # the code points of this lead byte are U+00C0 to U+00FF
    inside = (data >= 0x61) & (data <= 0x7A) | lead
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[firsts], ends[lasts] = inside[firsts], inside[lasts]  # runs never cross texts
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, buffers.rows_of(starts, offsets)


def _checksums(prefixes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, number: np.ndarray, words: list[bytes]) -> np.ndarray:
    """crc32 of each row's prefix with the word behind it.

    A checksum of joined strings is that of the first, moved on by the length of the second, xor that of
    the second: so prefixes are moved on once per length and words are summed once.
    """
    of_words = np.array([zlib.crc32(w) for w in words], np.uint32)
    longest = int(min(sizes.max(), _SHORT))
    moved = np.empty((longest + 1, len(prefixes)), np.uint32)
    moved[0] = prefixes
    for k in range(longest):
        moved[k + 1] = _CRC[moved[k] & 0xFF] ^ (moved[k] >> 8)
    out = moved[np.minimum(sizes, longest), rows] ^ of_words[number]
    for k in np.flatnonzero(sizes > _SHORT):
        out[k] = zlib.crc32(words[number[k]], int(prefixes[rows[k]]))
    return out


def _counted(min_points: int, thinned: int | None):
    """Words of each slice of texts with how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers.slices(batches, "text"):
            data, offsets = buffers.texts_of(batch.column("text"))
            data = _LOWER[data]
            starts, ends, rows = _runs(data, offsets)
            leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
            long = np.flatnonzero(ends - starts - (leads[ends] - leads[starts]) >= min_points)
            if not len(long):
                continue
            starts, rows, sizes = starts[long], rows[long], (ends - starts)[long]
            at = np.concatenate([[0], np.cumsum(sizes)])
            flat = data[buffers.ranges(starts, sizes)]
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(at), pa.py_buffer(flat)])
            coded = held.dictionary_encode()
            number, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            altered: Counter[str] = Counter()
            if thinned:
                ids = batch.column("id").to_pylist()
                prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                sums = _checksums(prefixes, rows, sizes, number, words)
                hit = sums % thinned == 0
                for k in np.flatnonzero(hit):
                    word = words[number[k]].decode()
                    gone = int(sums[k]) % len(word)
                    altered[word[:gone] + word[gone + 1 :]] += 1
                number = number[~hit]
            counts = np.bincount(number, minlength=len(words))
            out = {w.decode(): int(n) for w, n in zip(words, counts, strict=True) if n}
            for word, n in altered.items():
                if len(word) >= min_points:
                    out[word] = out.get(word, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], names=["word", "n"])

    return run


def counted(
    docs: DataFrame, min_points: int = MIN_POINTS, thinned: int | None = THINNED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Words of whole texts with their occurrences: word, n; words of fewer than `min_points` code points don't count.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With `thinned`, a run whose
    checksum crc32 of "id:run" is a multiple of it loses the code point at checksum modulo length. Counts are
    added up per slice, per task and then by word, so a word that is everywhere costs a row per task. Null
    texts have no words; a null id is written as nothing; repeated rows count each; other columns are
    ignored, whatever their names. Empty table: empty result.
    """
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = read.mapInArrow(_counted(min_points, thinned), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """All rotations of the marked words, each as itself and, if it ends in a letter, without that letter.

    Columns key, last (the letter left out; empty for a whole rotation), word, n, and fresh: the letter left
    out isn't the one before it again. A word without the letter at one place, rotated to that place, is a
    whole rotation; words with any letter there have the same key with that letter left out. So words near
    each other meet in the range of one prefix, key.
    """
    marked, size = F.concat("word", F.lit(END)), F.length("word")

    def rotated(k):
        return F.concat(F.substring(marked, k + 1, size + 1), F.substring(marked, F.lit(1), k))

    def gapped(k):
        letter, before = F.substring("word", k, F.lit(1)), F.substring("word", k - 1, F.lit(1))
        key = F.concat(F.substring(marked, k + 1, size + 1), F.substring(marked, F.lit(1), k - 1))
        return F.struct(key.alias("key"), letter.alias("last"), ((k == 1) | (letter != before)).alias("fresh"))

    whole = F.transform(
        F.sequence(F.lit(0), size), lambda k: F.struct(rotated(k).alias("key"), F.lit("").alias("last"), F.lit(True).alias("fresh"))
    )
    every = F.concat(whole, F.transform(F.sequence(F.lit(1), size), gapped))
    return words.select("word", "n", F.explode(every).alias("r")).select("r.key", "r.last", "word", "n", "r.fresh")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words, both ways, from rotations sorted by key; rows of one key are at most as many as letters."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        key = held.column("key")
        new = np.ones(len(held), bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(new)[-1])  # this key may go on in the next batch
        yield _pairs(held.slice(0, last), new[:last])
        held = held.slice(last)
    if held is not None:
        new = np.zeros(len(held), bool)
        new[0] = True
        yield _pairs(held, new)


def _pairs(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(rows)))
    size = np.repeat(sizes, sizes)
    one = np.repeat(np.arange(len(rows)), size)
    two = buffers.ranges(np.repeat(begins, sizes), size)
    whole = pc.equal(rows.column("last"), "").to_numpy(zero_copy_only=False)
    fresh = rows.column("fresh").to_numpy(zero_copy_only=False)
    # a whole rotation pairs once with each word: of a run of equal letters only the first is left out for it
    chosen = (one != two) & (~(whole[one] | whole[two]) | (fresh[one] & fresh[two]))
    one, two = pa.array(one[chosen]), pa.array(two[chosen])
    word, n = rows.column("word"), rows.column("n")
    return pa.RecordBatch.from_arrays([word.take(one), word.take(two), n.take(two)], names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of distinct words that differ by one inserted, deleted or replaced code point, both ways: word, near, near_n.

    words: word, n, each word once. The rotations are dealt by ranges of their keys and sorted; a key has at
    most one row per letter of the alphabet, so no group is large whatever the words are.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rotations(words).repartitionByRange(parts, "key").sortWithinPartitions("key", "last")
    return dealt.mapInArrow(_scanned, "word string, near string, near_n bigint")


def variants(
    words: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """Each word with the form it is a variant of and the root of its group: word, n, n_near, form, form_n, root.

    words: word, n, each word once (see counted). Only words of `min_points` code points and `min_count`
    occurrences or more take part. A word's form is its near word of most occurrences (ties: the smallest by
    code points), if it has at least `ratio` times as many as the word; the root is where following forms
    ends, the word itself without a form. Counts grow along forms, so they never lead in circles, and
    pointers that double their reach each round find the roots in a few. Null words and counts are left out.
    Other columns are ignored. No words: empty result.
    """
    words = words.select("word", "n").filter((F.length("word") >= min_points) & (F.col("n") >= min_count))
    words = stored(words, "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    )
    found = words.join(best, "word", "left")
    most, strong = -F.col("best.n"), -F.col("best.n") >= F.col("n") * ratio
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, most).alias("form_n"),
    )
    found = stored(found, "spelling-forms")
    reach = stored(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = reach.join(onward, "root", "left")
        longer = longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = stored(longer, "spelling-roots")
        reach = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    roots = found.join(reach, "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The rows of the query op12 in DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, x, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
    FROM documents) WHERE length(x) >= 6 GROUP BY ALL
), codes AS (
  SELECT x, n, list_transform(string_split(doc_id::VARCHAR || ':' || x, ''), lambda c: unicode(c)::BIGINT) AS cs FROM runs
), sums AS (
  SELECT x, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(cs, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))),
    lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295) AS h FROM codes, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word FROM sums)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
    CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT up.word, up.next, f.form FROM up JOIN forms f ON f.word = up.next
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM up WHERE next IS NULL) USING (word)
"""
