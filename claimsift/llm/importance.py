"""Importance resampling of documents toward a target's distribution of features.

Features are runs of consecutive words, hashed into buckets by CRC-32 (see
``checksum``). A bucket's gain says how much more often the target has it than
the documents do; a document's weight is the sum of its features' gains. With
a draw of its own added, that makes a score, and the documents with the highest
scores are a sample without replacement in which likelier ones stand first.

Texts are read once: their buckets are written as two-byte numbers, from which
both the counts over all documents and every document's weight are taken. Only
the counts, one figure a bucket, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.llm import checksum, chunks
from claimsift.llm.checksum import CRC_TABLE, crc32_sql
from claimsift.llm.common import stored, table
from claimsift.llm.ranks import numbered

# Fixed values of the contract: words in a run at most, buckets, the percentage
# that is drawn, the words that a document needs for it, the seed of the draws.
RUN_WORDS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
# Bytes of text described at once: each takes some ten bytes of working arrays.
TEXT_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# Bytes of words: digits, letters and all of characters beyond ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[ord("0") : ord("9") + 1] = True
_INSIDE[ord("a") : ord("z") + 1] = True
_INSIDE[128:] = True

DESCRIBED = "doc_id long, n_words long, n_features long, buckets binary"


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and length of each word, words of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]]
    edges = edges - edges[0]
    inside = np.concatenate([[False], _INSIDE[raw], [False]])
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # Words end where their text does.
    filled = edges[:-1] < edges[1:]
    first, last = edges[:-1][filled], edges[1:][filled] - 1
    begin[first] |= inside[1:-1][first]
    end[last] |= inside[1:-1][last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, edges))
    return raw, starts, ends - starts, counts


def features(texts: pa.Array, runs: int = RUN_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, and the words and features of each text."""
    raw, starts, lengths, counts = words(texts)
    if runs == 1:
        return checksum.crc32(raw, starts, lengths) % buckets, counts, counts
    # All words with one space behind each; a run is a span of that.
    joined = np.append(raw, np.uint8(0))
    joined = chunks.ragged(joined, starts, lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    joined[ends] = 32
    begin = ends - lengths
    text = np.repeat(np.arange(len(counts)), counts)
    found, of = [], []
    for n in range(1, runs + 1):
        first = np.arange(max(len(starts) - n + 1, 0))
        first = first[text[first] == text[first + n - 1]]
        found.append(checksum.crc32(joined, begin[first], ends[first + n - 1] - begin[first]) % buckets)
        of.append(text[first])
    order = np.argsort(np.concatenate(of), kind="stable")
    return np.concatenate(found)[order], counts, np.bincount(np.concatenate(of), minlength=len(counts))


def width(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def described(docs: DataFrame, runs: int, buckets: int) -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)`` of whole texts; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.slices(batch, "text", TEXT_BYTES):
                found, n, m = features(part.column("text"), runs, buckets)
                data = found.astype(width(buckets))
                ends = np.concatenate([[0], np.cumsum(m)]) * data.itemsize
                lists = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64)), lists], ["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, DESCRIBED)


def numbers(lists: pa.Array, buckets: int) -> np.ndarray:
    """All bucket numbers of a column, one row after the other."""
    edges = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    return np.frombuffer(lists.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].view(width(buckets))


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all rows of ``described``; each task gives a figure a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(numbers(batch.column("buckets").cast(pa.binary()), buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["bucket", "n"])

    counts = rows.select("buckets").mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(ours: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket the thousandths of the logarithm of how much likelier the target has it."""
    spark = ours.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(ours.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of ``described`` with ``weight`` in place of their buckets."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = numbers(batch.column("buckets").cast(pa.binary()), buckets)
                weight = chunks.sums(gain[found], np.asarray(batch.column("n_features")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A document's own draw, in thousandths: it depends on seed and id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    runs: int = RUN_WORDS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_features, weight, score, rank``.

    ``rank`` counts the drawn ones, ``percent`` of the rows with ``least`` words
    or more, from the highest score on, ties to the smaller ``doc_id``; it is
    null for the others. Null texts have no features and weight 0, as have
    empty ones; long texts count whole. A row without ``doc_id`` draws like the
    empty id and comes first among ties. Rows that repeat are rows of their own:
    they count each time and have the same score. Empty tables on either side
    are counts of zero. Other columns do not count.
    """
    rows = stored(described(docs, runs, buckets), "importance-features")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(counted(rows, buckets), counted(described(wanted, runs, buckets), buckets), buckets)
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scored.withColumn("open", F.col("n_words") >= least)
    ranked = numbered(scored, ["open"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "importance-scores")
    drawn = F.col("open") & (F.col("rank") * 100 + 100 <= F.col("total") * percent)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank") + 1).alias("rank"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op11: a tenth of the documents, drawn toward the benchmark's words."""
    rows = resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def words_sql(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"coalesce(regexp_extract_all(translate({text}, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


# One word a feature, as the contract has it.
ORACLE = f"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS n, doc_id, {words_sql('text')} AS words FROM documents),
ours AS (SELECT n, unnest(words) AS word FROM docs),
theirs AS (SELECT unnest({words_sql('text')}) AS word FROM benchmark),
vocabulary AS (
  SELECT word, {crc32_sql('word')} % {BUCKETS} AS bucket
  FROM (SELECT word FROM ours UNION SELECT word FROM theirs), crc_table),
s AS (SELECT bucket, count(*) AS s FROM ours JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM theirs JOIN vocabulary USING (word) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM ours) + {BUCKETS} AS DOUBLE)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM theirs) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM range({BUCKETS}) b(bucket) LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
weights AS (SELECT n, CAST(sum(gain) AS BIGINT) AS weight FROM ours JOIN vocabulary USING (word) JOIN gain USING (bucket) GROUP BY n),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (n)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS total
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= total * {PERCENT} // 100 THEN place END AS rank
FROM placed
"""
