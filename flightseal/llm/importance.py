"""Resampling by importance towards a target distribution.

Runs of words fall into hashed buckets. Their counts over all documents and
over all target texts give each bucket a gain, kept in an array as long as
there are buckets, whatever the corpus; a document's weight is the sum of the
gains that its features point at. Gumbel noise from a hash of the id makes the
highest scores a draw without replacement in proportion to exp(weight); a
distributed radix sort ranks the scores.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import radix
from .common import small_batches, tidy

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SCALE = 1000
#: Everything but digits, letters and what is not ASCII parts words; A-Z become a-z.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b | 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def features(found: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words, repeats included."""
    runs = found if longest == 1 else [b" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]
    return (np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % buckets).astype("<u4")


def hashed(texts: DataFrame, key: str | None, longest: int, buckets: int) -> DataFrame:
    """(key, n_words, features): buckets of each text as little-endian unsigned 32-bit numbers."""
    name = F.col(key).cast("long") if key else F.lit(None).cast("long")

    def run(batches):
        for batch in batches:
            split = [words(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [features(w, longest, buckets).tobytes() for w in split]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, split), pa.int64()), pa.array(found, pa.binary())], names=["key", "n_words", "features"])

    return small_batches(texts.select(name.alias("key"), F.col("text").cast("string"))).mapInArrow(tidy(run), "key long, n_words long, features binary")


def counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket. Tasks send one row per bucket they met, the driver gets one per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column("features").to_pylist():
                total += np.bincount(np.frombuffer(own, "<u4"), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.select("features").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floor of SCALE times the logarithm of how much more likely it is in the target, with one more of each."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: int | None, seed: int) -> int:
    """Scaled Gumbel noise decided by the id; a null id hashes as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)"""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            own = [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
            weight = [int(gain[x].sum()) for x in own]
            score = [w + noise(k, seed) for w, k in zip(weight, keys)]
            values = [batch.column("key"), batch.column("n_words"), *(pa.array(x, pa.int64()) for x in (map(len, own), weight, score))]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row per document.

    Of the documents with `least_words` words the `percent` in 100 (rounded
    down) with the highest scores have a rank, from 1; ties go to the smaller
    doc_id, null ids last. target: a table with the column text. A null text has
    no words. Repeated rows are documents of their own with equal scores and
    ranks that follow each other. Without target texts all gains come from the
    documents alone; an empty table gives no rows. Other columns do not go along.
    """
    made = materialize(hashed(docs, "doc_id", longest, buckets), "importance-features")
    gain = gains(counts(made, buckets), counts(hashed(target, None, longest, buckets), buckets))
    rows = materialize(scored(made, gain, seed), "importance-scores")
    fitting, enough = rows.where(F.col("n_words") >= least_words), F.col("n_words") < least_words
    drawn = fitting.count() * percent // 100
    ranks = radix.ranked(fitting, [("score", True), ("doc_id", False)], "rank")
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.unionByName(rows.where(enough).withColumn("rank", F.lit(None).cast("long")))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows in DuckDB's SQL. The checksum's table and its steps are list functions over the bytes of each distinct word.
SQL = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), texts AS (
  SELECT doc_id, coalesce(text, '') AS text, true AS own FROM documents
  UNION ALL SELECT NULL, coalesce(text, ''), false FROM benchmark
), split AS (
  SELECT row_number() OVER () AS id, doc_id, own,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM texts
), found AS (
  SELECT id, own, unnest(words) AS word FROM split
), counted AS (
  SELECT id, own, word, count(*) AS n FROM found GROUP BY ALL
), hexed AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)
), bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, tab
), placed AS (
  SELECT id, own, bucket, n FROM counted JOIN bucketed USING (word)
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM placed GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g FROM sums, totals
), weights AS (
  SELECT id, CAST(sum(n * g) AS BIGINT) AS weight FROM placed JOIN gain USING (bucket) WHERE own GROUP BY id
), scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (id) WHERE own
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fitting FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * fitting // 100 THEN place END AS rank
FROM ordered
"""
