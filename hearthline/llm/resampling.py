"""Resampling of documents towards a target distribution by importance weights.

Features are hashed into buckets; a bucket's gain is the logarithm of its share in the target over its share in
the documents, read from one array of all buckets. A document's weight is the mean gain of its features, and
adding Gumbel noise from a hash of its id makes the highest scores a draw without replacement. To draw k
documents no table is sorted whole: a quantile sketch brackets the k-th score, exact counts outside the bracket
validate it or widen it, and only the rows inside are sorted to locate the cutoff.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.files import free_name, saved
from hearthline.llm.mixing import numbered
from hearthline.llm.words import words_of

BUCKETS = 10_000
#: Words of a feature, at most.
RUN = 1
LEAST_WORDS = 20
SEED = 2024
#: Drawn share of the documents that may be drawn, as a fraction.
SHARE = (10, 100)
#: Relative accuracy of the quantile sketch, as its reciprocal.
ACCURACY = 10_000
#: Features that a Python worker remembers the buckets of.
REMEMBERED = 1 << 18


class Buckets(dict):
    """Bucket of a feature: the crc32 of its bytes modulo the number of buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes], run: int) -> np.ndarray:
        """Buckets of all runs of 1 to ``run`` consecutive words, repeats included."""
        found = list(map(self.__getitem__, words))
        for size in range(2, run + 1):
            found += [self[b" ".join(words[i:i + size])] for i in range(len(words) - size + 1)]
        return np.array(found, np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts. Tasks count by themselves and pass on a row a bucket at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                counts += np.bincount(known.of(words_of(data.as_py()), run), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])

    counted = texts.select(F.col(text).cast("binary")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(sources: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from the counts of both sides, in thousandths, rounded down.

    One is added to every count. The array is as long as there are buckets, whatever the tables.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, sources), (t, target)):
        for r in table.collect():  # a row a bucket at most
            counts[r.bucket] = r.n
    total_s, total_t = int(s.sum()), int(t.sum())
    return np.array([
        math.floor(1000 * math.log(float((int(b) + 1) * (total_s + buckets)) / float((int(a) + 1) * (total_t + buckets))))
        for a, b in zip(s, t)
    ], np.int64)


def _weigh(gain: np.ndarray, run: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            out = []
            for data in batch.column(0):
                words = words_of(data.as_py())
                found = known.of(words, run)
                out.append((len(words), len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c, pa.int64()) for c in columns]],
                [*batch.schema.names[1:], "n_words", "n_features", "weight"])
    return score


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of sha256("<seed>:<key>"); a null key is empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of ``n`` scores lies in [low, high], and ``above`` rows score higher than high.

    The sketch's quantiles around the place give a first bracket. Exact counts outside it tell whether the place is
    inside; if not, the side that failed is moved out, eight times as far each time, and to the end at last.
    """
    margin = [2.0 / accuracy, 2.0 / accuracy]
    while True:
        at = 1 - k / n
        low, high = scores.agg(F.percentile_approx(
            "score", [max(0.0, at - margin[0]), min(1.0, at + margin[1])], accuracy)).first()[0]
        if margin[0] >= 1 or margin[1] >= 1:
            ends = scores.agg(F.min("score"), F.max("score")).first()
            low, high = ends[0] if margin[0] >= 1 else low, ends[1] if margin[1] >= 1 else high
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        margin[0 if above < k else 1] *= 8


def draw(scored: DataFrame, k: int, n: int, key: str, accuracy: int = ACCURACY) -> DataFrame:
    """Rows of ``scored`` (a written table with score, ``key`` and a unique long ``tag``) with rank 1 to ``k``, null if not drawn.

    ``n`` rows have a score; rows without one are never drawn. Ranks follow descending scores; ties go to the smaller
    key, a null key last. The rows of the bracket are sorted to find the cutoff, then the drawn rows to number them,
    both over ranges.
    """
    everything = free_name(scored, "all")
    if k < 1:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    eligible = scored.filter("score is not null")
    low, high, above = bracket(eligible, k, n, accuracy)
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("tag")]
    inside = eligible.filter(F.col("score").between(low, high)).select("score", key, "tag", F.lit(0).alias(everything))
    place = free_name(inside, "number")
    last = numbered(inside, everything, order, place).filter(F.col(place) == k - above - 1).first()
    if last[key] is None:
        before = F.col(key).isNotNull() | (F.col("tag") <= last.tag)
    else:
        before = (F.col(key) < last[key]) | ((F.col(key) == last[key]) & (F.col("tag") <= last.tag))
    drawn = F.coalesce((F.col("score") > last.score) | ((F.col("score") == last.score) & F.coalesce(before, F.lit(False))), F.lit(False))
    ranked = numbered(scored.filter(drawn).withColumn(everything, F.lit(0)), everything, order, place)
    return ranked.withColumn("rank", F.col(place) + 1).drop(everything, place).unionByName(
        scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    run: int = RUN, seed: int = SEED, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(``id_col``, n_words, n_features, weight, score, rank) of every row of ``docs``; see ``draw`` for the order of ranks.

    floor(a * N / b) rows are drawn for ``share`` (a, b), N being the rows of at least ``least_words`` words. Null and empty
    texts have no features and weight 0. Null texts of ``target`` count as empty; an empty target gives every feature
    the gain of its rarity. Repeated rows are rows of their own; rows that repeat an id share its noise. The score of
    a row that may not be drawn is given, too.
    """
    gain = gains(bucket_counts(docs, buckets, run, text), bucket_counts(target, buckets, run, text), buckets)
    weighed = docs.select(F.col(text).cast("binary").alias("data"), F.col(id_col).cast("long").alias("key")).mapInArrow(
        _weigh(gain, run), "key long, n_words long, n_features long, weight long")
    held = saved(weighed.select("*", (F.col("weight") + noise(F.col("key"), seed)).alias("total"),
                                F.monotonically_increasing_id().alias("tag")), "weights")
    scored = held.withColumn("score", F.when(F.col("n_words") >= least_words, F.col("total")))
    n = scored.filter("score is not null").count()
    return draw(scored, share[0] * n // share[1], n, "key").select(
        F.col("key").alias(id_col), "n_words", "n_features", "weight", F.col("total").alias("score"), "rank")
