"""Importance resampling towards a target distribution, with texts cut into segments that are counted once.

A text's features are its runs of 1 to `ngrams` words, hashed to buckets. Newlines separate words, so they cut texts
into lines. The distinct lines of all documents are found by grouping, which sums up how often each occurs before
anything is shuffled. Each distinct line's features are counted once; the corpus holds them as often as the line
occurs, and a document's weight is the sum of its lines' weights. Runs of words that go over a newline belong to no
line: they are counted from the documents themselves and added.

A document's lines find their weights by a join on the line's hashes. Lines with more than a thousandth of all
occurrences (so at most a thousand) are looked up by a broadcast, so no key of the shuffle holds more than that share.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one, small_table, with_ordinal

NGRAMS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: A line with more than this part of all occurrences is looked up by a broadcast.
HOT_PART = 1000
#: A-Z become small, ASCII characters other than letters and digits separate words.
_FOLDED = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_ARRAYS = "buckets array<int>, times array<int>"


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return text.encode().translate(_FOLDED).split() if text else []


def features(own: list[bytes], ngrams: int, buckets: int) -> np.ndarray:
    """The buckets of all runs of 1 to ngrams words."""
    runs = own if ngrams == 1 else [b" ".join(own[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(own) - n + 1)]
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def crossing(text: str | None, ngrams: int, buckets: int) -> np.ndarray:
    """The buckets of the runs of 2 to ngrams words whose words aren't all in one line."""
    own, line = [], []
    for k, part in enumerate((text or "").split("\n")):
        found = words(part)
        own += found
        line += [k] * len(found)
    runs = [b" ".join(own[i : i + n]) for n in range(2, ngrams + 1) for i in range(len(own) - n + 1) if line[i] != line[i + n - 1]]
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def _counted(found: list[np.ndarray]) -> list[pa.Array]:
    """Distinct buckets and how often each is there, as two columns of lists."""
    pairs = [np.unique(x, return_counts=True) for x in found]
    until = pa.array(np.cumsum([0, *(len(b) for b, _ in pairs)]), pa.int32())
    return [pa.ListArray.from_arrays(until, pa.array(np.concatenate([p[i] for p in pairs]).astype(np.int32))) for i in (0, 1)]


def _lines(column):
    return F.split(F.coalesce(column, F.lit("")), "\n")


def _hashes(line):
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("second"), line).alias("k2"))


def distinct_lines(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """k1 and k2 (hashes), occurrences, n_words, n_features, and buckets with times of each distinct line of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [words(t) for t in one_by_one(batch.column(0))]
                found = [features(w, ngrams, buckets) for w in own]
                sizes = [pa.array(list(map(len, x)), pa.int64()) for x in (own, found)]
                yield pa.record_batch([*batch.columns[1:], *sizes, *_counted(found)], names=["k1", "k2", "occurrences", "n_words", "n_features", "buckets", "times"])

    lines = texts.select(F.explode(_lines(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("occurrences"))
    keyed = lines.select("line", _hashes(F.col("line")).alias("k"), "occurrences").select("line", "k.k1", "k.k2", "occurrences")
    return of_texts(keyed).mapInArrow(run, f"k1 long, k2 long, occurrences long, n_words long, n_features long, {_ARRAYS}")


def with_crossing(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the hashes of the lines (lines), and buckets with times of the runs that go over newlines, for each row; __row tells rows apart."""
    keyed = texts.select("doc_id", F.transform(_lines(F.col("text")), _hashes).alias("lines"), "text")
    none = F.array().cast("array<int>")
    if ngrams > 1:
        schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lines array<struct<k1: long, k2: long>>, {_ARRAYS}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = [crossing(t, ngrams, buckets) for t in one_by_one(batch.column(2))]
                    yield pa.record_batch([batch.column(0), batch.column(1), *_counted(found)], names=["doc_id", "lines", "buckets", "times"])

        keyed = of_texts(keyed).mapInArrow(run, schema)
    else:
        keyed = keyed.select("doc_id", "lines", none.alias("buckets"), none.alias("times"))
    return keyed.withColumn("__row", F.monotonically_increasing_id())


def bucket_counts(lines: DataFrame, crossed: DataFrame, buckets: int) -> np.ndarray:
    """How many features of the corpus each bucket holds: `buckets` numbers, whatever the corpus."""
    weighed = lines.select("buckets", "times", "occurrences").unionByName(crossed.select("buckets", "times", F.lit(1).cast("long").alias("occurrences")))
    each = weighed.select("occurrences", F.explode(F.arrays_zip("buckets", "times")).alias("f"))
    sums = each.groupBy(F.col("f.buckets").alias("bucket")).agg(F.sum(F.col("f.times") * F.col("occurrences")).alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln of how much likelier a feature is in the target than in the source), counts smoothed by one."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(table: DataFrame, gain: np.ndarray, keys: list[str]) -> DataFrame:
    """keys and the sum of gains over buckets and times of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, times = batch.column(len(keys)), np.asarray(batch.column(len(keys) + 1).flatten())
                sums = np.concatenate([[0], np.cumsum(gain[np.asarray(found.flatten())] * times)])
                until = np.concatenate([[0], np.cumsum(np.asarray(found.value_lengths()))])
                yield pa.record_batch([*batch.columns[: len(keys)], pa.array(sums[until[1:]] - sums[until[:-1]], pa.int64())], names=[*keys, "weight"])

    schema = ", ".join(f"{k} {table.schema[k].dataType.simpleString()}" for k in keys)
    return table.select(*keys, "buckets", "times").mapInArrow(run, f"{schema}, weight long")


def weights(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs, by the feature counts of docs and of target (both: text)."""
    lines = materialize(distinct_lines(docs, ngrams, buckets), "lines")
    rows = materialize(with_crossing(docs, ngrams, buckets), "rows")
    aims = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(bucket_counts(lines, rows, buckets), bucket_counts(distinct_lines(aims, ngrams, buckets), with_crossing(aims, ngrams, buckets), buckets))
    values = ["n_words", "n_features", "weight"]
    weighed = materialize(_weighed(lines, gain, ["k1", "k2", "occurrences", "n_words", "n_features"]), "weights")
    hot = weighed.filter(F.col("occurrences") * HOT_PART > (weighed.agg(F.sum("occurrences")).first()[0] or 0))
    hot = small_table(docs.sparkSession, [tuple(r) for r in hot.select("k1", "k2", *values).collect()], "k1 long, k2 long, n_words long, n_features long, weight long")  # under HOT_PART rows
    each = rows.select("__row", F.inline("lines"))
    found = each.join(F.broadcast(hot), ["k1", "k2"], "left")
    known = found.filter("weight IS NOT NULL")
    rest = found.filter("weight IS NULL").select("__row", "k1", "k2").join(weighed, ["k1", "k2"])
    parts = known.select("__row", *values).unionByName(rest.select("__row", *values))
    if ngrams > 1:
        over = _weighed(rows, gain, ["__row"]).join(rows.select("__row", F.expr("aggregate(times, 0L, (a, t) -> a + t)").alias("n_features")), "__row")
        parts = parts.unionByName(over.select("__row", F.lit(0).cast("long").alias("n_words"), "n_features", "weight"))
    sums = parts.groupBy("__row").agg(*(F.sum(v).alias(v) for v in values))
    return rows.select("__row", "doc_id").join(sums, "__row").select("doc_id", *values)


def resample(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for each row of docs (doc_id, text; other columns are left out).

    The score is the weight plus Gumbel noise that follows from seed and doc_id, so the highest scores are a draw
    without replacement in proportion to the weights. Of the documents of at least least_words words, percent of a
    hundred are drawn; rank is their place from 1, ties to the smaller doc_id, and null for all others. Null and empty
    texts have no features, weight 0 and no rank. A row without doc_id has neither score nor rank. Repeated rows count
    and stand as rows of their own. An empty table gives none; an empty target leaves weights to the smoothed counts.
    """
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weights(docs, target, ngrams, buckets).withColumn("score", F.col("weight") + noise), "scored")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ranked = with_ordinal(scored.filter(able), [F.col("score").desc(), F.col("doc_id").asc()], "__at")
    most = percent * scored.filter(able).count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("__at") < most, F.col("__at") + 1)).drop("__at")
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
