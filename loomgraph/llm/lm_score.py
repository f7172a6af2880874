"""Language-model scores of documents by stupid backoff over word bigrams, as count tables, joins and sums.

S(w | v) = c(v w) / c(v) where the corpus has the bigram at least `least` times, else BACKOFF * c(w) / N; a document's
first word has c(w) / N. A document's score is the sum of the logarithms of its words' S.

1. The table of words, with their counts, is grouped by the words themselves. Words get a number: frequent ones, with
   more than 1 / FREQUENT of all places and so fewer than FREQUENT, a small one, the others their 63-bit hash, which no
   two words of the corpus share.
2. Bigrams of two common words, with more than 1 / COMMON of all places each, are counted apart. Where one of them is
   frequent, its places add to their document's sum where the document is read, by a broadcast of fewer than FREQUENT
   rows, so that no bigram in many documents meets in one task. So do frequent words that open documents.
3. In the same pass, all other places become rows (document, v, w), hash-partitioned by their rare word or, without one, by the
   bigram. A partition has all places of its rare words and bigrams, so their part of the count tables is made there and
   added to the rows: they are sorted by this key, and some keys at a time are counted as arrays. No key of this shuffle
   has more than 1 / COMMON of the rows. What a row still needs, the count of v after a bigram that counts and of w after
   one that doesn't, comes by broadcast for a frequent word and by a join with the table of words for the first of two
   rare ones.
4. Sums by document, combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.llm.common import WORD, materialize, of_texts

BACKOFF, LEAST = 0.4, 2
#: Words and bigrams with a share over 1 / FREQUENT are broadcast: fewer than so many rows of two or three numbers each.
FREQUENT, COMMON = 2_000_000, 50_000
#: Documents whose places are numbered at once.
DOCS = 100
#: Places that are counted at once.
PLACES = 1 << 20
#: What stands for a bigram's other word where that is no first word: numbers above those of frequent words.
_FIRST, _OPENS = 1 << 40, 1 << 50
_SEED = 29


def words_of(text: str) -> Column:
    """The words of a text as an array; null if it has none."""
    bare = F.btrim(text, F.lit("".join(map(chr, (32, *range(9, 14))))))
    return F.split(F.when(bare != "", bare), r"[\x20\x09-\x0D]+")


def _hash(word: str | Column) -> Column:
    """A negative number, apart from the small ones of frequent words."""
    return F.xxhash64(F.lit(_SEED), word).bitwiseOR(F.lit(-(1 << 63)))


def places(docs: DataFrame) -> DataFrame:
    """A row for each word of docs: doc_id, the word's hash w and that of the word before it, v (null for a document's first)."""
    hashes = docs.select("doc_id", F.transform(words_of("text"), _hash).alias("ws"))
    each = hashes.select("doc_id", "ws", F.posexplode("ws").alias("at", "w"))
    return each.select("doc_id", F.get("ws", F.col("at") - 1).alias("v"), "w")


def word_counts(docs: DataFrame) -> DataFrame:
    """The table of words: h (hash) and n (count). Two words with one hash are an error."""
    words = docs.select(F.explode(words_of("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    found = materialize(words.select(_hash("w").alias("h"), "n"), "words")
    if not found.groupBy("h").count().filter("count > 1").isEmpty():
        raise ValueError("two words share a hash; another _SEED parts them")
    return found


def frequent_words(words: DataFrame, total: int, frequent: int) -> DataFrame:
    """h, id and n of the words with a share over 1 / frequent, the most frequent first; fewer than that many rows."""
    few = words.filter(F.col("n") * frequent > total)
    return materialize(few.select("h", (F.row_number().over(Window.orderBy(F.desc("n"), "h")) - 1).cast("long").alias("id"), "n"), "frequent")


def _sorted(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a table of fewer than FREQUENT rows, by the first."""
    keys, values = (c.combine_chunks().to_numpy() for c in table.select(key, value).toArrow().columns)
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id and ws, the hashes of a document's words."""
    return of_texts(docs).select("doc_id", F.transform(words_of("text"), _hash).alias("ws"))


def _numbered(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """Of DOCS documents at a time: doc_id, how many words each has, the place's document, v, w and whether it opens its document."""
    for part in (batch.slice(at, DOCS) for batch in batches for at in range(0, batch.num_rows, DOCS)):
        doc_id, ws = part.columns
        many, raw = ws.value_lengths().fill_null(0).to_numpy(), ws.flatten().to_numpy()
        opens = np.zeros(len(raw), bool)
        opens[(np.cumsum(many) - many)[many > 0]] = True
        at, there = _looked_up(hashes, raw)
        w = np.where(there, ids[at], raw) if len(ids) else raw
        yield doc_id, many, np.repeat(np.arange(len(many)), many), np.roll(w, 1), w, opens


def bigram_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """pair and n: the bigrams of two known words by the words' numbers, counted by PLACES in the tasks and then over all."""
    sent = docs.sparkSession.sparkContext.broadcast(_sorted(known, "h", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(pair), pa.array(n)], names=["pair", "n"])

        held, size = [], 0
        for _, _, _, v, w, opens in _numbered(batches, *sent.value):
            both = ~opens & (v >= 0) & (w >= 0)
            held.append((v[both] << 32) + w[both])
            size += len(held[-1])
            if size >= PLACES:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return _hashed(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def dealt(docs: DataFrame, known: DataFrame, bigrams: DataFrame) -> DataFrame:
    """What all places give, in one pass: doc_id, v, w and s.

    Places of the given bigrams are summed up for their document: a row with s. Each other place is a row with the numbers
    of its words, without s; a frequent word that opens a document gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((_sorted(known, "h", "id"), _sorted(bigrams, "pair", "s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "v", "w", "s"]
        words, (pairs, sums) = sent.value
        for doc_id, many, doc, v, w, opens in _numbered(batches, *words):
            both = np.flatnonzero(~opens & (v >= 0) & (w >= 0))
            at, there = _looked_up(pairs, (v[both] << 32) + w[both])
            met, left = both[there], ~opens | (w < 0)
            left[met] = False
            left = np.flatnonzero(left)
            yield pa.record_batch([doc_id.take(pa.array(doc[left])), pa.array(v[left], mask=opens[left]), pa.array(w[left]), pa.nulls(len(left), pa.float64())], names=names)
            if len(met):
                total, own = np.bincount(doc[met], sums[at[there]], len(many)), np.unique(doc[met])
                none = pa.nulls(len(own), pa.int64())
                yield pa.record_batch([doc_id.take(pa.array(own)), none, none, pa.array(total[own])], names=names)

    schema = StructType([docs.schema["doc_id"]]).add("v", "long").add("w", "long").add("s", "double")
    return _hashed(docs).mapInArrow(run, schema)


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by key as tables of at least so many, each with all rows of its keys."""
    held, size, wanted = [], 0, least
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("key").to_numpy()
        at = int(np.searchsorted(keys, keys[-1]))
        if at:
            yield table.slice(0, at)
        held, size = table.slice(at).to_batches(), size - at
        wanted = max(least, 2 * size)  # a key with many rows isn't copied again for each batch
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def settled(rest: DataFrame, known: DataFrame, total: int, least: int, backoff: float) -> DataFrame:
    """doc_id, need and s of the rows of dealt, given with their key, all of a key in one partition and sorted by it.

    s is what the counts of the key and of frequent words give; need is the rare word whose count is still to be taken
    away, else null.
    """
    sent = rest.sparkSession.sparkContext.broadcast(_sorted(known, "id", "n")[1])
    backed_off = np.log(backoff) - np.log(max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_known, names = sent.value, ["doc_id", "need", "s"]
        for table in _whole_keys(batches, PLACES // 8):
            doc_id, v, w, s, key = (c.combine_chunks() for c in table.columns)
            summed = s.is_valid().to_numpy(zero_copy_only=False)
            if summed.any():
                given = pa.array(np.flatnonzero(summed))
                yield pa.record_batch([doc_id.take(given), pa.nulls(len(given), pa.int64()), s.take(given)], names=names)
            own = np.flatnonzero(~summed)
            if not len(own):
                continue
            opens = v.is_null().to_numpy(zero_copy_only=False)[own]
            v, w, key = v.fill_null(0).to_numpy()[own], w.fill_null(0).to_numpy()[own], key.to_numpy()[own]
            of = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            second = w == key  # the bigram's rare second word, so that the first is what is left of it
            _, other = np.unique(np.where(second, np.where(opens, _OPENS, v), w + _FIRST), return_inverse=True)
            _, place, many = np.unique((of << 32) + other, return_inverse=True, return_counts=True)
            n, n_rare = many[place], np.bincount(of, second)[of]
            counts = ~opens & (n >= least)
            need = np.where(counts, v, w)
            frequent, rare = need >= 0, need == key
            times = np.ones(len(own))
            times[frequent] = n_known[need[frequent]]
            times[~frequent & rare] = n_rare[~frequent & rare]
            part = np.where(counts, np.log(n), np.where(opens, -np.log(max(total, 1)), backed_off))
            yield pa.record_batch([doc_id.take(pa.array(own)), pa.array(need, mask=frequent | rare), pa.array(part + np.where(counts, -1, 1) * np.log(times))], names=names)

    return rest.select("doc_id", "v", "w", "s", "key").mapInArrow(run, StructType([rest.schema["doc_id"]]).add("need", "long").add("s", "double"))


def score(docs: DataFrame, least: int = LEAST, backoff: float = BACKOFF, frequent: int = FREQUENT, common: int = COMMON) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of each row of docs (doc_id, text; other columns are left out), counted over all of them.

    A null or empty text has no words and null scores. Repeated rows count and are scored as often as they are there;
    rows that share a doc_id, null too, with other texts share the mean of their log_scores. An empty table gives none.
    """
    words = word_counts(docs)
    total = words.agg(F.sum("n")).first()[0] or 0
    known = frequent_words(words, total, frequent)
    limit = known.filter(F.col("n") * common > total).count()  # ids below it are common words

    of_id = lambda x: F.broadcast(known.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")))
    backed_off = F.log(F.lit(backoff)) - F.log(F.lit(max(total, 1)))

    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counted = bigram_counts(docs, known.filter(F.col("id") < limit))
    counted = counted.filter(F.col("n") * frequent > total).select("pair", "n", first.alias("v"), second.alias("w"))
    counted = counted.join(of_id("v"), "v").join(of_id("w"), "w")
    values = F.when(F.col("n") >= least, F.log("n") - F.log("n_v")).otherwise(backed_off + F.log("n_w"))
    bigrams = materialize(counted.select("pair", values.alias("s")), "bigrams")
    start = F.log(F.lit(max(total, 1)))
    openers = docs.select("doc_id", F.regexp_extract("text", WORD, 0).alias("w")).filter("w <> ''").select("doc_id", _hash("w").alias("h"))
    openers = openers.join(F.broadcast(known), "h").select("doc_id", (F.log("n") - start).alias("s"))

    rest = dealt(docs, known, bigrams)
    key = F.when(F.col("s").isNotNull(), F.xxhash64("doc_id")).when(F.col("w") < 0, F.col("w")).when(F.col("v") < 0, F.col("v")).otherwise(F.shiftleft("v", 32) + F.col("w"))
    rest = rest.repartition(key).withColumn("key", key).sortWithinPartitions("key")
    found = settled(rest, known, total, least, backoff)
    parts = materialize(found.groupBy("doc_id", "need").agg(F.sum("s").alias("s"), F.count("*").alias("times")), "parts")

    # only a bigram that counts leaves its first word open
    rare = parts.filter("need IS NOT NULL").join(words.select(F.col("h").alias("need"), "n"), "need")
    sums = rare.select("doc_id", (-F.col("times") * F.log("n")).alias("s"))
    sums = parts.select("doc_id", "s").unionByName(sums).unionByName(openers).groupBy(F.col("doc_id").alias("__id")).agg(F.sum("s").alias("s"))
    own = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    times = own.groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("times"))
    sums = sums.join(times, F.col("__id").eqNullSafe(F.col("__key"))).select("__id", (F.col("s") / F.col("times")).alias("s"))
    out = own.join(sums, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    value = F.when(F.col("n_words") > 0, F.col("s"))
    return out.select("doc_id", "n_words", value.alias("log_score"), (value / F.col("n_words")).alias("mean_log_score"))
