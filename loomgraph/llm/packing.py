"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity`
entries, whatever the input) reaches the driver. There the plan is made: for the longest length left, the gap is
looked up in an index of single, pair and triple sums of the lengths still available; an exact combination is
consumed as many times as its counts allow, and where there is none, the longest piece that fits goes in first and
the lookup repeats. The plan is a list of patterns with counts. Each piece then finds its place from its rank among
the pieces of its length, by arithmetic.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one, small_table

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 500_000
_CACHE_WORDS, _CACHE_CHARS, _CHUNK_ROWS = 40_000, 32, 256
# Fixed: how byte-level tokenizers of this kind split a text before they merge.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Odd(Exception):
    """A word that can't be encoded apart from its neighbours."""


class _Words(dict):
    """Ids of words after `before`, made when first asked for."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        ids = array("I", self.encode(self.before + word)).tobytes()
        if len(word) <= _CACHE_CHARS and len(self) < _CACHE_WORDS:
            self[word] = ids  # frequent words come early
        return ids


class WordEncoder:
    """Ids of texts as `tokenizers` gives them for a byte-level BPE file, with the ids of words kept.

    Such a tokenizer splits a text before each single space between two characters that are no white space, and
    never merges over such a split, so a text's ids are those of its parts. Parts go through tiktoken's merge loop
    over the file's own vocabulary, which gives the same ids in a quarter of the time. A text with other white space
    around a space, or with one of the file's added tokens in it, is encoded whole by tokenizers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the files write bytes as characters: printable ones as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        encode = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.rest = _Words(encode, ""), _Words(encode, " ")

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not any(x in text for x in self.added):
            head, *tail = text.split(" ")
            try:
                return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
            except _Odd:
                pass
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of n tokens: only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize texts and cut them: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Each text, null as empty, is followed by end_id, so that every row gives a piece. Texts of up to capacity tokens
    are not cut. Other columns of docs are left out; repeated rows give repeated pieces; an empty table gives none.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary"

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or WordEncoder(tokenizer)
            for at in range(0, batch.num_rows, _CHUNK_ROWS):
                part = batch.slice(at, _CHUNK_ROWS)
                rows, number, start, length, ids = [], [], [], [], []
                for i, text in enumerate(one_by_one(part.column(1))):
                    own = encoder.encode(text or "") + end
                    for k, (s, n) in enumerate(cut(len(own) // 4, capacity)):
                        rows.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(n)
                        ids.append(own[4 * s : 4 * (s + n)])
                yield pa.record_batch(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return of_texts(docs).select("doc_id", "text").mapInArrow(tokenized, schema)


def _highest(bits: int) -> int:
    return bits.bit_length() - 1


class _Lengths:
    """Counts of available lengths, with an index of the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = dict(counts), capacity
        self.ones = sum(1 << n for n, c in counts.items() if c)
        self.pairs = None

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                self.ones &= ~(1 << n)
                self.pairs = None

    def enough(self, lengths: list[int]) -> bool:
        return all(self.left.get(n, 0) >= lengths.count(n) for n in set(lengths))

    def _pair_sums(self) -> int:
        if self.pairs is None:
            self.pairs, bits = 0, self.ones
            while bits:
                low = bits & -bits
                self.pairs |= self.ones * low
                bits ^= low
            self.pairs &= (1 << (self.capacity + 1)) - 1
        return self.pairs

    def _descending(self, bits: int) -> Iterator[int]:
        while bits:
            n = _highest(bits)
            bits ^= 1 << n
            yield n

    def exact(self, gap: int, own: list[int]) -> list[int] | None:
        """One to three available lengths that fill gap exactly beside own, the longest first."""
        if not gap:
            return []
        if self.ones >> gap & 1 and self.enough([*own, gap]):
            return [gap]
        pairs, under = self._pair_sums(), self.ones & ((1 << gap) - 1)
        if pairs >> gap & 1:
            for a in self._descending(under):
                if 2 * a < gap:
                    break
                if self.ones >> (gap - a) & 1 and self.enough([*own, a, gap - a]):
                    return [a, gap - a]
        for a in self._descending(under):
            if 3 * a < gap:
                break
            if pairs >> (gap - a) & 1:
                for b in self._descending(self.ones & ((1 << min(a + 1, gap - a)) - 1)):
                    if 2 * b < gap - a:
                        break
                    if self.ones >> (gap - a - b) & 1 and self.enough([*own, a, b, gap - a - b]):
                        return [a, b, gap - a - b]
        return None

    def fitting(self, gap: int, own: list[int]) -> int | None:
        """The longest available length that fits gap beside own."""
        for n in self._descending(self.ones & ((1 << (gap + 1)) - 1)):
            if self.enough([*own, n]):
                return n
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, longest first after the opener) and how many sequences follow each."""
    index, patterns = _Lengths(counts, capacity), []
    while index.ones:
        own = [_highest(index.ones)]
        while True:
            gap = capacity - sum(own)
            if (rest := index.exact(gap, own)) is not None:
                own += rest
                break
            if (n := index.fitting(gap, own)) is None:
                break
            own.append(n)
        times = min(index.left[n] // own.count(n) for n in set(own))
        index.take(own, times)
        patterns.append((own, times))
    return patterns


def _places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Per length, for each pattern with it: first rank, first sequence, pieces in a sequence, offset of the first."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            many = lengths.count(n)
            found.setdefault(n, []).append((used.get(n, 0), sequence, many, offset))
            used[n] = used.get(n, 0) + many * times
            offset += n * many
        sequence += times
    return sorted(found.items())


def pack(lengths: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a length from 1 to capacity; order names columns that tell rows apart.

    No piece is dropped or cut. Rows that tie in order share out their places in any way, which gives the same
    result. Columns named sequence_id or offset are replaced. An empty table stays empty; a null length or one
    outside the range is an error.
    """
    wrong = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    own = [c for c in lengths.columns if c not in ("sequence_id", "offset")]
    checked = F.when(wrong, F.raise_error(F.lit(f"a length must be from 1 to {capacity}"))).otherwise(F.col("length")).cast("long")
    table = materialize(lengths.select(*own).withColumn("length", checked), "pieces")
    counts = {n: c for n, c in table.groupBy("length").count().collect()}
    salts = max(16, min(4096, -(-sum(counts.values()) // RANKED_TOGETHER)))
    places = small_table(table.sparkSession, _places(plan_patterns(counts, capacity)), "length long, __places array<struct<rank: long, sequence: long, many: long, offset: long>>")
    salted = table.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    by_salt = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")
    by_salt = by_salt.select("length", "__salt", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1
    ranked = salted.join(by_salt, ["length", "__salt"]).withColumn("__rank", F.col("__before") + rank)
    # one row for each length, at most capacity of them
    placed = ranked.join(F.broadcast(places), "length").withColumn("__p", F.expr("element_at(__places, size(filter(__places, p -> p.rank <= __rank)))"))
    within = F.col("__rank") - F.col("__p.rank")
    sequence = F.col("__p.sequence") + F.floor(within / F.col("__p.many")).cast("long")
    offset = F.col("__p.offset") + within % F.col("__p.many") * F.col("length")
    return placed.select(*own, sequence.alias("sequence_id"), offset.alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id, ids and the documents in them, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts")
    joined = F.expr("aggregate(parts, CAST('' AS BINARY), (a, p) -> concat(a, p.ids))").alias("ids")
    return packed.groupBy("sequence_id").agg(parts).select("sequence_id", joined, F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids"))


