"""Alignment of two tokenizers' tokens over whole texts by interval coalescing.

Tokenizer A is a byte-level BPE file that reads space + text, B a sentencepiece model that puts that space before the
text itself. Their tokens tile the same bytes. All tokens of both are sorted by where they start; the running maximum
of their ends is accumulated, and a group breaks where a start reaches it. Within a group each A token is linked with
each B token whose bytes overlap its own.

Both tokenizers cut before a single space between two other characters and merge nothing over it, so a text is cut
there into chunks, each of which is tokenized and aligned once for many texts. How often the links of a pair of ids
are found in the corpus, and which pair is the best of its A id, is counted over all documents. Pairs up to
MAX_BROADCAST_PAIRS are looked up by a broadcast, the most frequent ones first; all others are joined by a shuffle,
where no key holds more rows than the least frequent of those broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one

#: Pairs of ids of which counts are sent to every executor, at most; 16 bytes each.
MAX_BROADCAST_PAIRS = 500_000
#: A pair of ids as one number is a * IDS_B + b.
IDS_B = 1 << 20
#: Aligned chunks that a task keeps, and how long they are at most.
_KEPT, _KEPT_CHARS = 150_000, 32
#: Texts that are tokenized together.
_TOGETHER = 128
# A space that starts a new chunk: not after a space, nor before white space.
_BEFORE_WORD = re.compile("(?<=[^ ▁])(?= \\S)")


class Tokens:
    """A: ids and bytes of the tokens of a byte-level BPE file, after a text's leading space."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from loomgraph.llm.packing import _SPLIT

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.fast = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, chunk: str) -> list[int]:
        """tiktoken's merge loop gives the same ids faster; letters of rarer scripts and long chunks go to tokenizers itself."""
        if len(chunk) <= 64 and (chunk.isascii() or max(chunk) < "ɐ"):
            return self.fast(chunk)
        return self.model.encode(chunk, add_special_tokens=False).ids


class Pieces:
    """B: ids and bytes of a sentencepiece model's pieces; it puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError(f"{path} has pieces that go over a space, so texts can't be cut at spaces")
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode([c[1:] for c in chunks], num_threads=1)


def coalesce(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the tokens of two tilings of the same bytes (A's numbered first), the group of each in that order, and the links.

    Tokens are given by their ends. Returned: order, group, and the A and B numbers of each overlapping pair.
    """
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    start, end = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat([0, 1], [len(ends_a), len(ends_b)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.concatenate([[False], start[order][1:] >= reached[:-1]])
    group = np.cumsum(breaks)
    first, after = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    many = after - first
    left = np.repeat(np.arange(len(ends_a)), many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return order, group, left, right


class Aligner:
    """Alignments of chunks: counts of A tokens, B tokens and groups as three 32-bit numbers, links as 64-bit codes, groups as text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokens(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.name_a, self.name_b = ([str(i) for i in range(len(t.bytes))] for t in (self.a, self.b))
        self.known: dict[str, tuple[bytes, bytes, str] | None] = {}

    def align(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes, str] | None]:
        """The alignment of each distinct chunk, None where the tokens don't give back its bytes."""
        ids_a, ids_b = [self.a.encode(c) for c in chunks], self.b.encode(chunks)
        out: dict[str, tuple[bytes, bytes, str] | None] = {}
        good = []
        for k, (chunk, x, y) in enumerate(zip(chunks, ids_a, ids_b, strict=True)):
            whole = chunk.encode()
            if b"".join([self.a.bytes[i] for i in x]) == whole == b"".join([self.b.bytes[i] for i in y]):
                good.append(k)
            else:
                out[chunk] = None
        if not good:
            return out
        many_a, many_b = np.array([len(ids_a[k]) for k in good]), np.array([len(ids_b[k]) for k in good])
        flat_a, flat_b = np.array([i for k in good for i in ids_a[k]]), np.array([i for k in good for i in ids_b[k]])
        order, group, left, right = coalesce(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        codes = flat_a[left].astype(np.int64) * IDS_B + flat_b[right]
        until_a = np.cumsum(many_a)
        links_until = np.searchsorted(left, until_a)  # chunks follow each other, and so do their links
        # within a group A's ids come first: what stands behind an id is told by the next one
        is_b = order >= len(flat_a)
        by_group = np.lexsort((np.arange(len(order)), is_b, group))
        order, group, is_b = order[by_group], group[by_group], is_b[by_group]
        behind = np.concatenate([np.where(group[1:] != group[:-1], 2, np.where(is_b[1:] != is_b[:-1], 1, 0)), [2]])
        ids = np.concatenate([flat_a, flat_b])[order]
        shown = [(self.name_b[i] if b else self.name_a[i]) + ",|;"[s] for i, b, s in zip(ids.tolist(), is_b.tolist(), behind.tolist(), strict=True)]
        until = np.cumsum(many_a + many_b)
        groups = np.diff(np.concatenate([[-1], group[until - 1]]))
        heads = np.stack([many_a, many_b, groups], 1).astype(np.int32)
        at = link = 0
        for n, k in enumerate(good):
            out[chunks[k]] = heads[n].tobytes(), codes[link : links_until[n]].tobytes(), "".join(shown[at : until[n]])
            at, link = until[n], links_until[n]
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """For each text: counts (A, B, groups), codes of all links, groups as text; zeros and nothing where a text has no tokens."""
        cut = [_BEFORE_WORD.split(" " + t) if t else [] for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        here = self.align(new)
        for c in new:
            if len(self.known) < _KEPT and len(c) <= _KEPT_CHARS:
                self.known[c] = here[c]  # frequent chunks come early
        known = self.known
        for chunks in cut:
            found = [here[c] if c in here else known[c] for c in chunks]
            if not found or None in found:
                yield np.zeros(3, np.int64), np.empty(0, np.int64), ""
                continue
            heads, links, groups = zip(*found, strict=True)
            counts = np.frombuffer(b"".join(heads), np.int32).reshape(-1, 3).sum(0, dtype=np.int64)
            yield counts, np.frombuffer(b"".join(links), np.int64), "".join(groups)[:-1]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the text's distinct pairs (codes) with how often each is linked (times), for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(path_a, path_b)
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                counts, n_links, digests, codes, times = [], [], [], [], []
                for count, links, groups in aligner.texts(list(one_by_one(part.column(1)))):
                    distinct, many = np.unique(links, return_counts=True)
                    counts.append(count)
                    n_links.append(len(links))
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                    codes.append(distinct)
                    times.append(many.astype(np.int32))
                three = np.stack(counts)
                until = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(until, pa.array(np.concatenate(x))) for x in (codes, times)]
                yield pa.record_batch([part.column(0), *(pa.array(three[:, i]) for i in range(3)), pa.array(n_links, pa.int64()), pa.array(digests), *lists], names=names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"
    return of_texts(docs).select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(texts: DataFrame) -> DataFrame:
    """code, docs (how many rows of aligned() hold the pair) and best (whether no pair of the same A id is in more)."""
    counts = materialize(texts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("docs")), "pairs")
    id_a = F.shiftright("code", IDS_B.bit_length() - 1)
    most = counts.groupBy(id_a.alias("a")).agg(F.max("docs").alias("most"))  # a row for each entry of A's vocabulary at most
    return counts.withColumn("a", id_a).join(F.broadcast(most), "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _broadcast_from(counts: DataFrame, limit: int) -> int:
    """The least power of two so that at most `limit` pairs are in as many documents."""
    by_size = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("power")).count().collect()  # 63 rows at most
    held, power = 0, 62
    for p, n in sorted(by_size, reverse=True):
        held += n
        if held > limit:
            break
        power = p
    return 0 if held <= limit else 1 << power


def align(docs: DataFrame, path_a: str, path_b: str, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs (doc_id, text; other columns are left out).

    n_best counts the links whose pair is in as many documents as any of its A id, ties included; count_sum adds up
    the documents of each link's pair. Null and empty texts, and texts that tokens don't give back, have zeros and an
    empty digest. Repeated rows count as documents of their own. An empty table gives none.
    """
    raw = aligned(docs, path_a, path_b)
    texts = materialize(raw.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(texts), "counts")
    least = _broadcast_from(counts, max_broadcast)
    each = texts.select("__row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("__row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    frequent, rare = counts.filter(F.col("docs") >= least), counts.filter(F.col("docs") < least)
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    # an inner join on each side: every pair is in one of the two
    parts = each.join(F.broadcast(frequent), "code").groupBy("__row").agg(*sums)
    if least:
        more = each.join(F.broadcast(frequent.select("code")), "code", "left_anti").join(rare, "code").groupBy("__row").agg(*sums)
        parts = parts.unionByName(more).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    whole = texts.drop("codes", "times").join(parts, "__row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
