"""Very long texts, whole sequences and records that lie."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import license_scan, near_dedup, packing, warc
from loomgraph.llm.common import new_path
from loomgraph.llm.queries import tokenizer


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(9000)}" for _ in range(n)]


def test_very_long_near_copies(spark):
    long = words(1, 60_000)
    near, far = long[:], long[:]
    for i in range(0, 60_000, 400):
        near[i] = "new"
    for i in range(0, 60_000, 8):
        far[i] = f"x{i}"
    table = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(reversed(long)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(table).collect()}
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in ((1, long), (2, near), (3, far), (4, long[::-1]))}
    assert got == {i: (len(s), 1 if i == 2 else i) for i, s in sets.items()}
    assert len(sets[1] & sets[2]) / len(sets[1] | sets[2]) >= 0.75 > len(sets[1] & sets[3]) / len(sets[1] | sets[3])


def test_notices_in_a_very_long_text(spark):
    notice = license_scan.TEMPLATES["MIT"]
    text = " ".join([*words(2, 80_000), notice, *words(3, 80_000), notice])
    found = license_scan.scan(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in found] == [(7, "MIT", 1.0)] * 2
    assert all(text[r.start : r.stop].lower() in notice.lower() or notice.lower().startswith(text[r.start : r.stop].lower()) for r in found)


def test_sequences_hold_their_documents_tokens(spark):
    texts = {i: " ".join(words(i, 1 + 37 * i % 900)) for i in range(40)}
    pieces = packing.pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer(), capacity=256)
    packed = packing.pack(pieces.withColumn("crc", F.crc32("ids")), ["doc_id", "piece"], capacity=256)
    rows = packed.collect()
    sequences = {r.sequence_id: (bytes(r.ids), list(r.doc_ids)) for r in packing.sequences(packed).collect()}
    assert len(sequences) == len({r.sequence_id for r in rows})
    for r in rows:
        ids, owners = sequences[r.sequence_id]
        assert zlib.crc32(ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.crc and r.doc_id in owners
    for s, (ids, _) in sequences.items():
        assert len(ids) == 4 * sum(r.length for r in rows if r.sequence_id == s) <= 4 * 256


def test_a_record_that_lies_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>" + "x" * 1200 + "</p>")], "page_id long, url string, html string")
    path = new_path(spark, "archives")
    warc.write_archives(pages, path)
    whole = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    (tmp_path / "part-0").write_bytes(whole.replace(b"xxxxxxxx", b"xxxxyxxx", 1))
    with pytest.raises(Exception, match="doesn't hold its payload"):
        warc.read_archives(spark, str(tmp_path)).collect()
    (tmp_path / "part-0").write_bytes(whole)
    assert warc.read_archives(spark, str(tmp_path)).count() == 1
