"""Importance resampling against counting every document's features by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loomgraph.llm import importance

DOCS = "doc_id long, text string, weight string, rank string, line string, k1 string"


def runs(text, ngrams):
    own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return own, [b" ".join(own[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, ngrams, buckets=10_000, percent=10, least=20):
    found = {i: (len(runs(t, ngrams)[0]), Counter(zlib.crc32(x) % buckets for x in runs(t, ngrams)[1])) for i, t in docs}
    s = sum((c for _, c in found.values()), Counter())
    t = sum((Counter(zlib.crc32(x) % buckets for x in runs(text, ngrams)[1]) for text in target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = {}
    for i, (n, c) in found.items():
        w = sum(gain(b) * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, c.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    for place, i in enumerate(able[: percent * len(able) // 100]):
        out[i][4] = place + 1
    return {i: tuple(x) for i, x in out.items()}


def corpus():
    r = random.Random(8)
    line = lambda: " ".join(r.choice(["Alpha", "beta", "gam-ma", "Él", "ñandú", "x1", "10,5", "日本", "..."]) for _ in range(r.randrange(0, 9)))
    shared = [line() for _ in range(10)]
    texts = [None, "", "\n\n\n", "one", "\none\n\ntwo\n", "A\rb\x0bc d\u0085e", "..."]
    texts += ["\n".join(r.choice([*shared, line()]) for _ in range(r.randrange(1, 30))) for _ in range(120)]
    return list(enumerate(texts)), ["beta x1 beta", None, "日本\nalpha alpha", ""]


@pytest.mark.parametrize("ngrams", [1, 3])
@pytest.mark.parametrize("hot", [1000, 20])
def test_weights_and_draw(spark, ngrams, hot, monkeypatch):
    monkeypatch.setattr(importance, "HOT_PART", hot)
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], DOCS).repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aims, ngrams=ngrams)
    rows = {x.doc_id: (x.n_words, x.n_features, x.weight, x.score, x.rank) for x in got.collect()}
    want = brute(docs, target, ngrams)
    assert rows == want and sum(x[4] is not None for x in want.values()) > 5
    assert importance.resample(df.limit(0), aims, ngrams=ngrams).count() == 0


def test_rows_that_repeat_have_no_id_or_no_target(spark):
    text = "word " * 30
    df = spark.createDataFrame([(5, text, "", "", "", ""), (5, text, "", "", "", ""), (None, text, "", "", "", "")], DOCS)
    rows = importance.resample(df, spark.createDataFrame([], "text string"), percent=100).collect()
    assert sorted((r.doc_id or 0, r.n_features, r.rank) for r in rows if r.doc_id) == [(5, 30, 1), (5, 30, 2)]
    assert [(r.score, r.rank, r.n_features) for r in rows if r.doc_id is None] == [(None, None, 30)]


def test_a_very_long_text(spark):
    r = random.Random(2)
    text = "\n".join(" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(5000))
    df = spark.createDataFrame([(1, text, "", "", "", "")], DOCS)
    (row,) = importance.resample(df, spark.createDataFrame([("w1 w2",)], "text string"), percent=100, ngrams=2).collect()
    assert (row.n_words, row.n_features, row.weight) == brute([(1, text)], ["w1 w2"], 2, percent=100)[1][:3]
