"""The corpus pipeline, stage by stage, against brute force on a small corpus with nulls, empty texts, repeats and ties."""

import random
import zlib
from array import array
from collections import Counter

import pytest
from test_llm import DOCS, brute_groups, words

import corpus_pipeline
from loomgraph.llm import toxicity
from loomgraph.llm.queries import tokenizer

COLUMNS = DOCS.replace("size string", "target string")


def corpus():
    r = random.Random(11)
    rows, labels = [], []
    for i in range(260):
        text = words(i, r.choice([1, 4, 30, 120])).split()
        toxic = len(text) > 20 and r.random() < 0.2
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["scumbag", "vermin"]))
        rows.append((i, " ".join(text), r.choice(["a", "a", "b", "c", None])))
        if i % 2:
            labels.append((i, int(toxic)))
    for i in range(40):  # near copies of clean texts, some of them exact
        text = words(1000 + i % 4, 90).split()
        text[i % 90] = text[i % 90] if i % 3 else "other"
        rows.append((300 + i, " ".join(text), "b"))
    rows += [(400, None, "a"), (401, "", "a"), (402, " \n", None), (403, words(7, 3000), "a"), (404, "x", None), (404, "x", None), (None, "no id", "c")]
    return rows, labels


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    table = spark.createDataFrame([(i, t, s, None if t is None else len(t), f"kept {i}") for i, t, s in rows], COLUMNS)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), rows


def test_toxic_documents_go_and_clean_ones_stay(spark, tables):
    folder, docs, rows = tables
    got = Counter(tuple(r)[:3] for r in stage("toxicity")(spark, docs, folder).collect())
    grammar = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert got == Counter(x for x in rows if grammar.score(grammar.features(x[1])) < 0.5)
    assert all(("scumbag" in (t or "") or "vermin" in (t or "")) != ((i, t, s) in got) for i, t, s in rows)


def test_one_document_of_each_group_stays(spark, tables):
    folder, docs, rows = tables
    named = [x for x in rows if x[0] is not None]
    got = stage("minhash near-dedup")(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(brute_groups(named).values())) and sum(r.doc_id is None for r in got) == 1
    assert all(tuple(r)[:3] in rows and r.target == f"kept {r.doc_id}" for r in got) and set(got[0].asDict()) == set(docs.columns)


def brute_targets(rows):
    """Words of each source, shared by weight, none over twice its own."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)


def test_sources_are_mixed_to_their_targets(spark, tables):
    folder, docs, rows = tables
    got = stage("mixing sources")(spark, docs, folder).collect()
    taken, by_id, texts = Counter(), Counter(), {i: t for i, t, _ in rows}
    for r in got:
        n = len(r.text.split())
        taken[r.source] += n
        by_id[r.doc_id] += n
        assert r.n_chars == len(r.text) and texts[r.doc_id].startswith(r.text) and r.target == f"kept {r.doc_id}"
    for s, want in brute_targets(rows).items():
        assert abs(taken[s] - want) <= 2
    repeats = Counter(i for i, _, _ in rows)
    assert all(n <= 2 * repeats[i] * len(texts[i].split()) for i, n in by_id.items())


def test_sequences_hold_every_token_once(spark, tables):
    from tokenizers import Tokenizer

    folder, docs, rows = tables
    model, got = Tokenizer.from_file(tokenizer()), stage("best-fit packing")(spark, docs, folder).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_whole_run_and_empty_tables(spark, tables, tmp_path):
    folder, docs, rows = tables
    kept = docs
    for name, step in corpus_pipeline.STAGES:
        kept = step(spark, kept, folder)
        assert step(spark, docs.limit(0), folder).count() == 0, name
    whole = corpus_pipeline.run(spark, folder)
    key = lambda r: repr((r.doc_id, r.piece, r.length, r.ids_crc32))
    assert sorted(map(key, whole.collect())) == sorted(map(key, kept.collect()))
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
