"""The training-data operators against brute force, round trips and planted cases, with nulls, ties, empty tables and clashing columns."""

import gzip
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import additive_quantisation, bit_sliced, html_extraction, license_scan, lm_score, mixing, near_dedup, packing, toxicity, warc
from loomgraph.llm.common import new_path
from loomgraph.llm.queries import tokenizer

DOCS = "doc_id long, text string, source string, n_chars long, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), "extra") for i, t, s in rows], DOCS)


def words(seed, n, kinds=2000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


# ---- pages

PAGE = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>One\n two.<br><p>Three&nbsp;four</p><div class="comments">nice</div></article><footer>&copy; us</footer>'


def test_article_without_its_surroundings(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert got[1] == got[4] == "Head & line\nOne two.\nThree four" and got[2] == got[3] == ""
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_surge_and_dive_without_an_article():
    body = "".join(f"<p>{'long text of the story ' * 8}{i}</p>" for i in range(5))
    page = f"<body><ul>{'<li><a href=x>link</a></li>' * 9}</ul>{body}<ul>{'<li><a href=x>more</a></li>' * 9}</ul></body>"
    text = html_extraction.extract_text(page)
    assert text.count("\n") == 4 and "link" not in text and "more" not in text


STORY = [f"{'long text of the story ' * 8}{i}" for i in range(5)]


@pytest.mark.parametrize(
    "page",
    [
        "<body>{divs}<article><a href=x>Read this too</a></article></body>",
        "<body>{divs}<article class='teaser'><p>A teaser of another story that goes on and on, longer than the threshold of a surge point.</p></article></body>",
        "<body><article>{divs}</article><div class=related><article><p>{other}</p></article></div></body>",
        "<body><main>{divs}<article class=comment><p>{other}</p></article></main><div id=comments>{comments}</div></body>",
        "<body><form action=x><nav><a href=y>Home</a></nav><article>{divs}</article></form></body>",
        "<body><form action=x>{divs}<div class=ad>{other}</div></form><footer>{other}</footer></body>",
        "<body><div class='page has-sidebar'>{divs}<div class=sidebar>{other}</div></div></body>",
        "<body><nav><ul><li><a href=y>Home</a><article>{divs}</article></body>",
        "<head><body>{divs}</body>",
    ],
)
def test_main_text_beside_articles_and_in_wrappers(page):
    other = "What someone else has to say on this, longer than the threshold that a surge point needs."
    html = page.format(divs="".join(f"<div>{x}</div>" for x in STORY), other=other, comments=f"<article><p>{other}</p></article>" * 20)
    assert html_extraction.extract_text(html) == "\n".join(STORY)


def test_lines_are_blocks_and_notices_go():
    page = f"<body><article><p>{STORY[0]}<br><br>more<br/>still</p><p class='advert'>Buy</p><p class=notice>Mind</p><div class='alert'>Oh</div><h2 class='promo-line'>Now</h2><p class='lead text'>Lead</p><ol class='commentlist'><li>I say</li></ol><div id='discussion'>We say</div></article></body>"
    assert html_extraction.extract_text(page).split("\n") == [f"{STORY[0]} more still", "Lead"]


def test_broken_markup():
    assert html_extraction.extract_text(f'<article><p>{STORY[0]}</p><p title="x>hello</p></article>').split("\n") == [STORY[0], "hello"]
    assert html_extraction.extract_text(f"<article><p title='>{STORY[0]}<p>end <b").split("\n") == [STORY[0], "end <b"]


def test_a_very_long_page():
    text = [f"word{i} " * 20 for i in range(20_000)]
    page = f"<article>{''.join(f'<p>{t}</p>' for t in text)}</article>"
    assert html_extraction.extract_text(page) == "\n".join(t.strip() for t in text)


def test_the_curve_is_that_of_its_definition():
    """Surge and dive points by their definition, line for line, on random curves."""
    r = random.Random(9)
    for _ in range(300):
        lines = [("x" * n, n if r.random() < 0.8 else 0, False) for n in (r.choice([0, 1, 5, 30, 90, 200]) + 1 for _ in range(r.randrange(1, 25)))]
        sizes = [n if 2 * n >= len(t) else 0 for t, n, _ in lines]
        curve = [sum(sizes[i : i + 3]) for i in range(len(sizes))]
        surges = [i for i, c in enumerate(curve) if c >= 80]
        inside = lambda i: any(s <= i and all(curve[k] > 0 for k in range(s, i + 1)) for s in surges)  # noqa: B023, E731
        want = [t for i, (t, _, _) in enumerate(lines) if sizes[i] and (inside(i) if surges else True)]
        assert html_extraction.main_span(lines) == want


def test_short_lines_of_an_article_stay():
    page = f"<body><article><h1><a href=x>Eggs</a></h1><p>By me</p><p>May 1</p><p>One</p><p>{STORY[0]}</p><p>End</p></article><p>us</p></body>"
    assert html_extraction.extract_text(page).split("\n") == ["Eggs", "By me", "May 1", "One", STORY[0], "End"]


# ---- mixing


def test_targets_are_met_to_the_word(spark):
    r = random.Random(1)
    rows = [(i, words(i, r.choice([1, 5, 60, 300])), r.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "x y", "d"), (1002, "x y", "d")]
    table = docs(spark, rows)
    drawn = mixing.draws(table, shards=5, blocks_per_shard=7)
    got = drawn.withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")).collect()
    assert len(got) == len(rows) and all(x.taken <= 2 * x["size"] for x in got)
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, sum(d.words for d in x.draws)) for x in mixing.draws(table, shards=5, blocks_per_shard=7).collect())
    mixed = mixing.mix(table, shards=5, blocks_per_shard=7).collect()
    assert sum(x["words"] for x in mixed) == sum(x.taken for x in got) and all(len(x.text.split()) == x["words"] for x in mixed)


def test_mix_of_nothing(spark):
    assert mixing.draws(docs(spark, []).limit(0)).count() == 0


PLAN_NAMES = "weight passes cut quota shift n_blocks shard_of parts pass shard words d at_block rest ordinal places rank target source_size length offset".split()


def test_mixing_and_packing_with_clashing_columns(spark):
    rows = [(i, words(i, 1 + i % 40), "ab"[i % 2]) for i in range(60)]
    plain = docs(spark, rows)
    table = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in PLAN_NAMES))
    taken = F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)").alias("taken")
    pairs = [sorted(map(tuple, mixing.draws(t, shards=3).select("doc_id", taken).collect())) for t in (plain, table)]
    assert pairs[0] == pairs[1]
    mixed = mixing.mix(table, shards=3).collect()
    assert all(r["weight"] == "own weight" and r["size"] == "extra" and r["target"] == "own target" for r in mixed) and len(mixed) >= len(rows)
    pieces = packing.pieces(table, tokenizer()).select("*", *(F.lit(1).alias(c) for c in ("places", "rank", "p", "sequence")))
    packed = packing.pack(pieces, ["doc_id", "piece"])
    assert packed.filter("places = 1").count() == len(rows) and packed.select("sequence_id", "offset").distinct().count() == len(rows)


def test_large_shards_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    monkeypatch.setattr(mixing, "MAX_SHARDS", 4)
    monkeypatch.setattr(mixing, "LEAST_SHARDS", 2)
    table = docs(spark, [(i, words(i, 20), "a") for i in range(200)])
    plan = mixing.plan_mix(table).first()
    mixed = mixing.mix(table).collect()
    assert plan["parts"] == 15 and {r.shard for r in mixed} == {0, 1, 2, 3} and sum(r["words"] for r in mixed) == 6000


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 31)], "ordinal long, quota long")
    got = mixing.split_quotas(quotas, 6).groupBy("ordinal").agg(F.sum("quota").alias("q"), F.min("quota").alias("least")).collect()
    assert {r.ordinal: r.q for r in got} == {0: 100, 1: 7, 2: 0, 3: 31} and all(r.least >= 0 for r in got)


# ---- packing


def test_ids_equal_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    model, encoder = Tokenizer.from_file(tokenizer()), packing.WordEncoder(tokenizer())
    for text in ["", "a", "Hello world, don't", "  two  spaces ", "tab\t x\n\ny z", "é  ü", "<|endoftext|> a b", "x" * 500 + " y", "日本 語 12 34a"]:
        assert encoder.encode(text) == array("I", model.encode(text, add_special_tokens=False).ids).tobytes()


def test_every_piece_has_its_own_place(spark):
    rows = [(i, words(i, 1 + i * 7 % 900), "a") for i in range(120)] + [(500, None, "a"), (501, "", "a"), (7, "same", "a"), (7, "same", "a"), (502, words(9, 3000), "a")]
    pieces = packing.pieces(docs(spark, rows), tokenizer()).withColumn("crc", F.crc32("ids"))
    packed = packing.pack(pieces, ["doc_id", "piece"]).toPandas().sort_values(["sequence_id", "offset"])
    ends = packed.groupby("sequence_id").length.cumsum() - packed.length
    assert (ends == packed.offset).all() and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 2048) + 1
    assert all(zlib.crc32(bytes(r.ids)) == r.crc and len(r.ids) == 4 * r.length for r in packed.itertuples())
    long = packed[packed.doc_id == 502].sort_values("piece")
    assert (long.length[1:] == 2048).all() and list(long.start) == [0, *np.cumsum(long.length)[:-1]]
    assert packing.pack(pieces.limit(0), ["doc_id", "piece"]).count() == 0


def test_exact_complements_fill_sequences():
    patterns = packing.plan_patterns({60: 10, 40: 6, 25: 4, 15: 4, 30: 3, 5: 1}, 100)
    used: dict = {}
    for lengths, times in patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == {60: 10, 40: 6, 25: 4, 15: 4, 30: 3, 5: 1}
    assert sum(t for lengths, t in patterns if sum(lengths) == 100) >= 10


# ---- toxicity


def patterns(grammar, text):
    return [[(toxicity.PATTERNS[p], w) for p, w in clause] for clause in grammar.matched(text)]


def test_patterns_of_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "lowei*": 4.0})
    assert patterns(g, "you are an idiot") == [[("aimed", 5.0)]] == patterns(g, "an idiot is what they are")
    assert patterns(g, "an idiot is what all of it ever was, you") == [[("plain", 5.0)]]
    assert patterns(g, "not an idiot. fine") == [[("negated", 5.0)]]
    assert patterns(g, 'he said "what an idiot" then. idiot') == [[("reported", 5.0)], [("plain", 5.0)]]
    assert patterns(g, "das loweichen da") == [[("plain", 4.0)]] and g.matched(None) == g.matched("") == []
    assert patterns(g, "i will kill you") == [[("threat", 4.0)]] and patterns(g, "i will not kill you") == [[("threat off", 4.0)]]
    assert patterns(g, "to kill time") == []
    assert len(patterns(g, "you idiot! " * 20_000)) == 20_000


def test_negated_and_reported_clauses_score_below_aimed_ones():
    r = np.random.default_rng(1)
    sums = r.exponential(5, (400, 6)) * (r.random((400, 6)) < 0.3)
    for toxic in ((sums[:, 2] > 0), (sums.sum(1) > 4), (sums[:, 0] > 0)):
        factors, weights = toxicity._fitted(sums, toxic.astype(float))
        g = toxicity.Grammar({"idiot": 5.0}, factors, weights)
        aimed, plain, negated, reported = (g.score(g.features(t)) for t in ("you idiot", "what an idiot", "no idiot", "he said you idiot"))
        assert aimed > plain > max(negated, reported) and all(f in v for f, v in zip(factors, toxicity.FACTORS, strict=True))


def brute_patterns(clause):
    """All that each insult or threat may be by the words around it."""
    near = lambda i, kind, reach: any(k == kind for k, _ in clause[max(0, i - reach) : i])
    for i, (kind, weight) in enumerate(clause):
        off, said = near(i, toxicity.NEGATION, 3), any(k == toxicity.REPORT for k, _ in clause[:i])
        target = near(i, toxicity.TARGET, 4) or any(k == toxicity.TARGET for k, _ in clause[i + 1 : i + 5])
        if kind == toxicity.INSULT:
            yield (2 if off else 3 if said else 1 if target else 0), weight
        elif kind == toxicity.THREAT and near(i, toxicity.MODAL, 4) and target:
            yield (5 if off or said else 4), weight


def test_best_paths_equal_brute_force():
    r = random.Random(4)
    machine = toxicity.machine(False)
    for _ in range(3000):
        kinds = [r.choice([0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6]) for _ in range(r.randrange(14))]
        clause = [(k, {5: 4.0, 6: 3.0}.get(k, 0.0)) for k in kinds]
        assert machine.best_path(clause) == list(brute_patterns(clause))


def test_labels_are_learned_and_held_out(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = r.random() < 0.3
        text = words(i, 30).split()
        if bad:
            text.insert(5, r.choice(["scumbag", "vile", "vermin"]))
        rows.append((i, " ".join(text), "a"))
        labels.append((i, int(bad)))
    table, marks = docs(spark, [*rows, (9000, None, "a"), (9001, "", "a")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(table, toxicity.fit(table, marks)).withColumn("held", toxicity.held_out()).collect()
    truth = dict(labels)
    held = [x for x in got if x.held and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in held) > 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got) and all(x.predicted == 0 for x in got if x.doc_id >= 9000)
    assert toxicity.fit(table, marks.limit(0)).lexicon == {} and toxicity.score(table.limit(0), toxicity.Grammar()).count() == 0


# ---- archives


def test_archives_round_trip(spark):
    tricky = "x" * 990 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é"
    rows = [(1, "http://a", tricky), (2, "http://b\r\nX: y", tricky), (3, None, None), (4, "c", "small"), (5, "c", "small"), (9, "d", tricky), (9, "d", tricky)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    for compression in ("none", "gzip"):
        path = new_path(spark, "test")
        warc.write_archives(pages, path, compression=compression)
        got = warc.resolve(warc.read_archives(spark, path)).collect()
        assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got)[:2] == [(1, "revisit", 9), (2, "revisit", 9)]
        by_id = {r.page_id: r for r in got}
        assert by_id[1].refers_to == by_id[2].refers_to == 9 and by_id[9].record_type == by_id[4].record_type == "response"
        assert bytes(by_id[2].payload).decode() == tricky and by_id[3].payload_bytes == 0 and len(got) == 7
    path = new_path(spark, "empty")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archives_are_bounded_by_bytes(spark):
    rows = [(i, f"http://{i}", "é" * r) for i, r in enumerate([10, 3_000, 900_000, 20, 3_000, 5_000, 5_000, 40_000])]
    path = new_path(spark, "bounded")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, archive_bytes=30_000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert len(sizes) > 3 and sorted(s > 30_000 for s in sizes)[-3:] == [False, True, True]
    got = {r.page_id: bytes(r.payload).decode() if r.payload is not None else None for r in warc.resolve(warc.read_archives(spark, path)).collect()}
    assert got == {i: t for i, _, t in rows}


def test_gzip_members_are_all_read():
    record = "WARC/1.1\r\nWARC-Record-ID: <urn:page:{0}>\r\nContent-Length: 2\r\n\r\nh{0}\r\n\r\n"
    content = b"".join(gzip.compress(record.format(i).encode()) for i in range(3))
    assert [b for _, b in warc.parse_archive(content)] == [b"h0", b"h1", b"h2"]
    with pytest.raises(ValueError, match="end"):
        list(warc.parse_archive(content[:-9]))


# ---- vectors


def vectors(spark, n, dims=16, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=dims) / 4], 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dims, 1), (n + 2, [None] * dims, 1), (n + 3, [0.0] * dims, 1), (None, [1.0] * dims, 1), (50, rows[50][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), rows


def test_bit_sliced_top_k_is_exact(spark):
    table, rows = vectors(spark, 700)
    got = bit_sliced.top_k(table, block_rows=200, tile_queries=4).collect()
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q in range(0, 700, 50):
        own = next(v for i, v in good if i == q)
        want = sorted(((-int(own @ v), i) for i, v in good if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert bit_sliced.top_k(table.limit(0)).count() == 0


def test_neighbours_are_found(spark):
    table, rows = vectors(spark, 900, seed=3)
    got = additive_quantisation.neighbours(table, every=50, block_rows=400, shortlist=60).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for q in range(0, 900, 50):
        own = next(v for i, v in good if i == q)
        want = {i for _, i in sorted((float(np.linalg.norm(own - v)), i) for i, v in good if i != q)[:10]}
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r.score)] == list(range(1, 11))
        hits, total = hits + len(want & {r.vec_id for r in mine}), total + 10
    assert hits >= 0.9 * total
    assert additive_quantisation.neighbours(table.limit(0)).count() == 0


# ---- licenses


def test_notices_and_their_spans(spark):
    text = "intro words. Released under the MIT License. more\nThis work is licensed under the GNU General Public Licence, version 3. end"
    table = docs(spark, [(1, text, "a"), (2, None, "a"), (3, "", "a"), (4, "the license of the work", "a"), (1, text, "a")])
    got = license_scan.scan(table).collect()
    assert sorted(r.license for r in got) == ["GPL-3.0", "GPL-3.0", "MIT", "MIT"]
    gpl = next(r for r in got if r.license == "GPL-3.0")
    assert text[gpl.start : gpl.stop].startswith("This work") and gpl.matched == 11 and gpl.template_words == 12
    assert license_scan.scan(table.limit(0)).count() == 0


def brute_spans(template, words, least, lo=0):
    """Spans of a template's notices: the best local alignment of all cells, then those left and right of it."""
    top = None
    before = [(0, 0, 0)] * (len(words) + 1)
    for w in template:
        row = [(0, 0, 0)]
        for j, x in enumerate(words):
            s, m, f = before[j] if before[j][0] > 0 else (0, 0, j)
            cell = (s + (2 if x == w else -1), m + (x == w), f)
            for o in (before[j + 1], row[j]):
                if o[0] - 1 > cell[0]:
                    cell = (o[0] - 1, *o[1:])
            row.append(cell)
            if cell[1] >= least and cell[0] > 0 and (top is None or (-cell[0], j) < (-top[0], top[2])):
                top = (cell[0], cell[2], j)
        before = row
    if top is None:
        return []
    return brute_spans(template, words[: top[1]], least, lo) + [(lo + top[1], lo + top[2] + 1)] + brute_spans(template, words[top[2] + 1 :], least, lo + top[2] + 1)


def test_repeated_notices_are_all_found(spark):
    text = " ".join(f"{c}: Released under the MIT License." for c in "abcdefghij") + " Released under a MIT License. Licensed CC BY-SA 4.0."
    got = license_scan.scan(docs(spark, [(1, text, "a")])).orderBy("start").collect()
    assert [r.license for r in got] == ["MIT"] * 11 + ["CC-BY-SA-4.0"]
    assert {text[r.start : r.stop] for r in got[:10]} == {"Released under the MIT License"} and got[10].matched == 4 and got[11].matched == 6


@pytest.mark.parametrize("name", ["MIT", "CC-BY-SA-4.0", "Apache-2.0", "GPL-3.0", "Unlicense", "CC0-1.0"])
def test_notices_equal_brute_force(name):
    index = license_scan.Index({name: license_scan.TEMPLATES[name]})
    template, r = index.words[0], random.Random(name)
    found = 0
    for _ in range(150):
        words = []
        for _ in range(r.choice([1, 2, 5, 9])):
            copy = list(template)
            for _ in range(r.randrange(len(template) // 4 + 2)):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["zz"], [copy[at], "zz"], [copy[at], "zz", "yy"]]) if len(copy) > 1 else copy
            words += copy + ["qq"] * r.choice([0, 0, 1, 3, 12, 60])
        ends = list(np.cumsum([len(w) + 1 for w in words]))
        want = [(0 if a == 0 else int(ends[a - 1]), int(ends[b - 1]) - 1) for a, b in brute_spans(template, words, index.least[0])]
        assert [m[4:] for m in license_scan.matches(" ".join(words), index)] == want
        found += len(want)
    assert found > 150


# ---- language model


@pytest.mark.parametrize(("frequent", "common"), [(1, 1), (60, 30), (2_000_000, 20_000)])
def test_scores_equal_the_formula(spark, frequent, common):
    rows = [(i, words(i, 40, 60) + " very common" * (i % 9), "a") for i in range(50)] + [(90, None, "a"), (91, "  ", "a"), (92, "solo", "a"), (92, "solo", "a"), (93, words(3, 4000, 300), "a"), (None, "w1 w2", "a")]
    texts = [(i, (t or "").split()) for i, t, _ in rows]
    one, two = {}, {}
    for _, ws in texts:
        for k, w in enumerate(ws):
            one[w] = one.get(w, 0) + 1
            if k:
                two[ws[k - 1], w] = two.get((ws[k - 1], w), 0) + 1
    total = sum(one.values())
    found = lm_score.score(docs(spark, rows).withColumnRenamed("size", "n"), frequent=frequent, common=common).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, ws in texts:
        want = sum(np.log(one[w] / total) if not k else np.log(two[ws[k - 1], w] / one[ws[k - 1]]) if two[ws[k - 1], w] >= 2 else np.log(0.4 * one[w] / total) for k, w in enumerate(ws))
        assert got[i].n_words == len(ws) and (got[i].log_score is None if not ws else got[i].log_score == pytest.approx(want))
    if common == 30:
        assert lm_score.score(docs(spark, rows).limit(0)).count() == 0
        named = lm_score.score(docs(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), frequent=frequent, common=common).collect()
        assert sorted(r.log_score for r in named if r.log_score) == pytest.approx(sorted(r.log_score for r in found if r.log_score))


# ---- near duplicates


def brute_groups(rows):
    sets = [set(near_dedup.shingle_set(t).tolist()) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) or rows[i][0] == rows[j][0]:
                a, b = find(i), find(j)
                parent[a] = b
    least = {}
    for i, row in enumerate(rows):
        least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return {row[0]: least[find(i)] for i, row in enumerate(rows)}


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 40)
    r = random.Random(5)
    base = words(1, 120).split()
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9, 12])):
            t[r.randrange(len(t))] = f"x{r.randrange(5000)}"
        rows.append((3 * i + 1, " ".join(t), "a"))
    shared = words(2, 30)
    rows += [(2000 + i, words(100 + i, r.choice([5, 40])) + " " + shared, "a") for i in range(60)]
    rows += [(3000, None, "a"), (3001, "", "a"), (3002, "a b", "a"), (3003, "A b", "a"), (3004, " \n", "a"), (1, rows[0][1], "a")]
    want = brute_groups(rows)
    got = near_dedup.groups(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(x.component_id == want[x.doc_id] for x in got)
    kept = near_dedup.dedupe(docs(spark, rows)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(want.values()))
    assert near_dedup.groups(docs(spark, rows).limit(0)).count() == 0


def test_one_pass_gives_each_place_once(spark):
    rows = spark.createDataFrame([(1, "a b c a b"), (2, None), (3, "x"), (None, "b c"), (5, "a")], "doc_id long, text string")
    number = {w: h for w, h in spark.createDataFrame([(w,) for w in "abcx"], "w string").select("w", lm_score._hash("w")).collect()}
    known = spark.createDataFrame([(number["a"], 0, 3), (number["b"], 1, 3)], "h long, id long, n long")
    bigrams = spark.createDataFrame([((0 << 32) + 1, -0.5)], "pair long, s double")
    got = lm_score.dealt(rows, known, bigrams).collect()
    assert [(r.doc_id, r.s) for r in got if r.s is not None] == [(1, -1.0)]
    c, x = number["c"], number["x"]
    assert {tuple(r)[:3] for r in got if r.s is None} == {(1, 1, c), (1, c, 0), (3, None, x), (None, 1, c)}
    assert len(got) == 5


def test_keys_are_counted_whole_and_in_few_rows():
    rows = [(k, i) for k in (1, 2, 2, 2, 2, 2, 3, 4, 4) for i in range(3)]
    batches = [pa.record_batch([pa.array([k for k, _ in rows[i : i + 2]])], names=["key"]) for i in range(0, len(rows), 2)]
    tables = [t.column("key").to_pylist() for t in lm_score._whole_keys(iter(batches), 4)]
    assert sum(tables, []) == [k for k, _ in rows] and len(tables) > 2
    assert all(not set(a) & set(b) for i, a in enumerate(tables) for b in tables[i + 1 :])


def test_rows_meet_by_one_sort_of_their_key(spark):
    rows = [(1, 5, -7, -7), (1, 5, -7, -7), (2, None, -7, -7), (3, -7, 5, -7), (3, -9, -7, -7), (4, 0, 1, 1)]
    rest = spark.createDataFrame([(d, v, w, None, k) for d, v, w, k in rows] + [(5, None, None, -2.5, -7)], "doc_id long, v long, w long, s double, key long")
    known = spark.createDataFrame([(i, 10 + i) for i in range(6)], "id long, n long")
    got = lm_score.settled(rest.coalesce(1).sortWithinPartitions("key"), known, 100, 2, 0.4).collect()
    backed = np.log(0.4 / 100)
    want = [(1, None, np.log(2 / 15)), (1, None, np.log(2 / 15)), (2, None, np.log(4 / 100)), (3, None, backed + np.log(15)), (3, None, backed + np.log(4)), (4, None, backed + np.log(11)), (5, None, -2.5)]
    assert sorted((r.doc_id, r.need, round(r.s, 9)) for r in got) == sorted((d, n, round(s, 9)) for d, n, s in want)
