"""Alignment of two tokenizers against whole texts tokenized and compared token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from loomgraph.llm import alignment
from loomgraph.llm.queries import piece_model, tokenizer

DOCS = "doc_id long, text string, n_a string, codes string, __row string"


def tokens_of(text):
    """Ids and byte ranges of both tokenizers over a whole text, or none."""
    import sentencepiece

    model = Tokenizer.from_file(tokenizer())
    model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    if not text:
        return None
    a = [(i, bytes(byte_of[c] for c in model.id_to_token(i))) for i in model.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    out = []
    for side in (a, b):
        at, ranges = 0, []
        for i, x in side:
            ranges.append((i, at, at + len(x)))
            at += len(x)
        out.append(ranges)
    return out


def brute(texts):
    links, rows = [], []
    for text in texts:
        found = tokens_of(text)
        if not found:
            links.append([])
            rows.append((0, 0, 0, ""))
            continue
        a, b = found
        links.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ["|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)) for low, high in zip([0, *ends], ends)]
        rows.append((len(a), len(b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(p for own in links for p in set(own))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(*r[:3], len(own), sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), r[3]) for r, own in zip(rows, links)]


def texts():
    r = random.Random(3)
    odd = ["", None, " ", "  two  spaces ", "a", "tab\tand\nline\n\n next", "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score", "naïve ＡＢ é́ 東京 Пример 👩‍👩‍👧 ", " x 　y   z", "e" * 90 + " end", "1234567 8,9.10 don't WE'LL", "\x00 \x07 nul", "x ᠎ y"]
    words = ["the", "nation", "ouéen", "Straße", "token", "isation", "foo_bar", "http://a.b/c?d=e", "...", "€5", "русский", "日本", "ẖ"]
    return odd + [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(25)] + ["the nation"] * 3


def rows_of(spark, df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_is_that_of_whole_texts(spark):
    own = texts()
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(own)], DOCS).repartition(3)
    want = dict(enumerate(brute(own)))
    assert rows_of(spark, alignment.align(docs, tokenizer(), piece_model())) == want
    # few pairs are broadcast, the others go through the shuffle; ties at the border included
    for most in (0, 5, 40):
        assert rows_of(spark, alignment.align(docs, tokenizer(), piece_model(), max_broadcast=most)) == want
    assert alignment.align(docs.limit(0), tokenizer(), piece_model()).count() == 0


def test_rows_that_repeat_and_have_no_id(spark):
    docs = spark.createDataFrame([(1, "one two", "", "", ""), (1, "one two", "", "", ""), (None, "one", "", "", "")], DOCS)
    got = [(r.doc_id, r.n_a, r.n_links, r.count_sum) for r in alignment.align(docs, tokenizer(), piece_model()).collect()]
    assert sorted(got, key=str) == [(1, 2, 2, 5), (1, 2, 2, 5), (None, 1, 1, 3)]


def test_a_very_long_text():
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefghé") for _ in range(r.randrange(1, 9))) for _ in range(60_000))
    aligner = alignment.Aligner(tokenizer(), piece_model())
    ((counts, links, _),) = aligner.texts([text])
    a, b = tokens_of(text)
    assert counts[0] == len(a) and counts[1] == len(b) and counts[2] == len({e for _, _, e in a} & {e for _, _, e in b})
    assert len(links) == counts[0] + counts[1] - counts[2]  # two tilings: every end but a common one adds an overlap


def test_coalesced_groups_and_links():
    order, group, left, right = alignment.coalesce(np.array([3, 4, 9, 12]), np.array([1, 4, 10, 12]))
    assert order.tolist() == [0, 4, 5, 1, 2, 6, 3, 7] and group.tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (3, 3)]
