"""Budgets over blocks against going through the files one by one."""

import random

import numpy as np
import pytest

from loomgraph.operators import budget as B
from loomgraph.operators import dedupe as D


def one_by_one(costs, budget):
    batch, spent, out = -1, None, []
    for c in costs:
        if c > budget:
            batch, spent = batch + 1, None
        elif spent is not None and spent + c <= budget:
            spent += c
        else:
            batch, spent = batch + 1, c
        out.append(batch)
    return out, (batch, -1 if spent is None else spent)


@pytest.mark.parametrize("seed", range(40))
def test_tables_of_blocks_compose(seed):
    r = random.Random(seed)
    costs = [r.choice([0, 0, 1, 2, 3, 5, 9, 10, 11, 30]) for _ in range(r.randrange(1, 60))]
    state, numbers, at = (-1, -1), [], 0
    while at < len(costs):
        n = r.randrange(1, 12)
        fits = B.Fits(np.array(costs[at : at + n]), 10)
        begins = fits.begins(fits.joined(state[1]))
        numbers += (state[0] + np.searchsorted(np.array(begins, np.int64), np.arange(fits.n), "right")).tolist()
        state = B.next_state(state, fits.table())
        at += n
    assert (numbers, state) == one_by_one(costs, 10)


def test_projects_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    r = random.Random(3)
    rows = [(p, f"f{i:03}", "x" * r.choice([0, 4, 8, 40, 41, 90, 400])) for p, n in ((1, 200), (2, 3), (3, 90)) for i in range(n)]
    r.shuffle(rows)
    files = spark.createDataFrame(rows, "project int, path string, content string")
    got = {(x.project, x.path): x.batch for x in B.batch_by_budget(files, 20).collect()}
    kept = {(x.project, x.path): x.kept for x in B.cap_to_budget(files, 150).collect()}
    for p in (1, 2, 3):
        own = sorted((path, -(-len(c) // 4)) for q, path, c in rows if q == p)
        assert [got[p, path] for path, _ in own] == one_by_one([c for _, c in own], 20)[0]
        spent = 0
        for length, path in sorted((len(c), path) for q, path, c in rows if q == p):
            spent += -(-length // 4)
            assert kept[p, path] == (spent <= 150)
    assert B.batch_by_budget(files.limit(0)).count() == B.cap_to_budget(files.limit(0)).count() == 0


def test_props_of_several_sources(spark):
    rows = [("c", "a", "t1", None, None, "d1", ["x"], True, 1), ("c", "a", "t2", "cat", None, None, [], True, 2), ("c", "a", None, None, "v", None, None, False, 3)]
    df = spark.createDataFrame(rows, "component_key string, name string, type string, category string, default_value string, description string, values array<string>, required boolean, source_rank int")
    merged, replaced = D.merge_props(df).first(), D.merge_props(df, replace=True).first()
    assert (merged.type, merged.category, merged.default_value, merged.description, list(merged["values"]), merged.required) == ("t2", "cat", "v", "d1", ["x"], False)
    assert (replaced.type, replaced.default_value, replaced["values"], replaced.required) == (None, "v", None, False)
