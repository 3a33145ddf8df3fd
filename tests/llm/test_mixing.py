import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import mixing

SCHEMA = "doc_id long, text string, source string, doc_id_ string, size string"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 300), st.integers(0, 40))
def test_budget_is_met_as_well_as_brute_force(items, budget, reserve):
    sizes, counts = (np.array(x) for x in zip(*items))
    take = mixing.fit_budget(sizes, counts, budget, reserve)
    assert (0 <= take).all() and (take <= counts).all() and int((take * sizes).sum()) <= max(budget, 0)
    reach = {0}
    for s, n in items:
        reach = {r + k * s for r in reach for k in range(n + 1)}
    best = max(r for r in reach if r <= budget)
    if reserve >= budget:  # the programme has the whole budget
        assert int((take * sizes).sum()) == best


def water(sizes, weights):
    """Targets by resharing until none is above."""
    total, cap, share = sum(sizes), [3 * s for s in sizes], [0.0] * len(sizes)
    left, open_ = float(total), list(range(len(sizes)))
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        gain = {i: left * weights[i] / w for i in open_}
        for i in open_:
            share[i] += gain[i]
        left = sum(max(0.0, share[i] - cap[i]) for i in open_)
        for i in list(open_):
            if share[i] >= cap[i]:
                share[i] = float(cap[i])
                open_.remove(i)
    return share


def test_mix(spark):
    rows = [(i, "w " * (i % 7), "b" if i % 9 else "a", None, None) for i in range(400)] + [(1000 + i, None if i % 2 else "x\ty", None, None, None) for i in range(20)] + [(5, "w " * 5, "b", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows) and {r["doc_id"] for r in out} == {r[0] for r in rows}
    by = {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    names = sorted((k for k in by if k is not None)) + [None]
    sizes = [sum(r["size"] for r in by[n]) for n in names]
    want = water(sizes, [5, 2, 1])
    for n, s, t in zip(names, sizes, want):
        assert by[n][0]["source_size"] == s and abs(by[n][0]["target"] - t) < 1e-6 and abs(sum(r["taken"] for r in by[n]) - t) <= 2
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(5, 300), st.floats(0.05, 0.95))
def test_extra_documents_are_of_the_sources_mean_size(seed, n, share):
    """Sizes as skewed as texts' are: what is taken is neither the long documents nor the short ones."""
    rng = np.random.default_rng(seed)
    sizes, counts = np.unique(np.maximum(1, rng.lognormal(5.5, 0.9, n)).astype(int), return_counts=True)
    budget = int(share * (sizes * counts).sum())
    take = mixing.fit_budget(sizes, counts, budget)
    if take.sum() >= 20:
        assert budget - (take * sizes).sum() <= max(3, budget / 500)
        assert 0.75 < (take * sizes).sum() / take.sum() / ((sizes * counts).sum() / n) < 1.35


def test_salts_and_ties_change_no_total(spark):
    rows = [(7, "w w", "a", None, None)] * 50 + [(i, "w w", "a", None, None) for i in range(50)] + [(i, "w " * 9, "b", None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    totals = []
    for salts in (1, 8, 4096):
        out = mixing.mix_sources(docs, salts=salts).collect()
        assert len(out) == len(rows)
        totals.append(sorted((s, sum(r["taken"] for r in out if r["source"] == s)) for s in "ab"))
    assert totals[0] == totals[1] == totals[2]


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
