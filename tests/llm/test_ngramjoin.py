"""The similarity join against all pairs, and DivideSkip against plain counting."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolake.llm import neardup, ngramjoin

from .test_operators import components_by_force


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=20), min_size=1, max_size=20), st.sets(st.integers(0, 30), max_size=25), st.integers(1, 12))
def test_divide_skip_counts_right(data, query, least):
    """Members that reach their own need, which differs between them, and their overlaps; long and short lists."""
    q = np.array(sorted(query), np.int64)
    flat = np.array([e for s in data for e in s], np.int64)
    owner = np.repeat(np.arange(len(data)), [len(s) for s in data])
    need = np.array([least + k % 3 for k in range(len(data))])
    who, times = ngramjoin.divide_skip(*ngramjoin.occurrences(q, flat, owner), len(data), need)
    want = {k: len(s & query) for k, s in enumerate(data) if len(s & query) >= need[k]}
    assert dict(zip(who.tolist(), times.tolist(), strict=True)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 20), min_size=1), min_size=1, max_size=12), st.integers(1, 8))
def test_heap_merge_skips_nothing_that_counts(lists, t):
    got = dict(ngramjoin.merged([sorted(v) for v in lists], t))
    assert got == {e: n for e in range(21) if (n := sum(e in v for v in lists)) >= t}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=150), st.sets(st.integers(0, 400), max_size=12), st.sets(st.integers(0, 400), max_size=12), st.sampled_from([60, 80, 85, 100]))
def test_first_elements_of_linked_sets_meet(base, out, more, percent):
    """Linked sets share the wanted number of first elements, whatever their sizes."""
    a, b = sorted(base), sorted((base - out) | more)
    if b and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)):
        first = set(a[: ngramjoin.first_elements(len(a), percent)]) & set(b[: ngramjoin.first_elements(len(b), percent)])
        assert len(first) >= max(ngramjoin.wanted_hits(len(a), percent), ngramjoin.wanted_hits(len(b), percent))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_against_all_pairs(spark, size, percent):
    rng = np.random.default_rng(size)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.choice([4, 12, 60, 200]))))
        for _ in range(14):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "one"), (len(docs) + 3, "ONE"), (len(docs) + 4, docs[0][1])]
    want, sets = components_by_force(docs, size, percent)
    got = ngramjoin.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


def test_a_passage_that_all_share_links_nobody(spark):
    """A hot passage of two thirds of each text, and near copies among them; chains that only pairs of members close."""
    rng = np.random.default_rng(8)
    base = [f"v{k}" for k in range(100)]
    docs = [(k, " ".join(base + [f"own{k}_{j}" for j in range(50)])) for k in range(60)]
    for group in range(6):
        other = base[:20] + [f"g{group}_{k}" for k in range(4)] + base[24:96]
        for _ in range(6):
            copy = list(other)
            copy[int(rng.integers(30, 90))] = f"x{len(docs)}"
            docs.append((len(docs), " ".join(copy)))
    want, _ = components_by_force(docs, 4, 85)
    got = ngramjoin.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 60 < len(set(want.values())) < 90


def test_open_pairs_in_blocks_and_small_indexes(spark, monkeypatch):
    """Members dealt to many tasks, indexes of few elements and small blocks give the same classes."""
    monkeypatch.setattr(neardup, "MEMBERS", 4)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(ngramjoin, "INDEXED", 150)
    rng = np.random.default_rng(3)
    base, docs = [f"v{k}" for k in range(90)], []
    for k in range(70):
        copy = list(base)
        for at in rng.integers(0, 90, int(rng.integers(0, 6))):
            copy[int(at)] = f"y{int(rng.integers(0, 12))}"
        docs.append((k, " ".join(copy)))
    want, _ = components_by_force(docs, 4, 85)
    got = ngramjoin.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values())) < 70


def test_rows_without_an_id_and_further_columns(spark, odd, clashing):
    base = [f"w{k}" for k in range(200)]
    step = lambda k: " ".join([f"x{j}" for j in range(5 * k)] + base[5 * k :])
    docs = [(7, step(0)), (None, step(1)), (None, step(2)), (30, step(3)), (40, "quite another text of its own"), (None, "alone without an id"), (8, None)]
    got = ngramjoin.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(7, 7), (None, 7), (None, 7), (30, 7), (40, 40), (None, None), (8, 8)], key=str)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ngramjoin.classes(clashing)) == key(ngramjoin.op13_ngram_join(spark, odd))
