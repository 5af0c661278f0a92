"""Spelling variants against all pairs of words, with blocks of any size."""

import random
import re
import zlib
from collections import Counter

import pytest

from chronolake.llm import spelling

from .conftest import DOCS


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_force(count):
    """word -> (n, n_near, form, form_n, root)."""
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root(w)) for w in count}


def rows(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3, 128])
def test_against_all_pairs(spark, monkeypatch, block):
    """Few letters, so that blocks are large, edits lie everywhere and pairs share several halves."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "COMPARED", 500 if block == 3 else 1 << 23)
    rng, count = random.Random(3), {}
    for size in [5] * 120 + [6] * 120 + [7] * 60 + [11] * 30 + [12] * 30:
        count["".join(rng.choice("abé") for _ in range(size))] = rng.choice([3, 3, 4, 6, 9, 20, 50])
    for w in list(count)[-40:]:
        at = rng.randrange(len(w))
        for v in (w[:at] + w[at + 1 :], w[:at] + "ÿ" + w[at:], w[:at] + "÷" + w[at + 1 :]):
            count.setdefault(v, rng.choice([3, 7, 100]))
    count |= {"x" * 3000: 8, "x" * 3001: 4, "x" * 2999 + "y": 3, "lonelyword": 5}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert rows(spelling.grouped(words)) == by_force(count)


def test_a_hot_half_is_subdivided(spark):
    """All words share their first half: the blocks that are compared stay bounded, and no pair is lost."""
    rng = random.Random(4)
    count = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)): rng.randint(3, 30) for _ in range(1500)}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    pairs, _ = spelling.near_pairs(words)
    made = pairs.collect()
    assert len(made) == len({(r["word"], r["other"]) for r in made}) == sum(v[1] for v in by_force(count).values()) > 100
    _, tables = spelling.near_pairs(words)
    largest = [spark.read.parquet(t).agg({"_size": "max"}).first()[0] for t in tables]
    assert len(tables) > 1 and largest[0] > 1000 and largest[-1] <= spelling.BLOCK


def words_by_force(docs):
    count = Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("piece, held", [(1 << 19, 200_000), (20, 5)])
def test_odd_tables(spark, odd, clashing, monkeypatch, piece, held):
    """Nulls, empty and long texts, repeated rows and ids, letters beyond Latin-1; pieces of any size."""
    monkeypatch.setattr(spelling, "PIECE", piece)
    monkeypatch.setattr(spelling, "HELD", held)
    want = words_by_force(DOCS)
    got = spelling.op12_spelling_variants(spark, odd)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == by_force(want) and "gamma" in want
    assert rows(spelling.grouped(spelling.dictionary(clashing, damage=97))) == by_force(want)


def test_damage(spark):
    """Every 97th run of a document loses a code point; many documents, so that it shows."""
    docs = [(k, "Größe größe WÖRTERā don't variant variants") for k in range(400)]
    want = words_by_force(docs)
    got = rows(spelling.grouped(spelling.dictionary(spark.createDataFrame(docs, "doc_id long, text string"), damage=97)))
    assert got == by_force(want)
    assert rows(spelling.grouped(spelling.dictionary(spark.createDataFrame(docs, "doc_id long, text string")))).keys() == {"größe", "wÖrter", "variant", "variants"}
