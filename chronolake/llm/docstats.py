"""Statistics of whole texts, computed for many texts at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, pieces, text_buffers
from .wordscan import NONSPACE, Hashed, bounds, mixed64

#: Counts (long) and shares (double) of a text; a share of nothing is 0.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_word", "symbol_share", "upper_share", "shout_share", "bar_share", "repeat_share", "dup_line_share", "same_share", "distinct_share", "digit_share", "stop_share", "line_share"]
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _SHOUT, _BAR, _STOP = (_set(x) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!", b"|", b".,;:?"))
_LETTER = _set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0x100)))
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def _owners(edges: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


def statistics(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each text; words are white-space separated and keep their case."""
    n = len(offsets) - 1
    if len(body) == 0:
        return {c: np.zeros(n, np.int64) for c in COUNTS} | {c: np.zeros(n) for c in SHARES}
    hashed, solid = Hashed(body), NONSPACE[body]
    starts, stops = bounds(solid, offsets)
    first = np.searchsorted(starts, offsets)
    h, owner = hashed.ranges(starts, stops), _owners(first)
    salted = mixed64(h + owner.astype(np.uint64) * _ODD2)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": per_text(solid & ((body & 0xC0) != 0x80), offsets), "n_symbols": per_text(_SYMBOL[body], offsets)}
    # lines: between line feeds and text ends; those with a word count
    begins, ends = bounds(body != 10, offsets)
    some = np.searchsorted(starts, begins) < np.searchsorted(starts, ends)
    begins, ends = begins[some], ends[some]
    line_first = np.searchsorted(begins, offsets)
    lines = np.diff(line_first)
    line = mixed64(hashed.ranges(begins, ends) + _owners(line_first).astype(np.uint64) * _ODD2)
    once = np.unique(line, return_index=True)[1]
    out["n_dup_lines"] = lines - np.bincount(_owners(line_first)[once], minlength=n)
    # words covered by a 3-word window that occurs again in the text
    covered = np.zeros(len(h) + 3, np.int64)
    if len(h) >= 3:
        gram = mixed64(salted[:-2] * _ODD1 + mixed64(salted[1:-1] + _ODD1) + salted[2:] * _ODD2)
        at = np.flatnonzero(owner[:-2] == owner[2:])
        _, inverse, count = np.unique(gram[at], return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        covered[again] += 1
        covered[again + 3] -= 1
    out["n_repeat_words"] = per_text(np.cumsum(covered[:-3]) > 0, first)
    once = np.unique(salted, return_index=True)[1]
    distinct = np.bincount(owner[once], minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = salted[1:] == salted[:-1]
    size, chars = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1)
    letters = np.maximum(per_text(_LETTER[body], offsets), 1)
    shares = {
        "mean_word": out["word_chars"] / size, "symbol_share": out["n_symbols"] / chars, "upper_share": per_text(_UPPER[body], offsets) / letters,
        "shout_share": per_text(_SHOUT[body], offsets) / size, "bar_share": per_text(_BAR[body], offsets) / size,
        "repeat_share": out["n_repeat_words"] / size, "dup_line_share": out["n_dup_lines"] / np.maximum(lines, 1), "same_share": per_text(same, first) / size,
        "distinct_share": distinct / size, "digit_share": per_text(_DIGIT[body], offsets) / chars, "stop_share": per_text(_STOP[body], offsets) / size, "line_share": lines / size,
    }
    return {c: out[c].astype(np.int64) for c in COUNTS} | {c: shares[c].astype(float) for c in SHARES}


def _measure(text: str):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole, text):
                names = batch.schema.names
                got = statistics(*text_buffers(batch.column(names.index(text))))
                keep = [k for k, c in enumerate(names) if c != text]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(v) for v in got.values()], names=[names[k] for k in keep] + list(got))

    return run


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The statistics in place of the text; columns of their names are replaced."""
    docs = docs.drop(*COUNTS, *SHARES)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.mapInArrow(_measure(text), ", ".join([*kept, SCHEMA]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, train, seed: int = 11) -> DataFrame:
    """(doc_id, text, label, weight) of at most limit documents for each of the labels 0 and 1.

    train is a condition on the labels' doc_id.  The documents with the smallest hashes are taken,
    so that the sample is the same in each run; the bound makes it fit a broadcast.  A row's weight
    is the number of labelled documents of its class that it stands for, so that weighted rows
    have the classes' shares of the whole table.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("_id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64(F.lit(seed), "_id"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for k in (0, 1):
        weight = F.lit(max(total.get(k, 0) / max(limit, 1), 1.0))
        part = known.where(F.col("label") == k).orderBy("_h", "_id").limit(limit).withColumn("weight", weight)
        picked = part if picked is None else picked.union(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked.drop("_h")), F.col("doc_id") == F.col("_id")).drop("_id")


def held_out(modulus: int, rest: int):
    return bucket_of("doc_id", modulus) == rest
