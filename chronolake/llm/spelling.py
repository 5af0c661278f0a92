"""Groups of spelling variants by forward and reversed dictionaries.

Words are counted over all texts; the dictionary holds those that are long and frequent enough.  Two words, the
shorter of m code points, that one edit takes into each other have a common prefix and a common suffix of
m - 1 code points together at least, so that one of them has half of that.  A forward
dictionary brings words of a common first half together, a reversed one those of a common last half.
Each is sorted by its halves and scanned in ranges of one half, which are blocks.  In a block only the
rest of the words can differ, by one edit again, so that a block of more than BLOCK words is subdivided
by the halves of the rest, and so on, until the blocks are small or one free code point is left, whose
values bound the block.  Words of a block are verified on their code points in numpy; a pair is taken in the
one block that its common prefix leads to, so that none is found twice.

Roots follow forms by pointer doubling: a form has twice the count of its word at least, so that a chain is as
long as the logarithm of the largest count.

Defined results: a null text has no words; a null doc_id counts as empty text in the damage's hash; equal rows
count each; a table without frequent words gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, removed, small_batches, table, written
from .convrepair import CRC_TABLE, crc_sql

#: Code points and occurrences of a word, at least.
LENGTH, COUNT = 5, 3
#: Words of a block that are compared as they are.
BLOCK = 128
#: A form has so many times the count of its word, at least.
TIMES = 2
#: Counts that a task holds before it hands them on, and bytes compared at once.
HELD, COMPARED = 200_000, 1 << 23
#: Latin-1 bytes of runs, lower-cased; what is no letter becomes a blank.
_LETTERS = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 0xC0 else 32 for k in range(256))


def _damaged(run: bytes, h: int) -> bytes:
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _runs(text: str):
    """Lists of the runs of letters of a text, lower-cased; long texts are cut between runs."""
    data, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            cut = data.rfind(b" ", at, at + PIECE)
            cut = data.find(b" ", at + PIECE) if cut < 0 else cut
            end = cut + 1 if cut >= 0 else end
        yield data[at:end].split()
        at = end


def _counts(modulus: int | None):
    """Over (doc_id, text): words and how often they occur, summed for many texts at once.

    Letters are all in Latin-1, where a code point is a byte; others become "?", which separates.
    """

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()

        def batch():
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for given in batches:
            for doc, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                here: Counter = Counter()
                for runs in _runs(text or ""):
                    here.update(runs)
                if modulus and here:
                    begin = zlib.crc32(("" if doc is None else doc).encode() + b":")
                    runs = list(here)
                    hashes = [zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), begin) for r in runs]
                    hit = [(runs[k], hashes[k], here.pop(runs[k])) for k in np.flatnonzero(np.array(hashes, np.int64) % modulus == 0)]
                    for r, h, n in hit:
                        here[_damaged(r, h)] += n
                total.update(here)
                if len(total) > HELD:
                    yield batch()
                    total.clear()
        yield batch()

    return run


def dictionary(docs: DataFrame, *, damage: int | None = None) -> DataFrame:
    """word and n: the words of all texts that are long and frequent enough.

    damage: where it divides the crc32 of doc_id:run, the run loses one code point, as the query wants it.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counts(damage), "word string, n long")
    return found.where(F.length("word") >= LENGTH).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


BLOCK_KEY = ["m", "path", "left", "right"]


def _split(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, head, tail, path) in the two blocks that a half of the rest leads to.

    head and tail: code points that are intact at both ends; path: the halves taken, > for a prefix and < for a suffix.
    """
    half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    steps = [(F.col("head") + half, F.col("tail"), ">"), (F.col("head"), F.col("tail") + half, "<")]
    to = F.explode(F.array(*(F.struct(h.alias("head"), t.alias("tail"), F.concat("path", F.lit(p)).alias("path")) for h, t, p in steps)))
    out = rows.select("word", "n", "m", to.alias("_to")).select("word", "n", "m", "_to.*")
    left, right = F.substring("word", F.lit(1), F.col("head")), F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail"))
    return out.withColumn("left", left).withColumn("right", right)


def near(x: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows of code points, x of length m and y of m or (its last is not 0) m + 1, are one edit apart; their common prefix."""
    longer = y[:, m] != 0
    prefix = np.logical_and.accumulate(x[:, :m] == y[:, :m], axis=1).sum(1)
    tail = np.where(longer[:, None], y[:, 1:], y[:, :m])
    suffix = np.logical_and.accumulate((x[:, :m] == tail)[:, ::-1], axis=1).sum(1)
    return np.where(longer, prefix + suffix >= m, prefix + suffix == m - 1), prefix


def followed(m: int, path: str, prefix: np.ndarray) -> np.ndarray:
    """Whether common prefixes lead along a path: the prefix half wherever it is intact."""
    head = tail = 0
    out = np.ones(len(prefix), bool)
    for step in path:
        half = (m - head - tail) // 2
        fits = prefix >= head + half
        out &= fits if step == ">" else ~fits
        head, tail = (head + half, tail) if step == ">" else (head, tail + half)
    return out


def block_pairs(words: list[bytes], sizes: list[int], m: int, path: str):
    """Arrays of positions of words one edit apart, in blocks of the given sizes that lie one after another."""
    code = np.array(words, f"S{m + 1}").view(np.uint8).reshape(len(words), m + 1)
    size = np.repeat(sizes, sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    short = np.flatnonzero(code[:, m] == 0)
    at = 0
    while at < len(short):
        stop = at + max(int(np.searchsorted(np.cumsum(size[short[at:]]), COMPARED // (m + 1), "right")), 1)
        some = short[at:stop]
        i = np.repeat(some, size[some])
        j = np.repeat(begin[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(len(i))
        once = (code[j, m] != 0) | (i < j)
        i, j = i[once], j[once]
        ok, prefix = near(code[i], code[j], m)
        ok &= followed(m, path, prefix)
        yield i[ok], j[ok]
        at = stop


def _verify(batches):
    """Over rows sorted by block: pairs (word, n, other, n_other) one edit apart, both ways round."""
    import pyarrow as pa

    words, counts, sizes, kind, block, work = [], [], [], None, None, 0

    def compared():
        word, n = pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(counts, pa.int64())
        for i, j in block_pairs(words, sizes, *kind):
            a, b = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
            yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["word", "n", "other", "n_other"])

    for given in batches:
        for word, n, *here in zip(*(given.column(c).to_pylist() for c in ("word", "n", *BLOCK_KEY)), strict=True):
            if here != block:
                if kind is not None and (here[:2] != kind or work > COMPARED):
                    yield from compared()
                    words, counts, sizes, work = [], [], [], 0
                kind, block = here[:2], here
                sizes.append(0)
            words.append(word.encode("latin-1"))
            counts.append(n)
            sizes[-1] += 1
            work += sizes[-1] * (kind[0] + 1) * 2
    if kind is not None:
        yield from compared()


def near_pairs(words: DataFrame) -> tuple[DataFrame, list[str]]:
    """word, n, other, n_other: all pairs of distinct Latin-1 words one edit apart, both ways round; and the tables it reads."""
    used, ready, size = [], None, F.length("word")
    rows = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= LENGTH)).alias("m"))
    rows = rows.select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit("").alias("path"))
    while ready is None or not rows.isEmpty():
        split = _split(rows)
        # blocks of one word, or without a word of the shorter length, hold no pair
        sizes = split.groupBy(*BLOCK_KEY).agg(F.count("*").alias("_size"), F.count_if(size == F.col("m")).alias("_short")).where("_size > 1 AND _short > 0").drop("_short")
        sized, path = written(split.join(sizes, BLOCK_KEY), "spelling-blocks")
        used.append(path)
        large = (F.col("_size") > BLOCK) & (F.col("m") - F.col("head") - F.col("tail") > 1)
        small = sized.where(~large).select("word", "n", *BLOCK_KEY)
        ready = small if ready is None else ready.unionByName(small)
        rows = sized.where(large).select("word", "n", "m", "head", "tail", "path")
    blocks = ready.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    return blocks.mapInArrow(_verify, "word string, n long, other string, n_other long"), used


def roots(forms: DataFrame) -> tuple[DataFrame, list[str]]:
    """word and root of all words that have a form (word, form), by pointer doubling; and the tables it reads."""
    used = []
    hook, path = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        used.append(path)
        on = hook.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        further = hook.join(on, F.col("root") == F.col("_from"), "left")
        further, path = written(further.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "spelling-roots")
        hook = further.select("word", "root")
        if further.where("moved").isEmpty():
            return hook, [*used, path]


def grouped(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of a dictionary (word, n)."""
    spark = words.sparkSession
    words, path = written(words, "spelling-words")
    pairs, used = near_pairs(words)
    used.append(path)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("form"))).alias("_best"))
    best = best.select(F.col("word").alias("_of"), "n_near", F.col("_best.form").alias("form"), (-F.col("_best.n")).alias("form_n"))
    enough = F.col("form_n") >= TIMES * F.col("n")
    judged = words.join(best, F.col("word") == F.col("_of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    judged, _ = written(judged, "spelling-forms")
    root, more = roots(judged.where("form IS NOT NULL"))
    removed(spark, *used, *more[:-1])
    root = root.withColumnRenamed("word", "_of")
    return judged.join(root, F.col("word") == F.col("_of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: Words lose a code point where this divides the crc32 of their document and run, as the query wants it.
DAMAGE = 97


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(dictionary(table(spark, sf_dir, "documents"), damage=DAMAGE)).select("word", "form", "root", "n", "n_near", "form_n")


SQL = {
    "op12_spelling_variants": rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT d, r, count(*) AS c FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY d, r),
keyed AS (SELECT d || ':' || r AS k, r, c FROM runs),
hashed AS (SELECT r, c, {crc_sql("k")} AS h FROM keyed, crc_table),
damaged AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged GROUP BY word HAVING length(word) >= {LENGTH} AND sum(c) >= {COUNT}),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS n_other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON b.rest = a.word
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON b.rest = a.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n_other DESC, other) AS place FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= {TIMES} * w.n THEN other END AS form, CASE WHEN n_other >= {TIMES} * w.n THEN n_other END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
walk AS (SELECT word, word AS here, 0 AS step FROM forms UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN forms f ON f.word = k.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ends e ON e.word = f.word
""",
}
