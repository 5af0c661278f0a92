"""Benchmark decontamination by Wu-Manber search over word blocks.

The test strings are windows of ten consecutive benchmark words.  A block is two neighbouring
words (one where strings have one word).  For each block hash the shift table holds how far the
search may move on; where it says 0 the block ends a test string, the suffix-hash bucket names
the strings to try, and a comparison of the words' bytes confirms each occurrence.  A string that
several items have is searched once.  All texts of a batch are searched side by side, each cut into
stretches of start positions.

Defined results: a null or empty text, or one of separators only, has no words, no hits and no
items; benchmark rows without words or without item_id are skipped; ids that are no whole numbers are taken as texts; repeated
items count once; an empty benchmark marks nothing; an empty table gives an empty result; further columns pass through unless they have
the names of result columns, which are replaced.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import loaded, pieces, removed, shared_value, table, text_buffers, written
from .wordscan import ALNUM, mixed64, words

WINDOW = 10
#: Words of benchmark text in one block of test strings, and blocks that a pass over the documents searches;
#: a block takes some 50 MB on its way.  More blocks take further passes.
BLOCK_WORDS, BLOCKS = 1_000_000, 4
STRETCH = 256
_BITS = 20
RESULT = "n_words long, spans array<struct<first:int,stop:int>>, items array<long>"


def _block_hash(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the size words that start at each position."""
    if size == 1:
        return mixed64(h)
    return mixed64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


class Strings:
    """Different test strings of one length with their items, their shift table and suffix buckets.

    first: words that strings begin with; item: the item of each.
    """

    def __init__(self, length: int, first: np.ndarray, item: np.ndarray, hashes: np.ndarray):
        self.length, self.size = length, min(2, length)
        key = np.zeros(len(first), np.uint64)
        for k in range(length):
            key = mixed64(key + hashes[first + k])
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.items, self.item_at = item, np.append(new, len(item))
        first = first[order[new]]
        blocks = _block_hash(hashes, self.size)
        self.shift = np.full(1 << _BITS, length - self.size + 1, np.uint8)
        for at in range(length - self.size + 1):  # later blocks have smaller shifts and overwrite
            self.shift[self.slot(blocks[first + at])] = length - self.size - at
        suffix = blocks[first + length - self.size]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.first, self.number = suffix[order], first[order], order

    @staticmethod
    def slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - _BITS)).astype(np.int64)

    def ends(self, blocks: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Window starts at which the last block ends a test string; windows start in [begin, stop)."""
        tail = self.length - self.size
        lanes = -(-(stop - begin) // STRETCH)
        owner = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[owner] + nth * STRETCH
        limit = np.minimum(at + STRETCH, stop[owner])
        slots = self.slot(blocks)
        found = []
        while len(at):
            move = self.shift[slots[at + tail]]
            hit = move == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(move, 1)
            going = at < limit
            at, limit = at[going], limit[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Benchmark:
    """A block of benchmark items ready for the search."""

    def __init__(self, items: list[tuple], window: int):
        self.ids = [i for i, _ in items]
        body = np.frombuffer("\n".join(t for _, t in items).encode(), np.uint8)
        sizes = np.array([len(t.encode()) for _, t in items], np.int64)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        offsets = np.append(begin, len(body))
        self.low, self.starts, self.stops, self.hashes, firsts = words(body, offsets, ALNUM)
        by_length: dict[int, list] = {}
        item_of = np.repeat(np.arange(len(items)), np.diff(firsts))
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            if b > a:
                length = min(window, b - a)
                by_length.setdefault(int(length), []).append(np.arange(a, b - length + 1))
        self.strings = [Strings(k, at := np.concatenate(v), item_of[at], self.hashes) for k, v in sorted(by_length.items())]

    def word(self, k: int) -> bytes:
        return self.low[self.starts[k] : self.stops[k]].tobytes()


def search(blocks: list[Benchmark], body: np.ndarray, offsets: np.ndarray):
    """Each text's first word, the (word, words) of confirmed occurrences, and different (text, item) pairs.

    Items are numbered through the blocks.
    """
    low, starts, stops, hashes, firsts = words(body, offsets, ALNUM)
    spans, pairs = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    numbered = np.cumsum([0, *(len(b.ids) for b in blocks)]).tolist()
    for bench, base, s in ((b, k, s) for b, k in zip(blocks, numbered, strict=False) for s in b.strings):
        begin, stop = firsts[:-1], firsts[1:] - s.length + 1
        some = stop > begin
        if not some.any():
            continue
        block = _block_hash(hashes, s.size)
        at = s.ends(block, begin[some], stop[some])
        key = block[at + s.length - s.size]
        lo, hi = np.searchsorted(s.suffix, key, "left"), np.searchsorted(s.suffix, key, "right")
        n = hi - lo
        at = np.repeat(at, n)
        test = np.arange(len(at)) - np.repeat(np.cumsum(n) - n - lo, n)
        for k in range(s.length):
            same = hashes[at + k] == bench.hashes[s.first[test] + k]
            at, test = at[same], test[same]
        sure = [all(low[starts[a + k] : stops[a + k]].tobytes() == bench.word(t + k) for k in range(s.length)) for a, t in zip(at.tolist(), s.first[test].tolist(), strict=True)]
        at, test = at[sure], s.number[test[sure]]
        spans.append(np.stack((at, np.full(len(at), s.length)), 1))
        found = np.unique(np.stack((np.searchsorted(firsts, at, "right") - 1, test), 1), axis=0)
        n = s.item_at[found[:, 1] + 1] - s.item_at[found[:, 1]]
        item = s.items[np.arange(int(n.sum())) + np.repeat(s.item_at[found[:, 1]] - (np.cumsum(n) - n), n)]
        pairs.append(np.stack((np.repeat(found[:, 0], n), item + base), 1))
    return firsts, np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0)


def _scan(shared, text: str, id_type: str):
    """The search of some blocks as a function over record batches; earlier spans and items are kept."""

    def run(batches):
        import pyarrow as pa

        blocks = [loaded(b) for b in shared]
        ids = [i for b in blocks for i in b.ids]
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
        for whole in batches:
            for batch in pieces(whole, text):
                names = batch.schema.names
                firsts, found, pairs = search(blocks, *text_buffers(batch.column(names.index(text))))
                n = batch.num_rows
                spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
                if "_spans" in names:
                    spans = [[(x["first"], x["stop"]) for x in v] for v in batch.column(names.index("_spans")).to_pylist()]
                    items = batch.column(names.index("_items")).to_pylist()
                doc = np.searchsorted(firsts, found[:, 0], "right") - 1
                for d, (at, length) in zip(doc.tolist(), found.tolist(), strict=True):
                    spans[d].append((at - int(firsts[d]), at - int(firsts[d]) + length))
                for d, item in pairs.tolist():
                    items[d].append(ids[item])
                for d in set(pairs[:, 0].tolist()):
                    joined: list = []
                    for a, b in sorted(spans[d]):
                        if joined and a <= joined[-1][1]:
                            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                        else:
                            joined.append((a, b))
                    spans[d], items[d] = joined, sorted(set(items[d]))
                keep = [k for k, x in enumerate(names) if x not in ("_n_words", "_spans", "_items")]
                arrays = [batch.column(k) for k in keep]
                arrays += [pa.array(np.diff(firsts), pa.int64()), pa.array([[{"first": a, "stop": b} for a, b in v] for v in spans], spans_type), pa.array(items, pa.list_(pa.string() if id_type == "string" else pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[names[k] for k in keep] + ["_n_words", "_spans", "_items"])

    return run


def id_type(benchmark: DataFrame) -> str:
    """Ids of items are whole numbers, or else texts."""
    return "long" if isinstance(benchmark.schema["item_id"].dataType, T.IntegralType) else "string"


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW):
    """Blocks of benchmark items, of BLOCK_WORDS words at most (one item at least), one at a time."""
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast(id_type(benchmark)).alias("item_id"), "text").toLocalIterator():
        n = len(row.text) // 2 + 1
        if block and size + n > BLOCK_WORDS:
            yield Benchmark(block, window)
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield Benchmark(block, window)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, text: str) -> DataFrame:
    """docs with _n_words, _spans and _items.

    BLOCKS blocks of test strings are searched at a time; with more, each pass writes its result to
    the shared folder for the next, which is removed when that has read it.
    """
    spark, out, before, blocks = docs.sparkSession, docs, None, benchmark_blocks(benchmark, window)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    schema = ", ".join(fields + ["_n_words long", "_spans array<struct<first:int,stop:int>>", f"_items array<{id_type(benchmark)}>"])
    k = 0
    while some := [shared_value(spark, b) for b in islice(blocks, BLOCKS)]:
        if k:
            out, path = written(out, "decontaminate")
            if before:
                removed(spark, before)
            before = path
        out, k = out.mapInArrow(_scan(some, text, id_type(benchmark)), schema), k + 1
    return out


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with n_words, spans (hit words, as [first, stop) word numbers) and items (ids, sorted)."""
    out = _marked(docs.drop("n_words", "spans", "items"), benchmark, window, text)
    return out.withColumnsRenamed({"_n_words": "n_words", "_spans": "spans", "_items": "items"})


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Rows without any occurrence of a benchmark window, with their columns as they were."""
    return _marked(docs, benchmark, window, text).where(F.size("_items") == 0).select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = marked(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["stop"] - x["first"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = {
    "op5_decontaminate": """
WITH bench AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark WHERE item_id IS NOT NULL)),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
grams AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT g.rid, g.i, g.size, x.item_id FROM grams g JOIN windows x USING (key, size)),
hit_words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
""",
}
