"""Similarity join on word n-grams by T-occurrence search with DivideSkip.

Two sets that share enough have at least T elements in common, so that of the inverted lists of one's elements
the other occurs in T at least.  DivideSkip puts the L longest lists aside; who occurs in T lists occurs in
T - L of the others.  These are merged by a heap that skips what cannot reach T - L, and what does is
looked up in the long lists by binary search, until it has reached T or not.

The lists of all elements of all documents do not fit a task, so that the same division is made twice:

* Over the whole table the T - l longest lists of each set are put aside, those of its largest hashes first (any
  order that all sets share will do), and a set whose first elements do not occur l times in those of others is
  dropped: few are left of unlike texts, and only the first elements' hashes are shuffled.  Of the others, with all elements
  counted exactly, the T - 1 most frequent ones are put aside, and the lists of the rarest elements
  give the candidates: the members of a list and its hub, the smallest of them, so that candidates
  grow with the members and not with their square.
* In a task a hub asks its members, of whom no more than MEMBERS are dealt to one task, by DivideSkip over their inverted lists.
  Pairs of members that their hubs leave open ask each other in the same way by what they differ in
  from their hub; see neardup, which prunes and deals them and makes components of all links.

Every pair is found; nothing is left to chance.

Defined results are those of neardup: exact copies are one node; a null text or one without words has an empty
set, stays alone; a text shorter than an n-gram has one, the whole; rows without doc_id take part; a component's id is
its smallest doc_id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, text_buffers
from .neardup import _signed, id_bitmap, joined, keeper, prepared_nodes, set_prints, sets_of, shingle_sets, with_hubs
from .neardup import _bits as bits_of

#: Weight of a long list's length against a heap's step in the choice of L.
MU = 0.0085
#: Elements of members' sets that one index in a task holds, at most (a set at least).
INDEXED = 1 << 20


def least_overlap(n, percent: int):
    """Elements that a set of n shares with any set it is linked with, at least."""
    return -(-n * percent // 100)


def first_elements(n: int, percent: int) -> int:
    """Number of first elements, in one order of all sets, of which linked sets share wanted_hits() at least."""
    need = least_overlap(n, percent)
    return min(n, n - need + max(n - need, 1))


def wanted_hits(n, percent: int):
    """Shared first elements of a set of n and the smallest one it can be linked with: the least of both surpluses."""
    smallest = least_overlap(n, percent)
    return np.maximum(smallest - least_overlap(smallest, percent), 1)


def merged(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """(value, occurrences) of what occurs in t of the sorted lists at least, by a heap that skips."""
    heap = [(v[0], k, 0) for k, v in enumerate(lists)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= t:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= t:
            out.append((value, len(popped)))
            target = value + 1
        else:
            # whatever lies before the t-th smallest head occurs in fewer than t lists
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return out
            target = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return out


def divide_skip(element: np.ndarray, owner: np.ndarray, m: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, overlaps) of the members 0 to m - 1 that occur in enough of a query's inverted lists.

    element and owner: a query's elements, by number, and the members that have them, sorted by both;
    need: the overlap each member needs, 1 or more.
    """
    t = max(int(need.min()), 1)
    begin = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1]))) if len(element) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(element)))
    if len(begin) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = np.argsort(-length, kind="stable")
    n_long = min(int(t / (MU * math.log2(length.max() + 1) + 1)), t - 1)
    long, short = longest[:n_long], longest[n_long:]
    flat = owner.tolist()
    found = merged([flat[begin[k] : begin[k] + length[k]] for k in short.tolist()], t - n_long)
    who, times = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    if n_long and len(who):
        # all long lists in one sorted array: a list's number and a member make a key
        number = np.repeat(np.arange(n_long), length[long])
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(begin[long].tolist(), length[long].tolist(), strict=True)])
        keys = number * m + owner[at]
        probes = (np.arange(n_long)[:, None] * m + who[None, :]).ravel()
        place = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
        times = times + (keys[place] == probes).reshape(n_long, -1).sum(0)
    enough = times >= need[who]
    return who[enough], times[enough]


def occurrences(query: np.ndarray, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverted lists of a sorted query over members' elements: numbers of its elements and owners, sorted by both."""
    place = np.searchsorted(query, flat)
    hit = np.flatnonzero(query[np.minimum(place, len(query) - 1)] == flat) if len(query) else np.zeros(0, np.int64)
    order = np.lexsort((owner[hit], place[hit]))
    return place[hit][order], owner[hit][order]


def pair_need(n_query, n, percent: int):
    """Elements that sets of these sizes share if they are linked, at least."""
    return -(-(n_query + n) * percent // (100 + percent))


def open_links(node, n, size, x, component, query, data, percent: int) -> list[tuple[int, int]]:
    """Links between queries and data among members of one hub, enough to connect what is linked; close_pairs by T-occurrence search.

    With d = size_u + size_v - 2 o, where o is what both differences from the hub share, a pair is linked where
    100 (nu + nv - d) >= percent (nu + nv + d): o has a least value for each pair.
    """
    root, out = {}, []

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    flat = np.concatenate([*(x[k] for k in data), np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(data)), [len(x[k]) for k in data])
    for q in query.tolist():
        # 2 (100 + percent) o >= (100 + percent) (size_u + size_v) - (100 - percent) (n_u + n_v)
        least = (100 + percent) * (size[q] + size[data]) - (100 - percent) * (n[q] + n[data])
        need = np.maximum(-(-least // (2 * (100 + percent))), 0)
        apart = component[data] != component[q]
        if not apart.any():
            continue
        free = np.flatnonzero(apart & (need == 0))
        who, _ = divide_skip(*occurrences(np.sort(x[q]), flat, owner), len(data), np.where(apart, np.maximum(need, 1), len(x[q]) + 1))
        for k in [*who.tolist(), *free.tolist()]:
            a, b = find(int(component[q])), find(int(component[data[k]]))
            if a != b:
                root[a] = b
                out.append((int(node[q]), int(node[data[k]])))
    return out


def _ask_hubs(percent: int):
    """Over rows (hub, part, node, v) sorted by hub and part, the hub's own first: members found, and their differences from the hub."""

    def run(batches):
        import pyarrow as pa

        names = ["hub", "node", "n_node", "n_hub", "linked", "x"]

        def asked(hub, h, members):
            v = [m[1] for m in members]
            n = np.array([len(a) for a in v], np.int64)
            need = pair_need(len(h), n, percent)
            lists = occurrences(h, np.concatenate(v), np.repeat(np.arange(len(v)), n))
            found = np.zeros(len(v), bool)
            found[divide_skip(*lists, len(v), need)[0]] = True
            x = [np.setxor1d(h, a, assume_unique=True) for a in v]
            ends = np.concatenate(([0], np.cumsum([len(a) for a in x]))).astype(np.int32)
            arrays = [pa.array(np.full(len(v), hub)), pa.array([m[0] for m in members], pa.int64()), pa.array(n), pa.array(np.full(len(v), len(h)))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(found), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x)))], names=names)

        hub, part, h, members, held = None, None, None, [], 0
        for batch in batches:
            lists = batch.column(3)
            off, flat = np.array(lists.offsets), np.array(lists.values)
            for k, (a, b, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                v = np.sort(flat[off[k] : off[k + 1]])
                if (a, b) != (hub, part) or held + len(v) > INDEXED:
                    if members:
                        yield asked(hub, h, members)
                    members, held = [], 0
                if (a, b) != (hub, part):
                    hub, part, h = a, b, v  # its own row is the first
                else:
                    members.append((node, v))
                    held += len(v)
        if members:
            yield asked(hub, h, members)

    return run


def asked_by_hubs(own: DataFrame, of_hub: DataFrame, percent: int) -> DataFrame:
    """neardup's differences(), with the links that DivideSkip finds."""
    first = of_hub.select("hub", "part", F.col("hub").alias("node"), F.col("h").alias("v"), F.lit(0).alias("_rank"))
    rows = own.withColumn("_rank", F.lit(1)).unionByName(first).repartition("hub", "part").sortWithinPartitions("hub", "part", "_rank")
    return rows.select("hub", "part", "node", "v").mapInArrow(_ask_hubs(percent), "hub long, node long, n_node long, n_hub long, linked boolean, x array<long>")


def _prepare(size: int, percent: int):
    """doc_id, n_shingles, the set's prints and its first elements of each text."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(*text_buffers(batch.column(1)), size)
                prints = np.array([set_prints(s) for s in sets], np.uint64).reshape(-1, 2)
                some = [s[: first_elements(len(s), percent)] for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in some]))).astype(np.int32)
                flat = pa.array(_signed(np.concatenate([*some, np.zeros(0, np.uint64)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(_signed(prints[:, k].copy())) for k in (0, 1)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "n_shingles", "print1", "print2", "some"])

    return run


def _repeated(bitmap):
    """Of rows (node, some) the pairs (node, e) whose e may be in the bitmap."""

    def run(batches):
        import pyarrow as pa

        bits = bitmap.value
        for batch in batches:
            lists = batch.column(1)
            node = np.repeat(np.array(batch.column(0)), np.diff(np.array(lists.offsets)))
            e = np.array(lists.flatten())
            at, mask = bits_of(e, len(bits))
            ok = (bits[at.astype(np.int64)] & mask) != 0
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(e[ok])], names=["node", "e"])

    return run


def left_over(nodes: DataFrame, percent: int, keep) -> DataFrame:
    """Nodes (node, n, least_id) whose first elements occur often enough among those of others."""
    spark = nodes.sparkSession
    again = keep(nodes.select(F.explode("some").alias("e")).groupBy("e").count().where("count > 1").select("e"), "join-repeated")
    bitmap = spark.sparkContext.broadcast(id_bitmap(again, "e"))
    pairs = nodes.select("node", "some").mapInArrow(_repeated(bitmap), "node long, e long")
    hits = pairs.join(again, "e", "left_semi").groupBy("node").agg(F.count("*").alias("_hits"))
    smallest = F.ceil(F.col("n") * percent / 100)
    wanted = F.greatest(smallest - F.ceil(smallest * percent / 100), F.lit(1))
    return keep(nodes.select("node", "n", "least_id").join(hits, "node").where(F.col("_hits") >= wanted).drop("_hits"), "join-left-over")


def rare_lists(sets: DataFrame, percent: int, keep) -> DataFrame:
    """key and node: each set's rarest elements, without those that no other set has, up to the T - 1 most frequent ones."""
    pairs = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("e"))
    often = pairs.groupBy("e").agg(F.count("*").alias("often")).where("often > 1")
    known = keep(pairs.join(often, "e"), "join-frequencies")
    # single elements are the rarest and come first
    many = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("_shared"))
    active = known.groupBy("node", "n").agg(F.count("*").alias("_shared")).withColumn("_many", many.cast("int")).where("_many > 0").select("node", "_many")
    each = known.join(active, "node").groupBy("node").agg(F.first("_many").alias("_many"), F.array_sort(F.collect_list(F.struct("often", "e"))).alias("_all"))
    return each.select("node", F.explode(F.slice("_all", F.lit(1), F.col("_many"))).alias("_one")).select("node", F.col("_one.e").alias("key"))


def classes(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of documents (doc_id, text)."""
    keep, used = keeper()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prepared, nodes = prepared_nodes(texts, _prepare(size, percent), "some", keep)
    some = left_over(nodes, percent, keep)
    sets = sets_of(texts, some.select("node", "least_id"), size, keep).join(some.select("node"), "node", "left_semi")
    sets = keep(sets, "join-sets")
    members = keep(with_hubs(rare_lists(sets, percent, keep)), "join-members")
    pairs = keep(members.select("hub", "node").distinct(), "join-stars")
    out = joined(prepared, nodes, members, pairs, sets, percent, keep, used, asked_by_hubs, open_links)
    return out.select("doc_id", "n_shingles", "component_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = {
    "op13_ngram_join": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM steps UNION SELECT r.doc_id, s.y FROM reach r JOIN steps s ON s.x = r.other),
least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, t.doc_id) AS component_id
FROM documents t LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
""",
}
