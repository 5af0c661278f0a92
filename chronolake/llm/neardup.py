"""Near-duplicate classes by one-permutation MinHash with optimal densification.

One hash per shingle fills the bins of a signature; empty bins borrow from a non-empty bin that a
fixed random order of each bin selects.  Bands of bins make bucket keys.  In each bucket the
smallest node is the hub, and only its star of edges is a candidate: as many pairs as members.
Each star pair is compared on the full shingle sets, which gives the difference X of a member and
its hub; the members of a large hub are dealt to several tasks.  Exact copies are one node from
the start, named by a 64-bit sum of their shingle hashes.

The links of the stars make components.  Two members u and v of one hub differ by |Xu ^ Xv|
shingles, so the pairs that the star left open are decided from the differences alone.  Only
members outside the component of their hub (far ones) can add a link.  A far member u and a member v are
linked only if Xu and Xv share so many shingles that the rarest few of each, by the number of members
of the hub that have them, have one in common.  Those who meet nobody so drop out, and the rest is
compared in blocks.  A hub whose members differ from it each in their own way, as pages of one
template do, so costs no comparison.

bands() picks the number of bins and bands so that a pair at the threshold misses all buckets
with a probability below 1e-8.

Defined results: a null text, or one without words, has an empty set, stays alone and is kept; a
text with fewer words than a shingle has one shingle, the whole sequence; rows without doc_id take part like
others, and a component's id is the smallest doc_id in it, null if no row has one; a row is kept
if its doc_id equals that, so rows that repeat a doc_id are judged by their own texts; a doc_id that
is no number is null; an empty table gives an empty result; further columns are not read by
classes() and pass through kept_rows(), which keeps one row of each component and all rows without words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, removed, table, text_buffers, written
from .wordscan import NONSPACE, mixed64, words

#: Bins of a signature, at most, and the miss probability allowed at the threshold.
BINS, MISS = 256, 1e-8
#: Members of a hub that are compared with it in one task, and members that are compared as one block.
MEMBERS, BLOCK = 256, 128
#: Hubs whose sizes are broadcast, at most; beyond that they are joined by a shuffle.
FEW = 500_000
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def bands(threshold: float) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands that still find nearly every pair."""
    for rows in range(8, 0, -1):
        if (1 - threshold**rows) ** (BINS // rows) <= MISS:
            return rows, BINS // rows
    raise ValueError("no banding reaches this threshold")


def shingle_sets(body: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    _, _, _, h, first = words(body, offsets, NONSPACE)
    full = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size if len(full) else 0):
        full += h[k : k + len(full)] * np.uint64(_ODD[k])
    full = mixed64(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            short = (h[a:b] * np.array(_ODD[: b - a], np.uint64)).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def borrow_order(bins: int) -> np.ndarray:
    """For every bin the priorities of all bins to borrow from."""
    return mixed64(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(_ODD[0])).reshape(bins, bins)


def signature(sorted_set: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; the leading bits of a hash are its bin."""
    bins = len(order)
    home = ((sorted_set >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
    filled, out = home[first], np.zeros(bins, np.uint64)
    out[filled] = sorted_set[first]
    if len(filled) < bins:
        empty = np.ones(bins, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[filled[order[np.ix_(empty, filled)].argmin(1)]]
    return out


def set_prints(sorted_set: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit sums that name a set."""
    return mixed64(sorted_set).sum(dtype=np.uint64), mixed64(sorted_set ^ np.uint64(_ODD[1])).sum(dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prepare(size: int, rows: int, count: int):
    def run(batches):
        import pyarrow as pa

        order = borrow_order(rows * count)
        odd = np.array(_ODD[:rows], np.uint64)
        band = np.arange(count, dtype=np.uint64) * np.uint64(_ODD[7])
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(*text_buffers(batch.column(1)), size)
                n = np.array([len(s) for s in sets], np.int64)
                prints = np.array([set_prints(s) for s in sets], np.uint64).reshape(-1, 2)
                keys = np.zeros((len(sets), count), np.uint64)
                for k, s in enumerate(sets):
                    if len(s):
                        keys[k] = mixed64((signature(s, order).reshape(count, rows) * odd).sum(1, dtype=np.uint64) + band)
                keys = keys[n > 0]
                ends = np.concatenate(([0], np.cumsum(n > 0) * count)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(_signed(prints[:, 0].copy())), pa.array(_signed(prints[:, 1].copy())), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(keys.ravel())))], names=["doc_id", "n_shingles", "print1", "print2", "keys"])

    return run


def _bits(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of the one bit that each id sets in a bitmap of size 64-bit words."""
    h = mixed64(ids.view(np.uint64) + np.uint64(_ODD[2]))
    return (h >> np.uint64(6)) % np.uint64(size), np.uint64(1) << (h & np.uint64(63))


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap that has the bit of every id set, and few others; 8 MB at most, however many ids.

    Where there are too many ids for it, it lets more of the others through, which costs time only.
    """
    size = 1 << min(max(int(ids.count() * 16).bit_length() - 6, 10), 20)

    def run(batches):
        import pyarrow as pa

        bitmap = np.zeros(size, np.uint64)
        for batch in batches:
            at, mask = _bits(np.array(batch.column(0)), size)
            np.bitwise_or.at(bitmap, at.astype(np.int64), mask)
        at = np.flatnonzero(bitmap)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_signed(bitmap[at]))], names=["at", "mask"])

    parts = ids.select(column).mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size, np.uint64)
    out[np.array(parts.column("at"))] = np.array(parts.column("mask")).view(np.uint64)
    return out


def _sets(size: int, ids, prints):
    """Sets, by node, of the rows whose doc_id and then whose print may be in the bitmaps; a task gives each node once."""

    def run(batches):
        import pyarrow as pa

        id_bits, print_bits, given = ids.value, prints.value, set()
        maybe = lambda v, bits: (lambda at, mask: (bits[at.astype(np.int64)] & mask) != 0)(*_bits(v, len(bits)))
        for whole in batches:
            null = np.array(whole.column(0).is_null())
            whole = whole.filter(pa.array(null | maybe(np.array(whole.column(0).fill_null(0).cast(pa.int64())), id_bits)))
            for batch in pieces(whole, "text"):
                sets = [v for v in shingle_sets(*text_buffers(batch.column(1)), size) if len(v)]
                nodes = _signed(np.array([set_prints(v)[0] for v in sets], np.uint64))
                some = [k for k in np.flatnonzero(maybe(nodes, print_bits)).tolist() if nodes[k] not in given]
                some = list({int(nodes[k]): k for k in some}.values())
                given.update(nodes[some].tolist())
                ends = np.concatenate(([0], np.cumsum([len(sets[k]) for k in some]))).astype(np.int32)
                flat = np.concatenate([*(sets[k] for k in some), np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(flat)))], names=["node", "shingles"])

    return run


def close_pairs(node, n, size, x, component, query, data, percent: int) -> list[tuple[int, int]]:
    """Links between queries and data among members of one hub, enough to connect what is linked.

    n: set sizes; size: of the differences from the hub; x: the part of each difference that other members
    share; component: names of what is connected already; query, data: positions.  With
    d = |Xu ^ Xv| a pair is linked where 100 (nu + nv - d) >= percent (nu + nv + d).
    """
    flat, owner = np.concatenate([*x, np.zeros(0, np.int64)]), np.repeat(np.arange(len(x)), [len(v) for v in x])
    used, column = np.unique(flat, return_inverse=True)
    overlap = np.zeros((len(query), len(data)), np.float32)
    place_q, place_d = np.full(len(x), -1), np.full(len(x), -1)
    place_q[query], place_d[data] = np.arange(len(query)), np.arange(len(data))
    for lo in range(0, len(used), 4096):
        here = (column >= lo) & (column < lo + 4096)
        o, c = owner[here], column[here] - lo
        a, b = np.zeros((len(query), 4096), np.float32), np.zeros((len(data), 4096), np.float32)
        q, d = place_q[o] >= 0, place_d[o] >= 0
        a[place_q[o[q]], c[q]] = 1
        b[place_d[o[d]], c[d]] = 1
        overlap += a @ b.T
    apart = size[query][:, None] + size[data][None, :] - 2 * overlap
    both = n[query][:, None] + n[data][None, :]
    near = (100 * (both - apart) >= percent * (both + apart)) & (component[query][:, None] != component[data][None, :])
    out, root = [], {}

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(int(component[query[i]])), find(int(component[data[j]]))
        if a != b:
            root[a] = b
            out.append((int(node[query[i]]), int(node[data[j]])))
    return out


def _open_pairs(percent: int, search):
    """Over rows sorted by block key: the links that the stars left open, as search (close_pairs or its like) finds them."""

    def links(rows):
        import pyarrow as pa

        lists = rows.column("x").combine_chunks()
        flat, off = np.array(lists.flatten()), np.array(lists.offsets)
        off = off - off[0]
        x = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        asks = np.array(rows.column("asks"))
        node, n, size, component = (np.array(rows.column(c)) for c in ("node", "n", "size", "component"))
        got = search(node, n, size, x, component, np.flatnonzero(asks), np.flatnonzero(~asks), percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            key = np.stack([np.array(held.column(c)) for c in ("hub", "kind", "i", "j")])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for a, b in zip(np.concatenate(([0], edge[:-1])), edge, strict=True) if len(edge) else ():
                yield links(held.slice(a, b - a))
            held = held.slice(edge[-1]) if len(edge) else held
        if held is not None and held.num_rows:
            yield links(held)

    return run


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """node and the smallest node it is connected with, for all nodes of links (a, b).

    Every component hooks to its smallest neighbour, the hooks are followed to their ends, and the
    links are renamed; repeated until no link between components is left.
    """
    spark, paths = links.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        paths.append(path)
        return out

    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = keep(both, "cc-edges")
    label = None
    while not edges.isEmpty():
        hook = keep(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "cc-hooks")
        while True:
            further = hook.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
            jumped = keep(hook.join(further, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("to") != F.col("_to")).alias("moved")), "cc-jumps")
            hook = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = hook
        else:
            onward = hook.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
            label = keep(label.join(onward, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_to", "to").alias("to")), "cc-labels")
        end_a, end_b = (hook.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
        renamed = edges.join(end_a, "a").join(end_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = keep(renamed.where("a <> b").distinct(), "cc-edges")
    if label is None:
        label = spark.createDataFrame([], "node long, to long")
    return label.select("node", F.col("to").alias("component")), paths


def _few(hubs: DataFrame) -> DataFrame:
    """A written table of a row for each of some hubs, to be broadcast if they are few."""
    return F.broadcast(hubs) if hubs.limit(FEW + 1).count() <= FEW else hubs


def _overlap_links(members: DataFrame, stars: DataFrame, label: DataFrame, percent: int, keep, search) -> DataFrame:
    """Links among the members of each bucket that the components of the stars' links do not give.

    Only buckets whose members, the hub aside, lie in several components can have one.  With
    s = (100 - percent) / (100 + percent) and a = |X| - s n of each member, a link of u and v means |Xu & Xv| >=
    (a_u + a_v) / 2, which is above 0 where one of them is far, that is not linked to the hub.  So with the least a of
    those it may meet, each member has a least overlap; and with the shingles in one order the first
    ones of both, all but that overlap less one, have one in common.
    """
    share = F.lit((100 - percent) / (100 + percent))
    named = members.join(label.select("node", F.col("component").alias("_own")), "node", "left").withColumn("_own", F.coalesce("_own", "node"))
    open_ = named.groupBy("key").agg(F.min("_own").alias("_least"), F.max("_own").alias("_most")).where("_least < _most").select("key")
    some = named.join(open_, "key", "left_semi").select("hub", "node", F.col("_own").alias("component")).distinct()
    some = some.join(label.select(F.col("node").alias("hub"), F.col("component").alias("_hub")), "hub", "left")
    some = keep(some.withColumn("far", F.col("component") != F.coalesce("_hub", "hub")).drop("_hub"), "near-open")
    if some.isEmpty():
        return some.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    rows = stars.join(some, ["hub", "node"]).select("hub", "node", F.col("n_node").alias("n"), "n_hub", F.size("x").alias("size"), "x", "component", "far")
    rows = keep(rows, "near-open-rows")
    each = rows.select("hub", "node", F.explode("x").alias("e"))
    often = each.groupBy("hub", "e").agg(F.count("*").alias("often")).where("often > 1")
    common = each.join(often, ["hub", "e"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("often", "e"))).alias("common"))
    rows = keep(rows.drop("x").join(common, ["hub", "node"]).withColumn("_a", F.col("size") - share * F.col("n")).withColumn("x", F.transform("common", lambda c: c["e"])).drop("common"), "near-common")
    far_a, near_a = (F.min(F.when(c, F.col("_a"))) for c in (F.col("far"), ~F.col("far")))
    bounds = keep(rows.groupBy("hub").agg(far_a.alias("_far_a"), near_a.alias("_near_a")), "near-bounds")
    rows = rows.join(_few(bounds), "hub")

    def beginning(other: str):
        """Number of the rarest shared shingles of a member, one of which any partner among the others must share."""
        need = F.ceil((F.col("_a") + F.col(other)) / 2 - F.lit(1e-6)).cast("int")
        many = F.size("x") - need + 1  # unshared ones are the rarest
        return F.greatest(F.least(F.coalesce(many, F.lit(0)), F.size("x")), F.lit(0))

    # kind 0: far members among themselves; kind 1: far members with the others
    far = F.col("far")
    met = rows.withColumns({"_k0": F.when(far, beginning("_far_a")).otherwise(0), "_k1": F.when(far, beginning("_near_a")).otherwise(beginning("_far_a"))})
    met = met.select("hub", "node", "far", "component", "_k0", "_k1", F.posexplode(F.slice("x", F.lit(1), F.greatest("_k0", "_k1"))).alias("_at", "e"))
    met = keep(met.select("hub", "node", "far", "component", "e", (F.col("_at") < F.col("_k0")).alias("_in0"), (F.col("_at") < F.col("_k1")).alias("_in1")), "near-beginnings")
    at = lambda k: F.when(F.col(f"_in{k}"), F.col("component"))
    group = met.groupBy("hub", "e").agg(
        F.min(at(0)).alias("_least0"), F.max(at(0)).alias("_most0"), F.min(at(1)).alias("_least1"), F.max(at(1)).alias("_most1"), F.bool_or(far & F.col("_in1")).alias("_far"), F.bool_or(~far & F.col("_in1")).alias("_near")
    )
    open0, open1 = F.coalesce(F.col("_least0") < F.col("_most0"), F.lit(False)), F.coalesce(F.col("_far") & F.col("_near") & (F.col("_least1") < F.col("_most1")), F.lit(False))
    some = group.select(F.col("hub").alias("_hub"), F.col("e").alias("_e"), open0.alias("_open0"), open1.alias("_open1")).where("_open0 OR _open1")
    kinds = [F.when(F.col(f"_in{k}") & F.col(f"_open{k}"), F.lit(k)) for k in (0, 1)]
    who = met.join(some, (F.col("hub") == F.col("_hub")) & (F.col("e") == F.col("_e")) & (F.col("_in0") & F.col("_open0") | F.col("_in1") & F.col("_open1")))
    who = who.groupBy("hub", "node").agg(*(F.max(k).alias(f"_kind{n}") for n, k in enumerate(kinds))).select("hub", "node", F.explode(F.array_compact(F.array("_kind0", "_kind1"))).alias("kind"))
    rows = keep(rows.drop("_a", "_far_a", "_near_a").join(who, ["hub", "node"]), "near-met")
    size = keep(rows.groupBy("hub", "kind").agg(F.count_if((F.col("kind") == 0) | ~F.col("far")).alias("n_data"), F.count_if("far").alias("n_asks")).where("n_data > 0 AND n_asks > 0"), "near-sizes")
    rows = rows.join(_few(size), ["hub", "kind"])
    n_i, n_j = F.ceil(F.col("n_asks") / BLOCK).cast("int"), F.ceil(F.col("n_data") / BLOCK).cast("int")
    spread = F.xxhash64("node")
    i, j = F.pmod(spread, n_i).cast("int"), F.pmod(spread, n_j).cast("int")
    fields = ["hub", "kind", "node", "n", F.col("size").cast("long").alias("size"), "x", "component"]
    asks = rows.where("far").select(*fields, F.lit(True).alias("asks"), i.alias("i"), F.explode(F.sequence(F.lit(0), n_j - 1)).alias("j"))
    data = rows.where("kind = 0 OR NOT far").select(*fields, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), n_i - 1)).alias("i"), j.alias("j"))
    blocks = asks.unionByName(data).repartition("hub", "kind", "i", "j").sortWithinPartitions("hub", "kind", "i", "j")
    return blocks.mapInArrow(_open_pairs(percent, search), "a long, b long").distinct()


def prepared_nodes(texts: DataFrame, prepare, list_name: str, keep) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, print1, print2, a list) that prepare makes of texts, and a node for each distinct set."""
    prepared, _ = written(texts.mapInArrow(prepare, f"doc_id long, n_shingles long, print1 long, print2 long, {list_name} array<long>"), "near-prints")
    # were two sets to have one print1, that with the smaller print2 would be the node and the other stay alone
    least = F.min(F.struct("print2", F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    nodes = prepared.where("n_shingles > 0").groupBy(F.col("print1").alias("node")).agg(least.alias("least"), F.min_by("n_shingles", "print2").alias("n"), F.min_by(list_name, "print2").alias(list_name))
    return prepared, keep(nodes.select("node", "n", F.col("least.print2").alias("print2"), F.col("least.doc_id").alias("least_id"), list_name), "near-nodes")


def with_hubs(buckets: DataFrame) -> DataFrame:
    """key, hub and node: the smallest node of each bucket (key, node) with each other one."""
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub < _last").select("key", "hub")
    return buckets.join(hubs, "key").where("node <> hub").select("key", "hub", "node")


def sets_of(texts: DataFrame, nodes: DataFrame, size: int, keep) -> DataFrame:
    """node and shingles of the nodes (node, least_id), and of few others."""
    bitmaps = [texts.sparkSession.sparkContext.broadcast(id_bitmap(nodes.select(F.coalesce(c, F.lit(0)).alias(c)), c)) for c in ("least_id", "node")]
    sets = keep(texts.mapInArrow(_sets(size, *bitmaps), "node long, shingles array<long>"), "near-sets")
    if sets.count() > sets.select("node").distinct().count():  # copies without an id, in several tasks
        sets = sets.groupBy("node").agg(F.any_value("shingles").alias("shingles"))
    return sets


def differences(own: DataFrame, of_hub: DataFrame, percent: int) -> DataFrame:
    """hub, node, n_node, n_hub, x, the difference of a member's set and its hub's, and linked."""
    x = F.concat(F.array_except("v", "h"), F.array_except("h", "v"))
    out = own.join(of_hub, ["hub", "part"]).select("hub", "node", F.size("v").cast("long").alias("n_node"), F.size("h").cast("long").alias("n_hub"), x.alias("x"))
    total, apart = F.col("n_node") + F.col("n_hub"), F.size("x")
    return out.withColumn("linked", 100 * (total - apart) >= percent * (total + apart))


def joined(prepared: DataFrame, nodes: DataFrame, members: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, keep, used: list[str], star=differences, search=close_pairs) -> DataFrame:
    """doc_id, n_shingles, print1, print2, group (a component's node; null without words) and component_id of each row.

    members: key, hub, node of all candidates; pairs: their distinct stars; star and search compare members with
    their hub and among each other.  The tables named in used are removed.
    """
    spark = prepared.sparkSession
    # the members of a hub are dealt to as many tasks as it takes, and its set goes to each
    parts = keep(pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "near-hubs")
    large = _few(parts.where("parts > 1"))
    dealt = pairs.join(large, "hub", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    own = dealt.join(sets, "node").select("hub", "part", "node", F.col("shingles").alias("v"))
    of_hub = parts.join(sets, F.col("hub") == F.col("node")).select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("h"))
    stars = keep(star(own, of_hub, percent), "near-links")
    label, paths = components(stars.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    used += paths
    more = keep(_overlap_links(members, stars, label, percent, keep, search), "near-more-links")
    if not more.isEmpty():
        at = [label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab"]
        between = more.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        across, paths = components(keep(between, "near-between"))
        used += paths
        every = label.select("node", "component").union(more.select("a", "a")).union(more.select("b", "b")).groupBy("node").agg(F.min_by("component", F.col("component") == F.col("node")).alias("component"))
        onward = across.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        label = every.join(onward, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    linked = keep(label.join(nodes.select("node", "least_id"), "node"), "near-linked")
    smallest = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = linked.select("node", "component").join(smallest, "component").select("node", F.col("component").alias("_group"), F.col("component_id").alias("_id"), F.lit(True).alias("_linked"))
    named = nodes.select("node", "print2", "least_id").join(known, "node", "left")
    named = named.select(F.col("node").alias("print1"), "print2", F.coalesce("_group", "node").alias("group"), F.when(F.col("_linked"), F.col("_id")).otherwise(F.col("least_id")).alias("component_id"), F.lit(True).alias("_named"))
    named, _ = written(named, "near-named")
    removed(spark, *used)
    out = prepared.select("doc_id", "n_shingles", "print1", "print2").join(named, ["print1", "print2"], "left")
    group = F.when(F.col("n_shingles") > 0, F.coalesce("group", F.xxhash64("print1", "print2")))
    own_id = F.when((F.col("n_shingles") > 0) & F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "print1", "print2", group.alias("group"), own_id.alias("component_id"))


def keeper() -> tuple:
    """A function that writes a table between steps, and the list of the paths it has written to."""
    used: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        used.append(path)
        return out

    return keep, used


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of joined(), for candidates that share a band."""
    keep, used = keeper()
    rows, count = bands(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prepared, nodes = prepared_nodes(texts, _prepare(size, rows, count), "keys", keep)
    members = keep(with_hubs(nodes.select("node", F.explode("keys").alias("key"))), "near-members")
    pairs = keep(members.select("hub", "node").distinct(), "near-stars")
    needed = keep(pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct().join(nodes.select("node", "least_id"), "node"), "near-needed")
    return joined(prepared, nodes, members, pairs, sets_of(texts, needed, size, keep), percent, keep, used)


def classes(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of documents (doc_id, text)."""
    return _classes(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_prints(size: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(*text_buffers(batch.column(batch.schema.names.index("text"))), size)
                prints = np.array([set_prints(s) for s in sets], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(_signed(prints[:, k].copy())) for k in (0, 1))], names=[*batch.schema.names, "_print1", "_print2"])

    return run


def kept_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of documents that stay: one of each class, with the smallest doc_id.

    Rows with a doc_id of their own are found by it; the others, if there are any, by their sets.
    """
    every, _ = written(_classes(docs, size, percent), "near-rows")
    repeated = every.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_again"))
    repeated, _ = written(repeated, "near-repeated")
    stay = every.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = docs["doc_id"].cast("long")
    if repeated.isEmpty():
        return docs.join(stay.select(F.col("doc_id").alias("_kept")), key == F.col("_kept"), "left_semi").select(*docs.columns)
    single = stay.join(repeated, F.col("doc_id") == F.col("_again"), "left_anti").select(F.col("doc_id").alias("_kept"))
    out = docs.join(single, key == F.col("_kept"), "left_semi").select(*docs.columns)
    rows = docs.withColumn("_key", key).join(repeated, F.col("_key").eqNullSafe(F.col("_again")), "left_semi")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_print1 long", "_print2 long"])
    rows = rows.mapInArrow(_with_prints(size), schema)
    some = stay.where("n_shingles > 0").select(F.col("doc_id").alias("_id"), F.col("print1").alias("_p1"), F.col("print2").alias("_p2"), F.col("group").alias("_group")).distinct()
    match = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_print1") == F.col("_p1")) & (F.col("_print2") == F.col("_p2"))
    once = rows.join(some, match).dropDuplicates(["_group"]).select(*docs.columns)
    empty = rows.where("_print1 = 0 AND _print2 = 0").select(*docs.columns)
    return out.unionByName(once).unionByName(empty)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = {
    "op10_near_duplicates": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM steps UNION SELECT r.doc_id, s.y FROM reach r JOIN steps s ON s.x = r.other),
least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, t.doc_id) AS component_id, coalesce(m, t.doc_id) = t.doc_id AS kept
FROM documents t LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
""",
}
