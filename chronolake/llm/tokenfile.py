"""Token ids of documents in a grammar-compressed file, shard by shard, and their decoding.

A file is a Parquet folder with one row per shard, in ascending doc_id order.  In each shard the
Re-Pair rounds replace frequent neighbouring symbols by nonterminals; a shard holds its alphabet
(token ids), its rules, the expansion length of every symbol, the symbol sequence and, per
document, the doc_id, the first symbol and the number of tokens.  Symbols never span documents,
so one document, or any token range, is decoded without the rest.

The tokenizer gives the ids of each distinct piece of text once per worker.  Pieces are cut where the tokenizer
itself always cuts: at white space, and, in chunks of ASCII and Latin-1 letters, between letters,
digits and marks; any other chunk goes to the tokenizer whole.  A tokenizer for which that does
not hold, which is tried when it is loaded, gets whole texts.

Defined results: a null text is empty and gives the end id alone; a null doc_id comes first;
rows that repeat a doc_id follow each other in the order of a hash of their text; an empty table
gives an empty file; a doc_id that is no number is null; further columns are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, kept_by_worker, pieces, table, text_buffers, written
from .wordscan import Hashed, bounds

#: Tokens in a shard; a longer document makes a longer shard.
SHARD = 1 << 20
#: Fewest occurrences that make a rule, round by round; the last holds until no pair is left.
LEAST = (16, 4, 2)
END_ID = 1
SCHEMA = (
    "part int, shard int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, "
    "width int, alphabet binary, rules binary, lengths binary, symbols binary"
)

#: Entries of a worker's table of known pieces, and the slots of its hash table.
KNOWN, SLOTS = 1 << 19, 1 << 20
#: Bytes of text that are cut into pieces at once.
SPAN = 1 << 19
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _kinds() -> np.ndarray:
    """The kind of each byte.  Odd bytes are those whose chunk only the tokenizer itself can split:
    apostrophes, control characters, and all non-ASCII text but the letters of Latin-1."""
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _MARK
    kind[[0x20, 9, 10, 11, 12, 13]] = _SPACE
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0xC3] = _LETTER
    kind[0x27] = _ODD
    return kind


_KIND = _kinds()
_LOWER = np.frombuffer(LOWER, np.uint8)


def cut(body: np.ndarray, edges: np.ndarray):
    """Pieces that the tokenizer encodes independently: (bytes, starts, stops, whether they are odd).

    A piece is a run of letters, a digit or a run of other marks; white space separates pieces, and a
    chunk with an odd byte is one piece.  ASCII letters are lower-cased outside odd chunks.  edges:
    where texts start and end.
    """
    kind = _KIND[body]
    after = np.flatnonzero(body[:-1] == 0xC3) + 1  # second bytes of Latin-1 letters; 97 and B7 are signs
    kind[after] = np.where((body[after] == 0x97) | (body[after] == 0xB7), _ODD, _LETTER)
    special = np.flatnonzero((body[:-1] == 0x3C) & (body[1:] == 0x7C))  # "<|" may begin a special token
    kind[special] = _ODD
    starts, stops = bounds(kind != _SPACE, edges)
    low = _LOWER[body]
    odd = np.zeros(len(starts), bool)
    odd[np.searchsorted(starts, np.flatnonzero(kind == _ODD), "right") - 1] = True
    for k in np.flatnonzero(odd).tolist():
        low[starts[k] : stops[k]] = body[starts[k] : stops[k]]
    turn = kind != _SPACE
    turn[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    turn[starts] = True
    begins = np.flatnonzero(turn)
    chunk = np.searchsorted(starts, begins, "right") - 1
    some = ~odd[chunk] | (begins == starts[chunk])
    begins, chunk = begins[some], chunk[some]
    return low, begins, np.minimum(stops[chunk], np.append(begins[1:], len(body))), odd[chunk]


class Encoder:
    """Token ids of texts, as unsigned 32-bit integers, by the tokenizer at ``path``.

    The ids of a piece are asked for once and kept in a table of numpy arrays, of a bounded size.  When it
    is full, only pieces that came again in a later span stay.  A tokenizer that does not split texts as cut() does, which is tried on
    some sentences, gets whole texts.
    """

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), known
        words, suffix = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max([*words.values(), 0]) + 1, bool)  # ids that end a piece
        self.last[[i for w, i in words.items() if suffix and w.endswith(suffix)]] = True
        self.forget()
        self.fits = bool(suffix) and all(np.array_equal(self._pieces(t.encode()), self.direct(t.encode())) for t in _TRIALS)
        self.forget()

    def forget(self) -> None:
        self.keys, self.number = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.more: dict[int, int] = {}  # pieces whose slot was taken
        self.n = 0
        self.at, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)  # where a piece's ids are, and how many
        self.head, self.size = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int32)  # a piece's first bytes and length
        self.hash, self.again = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, bool)  # its hash, and whether it came again
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0

    def renew(self) -> None:
        """Forget the pieces that did not come again; all, if too many did."""
        keep = np.flatnonzero(self.again[: self.n])
        known = [v[keep] for v in (self.hash, self.head, self.size)]
        count = self.count[keep]
        ends = np.cumsum(count, dtype=np.int64)
        ids = self.flat[np.repeat(self.at[keep] - (ends - count), count) + np.arange(int(count.sum()))]
        self.forget()
        if len(keep) <= self.most // 2:
            self._learn(*known, ids, count)

    def direct(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _asked(self, plain: list[bytes], odd: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of ids of each; odd ones are asked for singly."""
        groups = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        got = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

        def singly(some):
            for found in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False):
                ids.append(np.array(found.ids, np.uint32))
                counts.append(np.array([len(ids[-1])]))

        for group, found in zip(groups, got, strict=True):
            here = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.last[np.minimum(here, len(self.last) - 1)]) + 1
            if len(ends) == len(group) and ends[-1] == len(here):
                ids.append(here)
                counts.append(np.diff(ends, prepend=0))
            else:  # not a word each
                singly(group)
        singly(odd)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        n, used = self.n + len(h), self.used + len(ids)
        if n > len(self.at):
            for name in ("at", "count", "head", "size", "hash", "again"):
                setattr(self, name, np.resize(getattr(self, name), 2 * n))
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        here = slice(self.n, n)
        self.flat[self.used : used], self.count[here], self.head[here], self.size[here] = ids, count, head, size
        self.hash[here], self.again[here] = h, False
        self.at[here] = self.used + np.cumsum(count) - count
        mine = np.arange(self.n, n, dtype=np.int32)
        for k in (0, 1):  # the first free one of a piece's two slots
            slot = self._slot(h, k)
            free = np.flatnonzero(self.number[slot] < 0)
            self.number[slot[free]], self.keys[slot[free]] = mine[free], h[free]
            lost = np.flatnonzero(self.keys[slot] != h)
            h, mine = h[lost], mine[lost]
        self.more.update(zip(h.tolist(), mine.tolist(), strict=True))
        self.n, self.used = n, used

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(32 * k)) % np.uint64(SLOTS)).astype(np.int64)

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces in the table of slots; -1 for others."""
        slot = self._slot(h, 0)
        number = np.where(self.keys[slot] == h, self.number[slot], -1)
        open_ = np.flatnonzero(number < 0)
        slot = self._slot(h[open_], 1)
        number[open_] = np.where(self.keys[slot] == h[open_], self.number[slot], -1)
        return number

    def _span(self, body: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, number of ids) of each piece, and all ids."""
        low, starts, stops, odd = cut(body, edges)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint32)
        h, size = Hashed(low).ranges(starts, stops), (stops - starts).astype(np.int32)
        wide = np.concatenate((low, np.zeros(8, np.uint8)))
        head = np.ndarray(len(low) + 1, "<u8", wide, strides=(1,))[starts]
        head &= _HEAD[np.minimum(size, 8)]
        if self.n > self.most:
            self.renew()
        number = self._found(h)
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            kinds, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            place = np.array([self.more.get(x, -1) for x in kinds.tolist()], np.int64)
            self.again[place[place >= 0]] = True
            unknown = np.flatnonzero(place < 0)
            order = unknown[np.argsort(odd[new[first[unknown]]], kind="stable")]  # plain ones first
            pick = new[first[order]]
            n_plain, data = int((~odd[pick]).sum()), low.tobytes()
            asked = [data[a:b] for a, b in zip(starts[pick].tolist(), stops[pick].tolist(), strict=True)]
            place[order] = self.n + np.arange(len(order))
            self._learn(kinds[order], head[pick], size[pick], *self._asked(asked[:n_plain], asked[n_plain:]))
            number[new] = place[inverse]
        count, at = self.count[number].astype(np.int64), self.at[number]
        wrong = np.flatnonzero((self.head[number] != head) | (self.size[number] != size))
        own = [self.direct(low[starts[k] : stops[k]].tobytes()) for k in wrong.tolist()]  # another piece has the same hash
        count[wrong] = [len(v) for v in own]
        before = np.cumsum(count) - count
        ids = self.flat[np.minimum(np.repeat(at - before, count) + np.arange(int(count.sum())), self.used - 1)] if self.used else np.zeros(int(count.sum()), np.uint32)
        for k, v in zip(wrong.tolist(), own, strict=True):
            ids[before[k] : before[k] + len(v)] = v
        return starts, count, ids

    def _pieces(self, text: bytes) -> np.ndarray:
        return self._span(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[2]

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each; offsets are the texts' bounds in body."""
        if not self.fits:
            each = [self.direct(body[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(e) for e in each], np.int64)
        ids, counts, start = [], np.zeros(len(offsets) - 1, np.int64), 0
        while start < len(body):
            stop = min(start + SPAN, len(body))
            if stop < len(body):  # end behind white space, or where a text ends; a longer chunk stays whole
                ends = np.flatnonzero(_KIND[body[start:stop]] == _SPACE)
                text = np.searchsorted(offsets, stop, "right") - 1
                best = max(start + int(ends[-1]) + 1 if len(ends) else start, int(offsets[text]))
                while best <= start:
                    stop = min(stop + SPAN, int(offsets[text + 1]))
                    ends = np.flatnonzero(_KIND[body[start:stop]] == _SPACE)
                    best = stop if stop == offsets[text + 1] else start + int(ends[-1]) + 1 if len(ends) else start
                stop = best
            lo, hi = np.searchsorted(offsets, [start, stop], "left")
            at, count, got = self._span(body[start:stop], np.concatenate(([0], offsets[lo:hi] - start, [stop - start])))
            counts += np.bincount(np.searchsorted(offsets, at + start, "right") - 1, count, minlength=len(counts)).astype(np.int64)
            ids.append(got)
            start = stop
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), counts


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Sentences that show whether a tokenizer splits texts as cut() does.
_TRIALS = ["The 3rd naïve ÉTÉ — it's 3.14!! (#x) 'LL\tI'M 中文 IT'S", "a1b2 ÀÇ×÷ß <|endoftext|> x<y||z e\u0301 \u212a\u00a0\x85\x1c ...?!", "don't we'Ve 'quoted' x_y-z €5"]


def replace_round(seq: np.ndarray, last: np.ndarray, n: int, limit: int, least: int):
    """One round: (new sequence, new document ends, rules as an (r, 2) array) or None.

    Pairs are taken by falling frequency as long as no symbol is a left part of one and a right
    part of another, so that occurrences of different chosen pairs never overlap.
    """
    half = np.uint64(32) if seq.dtype == np.uint32 else np.uint32(16)
    wide = np.uint64 if seq.dtype == np.uint32 else np.uint32
    keys = (seq[:-1].astype(wide) << half) | seq[1:]
    ordered = np.sort(keys[~last[:-1]])
    if not len(ordered):
        return None
    edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    count = np.diff(edge)
    often = np.flatnonzero(count >= least)
    often = often[np.argsort(-count[often], kind="stable")]
    left, right, chosen, shift = bytearray(n), bytearray(n), [], int(half)
    mask = (1 << shift) - 1
    for key in ordered[edge[often]].tolist():
        a, b = key >> shift, key & mask
        if right[a] or left[b] or (a == b and (left[a] or right[b])):
            continue
        if len(chosen) >= limit - n:
            break
        left[a] = right[b] = 1
        chosen.append(key)
    if not chosen:
        return None
    chosen = np.sort(np.array(chosen, wide))
    at = np.flatnonzero(np.frombuffer(left, bool)[seq[:-1]] & np.frombuffer(right, bool)[seq[1:]] & ~last[:-1])
    rule = _places(chosen, keys[at])
    hit = rule >= 0
    at, rule = at[hit], rule[hit]
    # occurrences of a pair of equal symbols can overlap: every second one of a run counts
    run = np.concatenate(([True], at[1:] != at[:-1] + 1))
    nth = at - at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
    at, rule = at[nth % 2 == 0], rule[nth % 2 == 0]
    seq, last, keep = seq.copy(), last.copy(), np.ones(len(seq), bool)
    seq[at] = (n + rule).astype(seq.dtype)
    last[at] = last[at + 1]
    keep[at + 1] = False
    rules = np.stack([chosen >> half, chosen & wide(mask)], 1)
    return seq[keep], last[keep], rules


def _places(chosen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in the sorted array chosen; -1 for those that are not there.

    A table by hash answers nearly all; a slot that two chosen keys share is looked up by search.
    """
    slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
    mine = slot(chosen)
    table = np.full(1 << 21, -1, np.int32)
    table[mine] = np.arange(len(chosen))
    shared = mine[table[mine] != np.arange(len(chosen))]
    table[shared] = -2
    out = table[slot(keys)]
    found = np.flatnonzero(out >= 0)
    out[found[chosen[out[found]] != keys[found]]] = -1
    rest = np.flatnonzero(out == -2)
    at = np.minimum(np.searchsorted(chosen, keys[rest]), len(chosen) - 1)
    out[rest] = np.where(chosen[at] == keys[rest], at, -1)
    return out


def _ranks(alphabet: np.ndarray) -> np.ndarray:
    out = np.zeros(int(alphabet[-1]) + 1, np.uint32)
    out[alphabet] = np.arange(len(alphabet))
    return out


def compress(ids: np.ndarray, counts: np.ndarray, least: tuple[int, ...] = LEAST) -> dict:
    """Grammar of the ids of some documents with counts tokens each (all at least 1).

    Rounds go on until no pair occurs ``least[-1]`` times or all symbol numbers are in use: 65,536
    where the alphabet leaves room for rules in 16 bits, else 2**22.
    """
    alphabet = np.flatnonzero(np.bincount(ids)) if ids.max() < 1 << 20 else np.unique(ids)
    seq = np.searchsorted(alphabet, ids) if len(alphabet) <= ids.max() >> 8 else _ranks(alphabet)[ids]
    width = 2 if len(alphabet) <= 49152 + 4096 else 4
    kind = np.uint16 if width == 2 else np.uint32
    limit = 1 << 16 if width == 2 else 1 << 22
    seq, n, rules, step = seq.astype(kind), len(alphabet), [], 0
    lengths = [np.ones(n, np.uint32)]
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts) - 1] = True
    while step < len(least):
        got = replace_round(seq, last, n, limit, least[step])
        if got is not None:
            seq, last, new = got
            rules.append(new)
            known = np.concatenate(lengths)
            lengths = [known, known[new[:, 0]] + known[new[:, 1]]]
            n += len(new)
        if got is None or step + 1 < len(least):
            step += 1
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), kind)
    lengths = np.concatenate(lengths)
    ends = np.flatnonzero(last) + 1
    return {"width": width, "alphabet": alphabet.astype("<u4").tobytes(), "rules": rules.astype(f"<u{width}").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": seq.astype(f"<u{width}").tobytes(), "doc_symbols": np.concatenate(([0], ends[:-1])).astype(np.int64)}


class Shard:
    """A shard as read back; any token range is decoded from the symbols that cover it."""

    def __init__(self, row: dict):
        kind = f"<u{row['width']}"
        self.alphabet = np.frombuffer(row["alphabet"], "<u4")
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], kind)
        rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
        n = len(self.alphabet)
        flat = np.arange(n + len(rules))
        while (deep := flat >= n).any():  # every symbol's expansion, one level a pass
            at = np.arange(len(flat)) + np.cumsum(deep) - deep
            longer = np.empty(len(flat) + int(deep.sum()), np.int64)
            longer[at[~deep]] = flat[~deep]
            longer[at[deep]], longer[at[deep] + 1] = rules[flat[deep] - n].T
            flat = longer
        self.flat = self.alphabet[flat]
        self.offset = np.cumsum(self.lengths) - self.lengths

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        at = np.repeat(self.offset[symbols] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at]

    def tokens(self, first: int, stop: int) -> np.ndarray:
        """Token ids [first, stop) of the shard."""
        ends = np.cumsum(self.lengths[self.symbols])
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, stop, "left") + 1
        begin = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[first - begin : stop - begin]


def _encode(path: str, shard: int, least: tuple[int, ...]):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = kept_by_worker(("encoder", path), lambda: Encoder(path))
        part, number, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, counts, size = [], [], [], 0  # of the shard that is being filled

        def row():
            n = np.concatenate(counts)
            got = compress(np.concatenate(ids), n, least)
            lists = {"doc_ids": pa.concat_arrays(doc_ids), "doc_tokens": pa.array(n), "doc_symbols": pa.array(got["doc_symbols"])}
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists.values()]
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), *lists, pa.array([got["width"]], pa.int32())]
            arrays += [pa.array([got[k]], pa.binary()) for k in ("alphabet", "rules", "lengths", "symbols")]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for whole in batches:
            for batch in pieces(whole, "text"):
                got, n = encoder.encode(*text_buffers(batch.column(1)))
                ends = np.cumsum(n)
                flat = np.insert(got, ends, END_ID)  # an end id behind each document
                n, ends, start = n + 1, ends + np.arange(1, len(n) + 1), 0
                while start < len(n):
                    before = int(ends[start - 1]) if start else 0
                    stop = min(int(np.searchsorted(ends, before + shard - size)) + 1, len(n))
                    doc_ids.append(batch.column(0).slice(start, stop - start))
                    ids.append(flat[before : ends[stop - 1]])
                    counts.append(n[start:stop])
                    size += int(ends[stop - 1]) - before
                    start = stop
                    if size >= shard:
                        yield row()
                        first, number = first + size, number + 1
                        doc_ids, ids, counts, size = [], [], [], 0
        if size:
            yield row()

    return run


def token_file(docs: DataFrame, tokenizer: str, shard: int = SHARD, least: tuple[int, ...] = LEAST) -> str:
    """Encode and compress documents (doc_id, text) into a file in the shared folder; its path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_order", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order", "text")
    return written(rows.select("doc_id", "text").mapInArrow(_encode(tokenizer, shard, least), SCHEMA), "tokens")[1]


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The file's shards with ``start``: tokens of the whole file before the shard."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row per partition of the writer
    before = F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("part", before.alias("_base"))
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("first") + F.col("_base"))


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            ids = Shard(row).expand(np.frombuffer(row["symbols"], f"<u{row['width']}")).tobytes()
            counts = np.array(row["doc_tokens"], np.int64)
            before = np.cumsum(counts) - counts
            crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(before.tolist(), row["doc_tokens"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + before, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded file."""
    return with_starts(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark, token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
