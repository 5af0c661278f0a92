"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

The most frequent tokens are the model's words, in classes of equal size; all others form one rare
class.  The chance of a token is that of its class given the history times that of the token in its class.  Class scores come from hashed features of the
history: the last token, the last two, and the tokens two and three back; word scores from the
last token and the class.  Words that follow the same frequent words share a class.  Words and
hashed rows grow with the corpus up to stated bounds; a row that several features share drops none.

The rare class has no bound: each of its tokens has a feature for each last token that it follows, without
hashing into rows.  As one feature of a token fires there, the likelihood with its prior is largest at
(occurrences after the last token + RARE_PRIOR x the token's share) / (rare tokens after it + RARE_PRIOR), where
tokens that were never seen share one occurrence.  These counts of the whole corpus stay distributed: rare tokens with their last
token and text are dealt out by token, and the numbers of rare tokens after each token are looked up or joined.

Training maximises the likelihood of all training documents by the gradient, observed less
expected counts of each feature with each outcome.  The first update takes the gradient of the whole
corpus, in which expected counts are known at once as no weight is set yet.  In each further
round a part of the documents gives the gradient under the weights so far, the expected part from
outcomes drawn from the model, one for each token, by a hash of the text.  So all sums are of
whole numbers and do not depend on their order.  Executors sum counts, partial sums are added
block by block, and the driver, which sees tables of bounded size only, updates the weights by
the logarithm of (observed / expected), which is the gradient's direction scaled for each feature.

The table of all token counts stays distributed: a bounded share of frequent tokens is looked up in
memory, the others are counted for each document and joined, their frequent ones apart.

Defined results: a null or empty text is one end token; rows that repeat a doc_id are scored one by
one; a null doc_id counts as the empty text when training documents are chosen, and an id that is no
number becomes null in the result; with no training document every token has c = 0 and the scores
are 0 for the base and the model; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, pieces, loaded, shared_value, table, text_buffers, written
from .wordscan import NONSPACE, mixed64, words

#: Classes of words, and frequent tokens whose counts are looked up.
CLASSES, LOOKUP = 64, 1 << 18
#: Exponents of 2, least and most, of the words of a class, of the hashed rows of class scores and of
#: word scores; they follow the number of training tokens.
SIZES, ROWS, WORD_ROWS = (5, 7), (14, 16), (11, 14)
#: Rounds after the first update, the damping of an update, and its largest change.
ROUNDS, RATE, STEP = 2, 0.5, 2.0
#: The largest score of a feature: the exponentials of five scores must fit 32-bit floating point numbers.
LARGEST = 8.0
#: Occurrences that are added before logarithms are taken: in the first update of a feature, shared out
#: like outcomes in general, and in the others to each outcome.
PRIOR, NOISE = 100.0, 20.0
#: Occurrences that are added to those of rare tokens after each token, shared out like rare tokens in general.
RARE_PRIOR = 1000.0
#: Frequent words whose following words describe a class, those that make features of two words, and
#: tokens handled at once.
CONTEXT, PAIRED, CHUNK = 128, 512, 1 << 12
#: Tokens with their counts that a task holds before it passes them on.
HELD = 1 << 18
END = np.uint64(0xE4D0E4D0E4D0E4D1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.int32(1)
#: Words have places by the bits of their hashes that are left after a shift by so many.
_SLOT = np.uint64(46)
#: Rare tokens in a part that one group of a shuffle takes, about, and parts at least.
PART, PARTS = 1 << 19, 256
#: Input partitions that one training task takes, if there are enough for all cores; each task
#: passes on one set of count tables.
PARTITIONS_PER_TASK = 4
#: Numbers in a block of a count table, at most.
BLOCK = 1 << 16


def shape(total: int) -> tuple[int, int, int]:
    """Words of a class, rows of class scores and rows of word scores for so many training tokens."""
    bits = max(int(total), 1).bit_length()
    within = lambda v, bounds: 1 << min(max(v, bounds[0]), bounds[1])
    return within((bits - 8) // 2, SIZES), within(bits - 9, ROWS), within(bits - 8, WORD_ROWS)


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and each text's first token (one more entry)."""
    _, _, _, h, first = words(body, offsets, NONSPACE)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def before(h: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each token at the positions, and the hash of the token before it; 0 at a text's start."""
    owner = np.searchsorted(first, at, "right") - 1
    return owner, np.where(at > first[owner], h[at - 1], np.uint64(0))


def _merged(hashes: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return kinds, np.bincount(at, np.concatenate(numbers), minlength=len(kinds)).astype(np.int64)


def _counted(some):
    """Kinds and numbers of the hashes in some arrays; a kind may come again."""
    hashes, numbers, size = [], [], 0
    for each in some:
        h, n = np.unique(each, return_counts=True)
        hashes.append(h)
        numbers.append(n)
        size += len(h)
        if size >= 2 * HELD:
            hashes, numbers = ([v] for v in _merged(hashes, numbers))
            size = len(hashes[0])
            if size >= HELD:
                yield hashes[0].view(np.int64), numbers[0]
                hashes, numbers, size = [], [], 0
    if size:
        hashes, numbers = _merged(hashes, numbers)
        yield hashes.view(np.int64), numbers


def _counts(batches):
    import pyarrow as pa

    for h, n in _counted(tokens(*text_buffers(batch.column(0)))[0] for whole in batches for batch in pieces(whole, "text")):
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "c"])


def token_counts(docs: DataFrame) -> DataFrame:
    """h (token hash) and c (occurrences) of all tokens of the documents."""
    return docs.select("text").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent tokens, at most ``most``, by falling count.

    A histogram of the counts' logarithms gives the least count that is frequent, so that no task
    sees more than what is returned.  Only where the first level of the histogram alone holds too many
    are its tokens with the smallest hashes taken.
    """
    level = F.floor(F.log2("c") * 16)
    steps = counts.groupBy(level.alias("level")).count().collect()  # some hundred rows
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r["level"]):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    if least is not None:
        top = counts.where(level >= least).toArrow()
    else:
        top = counts.orderBy(F.desc("c"), "h").limit(most).toArrow()
    h, c = np.array(top.column(0)).astype(np.int64), np.array(top.column(1)).astype(np.int64)
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order]


def _rows_of(blocks):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([v.tobytes() for _, v in blocks], pa.binary())], names=["block", "part"])


def _summed(parts: DataFrame, tasks: int, finish) -> list[tuple[int, bytes]]:
    """finish(block, sum) of every block of 32-bit counts, summed over all tasks.

    With many tasks a block is first summed in groups, so that no task adds more than some hundreds.
    """

    def adding(kind, end):
        def add(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    piece = np.frombuffer(raw, kind)
                    total[k] = total[k] + piece if k in total else piece.astype(np.int64)
            for k, v in total.items():
                yield _rows_of([(k, end(k, v))])

        return add

    kind = np.int32
    if tasks > 256:
        salt = F.pmod(F.xxhash64("part"), F.lit(tasks // 256 + 1)).cast("int")
        parts = parts.withColumn("_salt", salt).repartition("block", "_salt").drop("_salt").mapInArrow(adding(kind, lambda _, v: v), "block int, part binary")
        kind = np.int64
    rows = parts.repartition("block").mapInArrow(adding(kind, finish), "block int, part binary").toArrow()
    return sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


class Words:
    """The model's words: ids by hash, and the place of each in its class; rare tokens share id n."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, size: int):
        order = np.argsort(hashes)
        self.sorted, self.order, self.n, self.size = hashes[order], order, len(hashes), size
        self.counts, self.hashes = counts, np.append(hashes, np.uint64(0))
        slots = (hashes >> _SLOT).astype(np.int64)
        taken, at = np.unique(slots, return_index=True)
        self.slots = np.full(1 << (64 - int(_SLOT)), self.n, np.int32)
        self.slots[taken] = at
        apart = order[self.slots[slots[order]] != order]  # words whose place another has, by hash
        self.apart, self.apart_hashes = np.append(apart, self.n), np.append(hashes[apart], ~np.uint64(0))
        self.place(np.arange(self.n))

    def place(self, ranking: np.ndarray) -> None:
        slot = np.zeros(self.n, np.int64)
        slot[ranking] = np.arange(self.n)
        self.group, self.spot = np.append(slot // self.size, CLASSES), np.append(slot % self.size, 0)

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = self.slots[(h >> _SLOT).view(np.int64)].astype(np.int64)
        others = np.flatnonzero((self.hashes[out] != h) | (out == self.n))
        at = np.searchsorted(self.apart_hashes[:-1], h[others])
        out[others] = np.where(self.apart_hashes[at] == h[others], self.apart[at], self.n)
        return out


class Seen:
    """Tokens with their ids, the hashes and ids of the tokens before them, and a number in [0, 1) for each.

    Before a text's start stand tokens with hash 0 and an id of their own, n + 1.
    """

    def __init__(self, vocabulary: Words, h: np.ndarray, first: np.ndarray):
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        self.own, self.place, self.ids, self.hashes, self.back = h, place, vocabulary.ids(h), [], []
        for k in (1, 2, 3):
            before, ids = np.zeros(len(h), np.uint64), np.full(len(h), vocabulary.n + 1)
            before[k:], ids[k:] = h[:-k], self.ids[:-k]
            outside = np.flatnonzero(place < k)
            before[outside], ids[outside] = 0, vocabulary.n + 1
            self.hashes.append(before)
            self.back.append(ids)
        self.key = None

    def draw(self, nth: int) -> np.ndarray:
        if self.key is None:
            self.key = mixed64(self.own * _ODD + self.hashes[0] + mixed64(self.place.astype(np.uint64)))
        return (mixed64(self.key + np.uint64(nth)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


class Model:
    """Words, biases from counts, and hashed tables of class and word scores."""

    def __init__(self, vocabulary: Words, rare: int, rare_kinds: int, total: int, rows: int, word_rows: int):
        self.words, self.rare, self.rare_kinds, self.n_rows, self.buckets = vocabulary, rare, rare_kinds, rows, max(word_rows // CLASSES, 2)
        mass = np.zeros((CLASSES + 1, vocabulary.size))
        mass[vocabulary.group[:-1], vocabulary.spot[:-1]] = vocabulary.counts
        mass[CLASSES, 0] = rare + 1
        by_class = mass.sum(1)
        self.class_bias = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9) / max(total + 1, 1)), -1e4).astype(np.float32)
        self.word_bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / np.maximum(by_class, 1e-9)[:, None]), -1e4).astype(np.float32)
        self.classes = np.zeros((rows + 1, CLASSES + 1), np.float32)  # the last row stands for no feature
        self.inner = np.zeros((CLASSES * self.buckets, vocabulary.size), np.float32)
        self.powers = self.totals = None

    def rows(self, seen: Seen) -> list[np.ndarray]:
        """The row of each feature; tokens outside the words have rows of their own kind, so that they disturb no word's."""
        own = np.uint64(self.n_rows - self.n_rows // 4)
        out = []
        for k, (h, i) in enumerate(zip(seen.hashes, seen.back, strict=True)):
            key = mixed64(h * _ODD + np.uint64(k))
            out.append(np.where(i != self.words.n, key % own, own + key % (np.uint64(self.n_rows) - own)).astype(np.int64))
        key = mixed64(mixed64(seen.hashes[0] + np.uint64(9)) + seen.hashes[1])
        often = np.maximum(np.where(seen.back[0] == self.words.n + 1, 0, seen.back[0]), np.where(seen.back[1] == self.words.n + 1, 0, seen.back[1])) < PAIRED
        out.append(np.where(often, (key % own).astype(np.int64), self.n_rows))
        return out

    def inner_rows(self, seen: Seen, own: np.ndarray) -> np.ndarray:
        """Rows of word scores: for each class, buckets of the last token; frequent ones have their own."""
        half, before = self.buckets // 2, seen.back[0][own]
        bucket = np.where(before < half, before, half + (mixed64(seen.hashes[0][own]) % np.uint64(half)).astype(np.int64))
        return self.words.group[seen.ids[own]] * self.buckets + bucket

    def weights(self) -> tuple[np.ndarray, ...]:
        """Exponentials of class scores and biases, and the weights of words with their sums, for each row of word scores.

        A row of word scores belongs to one class and is all that a word's weight depends on, so these are taken once.
        """
        if self.powers is None:
            words = np.exp(self.inner)
            words *= np.repeat(np.exp(self.word_bias[:CLASSES]), self.buckets, axis=0)
            self.powers = np.exp(self.classes), np.exp(self.class_bias), words, words.sum(1)
        return self.powers

    def chunks(self, seen: Seen, rows: list[np.ndarray] | None = None):
        """Chunk by chunk: the tokens' positions, rows of features and classes, and the weights of classes, which the next chunk overwrites.

        A weight is the product of the exponentials of scores.
        """
        classes, class_bias, *_ = self.weights()
        rows, n = rows or self.rows(seen), len(seen.ids)
        product, factor = np.empty((2, min(n, CHUNK), CLASSES + 1), np.float32)
        for k in range(0, n, CHUNK):
            here = slice(k, k + CHUNK)
            at = [r[here] for r in rows]
            weight, other = product[: len(at[0])], factor[: len(at[0])]
            np.take(classes, at[0], axis=0, out=weight, mode="clip")
            for r in at[1:]:
                weight *= np.take(classes, r, axis=0, out=other, mode="clip")
            weight *= class_bias
            yield here, at, self.words.group[seen.ids[here]], weight

    def log_chances(self, seen: Seen) -> np.ndarray:
        """Natural logarithm of each token's chance; of a rare one, of its class's chance."""
        out = np.zeros(len(seen.ids))
        for here, _, group, weight in self.chunks(seen):
            out[here] = np.log(weight[np.arange(len(group)), group] / weight.sum(1))
        *_, words, sums = self.weights()
        own = np.flatnonzero(seen.ids < self.words.n)
        at = self.inner_rows(seen, own)
        out[own] += np.log(words[at, self.words.spot[seen.ids[own]]] / sums[at])
        return out

    def observed(self, seen: Seen, classes: np.ndarray, inner: np.ndarray, rows: list[np.ndarray] | None = None) -> None:
        """Add the counts of features with outcomes."""
        group = self.words.group[seen.ids]
        for r in rows or self.rows(seen):
            np.add.at(classes, r * (CLASSES + 1) + group, _ONE)
        own = np.flatnonzero(seen.ids < self.words.n)
        np.add.at(inner, self.inner_rows(seen, own) * self.words.size + self.words.spot[seen.ids[own]], _ONE)

    def expected(self, seen: Seen, classes: np.ndarray, inner: np.ndarray, rows: list[np.ndarray] | None = None) -> None:
        """Add the counts of features with outcomes drawn from the model, one for each token."""
        if self.totals is None:
            self.totals = np.cumsum(self.weights()[2], axis=1)
        draws = seen.draw(0), seen.draw(1)
        for here, at, _, weight in self.chunks(seen, rows):
            group = _drawn(weight, draws[0][here])
            for r in at:
                np.add.at(classes, r * (CLASSES + 1) + group, _ONE)
        own = np.flatnonzero(seen.ids < self.words.n)
        at = self.inner_rows(seen, own)
        np.add.at(inner, at * self.words.size + _ended(self.totals, at, draws[1][own]), _ONE)

    def blocks(self) -> list[tuple[int, int, int]]:
        """Blocks of both tables: the table, and the first and last but one of its rows."""
        out = []
        for k, table in enumerate((self.classes, self.inner)):
            step = max(BLOCK // table.shape[1], 1)
            out += [(k, a, min(a + step, len(table))) for a in range(0, len(table), step)]
        return out

    def changed(self, changes: list[tuple[int, bytes]]) -> None:
        """Add the changes of blocks of scores."""
        blocks, tables = self.blocks(), (self.classes, self.inner)
        for k, raw in changes:
            table, a, b = blocks[k]
            part = tables[table][a:b]
            part += np.frombuffer(raw, np.float32).reshape(part.shape)
            np.clip(part, -LARGEST, LARGEST, out=part)
        self.classes[-1], self.powers, self.totals = 0, None, None

    def steps(self) -> Steps:
        return Steps(self.blocks(), np.exp(self.class_bias.astype(float)), np.exp(self.word_bias[:CLASSES].astype(float)), self.buckets)


class Steps:
    """Changes of scores from summed counts, block by block."""

    def __init__(self, blocks, class_share: np.ndarray, word_share: np.ndarray, buckets: int):
        self.blocks, self.class_share, self.word_share, self.buckets = blocks, class_share, word_share, buckets

    def first(self, block: int, counts: np.ndarray) -> np.ndarray:
        """The first change, from the counts of the whole corpus: without scores, outcomes have their shares."""
        table, a, b = self.blocks[block]
        observed = counts.reshape(b - a, -1)
        share = self.word_share[np.arange(a, b) // self.buckets] if table else self.class_share
        return _step(observed, observed.sum(1, keepdims=True) * share, PRIOR * share)

    def further(self, block: int, counts: np.ndarray) -> np.ndarray:
        """A further change, from the counts of a part of the corpus, observed and drawn."""
        observed, drawn = counts.reshape(2, -1)
        return _step(observed, drawn, NOISE)


def _step(observed: np.ndarray, expected: np.ndarray, smooth) -> np.ndarray:
    return np.clip(RATE * np.log((observed + smooth + 1e-30) / (expected + smooth + 1e-30)), -STEP, STEP).astype(np.float32)


def _drawn(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The outcome of each row in which the share u of its weights ends.

    Weights are added outcome by outcome for all rows, so that no row's sum depends on the rows beside it.
    """
    n, outcomes = weights.shape
    total = np.empty((outcomes, n + 24), np.float32)[:, :n]  # lines a power of two apart would share places in the cache
    total[:] = weights.T
    for before, now in zip(total[:-1], total[1:], strict=True):
        now += before
    return (total[:-1] < u * total[-1]).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)


def _ended(totals: np.ndarray, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The outcome in which the share u of the weights ends, by bisection in the given rows of running totals."""
    flat, left = totals.ravel(), totals.shape[1]
    start = rows * left
    end, at = u * flat[start + left - 1], start.copy()
    while left > 1:
        half = left >> 1
        at += half * (flat[at + (half - 1)] < end)
        left -= half
    return at - start


def _contexts(shared):
    """Counts of (word, frequent word before it) pairs as blocks, and, in rows of their own, those of rare tokens after each token."""

    def run(batches):
        import pyarrow as pa

        v = loaded(shared)
        got = np.zeros(v.n * CONTEXT, np.int64)
        names = ["block", "part", "h", "c"]

        def befores():
            for whole in batches:
                for batch in pieces(whole, "text"):
                    h, first = tokens(*text_buffers(batch.column(0)))
                    ids = v.ids(h)
                    now, last = ids[1:], ids[:-1]
                    some = (now < v.n) & (last < CONTEXT)
                    np.add.at(got, now[some] * CONTEXT + last[some], 1)
                    yield before(h, first, np.flatnonzero(ids == v.n))[1]

        for h, n in _counted(befores()):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary()), pa.array(h), pa.array(n)], names=names)
        for k in range(0, len(got), BLOCK):
            rows = _rows_of([(k // BLOCK, got[k : k + BLOCK].astype(np.int32))])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)

    return run


def ranking(context: np.ndarray) -> np.ndarray:
    """Words ordered by the group of their contexts, given as roots of counts, then by frequency (ids are frequency ranks)."""
    x = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    centers = [x[0]]
    for _ in range(7):  # spread the first centers over the frequent words
        near = np.max([x[:512] @ c for c in centers], 0)
        centers.append(x[int(near.argmin())])
    centers = np.array(centers)
    for _ in range(20):
        own = (x @ centers.T).argmax(1)
        for k in range(len(centers)):
            if (own == k).any():
                c = x[own == k].sum(0)
                centers[k] = c / max(np.linalg.norm(c), 1e-9)
    return np.lexsort((np.arange(len(x)), own))


def _gradients(shared, first_round: bool):
    """Observed counts of features with outcomes and, but for the first round, drawn ones, as blocks."""

    def run(batches):
        m = loaded(shared)
        sums = [np.zeros(t.size, np.int32) for t in (m.classes, m.inner) * (1 if first_round else 2)]
        for whole in batches:
            for batch in pieces(whole, "text"):
                seen = Seen(m.words, *tokens(*text_buffers(batch.column(0))))
                rows = m.rows(seen)
                m.observed(seen, *sums[:2], rows)
                if not first_round:
                    m.expected(seen, *sums[2:], rows)
        for k, (table, a, b) in enumerate(m.blocks()):
            width = (m.classes, m.inner)[table].shape[1]
            part = np.concatenate([v[a * width : b * width] for v in sums[table::2]])
            if part.any():
                yield _rows_of([(k, part)])

    return run


def trained(docs: DataFrame, top: tuple[np.ndarray, np.ndarray], total: int, kinds: int) -> tuple[Model, DataFrame]:
    """The model of the training documents, and c, the rare tokens after each token h; top: hashes and counts of frequent tokens."""
    spark = docs.sparkSession
    size, rows, word_rows = shape(total)
    hashes, numbers = (v[: CLASSES * size] for v in top)
    vocabulary = Words(hashes, numbers, size)
    tasks = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // PARTITIONS_PER_TASK)
    texts = docs.select("text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS)).alias("_part"))
    pairs = texts.select("text").coalesce(tasks).mapInArrow(_contexts(shared_value(spark, vocabulary)), "block int, part binary, h long, c long")
    pairs, _ = written(pairs, "lm-contexts")
    after = pairs.where("h is not null").groupBy("h").agg(F.sum("c").alias("c"))
    if vocabulary.n:
        pairs = pairs.where("block is not null").select("block", "part")
        context = np.concatenate([np.frombuffer(raw, np.float32) for _, raw in _summed(pairs, tasks, lambda _, v: np.sqrt(v).astype(np.float32))])
        vocabulary.place(ranking(context.reshape(-1, CONTEXT)))
    model = Model(vocabulary, total - int(numbers.sum()), kinds - len(hashes), total, rows, word_rows)
    for k in range(ROUNDS + 1 if vocabulary.n else 0):
        shared, steps = shared_value(spark, model), model.steps()
        part = texts if k == 0 else texts.where(F.col("_part") == k - 1)
        part = part.select("text").coalesce(tasks).mapInArrow(_gradients(shared, k == 0), "block int, part binary")
        model.changed(_summed(part, tasks, steps.first if k == 0 else steps.further))
        shared.unpersist()
    return model, after


#: Logarithms are summed as whole multiples of this part, so that sums do not depend on their order.
_PART = float(1 << 36)


def _dealt(shared, parts: int):
    """Rare tokens with the token before, the text's place and whether it trains, packed by part; a part has all occurrences of its tokens."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        v, start, number = loaded(shared), 0, 0
        at_task = TaskContext.get().partitionId() << 33
        held, size = [], 0

        def rows():
            own, last, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            key = mixed64(own)
            order = np.argsort(key)  # parts are ranges of it, so that this brings equal tokens together too
            edge = np.searchsorted(_part_of(key[order], parts), np.arange(parts + 1))
            packed = [(k, b"".join(x[order[a:b]].tobytes() for x in (own, last, mark))) for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if a < b]
            base = pa.array(np.full(len(packed), at_task + start))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), base, pa.array([x for _, x in packed], pa.binary())], names=["part", "base", "packed"])

        for whole in batches:
            for batch in pieces(whole, "text"):
                h, first = tokens(*text_buffers(batch.column(2)))
                at = np.flatnonzero(v.ids(h) == v.n)
                owner, last = before(h, first, at)
                train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                held.append((h[at], last, (2 * (number - start + owner) + train[owner]).astype(np.uint32)))
                size, number = size + len(at), number + batch.num_rows
                if size >= 2 * PART:
                    yield rows()
                    held, size, start = [], 0, number
        if size:
            yield rows()

    return run


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each scrambled hash, which grows with it."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _rare_logs(whole: int):
    """For the texts of a part, the logarithms of smoothed counts of their rare tokens after the tokens before; whole: the rare tokens' occurrences and kinds, and one."""

    def run(table):
        import pyarrow as pa

        parts = []
        for base, raw in zip(table["base"].to_pylist(), table["packed"].to_pylist(), strict=True):
            n = len(raw) // 20
            own, last = np.frombuffer(raw, np.uint64, 2 * n).reshape(2, n)
            parts.append((own, last, np.frombuffer(raw, np.uint32, n, 16 * n), np.full(n, base)))
        own, last, mark, base = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((last, own))
        own, last, mark, row = own[order], last[order], mark[order], base[order] + (mark[order] >> 1)
        new = np.concatenate(([True], own[1:] != own[:-1]))
        kind, pair = np.cumsum(new) - 1, np.cumsum(new | np.concatenate(([True], last[1:] != last[:-1]))) - 1
        train = (mark & 1).astype(float)
        log = np.log10(np.bincount(pair, train)[pair] + RARE_PRIOR * ((np.bincount(kind, train) + 1) / whole)[kind])
        order = np.argsort(row)
        rows, first = np.unique(row[order], return_index=True)
        return pa.table({"row": rows, "v": np.add.reduceat(np.round(log[order] * _PART).astype(np.int64), first)})

    return run


def rare_logs(rows: DataFrame, vocabulary: Words, occurrences: int, whole: int) -> DataFrame:
    """row, and rare_logs: the sum over a text's rare tokens.

    Rows are numbered as in _scored(): both read the same partitions, which for a table of files come in the same order.
    """
    parts = max(PARTS, occurrences // PART)
    dealt = rows.mapInArrow(_dealt(shared_value(rows.sparkSession, vocabulary), parts), "part int, base long, packed binary")
    logs = dealt.groupBy("part").applyInArrow(_rare_logs(whole), "row long, v long")
    return logs.groupBy("row").agg((F.sum("v") / F.lit(_PART)).alias("rare_logs"))


def _scored(shared):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        model, known, logs, contexts, context_logs = loaded(shared)
        number = TaskContext.get().partitionId() << 33
        pair = pa.struct([("h", pa.int64()), ("n", pa.int32())])

        def looked_up(h, known, logs):
            """Whether each hash is known, and its value or 0."""
            if not len(known):
                return np.zeros(len(h), bool), np.zeros(len(h))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            return known[at] == h, np.where(known[at] == h, logs[at], 0.0)

        def by_id(known, logs):
            """The same for tokens that are given by id and hash; the words are looked up once."""
            words = looked_up(model.words.hashes, known, logs)

            def look(ids, h):
                found, value = (v[np.minimum(ids, model.words.n)] for v in words)
                others = np.flatnonzero(ids >= model.words.n)
                found[others], value[others] = looked_up(h[others], known, logs)
                return found, value

            return look

        token, token_before = by_id(known, logs), by_id(contexts, context_logs)
        def lists(h, owner, n):
            """Each text's hashes with their occurrences in it."""
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))[: len(order)]
            times = np.diff(np.append(new, len(order))).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n)))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(times)], fields=list(pair)))

        for whole in batches:
            for batch in pieces(whole, "text"):
                h, first = tokens(*text_buffers(batch.column(2)))
                seen, n = Seen(model.words, h, first), batch.num_rows
                owner = np.repeat(np.arange(n), np.diff(first))
                chance = model.log_chances(seen) / np.log(10)
                rare = np.flatnonzero(seen.ids == model.words.n)
                last = seen.hashes[0][rare]
                found, value = token(seen.ids, h)
                near, before_value = token_before(seen.back[0][rare], last)
                add = lambda v, owner=owner, n=n: np.bincount(owner, v, minlength=n)
                columns = [number + np.arange(n), np.diff(first), add(found).astype(np.int64), add(value), add(chance), np.bincount(owner[rare], minlength=n), np.bincount(owner[rare], before_value, minlength=n).astype(float)]
                opened = [lists(h[~found], owner[~found], n), lists(last[~near], owner[rare][~near], n)]
                names = ["doc_id", "held_out", "row", "n_tokens", "n_seen", "seen_logs", "chance", "n_rare", "before_logs", "open", "open_before"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), *opened], names=names)
                number += n

    return run


def scored(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    counts, _ = written(token_counts(train), "lm-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hashes, numbers = frequent(counts, LOOKUP)
    model, after = trained(train, (hashes, numbers), total, kinds)
    befores, times = frequent(after, LOOKUP)
    order, at = np.argsort(hashes), np.argsort(befores)
    shared = shared_value(spark, (model, hashes[order], np.log10(numbers[order] + 1.0), befores[at], np.log10(times[at] / RARE_PRIOR + 1.0)))
    open_ = "array<struct<h:long,n:int>>"
    schema = f"doc_id long, held_out boolean, row long, n_tokens long, n_seen long, seen_logs double, chance double, n_rare long, before_logs double, open {open_}, open_before {open_}"
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    part, _ = written(rows.mapInArrow(_scored(shared), schema), "lm-parts")
    occurrences = part.agg(F.coalesce(F.sum("n_rare"), F.lit(0))).first()[0]
    rare, _ = written(rare_logs(rows, model.words, occurrences, model.rare + model.rare_kinds + 1), "lm-rare")

    def opened(column: str, table: DataFrame, value, n: str, logs: str) -> DataFrame:
        """For each text, the occurrences of its tokens in the column that the table has, and the sum of their values."""
        log = F.round(value * F.lit(_PART)).cast("long") * F.col("n")
        return part.select("row", F.inline(column)).join(table, "h").groupBy("row").agg(F.sum("n").alias(n), (F.sum(log) / F.lit(_PART)).alias(logs))

    out = part.drop("open", "open_before").join(opened("open", counts, F.log10(F.col("c") + 1), "n_open", "open_logs"), "row", "left")
    out = out.join(opened("open_before", after, F.log10(F.col("c") / F.lit(RARE_PRIOR) + 1), "n_before", "open_before_logs"), "row", "left").join(rare, "row", "left")
    out = out.na.fill(0, ["n_open", "open_logs", "open_before_logs", "rare_logs"])
    whole = F.lit(float(np.log10(total + kinds + 1)))
    logs = F.col("seen_logs") + F.col("open_logs")
    score = F.col("chance") + F.col("rare_logs") - F.col("before_logs") - F.col("open_before_logs") - F.col("n_rare") * F.lit(float(np.log10(RARE_PRIOR)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_seen") + F.col("n_open")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * whole).alias("base_score"), score.alias("score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), bucket_of("doc_id", 7) == 2)
