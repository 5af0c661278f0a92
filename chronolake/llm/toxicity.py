"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Only documents are labelled.  A sentence is toxic with p = sigmoid(weights of its features + bias),
a document with 1 - prod(1 - p); the weights are fitted to the documents' labels and then also
say which sentences offend.  The sample's documents are weighted back to the classes' shares among
all training labels.  Features are a sentence's distinct words and beginnings of words, as
far as they are clearly commoner in toxic documents of the sample.  Sentences end at . ! ? and
line feeds.

Defined results: a null or empty text has no sentence and score 0; labels other than 0 and 1 and
labels of unknown documents are ignored; repeated labels of a document count once, as 1 if any says
so; with no toxic label in the sample all scores are 0; an empty table gives an empty result;
further columns pass through located() unless they are named score or offending, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded, pieces, shared_value, table, text_buffers
from .docstats import held_out, labelled_sample
from .wordscan import ALNUM, Hashed, words

#: Labelled documents of each class, at most, that the model is fitted to.
SAMPLE = 5_000
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: A feature must be in so many of the sample's documents, so many standard errors and so many
#: times commoner in toxic ones.
LEAST, SIGNIFICANT, LIFT = 4, 4.5, 4.0
ROUNDS, RATE, DECAY = 150, 0.15, 1e-5
#: Weights smaller than this are dropped from the model.
SMALL = 0.02
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentences(body: np.ndarray, offsets: np.ndarray):
    """Words' sentences, the sentences' texts, the words' bounds, and (word, feature hash) pairs.

    Sentences without words do not count; sentence numbers run through all texts.
    """
    low, starts, stops, h, first = words(body, offsets, ALNUM)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, starts, stops, none, h
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = np.cumsum(_END[body])[starts]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (ends[1:] != ends[:-1])))
    hashed, word, feature = Hashed(low), [np.arange(len(h))], [h]
    for size in BEGINNINGS:
        long = np.flatnonzero(stops - starts > size)
        word.append(long)
        feature.append(hashed.ranges(starts[long], starts[long] + size) + np.uint64(size))
    return np.cumsum(new) - 1, text[new], starts, stops, np.concatenate(word), np.concatenate(feature)


def distinct_pairs(sentence: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(sentence * n_features + feature)
    return key // n_features, key % n_features


class NoisyOr:
    """Feature hashes (sorted) with weights, and the bias of a sentence."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def chances(self, body: np.ndarray, offsets: np.ndarray):
        """Each sentence's probability, its text, and the byte range it covers."""
        number, text, starts, stops, word, h = sentences(body, offsets)
        if not len(text):
            return np.zeros(0), text, np.zeros(0, np.int64), np.zeros(0, np.int64)
        z = np.full(len(text), self.bias)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == h
            s, f = distinct_pairs(number[word[hit]], at[hit], len(self.vocabulary))
            z += np.bincount(s, self.weights[f], minlength=len(text))
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        last = np.concatenate((first[1:], [len(number)])) - 1
        return 1 / (1 + np.exp(-z)), text, starts[first], stops[last]

    def score(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p, text, _, _ = self.chances(body, offsets)
        clean = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(offsets) - 1)
        return 1 - np.exp(clean)


def _feature_documents(batches):
    """Features with the numbers of toxic and of other documents that they are in."""
    import pyarrow as pa

    for whole in batches:
        for batch in pieces(whole, "text"):
            y = np.array(batch.column(1)).astype(np.int64)
            number, text, _, _, word, h = sentences(*text_buffers(batch.column(0)))
            kinds, feature = np.unique(h, return_inverse=True)
            doc, seen = distinct_pairs(text[number[word]], feature, max(len(kinds), 1))
            bad = np.bincount(seen, y[doc], minlength=len(kinds)).astype(np.int64)
            both = np.bincount(seen, minlength=len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(both - bad)], names=["feature", "bad", "good"])


def selected(sample: DataFrame, bad_total: int, good_total: int) -> np.ndarray:
    """Hashes, sorted, of the features that are clearly commoner in toxic documents."""
    counts = sample.select("text", "label").mapInArrow(_feature_documents, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    in_bad, in_good = F.col("bad") / F.lit(float(bad_total)), F.col("good") / F.lit(float(good_total))
    each = (F.col("bad") + F.col("good")) / F.lit(float(bad_total + good_total))
    error = F.sqrt(each * (1 - each) * F.lit(1 / bad_total + 1 / good_total)) + 1e-12
    chosen = counts.where((F.col("bad") + F.col("good") >= LEAST) & (in_bad - in_good >= SIGNIFICANT * error) & (in_bad >= LIFT * in_good))
    return np.sort(np.array(chosen.select("feature").toArrow().column(0)).view(np.uint64))


def _instances(vocabulary: np.ndarray):
    """Per document: label, weight, sentences without a chosen feature, and the others' (sentence, feature) pairs."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole, "text"):
                n = batch.num_rows
                number, text, _, _, word, h = sentences(*text_buffers(batch.column(0)))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                s, f = distinct_pairs(number[word[hit]], at[hit], len(vocabulary))
                doc = text[s]
                plain = np.bincount(text, minlength=n) - np.bincount(text[np.unique(s)], minlength=n)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int64))) for v in (s, f)]
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), batch.column(3), pa.array(plain), *lists], names=["doc_id", "label", "weight", "plain", "s", "f"])

    return run


def fit_noisy_or(vocabulary: np.ndarray, y: np.ndarray, plain: np.ndarray, text: np.ndarray, s: np.ndarray, f: np.ndarray, weight: np.ndarray | None = None) -> NoisyOr:
    """Full-batch Adam on the documents' weighted log loss.

    text names the document of each sentence with features, plain counts each document's others;
    weight has what each document stands for, 1 by default.
    """
    n, m = len(vocabulary), len(text)
    share = np.full(len(y), 1 / len(y)) if weight is None else weight / weight.sum()
    w, b = np.zeros(n), -6.0
    m1, m2, g1, g2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        z = b + np.bincount(s, w[f], minlength=m)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        total = np.bincount(text, np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, b)
        # d loss / d total: 1 for clean documents, -exp(-total) / (1 - exp(-total)) for toxic ones
        slope = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) * share
        back = slope[text] * p
        gw, gb = np.bincount(f, back[s], minlength=n) + DECAY * w, back.sum() + (slope * plain).sum() * p0
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw**2
        g1, g2 = 0.9 * g1 + 0.1 * gb, 0.99 * g2 + 0.01 * gb**2
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w -= RATE * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        b -= 0.3 * RATE * (g1 / c1) / (np.sqrt(g2 / c2) + 1e-6)
    keep = np.abs(w) >= SMALL
    return NoisyOr(vocabulary[keep], w[keep], float(b))


def fitted(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> NoisyOr:
    """The model of the labels' toxicity, from the documents that the condition train selects."""
    rows = labelled_sample(docs, labels, "toxic", sample, train)
    bad, both, share = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*"), F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()
    if not 0 < bad < both:
        return NoisyOr(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    vocabulary = selected(rows, bad, both - bad)
    if not len(vocabulary):
        return NoisyOr(vocabulary, np.zeros(0), float(np.log(share)))
    got = rows.select("text", "label", "doc_id", "weight").mapInArrow(_instances(vocabulary), "doc_id long, label int, weight double, plain long, s array<long>, f array<long>")
    got = got.toArrow().sort_by([("doc_id", "ascending"), ("plain", "ascending")])
    counts = np.array(got.column("s").combine_chunks().value_lengths())
    owner = np.repeat(np.arange(got.num_rows), counts)
    s, f = (np.array(got.column(c).combine_chunks().flatten()) for c in "sf")
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])))[: len(s)]
    return fit_noisy_or(vocabulary, np.array(got.column("label")).astype(float), np.array(got.column("plain")), owner[new], np.cumsum(new) - 1, f, np.array(got.column("weight")))


def _locate(model, text: str, whole_rows: bool, least: float):
    def run(batches):
        import pyarrow as pa

        known = loaded(model)
        for whole in batches:
            for batch in pieces(whole, text):
                names = batch.schema.names
                body, offsets = text_buffers(batch.column(names.index(text)))
                keep = [k for k, c in enumerate(names) if whole_rows or c != text]
                arrays, out = [batch.column(k) for k in keep], [names[k] for k in keep]
                arrays.append(pa.array(known.score(body, offsets)))
                out.append("score")
                if whole_rows:
                    p, owner, start, stop = known.chances(body, offsets)
                    point = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
                    spans = [[] for _ in range(batch.num_rows)]
                    for k in np.flatnonzero(p >= least):
                        d = int(owner[k])
                        base = int(point[offsets[d]])
                        spans[d].append({"first": int(point[start[k]]) - base, "stop": int(point[stop[k]]) - base, "score": float(p[k])})
                    arrays.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))))
                    out.append("offending")
                yield pa.RecordBatch.from_arrays(arrays, names=out)

    return run


def located(docs: DataFrame, model: NoisyOr, text: str = "text", least: float = 0.3, whole_rows: bool = True) -> DataFrame:
    """docs with score and offending: code point ranges of sentences with at least that chance."""
    docs = docs.drop("score", "offending")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if whole_rows or f.name != text]
    more = ["score double"] + ["offending array<struct<first:long,stop:long,score:double>>"] * whole_rows
    bound = shared_value(docs.sparkSession, model)
    return docs.mapInArrow(_locate(bound, text, whole_rows, least), ", ".join(kept + more))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = located(docs, fitted(docs, labels, ~held_out(4, 2)), whole_rows=False)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
