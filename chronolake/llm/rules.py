"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Each rule is a conjunction of thresholds.  It is grown on two thirds of the documents that earlier
rules left, by information gain against the bad label, and pruned on the last third; documents
that it covers are removed and the next is learned.  Documents are weighted back to the classes'
shares among all labels.  The list is emitted as ordered Spark conditional expressions.  A fixed
base rule comes first.  Of cuts of equal gain the first one tried is taken, in the order of the statistics.

Defined results: a null text has no words; a text without words fails the base; with no bad
labels the list is empty and keeps what passes the base; an empty table gives an empty result;
further columns do not matter, they are dropped by op3_quality_rules() and pass through measured().
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .docstats import SHARES, labelled_sample, measured

#: Labelled documents of each class, at most, that rules are learned from.
SAMPLE = 10_000
#: Most rules, most thresholds in a rule, and thresholds tried for each statistic.
RULES, CONDITIONS, CUTS = 12, 4, 32
#: A pruned rule must be right about this share of what it covers, and cover this many.
PRECISION, COVER = 0.97, 3
INPUTS = SHARES
Rule = list[tuple[str, str, float]]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(x[INPUTS[0]]), bool)
    for name, sign, cut in rule:
        out &= x[name] > cut if sign == ">" else x[name] <= cut
    return out


def _gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    if bad == 0:
        return 0.0
    return bad * (np.log2(bad / (bad + good)) - np.log2(bad_before / (bad_before + good_before)))


def _grown(x: dict, bad: np.ndarray, weight: np.ndarray) -> Rule:
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (~bad & inside).any():
        best, pick = 0.0, None
        b0, g0 = weight[bad & inside].sum(), weight[~bad & inside].sum()
        for name in INPUTS:
            v = x[name][inside]
            w, y = weight[inside], bad[inside]
            wy = w * y
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[:-1], method="lower")):
                above = v > cut
                for sign, part in ((">", above), ("<=", ~above)):
                    b = wy @ part
                    gain = _gain(b, w @ part - b, b0, g0)
                    if gain > best + 1e-9:
                        best, pick = gain, (name, sign, float(cut))
        if pick is None:
            break
        rule.append(pick)
        inside &= covers([pick], x)
    return rule


def _worth(rule: Rule, x: dict, bad: np.ndarray, weight: np.ndarray) -> float:
    inside = covers(rule, x)
    b, n = weight[bad & inside].sum(), weight[inside].sum()
    return (b + 1) / (n + 2) if n else 0.0


def learned(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray | None = None) -> list[Rule]:
    """Ordered rules for the bad label; weight has what each row stands for, 1 by default."""
    out: list[Rule] = []
    weight = np.ones(len(bad)) if weight is None else weight * (len(weight) / max(weight.sum(), 1e-9))
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(out) < RULES and (bad & left).any():
        grow, prune = left & ~third, left & third
        if not (bad & grow).any():
            break
        rule = _grown({k: v[grow] for k, v in x.items()}, bad[grow], weight[grow])
        held = {k: v[prune] for k, v in x.items()}
        while len(rule) > 1 and _worth(rule[:-1], held, bad[prune], weight[prune]) >= _worth(rule, held, bad[prune], weight[prune]):
            rule = rule[:-1]
        inside = covers(rule, x) & left if rule else np.zeros(len(bad), bool)
        if inside.sum() < COVER or weight[bad & inside].sum() < PRECISION * weight[inside].sum():
            break
        out.append(rule)
        left &= ~inside
    return out


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, cut in rule:
        out = out & (F.col(name) > F.lit(cut) if sign == ">" else F.col(name) <= F.lit(cut))
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(condition(rule), k) if out is None else out.when(condition(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    rows = measured(labelled_sample(docs, labels, "quality", sample, F.lit(True))).toPandas()
    hashed = lambda i: zlib.crc32(i.encode()) if isinstance(i, str) else (int(i) * 2654435761) & 0xFFFFFFFF
    rows = rows.assign(_h=rows["doc_id"].map(hashed)).sort_values(["_h", "doc_id"], kind="stable")
    return learned({c: rows[c].to_numpy().astype(float) for c in INPUTS}, rows["label"].to_numpy() == 0, rows["weight"].to_numpy())


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with base_failed, rule (number of the deciding rule, 0 for none) and kept."""
    rows = measured(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns({"base_failed": base, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
