"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models over characters, one of accepted and one of rejected
URLs, use the longest context seen and blend its estimate with the next shorter one by the number
of different characters seen after it.  A URL's score is the difference of the models'
log-likelihoods per character.  The threshold is calibrated on URLs of both kinds kept out of the training:
it lets a given share of the accepted ones pass, and where the same share of the rejected ones
scores lower it lies half way between.  By default the URLs that rules decide train the models.

Defined results: only URLs that no rule decides get a score, others null; a null URL, or one without
``://``, has an empty host and path, fits no rule and, if null, gets score 0; the score of an empty text is 0; a score at or above the threshold is allowed; with no
training URL of one kind the threshold is 0 and all scores are 0, so that all is allowed; an
empty table gives an empty result; further columns pass through judged() unless they are named
host, path, rule, verdict or score, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded, shared_value, table

#: (action, rule); a rule is a host and the beginning of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Training URLs of each kind, at most; every eighth of them calibrates.
SAMPLE = 20_000
ORDER, PASS = 5, 0.98


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """host and path columns."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    out = pages.drop("host", "path").withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    host = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return out.withColumn("path", path).withColumn("host", host).drop("_rest", "_host")


def decided(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action, as conditional expressions over host and path."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, action


class MarkovModel:
    """Counts of characters after contexts of up to ORDER characters."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order = order
        self.after: dict[str, dict[str, int]] = {}
        alphabet = set()
        for u in urls:
            text = self.framed(u)
            for i in range(order, len(text)):
                alphabet.add(text[i])
                for k in range(order + 1):
                    seen = self.after.setdefault(text[i - k : i], {})
                    seen[text[i]] = seen.get(text[i], 0) + 1
        self.uniform = 1 / (len(alphabet) + 1)
        self.total = {c: sum(v.values()) for c, v in self.after.items()}

    def framed(self, url: str) -> str:
        return "\x02" * self.order + url + "\x03"

    def chance(self, context: str, char: str) -> float:
        p = self.uniform
        for k in range(self.order + 1):  # from the empty context to the longest that was seen
            seen = self.after.get(context[len(context) - k :])
            if seen is None:
                break
            different = len(seen)
            p = (seen.get(char, 0) + different * p) / (self.total[context[len(context) - k :]] + different)
        return p

    def log_likelihood(self, url: str) -> float:
        text = self.framed(url)
        return sum(math.log(self.chance(text[i - self.order : i], text[i])) for i in range(self.order, len(text)))


class Ratio:
    """Both models and the threshold of their length-normalised difference."""

    def __init__(self, accepted: list[str], rejected: list[str], share: float = PASS):
        held = [[u for k, u in enumerate(v) if k % 8 == 7] or v for v in (accepted, rejected)]
        accepted, rejected = ([u for k, u in enumerate(v) if k % 8 != 7] for v in (accepted, rejected))
        self.usable, self.threshold = bool(accepted and rejected), 0.0
        #: Shares of held-out accepted URLs that are rejected, and of rejected ones that are accepted.
        self.errors = (0.0, 0.0)
        if self.usable:
            self.good, self.bad = MarkovModel(accepted), MarkovModel(rejected)
            good, bad = (sorted(self.score(u) for u in v) for v in held)
            low, high = good[int((1 - share) * len(good))], bad[min(int(share * len(bad)), len(bad) - 1)]
            self.threshold = (low + high) / 2 if high < low else low
            self.errors = sum(s < self.threshold for s in good) / len(good), sum(s >= self.threshold for s in bad) / len(bad)

    def score(self, url: str | None) -> float:
        if not self.usable or not url:
            return 0.0
        return (self.good.log_likelihood(url) - self.bad.log_likelihood(url)) / len(url)


def fitted(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> Ratio:
    """Models of the URLs that the rules allow and block, from at most ``sample`` of each."""
    _, action = decided(rules)
    known = with_parts(pages.select("url")).select("url", action.alias("action")).where("action IS NOT NULL").distinct()
    lists = {}
    for act in ("allow", "block"):
        rows = known.where(F.col("action") == act).orderBy(F.xxhash64("url"), "url").limit(sample).select("url").toArrow()
        lists[act] = rows.column(0).to_pylist()
    return Ratio(lists["allow"], lists["block"])


def _scores(model):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ratio = loaded(model)
        for batch in batches:
            at = batch.schema.names.index("_url")
            kinds = batch.column(at).dictionary_encode()
            score = pa.array([ratio.score(u) for u in kinds.dictionary.to_pylist()], pa.float64())
            got = pc.fill_null(score.take(kinds.indices), 0.0)
            decided = batch.column(batch.schema.names.index("verdict")).is_valid()
            got = pc.if_else(decided, pa.scalar(None, pa.float64()), got)
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at] + [got], names=[n for n in batch.schema.names if n != "_url"] + ["score"])

    return run


def judged(pages: DataFrame, model: Ratio, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score; the models judge what no rule decides."""
    rule, action = decided(rules)
    rows = with_parts(pages.drop("rule", "verdict", "score")).withColumn("rule", rule).withColumn("verdict", action).withColumn("_url", F.when(F.col("verdict").isNull(), F.col("url")))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_url"]
    out = rows.mapInArrow(_scores(shared_value(pages.sparkSession, model)), ", ".join([*kept, "score double"]))
    allowed = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce("verdict", allowed))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, fitted(pages)).select("page_id", "host", "path", "rule", "verdict", "score")
