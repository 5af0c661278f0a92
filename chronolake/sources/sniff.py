"""Dialect and types of CSV files, from their head and a check of the rest.

The head, HEAD lines at most, is parsed in every dialect of a small family; the one whose rows agree best on their number of fields,
and have most of them, is taken.  Types come from the same lines.  All columns are then read as text by one scan and cast;
one aggregation over the file tells for each column whether a type from the head fails further down, and the type
is widened until none does, so that what comes out does not depend on the head.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a file's head.
HEAD = 1000
SEPARATORS, QUOTES = (",", "\t", ";", "|"), ('"', "'")
#: Texts that are no value, and those of flags.
NULLS, FLAGS = ("",), ("true", "false")
#: Types from the narrowest on; a value of one is a value of those behind the arrow, too.
WIDER = {"int": "bigint", "bigint": "double", "double": "string", "boolean": "string", "date": "timestamp_ntz", "timestamp_ntz": "string"}
_PATTERNS = {
    "int": r"[+-]?\d{1,9}", "bigint": r"[+-]?\d{1,18}", "double": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Nn]a[Nn]",
    "boolean": "(?i:true|false)", "date": r"\d{4}-\d{2}-\d{2}", "timestamp_ntz": r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?",
}


@dataclass(frozen=True)
class Dialect:
    """How a file separates and quotes its fields; escape is the quote itself where quotes are doubled."""

    sep: str = ","
    quote: str = '"'
    escape: str = '"'
    header: bool = True
    multiline: bool = False

    def options(self) -> dict:
        return {"sep": self.sep, "quote": self.quote, "escape": self.escape, "header": str(self.header).lower(), "multiLine": str(self.multiline).lower(), "nullValue": "", "mode": "PERMISSIVE"}

    def rows(self, text: str) -> list[list[str]]:
        doubled = self.escape == self.quote
        reader = csv.reader(io.StringIO(text), delimiter=self.sep, quotechar=self.quote, doublequote=doubled, escapechar=None if doubled else self.escape)
        return [r for r in reader if r]


def head_of(spark: SparkSession, path: str | list[str]) -> str:
    """The first lines of one file, by a scan that stops there; without a byte-order mark."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).limit(HEAD).collect()
    return "\n".join(r["value"] for r in lines if r["file"] == lines[0]["file"]).removeprefix("﻿")


def _kind(values: list[str]) -> str:
    """The narrowest type of texts; text if there are none."""
    values = [v for v in values if v not in NULLS]
    for kind in ("boolean", "int", "bigint", "double", "date", "timestamp_ntz"):
        if values and all(re.fullmatch(_PATTERNS[kind], v) for v in values):
            return kind
    return "string"


def sniffed(text: str) -> Dialect:
    """The dialect in which a head's rows agree best."""
    best, score = Dialect(), (-1.0, 0.0, 0)
    for sep, quote in itertools.product(SEPARATORS, QUOTES):
        for escape in (quote, "\\"):
            d = Dialect(sep, quote, escape)
            try:
                rows = d.rows(text)
            except csv.Error:
                continue
            if not rows:
                continue
            # the last row of a head may be cut
            counts = Counter(len(r) for r in (rows[:-1] if len(rows) > 2 else rows))
            width, often = max(counts.items(), key=lambda c: (c[1], c[0]))
            agree = often / sum(counts.values())
            loose = sum(f.count('"') + f.count("\\") for r in rows for f in r) / max(len(text), 1)
            now = (round(agree if width > 1 else agree / 4, 2), -loose, width)
            if now > score:
                best, score = d, now
    rows = best.rows(text)
    multiline = any("\n" in f for r in rows[:-1] for f in r)
    return Dialect(best.sep, best.quote, best.escape, _has_header(rows), multiline)


def _has_header(rows: list[list[str]]) -> bool:
    """Names: different ones, none of them empty or a number or date; a file of text only has them by default."""
    if not rows:
        return True
    first = rows[0]
    return len(set(first)) == len(first) and all(f.strip() and _kind([f.strip()]) == "string" for f in first)


def read_sniffed(spark: SparkSession, path: str | list[str], *, sep: str | None = None, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file as its own dialect and types have it; named columns stay text. Columns without names are _c0, _c1, ..."""
    text = head_of(spark, path)
    dialect = sniffed(text)
    if sep is not None and sep != dialect.sep:
        dialect = Dialect(sep, dialect.quote, dialect.escape, dialect.header, dialect.multiline)
    rows = dialect.rows(text)
    names = [n.strip() for n in rows[0]] if rows and dialect.header else [f"_c{k}" for k in range(max((len(r) for r in rows), default=0))]
    if not names:
        return spark.createDataFrame([], "")
    body = rows[dialect.header :][: HEAD - 1]
    body = body[:-1] if len(body) >= HEAD - 2 else body
    kinds = {n: "string" if n.lower() in text_columns else _kind([r[k] for r in body if k < len(r)]) for k, n in enumerate(names)}
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).options(**dialect.options()).csv(path)
    while open_ := {n: k for n, k in kinds.items() if k != "string"}:
        fails = raw.agg(*(F.count_if(F.col(f"`{n}`").isNotNull() & ~F.coalesce(_fits(n, k), F.lit(False))).alias(f"_{j}") for j, (n, k) in enumerate(open_.items()))).first()
        wrong = [n for j, n in enumerate(open_) if fails[j]]
        if not wrong:
            break
        kinds |= {n: WIDER[kinds[n]] for n in wrong}
    return raw.select(*(F.col(f"`{n}`").try_cast(k).alias(n) for n, k in kinds.items()))


def _fits(name: str, kind: str):
    return F.col(f"`{name}`").rlike(f"^({_PATTERNS[kind]})$") & F.col(f"`{name}`").try_cast(kind).isNotNull()
