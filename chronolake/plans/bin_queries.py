"""Queries of the binning operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import date_diff
from ..functions.spec import DAY, STRATEGIES
from ..operators.binning import binned, dense
from ..operators.intervals import overlapping
from ..sources.loaders import binned_long
from .roles import SQL_ROLES, measurements, spans, sql_bins, table, users

HOUR = DAY // 24


def _concepts(events: DataFrame) -> DataFrame:
    return events.select("concept").distinct()


def _dense(spark, sf_dir, events, *, length=DAY, count=10, strategy="last", span=False, order=("event_id",)) -> DataFrame:
    obs = users(spark, sf_dir)
    cells = binned(obs, events, length=length, count=count, fields=["value"], strategy=strategy, span=span, order=order)
    return dense(obs, _concepts(events), cells, length=length, count=count, strategy=strategy, fields=["value"])


def point(strategy: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _dense(spark, sf_dir, measurements(spark, sf_dir), strategy=strategy)
        value = F.col("value").cast("bigint" if strategy == "count" else "double")
        return out.select("obs_id", "concept", "interval_step", F.col("is_present").cast("double").alias("is_present"), (F.round(value, 6) if strategy in ("std", "mean") else value).alias("value"))

    return query


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dense(spark, sf_dir, measurements(spark, sf_dir))
    return out.select("obs_id", "concept", "interval_step", "interval_start", "interval_end", F.col("is_present").cast("double").alias("is_present"))


def date_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties within a day go to the later exact time."""
    events = measurements(spark, sf_dir).withColumn("at", F.col("at").cast("date"))
    return _dense(spark, sf_dir, events, order=("exact", "event_id")).select("obs_id", "concept", "interval_step", "value")


def span(side: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spans(spark, sf_dir)
        if side == "end":
            events = events.withColumn("at", F.col("until"))
        out = _dense(spark, sf_dir, events, strategy="count", span=side == "interval")
        return out.select("obs_id", "concept", "interval_step", F.col("is_present").cast("double").alias("is_present"), F.col("value").cast("bigint").alias("value"))

    return query


def right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly right-closed bins of the first two days; the last event of a bin stays."""
    rows = measurements(spark, sf_dir).join(users(spark, sf_dir).select("person_id", "start_date"), "person_id")
    hours = F.timestamp_diff("MICROSECOND", F.col("start_date"), F.col("at")) / F.lit(float(HOUR))
    rows = rows.select(F.col("person_id").alias("record"), F.col("concept").alias("parameter"), hours.alias("hours"), "value", F.struct("at", "event_id").alias("position"))
    return binned_long(rows, length=1.0, count=48).select(F.col("record").alias("person_id"), F.col("parameter").alias("concept"), F.col("step").alias("interval_step"), "value")


def hourly_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """720 hourly bins, only those that have events."""
    cells = binned(users(spark, sf_dir), measurements(spark, sf_dir), length=HOUR, count=720, fields=["value"], strategy="sum", order=("event_id",))
    return cells.select("obs_id", "concept", "interval_step", F.col("is_present").cast("double").alias("is_present"), "value")


def concept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = measurements(spark, sf_dir).where(F.col("concept").isin("click", "purchase"))
    return _dense(spark, sf_dir, events, strategy="max").select("obs_id", "concept", "interval_step", "value")


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the observation's end do not count."""
    obs = users(spark, sf_dir).withColumn("end_date", F.col("start_date") + F.expr("INTERVAL '36' HOUR"))
    cells = binned(obs, measurements(spark, sf_dir), length=DAY, count=5, fields=["value"], strategy="count", clip_to_end=True)
    return cells.select("obs_id", "concept", "interval_step", F.col("value").cast("bigint").alias("value"))


def date_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of each unit between the midnight before a user's first event and an event, and back."""
    rows = measurements(spark, sf_dir).join(users(spark, sf_dir).select("person_id", "start_date"), "person_id")
    units = [date_diff(u, F.col("start_date"), F.col("at")).cast("long").alias(f"{u}s") for u in ("month", "week", "day", "hour", "second")]
    return rows.select("event_id", *units, date_diff("hour", F.col("at"), F.col("start_date")).cast("long").alias("back"))


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the deliveries to its customer, each as many days long as its quantity, that lie in the 30 days from the order on."""
    orders = table(spark, sf_dir, "orders")
    windows = orders.select("o_orderkey", F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("_zero"))
    # all orders: two columns of a small file are many rows, which a broadcast would send through the driver
    customers = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id")).hint("merge")
    lines = table(spark, sf_dir, "lineitem").join(customers, "l_orderkey")
    low = F.col("l_shipdate").cast("timestamp_ntz")
    spans = lines.select("person_id", "l_quantity", low.alias("_low"), (low + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("_high"))
    met = overlapping(windows, spans, width=30 * DAY)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n_spans"), F.sum("l_quantity").alias("quantity"), F.min("_low").alias("first_low"), F.max("_high").alias("last_high"))


QUERIES = {f"bin_point_{s}": point(s) for s in STRATEGIES} | {
    "bin_presence": presence, "bin_point_date_precision": date_precision, "bin_span_start": span("start"), "bin_span_end": span("end"),
    "bin_span_interval": span("interval"), "bin_right_closed": right_closed, "bin_hourly_sparse": hourly_sparse, "bin_concept_filter": concept_filter,
    "bin_clip_to_end": clipped, "date_differences": date_differences, "span_overlaps": span_overlaps,
}

_BIN = f"WITH {SQL_ROLES}, {sql_bins(10, '1 day')}"
_JOINED = "FROM bins x LEFT JOIN measurements m ON x.person_id = m.person_id AND x.concept = m.concept AND m.ts >= x.a AND m.ts < x.b"
_VALUE = {
    "last": "LAST(m.value ORDER BY m.ts, m.event_id)", "first": "FIRST(m.value ORDER BY m.ts, m.event_id)", "mean": "ROUND(AVG(m.value), 6)",
    "median": "CAST(MEDIAN(m.value) AS DOUBLE)", "sum": "CAST(SUM(m.value) AS DOUBLE)", "count": "COUNT(m.value)", "min": "MIN(m.value)", "max": "MAX(m.value)",
    "std": "ROUND(STDDEV_SAMP(m.value), 6)",
}
_KEYS = "x.obs_id, x.concept, x.interval_step"
_PRESENT = "CAST(CASE WHEN COUNT(m.event_id) > 0 THEN 1 END AS DOUBLE) AS is_present"
SQL = {f"bin_point_{s}": f"{_BIN} SELECT {_KEYS}, {_PRESENT}, {v} AS value {_JOINED} GROUP BY {_KEYS}" for s, v in _VALUE.items()}
SQL["bin_point_mode"] = f"""{_BIN}, counted AS (SELECT {_KEYS}, m.value, COUNT(*) AS n {_JOINED} WHERE m.value IS NOT NULL GROUP BY {_KEYS}, m.value),
best AS (SELECT obs_id, concept, interval_step, value, row_number() OVER (PARTITION BY obs_id, concept, interval_step ORDER BY n DESC, value) AS r FROM counted),
present AS (SELECT {_KEYS}, {_PRESENT} {_JOINED} GROUP BY {_KEYS})
SELECT p.*, b.value FROM present p LEFT JOIN best b ON b.r = 1 AND p.obs_id = b.obs_id AND p.concept = b.concept AND p.interval_step = b.interval_step"""
SQL["bin_presence"] = f"{_BIN} SELECT {_KEYS}, x.a AS interval_start, x.b AS interval_end, {_PRESENT} {_JOINED} GROUP BY {_KEYS}, x.a, x.b"
SQL["bin_point_date_precision"] = f"""{_BIN} SELECT {_KEYS}, LAST(m.value ORDER BY m.ts, m.event_id) AS value
FROM bins x LEFT JOIN measurements m ON x.person_id = m.person_id AND x.concept = m.concept AND CAST(m.ts AS DATE) >= x.a AND CAST(m.ts AS DATE) < x.b GROUP BY {_KEYS}"""


def _span_sql(condition: str) -> str:
    return f"{_BIN} SELECT {_KEYS}, {_PRESENT}, COUNT(m.value) AS value FROM bins x LEFT JOIN spans m ON x.person_id = m.person_id AND x.concept = m.concept AND ({condition}) GROUP BY {_KEYS}"


SQL["bin_span_start"] = _span_sql("m.ts >= x.a AND m.ts < x.b")
SQL["bin_span_end"] = _span_sql("m.until >= x.a AND m.until < x.b")
SQL["bin_span_interval"] = _span_sql("m.ts >= x.a AND m.ts < x.b OR m.until >= x.a AND m.until < x.b OR (m.ts < x.a AND m.until >= x.b)")
SQL["bin_right_closed"] = f"""WITH {SQL_ROLES}, steps AS (SELECT unnest(range(48)) AS i),
timed AS (SELECT m.*, u.start_date FROM measurements m JOIN users u USING (person_id) WHERE m.ts <= u.start_date + INTERVAL 48 HOUR)
SELECT person_id, concept, CAST(i AS INTEGER) AS interval_step, LAST(value ORDER BY ts, event_id) AS value
FROM timed, steps WHERE (ts > start_date + i * INTERVAL 1 HOUR OR i = 0) AND ts <= start_date + (i + 1) * INTERVAL 1 HOUR
GROUP BY person_id, concept, i"""
SQL["bin_hourly_sparse"] = f"""WITH {SQL_ROLES}, {sql_bins(720, '1 hour')}
SELECT {_KEYS}, {_PRESENT}, CAST(SUM(m.value) AS DOUBLE) AS value {_JOINED.replace("LEFT JOIN", "JOIN")} GROUP BY {_KEYS}"""
SQL["bin_concept_filter"] = f"{_BIN} SELECT {_KEYS}, MAX(m.value) AS value {_JOINED} WHERE x.concept IN ('click', 'purchase') GROUP BY {_KEYS}"
SQL["bin_clip_to_end"] = f"""WITH {SQL_ROLES}, {sql_bins(5, '1 day')} SELECT {_KEYS}, COUNT(m.value) AS value
{_JOINED.replace("LEFT JOIN", "JOIN")} JOIN users u ON u.obs_id = x.obs_id WHERE m.ts <= u.start_date + INTERVAL 36 HOUR GROUP BY {_KEYS}"""
SQL["date_differences"] = f"""WITH {SQL_ROLES} SELECT event_id, {", ".join(f"date_diff('{u}', start_date, ts) AS {u}s" for u in ("month", "week", "day", "hour", "second"))}, date_diff('hour', ts, start_date) AS back
FROM measurements JOIN users USING (person_id)"""

SQL["span_overlaps"] = """WITH spans AS (SELECT o_custkey, l_quantity, CAST(l_shipdate AS TIMESTAMP) AS low, CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_quantity AS INTEGER)) AS high FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) AS n_spans, sum(l_quantity) AS quantity, min(low) AS first_low, max(high) AS last_high FROM orders o JOIN spans s ON s.o_custkey = o.o_custkey
AND low < CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY AND high >= CAST(o_orderdate AS TIMESTAMP) GROUP BY o_orderkey"""
