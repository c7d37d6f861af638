"""All queries of the telemetry and relational operators, with SQL equivalents.

The driver's tables stand in for telemetry: events are a packet stream (user = console,
ts = clock, value = channel, props.k = counter), orders are laps (total price = time),
customers are sessions (market segment = category), nations circuits, parts cars,
lineitem ticks of a lap and embeddings positions. Each query has its SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.functions import bits, text
from lapforge.operators import align, detectors, ranges, relational, spatial, stats, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def laps(spark: SparkSession, d: str) -> DataFrame:
    """orders as laps, with the session's circuit and category; times are whole cents, so sums are exact."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("time_c"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


LAPS = """(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS time_c,
  c_custkey, c_nationkey, c_mktsegment, n_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """events as packets: per user in order of event_id, value in hundredths, k from the JSON props."""
    e = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    return e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"), k.cast("long").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


EVENTS = """(SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bests_gap(spark, d)


# --- bests, rollups and listings ---------------------------------------------------


@query(f"""SELECT n_name, c_mktsegment, o_orderkey, time_c, laps FROM (SELECT *,
  row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY time_c, o_orderkey) AS r,
  CAST(count(*) OVER (PARTITION BY n_name, c_mktsegment) AS BIGINT) AS laps
  FROM {LAPS} WHERE o_orderstatus <> 'P') WHERE r = 1""")
def bests_board(spark, d):
    return relational.personal_bests(laps(spark, d).where("o_orderstatus <> 'P'"), ["n_name", "c_mktsegment"], "time_c", "o_orderkey")


@query(f"""SELECT n_name, o_orderkey, time_c, laps, c_mktsegment FROM (SELECT *,
  row_number() OVER (PARTITION BY n_name ORDER BY time_c, o_orderkey) AS r,
  CAST(count(*) OVER (PARTITION BY n_name) AS BIGINT) AS laps FROM {LAPS}) WHERE r = 1 AND c_mktsegment = 'BUILDING'""")
def bests_board_category(spark, d):
    return relational.personal_bests(laps(spark, d), ["n_name"], "time_c", "o_orderkey", ["c_mktsegment"]).where("c_mktsegment = 'BUILDING'")


@query(f"""SELECT n_name, o_orderkey, time_c - min(time_c) OVER (PARTITION BY n_name) AS gap FROM {LAPS}""")
def bests_gap(spark, d):
    return relational.gap_to_best(laps(spark, d), ["n_name"], "time_c").select("n_name", "o_orderkey", "gap")


@query(f"""SELECT o_orderkey, time_c FROM {LAPS} WHERE n_nationkey = 7 AND c_mktsegment = 'MACHINERY' ORDER BY time_c, o_orderkey LIMIT 1""")
def class_best(spark, d):
    one = laps(spark, d).where("n_nationkey = 7 and c_mktsegment = 'MACHINERY'")
    return one.orderBy("time_c", "o_orderkey").limit(1).select("o_orderkey", "time_c")


@query(f"""SELECT o_orderkey, time_c FROM {LAPS} ORDER BY time_c, o_orderkey DESC LIMIT 20""")
def top_n_laps(spark, d):
    return relational.top_laps(laps(spark, d), "time_c", "o_orderkey", 20).select("o_orderkey", "time_c")


@query("""SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS laps, best, status FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, min(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS best,
  max(o_orderstatus) AS status FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def session_rollup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", cents("o_totalprice").alias("t"))
    out = relational.session_rollup(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "t", F.col("o_orderstatus") != "P", "o_orderstatus")
    return out.withColumnRenamed("category", "status")


@query("""SELECT CAST(count(*) AS BIGINT) AS laps, min(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS best,
  CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS total FROM orders""")
def session_totals(spark, d):
    t = cents("o_totalprice")
    return table(spark, d, "orders").agg(F.count("*").alias("laps"), F.min(F.when(F.col("o_orderstatus") != "P", t)).alias("best"), F.coalesce(F.sum(t), F.lit(0)).alias("total"))


@query("""SELECT 'orders' AS name, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n UNION ALL SELECT 'customer', CAST((SELECT count(*) FROM customer) AS BIGINT)""")
def table_counts(spark, d):
    one = lambda name: table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("orders").unionAll(one("customer"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END, o_orderkey) AS r FROM orders WHERE o_totalprice >= 1000) WHERE r = 1""")
def best_candidate_per_session(spark, d):
    out = relational.best_candidate(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", "o_totalprice", 1000)
    return out.select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_ids(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_unlisted(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT coalesce(s.k, c.k) AS nationkey, n_name, CAST(coalesce(suppliers, 0) AS BIGINT) AS suppliers, CAST(coalesce(customers, 0) AS BIGINT) AS customers
  FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c ON s.k = c.k
  LEFT JOIN nation ON n_nationkey = coalesce(s.k, c.k)""")
def full_outer_overview(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return s.join(c, "nationkey", "full").join(n, "nationkey", "left").select("nationkey", "n_name", zero("suppliers"), zero("customers"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*)
  THEN CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) END AS total FROM lineitem GROUP BY l_orderkey""")
def complete_race_time(spark, d):
    return relational.complete_set_time(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.round("l_quantity").cast("long"))


@query("""SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY ALL""")
def label_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size <= 10 UNION ALL
  SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10)""")
def union_distinct_priority(spark, d):
    p = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return relational.union_by_priority(p, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("""SELECT p_partkey, array_to_string(list_sort(list_intersect(string_split(p_type, ' '), ['STEEL', 'BRASS', 'ECONOMY'])), ',') AS kept,
  array_to_string(list_sort(list_filter(list_distinct(string_split(p_type, ' ')), lambda x: NOT list_contains(['STEEL', 'BRASS', 'ECONOMY'], x))), ',') AS other FROM part""")
def array_set_ops(spark, d):
    words, known = F.split("p_type", " "), F.array(F.lit("STEEL"), F.lit("BRASS"), F.lit("ECONOMY"))
    join = lambda a: F.array_join(F.sort_array(a), ",")
    return table(spark, d, "part").select("p_partkey", join(F.array_intersect(words, known)).alias("kept"), join(F.array_except(words, known)).alias("other"))


# --- windows over a stream ---------------------------------------------------------


@query(f"""SELECT event_id, CASE WHEN g BETWEEN 1 AND 60 THEN g ELSE 1 END AS frames, CASE WHEN g BETWEEN 1 AND 60 THEN g - 1 ELSE 0 END AS dropped
  FROM (SELECT event_id, k - lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM {EVENTS})""")
def gap_integration(spark, d):
    return windows.gap_frames(events(spark, d), ["user_id"], "k", "event_id").select("event_id", "frames", "dropped")


@query(f"""SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS dist, CAST(sum(CASE WHEN r = 1 THEN 0 ELSE k END) OVER w AS BIGINT) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {EVENTS})
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_distance(spark, d):
    e = windows.integrate(events(spark, d), ["user_id"], "event_id", F.col("v"), "dist")
    return windows.integrate(e, ["user_id"], "event_id", F.col("k"), "t", skip_first=True).select("event_id", "dist", "t")


_ISLANDS = f"""(SELECT user_id, g, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT *, sum(CASE WHEN k < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM {EVENTS}) WHERE k < 50 GROUP BY user_id, g)"""


@query(f"SELECT user_id, first, last, n FROM {_ISLANDS} WHERE n >= 3")
def islands_min_len(spark, d):
    return windows.islands(events(spark, d), ["user_id"], "event_id", F.col("k") < 50, 3)


@query(f"SELECT user_id, CAST(count(*) AS BIGINT) AS excursions FROM {_ISLANDS} WHERE n >= 6 GROUP BY user_id")
def excursion_count(spark, d):
    return windows.islands(events(spark, d), ["user_id"], "event_id", F.col("k") < 50, 6).groupBy("user_id").agg(F.count("*").alias("excursions"))


@query(f"""SELECT event_id, CAST(1 + sum(CASE WHEN event_type <> p OR k < q THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session
  FROM (SELECT *, lag(event_type) OVER w AS p, lag(k) OVER w AS q FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def session_boundaries(spark, d):
    w = windows.ordered(["user_id"], "event_id")
    e = events(spark, d)
    starts = (F.lag("event_type").over(w) != F.col("event_type")) | (F.lag("k").over(w) > F.col("k"))
    return windows.segments(e, ["user_id"], "event_id", starts, "session").select("event_id", "session")


@query(f"""SELECT user_id, event_id, k FROM (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {EVENTS}) WHERE k > p AND p > 0 AND v > 0""")
def lap_boundaries(spark, d):
    previous = F.lag("k").over(windows.ordered(["user_id"], "event_id"))
    return events(spark, d).withColumn("p", previous).where("k > p and p > 0 and v > 0").select("user_id", "event_id", "k")


@query(f"""SELECT event_id, excess FROM (SELECT event_id, v - (lag(v, 2) OVER w + lead(v, 2) OVER w) / 2.0 AS excess,
  max(v) OVER (PARTITION BY user_id) - min(v) OVER (PARTITION BY user_id) AS rng FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE excess > 0.35 * rng""")
def spike_lag_lead(spark, d):
    return windows.spikes(events(spark, d), ["user_id"], "event_id", "v").select("event_id", "excess")


@query(f"""SELECT event_id, round((lead(v) OVER w - lag(v) OVER w) / nullif(CAST(lead(us) OVER w - lag(us) OVER w AS DOUBLE), 0) * 1000000, 6) AS rate
  FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def central_difference(spark, d):
    e = windows.central_difference(events(spark, d), ["user_id"], "event_id", "v", F.col("us").cast("double"), "r")
    return e.select("event_id", F.round(F.col("r") * 1000000, 6).alias("rate"))


@query(f"""SELECT event_id, v FROM (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {EVENTS}) WHERE top IS NULL OR v > top""")
def monotone_filter(spark, d):
    return windows.monotone(events(spark, d), ["user_id"], "event_id", "v").select("event_id", "v")


@query(f"""SELECT event_id, CASE WHEN v = hi THEN 'peak' ELSE 'valley' END AS kind FROM (SELECT *, max(v) OVER w AS hi, min(v) OVER w AS lo,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n
  FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE (v = hi OR v = lo) AND r > 5 AND r <= n - 5""")
def local_extrema_candidates(spark, d):
    return windows.extrema_candidates(events(spark, d), ["user_id"], "event_id", "v", 5).select("event_id", "kind")


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM (SELECT *, max(v) OVER w AS hi, min(v) OVER w AS lo,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n
    FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE (v = hi OR v = lo) AND r > 5 AND r <= n - 5),
  t AS (SELECT user_id, min(event_id) AS "at" FROM c GROUP BY user_id UNION ALL SELECT t.user_id, min(c.event_id) FROM t JOIN c ON c.user_id = t.user_id AND c.event_id >= t."at" + 1000 GROUP BY t.user_id, t."at")
SELECT t.user_id, CAST(t."at" AS DOUBLE) AS "at", CAST(i AS BIGINT) AS "row" FROM t JOIN c ON c.user_id = t.user_id AND c.event_id = t."at\"""")
def thinned_extrema(spark, d):
    peaks = windows.extrema_candidates(events(spark, d), ["user_id"], "event_id", "v", 5)
    return windows.thin(peaks, ["user_id"], "event_id", "event_id", 1000)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, k - 50 AS x, CASE WHEN k > 50 THEN 1 ELSE -1 END AS s FROM {EVENTS}),
  h AS (SELECT user_id, i, CASE WHEN abs(x) > 40 THEN i END AS o, s AS now, i AS seen, CAST(NULL AS BIGINT) AS ef, CAST(NULL AS BIGINT) AS el, 0 AS es FROM e WHERE i = 0
    UNION ALL SELECT h.user_id, e.i, CASE WHEN o IS NULL OR (e.s <> now AND abs(e.x) > 40) THEN CASE WHEN abs(e.x) > 40 THEN e.i END WHEN e.s = now AND abs(e.x) >= 20 THEN o WHEN e.i - seen >= 3 THEN NULL ELSE o END,
      CASE WHEN abs(e.x) > 40 AND (o IS NULL OR e.s <> now) THEN e.s ELSE now END, CASE WHEN (abs(e.x) > 40 AND (o IS NULL OR e.s <> now)) OR (o IS NOT NULL AND e.s = now AND abs(e.x) >= 20) THEN e.i ELSE seen END,
      CASE WHEN o IS NOT NULL AND ((e.s <> now AND abs(e.x) > 40) OR (NOT (e.s = now AND abs(e.x) >= 20) AND e.i - seen >= 3)) THEN o END,
      CASE WHEN o IS NOT NULL AND ((e.s <> now AND abs(e.x) > 40) OR (NOT (e.s = now AND abs(e.x) >= 20) AND e.i - seen >= 3)) THEN seen END, now FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)
SELECT user_id, CAST(ef AS BIGINT) AS "first", CAST(el AS BIGINT) AS "last", CAST(es AS INTEGER) AS sign FROM h WHERE ef IS NOT NULL
UNION ALL SELECT user_id, CAST(o AS BIGINT), CAST(seen AS BIGINT), CAST(now AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM h) WHERE r = 1 AND o IS NOT NULL""")
def hysteresis_segments(spark, d):
    e = events(spark, d).withColumn("c", (F.col("k") - 50).cast("double"))
    return windows.hysteresis(e, ["user_id"], "event_id", "c", 40, 20, 3)


@query(f"""SELECT event_id, last_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label
  FROM (SELECT *, CASE WHEN k < 20 THEN event_type END AS l FROM {EVENTS})""")
def forward_fill_label(spark, d):
    e = events(spark, d).withColumn("l", F.when(F.col("k") < 20, F.col("event_type")))
    return windows.forward_fill(e, ["user_id"], "event_id", "l", "label").select("event_id", "label")


# --- statistics --------------------------------------------------------------------


@query(f"""SELECT user_id, round(CASE WHEN sum(w) > 0 THEN 100.0 * sum(CASE WHEN k >= 98 THEN w ELSE 0 END) / sum(w) ELSE 0 END, 6) AS pct FROM (
  SELECT user_id, k, CASE WHEN lag(us) OVER o IS NOT NULL THEN greatest(us - lag(us) OVER o, 0) WHEN lead(us) OVER o IS NOT NULL THEN greatest(lead(us) OVER o - us, 0) ELSE 1 END AS w FROM {EVENTS} WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id""")
def weighted_pct(spark, d):
    e = stats.time_weights(events(spark, d).withColumn("c", F.col("us").cast("double")), ["user_id"], "event_id", "c")
    return e.groupBy("user_id").agg(F.round(stats.weighted_percent("weight", F.col("k") >= 98), 6).alias("pct"))


@query("""SELECT l_returnflag, round(sum(q * p) / sum(q * q), 4) AS slope, round(1 - (sum(p * p) - sum(q * p) / sum(q * q) * sum(q * p)) / sum(p * p), 6) AS r2
  FROM (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS p FROM lineitem) GROUP BY l_returnflag""")
def origin_regression(spark, d):
    slope, r2 = stats.origin_fit("l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(slope, 4).alias("slope"), F.round(r2, 6).alias("r2"))


@query(f"""SELECT user_id, s[CAST(floor(0.85 * len(s)) AS INT) + 1] AS jitter FROM (SELECT user_id, list_sort(list(j)) AS s FROM (
  SELECT user_id, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY event_id)) AS j FROM {EVENTS}) WHERE j IS NOT NULL GROUP BY user_id)""")
def lower_percentile(spark, d):
    jump = F.abs(F.col("v") - F.lag("v").over(windows.ordered(["user_id"], "event_id")))
    e = events(spark, d).withColumn("j", jump)
    return stats.lower_percentile(e, ["user_id"], F.col("j"), 0.85, "jitter")


@query(f"""SELECT k, median(v) AS median, round(stddev_pop(v), 4) AS spread, CAST(count(*) AS BIGINT) AS n FROM {EVENTS} GROUP BY k HAVING count(*) >= 2""")
def median_std_by_grid(spark, d):
    return stats.median_and_spread(events(spark, d), ["k"], "v").withColumn("spread", F.round("spread", 4))


@query(f"""SELECT user_id, greatest(0.0, max(k - 50)) AS most, greatest(0.0, -min(k - 50)) AS least FROM {EVENTS} GROUP BY user_id""")
def clamped_extremes(spark, d):
    most, least = stats.clamped_extremes("c")
    return events(spark, d).withColumn("c", (F.col("k") - 50).cast("double")).groupBy("user_id").agg(most.alias("most"), least.alias("least"))


@query(f"""SELECT user_id, CAST(k // 10 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS hits FROM {EVENTS} WHERE event_type = 'click' GROUP BY ALL HAVING count(*) >= 3""")
def event_buckets(spark, d):
    return relational.event_buckets(events(spark, d).where("event_type = 'click'"), ["user_id"], "k", 10, 3)


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def event_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# --- alignment and range joins -----------------------------------------------------


def _ticks(spark, d) -> DataFrame:
    """One sample a user and k: the mean of v in whole numbers."""
    return events(spark, d).groupBy("user_id", F.col("k").cast("double").alias("x")).agg(F.floor(F.avg("v")).cast("double").alias("y"))


_TICKS = f"(SELECT user_id, CAST(k AS DOUBLE) AS x, CAST(floor(avg(v)) AS DOUBLE) AS y FROM {EVENTS} GROUP BY user_id, k)"
_GRID = f"(SELECT user_id, unnest(range(0, CAST(floor(max(x) / 7) AS INT) + 1)) * 7.0 AS x FROM {_TICKS} GROUP BY user_id)"
_NEAR = f"""(SELECT g.user_id, g.x, lo.x AS lx, lo.y AS ly, hi.x AS hx, hi.y AS hy FROM {_GRID} g
  ASOF LEFT JOIN {_TICKS} lo ON g.user_id = lo.user_id AND g.x >= lo.x ASOF LEFT JOIN {_TICKS} hi ON g.user_id = hi.user_id AND g.x <= hi.x)"""
_BLEND = "CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly WHEN hx > lx THEN ly + (hy - ly) * ((x - lx) / (hx - lx)) ELSE ly END"


@query(f"SELECT user_id, CAST(x AS DOUBLE) AS x, round({_BLEND}, 4) AS y FROM {_NEAR}")
def asof_interpolate(spark, d):
    return align.resample(_ticks(spark, d), ["user_id"], "x", ["y"], 7.0).select("user_id", "x", F.round("y", 4).alias("y"))


@query(f"SELECT user_id, CAST(x AS DOUBLE) AS x, CASE WHEN lx IS NULL OR hx - x < x - lx THEN hy ELSE ly END AS y FROM {_NEAR}")
def asof_nearest(spark, d):
    t = _ticks(spark, d)
    return align.nearest(t, align.grid(t, ["user_id"], "x", 7.0), ["user_id"], "x", ["y"])


@query(f"""WITH r AS (SELECT user_id, CAST(x AS DOUBLE) AS x, {_BLEND} AS y FROM {_NEAR})
  SELECT a.user_id, a.x, round((a.y - b.y) * 1000, 3) AS delta_ms FROM r a JOIN r b ON a.x = b.x AND b.user_id = 1 WHERE a.user_id <> 1""")
def delta_vs_ref(spark, d):
    return align.delta(_ticks(spark, d), "user_id", "x", "y", 1, 7.0).select("user_id", "x", F.round("delta_ms", 3).alias("delta_ms"))


def _intervals(spark, d) -> DataFrame:
    return events(spark, d).where("k >= 90").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 40 + F.col("k")).alias("hi"))


@query(f"""SELECT e.event_id, i.event_id AS lo FROM {EVENTS} e JOIN {EVENTS} i ON e.user_id = i.user_id AND i.k >= 90 AND e.event_id >= i.event_id AND e.event_id < i.event_id + 40 + i.k""")
def range_join_windows(spark, d):
    points = events(spark, d).select("user_id", "event_id")
    return ranges.points_in_intervals(points, _intervals(spark, d), ["user_id"], "event_id", "lo", "hi", 100.0).select("event_id", "lo")


def _near_sql(distance: str, order: str) -> str:
    return f"""SELECT user_id, event_id, n, distance FROM (SELECT e.user_id, e.event_id, c.event_id AS n, {distance} AS distance,
  row_number() OVER (PARTITION BY e.event_id ORDER BY {order}) AS r FROM {EVENTS} e JOIN {EVENTS} c ON c.user_id = e.user_id AND c.k >= 80 WHERE {distance} >= 0 AND {distance} < 300) WHERE r = 1"""


def _near(spark, d, ahead: bool) -> DataFrame:
    e = events(spark, d)
    corners = e.where("k >= 80").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("n"))
    return ranges.nearest_within(e.select("user_id", "event_id"), corners, ["user_id"], "event_id", "at", "n", 300, ahead)


@query(_near_sql("c.event_id - e.event_id", "c.event_id"))
def nearest_ahead(spark, d):
    return _near(spark, d, True)


@query(_near_sql("e.event_id - c.event_id", "c.event_id DESC"))
def nearest_behind(spark, d):
    return _near(spark, d, False)


# --- plane geometry ----------------------------------------------------------------


def _positions(spark, d) -> DataFrame:
    p = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") * 1000)
    return table(spark, d, "embeddings").select("vec_id", "label", p(0).cast("double").alias("x"), p(1).cast("double").alias("z"))


_POS = "(SELECT vec_id, label, floor(CAST(embedding[1] AS DOUBLE) * 1000) AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000) AS z FROM embeddings)"


@query(f"SELECT DISTINCT label, CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(z / 20) AS BIGINT) AS cz FROM {_POS}")
def grid_distinct_cells(spark, d):
    return spatial.cells(_positions(spark, d), ["label"], "x", "z", 20)


@query(f"""SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM {_POS} q WHERE q.label = 0 AND abs(floor(q.x / 20) - floor(p.x / 20)) <= 1
  AND abs(floor(q.z / 20) - floor(p.z / 20)) <= 1)) AS BIGINT) AS hits FROM {_POS} p GROUP BY label""")
def grid_coverage(spark, d):
    p = _positions(spark, d)
    return spatial.coverage(p, spatial.cells(p.where("label = 0"), [], "x", "z", 20), ["label"], "vec_id", "x", "z", 20)


@query(f"""SELECT vec_id, anchor, d2 FROM (SELECT p.vec_id, a.vec_id AS anchor, (p.x - a.x) * (p.x - a.x) + (p.z - a.z) * (p.z - a.z) AS d2,
  row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - a.x) * (p.x - a.x) + (p.z - a.z) * (p.z - a.z), a.vec_id) AS r
  FROM {_POS} p JOIN {_POS} a ON a.label = 1 WHERE p.label <> 1 AND (p.x - a.x) * (p.x - a.x) + (p.z - a.z) * (p.z - a.z) <= 3600) WHERE r = 1""")
def nearest_point(spark, d):
    p = _positions(spark, d)
    return spatial.nearest_point(p.where("label <> 1"), p.where("label = 1").withColumnRenamed("vec_id", "anchor"), "vec_id", "anchor", 60.0)


@query(f"""SELECT vec_id, round((x - t * 100) * (x - t * 100) + (z - t * 50) * (z - t * 50), 3) AS d2 FROM (SELECT vec_id, x, z, greatest(0.0, least(1.0, (x * 100 + z * 50) / 12500)) AS t FROM {_POS})""")
def point_segment(spark, d):
    zero = F.lit(0.0)
    d2 = spatial.segment_distance2(F.col("x"), F.col("z"), zero, zero, F.lit(100.0), F.lit(50.0))
    return _positions(spark, d).select("vec_id", F.round(d2, 3).alias("d2"))


@query(f"SELECT vec_id, x BETWEEN -50 AND 80 AND z BETWEEN -20 AND 60 AS inside FROM {_POS}")
def point_in_quad(spark, d):
    corners = [(F.lit(a), F.lit(b)) for a, b in ((-50.0, -20.0), (80.0, -20.0), (80.0, 60.0), (-50.0, 60.0))]
    return _positions(spark, d).select("vec_id", spatial.inside_quad(F.col("x"), F.col("z"), corners).alias("inside"))


@query(f"""SELECT id, rid, round(width, 4) AS width FROM (SELECT l.vec_id AS id, r.vec_id AS rid, sqrt((r.x - l.x) * (r.x - l.x) + (r.z - l.z) * (r.z - l.z)) AS width,
  row_number() OVER (PARTITION BY l.vec_id ORDER BY sqrt((r.x - l.x) * (r.x - l.x) + (r.z - l.z) * (r.z - l.z)), r.vec_id) AS n
  FROM {_POS} l JOIN {_POS} r ON l.label < 5 AND r.label >= 5 AND (r.x - l.x) * (r.x - l.x) + (r.z - l.z) * (r.z - l.z) BETWEEN 9 AND 1600
  WHERE abs(r.z - l.z) / sqrt((r.x - l.x) * (r.x - l.x) + (r.z - l.z) * (r.z - l.z)) >= 0.85) WHERE n = 1""")
def across_pairs(spark, d):
    p = _positions(spark, d).select(F.col("vec_id").alias("id"), "label", "x", "z", F.lit(1.0).alias("hx"), F.lit(0.0).alias("hz"))
    return spatial.pairs_across(p.where("label < 5"), p.where("label >= 5")).withColumn("width", F.round("width", 4))


_SIG_L = "(SELECT c_custkey, c_acctbal + 10000 AS len, CAST(c_custkey % 997 AS DOUBLE) AS x, CAST(c_nationkey * 40 AS DOUBLE) AS z FROM customer)"
_SIG_T = "(SELECT s_suppkey, s_nationkey, s_acctbal + 10000 AS t_len, CAST(s_suppkey * 9 % 997 AS DOUBLE) AS t_x, CAST(s_nationkey * 40 AS DOUBLE) AS t_z FROM supplier)"
_SIG = f"(SELECT c_custkey, s_suppkey, s_nationkey FROM {_SIG_L} JOIN {_SIG_T} ON abs(len - t_len) <= 0.04 * t_len AND abs(x - t_x) <= 120 AND abs(z - t_z) <= 120)"


def _signatures(spark, d) -> tuple[DataFrame, DataFrame]:
    num = lambda c: c.cast("double")
    lap = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") + 10000).alias("len"), num(F.col("c_custkey") % 997).alias("x"), num(F.col("c_nationkey") * 40).alias("z"))
    t = table(spark, d, "supplier")
    t = t.select("s_suppkey", "s_nationkey", (F.col("s_acctbal") + 10000).alias("t_len"), num(F.col("s_suppkey") * 9 % 997).alias("t_x"), num(F.col("s_nationkey") * 40).alias("t_z"))
    return lap, t


@query(f"SELECT c_custkey, s_suppkey FROM {_SIG}")
def signature_match(spark, d):
    return relational.signature_match(*_signatures(spark, d), "len", "x", "z").select("c_custkey", "s_suppkey")


@query(f"SELECT c_custkey, CAST(count(DISTINCT s_nationkey) AS BIGINT) AS candidates, CASE WHEN count(DISTINCT s_nationkey) = 1 THEN min(s_nationkey) END AS s_nationkey FROM {_SIG} GROUP BY c_custkey")
def signature_ambiguity(spark, d):
    return relational.unambiguous(relational.signature_names(*_signatures(spark, d), "c_custkey", "s_nationkey", "len", "x", "z"), "c_custkey", "s_nationkey")


# --- text, bits and shapes ---------------------------------------------------------


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') AS slug FROM part""")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


_TOK = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"""WITH a AS (SELECT p_partkey, {_TOK.format("p_type || ' ' || p_brand")} AS t, p_retailprice AS la FROM part),
  b AS (SELECT other, {_TOK.format("p_type")} AS u, lb FROM (SELECT p_type, min(p_partkey) AS other, min(p_retailprice) AS lb FROM part GROUP BY p_type)),
  s AS (SELECT p_partkey, other, 2.0 * len(list_intersect(t, u)) / (len(t) + len(u)) AS f1, abs(la - lb) / lb AS apart FROM a, b WHERE len(list_intersect(t, u)) > 0),
  w AS (SELECT *, f1 + CASE WHEN apart <= 0.04 THEN 0.15 WHEN apart > 0.15 THEN -0.4 ELSE 0.0 END AS score FROM s)
  SELECT p_partkey, other, round(f1, 9) AS f1, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS r FROM w WHERE score >= 0.55) WHERE r = 1""")
def token_f1_match(spark, d):
    p = table(spark, d, "part")
    kinds = p.groupBy("p_type").agg(F.min("p_partkey").alias("other"), F.min("p_retailprice").alias("p_retailprice"))
    right = kinds.withColumn("t", text.tokens(F.col("p_type")))
    left = p.withColumn("t", text.tokens(F.concat_ws(" ", "p_type", "p_brand")))
    out = relational.token_f1(left, right, "p_partkey", "t", "other", "t", 0.55, "p_retailprice")
    return out.select("p_partkey", "other", F.round("f1", 9).alias("f1"), F.round("score", 9).alias("score"))


@query(f"""SELECT place, kind, votes FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY (kind = 'purchase') DESC, votes DESC, kind) AS r FROM (
  SELECT place, kind, CAST(sum(n) AS BIGINT) AS votes FROM (SELECT k AS place, event_type AS kind, user_id, max(v) AS n FROM {EVENTS} GROUP BY ALL) GROUP BY place, kind)) WHERE r = 1""")
def vote_resolution(spark, d):
    votes = events(spark, d).select(F.col("k").alias("place"), F.col("event_type").alias("kind"), F.col("user_id").alias("source"), F.col("v").alias("n"))
    return relational.resolve_votes(votes, ["place"], ["purchase"])


@query(f"SELECT user_id, max(k) AS run, greatest(max(k), 50) AS next_run FROM {EVENTS} GROUP BY user_id")
def watermark_runs(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max("k").alias("run"), F.greatest(F.max("k"), F.lit(50)).cast("long").alias("next_run"))


_O = "(SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS moment, CAST(round(o_totalprice * 100) AS BIGINT) AS b FROM orders)"


@query(f"""SELECT o_custkey, round(avg(b), 4) AS burn, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, max(b) OVER (PARTITION BY o_custkey) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY moment DESC, o_orderkey DESC) AS r FROM {_O} WHERE b > 0) WHERE r <= 3) WHERE b >= 0.5 * top GROUP BY o_custkey""")
def fuel_projection(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", cents("o_totalprice").alias("b"))
    out = relational.fuel_projection(o, "o_custkey", ["o_orderdate", "o_orderkey"], "b", "b")
    return out.select("o_custkey", F.round("burn", 4).alias("burn"), "n")


@query("""SELECT s_suppkey, CAST(step AS INT) AS step, CAST(90000 - 250 * step AS BIGINT) AS map_ms, CAST(floor(100.0 / (CAST(s_suppkey % 9 AS DOUBLE) * (1 + 0.1 * step))) AS BIGINT) AS laps_left
  FROM supplier, (SELECT unnest(range(-5, 6)) AS step) WHERE s_suppkey % 9 > 0""")
def fuel_map(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.lit(100.0).alias("level"), (F.col("s_suppkey") % 9).cast("double").alias("burn"), F.lit(90000).alias("ms"))
    return relational.fuel_map(s, "level", "burn", "ms").select("s_suppkey", "step", "map_ms", "laps_left")


@query(f"""SELECT event_id, CAST((k & 15) | ((v & 15) << 4) | ((user_id & 15) << 8) AS INT) AS packed, CAST((((k & 15) | ((v & 15) << 4)) >> 4) & 15 AS INT) AS second FROM {EVENTS}""")
def bitpack_surface(spark, d):
    e = events(spark, d)
    codes = [F.col(c).bitwiseAND(15) for c in ("k", "v", "user_id")]
    packed = bits.pack_nibbles(codes)
    return e.select("event_id", packed.alias("packed"), bits.nibble(packed, 1).alias("second"))


@query(f"""SELECT CAST(b AS INT) AS bit, CAST(count(*) AS BIGINT) AS n FROM {EVENTS}, (SELECT unnest(range(0, 7)) AS b) WHERE (k >> b) & 1 = 1 GROUP BY b""")
def bit_histogram(spark, d):
    bit = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("bit")
    return events(spark, d).select("k", bit).where(F.expr("getbit(k, bit) = 1")).groupBy("bit").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, concat(CAST(t // 60000 AS VARCHAR), ':', lpad(CAST(t // 1000 % 60 AS VARCHAR), 2, '0'), '.', lpad(CAST(t % 1000 AS VARCHAR), 3, '0')) AS lap
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM orders)""")
def lap_time_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.lap_time(cents("o_totalprice")).alias("lap"))


@query(f"""SELECT event_id, concat(lpad(CAST(m // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(m % 60 AS VARCHAR), 2, '0')) AS clock FROM (SELECT event_id, us // 1000 % 86400000 // 60000 AS m FROM {EVENTS})""")
def clock_text(spark, d):
    return events(spark, d).select("event_id", text.clock(F.floor(F.col("us") / 1000)).alias("clock"))


_SMALL, _TENS = (str(list(ws)).replace('"', "'") for ws in (text.SMALL, text.TENS))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN q < 20 THEN ({_SMALL})[q + 1] ELSE ({_TENS})[q // 10 - 1] || CASE WHEN q % 10 > 0 THEN '-' || ({_SMALL})[q % 10 + 1] ELSE '' END END AS words
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def spoken_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.spoken_int(F.col("l_quantity").cast("long")).alias("words"))


@query("""SELECT l_orderkey, CAST(round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END)) AS BIGINT) AS a, CAST(round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END)) AS BIGINT) AS n,
  CAST(round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)) AS BIGINT) AS r FROM lineitem GROUP BY l_orderkey""")
def pivot_channels(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return wide.select("l_orderkey", *[F.round(c).cast("long").alias(c.lower()) for c in "ANR"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity + l_tax) / 2, 6) AS mean, greatest(0.0, l_discount - l_tax) AS cut,
  CASE WHEN l_discount >= 0.05 THEN 0 WHEN l_tax >= 0.05 THEN 2 ELSE 1 END AS zone FROM lineitem""")
def derived_channels(spark, d):
    zone = F.when(F.col("l_discount") >= 0.05, 0).when(F.col("l_tax") >= 0.05, 2).otherwise(1)
    mean = F.round((F.col("l_quantity") + F.col("l_tax")) / 2, 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("l_discount") - F.col("l_tax")).alias("cut"), zone.alias("zone"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS INT) < 90 THEN 'ok' ELSE 'too large' END AS reason FROM events""")
def json_validate_explode(spark, d):
    k = F.from_json("props", "k int")["k"]
    reason = F.when(k.isNull(), "malformed").when(k < 90, "ok").otherwise("too large")
    return table(spark, d, "events").select("event_id", k.alias("k"), reason.alias("reason"))


# --- detectors ---------------------------------------------------------------------


@query(f"""SELECT user_id, "at", "old", "new" FROM (SELECT *, lag("new") OVER (PARTITION BY user_id ORDER BY run) AS "old" FROM (
  SELECT user_id, run, any_value(p) AS "new", min(CASE WHEN nth = 3 THEN event_id END) AS "at" FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS nth FROM (
      SELECT *, sum(CASE WHEN p = q THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
        SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM (SELECT *, CAST(k // 34 AS INTEGER) AS p FROM {EVENTS}))))
  GROUP BY user_id, run) WHERE "at" IS NOT NULL OR run = 1) WHERE "old" <> "new\"""")
def position_debounce(spark, d):
    e = events(spark, d).withColumn("pos", (F.col("k") / 34).cast("int"))
    return detectors.debounced_changes(e, ["user_id"], "event_id", "pos", 2)


@query(f"""SELECT user_id, t AS "at", CAST(k AS DOUBLE) AS value FROM (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM (
  SELECT *, k >= 40 AND max(CASE WHEN k >= 60 AND t - since >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, span ORDER BY event_id) = 1 AS active FROM (
    SELECT *, min(CASE WHEN k >= 60 THEN t END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS since FROM (
      SELECT *, us / 1000000 AS t, count(CASE WHEN k < 40 THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS span,
        count(CASE WHEN k < 60 THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM {EVENTS})))) WHERE active AND NOT coalesce(was, false)""")
def sustained_threshold(spark, d):
    e = events(spark, d).withColumn("t", (F.col("us") / 1000000).cast("double"))
    return detectors.sustained(e, ["user_id"], "event_id", "k", "t", 60, 40, 600)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, us / 1000000 AS t, k // 25 AS level FROM {EVENTS}),
  p AS (SELECT user_id, min(event_id) AS event_id, arg_min(t, event_id) AS t, arg_min(level, event_id) AS level FROM e GROUP BY user_id
    UNION ALL SELECT p.user_id, min(e.event_id), arg_min(e.t, e.event_id), arg_min(e.level, e.event_id) FROM p JOIN e ON e.user_id = p.user_id AND e.event_id > p.event_id AND (e.t - p.t >= 3600 OR e.level > p.level) GROUP BY p.user_id, p.event_id)
SELECT user_id, CAST(t AS DOUBLE) AS "at", CAST(level AS INTEGER) AS severity FROM p""")
def emission_policy(spark, d):
    e = events(spark, d).withColumns({"t": (F.col("us") / 1000000).cast("double"), "level": (F.col("k") / 25).cast("int")})
    return detectors.rate_limited(e, ["user_id"], "event_id", "t", "level", 3600)
