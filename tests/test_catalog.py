import random

import duckdb
import pandas as pd
import pytest

from lapforge.operators import relational, windows
from lapforge.plans import catalog, racing

DATA = "/root/testdata/sf0.001"
assert racing  # registers its queries
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)


def test_spike_at_exactly_its_share_is_none(spark):
    # 0.35 * 90 is 31.499999999999996 in doubles: a value 31.5 above its neighbours' mean is no spike of 35 %
    rows = [(1, i, v) for i, v in enumerate((0, 0, 0, 90, 45, 45, 27, 0, 0))] + [(2, i, v) for i, v in enumerate((0, 90, 0, 0, 32, 0, 1, 0))]
    df = spark.createDataFrame(rows, "u int, i int, v long")
    got = {(r["u"], r["i"]) for r in windows.spikes(df, ["u"], "i", "v").collect()}
    lists = {u: [v for w, _, v in rows if w == u] for u in (1, 2)}
    exact = {(u, i) for u, vs in lists.items() for i in range(2, len(vs) - 2) if 100 * (2 * vs[i] - vs[i - 2] - vs[i + 2]) > 70 * (max(vs) - min(vs))}
    assert got == exact and (2, 4) not in got


def signatures(spark, n_laps, n_tracks):
    rng = random.Random(11)
    at = lambda: (round(rng.uniform(0, 3000), 1), float(40 * rng.randint(-3, 12)), float(120 * rng.randint(-2, 2)))
    lap = spark.createDataFrame([(i, *at()) for i in range(n_laps)], "lap int, len double, x double, z double")
    tracks = spark.createDataFrame([(i, rng.choice((None, "a", "b", "c")), *at()) for i in range(n_tracks)], "track int, name string, t_len double, t_x double, t_z double")
    return lap, tracks


@pytest.mark.parametrize("n_tracks", [25, 700])
def test_signature_names_equal_all_pairs(spark, n_tracks):
    lap, tracks = signatures(spark, 120, n_tracks)
    same = lambda a, b: abs(a["len"] - b["t_len"]) <= 0.04 * b["t_len"] and abs(a["x"] - b["t_x"]) <= 120 and abs(a["z"] - b["t_z"]) <= 120 and a["len"] > 0
    pairs = {(a["lap"], b["track"], b["name"]) for a in lap.collect() for b in tracks.collect() if same(a, b)}
    assert sorted((r["lap"], r["track"]) for r in relational.signature_match(lap, tracks, "len", "x", "z").collect()) == sorted(p[:2] for p in pairs)
    assert {tuple(r) for r in relational.signature_names(lap, tracks, "lap", "name", "len", "x", "z").collect()} == {(a, n) for a, _, n in pairs}


def test_signatures_meet_by_length_too(spark):
    # one place, lengths far apart: only neighbours in length may be joined
    lap = spark.range(200).selectExpr("id AS lap", "1000 * pow(1.1, id) AS len", "1D AS x", "1D AS z")
    tracks = spark.range(200).selectExpr("id AS track", "1000 * pow(1.1, id) AS t_len", "1D AS t_x", "1D AS t_z")
    out = relational.signature_match(lap, tracks, "len", "x", "z")
    assert out.count() == 200 and "_bl" in out._jdf.queryExecution().executedPlan().toString()


def stream(spark):
    return [r.asDict() for r in catalog.events(spark, DATA).orderBy("user_id", "event_id").collect()]


def by_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r["user_id"], []).append(r)
    return out


def test_hysteresis_against_a_plain_scan(spark):
    want = set()
    for user, rows in by_user(stream(spark)).items():
        v, i = [r["k"] - 50 for r in rows], 0
        while i < len(v):
            if abs(v[i]) <= 40:
                i += 1
                continue
            sign, first, last = (1 if v[i] > 0 else -1), i, i
            while i < len(v):
                if v[i] * sign >= 20:
                    last = i
                elif -v[i] * sign > 40 or i - last >= 3:
                    break
                i += 1
            want.add((user, first, last, sign))
    got = {(r["user_id"], r["first"], r["last"], r["sign"]) for r in catalog.hysteresis_segments(spark, DATA).collect()}
    assert got == want


def test_debounce_needs_the_hold(spark):
    want = set()
    for user, rows in by_user(stream(spark)).items():
        base, last, n = rows[0]["k"] // 34, None, 0
        for r in rows:
            p = r["k"] // 34
            last, n = p, n + 1 if p == last else 1
            if n == 3 and p != base:
                want.add((user, r["event_id"], base, p))
                base = p
    got = {(r["user_id"], r["at"], r["old"], r["new"]) for r in catalog.position_debounce(spark, DATA).collect()}
    assert got == want


def test_emission_policy_against_a_plain_scan(spark):
    want = 0
    for rows in by_user(stream(spark)).values():
        last = level = None
        for r in rows:
            t, s = r["us"] / 1e6, r["k"] // 25
            if last is None or t - last >= 3600 or s > level:
                last, level, want = t, s, want + 1
    assert catalog.emission_policy(spark, DATA).count() == want


def test_spoken_numbers(spark):
    from pyspark.sql import functions as F

    from lapforge.functions import text

    rows = spark.createDataFrame([(n,) for n in (-32, 0, 7, 13, 20, 45, 100, 219, 1000, 9999, 10000)], "n long").select("n", text.spoken_int(F.col("n")).alias("w")).collect()
    words = {r["n"]: r["w"] for r in rows}
    assert words[45] == "forty-five" and words[-32] == "minus thirty-two" and words[219] == "two hundred nineteen" and words[1000] == "one thousand"
    assert words[9999] == "nine thousand nine hundred ninety-nine" and words[10000] == "10000" and words[0] == "zero"


def test_sustained_against_a_plain_scan(spark):
    want = set()
    for user, rows in by_user(stream(spark)).items():
        began = None
        on = False
        for r in rows:
            t, k = r["us"] / 1e6, r["k"]
            if on:
                on = k >= 40
                began = None if not on else began
            if not on:
                began = None if k < 60 else t if began is None else began
                if began is not None and t - began >= 600:
                    on = True
                    want.add((user, t, float(k)))
    assert {(r["user_id"], r["at"], r["value"]) for r in catalog.sustained_threshold(spark, DATA).collect()} == want and want
