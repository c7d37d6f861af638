"""Laps and salvage: hand cases, and the packet-by-packet stream against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from lapforge.operators import salvage
from lapforge.streaming import laps as stream_laps

SCHEMA = "console int, at long, packet_id long, car_id int, current_lap int, total_laps int, on_track boolean, paused boolean, loading boolean, last_ms long, best_ms long, clock_ms long, speed double, fuel double"
LEAST = 60


class Feed:
    """Packets of one console, one after another."""

    def __init__(self, console=1):
        self.console, self.rows, self.pid, self.fuel = console, [], 0, 100.0

    def drive(self, n, lap, car=1, last=-1, best=-1, clock=None, total=0, on=True, paused=False, loading=False, speed=50.0, gap=1):
        """n packets; clock may be a list, or start a counting one."""
        for i in range(n):
            self.pid += gap
            self.fuel -= 0.01
            c = clock[i] if isinstance(clock, list) else None if clock is None else clock + round(i * 1000 / 60)
            self.rows.append((self.console, len(self.rows), self.pid, car, lap, total, on, paused, loading, last, best, c, speed, round(self.fuel, 2)))
        return self


def ms(ticks):
    return round((ticks - 1) * 1000 / 60)


def cases():
    """Name, feed and the laps to come: (session, lap, time, ticks, trimmed, salvaged)."""
    f = lambda: Feed()
    yield "completed", f().drive(120, 1).drive(5, 2, last=61_500), [(1, 1, 61_500, 120, 0, False)]
    yield "too short", f().drive(20, 1).drive(5, 2, last=61_500), []
    yield "no time", f().drive(120, 1).drive(5, 2), []
    yield "skipped counter", f().drive(120, 1).drive(5, 3, last=99_000), []
    yield "on reset", f().drive(120, 1).drive(5, 0, last=ms(120) + 400), [(1, 1, ms(120) + 400, 120, 0, True)]
    yield "no match on reset", f().drive(120, 1).drive(5, 0, last=ms(120) + 600), []
    yield "wide tolerance of long laps", f().drive(9000, 1).drive(5, 0, last=ms(9000) + 700), [(1, 1, ms(9000) + 700, 9000, 0, True)]
    yield "while loading, once", f().drive(120, 1, last=5).drive(30, 1, loading=True, best=ms(120)).drive(5, 1), [(1, 1, ms(120), 120, 0, True)]
    yield "loading blip", f().drive(70, 1).drive(9, 1, loading=True).drive(50, 1).drive(3, 2, last=70_000), [(1, 1, 70_000, 120, 0, False)]
    clock = [5000] * 40 + [round(i * 1000 / 60) for i in range(100)]
    yield "pre-roll", f().drive(140, 0, clock=clock).drive(5, 0, loading=True, last=ms(100)), [(1, 0, ms(100), 100, 40, True)]
    stub = [round(i * 1000 / 60) for i in range(150)] + [round(i * 1000 / 60) for i in range(70)]
    yield "post-line stub", f().drive(220, 0, clock=stub).drive(5, 0, loading=True, last=ms(150)), [(1, 0, ms(150), 150, 70, True)]
    frozen = [0] * 10 + [round(i * 1000 / 60) for i in range(1, 100)] + [round(99 * 1000 / 60)] * 30
    yield "frozen hold", f().drive(139, 1, clock=frozen).drive(5, -1, on=False, last=ms(100)), [(1, 1, ms(100), 100, 39, True)]
    yield "out-lap", f().drive(120, 0).drive(120, 1).drive(5, 2, last=66_000), [(1, 1, 66_000, 120, 0, False)]
    yield "another car", f().drive(120, 1).drive(5, 1, last=ms(120)).drive(80, 1, car=2).drive(4, 2, car=2, last=44_000), [(1, 1, ms(120), 125, 0, True), (2, 1, 44_000, 80, 0, False)]
    own = f().drive(120, 0).drive(9, 0, loading=True, last=ms(120)).drive(90, 0).drive(120, 1).drive(5, 2, last=55_000)
    yield "own driving after a replay", own, [(1, 0, ms(120), 120, 0, True), (2, 1, 55_000, 120, 0, False)]
    again = f().drive(120, 0).drive(9, 0, loading=True, last=ms(120)).drive(100, 0).drive(9, 0, loading=True, last=ms(100)).drive(3, 0)
    yield "two replays", again, [(1, 0, ms(120), 120, 0, True), (2, 0, ms(100), 100, 0, True)]
    yield "gaps count as time", f().drive(100, 1, gap=2).drive(2, 0, last=round(99 * 2000 / 60)), [(1, 1, round(99 * 2000 / 60), 100, 0, True)]
    yield "long gaps count as a frame", f().drive(100, 1, gap=90).drive(2, 0, last=ms(100)), [(1, 1, ms(100), 100, 0, True)]
    yield "a pause adds no time", f().drive(60, 1).drive(50, 1, paused=True).drive(60, 1).drive(3, 0, last=ms(120)), [(1, 1, ms(120), 120, 0, True)]
    yield "cool-down", f().drive(120, 3, total=3).drive(120, 4, total=3, last=70_000).drive(3, 0, last=ms(120)), [(1, 3, 70_000, 120, 0, False)]
    # a salvage at a forward jump takes the packet that showed it: the next lap begins one later, in a session of its own
    jump = f().drive(120, 1).drive(1, 4, last=ms(120)).drive(99, 4, last=ms(120)).drive(5, 5, last=33_000)
    yield "forward jump", jump, [(1, 1, ms(120), 120, 0, True), (2, 4, 33_000, 99, 0, False)]
    chain = f().drive(100, 1).drive(61, 4, last=ms(100)).drive(61, 7, last=ms(61)).drive(61, 9, last=ms(60)).drive(3, 11, last=ms(61))
    yield "jumps in a row", chain, None
    yield "nothing", f().drive(3, -1, on=False), []


CASES = list(cases())


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(6)
    rows = []
    for n, (_, feed, _) in enumerate(CASES):
        rows += [(n, *r[1:]) for r in feed.rows]
    for n in range(1000, 1016):  # streams of every kind of step
        feed, lap = Feed(), 0
        for _ in range(rng.randint(4, 14)):
            n_ticks = rng.choice((1, 20, 59, 60, 61, 62, 90))
            kind = rng.random()
            times = {"last": rng.choice((-1, ms(60), ms(61), ms(62), ms(90))), "best": rng.choice((-1, ms(90)))}
            clock = rng.choice((None, 0, 0, 900))
            car = 1 if rng.random() < 0.9 else 2
            if kind < 0.2:
                feed.drive(rng.randint(1, 4), lap, loading=True, **times)
                continue
            lap = lap + 1 if kind < 0.5 else rng.choice((0, lap, lap + 2, -1, max(lap - 1, 0)))
            feed.drive(n_ticks, lap, car=car, clock=clock, on=lap >= 0, paused=rng.random() < 0.05, total=rng.choice((0, 0, 3)), **times)
        rows += [(n, *r[1:]) for r in feed.rows]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def batch(packets):
    return sorted(map(tuple, salvage.lap_stream(packets[1].repartition(5), "console", "at", LEAST).collect()))


def test_hand_cases(batch):
    for n, (name, _, want) in enumerate(CASES):
        if want is not None:
            got = [(r[2], r[3], r[4], r[5], r[6], r[10]) for r in batch if r[0] == n]
            assert got == want, name


def test_lengths_and_fuel(batch):
    by = {CASES[r[0]][0]: r for r in batch if r[0] < len(CASES)}
    done, cut = by["completed"], by["pre-roll"]
    assert done[7] == 100.0 and done[8] == 99.99 and done[9] == 98.79  # first packet of the lap to first packet of the next
    assert cut[7] == pytest.approx(99 * 50 / 60, abs=0.02) and cut[8] == pytest.approx(100 - 0.41) and cut[9] == pytest.approx(100 - 1.4)


@pytest.mark.parametrize("files", [1, 7])
def test_stream_equals_batch(spark, packets, batch, tmp_path, files):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, at = packets[0], str(tmp_path / "in")
    top = max(r[1] for r in rows) + 1
    for i in range(files):  # a micro-batch a file, cut through laps; ordered by name
        part = [r for r in rows if i * top // files <= r[1] < (i + 1) * top // files]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{at}/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")
    out = stream_laps.lap_stream(stream, "console", "at", LEAST)
    name = f"laps_{files}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table(name).collect()))
    assert len(got) > 40 and got == batch


def test_query_equals_the_stream(spark, tmp_path):
    from lapforge.plans import racing

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sf = "/root/testdata/sf0.001"
    rows = racing._packets(spark, sf)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stream_laps.lap_stream(stream, "user_id", "event_id", 5)
    q = out.writeStream.format("memory").queryName("laps_query").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("laps_query").collect()))
    assert len(got) > 10 and got == sorted(map(tuple, racing.lap_salvage(spark, sf).collect()))


def test_lap0_buffer_is_dropped_when_full(spark):
    feed = Feed().drive(250, 0).drive(2, 0, loading=True, last=ms(50))
    df = spark.createDataFrame(feed.rows, SCHEMA)
    assert salvage.lap_stream(df, "console", "at", 30, lap0_ticks=100).select("ticks", "trimmed").collect() == [(50, 0)]
    assert salvage.lap_stream(df, "console", "at", 30, lap0_ticks=200).select("ticks").collect() == [(50,)]
    assert salvage.lap_stream(df, "console", "at", 30).count() == 0


def test_empty_and_null_keys(spark):
    assert salvage.lap_stream(spark.createDataFrame([], SCHEMA), "console", "at").count() == 0
    df = spark.createDataFrame(Feed().drive(120, 1).drive(5, 2, last=61_500).rows, SCHEMA)
    assert salvage.lap_stream(df.withColumn("console", F.lit(None).cast("int")), "console", "at", LEAST).count() == 0
