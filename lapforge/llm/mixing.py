"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) take the weights in turn; all words
are shared out by weight, no source above ``max_repeat`` times its own size, the excess
reshared by weight (water filling, solved in closed form by a running sum over sources
in the order in which they reach their cap).

Schedule: slot n of N maps the golden-ratio point frac(n * phi) (32-bit fixed point)
through the cumulative target shares to a source, and the slots of a source are ranked
in order. Rank r of k stands for words [r*T/k, (r+1)*T/k) of the source's T target words,
read cyclically from its documents in a seeded shuffle: equal-token blocks, joined to
the documents that they cover. So every source gives its target exactly, spread evenly.

Scale: nothing is grouped by source alone. Running sums and ranks are two-level: inside
a bucket of bounded rows, then over bucket totals; the block join has the key (source,
rank), with about ``block_words`` words a key. Only the one-row-a-source table goes
through single-task windows.

Edge cases: null and empty texts have size 0 and are taken 0 times; a null source is a
source; an empty table gives an empty result; rows of one id are ordered by size and text,
rows without an id by text, so reruns agree (equal rows are interchangeable); rows stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
MAX_SLOTS = 1 << 20
MIN_BLOCK_WORDS = 32
BUCKET_ROWS = 4096
GOLDEN32 = 2654435769  # 2**32 / golden ratio, rounded to odd


def count_words(text: Column) -> Column:
    """Number of runs outside 0x20 and 0x09-0x0D; 0 for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.length(F.regexp_replace(F.regexp_replace(trimmed, r"[^ \t-\r]+", "w"), r"[ \t-\r]+", ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n_docs, target) of a (source, size) table, one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.get(table, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    # a source is capped when the water level (words per weight) would exceed cap / weight
    per = per.withColumn("_reach", max_repeat * F.col("source_size") / F.col("weight"))
    seq = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_capped": F.coalesce(F.sum(max_repeat * F.col("source_size")).over(before), F.lit(0)),
        "_open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "_total": F.sum("source_size").over(every),
    })
    per = per.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    # the level of the first source, in that order, that does not reach its cap
    per = per.withColumn("_final", F.min(F.when(F.col("_reach") >= F.col("_level"), F.struct("_reach", F.col("source").isNull(), "source", "_level"))).over(every)["_level"])
    return per.select(
        "source", "source_size", "n_docs", "_total",
        F.when(F.col("_reach") <= F.col("_final"), (max_repeat * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("_final")).alias("target"),
    )


def shuffled_offsets(docs: DataFrame, per: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Add ``_from``: words of the source before each document in the seeded order."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.col("_text").cast("string")))  # rows without an id spread by their texts
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), own))
    docs = docs.withColumn("_key", key).join(per.select(F.col("source").alias("_s"), "n_docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    # leading 32 bits of the key, cut into as many equal ranges as the source has thousands of rows
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    docs = docs.withColumn("_bucket", F.floor(lead * F.ceil(F.col("n_docs") / BUCKET_ROWS) / F.lit(float(1 << 32))).cast("long"))
    sums = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_base")
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "inner")
    inner = Window.partitionBy("source", "_bucket").orderBy("_key", id_col, "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("_from", F.col("_base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("_s", "_b", "_base", "_bucket", "_key", "_text", "n_docs")


def schedule(per: DataFrame, max_slots: int = MAX_SLOTS, min_block: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank, n_slots): the source of each slot, and its rank among the source's slots."""
    spark = per.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    per = per.where("target > 0").withColumn("_upto", F.sum("target").over(order))
    cut = per.select("source", (F.col("_upto") - F.col("target")).alias("_low"), F.col("_upto").alias("_high"), "target", "_total")
    size = per.agg(F.max("_total").alias("t")).first()["t"] or 0  # one number: all words
    block = max(min_block, -(-size // max_slots))
    n = -(-size // block)
    point = (F.col("slot") * F.lit(GOLDEN32)) % F.lit(1 << 32) / F.lit(float(1 << 32))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("_at", point * F.lit(float(size)))
    # the sources' shares, one row each, are joined by a grid of the cumulative axis, so no row meets all sources
    cells = 1024
    cell = lambda c: F.floor(c * cells / F.lit(float(max(size, 1)))).cast("int")
    grid = cut.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    slots = slots.withColumn("_cell", cell(F.col("_at"))).join(grid, "_cell").where("_at >= _low and _at < _high")
    slots = slots.select("slot", "source").withColumn("_chunk", F.floor(F.col("slot") / 65536).cast("long"))
    counts = slots.groupBy("source", "_chunk").agg(F.count("*").alias("_k"))
    ahead = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_base"), F.sum("_k").over(Window.partitionBy("source")).alias("n_slots"))
    slots = slots.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    rank = F.col("_base") + F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1
    slots = slots.select("slot", "source", rank.alias("rank"), "n_slots")
    # a source too small for a point of its own gets one slot at the end
    missed = cut.join(counts.select("_s").distinct(), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    return slots.unionByName(missed.select(F.lit(n).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("n_slots")))


def mix_plan(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): sizes, targets and places of the documents; and the mix itself.

    A row of pieces (slot, source, rank, pass, id, from_word, to_word) takes words
    [from_word, to_word) of a document at its slot; ordered by (slot, pass, from) they are the mix.
    """
    sizes = staged(df.select(F.col(id_col), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_text")), "mix-sizes")
    per = staged(targets(sizes, weights, max_repeat), "mix-targets")
    docs = shuffled_offsets(sizes, per, seed, id_col).withColumn("words", F.least(F.round("target").cast("long"), max_repeat * F.col("source_size")))
    docs = staged(docs, "mix-offsets")
    slots = schedule(per)
    each = slots.groupBy("source").agg(F.max("n_slots").alias("_n")).select(F.col("source").alias("_s"), "_n")
    runs = docs.where("size > 0 and words > 0").join(each, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    runs = runs.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")).cast("long"))))
    runs = runs.withColumn("_lo", F.col("pass") * F.col("source_size") + F.col("_from"))
    runs = runs.withColumn("_hi", F.least(F.col("_lo") + F.col("size"), F.col("words"))).where("_hi > _lo")
    low, high = F.floor(F.col("_lo") * F.col("_n") / F.col("words")), F.floor((F.col("_hi") - 1) * F.col("_n") / F.col("words"))
    # one block more on either side, as double division may round; an empty overlap is dropped
    runs = runs.withColumn("rank", F.explode(F.sequence(F.greatest(low - 1, F.lit(0)).cast("long"), F.least(high + 1, F.col("_n") - 1).cast("long"))))
    edge = lambda r: F.expr(f"({r} * (words div _n) + ({r} * (words % _n)) div _n)")  # noqa: E731  floor(r * words / n) without overflow
    runs = runs.withColumns({"_a": F.greatest("_lo", edge("rank")), "_b": F.least("_hi", edge("(rank + 1)"))}).where("_b > _a")
    places = slots.select("slot", F.col("source").alias("_s"), F.col("rank").alias("_r"))
    pieces = runs.join(places, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r")))
    return docs, pieces.select("slot", "source", "rank", "pass", id_col, "_from", (F.col("_a") - F.col("_lo")).alias("from_word"), (F.col("_b") - F.col("_lo")).alias("to_word"))


def taken_words(df: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes of it."""
    docs, pieces = mix_plan(df, id_col=id_col, **kw)
    # _from tells rows of one id apart
    got = pieces.groupBy(F.col(id_col).alias("_id"), F.col("_from").alias("_at")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = docs.join(got, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_from") == F.col("_at")) & (F.col("size") > 0), "left")
    return out.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
