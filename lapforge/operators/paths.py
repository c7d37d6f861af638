"""Ordering by links: nodes with two ports, linked into paths and rings, are ranked without walking them.

A node has a port on either side (+1 and -1) and each port at most one link. Seen as
directed nodes (id, way), leaving through the port ``way``, links make lists, and pointer jumping
finds the end and the number of steps to it of every node in as many joins as the logarithm of the
longest list, whatever the number of lists. No list is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.sources.scratch import staged


def _on(keys: list[str], pairs: dict[str, str]) -> Column:
    """Equality of ``keys`` with their r_ twins (of ``_right``) and of the named column pairs."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    for a, b in pairs.items():
        cond = cond & (F.col(a) == F.col(b))
    return cond


def _right(df: DataFrame, keys: list[str], **names: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(c).alias(a) for a, c in names.items()])


def matched(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Links (keys, a, s, b, t, order...) chosen from candidate pairs of ports so that no port is used twice.

    Candidates name each pair of ports once, a < b. In every round, the pairs that come first by ``order`` (ties: smaller a, b, s, t) for both
    of their ports are linked and all pairs of those ports go, until none is left: the same links as
    taking the pairs one by one in that order.
    """
    rank = F.struct(*order, "a", "b", "s", "t")
    left, chosen = staged(candidates, "pairs"), None
    while True:
        ports = left.select(*keys, F.col("a").alias("i"), F.col("s").alias("p"), rank.alias("rank")).unionByName(left.select(*keys, F.col("b").alias("i"), F.col("t").alias("p"), rank.alias("rank")))
        first = ports.groupBy(*keys, "i", "p").agg(F.min("rank").alias("rank"))
        # a pair that comes first for both its ports is seen twice among the firsts
        both = first.groupBy(*keys, "rank").count().where("count = 2").select(*keys, "rank.*")
        links = staged(both.select(*candidates.columns), "links")
        if links.isEmpty():
            return chosen if chosen is not None else links
        chosen = links if chosen is None else chosen.unionByName(links)
        used = links.select(*keys, F.col("a").alias("i"), F.col("s").alias("p")).unionByName(links.select(*keys, F.col("b").alias("i"), F.col("t").alias("p")))
        used = _right(used, keys, i="i", p="p")
        rest = left.join(used, _on(keys, {"a": "i", "s": "p"}), "left_anti")
        left = staged(rest.join(used, _on(keys, {"b": "i", "t": "p"}), "left_anti"), "pairs")


def both_ways(links: DataFrame, keys: list[str]) -> DataFrame:
    """Each link from either of its ports: (keys, a, s, b, t)."""
    return links.select(*keys, "a", "s", "b", "t").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("t").alias("s"), F.col("a").alias("b"), F.col("s").alias("t")))


def _jump(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, way, to, to_way, hops, least, ends) of every directed node, pointers as far as they go.

    least: the least seed met, after how many steps, and which way it was then left.
    """
    way = F.explode(F.array(F.lit(1), F.lit(-1)))
    own = nodes.select(*keys, "id", "seed", way.alias("way")).withColumn("least", F.struct("seed", F.lit(0).cast("long").alias("hops"), "way"))
    step = _right(both_ways(links, keys), keys, a="a", s="s", b="b", t="t")
    d = own.join(step, _on(keys, {"id": "a", "way": "s"}), "left")
    d = d.select(*keys, "id", "way", F.coalesce("b", "id").alias("to"), F.coalesce(-F.col("t"), "way").alias("to_way"), F.when(F.col("b").isNull(), 0).otherwise(1).cast("long").alias("hops"), "least", F.col("b").isNull().alias("ends"), F.lit(True).alias("moved"))
    d, before = staged(d, "pointers"), None
    while True:
        # the nodes ahead whose own pointer ends close those that point at them
        ahead = _right(d, keys, i="id", w="way", n_to="to", n_way="to_way", n_hops="hops", n_least="least", n_ends="ends")
        least = F.least("least", F.struct(F.col("n_least.seed").alias("seed"), (F.col("hops") + F.col("n_least.hops")).alias("hops"), F.col("n_least.way").alias("way")))
        open_ = d.where(~F.col("ends")).join(ahead, _on(keys, {"to": "i", "to_way": "w"})).select(
            *keys, "id", "way", F.col("n_to").alias("to"), F.col("n_way").alias("to_way"), (F.col("hops") + F.col("n_hops")).alias("hops"),
            least.alias("least"), F.col("n_ends").alias("ends"), (least != F.col("least")).alias("moved"),
        )
        d = staged(d.where("ends").withColumn("moved", F.lit(False)).unionByName(open_), "pointers")
        now = d.agg(F.count_if(~F.col("ends")).alias("open"), F.count_if(~F.col("ends") & F.col("moved")).alias("moved")).first()
        if now["open"] == 0 or (now["open"] == before and now["moved"] == 0):  # what stays open is rings, each with its least node known
            return d
        before = now["open"]


def ranked(nodes: DataFrame, links: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(lines, rings): keys, id, path, place, size, ahead of the nodes of paths, and of rings opened at their least node.

    ``nodes`` has keys, id and seed (a struct that ends in id). The least seed of a path names it (``path``) and gives it its direction: its +1 port
    looks ahead. Places count from 0, in a ring from its least node. ahead: whether the node's own +1 port looks ahead.
    """
    d = _jump(nodes, links, keys)
    ids = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
    # one of the two ways round a ring comes to the least node from ahead of it and leaves it by its -1 port: that is the way back
    back = F.min(F.when(F.col("least.way") == -1, F.struct(F.col("least.hops").alias("hops"), "way")))
    both = d.groupBy(*keys, "id").agg(
        F.min("least.seed").alias("least"), F.bool_and("ends").alias("ends"), back.alias("back"), ids(1, "to").alias("end_p"), ids(1, "hops").alias("hops_p"), ids(-1, "to").alias("end_m"), ids(-1, "hops").alias("hops_m"),
    )
    both = staged(both.withColumn("path", F.col("least.id")), "ends")
    lines, rings = both.where("ends"), both.where("not ends")
    start = _right(lines.where("id = path"), keys, r_path="path", start="end_m")
    placed = lines.join(start, _on(keys, {"path": "r_path"})).withColumn("ahead", F.col("end_m") == F.col("start"))
    placed = placed.select(*keys, "id", "path", F.when(F.col("ahead"), F.col("hops_m")).otherwise(F.col("hops_p")).alias("place"), (F.col("hops_p") + F.col("hops_m") + 1).alias("size"), "ahead")
    size = _right(rings.groupBy(*keys, "path").agg(F.count("*").alias("size")), keys, r_path="path", size="size")
    opened = rings.join(size, _on(keys, {"path": "r_path"})).select(*keys, "id", "path", F.col("back.hops").alias("place"), "size", (F.col("back.way") == -1).alias("ahead"))
    return placed, opened


def cut_rings(links: DataFrame, rings: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The links without the last by ``by`` of each ring."""
    of = _right(rings, keys, i="id", path="path")
    inside = links.join(of, _on(keys, {"a": "i"}))
    worst = inside.groupBy(*keys, "path").agg(F.max(F.struct(*by, "a", "b", "s", "t")).alias("w"))
    worst = worst.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(f"w.{c}").alias(f"w_{c}") for c in ("a", "b", "s", "t")])
    return links.join(worst, _on(keys, {c: f"w_{c}" for c in ("a", "b", "s", "t")}), "left_anti")
