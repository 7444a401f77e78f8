"""Connected components by star contraction: the least id reachable by links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import drop_stage, stage


def _least(pairs: DataFrame) -> DataFrame:
    """``v`` tied to the least of its ``u`` and that u's other partners, for pairs ``(u, v)``.

    The pairs are dealt out by ``u`` once, for the least and for the join with it.
    """
    pairs = pairs.repartition("u")
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("low"))
    return pairs.join(low, F.col("u") == F.col("k")).select("u", "v", "low")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).filter("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = _least(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return down.select(F.explode(F.array(
        F.struct(F.col("low").alias("a"), F.col("v").alias("b")),
        F.struct(F.col("low").alias("a"), F.col("u").alias("b")))).alias("l")).select("l.a", "l.b")


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct links as a staged table, their number and the sum of their hashes."""
    seen = Observation()
    links = stage(links.distinct().observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    return links, (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of each node with a link, from links ``(a, b)`` in any order.

    Large and small stars in turn: every node hands its partners the least id near
    it, until each component is one star around its least id. A round is two joins
    and ends in a written table; rounds grow with the logarithm of the component.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    (links, state), before = _written(links), None
    while state != before and state[0]:
        before, old = state, links
        # A large star has no more rows than links: one distinct a round is enough.
        links, state = _written(_small_star(_large_star(old).filter("a <> b")).filter("a <> b"))
        drop_stage(old)
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
