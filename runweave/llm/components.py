"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runweave.llm.common import attach_by_key
from runweave.storage import cut_lineage, discard, files_for


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = links.select(F.inline(F.array(F.struct("u", "v"), turned)))
    near = attach_by_key(both, _least_neighbour(both), "u", "v")
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    near = attach_by_key(links, _least_neighbour(links), "u", "v")
    own, moved = (F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v"))
    return near.select(F.inline(F.array(own, moved))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, root``: every id that is linked, and the least id it reaches.

    The links become stars around the least id of each component in a number of
    rounds that grows with the logarithm of a component's length.  The centre of
    a star may have any number of links: they meet it in parts.  A round's links are
    no more than twice those before, and lie in as few files as suit so many; those
    before are deleted.  Each half of a round is written by itself, as its links are
    read several times: one plan for both would repeat the first half in each of
    them, and plans are what the driver holds.
    """
    links = links.select(
        F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")
    ).where("u <> v")
    links = cut_lineage(links.distinct(), "links")
    mark = None
    while True:
        if (now := links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) == mark:
            break
        mark, before = now, links
        half = cut_lineage(_large_star(links).coalesce(files_for(now[0])), "half-round")
        links = cut_lineage(_small_star(half).coalesce(files_for(2 * now[0])), "links")
        discard(links.sparkSession, before, half)
    own, root = (F.struct(F.col(c).alias("id"), F.col("v").alias("root")) for c in ("u", "v"))
    return links.select(F.inline(F.array(own, root))).distinct()
