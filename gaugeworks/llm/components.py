"""Connected components of undirected links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import remove, written


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every end of ``links`` (``a``, ``b``).

    Each round joins every node's larger neighbours to its smallest neighbour, then every node and its
    smaller neighbours to the smallest of them; links become stars in a logarithmic number of rounds.
    Smallest neighbours are aggregates with map-side combining and meet the links in inner joins, where a
    node with very many links is split. Each round is written, so no plan grows and no executor's loss
    reaches back further than one round. Nulls and links of a node to itself add nothing.
    """
    links = links.where("a <> b")
    held = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _fingerprint(held)
    while seen[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # written, so that links and minima meet in a join of two shuffles, and a centre of very many links is split
        centres = written(smallest, "links")
        large = (
            both.where("v > u")
            .join(centres, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        pairs = large.join(smallest, F.col("u") == F.col("w"))
        contracted = pairs.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = written(contracted.select("e.u", "e.v").where("u <> v").distinct(), "links")
        before, seen = seen, _fingerprint(new)
        remove(held)
        remove(centres)
        held = new
        if seen == before:
            break
    found = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


class Forest:
    """Union-find over the positions 0 to n - 1 of a task's own rows."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        """Joins two trees; ``edges`` keeps the links that did, at most one per position."""
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))
