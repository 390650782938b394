"""Mix sources to target weights with Sainte-Laguë apportionment of equal blocks of words.

Each source's target becomes a whole number of blocks, by highest quotients; so does each shard's part
of its source's blocks. Shards are seeded hash buckets of documents, so that no task ever handles a
whole source. In a shard the documents stand in seeded order, twice in a row, and the quota's blocks
are the first ones: a document is taken whole, twice, or not at all, except the one at the end.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import WORD, hash128, prepare, word_count, written

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS = 16
ROWS_PER_SHARD = 1000
MAX_SHARDS = 4096


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all sizes by weight; what exceeds ``most`` times a size is shared out again."""
    total, found, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        level = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                found[i] = level * weights[i]
            break
        for i in full:
            found[i] = most * sizes[i]
            total -= found[i]
        open_ = [i for i in open_ if i not in set(full)]
    return found


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """``seats`` given to the highest quotients vote / (2 k + 1); ties go to the earlier entry.

    Starts from a divisor so large that nobody has too much, then hands out the few seats left.
    """
    total, n = sum(votes), sum(v > 0 for v in votes)
    given = [0] * len(votes)
    if total <= 0 or seats <= 0:
        return given
    if seats > n:
        divisor = total / (seats - n / 2)
        given = [max(0, math.ceil(v / divisor - 0.5)) if v > 0 else 0 for v in votes]
        while sum(given) > seats:  # rounding of the divisor itself
            i = min((i for i, g in enumerate(given) if g), key=lambda i: (votes[i] / (2 * given[i] - 1), -i))
            given[i] -= 1
    queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, given)) if v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        i = queue[0][1]
        given[i] += 1
        heapq.heapreplace(queue, (-votes[i] / (2 * given[i] + 1), i))
    return given


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    rows_per_shard: int = ROWS_PER_SHARD,
    seed: int = 1,
) -> DataFrame:
    """Per document: id, ``size``, ``source_size``, ``target`` and ``taken`` words of the mix, and the key of its row.

    Sources in code point order, null last, have ``weights`` in turn. A null text has size 0 and gives
    nothing. ``taken`` is at most ``2 * size``. Rows are told apart by id and text; equal rows share
    their order number's place but each has its own words. An empty table gives an empty result.

    What reaches the driver is one row per source; shards of a source are apportioned in one group of
    at most ``MAX_SHARDS`` rows. Documents move once, as narrow rows, to be ordered in their shard.
    """
    if most > 2:
        raise ValueError("a document is repeated at most twice")
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    sized = docs.select(
        ident.alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), *hash128(text, ("t1", "t2"))
    )
    spark = prepare(docs.sparkSession)
    sized = written(sized, "sizes")

    per_source = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")).collect()
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))  # str order is code point order
    sizes = [r.source_size for r in per_source]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    quotas = sainte_lague(wanted, round(sum(wanted) / block_words))
    plan = spark.createDataFrame(
        [
            (r.source, r.source_size, t, q, min(MAX_SHARDS, -(-r.rows // rows_per_shard)))
            for r, t, q in zip(per_source, wanted, quotas)
        ],
        "source string, source_size long, target double, blocks long, shards int",
    )
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("t1"), F.col("t2"))
    placed = (
        sized.withColumn("order", order)
        .join(plan.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
        .drop("its")
        .withColumn("shard", F.pmod("order", F.col("shards")).cast("int"))
    )
    shard = ["source", "shard"]

    def apportion(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        given = sainte_lague(group["words"].tolist(), int(group["blocks"].iloc[0]))
        return pd.DataFrame({"source": group["source"], "shard": group["shard"], "quota": given})

    shard_quotas = (
        placed.groupBy(*shard)
        .agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
        .groupBy("source")
        .applyInPandas(apportion, "source string, shard int, quota long")
        .select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "quota")
    )
    by = Window.partitionBy(*shard).orderBy("order", "id", "t1", "t2").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*shard)
    streamed = placed.select("*", F.coalesce(F.sum("size").over(by), F.lit(0)).alias("begin"), F.sum("size").over(whole).alias("words"))
    taken = streamed.join(
        shard_quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard"))
    ).withColumn("words_taken", F.col("quota") * block_words)

    def passed(begin: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("words_taken") - begin))

    first, second = passed(F.col("begin")), passed(F.col("begin") + F.col("words"))
    return taken.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (first + second).alias("taken"), "t1", "t2"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken twice is two rows.

    The document at the end of a quota is cut behind its last word taken; its ``n_chars`` follows. Rows of
    equal id and text share the words taken of all of them, to the last one. Empty and null texts give no row.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    text = F.col(f"`{text_col}`")
    per_key = mix(docs, **options).where("taken > 0").groupBy(id_col, "t1", "t2")
    # equal rows share their words evenly; the first ones take one of what is left over
    n, words = F.count("*"), F.sum("taken")
    shares = per_key.agg(F.first("size").alias("__size"), F.floor(words / n).cast("long").alias("__each"), (words % n).alias("__rest"))
    shares = shares.select(*(F.col(a).alias(b) for a, b in ((id_col, "__id"), ("t1", "__1"), ("t2", "__2"))), "__size", "__each", "__rest")
    shares = written(shares, "mix-shares")
    keyed = docs.withColumns(dict(zip(("__t1", "__t2"), hash128(text, ("a", "b")))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__t1") == F.col("__1")) & (F.col("__t2") == F.col("__2"))
    joined = keyed.join(shares.where("__rest = 0"), same).withColumn("__taken", F.col("__each"))
    uneven = shares.where("__rest > 0")
    if not uneven.isEmpty():
        rows = _placed(keyed.join(uneven, same), docs)
        joined = joined.unionByName(
            rows.withColumn("__taken", F.col("__each") + F.when(F.col("__place") <= F.col("__rest"), 1).otherwise(0)).drop("__place")
        )
    left = F.col("__taken") - F.col("__size")
    parts = F.filter(F.array(F.least("__size", "__taken"), left), lambda n: n > 0)
    out = joined.withColumn("__words", F.explode(parts))
    out = out.withColumn(text_col, F.when(F.col("__words") >= F.col("__size"), text).otherwise(first_words(text, F.col("__words"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _placed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with ``__place``, the number of each among those of equal id and text, from 1.

    They are counted in up to 64 parts by their other columns, so that only rows equal in every column meet in a sort.
    """
    key = ("__id", "__1", "__2")
    others = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    salted = rows.withColumn("__hash", F.xxhash64(*others)).withColumn("__salt", F.pmod("__hash", F.lit(64)).cast("int"))
    ahead = Window.partitionBy(*key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy(*key, "__salt").agg(F.count("*").alias("__n"))
    parts = parts.select(*(F.col(c).alias(f"{c}_") for c in (*key, "__salt")), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*key, "__salt")]
    place = F.row_number().over(Window.partitionBy(*key, "__salt").orderBy("__hash")) + F.col("__ahead")
    found = salted.join(parts, same[0] & same[1] & same[2] & same[3]).withColumn("__place", place)
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), "__place")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    spaced = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(spaced, F.lit(1), n.cast("int")), "")
