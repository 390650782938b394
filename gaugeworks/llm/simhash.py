"""SimHash fingerprints of 128 bits, and the fingerprints within a Hamming radius.

Built-in functions throughout. A text's terms are its pairs of neighbouring words; each term's hash
votes for or against every bit, weighted by the term's length. The votes are 64 sums per text, two
counts of 32 bits in each, so the terms are rows that are added up where they are made: no term is
shuffled, and a very long text is one row of sums.

The search cuts fingerprints into more blocks than the radius. Two fingerprints within the radius
agree in all but ``radius`` blocks at least, so for every choice of that many blocks to leave out there
is a table sorted (here: joined) by the others. A bucket of such a table is dealt into chunks of
bounded size, a chunk is one row, and each query meets the chunks of its bucket: rows grow with
queries and chunks, never with pairs.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import hash128, written

BITS = 128
HEAVIEST = 16  # a term weighs its code points, this many at most
CHUNK = 1024  # fingerprints in one row of a bucket
SPACE = r"[\x20\x09-\x0D]+"
_LANES = 0x1_0000_0001


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def terms(words: Column) -> Column:
    """The pairs of neighbours in a column of words; one word is a term of its own, no word an empty term of no weight."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(n > 1, pairs).when(n == 1, words).otherwise(F.array(F.lit("")))


def vote(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the fingerprint (``f1``, ``f2``) of each key's ``text``.

    Rows of one key are expected to have one text: more of them vote more often for the same bits.
    """
    hashed = (
        texts.select(*keys, words_of(F.col("text")).alias("words"))  # a column of its own, so a text is split once
        .select(*keys, F.explode(terms(F.col("words"))).alias("term"))
        .select(*keys, F.least(F.char_length("term"), F.lit(HEAVIEST)).cast("long").alias("w"), *hash128(F.col("term"), ("h1", "h2")))
    )
    sums = [
        F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(32)
    ]
    voted = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)

    def half(h: str) -> Column:
        lanes = [F.shiftrightunsigned(f"{h}_{i}", 32) for i in reversed(range(32))]
        lanes += [F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in reversed(range(32))]
        bits = (F.when(votes * 2 > F.col("w"), "1").otherwise("0") for votes in lanes)
        return F.conv(F.concat(*bits), 2, -10).cast("long")

    return voted.select(*keys, half("h1").alias("f1"), half("h2").alias("f2"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_text(f1: str, f2: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(f), 16, "0") for f in (f1, f2))))


def distance(a: tuple, b: tuple) -> Column:
    """Bits that differ; a pair of numbers each."""
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    return differ(a[0], b[0]) + differ(a[1], b[1])


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits: about 0.5 for unrelated texts, 1 for texts of equal terms."""
    return F.lit(1.0) - distance((F.col(a[0]), F.col(a[1])), (F.col(b[0]), F.col(b[1]))) / F.lit(float(BITS))


# ---- the search


class Tables:
    """All ways to leave out ``radius`` of ``blocks`` blocks; ``masks`` holds the bits that remain."""

    def __init__(self, radius: int, blocks: int):
        if not 0 <= radius < blocks <= BITS:
            raise ValueError("a radius from 0 and more blocks than that are expected")
        cuts = [BITS * j // blocks for j in range(blocks + 1)]
        own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        whole = [sum(c) for c in itertools.combinations(own, blocks - radius)]
        self.radius = radius
        self.masks = [(_signed(m & (1 << 64) - 1), _signed(m >> 64)) for m in whole]

    @staticmethod
    def blocks_for(radius: int, n: int) -> int:
        """The fewest blocks whose tables tell ``n`` fingerprints apart: any number finds the same pairs."""
        blocks = radius + 1
        while blocks < min(BITS, 2 * radius + 4) and BITS * (blocks - radius) / blocks < math.log2(max(n, 2)):
            blocks += 1
        return blocks

    def keyed(self, prints: DataFrame) -> DataFrame:
        """A row per fingerprint and table."""
        key = lambda m1, m2: F.xxhash64(F.col("f1").bitwiseAND(F.lit(m1)), F.col("f2").bitwiseAND(F.lit(m2)))
        each = F.array(*(F.struct(F.lit(t).alias("t"), key(*m).alias("key")) for t, m in enumerate(self.masks)))
        return prints.select("*", F.explode(each).alias("at")).select(*prints.columns, "at.*")

    def owned(self, x1: Column, x2: Column, t: Column) -> Column:
        """Whether no table before ``t`` brings the same pair together; ``x`` has the bits that differ."""
        masks = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in self.masks))
        return F.forall(F.slice(masks, F.lit(1), t), lambda m: (x1.bitwiseAND(m["a"]) != 0) | (x2.bitwiseAND(m["b"]) != 0))


def count_within(queries: DataFrame, prints: DataFrame, *, radius: int = 6, blocks: int | None = None) -> DataFrame:
    """``f1``, ``f2`` of the distinct ``queries``, and ``n_within``: how much of ``prints`` (``f1``, ``f2``, ``n``) is that near.

    ``prints`` are distinct and weigh ``n`` each. A query with nothing near it has no row.
    """
    held = written(prints.select("f1", "f2", "n"), "fingerprints")
    tables = Tables(radius, blocks or Tables.blocks_for(radius, held.count()))
    asked = written(tables.keyed(queries.select("f1", "f2").distinct()).select(F.col("f1").alias("q1"), F.col("f2").alias("q2"), "t", "key"), "fingerprint-queries")
    met = written(tables.keyed(held).join(asked.select("t", "key").distinct(), ["t", "key"], "left_semi"), "fingerprint-buckets")
    large = met.groupBy("t", "key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1")
    dealt = met.join(large, ["t", "key"], "left").withColumn(
        "chunk", F.pmod(F.xxhash64("f1", "f2"), F.coalesce("chunks", F.lit(1))).cast("int")
    )
    chunks = dealt.groupBy("t", "key", "chunk").agg(F.collect_list(F.struct("f1", "f2", "n")).alias("held"))
    query = (F.col("q1"), F.col("q2"))

    def near(p: Column) -> Column:
        x1, x2 = query[0].bitwiseXOR(p["f1"]), query[1].bitwiseXOR(p["f2"])
        return (F.bit_count(x1) + F.bit_count(x2) <= radius) & tables.owned(x1, x2, F.col("t"))

    found = F.aggregate(F.filter("held", near), F.lit(0).cast("long"), lambda total, p: total + p["n"])
    counted = chunks.join(asked, ["t", "key"]).select("q1", "q2", found.alias("n")).groupBy("q1", "q2").agg(F.sum("n").alias("n_within"))
    return counted.select(F.col("q1").alias("f1"), F.col("q2").alias("f2"), "n_within").where("n_within > 0")


# ---- documents


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` (null: empty) and 128 bits that stand for both (``r1``, ``r2``)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # a null adds nothing to a hash, so its place is hashed as well
    keys = {r: F.xxhash64(F.lit(seed), F.col("id").isNull(), "id", "text") for r, seed in (("r1", "a"), ("r2", "b"))}
    return rows.withColumns(keys)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct (id, text): the id, ``f1``, ``f2`` and ``fingerprint`` (32 hex digits). A null text is an empty one: zeros."""
    rows = _rows(docs, id_col, text_col)
    return vote(rows, ["id", "r1", "r2"]).select(F.col("id").alias(id_col), "f1", "f2", as_text("f1", "f2").alias("fingerprint"))


def in_order(ids: DataFrame) -> DataFrame:
    """``ids`` (distinct ``id``, ``r1``, ``r2``; ``n``) by descending id, with the row before each: ``p1``, ``p2``, ``pn``.

    Before the first comes the last. Null ids come last, equal ids in the order of the other columns. Rows
    are numbered within range partitions; only each partition's last row crosses over, so what a single
    task sees is one row per partition.
    """
    order = [F.col("id").desc_nulls_last(), F.col("r1"), F.col("r2")]
    dealt = written(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    w = Window.partitionBy("part").orderBy(*order)
    me = F.struct("r1", "r2", "n")
    placed = dealt.withColumns({"before": F.lag(me).over(w), "last": F.lead(F.lit(True)).over(w).isNull()})
    parts = placed.where("last").select("part", me.alias("tail"))
    across = Window.orderBy("part")  # one row per partition
    parts = parts.select("part", F.coalesce(F.lag("tail").over(across), F.last("tail").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("tail"))
    joined = placed.join(parts, "part").withColumn("before", F.coalesce("before", "tail"))
    return joined.select(*ids.columns, *(F.col(f"before.{c}").alias(a) for c, a in (("r1", "p1"), ("r2", "p2"), ("n", "pn"))))


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 6, every: int = 50) -> DataFrame:
    """Each document's fingerprint against that of its edited text, its next document and the whole table.

    The edited text has the last third (code points, rounded down) replaced by as many of the next
    document's first ones, or all it has; next is by descending id, and after the last comes the first.
    Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` (shares of equal bits), and ``n_near``: where ``every`` divides the id, how many other
    documents have a fingerprint within ``radius`` bits; null elsewhere.

    A null text is an empty one. Rows of equal id and text are one document in the order and come back
    once each; rows of one id with other texts are neighbours in a fixed order; a null id comes last.
    A single document is its own next one. An empty table gives an empty result. Whole texts move once.
    """
    rows = _rows(docs, id_col, text_col)
    ids = rows.groupBy("id", "r1", "r2", F.char_length("text").alias("n")).agg(F.count("*").alias("copies"))
    order = written(in_order(ids), "order")
    # one exchange of texts for both uses: as the document itself, and as what follows another one
    texts = rows.groupBy("r1", "r2").agg(F.first("text").alias("text"))
    own = texts.join(order.select("r1", "r2", "n"), ["r1", "r2"])
    third = lambda n: F.floor(F.col(n) / 3).cast("int")
    heads = texts.join(order.select("r1", "r2", "p1", "p2", "pn"), ["r1", "r2"]).select(
        F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.substring("text", F.lit(1), third("pn")).alias("head")
    )
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third("n")), F.col("head"))
    both = own.join(heads, ["r1", "r2"]).select("r1", "r2", "text", edited.alias("edited"))
    each = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit("").alias("sha"), F.col("text")),
        F.struct(F.lit(1).alias("kind"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("text")),
    )
    voted = vote(both.select("r1", "r2", F.explode(each).alias("e")).select("r1", "r2", "e.*"), ["r1", "r2", "kind", "sha"])
    pick = lambda kind, c, name: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name)
    pair = voted.groupBy("r1", "r2").agg(
        pick(0, "f1", "f1"), pick(0, "f2", "f2"), pick(1, "f1", "e1"), pick(1, "f2", "e2"), F.max("sha").alias("edited_sha256")
    )
    pair = written(pair, "fingerprint-pairs")
    mine = written(order.join(pair, ["r1", "r2"]), "fingerprint-pairs")
    following = mine.select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    near = count_within(
        mine.where(F.pmod("id", F.lit(every)) == 0), mine.groupBy("f1", "f2").agg(F.sum("copies").alias("n")), radius=radius
    )
    searched = mine.where(F.pmod("id", F.lit(every)) == 0).select("r1", "r2", "f1", "f2").join(near, ["f1", "f2"]).drop("f1", "f2")
    return (
        mine.join(following, ["r1", "r2"])
        .join(searched, ["r1", "r2"], "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_chars"),
            "edited_sha256",
            as_text("f1", "f2").alias("fingerprint"),
            as_text("e1", "e2").alias("edited_fingerprint"),
            likeness(("f1", "f2"), ("e1", "e2")).alias("near_edited"),
            likeness(("f1", "f2"), ("n1", "n2")).alias("near_next"),
            (F.col("n_within") - 1).alias("n_near"),
        )
    )
