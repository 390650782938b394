"""Jaccard join of word shingles by T-occurrence search, in blocks that provably hold every link.

Blocks. Two sets of sizes a and b with Jaccard similarity of at least t differ in at most
d = (1 - t) / (1 + t) * (a + b) shingles. Cut the hash space into more than d parts, then some part is
untouched by the differences: both sets have it in common. So a document emits a hash of each part of
its set, and documents with an equal part belong to one block (a connected component). The number of
parts depends on the sizes: schemes cover bands of sizes, and narrow schemes cover the bands' borders.
An equal part must not be empty; a document with too many empty parts repeats under another cut.
Passages that many documents share rarely fill a whole part, so they don't join blocks.

Large blocks. One equal part is weak evidence, and in a large input common phrases chain most documents to
one block. So the distinct sets of a large block are put into blocks anew by sharper signatures (PartEnum):
cut into more than d / 2 parts, some part holds one difference at most; cut that part into four again, then
three of its four quarters are untouched. Every choice of three quarters is a signature. Bands of sizes are
narrow here, by the smaller set of a pair, so that d fits the pair's own sizes; small sets keep the plain parts.

Links. In a block, each set looks up its shingles in inverted lists: a partner is found T times, T the
least overlap. As in DivideSkip the L longest lists are set aside, the short ones are merged, candidates
found T - L times or more are probed in the long lists by binary search, and the exact overlap decides.
A search can stop when all sets not yet searched belong to one component.

Blocks that are still large are cut by size class, as partners are at most one class apart, and into cells of bounded size;
a set goes to the cells of its own and the two next classes. Equal sets are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import wordscan
from gaugeworks.llm.common import arrow_batches, prepare, slices, text_arrays, written
from gaugeworks.llm.components import Forest, connected_components

SLICE_BYTES = 1 << 20
CELL_SHINGLES = 3_000_000
QUARTERS, BAND_STEP, FINE_FROM = 4, 1.125, 64
MARK_BITS, LARGEST_MAP = 16, 1 << 27  # bits for each marked id; of a map, 16 MB
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Jaccard:
    """The threshold num / den, and what follows from it, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0.8 * den <= num <= den:
            raise ValueError("a similarity from 0.8 to 1 is expected; below it too many parts are empty")
        self.num, self.den, self.known = num, den, {}

    def holds(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def least_overlap(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def most_differences(self, both: int) -> int:
        """Of two sets with ``both`` elements together, counted twice where shared."""
        return (self.den - self.num) * both // (self.den + self.num)

    def smallest_partner(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def largest_partner(self, n: int) -> int:
        return self.den * n // self.num

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """Scheme, number of parts, and harmless number of empty parts, where a set of ``n`` takes part.

        Band k holds the sizes from 2**k to 2**(k+1) - 1 (scheme 2k); the border above band k, the
        pairs with one size on each side of it (scheme 2k + 1).
        """
        band = n.bit_length() - 1
        found = [(2 * band, *self._parts(2 * (2 ** (band + 1) - 1), 2**band))]
        for k in (band - 1, band):
            border = 2 ** (k + 1)
            if k >= 0 and (self.largest_partner(n) >= border if n < border else self.smallest_partner(n) < border):
                found.append((2 * k + 1, *self._parts(border - 1 + self.largest_partner(border - 1), self.smallest_partner(border))))
        return found

    def fine_schemes(self, n: int) -> list[tuple[int, int, int]]:
        """The same for sharper signatures: number of parts, and harmless number of weak parts.

        Scheme k is for the pairs whose smaller set has at least edge(k) and less than edge(k + 1) elements.
        """
        edge = lambda k: math.ceil(FINE_FROM * BAND_STEP**k)
        found, k = [], 0
        while edge(k) <= n:
            if n <= self.largest_partner(edge(k + 1) - 1):
                most = edge(k + 1) - 1
                found.append((k, *self._fine_parts(most + self.largest_partner(most), edge(k))))
            k += 1
        return found

    def _fine_parts(self, both: int, smallest: int) -> tuple[int, int]:
        """A part is weak when all its elements may be in one quarter."""
        if ("fine", both, smallest) not in self.known:
            least, spare = self.most_differences(both) // 2 + 1, 0

            def weak() -> float:
                empty = math.exp(-smallest / (least + spare) / QUARTERS)
                return empty**QUARTERS + QUARTERS * (1 - empty) * empty ** (QUARTERS - 1)

            while spare < int(1.3 * (least + spare) * weak()):
                spare += 1 + least // 50
            self.known["fine", both, smallest] = least + spare, spare
        return self.known["fine", both, smallest]

    def _parts(self, both: int, smallest: int) -> tuple[int, int]:
        """More parts than differences and, on top, as many as a set of the smallest size leaves empty by chance."""
        if (both, smallest) not in self.known:
            differences, spare = self.most_differences(both), 0
            while spare < int(1.3 * (differences + 1 + spare) * math.exp(-smallest / (differences + 1 + spare))):
                spare += 1 + differences // 50
            self.known[both, smallest] = differences + 1 + spare, spare
        return self.known[both, smallest]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, data = text_arrays(texts)
    for first, last in slices(offsets, SLICE_BYTES):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        begins, ends = wordscan.spans(part, own)
        hashes = wordscan.span_hashes(part, begins, ends, lower=True)
        bounds = np.searchsorted(begins, own)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(wordscan.shingles(hashes[a:b], k))


def signatures(shingles: np.ndarray, jaccard: Jaccard) -> np.ndarray:
    """A hash for each part of each cut that the set takes part in."""
    found = []
    for scheme, parts, spare in jaccard.schemes(len(shingles)):
        salt = 0
        while True:
            own = shingles if not salt else np.sort(wordscan.mix(shingles + np.uint64(salt * int(_SALT) & (1 << 64) - 1)))
            part = (own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = np.add.reduceat(wordscan.mix(own), begins)
            label = np.uint64((scheme << 40) + (salt << 32)) + part[begins]
            found.append(wordscan.mix(sums + wordscan.mix(label)))
            if parts - len(begins) <= spare:
                break
            salt += 1
    return np.concatenate(found)


def fine_signatures(shingles: np.ndarray, jaccard: Jaccard) -> np.ndarray:
    """A hash for every choice of all quarters but one, of each part of each cut that the set takes part in.

    Linked sets have one in common: with d differences, more than ``spare`` parts have one difference at most,
    and the quarters without it are equal. Where a part isn't weak for one of the sets these are not empty.
    Pairs whose smaller set has fewer than ``FINE_FROM`` elements have a plain part in common.
    """
    n, found = len(shingles), []
    if jaccard.smallest_partner(n) < FINE_FROM:
        found.append(signatures(shingles, jaccard))
    for scheme, parts, spare in jaccard.fine_schemes(n):
        salt = 0
        while True:
            own = shingles if not salt else np.sort(wordscan.mix(shingles + np.uint64(salt * int(_SALT) & (1 << 64) - 1)))
            quarter = ((own >> np.uint64(32)) * np.uint64(parts * QUARTERS) >> np.uint64(32)).astype(np.int64)
            counts = np.bincount(quarter, minlength=parts * QUARTERS)
            totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordscan.mix(own), dtype=np.uint64)])
            ends = np.cumsum(counts)
            sums = (totals[ends] - totals[ends - counts]).reshape(parts, QUARTERS)
            counts = counts.reshape(parts, QUARTERS)
            left = counts.sum(axis=1, keepdims=True) - counts > 0
            label = np.uint64((1 << 62) + (scheme << 48) + (salt << 40)) + np.arange(parts * QUARTERS, dtype=np.uint64)
            hashes = wordscan.mix(sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums + wordscan.mix(label).reshape(parts, QUARTERS))
            found.append(hashes[left])
            if parts - int(left.all(axis=1).sum()) <= spare:
                break
            salt += 1
    return np.concatenate(found)


def search(sets: list[np.ndarray], queries: np.ndarray, jaccard: Jaccard, forest: Forest) -> None:
    """Link ``queries`` (positions) with all ``sets`` in ``forest``.

    Without a link left out between two queries, or a query and another set, unless both ends are in
    one component anyway.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")  # owners ascend within a list
    values, owner = values[order], owner[order]
    open_ = list(queries)
    while open_:
        q = open_.pop()
        begin = np.searchsorted(values, sets[q], side="left")
        end = np.searchsorted(values, sets[q], side="right")
        least, most = jaccard.smallest_partner(int(sizes[q])), jaccard.largest_partner(int(sizes[q]))
        required = int(jaccard.least_overlap(int(sizes[q]), least))
        lengths = end - begin
        by_length = np.argsort(lengths, kind="stable")
        n_long = min(required - 1, int(required / (0.01 * math.log2(max(2, lengths.max())) + 1)))
        # the longest lists are worth setting aside only where they are long
        n_long = min(n_long, int((lengths > 8).sum()))
        short, long_ = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
        merged = np.concatenate([owner[begin[k] : end[k]] for k in short]) if len(short) else np.empty(0, int)
        found = np.bincount(merged, minlength=len(sets))
        fits = (found >= max(1, required - n_long)) & (sizes >= least) & (sizes <= most)
        fits[q] = False
        candidates = np.flatnonzero(fits)
        overlap = found[candidates]
        for seen, k in enumerate(long_):
            if not len(candidates):
                break
            its = owner[begin[k] : end[k]]
            at = np.minimum(np.searchsorted(its, candidates), len(its) - 1)
            overlap = overlap + (its[at] == candidates)
            alive = overlap + (n_long - seen - 1) >= required
            candidates, overlap = candidates[alive], overlap[alive]
        for c in candidates[jaccard.holds(overlap, int(sizes[q]), sizes[candidates])]:
            forest.union(int(q), int(c))
        if len(open_) % 16 == 0 and len(queries) == len(sets):
            # links among the sets not searched yet matter only between components
            roots = np.array([forest.find(i) for i in open_])
            if len(roots) and (roots == roots[0]).all():
                break
            common = np.bincount(roots).argmax() if len(roots) else -1
            open_.sort(key=lambda i: forest.find(i) != common)  # the largest component waits


def only_marked(df: DataFrame, column: str, marks: DataFrame) -> DataFrame:
    """The rows of ``df`` whose whole number may be one of ``marks`` (one column); none of those is lacking.

    The marks set bits of a map that every task gets. Rows that pass by chance are for the caller's
    join to drop; a join then need not move the others. For so many marks that the map would be too
    large to send around, nothing is left out ahead of that join.
    """
    size = 1 << (MARK_BITS * max(marks.count(), 1 << 12)).bit_length()
    if size > LARGEST_MAP:
        return df
    value = F.pmod(F.xxhash64(F.col(marks.columns[0])), F.lit(size))
    one = F.lit(1)  # bucket and bit numbers start at 1
    bits = marks.select(value.alias("m")).groupBy(F.bitmap_bucket_number(F.col("m") + one).alias("m_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("m") + one)).alias("m_bits"))
    own = F.pmod(F.xxhash64(F.col(column)), F.lit(size)) + one
    placed = df.withColumns({"m_own": F.bitmap_bucket_number(own), "m_at": F.bitmap_bit_position(own)})
    joined = placed.join(F.broadcast(bits), F.col("m_own") == F.col("m_bucket"))  # at most LARGEST_MAP / 8 bytes
    byte = F.conv(F.hex(F.substring("m_bits", (F.shiftright("m_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("m_at", F.lit(8)))), F.lit(2)) == 1
    return joined.where(hit).select(*df.columns)


def join_similar(
    docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``n_shingles`` (set size), and ``component_id``, the smallest id reachable by links.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles (A-Z as a-z) is
    at least ``similarity`` (numerator, denominator). A text with fewer words is one shingle; without
    words or text the set is empty and links with nothing. Rows with one id are one document, and link
    all their texts' partners. A row without id takes no part and has a null component. Every row comes
    back once; an empty table gives an empty result. Ids are whole numbers.
    """
    spark = prepare(docs.sparkSession)
    jaccard = Jaccard(*similarity)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            sizes, h1, h2 = [], [], []
            for s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                h1.append(int(wordscan.mix(s).sum(dtype=np.uint64)))
                h2.append(int(wordscan.mix(s + _SALT).sum(dtype=np.uint64)))
            hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *hashes], names=["id", "n", "h1", "h2"])

    digests = written(texts.mapInArrow(digest, "id long, n long, h1 long, h2 long"), "shingle-digests")
    nodes = digests.where("n > 0 and id is not null")

    def parts(how):
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrow_batches(batches):
                found = [how(s, jaccard) if len(s) else s for s in shingle_sets(batch.column(1), words)]
                counts = [len(f) for f in found]
                ids = np.repeat(np.asarray(batch.column(0)), counts)
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids, pa.int64())], names=["sig", "id"])

        return spread

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links from the first id of each run of equal signatures to the others; rows come sorted."""
        sig, first = None, None
        for batch in arrow_batches(batches):
            sigs, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            begins = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            heads = np.repeat(ids[begins], np.diff(np.append(begins, len(sigs))))
            if sigs[0] == sig:
                heads[: begins[1] if len(begins) > 1 else len(heads)] = first
            sig, first = sigs[-1], heads[-1]
            linked = heads != ids
            pairs = np.unique(np.stack([heads[linked], ids[linked]], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def blocks_of(some: DataFrame, how) -> DataFrame:
        """Every id that has a signature in common with another one, and its block."""
        spread = some.select("id", "text").mapInArrow(parts(how), "sig long, id long")
        candidates = spread.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(stars, "a long, b long").distinct()
        return connected_components(candidates).select(F.col("node").alias("id"), F.col("component").alias("block"))

    blocks = blocks_of(texts.where("id is not null and text is not null"), signatures)

    # equal sets of a block are one row; their documents link to its smallest id
    placed = written(nodes.join(blocks, "id"), "shingle-blocks")
    classes = written(placed.groupBy("block", "h1", "h2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "shingle-sets")
    copies = placed.join(classes.withColumnRenamed("block", "its").drop("n"), ["h1", "h2"]).where("block = its and id <> rep").select(
        F.col("rep").alias("a"), F.col("id").alias("b")
    )

    def weighed(sets: DataFrame) -> DataFrame:
        weight = sets.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("weight")).where("sets > 1")
        return weight.select(F.col("block").alias("its"), (F.col("weight") > CELL_SHINGLES).alias("large"))

    # a set of a large block without a sharper signature in common links with no other set
    at_large = classes.join(weighed(classes).where("large"), F.col("block") == F.col("its"))
    at_large = written(at_large.select(F.col("rep").alias("r")).distinct(), "shingle-large")
    if not at_large.isEmpty():
        some = only_marked(texts.where("text is not null"), "id", at_large)
        finer = blocks_of(some.join(at_large, F.col("id") == F.col("r"), "left_semi"), fine_signatures)
        finer = at_large.join(finer, F.col("r") == F.col("id"), "left").select("r", F.col("block").alias("finer"))
        classes = classes.join(finer, F.col("rep") == F.col("r"), "left").where("r is null or finer is not null")
        classes = classes.withColumn("block", F.coalesce("finer", "block")).drop("r", "finer")
        classes = written(classes, "shingle-sets")
    # blocks still large are cut by size class, since partners are at most one class apart, and then by a hash
    weight = weighed(classes)
    size_class = F.floor(F.log(F.col("n")) / (math.log(jaccard.den / jaccard.num) * (1 + 1e-6) if jaccard.num < jaccard.den else 1e-3))
    sized = classes.join(weight, F.col("block") == F.col("its")).drop("its")
    sized = written(sized.withColumn("band", F.when(F.col("large"), size_class).otherwise(0).cast("int")), "shingle-classes")
    cut = sized.where("large").groupBy("block", "band").agg(F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("chunks"))
    cut = written(cut, "shingle-cuts")

    def cells_with(step: int, alias: str) -> DataFrame:
        """The chunks of the size class ``step`` above each class."""
        return cut.select(F.col("block").alias(f"b{alias}"), (F.col("band") - step).alias(f"d{alias}"), F.col("chunks").alias(alias))

    same = lambda alias: (F.col("block") == F.col(f"b{alias}")) & (F.col("band") == F.col(f"d{alias}"))
    reps = sized
    for step, alias in ((0, "own"), (1, "above"), (-1, "below")):
        reps = reps.join(cells_with(step, alias), same(alias), "left")
    chunk = F.pmod(F.xxhash64("h1", "h2"), F.col("own")).cast("int")
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda low, c, high, o: F.struct(
        low.alias("low"), c.cast("int").alias("chunk"), high.alias("high"), o.cast("int").alias("other")
    )
    own, above, below = (F.coalesce(F.col(c), F.lit(0)) for c in ("own", "above", "below"))
    band = F.col("band")
    # a chunk meets the chunks of its own size class and of the next ones; where it is the only one of its
    # class, it meets itself on the way
    alone = (own == 1) & (above + below > 0)
    with_own = F.when(alone, F.array().cast("array<int>")).otherwise(places(own))
    meets = F.concat(
        F.transform(with_own, lambda o: cell(band, F.least(chunk, o), band, F.greatest(chunk, o))),
        F.transform(places(above), lambda o: cell(band, chunk, band + 1, o)),
        F.transform(places(below), lambda o: cell(band - 1, o, band, chunk)),
    )
    single = F.array(cell(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    reps = reps.select("block", "rep", F.when(F.col("large"), meets).otherwise(single).alias("cells"))

    wanted = written(reps.select(F.col("rep").alias("r"), "block", "cells"), "shingle-cells")
    chosen = only_marked(texts, "id", wanted.select("r")).join(wanted, F.col("id") == F.col("r"))
    # texts go to the cells, and sets are made there: a set is several times as large, and does not compress.
    # an id with several texts may stand for one of them only; each of its texts comes along
    cells = chosen.select("block", F.explode("cells").alias("cell"), F.col("r").alias("rep"), "text").select("block", "cell.*", "rep", "text")

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(pa.array(cell["text"], pa.large_string()), words))
        # an id may have texts without words besides; their empty sets link with nothing
        some = np.array([len(s) > 0 for s in sets], dtype=bool)
        cell, sets = cell[some], [s for s in sets if len(s)]
        forest = Forest(len(sets))
        search(sets, np.arange(len(sets)), jaccard, forest)
        rep = cell["rep"].to_numpy()
        ends = np.array(forest.edges, dtype=int).reshape(-1, 2)
        return pd.DataFrame({"a": rep[ends[:, 0]], "b": rep[ends[:, 1]]}, dtype="int64")

    links = cells.groupBy("block", "low", "chunk", "high", "other").applyInPandas(link, "a long, b long")
    found = connected_components(links.unionByName(copies))
    return digests.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller one; rows without id stay."""
    id_col = options.get("id_col", "doc_id")
    found = join_similar(docs, **options)
    copies = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__copy_id")).distinct()
    return docs.join(copies, F.col(f"`{id_col}`").cast("long") == F.col("__copy_id"), "left_anti")
