"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the words of a random product code: the rotated space is cut into blocks, each with
its own random unit codewords, and a direction takes one codeword of each block. A vector passes a filter
when its inner product with the direction is large. List decoding finds all filters a vector passes,
block by block, dropping beginnings that cannot reach the threshold any more, without looking at all
directions. Vectors of one label that pass a common filter are compared exactly. Codes of few blocks, and
several of them in rotations of their own, keep the number of filters a vector passes near its mean: with
the settings here 998 of 1000 random pairs of cosine 0.93 in 64 dimensions meet, and more above it. Vectors of
few components have codes of one block, with caps and words by the angle of a link.

Equal vectors are one row with a count. A bucket (label and filter) of many vectors is cut into cells of
bounded size. A pair counts in its smallest common filter only. Cells give one number per vector and the
links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import arrow_batches, hash128, prepare, written
from gaugeworks.llm.components import Forest, connected_components

BLOCKS = 2
CODEWORDS = 512
CODES = 4
FILTERS_PER_VECTOR = 16  # of each code
SMALL_DIM = 12  # below, a code is one block
SMALL_WORDS = 4096  # of such a block, at most
CELL_ROWS = 512
FLUSH_ROWS = 8192  # more than a cell has
CELL = ("label", "dim", "filter", "first", "second")


class ProductCode:
    """Directions for vectors of ``dim`` components; the same for everybody, as all is seeded."""

    def __init__(self, dim: int, blocks: int, codewords: int, per_vector: int, seed: int):
        random = np.random.RandomState(seed)
        self.rotation = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), min(blocks, dim))
        self.words = []
        for cut in self.cuts:
            words = random.normal(size=(len(cut), codewords))
            self.words.append(words / np.linalg.norm(words, axis=0) / np.sqrt(len(self.cuts)))
        # the threshold that random vectors pass in per_vector of all directions on average
        trial = random.normal(size=(64, dim))
        trial /= np.linalg.norm(trial, axis=1)[:, None]
        picks = random.randint(codewords, size=(len(self.cuts), 200_000))
        sums = sum(s[:, p] for s, p in zip(self.scores(trial), picks))
        every = codewords ** len(self.cuts)
        self.threshold = float(np.quantile(sums, max(0.0, 1 - per_vector / every)))

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, cut] @ words for cut, words in zip(self.cuts, self.words)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The sorted numbers of the filters each vector passes."""
        scores = self.scores(unit)
        most = [s.max(axis=1) for s in scores]
        found = []
        for v in range(len(unit)):
            sums, numbers = np.zeros(1), np.zeros(1, np.int64)
            rest = sum(m[v] for m in most)
            for s, m in zip(scores, most):
                rest -= m[v]
                further = sums[:, None] + s[v]
                at, word = np.nonzero(further >= self.threshold - rest)
                sums, numbers = further[at, word], numbers[at] * s.shape[1] + word
            found.append(np.sort(numbers))
        return found


def small_code(dim: int, per_vector: int, min_cosine: float, seed: int) -> ProductCode:
    """One block for vectors of few components, most of which are far from every sum of words of several blocks.

    Caps are twice as wide as the angle of a link, or wider, so that those of linked vectors overlap well,
    and there are as many words as bring a vector into ``per_vector`` caps on average.
    """
    trial = np.random.RandomState(seed).normal(size=(200_000, dim))
    cosines = trial[:, 0] / np.linalg.norm(trial, axis=1)
    widest = np.cos(min(np.pi, 2 * np.arccos(np.clip(min_cosine, -1, 1))))
    threshold = min(widest, float(np.quantile(cosines, max(0.0, 1 - per_vector / SMALL_WORDS)))) - 1e-9
    code = ProductCode(dim, 1, max(1, round(per_vector / np.mean(cosines >= threshold))), per_vector, seed)
    code.threshold = threshold
    return code


@lru_cache(8)
def product_codes(dim: int, blocks: int, codewords: int, codes: int, per_vector: int, min_cosine: float, seed: int) -> list[ProductCode]:
    if dim < SMALL_DIM:
        return [small_code(dim, per_vector, min_cosine, seed + k) for k in range(codes)]
    return [ProductCode(dim, blocks, codewords, per_vector, seed + k) for k in range(codes)]


def decode_all(codes: list[ProductCode], unit: np.ndarray) -> list[np.ndarray]:
    """The sorted numbers of the filters each vector passes, of all codes."""
    every = max(c.words[0].shape[1] ** len(c.words) for c in codes)
    return [np.concatenate([f + k * every for k, f in enumerate(found)]) for found in zip(*(c.decode(unit) for c in codes))]


def unit_rows(block: np.ndarray) -> np.ndarray:
    block = block / np.abs(block).max(axis=1)[:, None]  # no overflow or underflow in the squares
    return block / np.linalg.norm(block, axis=1)[:, None]


def cell_begins(table: pa.Table) -> np.ndarray:
    """Where a new cell begins in rows sorted by cell."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in CELL:
        column = table.column(name).combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
    return np.flatnonzero(new)


def _linked(table: pa.Table, begins: np.ndarray, width: str, min_cosine: float) -> Iterator[pa.RecordBatch]:
    """Of whole cells: each vector's number of links that count here, and links that connect them."""
    if not len(begins):
        return
    plain = {c: table.column(c).to_numpy() for c in ("dim", "filter", "first", "second", "chunk", "copies", "rep")}
    raw = table.column("raw").to_pylist()
    filters = table.column("filters").combine_chunks()
    at, values = np.asarray(filters.offsets), np.asarray(filters.values)
    own = lambda i: values[at[i] : at[i + 1]]
    sizes = np.diff(np.append(begins, table.num_rows))
    across = plain["first"] != plain["second"]
    pairs = []

    def hits(rows: np.ndarray) -> np.ndarray:
        """Of cells of one size (a row each): which pairs reach the threshold."""
        block = unit_rows(np.frombuffer(b"".join(raw[i] for i in rows.ravel()), width).reshape(rows.size, -1).astype(float))
        block = block.reshape(*rows.shape, -1)
        found = np.triu(block @ block.transpose(0, 2, 1) >= min_cosine, 1)
        other = plain["chunk"][rows]
        return found & ~(across[rows[:, :1, None]] & (other[:, :, None] == other[:, None, :]))

    for dim, size in sorted(set(zip(plain["dim"][begins].tolist(), sizes.tolist()))):
        cells = begins[(sizes == size) & (plain["dim"][begins] == dim)][:, None] + np.arange(size)
        step = max(1, 4_000_000 // (size * max(size, dim)))
        for k in range(0, len(cells) if size > 1 else 0, step):
            rows = cells[k : k + step]
            for cell, found in zip(rows, hits(rows)):
                if not found.any():
                    continue
                used = np.flatnonzero(found.any(axis=0) | found.any(axis=1))
                # pairs with a smaller common filter count there
                lower = [f[f < plain["filter"][cell[0]]] for f in map(own, cell[used])]
                names, column, count = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
                both = count[column] > 1
                if both.any():
                    inside = np.zeros((len(used), len(names)), dtype=np.float32)
                    inside[np.repeat(np.arange(len(used)), [len(f) for f in lower])[both], column[both]] = 1
                    inside = inside[:, count > 1]
                    found[np.ix_(used, used)] &= inside @ inside.T == 0
                one, two = np.nonzero(found)
                pairs.append(cell[np.stack([one, two])])
    if not pairs:
        return
    one, two = np.concatenate(pairs, axis=1)
    n = np.zeros(table.num_rows, dtype=np.int64)
    np.add.at(n, one, plain["copies"][two])
    np.add.at(n, two, plain["copies"][one])
    some = pa.array(np.flatnonzero(n))
    names, place = np.unique(plain["rep"], return_inverse=True)
    forest = Forest(len(names))
    for i, j in zip(place[one].tolist(), place[two].tolist()):
        forest.union(i, j)
    links = names[np.array(forest.edges, dtype=int).reshape(-1, 2)]
    columns = ["label", "h1", "h2", "n", "a", "b"]
    keys = [table.column(c).combine_chunks().take(some) for c in columns[:3]]
    none = lambda count, kind=pa.int64(): pa.nulls(count, kind)
    if len(some):
        yield pa.record_batch([*keys, pa.array(n[np.asarray(some)]), none(len(some)), none(len(some))], names=columns)
    if len(links):
        empty = [none(len(links), keys[0].type), *(none(len(links)) for _ in range(3))]
        yield pa.record_batch([*empty, pa.array(links[:, 0]), pa.array(links[:, 1])], names=columns)


def link_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.93,
    blocks: int = BLOCKS,
    codewords: int = CODEWORDS,
    codes: int = CODES,
    per_vector: int = FILTERS_PER_VECTOR,
    cell_rows: int = CELL_ROWS,
    seed: int = 7,
) -> DataFrame:
    """Per vector: id, ``n_links``, ``component_id`` and ``kept`` (it is its component's smallest id).

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine in
    double precision is at least ``min_cosine``. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, nor does a row without id (null component, kept). Rows with
    one id are separate vectors of one node. Pairs below the threshold are never linked; the part of
    linked pairs found is measured in the tests. Ids are whole numbers.
    """
    spark = prepare(vectors.sparkSession)
    ident, vector, label = (F.col(f"`{c}`") for c in (id_col, vector_col, label_col))
    plain = vectors.select(ident.cast("long").alias("id"), label.alias("label"), vector.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = plain.withColumn("usable", usable).withColumns(dict(zip(("h1", "h2"), hash128(F.col("v"), ("h1", "h2")))))
    rows = written(keyed.select("id", "label", "h1", "h2", "usable"), "vector-rows")
    key = ["label", "h1", "h2"]
    classes = keyed.where("usable").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))

    width = "<f4" if "array<float>" == vectors.schema[vector_col].dataType.simpleString() else "<f8"  # exact either way
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            lists = [np.array(v) for v in batch.column("v").to_pylist()]
            filters = [None] * len(lists)
            for dim in {len(v) for v in lists}:
                at = [k for k, v in enumerate(lists) if len(v) == dim]
                own = product_codes(dim, blocks, codewords, codes, per_vector, min_cosine, seed)
                for k, found in zip(at, decode_all(own, unit_rows(np.stack([lists[k] for k in at])))):
                    filters[k] = found
            names = [*key, "rep", "copies"]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array([len(v) for v in lists], pa.int32()), pa.array([v.astype(width).tobytes() for v in lists], pa.binary()), pa.array(filters, pa.list_(pa.int64()))],
                names=[*names, "dim", "raw", "filters"],
            )

    kind = keyed.schema["label"].dataType.simpleString()
    decoded = written(
        classes.select(*key, "rep", "copies", "v").mapInArrow(
            decode, f"label {kind}, h1 long, h2 long, rep long, copies long, dim int, raw binary, filters array<long>"
        ),
        "vector-filters",
    )
    passes = decoded.select("label", "dim", F.explode("filters").alias("filter"), "h1", "h2")
    bucket = ["label", "dim", "filter"]
    shared = passes.groupBy(*bucket).agg(F.count("*").alias("rows")).where("rows > 1")
    cut = shared.select(*bucket, F.ceil(F.col("rows") / cell_rows).cast("int").alias("chunks"))
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("h1", "h2"), F.col("chunks"))).otherwise(0).cast("int")
    met = passes.join(cut, bucket).withColumn("chunk", chunk)
    # of a vector's filters, those that others pass too
    met = written(met, "vector-meetings")
    common = met.groupBy("label", "h1", "h2").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    # each chunk of a bucket meets itself and every other one in a cell of their own
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(*bucket, F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "chunk", "h1", "h2")
    payload = decoded.drop("filters").join(common, key).select(
        F.col("label").alias("l"), F.col("h1").alias("a"), F.col("h2").alias("b"), "rep", "copies", "raw", "filters"
    )
    cells = met.join(payload, (F.col("label") == F.col("l")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))

    kinds = f"label {kind}, h1 long, h2 long, n long, a long, b long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the cells; rows come sorted by cell. A row is a vector's number of links, or a link of two classes."""
        held, size = [], 0
        for batch in arrow_batches(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= FLUSH_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                begins = cell_begins(table)
                yield from _linked(table.slice(0, begins[-1]), begins[:-1], width, min_cosine)
                rest = table.slice(begins[-1])
                held, size = rest.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _linked(table, cell_begins(table), width, min_cosine)

    columns = [*CELL, "chunk", "h1", "h2", "rep", "copies", "raw", "filters"]
    by_cell = cells.select(*columns).repartition(*CELL).sortWithinPartitions(*CELL)
    compared = written(by_cell.mapInArrow(compare, kinds), "vector-links")
    counts = compared.where("n is not null").groupBy(*key).agg(F.sum("n").alias("n"))
    found = connected_components(compared.where("a is not null").select("a", "b"))
    judged = (
        decoded.select(*key, "rep", "copies")
        .join(counts, key, "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select(
            *(F.col(c).alias(f"c_{c}") for c in key),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    same = F.col("usable") & (F.col("label") == F.col("c_label")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))
    component = F.coalesce("component_id", "id")
    return rows.join(judged, same, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
