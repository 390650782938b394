"""Lines that several documents share stay in one of them only.

Built-in functions throughout: lines are exploded and hashed to 128 bits, documents are counted per
hash with map-side combining, and each document gets back one flag per line, ordered by position.
Texts move once, to meet their flags; the other shuffles carry hashes, ids and positions. A line that
stands in very many documents is one group of counts, and its occurrences are the left side of an
outer join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import BLANKS, ascii_lower, hash128, written


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, counts: bool = True
) -> DataFrame:
    """``docs`` without repeated lines, plus ``n_lines`` and ``n_dropped`` with ``counts``.

    A key of at least ``min_chars`` characters found in at least ``min_docs`` documents loses all its
    lines except in the smallest document holding it. Rows with one id are one document; each row
    keeps its own text. A null id is not counted as a document and loses every shared line. A null or
    empty text is one empty line. All columns stay, whatever their names; no row is added or lost.
    """
    names = {c.lower() for c in docs.columns}
    own = lambda name: name if name not in names else own(f"_{name}")
    t1, t2, pos, h1, h2, keeper, line, flags = map(own, ("t1", "t2", "pos", "h1", "h2", "keeper", "line", "flags"))
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    # the row's identity: its id and a hash of its text, so repeated ids with other texts stay apart
    lines = (
        docs.select(ident.alias(id_col), *hash128(text, (t1, t2)), F.posexplode(F.split(text, "\n")).alias(pos, line))
        .withColumn(line, line_key(F.col(line)))
        .select(id_col, t1, t2, pos, *hash128(F.col(line), (h1, h2)), (F.char_length(line) >= min_chars).alias(line))
    )
    shared = (
        lines.where(F.col(line))
        .select(h1, h2, id_col)
        .distinct()
        .groupBy(h1, h2)
        .agg(F.count(id_col).alias(keeper + "s"), F.min(id_col).alias(keeper))
        .where(F.col(keeper + "s") >= min_docs)
        .drop(keeper + "s")
    )
    # written, so that the lines meet them in a join of two shuffles, whose hot keys are split
    shared = written(shared, "shared-lines")
    gone = F.col(keeper).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(keeper))
    marked = (
        lines.join(shared, [h1, h2], "left")
        .groupBy(id_col, t1, t2)
        .agg(F.sort_array(F.collect_set(F.struct(F.col(pos), gone.alias("gone")))).alias(flags))
        .select(F.col(id_col).alias(keeper), F.col(t1).alias(h1), F.col(t2).alias(h2), F.col(f"{flags}.gone").alias(flags))
    )
    left = docs.withColumns(dict(zip((t1, t2), hash128(text, (t1, t2)))))
    joined = left.join(
        marked, ident.eqNullSafe(F.col(keeper)) & (F.col(t1) == F.col(h1)) & (F.col(t2) == F.col(h2)), "left"
    )
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.get(F.col(flags), i))
    added = {"n_lines": F.size(flags), "n_dropped": F.size(F.filter(flags, lambda f: f))} if counts else {}
    columns = [F.concat_ws("\n", kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in added]
    return joined.select(*columns, *(value.cast("long").alias(name) for name, value in added.items()))


def digest(deduped: DataFrame) -> DataFrame:
    """What the query returns of a result of ``dedup_lines``."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
