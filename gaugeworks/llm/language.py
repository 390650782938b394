"""Language identification by cross-parsing entropy.

A suffix automaton per language, built from a bounded sample of labelled texts, tells how far a text can
be followed from any position within the sample's substrings. Parsing greedily, each longest match is a
phrase; a text of n symbols in c phrases against a sample of N symbols costs c * log2(N) / n bits a
symbol. The language with the fewest such normalised phrases wins.

Symbols are UTF-8 bytes with A-Z as a-z. Texts are parsed in segments of a fixed number of bytes, all of
a batch side by side: one numpy step follows one symbol of every segment in a language's automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import arrow_batches, prepare, slices, text_arrays

SAMPLE_DOCS = 200
SAMPLE_BYTES = 20_000
ALL_SAMPLE_BYTES = 200_000
SEGMENT_BYTES = 512
SLICE_BYTES = 4 << 20
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


class SuffixAutomaton:
    """The smallest automaton that follows exactly the substrings of a byte string, as a dense table.

    ``follow[state * width + symbol]`` is the next state, or 0 (the start) where there is none; column 0
    is for bytes that the samples lack.
    """

    def __init__(self, text: bytes, symbols: np.ndarray, width: int):
        links, lengths, moves, last = [-1], [0], [{}], 0
        for byte in symbols[np.frombuffer(text, np.uint8)].tolist():
            state = len(links)
            links.append(0)
            lengths.append(lengths[last] + 1)
            moves.append({})
            at = last
            while at >= 0 and byte not in moves[at]:
                moves[at][byte] = state
                at = links[at]
            if at >= 0:
                other = moves[at][byte]
                if lengths[other] == lengths[at] + 1:
                    links[state] = other
                else:
                    clone = len(links)
                    links.append(links[other])
                    lengths.append(lengths[at] + 1)
                    moves.append(dict(moves[other]))
                    while at >= 0 and moves[at].get(byte) == other:
                        moves[at][byte] = clone
                        at = links[at]
                    links[other] = links[state] = clone
            last = state
        self.follow = np.zeros(len(links) * width, dtype=np.int32)
        for state, found in enumerate(moves):
            for byte, to in found.items():
                self.follow[state * width + byte] = to * width
        self.bits = float(np.log2(max(2, len(text))))

    def phrases(self, columns: list[np.ndarray]) -> np.ndarray:
        """Phrases of every segment; ``columns[k]`` has the k-th symbols of the segments that are longer than k."""
        n = len(columns[0])
        state, count = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        for symbols in columns:
            m = len(symbols)
            ahead = self.follow[state[:m] + symbols]
            miss = ahead == 0
            count[:m] += miss
            # the phrase ends in front of the symbol, and the next one begins with it
            ahead[miss] = self.follow[symbols[miss]]
            state[:m] = ahead
        return count + (state != 0)


class Model:
    """Automata by language, in the order of their names."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.symbols = np.zeros(256, dtype=np.int32)
        self.symbols[used] = np.arange(1, len(used) + 1)
        self.automata = [SuffixAutomaton(samples[name], self.symbols, len(used) + 1) for name in self.names]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits a symbol, by text and language."""
        lengths = np.diff(offsets)
        per_text = -(-lengths // SEGMENT_BYTES)
        text = np.repeat(np.arange(len(lengths)), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = offsets[text] + nth * SEGMENT_BYTES
        length = np.minimum(SEGMENT_BYTES, offsets[text + 1] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, text = begin[order], length[order], text[order]
        coded = self.symbols[_FOLD[data]]
        longer = np.searchsorted(-length, -np.arange(length[0]) if len(length) else [], side="left")
        columns = [coded[begin[:m] + k] for k, m in enumerate(longer)]
        found = np.zeros((len(lengths), len(self.names)))
        for j, automaton in enumerate(self.automata if columns else []):
            found[:, j] = np.bincount(text, weights=automaton.phrases(columns), minlength=len(lengths)) * automaton.bits
        return found / np.maximum(lengths, 1)[:, None]


def samples(docs: DataFrame, label: Column, text: Column, key: Column, sample_docs: int, sample_bytes: int, all_bytes: int) -> dict[str, bytes]:
    """About ``sample_docs`` passages per label, up to ``sample_bytes`` together, in order of a seeded hash.

    This is the only bounded part: counts per label give each label's share of the hash range, and what
    reaches the driver is a passage of each document in that range; equal passages count once. All
    samples together have at most about ``all_bytes``.
    """
    labelled = docs.select(label.alias("label"), F.pmod(key, F.lit(1 << 40)).alias("order"), text.alias("text")).where("label is not null")
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return {}
    share = min(sample_bytes, all_bytes // len(counts))
    passage = max(64, 4 * share // sample_docs)
    limits = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, int((1 << 40) * min(1.0, sample_docs / n)))))
    begin = 1 + F.pmod(F.xxhash64("order"), F.greatest(F.lit(1), F.char_length("text") - passage))
    chosen = labelled.where(F.col("order") <= F.element_at(limits, F.col("label")))
    rows = chosen.select("label", "order", F.substring("text", begin.cast("int"), F.lit(passage)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    found: dict[str, bytes] = {}
    for r in sorted(rows.distinct().collect()):
        held = found.get(r.label, b"")
        if len(held) < share:
            raw = _FOLD[np.frombuffer(r.text.encode(), np.uint8)].tobytes()
            found[r.label] = (held + raw + b"\n")[:share]
    return found


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
    all_bytes: int = ALL_SAMPLE_BYTES,
) -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred`` and ``score``.

    Texts whose crc32 of the id modulo 4 is 2 are held out of the samples. Labels, sources and ids are no
    input of a prediction. ``und`` with score 0 where the text is null or has no letter, or nothing could
    be learned; ties go to the smaller name. The score is 1 - best / second bits a symbol (1 if there is
    one language only). A null id counts as the text '' for the fold. Repeated rows stay.
    """
    spark = prepare(docs.sparkSession)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    fold = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    learn = docs.where(~fold & F.col(f"`{label_col}`").isNotNull())
    label = F.col(f"`{label_col}`").cast("string")
    model = spark.sparkContext.broadcast(
        Model(samples(learn, label, text, F.xxhash64(F.lit("sample"), ident), sample_docs, sample_bytes, all_bytes))
    )
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(ident.alias("id"), fold.alias("held_out"), F.when(letters, text).alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value.names
        for batch in arrow_batches(batches):
            column = batch.column("text")
            offsets, data = text_arrays(column)
            found = [model.value.bits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE_BYTES)]
            bits, known = np.concatenate(found), np.asarray(column.is_valid()) & bool(names)
            if names:
                best = bits.argmin(axis=1)
                ranked = np.sort(bits, axis=1)
                second = ranked[:, 1] if len(names) > 1 else np.full(len(bits), np.inf)
                score = np.where(known, 1 - ranked[:, 0] / np.maximum(second, 1e-9), 0.0).clip(0, 1)
                predicted = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
            else:
                score, predicted = np.zeros(batch.num_rows), [UNDETERMINED] * batch.num_rows
            yield pa.record_batch([batch.column("id"), batch.column("held_out"), pa.array(predicted), pa.array(score)], names=schema.names)

    return narrow.mapInArrow(predict, schema)
