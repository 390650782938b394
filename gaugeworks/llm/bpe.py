"""Byte-level BPE encoding and decoding through a table of distinct words.

1. Spark splits the texts into words (the tokenizer's own pre-tokens) and each task numbers the words
   of a chunk of texts: a chunk is a row with its distinct words and, per text, word numbers by position.
2. The words of all chunks meet by buckets of their hashes, and each distinct word is encoded once.
3. The ids of a chunk's words return to the chunk by a join, and the numbers by position become ids.
4. Ids become pieces by the id-to-piece table, which has the fixed size of the vocabulary.

Neither texts nor word numbers are shuffled: chunks are a table bucketed by chunk, so the join only moves
the words' ids. A word occurs once per chunk, so a frequent one is no heavier than others. What is
written or moved is packed: frequent words have small numbers, and a bucket's words of a chunk are a row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import wordscan
from gaugeworks.llm.common import arrow_batches, prepare, slices, text_arrays
from gaugeworks.plans.materialize import new_folder

#: Fixed value: white space as the tokenizers library's splitting pattern has it.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Fixed value: the splitting pattern of byte-level BPE, in Java's notation.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+"
)
#: Code points that Java's tables don't know yet may be letters to the library; it splits such texts itself.
UNKNOWN = r"\p{Cn}"
CHUNK_BYTES = 64 << 20
DECODE_TOKENS = 200_000
BUCKETS = 2048
CACHE_WORDS = 300_000


class Vocabulary:
    """A tokenizer file's content, shipped to tasks by value; each worker process parses it once."""

    _parsed: dict = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.content = file.read()
        spec = json.loads(self.content)
        split = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or spec.get("normalizer") or split.get("add_prefix_space"):
            raise ValueError(f"{path}: byte-level BPE without normalizer and prefix space is expected")
        added = spec.get("added_tokens", [])
        if len(added) > 1 or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: at most one added token, without stripping, is expected")
        self.special = added[0]["content"] if added else None
        self.key = hashlib.sha256(self.content.encode()).hexdigest()

    def tokenizer(self):
        if self.key not in self._parsed:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            found = Tokenizer.from_str(self.content)
            found.no_truncation()
            found.no_padding()
            self._parsed[self.key] = found
        return self._parsed[self.key]

    def encode(self, words: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), 4096):
            out += [e.ids for e in self.tokenizer().encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
        return out

    def split(self, text: str) -> list[str]:
        """The library's own split of a text, special strings apart."""
        parts = re.split(f"({re.escape(self.special)})", text) if self.special else [text]
        found = []
        for k, part in enumerate(parts):
            found += [part] if k % 2 else [part[a:b] for _, (a, b) in self.tokenizer().pre_tokenizer.pre_tokenize_str(part)]
        return [w for w in found if w]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces by id, as offsets and one array; the table is as large as the vocabulary."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        to_byte = {chr(c): c for c in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        by_id = sorted((i, piece) for piece, i in self.tokenizer().get_vocab(with_added_tokens=True).items())
        if [i for i, _ in by_id] != list(range(len(by_id))):
            raise ValueError("ids are expected to be 0, 1, 2 and so on")
        raw = [piece.encode() if piece == self.special else bytes(map(to_byte.__getitem__, piece)) for _, piece in by_id]
        return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8)


def words(text: Column, special: str | None) -> Column:
    """The words of a text, in order; ``special`` is a word of its own. Null or empty: none."""

    def plain(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))

    text = F.coalesce(text, F.lit(""))
    if special is None:
        return plain(text)
    parts = F.split(text, re.escape(special), -1)
    between = F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, plain(p)).otherwise(F.concat(F.array(F.lit(special)), plain(p)))))
    return F.when(text.contains(special), between).otherwise(plain(text))


def split_words(docs: DataFrame, text: Column, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ``words`` by Spark, and ``unsplit``: the few texts that the library must split."""
    unknown = F.coalesce(text.rlike(UNKNOWN), F.lit(False))
    return docs.select("*", F.when(unknown, text).alias("unsplit"), F.when(~unknown, words(text, vocabulary.special)).alias("words"))


def word_arrays(batch: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, pa.Array]:
    """Words per row and all words of a batch of ``split_words``."""
    column, rest = batch.column("words"), batch.column("unsplit")
    if rest.null_count < len(rest):
        lists = [w if t is None else vocabulary.split(t) for w, t in zip(column.to_pylist(), rest.to_pylist())]
        column = pa.array(lists, pa.list_(pa.string()))
    counts = np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, int)
    return counts, column.flatten()


def encode(
    docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, Vocabulary]:
    """Encoded chunks of documents, for ``decoded``: ids, word numbers by position, and token ids of the words.

    Null and empty texts have no tokens. Repeated ids and rows stay apart, as chunks hold rows.
    """
    prepare(docs.sparkSession)
    vocabulary = Vocabulary(vocabulary_path)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("words", T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("packed", T.BinaryType())]))),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("numbers", T.BinaryType()),
        ]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            flat = pa.chunked_array([w for _, _, w in held]).unify_dictionaries()
            flat = flat.combine_chunks()
            indices = np.asarray(flat.indices)
            by_use = np.argsort(-np.bincount(indices, minlength=len(flat.dictionary)), kind="stable")
            rank = np.empty(len(by_use), np.uint32)
            rank[by_use] = np.arange(len(by_use))
            one = lambda values: pa.array([values])
            as_list = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.record_batch(
                {
                    "chunk": one((partition << 32) + seq),
                    "words": as_list(by_bucket(flat.dictionary.take(pa.array(by_use)))),
                    "ids": as_list(pa.concat_arrays([i for i, _, _ in held])),
                    "counts": as_list(pa.array(np.concatenate([c for _, c, _ in held]), pa.int32())),
                    "numbers": one(pack(rank[indices])),
                }
            )

        for batch in arrow_batches(batches):
            counts, flat = word_arrays(batch, vocabulary)
            held.append((batch.column(0), counts, flat.dictionary_encode()))
            size += flat.nbytes
            if size >= chunk_bytes:
                yield chunk()
                seq, held, size = seq + 1, [], 0
        if held:
            yield chunk()

    text = F.col(f"`{text_col}`")
    rows = split_words(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")), F.col("text"), vocabulary)
    numbered = rows.select("id", "unsplit", "words").mapInArrow(number, schema)
    chunks = bucketed(numbered, "chunks", "chunk")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For words by bucket: the ids of each chunk's words; a word is encoded when its bucket first has it."""
        known: dict[bytes, np.ndarray] = {}
        last = None
        for batch in arrow_batches(batches):
            buckets = np.asarray(batch.column("bucket"))
            if len(known) > CACHE_WORDS and buckets[0] != last:
                known.clear()
            last = buckets[-1]
            found = [unpack_words(p) for p in batch.column("packed").to_pylist()]
            new = [w for w in dict.fromkeys(w for _, words in found for w in words) if w not in known]
            known.update((w, np.array(ids, np.uint32)) for w, ids in zip(new, vocabulary.encode([w.decode() for w in new])))
            tokens = []
            for numbers, words in found:
                ids = [known[w] for w in words]
                tokens.append(pack_numbered(numbers, [len(i) for i in ids], np.concatenate(ids)))
            yield pa.record_batch({"chunk": batch.column("chunk"), "tokens": pa.array(tokens, pa.binary())})

    words_of = chunks.select("chunk", F.inline("words"))
    met = words_of.repartition("bucket").sortWithinPartitions("bucket")
    per_chunk = met.select("chunk", "bucket", "packed").mapInArrow(encode_words, "chunk long, tokens binary")
    per_chunk = per_chunk.groupBy("chunk").agg(F.collect_list("tokens").alias("tokens"))
    return chunks.drop("words").join(per_chunk, "chunk", "left"), vocabulary


def bucketed(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir`` that is joined by ``key`` without a shuffle."""
    spark = df.sparkSession
    name = f"llm_{purpose}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    writer.option("compression", "zstd").option("path", new_folder(spark, f"llm-{purpose}")).saveAsTable(name)
    return spark.table(name)


def by_bucket(words: pa.Array) -> pa.Array:
    """Numbered words as one packed string for each bucket of their hashes."""
    offsets, data = text_arrays(words)
    bucket = (wordscan.span_hashes(data, offsets[:-1], offsets[1:], lower=False) % np.uint64(BUCKETS)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    offsets, data = text_arrays(words.take(pa.array(order)))
    names, first = np.unique(bucket[order], return_index=True)
    packed = []
    for a, b in zip(first, [*first[1:], len(order)]):
        raw = data[offsets[a] : offsets[b]].tobytes()
        packed.append(pack_numbered(order[a:b], np.diff(offsets[a : b + 1]), np.empty(0)) + raw)
    return pa.StructArray.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])


def pack_numbered(numbers: np.ndarray, lengths, values: np.ndarray) -> bytes:
    """Ascending numbers, a length for each, and values, packed; the first four bytes tell how long that is."""
    packed = pack(np.concatenate([[len(numbers)], np.diff(numbers, prepend=0), lengths, values]).astype(np.uint32))
    return len(packed).to_bytes(4, "little") + packed


def unpack_numbered(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    end = 4 + int.from_bytes(packed[:4], "little")
    found = unpack(packed[4:end])
    n = int(found[0])
    return np.cumsum(found[1 : 1 + n], dtype=np.int64), found[1 + n : 1 + 2 * n], found[1 + 2 * n :], packed[end:]


def unpack_words(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    numbers, lengths, _, raw = unpack_numbered(packed)
    ends = np.cumsum(lengths).tolist()
    return numbers, [raw[a:b] for a, b in zip([0, *ends], ends)]


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers as a compressed string: their lowest bytes, then the next ones, and so on."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def gather(begins: np.ndarray, lengths: np.ndarray, values: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``picked`` of lists stored in one array: where each begins in the result, and all their values."""
    own = lengths[picked].astype(np.int64)
    out = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(out[-1]) + np.repeat(begins[picked] - out[:-1], own)
    return out, values[at]


def word_tokens(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words by number: where the ids begin, how many there are, and all ids."""
    parts = [unpack_numbered(p) for p in packed]
    numbers, lengths, ids = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.uint32)]) for k in range(3))
    numbers = numbers.astype(np.int64)
    begin, length = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    begin[numbers], length[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
    return begin, length, ids


def decoded(
    encoded: DataFrame, vocabulary: Vocabulary, result: Callable[[np.ndarray, str], tuple], schema: T.StructType
) -> DataFrame:
    """One row per document: its id and what ``result`` makes of its token ids and its decoded text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            for ids, counts, numbers, tokens in zip(*(batch.column(c) for c in ("ids", "counts", "numbers", "tokens"))):
                begins, lengths, word_ids = word_tokens(tokens.as_py() or [])
                word_begin, all_ids = gather(begins, lengths, word_ids, unpack(numbers.as_py()))
                piece_at, piece_bytes = pieces.value
                token_begin = word_begin[np.concatenate([[0], np.cumsum(np.asarray(counts.values))])]
                for first, last in slices(token_begin, DECODE_TOKENS):
                    own = all_ids[token_begin[first] : token_begin[last]]
                    begin = token_begin[first : last + 1] - token_begin[first]
                    piece_begin, data = gather(piece_at[:-1], np.diff(piece_at), piece_bytes, own)
                    data, cut = data.tobytes(), piece_begin[begin]
                    found = [
                        result(own[begin[k] : begin[k + 1]], data[cut[k] : cut[k + 1]].decode(errors="replace")) for k in range(last - first)
                    ]
                    columns = [ids.values.slice(first, last - first), *(list(c) for c in zip(*found))]
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return encoded.select("ids", "counts", "numbers", "tokens").mapInArrow(rows, schema)


def round_trip(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens``, and SHA-256 of its ids and of the text decoded from them."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def digest(ids: np.ndarray, text: str) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    encoded, vocabulary = encode(docs, vocabulary_path, id_col=id_col, text_col=text_col)
    return decoded(encoded, vocabulary, digest, schema)


def tokens_and_text(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, its ``tokens`` and the ``decoded`` text."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("tokens", T.ArrayType(T.LongType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    encoded, vocabulary = encode(docs, vocabulary_path, id_col=id_col, text_col=text_col)
    return decoded(encoded, vocabulary, lambda ids, text: (ids.tolist(), text), schema)
