"""Deterministic WARC archives: range-sorted records in rolled shards, committed by a manifest.

Records are sorted by id across ranges, a task each; the bounds come from a seeded hash sample of ids and
their sizes, so the same rows give the same files on any cluster. A file ends when its compressed bytes
reach the limit, several times in a range. A task writes its shards under temporary names,
moves each to its final name when it is complete, and reports it in a manifest that Spark's committer
publishes. A repeated or lost task writes the same bytes again. Files the manifest lacks are not read.

Each record is a gzip member of its own. Headers and digests are made anew. Of records with an equal
payload the first is a response, the others are revisits, which carry no payload.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import arrow_batches, prepare, written
from gaugeworks.plans.materialize import new_folder

RANGE_BYTES = 128 << 20  # of payload
ROLL_BYTES = 16 << 20  # of gzip; pages are packed to a third or less
SAMPLE_ROWS, SAMPLE_PER_RANGE = 200_000, 16  # ids that reach the driver, at any size of the input
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, path string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
LEVEL = 6
_URL_CHARACTERS = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")


def _storage(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; a plain path is a mounted one."""
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


#: Names that Hadoop's connectors have for stores pyarrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _uri(spark: SparkSession, folder: str, make: bool = False) -> str:
    """The shared folder as tasks open it: mount tables are resolved, and schemes have pyarrow's names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(path)
    return _renamed(fs.resolvePath(path).toString())


def _renamed(uri: str) -> str:
    scheme, colon, rest = uri.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        rest = f"//{rest}"
    return SCHEMES.get(scheme, scheme) + colon + rest


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    """A name for a record that every run gives it anew."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{nth}')}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member; the header lines come in the order given."""
    lines = {"WARC-Type": kind, "WARC-Date": DATE, **headers, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # 31: gzip, whose header then has no time
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, digest: str, nth: int, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = {"WARC-Record-ID": record_id(page_id, digest, nth)}
    if url is not None:
        # a line end in a url would end the header
        plain = url.isprintable()
        headers["WARC-Target-URI"] = url if plain else quote(url, safe=_URL_CHARACTERS)
        if not plain:
            headers["X-Target-URI-Encoding"] = "percent"
    headers |= {
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest, 0), "X-Refers-To-Page-ID": str(refers_to)}
    return record("revisit" if revisit else "response", headers, block)


class _Shard:
    """A file that grows under a temporary name and gets its own when it is whole."""

    def __init__(self, folder: str, shard: int, part: int):
        self.fs, base = _storage(folder)
        self.shard, self.part, self.records, self.bytes, self.digest = shard, part, 0, 0, hashlib.sha256()
        self.name = f"records-{shard:06d}-{part:04d}.warc.gz"
        self.path = f"{base}/{self.name}"
        context = TaskContext.get()
        self.held = f"{base}/_temporary-{self.name}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        self.file = self.fs.open_output_stream(self.held, compression=None)
        info = f"software: gaugeworks\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\npart: {part}\r\n".encode()
        headers = {"WARC-Record-ID": record_id(None, "info", shard << 20 | part), "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}
        self._write(record("warcinfo", headers, info))

    def _write(self, raw: bytes) -> None:
        self.file.write(raw)
        self.digest.update(raw)
        self.bytes += len(raw)

    def add(self, raw: bytes) -> None:
        self._write(raw)
        self.records += 1

    def commit(self) -> tuple:
        self.file.close()
        self.fs.move(self.held, self.path)  # another attempt's file has the same bytes
        return self.shard, self.part, self.name, self.records, self.bytes, self.digest.hexdigest()


def range_bounds(ids: np.ndarray, sizes: np.ndarray, ranges: int) -> np.ndarray:
    """First ids of all ranges but the first, so that each has about as many bytes."""
    order = np.argsort(ids)
    upto = np.cumsum(sizes[order])
    if not len(upto) or not upto[-1]:
        return np.empty(0, np.int64)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges, side="right")
    return np.unique(ids[order][np.minimum(at, len(ids) - 1)])


def write_archive(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    range_bytes: int = RANGE_BYTES,
    roll_bytes: int = ROLL_BYTES,
    min_revisit: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the committed manifest.

    A null html is an empty payload. Of equal payloads of at least ``min_revisit`` bytes, the one with the
    smallest id is the response; rows with that very id and payload are revisits of the first of them. A
    row without id never is the one referred to, unless no equal one has an id. Ids are whole numbers.
    About ``range_bytes`` of payload make a sorted range (one task), more where the sample of ids has too few
    for so many ranges. ``roll_bytes`` of gzip end a file.
    """
    spark = prepare(pages.sparkSession)
    folder = _uri(spark, folder, make=True)
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = written(keyed.select("id", "digest", F.octet_length("payload").alias("size")), "warc-digests")

    first = (
        narrow.where(F.col("size") >= min_revisit)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select(F.col("digest").alias("same"), "first_id")
    )
    # one mark in front of the rows that are revisits; it meets them by sorting, not by a join with texts
    marks = narrow.join(first, F.col("digest") == F.col("same")).select("id", "digest", "first_id").distinct()

    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("id")).first()
    ranges = min(max(1, -(-total[0] // range_bytes)), SAMPLE_ROWS // SAMPLE_PER_RANGE)
    every = max(1, -(-total[1] // SAMPLE_ROWS))
    in_sample = F.pmod(F.xxhash64(F.lit("bounds"), "id"), F.lit(every)) == 0
    bounds = np.empty(0, np.int64)
    if ranges > 1:
        sampled = narrow.where(F.col("id").isNotNull() & in_sample).groupBy("id").agg(F.sum("size").alias("size")).toArrow()
        bounds = range_bounds(np.asarray(sampled["id"]), np.asarray(sampled["size"]), ranges)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype("int32"))

    # rows without id go by their payload
    known = F.coalesce("id", F.lit(0))
    shard = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(len(bounds) + 1)).cast("int")).otherwise(shard_of(known))
    one = keyed.select("id", "digest", "url", "payload", F.lit(None).cast("long").alias("first_id"), F.lit(1).alias("kind"))
    two = marks.select("id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first_id", F.lit(0).alias("kind"))
    placed = one.unionByName(two).withColumn("shard", shard)
    order = ["shard", "id", "digest", "kind", "url"]
    dealt = placed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, mark, nth = None, [], None, 0
        for batch in arrow_batches(batches):
            for shard, page_id, digest, kind, url, raw, first_id in zip(*(c.to_pylist() for c in batch.columns)):
                same = mark is not None and mark[:2] == (page_id, digest)
                if kind == 0:
                    mark, nth = (page_id, digest, first_id), 0
                    continue
                nth = nth + 1 if same else 0
                refers_to = mark[2] if same and (page_id != mark[2] or nth > 1) else None
                if file is None or file.shard != shard or file.bytes >= roll_bytes:
                    part = file.part + 1 if file is not None and file.shard == shard else 0
                    done += [file.commit()] if file is not None else []
                    file = _Shard(folder, shard, part)
                file.add(page_record(page_id, url, raw, digest, max(0, nth - 1), refers_to))
        done += [file.commit()] if file is not None else []
        names = ["shard", "part", "path", "records", "bytes", "sha256"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        if done:
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=names)

    manifest = dealt.select("shard", "id", "digest", "kind", "url", "payload", "first_id").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(raw: io.RawIOBase, block: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of an archive's records, read a piece at a time."""
    unpacker, held = zlib.decompressobj(31), []
    while data := raw.read(block):
        while data:
            held.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                head, _, body = b"".join(held).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                headers = dict(line.split(": ", 1) for line in lines[1:])
                size = int(headers["Content-Length"])
                if lines[0] != "WARC/1.1" or body[size:] != b"\r\n\r\n":
                    raise ValueError("not a whole record")
                yield headers, body[:size]
                unpacker, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the archive ends within a record")


def read_archive(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The page records of all shards that the manifest lists, a task per shard; digests are checked.

    An archive of an empty table has no records.
    """
    prepare(spark)
    folder = _uri(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    top = manifest.agg(F.max("shard")).first()[0]
    columns = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def target(headers: dict[str, str]) -> str | None:
        url = headers.get("WARC-Target-URI")
        return unquote(url) if "X-Target-URI-Encoding" in headers else url

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=columns)

        for batch in arrow_batches(batches):
            for path in batch.column("path").to_pylist():
                fs, base = _storage(folder)
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as file:
                    for headers, block in records(file):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} does not have its digest")
                        rows.append(
                            (
                                number(headers.get("X-Page-ID")),
                                target(headers),
                                int(headers["X-Payload-Length"]) if payload is None else len(payload),
                                digest,
                                headers["WARC-Type"],
                                number(headers.get("X-Refers-To-Page-ID")),
                                payload if payloads else None,
                            )
                        )
                        size += len(payload or b"") if payloads else 0
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    dealt = manifest.repartitionById(1 + (top or 0), "shard")
    return dealt.select("path").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a fresh folder below the shared one and read the records back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "llm-warc")
    write_archive(pages, folder, **options)
    return read_archive(spark, folder, payloads=False).drop("payload", "url")
