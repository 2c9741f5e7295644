"""Deterministic sharded WARC writer, and a reader of what it committed.

1. Payload digests and sizes are computed by Spark; of equal payloads the record with
   the smallest id is the response, found by one aggregation over digests.
2. Records are range-sorted: shard limits are ids at which the running total of bytes
   in id order passes a multiple of the shard size, so they follow from the data
   alone, not from sampling, partitions or cores.
3. One shuffle brings a shard's records together in order. The rows that say what a
   record revisits take part in that shuffle, just before their record.
4. Each task streams its shards into gzip-member-per-record files, rolled when the
   compressed size passes a limit; headers, digests and record ids are regenerated
   from content, so equal tables give equal bytes.
5. Files are written under a temporary name of the task attempt, then moved to their
   names, then listed in a manifest that is itself moved into place last. Readers go by
   the manifest: what a lost executor left behind is never seen.

Paths are URIs that pyarrow.fs opens (file:, hdfs:, s3:, gs:), reached by driver and
executors alike.

Defined results: a null payload is empty; a null URL is left out; of rows that repeat
id and payload the first is written as usual and the others revisit it; an empty table
commits an empty manifest; a null id is written as an empty value and read as null.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.llm import common as C

MANIFEST = "manifest.json"
_FILES = "shard int, roll int, temporary string, name string, records long, bytes long, sha256 string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- records


def record_id(page: object, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{repeat}')}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def response_or_revisit(page: object, url: str | None, payload: bytes, digest: str, refers: object, repeat: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shown = "" if page is None else page
    headers: list[tuple[str, object]] = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, digest, repeat)), ("WARC-Date", date), ("WARC-Page-ID", shown)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        return _member(headers, http + payload)
    return _member([*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Refers-To-Page-ID", refers)], http)


class ShardFiles:
    """The files of one shard, under temporary names."""

    def __init__(self, root: str, shard: int, roll_bytes: int, date: str) -> None:
        self.fs, self.path = _open(root)
        self.shard, self.roll_bytes, self.date = shard, roll_bytes, date
        self.roll, self.out, self.done = 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.roll:04d}.warc.gz"
            self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}")
            self.records, self.bytes, self.sum = 0, 0, sha256()
            info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, "info")), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)
        self.sum.update(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.roll, self.temporary, self.name, self.records, self.bytes, self.sum.hexdigest()))
            self.out, self.roll = None, self.roll + 1


def _write_shards(batches: Iterator[pa.RecordBatch], root: str, roll_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    files, refers, before, repeat = None, None, None, 0
    done: list[tuple] = []
    for batch in batches:
        shards, pages, digests, kinds, targets, urls, payloads = (batch.column(c) for c in ("shard", "page", "digest", "kind", "refers", "url", "payload"))
        for i in range(batch.num_rows):
            shard, page, digest = shards[i].as_py(), pages[i].as_py(), digests[i].as_py()
            if files is None or files.shard != shard:
                if files is not None:
                    files.close()
                    done += files.done
                files = ShardFiles(root, shard, roll_bytes, date)
            if kinds[i].as_py() == 0:  # what the records of this page and payload revisit
                refers = (page, digest, targets[i].as_py())
                continue
            repeat = repeat + 1 if before == (page, digest) else 0
            before = (page, digest)
            payload = (payloads[i].as_py() or "").encode()
            to = refers[2] if refers and refers[:2] == before else None
            if to is None and repeat and len(payload) >= 100:
                to = page
            files.write(response_or_revisit(page, urls[i].as_py(), payload, digest, to, repeat, date))
    if files is not None:
        files.close()
        done += files.done
    names = [f.name for f in _files_schema()]
    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], _files_schema())


def _files_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("roll", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


# ---------------------------------------------------------------- shards


def shard_size(total: int, least: int = 4 << 20, most: int = 512 << 20, shards: int = 64) -> int:
    return max(least, min(most, -(-total // shards)))


def shard_limits(sizes: DataFrame, overhead: int = 512) -> list[int]:
    """The first id of every shard but the first. sizes: (page, bytes), rows of an id stay together."""
    spark = sizes.sparkSession
    per_id = sizes.where("page is not null").groupBy("page").agg(F.sum(F.col("bytes") + overhead).alias("bytes"))
    per_id = C.saved(per_id, "page-bytes")
    total, count = per_id.agg(F.sum("bytes"), F.count("*")).first()
    if not count:
        return []
    size = shard_size(total)
    spans = max(1, -(-count // 100_000))
    sorted_ids = C.saved(per_id.repartitionByRange(spans, "page").withColumn("span", F.spark_partition_id()), "page-spans")
    starts, before = {}, 0
    for r in sorted_ids.groupBy("span").agg(F.sum("bytes").alias("bytes")).orderBy("span").collect():  # one row per 100,000 ids
        starts[r["span"]], before = before, before + r["bytes"]
    offsets = spark.createDataFrame(list(starts.items()), "span int, before long")
    earlier = Window.partitionBy("span").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    total_before = F.col("before") + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))
    placed = sorted_ids.join(offsets, "span").select("page", F.floor(total_before / size).alias("shard"))
    return [r["page"] for r in placed.groupBy("shard").agg(F.min("page").alias("page")).orderBy("shard").collect()][1:]  # one row per shard


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write all rows to the new folder root (a URI), and commit."""
    spark = pages.sparkSession
    payload = F.coalesce(pages[payload_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page"), F.sha2(payload, 256).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers"), pages[url_col].alias("url"), payload.alias("payload"))
    light = C.saved(rows.select("page", "digest", F.octet_length("payload").cast("long").alias("bytes")), "payloads")
    limits = np.array(shard_limits(light), np.int64)

    @F.pandas_udf("int")
    def shard_of(page: pd.Series) -> pd.Series:
        return pd.Series(np.where(page.isna(), 0, np.searchsorted(limits, page.fillna(0).astype(np.int64), side="right")).astype(np.int32))

    first = light.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page").alias("refers"))
    revisits = light.join(first, "digest").where("page > refers").select("page", "digest", "refers").distinct()
    revisits = revisits.select("page", "digest", F.lit(0).alias("kind"), "refers", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"))
    together = rows.unionByName(revisits).withColumn("shard", shard_of("page"))
    together = together.repartition(len(limits) + 1, "shard").sortWithinPartitions("shard", "page", "digest", "kind", "url")
    fs, path = _open(root)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    files = together.mapInArrow(lambda b: _write_shards(b, root, roll_bytes, date), _FILES).collect()  # one row per file
    commit(spark, root, [r.asDict() for r in files])


def commit(spark: SparkSession, root: str, files: list[dict]) -> None:
    """Move files to their names in tasks, then the manifest; moving again after a lost task does no harm."""
    if files:

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, path = _open(root)
            for batch in batches:
                for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if fs.get_file_info(f"{path}/{old}").type != pafs.FileType.NotFound:
                        fs.move(f"{path}/{old}", f"{path}/{new}")
                yield batch

        names = spark.createDataFrame([(f["temporary"], f["name"]) for f in files], "temporary string, name string")
        names.repartition(max(1, min(len(files), 64))).mapInArrow(move, names.schema).count()
    listed = sorted(({k: v for k, v in f.items() if k != "temporary"} for f in files), key=lambda f: f["name"])
    fs, path = _open(root)
    with fs.open_output_stream(f"{path}/_temporary/{MANIFEST}") as out:
        out.write(json.dumps({"files": listed}, indent=1).encode())
    fs.move(f"{path}/_temporary/{MANIFEST}", f"{path}/{MANIFEST}")
    fs.delete_dir(f"{path}/_temporary")


# ---------------------------------------------------------------- reading


def read_members(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    with gzip.GzipFile(fileobj=stream) as data:
        while first := data.readline():
            if first.strip() != b"WARC/1.1":
                raise ValueError(f"not a record: {first[:40]!r}")
            headers = {}
            while line := data.readline().rstrip(b"\r\n"):
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            length = int(headers["content-length"])
            block = data.read(length)
            if len(block) != length or data.read(4) != b"\r\n\r\n":
                raise ValueError(f"{headers.get('warc-record-id')} is cut short")
            if headers["warc-block-digest"] != f"sha256:{sha256(block).hexdigest()}":
                raise ValueError(f"{headers['warc-record-id']} does not have its digest")
            yield headers, block


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Committed records: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    fs, path = _open(root)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}") as raw:
                    rows, held = [], 0
                    for headers, block in read_members(raw):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != length or sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
                        number = lambda x: int(x) if x else None
                        rows.append((number(headers["warc-page-id"]), headers.get("warc-target-uri"), length, digest, kind, number(headers.get("warc-refers-to-page-id")), payload.decode() if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return files.repartition(max(1, len(names))).mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])
