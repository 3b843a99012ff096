"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, commit by manifest.

Pages are cut into ranges of (page_id, payload digest); the bounds come from a sample chosen by a hash of the keys, so
equal tables give equal ranges, and each range is one sorted partition. A task turns its rows into records one by one:
headers and digests are regenerated, each record is a gzip member without a time stamp, and a new file starts once the
current one has ``file_bytes`` compressed bytes. A file is written under a temporary name of the task's attempt and
moved to its final name when it is complete; the name and all bytes follow from the rows, so a second attempt writes the
same files again. Every finished file is a row of the manifest. The manifest is written under a temporary name too, and
its renaming commits the whole archive: readers open the files it names, nothing else.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest ``page_id`` is a response and the
others are revisits without payload. Payloads are compared by SHA-256. Which pages are revisits is found on small rows of
(page_id, digest, size); these decisions travel to the page's range and sort right before the page, so page texts move
once. Rows of one common payload meet in a join that runtime skew handling splits.

``read_archives`` reads the files record by record, checks every digest and the counts of the manifest, and raises
``ValueError`` when one differs.

Defined cases: a null html is an empty payload; a null ``page_id`` sorts first, ranks below all ids, and equal payloads
without any id are all responses; rows that repeat the largest ``page_id`` of a payload are all responses; rows that
repeat a page_id and payload stay in one range and have record ids of their own; a null url is written as
``urn:x-no-url:`` and read as null, control characters and spaces in a url are percent-encoded; an empty table gives an
empty, committed archive; other columns are not read. A task holds one batch of pages and one file name at a time.

Files are reached by ``pyarrow.fs`` from tasks (local, hdfs, s3, gs), in a folder that driver and executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata_spark.llm.tasks import map_arrow
from strata_spark.session import work_path, written

MIN_BYTES = 1000
FILE_BYTES = 64 << 20
#: Payload bytes of a range, and keys sampled for each range to find the bounds.
RANGE_BYTES = 1 << 30
SAMPLED = 32
#: Payload bytes that a reader hands on at a time.
BATCH_BYTES = 8 << 20
#: Every record has this date: archives follow from the table alone.
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-archive")
NO_URL = "urn:x-no-url:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, MANIFEST_DRAFT, DRAFTS = "manifest", "manifest-draft", "drafts"


def _labelled(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def _bare(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", _labelled(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '/'.join(map(str, parts)))}>"


def _written_url(url: str | None) -> str:
    return NO_URL if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, sha256: str, repeat: int, refers_to: int | None) -> bytes:
    """The record of one page; ``repeat`` numbers rows of equal page_id and payload."""
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, sha256, repeat)), ("WARC-Date", DATE),
              ("WARC-Target-URI", _written_url(url)), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", _labelled(hashlib.sha1(payload).hexdigest()))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, sha256, 0)),
                   ("Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http if refers_to is not None else http + payload)


def _info_record(name: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name)), ("WARC-Date", DATE), ("WARC-Filename", name),
                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


class Shards:
    """The files of one range: drafts under a name of this attempt, moved into place when they are full."""

    def __init__(self, folder: str, number: int, file_bytes: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.number, self.file_bytes, self.done = number, file_bytes, 0
        self.drafts = f"{self.folder}/{DRAFTS}/{number}-{uuid.uuid4().hex}"
        self.stream = None

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def add(self, page_id: int | None, record: bytes) -> tuple | None:
        """The manifest row of a file that this record has filled."""
        if self.stream is None:
            self.store.create_dir(self.drafts, recursive=True)
            self.name = f"range-{self.number:06d}-{self.done:05d}.warc.gz"
            self.stream = self.store.open_output_stream(f"{self.drafts}/{self.name}", compression=None)
            self.sha1, self.bytes, self.records, self.first = hashlib.sha1(), 0, 0, page_id
            self._write(_info_record(self.name))
        self._write(record)
        self.records, self.last = self.records + 1, page_id
        return self.close() if self.bytes >= self.file_bytes else None

    def close(self) -> tuple | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.store.move(f"{self.drafts}/{self.name}", f"{self.folder}/{self.name}")
        self.stream, self.done = None, self.done + 1
        return self.name, self.number, self.records, self.bytes, self.sha1.hexdigest(), self.first, self.last


MANIFEST_ROW = "name string, range int, records bigint, bytes bigint, sha1 string, first_page bigint, last_page bigint"


def _table(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")])


def _writer(folder: str, file_bytes: int):
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, verdict, before, repeat = None, (None, None), None, 0
        for batch in batches:
            out = []
            for number, page_id, sha256, is_page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_page:
                    verdict = (page_id, sha256), refers_to
                    continue
                if shards is None or shards.number != number:
                    out.append(shards and shards.close())
                    shards = Shards(folder, number, file_bytes)
                key = (page_id, sha256)
                repeat = repeat + 1 if key == before else 0
                before = key
                target = verdict[1] if verdict[0] == key else None
                out.append(shards.add(page_id, page_record(page_id, url, payload, sha256, repeat, target)))
            yield _table([r for r in out if r], MANIFEST_ROW, kinds)
        last = shards and shards.close()
        yield _table([last] if last else [], MANIFEST_ROW, kinds)

    return run


def _range_key(page_id: Column, sha256: Column) -> Column:
    """Sorts like (page_id with nulls first, digest): the id with its sign bit turned, in hexadecimal."""
    turned = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0")
    return F.concat(F.coalesce(turned, F.lit("")), F.substring(sha256, 1, 16))


def _bounds(light: DataFrame, ranges: int) -> list[str]:
    """First keys of all ranges but the first, so that ranges have about equal bytes; some ``SAMPLED`` keys a range are looked at."""
    n = light.count()
    every = max(1, n // (ranges * SAMPLED))
    keyed = light.select(_range_key(F.col("page_id"), F.col("sha256")).alias("key"), "bytes")
    rows = keyed.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).groupBy("key").agg(F.sum("bytes").alias("bytes")).orderBy("key").collect()
    if not rows:
        return []
    reached = np.cumsum([r.bytes + 1 for r in rows])
    cuts = np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges, "left") + 1
    return [rows[i].key for i in sorted({int(c) for c in cuts if c < len(rows)})]


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are not above the key, found by halving steps."""
    listed, n = F.array(*[F.lit(b) for b in bounds]).cast("array<string>"), len(bounds)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda have, step: F.when(
        (have + step <= n) & (F.get(listed, have + step - 1) <= key), have + step).otherwise(have))


def _revisits(light: DataFrame, min_bytes: int) -> DataFrame:
    """``(page_id, sha256, refers_to)`` of pages whose payload a page with a larger id has as well."""
    able = light.where(F.col("bytes") >= min_bytes).select("page_id", "sha256")
    keepers = able.groupBy("sha256").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    lower = F.col("page_id").isNull() & F.col("refers_to").isNotNull() | (F.col("page_id") < F.col("refers_to"))
    return able.join(keepers, "sha256").where(lower)


def _rename(spark: SparkSession, folder: str, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(path(f"{folder}/{old}"), path(f"{folder}/{new}")):
        raise OSError(f"could not commit {folder}/{new}")
    store.delete(path(f"{folder}/{DRAFTS}"), True)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES,
                   range_bytes: int = RANGE_BYTES) -> str:
    """Writes ``pages`` (page_id, url, html) and commits the archive; returns its folder.

    ``folder`` is a new folder that driver and executors share, by default one under ``spark.checkpoint.dir``.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"),
                         F.sha2(payload, 256).alias("sha256"))
    light = written(pages.select("page_id", "sha256", F.octet_length("payload").cast("bigint").alias("bytes")), "warc-digests")
    total = light.agg(F.sum("bytes").alias("n")).first().n or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    bounds = _bounds(light, wanted)
    rows = pages.withColumns({"is_page": F.lit(True), "refers_to": F.lit(None).cast("bigint")}).unionByName(
        _revisits(light, min_bytes).withColumns({"is_page": F.lit(False)}), allowMissingColumns=True)
    rows = rows.withColumn("range", _range_of(_range_key(F.col("page_id"), F.col("sha256")), bounds))
    rows = rows.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "page_id", "sha256", "is_page", "url")
    files = map_arrow(rows.select("range", "page_id", "sha256", "is_page", "url", "payload", "refers_to"),
                      _writer(folder, file_bytes), MANIFEST_ROW)
    files.write.parquet(f"{folder}/{MANIFEST_DRAFT}")
    _rename(spark, folder, MANIFEST_DRAFT, MANIFEST)
    return folder


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = stream.read(size := int(fields["Content-Length"]))
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
        if _labelled(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} differs from its block digest")
        yield fields, block


READ = ("page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, "
        "refers_to bigint, file string")
_READ_KINDS = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _page(fields: dict[str, str], block: bytes, name: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind, url = _bare(fields["WARC-Payload-Digest"]), fields["WARC-Type"], fields["WARC-Target-URI"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its payload digest")
    return (_number(fields.get("Page-ID")), None if url == NO_URL else url, kind, payload if kind == "response" else None, size,
            digest, _number(fields.get("Refers-To-Page-ID")), name)


def _reader(folder: str, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                out, held, found = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        row = _page(fields, block, name)
                        out.append(row if keep_payload else (*row[:3], None, *row[4:]))
                        found, held = found + 1, held + 100 + keep_payload * len(block)
                        if held >= BATCH_BYTES:
                            yield _table(out, READ, _READ_KINDS)
                            out, held = [], 0
                if found != wanted:
                    raise ValueError(f"{name} has {found} records, its manifest row {wanted}")
                yield _table(out, READ, _READ_KINDS)

    return run


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of a committed archive; revisits have no payload."""
    files = spark.read.schema(MANIFEST_ROW).parquet(f"{folder}/{MANIFEST}")
    # a task reads the files of its ranges one after another
    ranges = (files.agg(F.max("range").alias("n")).first().n or 0) + 1
    spread = files.repartitionById(ranges, F.col("range")).select("name", "records")
    return map_arrow(spread, _reader(folder, keep_payload), READ)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back: size, digest, kind of record and what a revisit refers to."""
    folder = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, folder, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = f"""
WITH p AS (
 SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
r AS (SELECT *, CASE WHEN strlen(payload) >= {MIN_BYTES} AND page_id < keeper THEN keeper END AS refers_to FROM p)
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
 CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""
