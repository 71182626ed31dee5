"""WARC archives without repeated payloads, and their records read back.

Every page is first written as a response record, one gzip member each, by the task that reads it; what that yields is a
table of headers: id, url, payload digest and size, and where the member lies. Only headers are shuffled: groups of equal
payloads are found by digest, the page that the others of a group revisit is joined to them, and the archives are written
anew, one task for each: members of responses are copied as they are, revisits get fresh headers and no payload. Reading
streams through each archive and joins the revisit records to the responses that they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import scratch_dir, staged
from marlstone.llm.words import small_batches

MIN_PAYLOAD = 1000
ARCHIVE_BYTES = 256 << 20
SALTS = 16
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread, salts: int = SALTS) -> DataFrame:
    """left join on ``key`` where ``right`` has a row for each key at most: rows of a common key are dealt over ``salts`` tasks."""
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [key, "__salt"], "left").drop("__salt")


def decide(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``headers`` with original: the page whose response a record revisits, null for a response.

    Among equal payloads of ``min_payload`` bytes or more the rows with the largest page_id are responses. A group whose
    page ids are all null has responses only.
    """
    groups = headers.where(F.col("size") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = salted_left_join(headers, groups, "digest", F.struct("page_id", "url", "path", "start"))
    original = F.when(F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last")), F.lit(None)).otherwise(F.col("last"))
    return joined.withColumn("original", original.cast("long")).drop("last")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def _field(name: str, value: str | None) -> bytes:
    return b"" if value is None else f"{name}: {' '.join(value.split())}\r\n".encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, original: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = original is not None
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _field("WARC-Type", "revisit" if revisit else "response") + _field("WARC-Record-ID", record_id(page_id, digest)) + _field("WARC-Date", DATE) + _field("WARC-Target-URI", url)
    head += _field("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()) + _field("Page-ID", None if page_id is None else str(page_id))
    if revisit:
        head += _field("WARC-Profile", PROFILE) + _field("WARC-Refers-To", record_id(original, digest))
    return head + _field("Content-Type", "application/http;msgtype=response") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own, as each record of an archive is."""
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Archives:
    """Writes members to archives under a folder. An archive takes its final name, unique to the attempt, only when it is
    whole, so a task that is lost and runs again leaves nothing that is read."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.root, recursive=True)
        self.out, self.path, self.size = None, "", 0

    def add(self, raw: bytes) -> tuple[str, int]:
        """The archive's path and the place in it."""
        if self.out is not None and self.size >= ARCHIVE_BYTES:
            self.close()
        if self.out is None:
            self.path, self.size = f"{self.root}/{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.system.open_output_stream(self.path + ".open")
        self.out.write(raw)
        self.size += len(raw)
        return self.path, self.size - len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.path + ".open", self.path)
            self.out = None


HEADERS = "page_id long, url string, digest string, size long, path string, start long, length long"


def write_responses(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page as a response record to *.warc.gz under ``folder`` (any place that pyarrow's file systems reach) and
    return the staged headers (HEADERS) of the tasks that succeeded."""

    def write(batches):
        archives = _Archives(folder)
        for batch in small_batches(batches, 2):
            found = []
            for page, link, text in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (text or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload).hexdigest()
                packed = member(record(page, link, payload, len(payload), digest, None))
                found.append((page, link, digest, len(payload), *archives.add(packed), len(packed)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[c.split()[0] for c in HEADERS.split(", ")])
        archives.close()

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return staged(rows.mapInArrow(write, HEADERS), "warc-headers")


def rewrite(decided: DataFrame, folder: str) -> DataFrame:
    """Write the archives of ``decide``'s rows anew under ``folder``, without the payloads of revisits; the staged manifest:
    path, records, bytes. Each archive is read by one task, in the order of its members."""
    archives = decided.select("path").distinct().count()

    def write(batches):
        out, last, source = _Archives(folder), None, None
        done: dict[str, list[int]] = {}
        for batch in batches:
            for page, url, digest, size, path, start, length, original in zip(*(c.to_pylist() for c in batch.columns)):
                if original is not None:
                    packed = member(record(page, url, None, size, digest, original))
                else:
                    if path != last:
                        if source is not None:
                            source.close()
                        source, last = out.system.open_input_file(path), path
                    source.seek(start)
                    packed = source.read(length)
                    if len(packed) != length:
                        raise ValueError(f"{path} is cut short")
                own, _ = out.add(packed)
                count = done.setdefault(own, [0, 0])
                count[0] += 1
                count[1] += len(packed)
        if source is not None:
            source.close()
        out.close()
        columns = [list(done), [c[0] for c in done.values()], [c[1] for c in done.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    rows = decided.select("page_id", "url", "digest", "size", "path", "start", "length", "original")
    rows = rows.repartition(max(1, archives), "path").sortWithinPartitions("path", "start")
    return staged(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("intact", T.BooleanType()),
    ]
)


def parse_records(stream):
    """(headers, block) of each record of a stream of WARC records."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the manifest's archives, one task for each; ``intact``: a response's payload has the digest of
    its header."""
    archives = manifest.count()

    def read(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in parse_records(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        response = h["warc-type"] == "response"
                        page = h.get("page-id")
                        rows.append((int(page) if page else None, h.get("warc-target-uri"), h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), digest, len(payload) if response else None, hashlib.sha1(payload).hexdigest() == digest if response else None))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return manifest.select("path").repartition(max(1, archives), "path").mapInArrow(read, RECORDS)


def _batch(rows):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORDS.fieldNames())


def resolve(records: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact."""
    answers = records.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("size"), F.min("intact").alias("whole"))
    referred = records.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    answers = answers.join(referred, "record_id", "left_semi").withColumnRenamed("record_id", "refers_to_id")
    joined = salted_left_join(records, answers, "refers_to_id", F.col("record_id"))
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "size").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        "url",
        F.coalesce("intact", "whole").alias("intact"),
    )


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and resolve the revisits: a row for each page.

    The archives go to ``folder``/archives and stay; without a folder they lie in the application's shared scratch folder
    and go with it. A null html is an empty payload. Repeated rows are records each on their own; of equal payloads whose
    largest page_id occurs more than once all its rows are responses. White space inside a url becomes one space, as a
    header is one line; a null url has no header. A page of any length is one record, which one task holds once. Other
    columns are not read; page ids must be integers or null. An empty table writes nothing and gives no rows.
    """
    scratch = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    target = f"{folder.rstrip('/')}/archives" if folder else f"{scratch}/archives"
    manifest = rewrite(decide(write_responses(pages, f"{scratch}/responses", page_id, url, html), min_payload), target)
    return resolve(staged(read_archives(manifest, target), "warc-records"))


def query(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The query in DuckDB's SQL.
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size AS payload_bytes, p.digest AS payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN last <> page_id THEN last END AS refers_to, url, true AS intact
FROM p LEFT JOIN g ON p.digest = g.digest AND size >= 1000
"""
