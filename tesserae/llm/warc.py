"""WARC archives as a Spark data source.

Writing: each task writes part files of its own name; the driver's commit lists them, with record
boundaries about every SPLIT bytes, in a manifest, so that files of lost or repeated tasks are never
read. Reading: partitions are planned from the manifest's boundaries or, in a folder without one, a
file each of *.warc and *.warc.gz (members of any number of records); predicates on record_type and
on header fields are pushed down and tested on the headers alone; the payload of a record that fails
them, or that the option payload=false declines, is skipped by its Content-Length without decoding.

Records of any type are read: the payload is what follows the HTTP header, or the whole block where
there is none; page_id and refers_to are numbers in archives written here and null elsewhere, record_id
is always there. Digests are lower-case hex, also where they are written in base 32.

Null payloads are written as empty and null URLs as an empty target URI; control characters in a URL
are percent-encoded; of equal payloads with one page_id all rows are responses; repeated rows are
records of their own; long payloads are held one at a time, and rows leave in batches of about BATCH
bytes; an empty table writes a manifest without files and reads back no rows; columns other than those
written are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import Scratch, join_sized, new_path, table

SPLIT, ROWS, BATCH, LEAST_PAYLOAD, MANIFEST = 16_000_000, 512, 1 << 23, 1000, "_manifest.json"
SCHEMA = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string"
FIELDS = ("page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id")


def opened(path: str):
    """File system and path; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def safe(text: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text or "")


def record(page_id, url, record_type: str, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; a revisit has the HTTP header of its payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, name: str, marks: list[int], size: int):
        self.name, self.marks, self.size = name, marks, size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        name, marks, size = f"part-{uuid.uuid4().hex}.warc", [0], 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                columns = [batch.column(c) for c in ("page_id", "url", "record_type", "payload", "payload_digest", "refers_to")]
                for k in range(batch.num_rows):
                    page_id, url, kind, payload, digest, refers_to = (c[k].as_py() for c in columns)
                    payload = payload or b""
                    data = record(page_id, url, kind, payload, len(payload), digest, refers_to)
                    if size - marks[-1] >= SPLIT:
                        marks.append(size)
                    out.write(data)
                    size += len(data)
        return Written(name, marks, size)

    def commit(self, messages):
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        listed = [[m.name, m.marks, m.size] for m in messages if m is not None and m.size]
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(listed)).encode())

    def abort(self, messages):
        files, root = opened(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


class Stretch(InputPartition):
    def __init__(self, name: str, start: int, end: int | None):
        self.name, self.start, self.end = name, start, end


class Plain:
    """Bytes of a file from a place on, read in portions; what is skipped is not read."""

    def __init__(self, source, place: int = 0):
        self.source, self.held, self.at, self.place = source, b"", 0, place
        source.seek(place)

    def more(self) -> bool:
        part = self.source.read(1 << 16)
        self.held, self.at = self.held[self.at :] + part, 0
        return bool(part)

    def line(self) -> bytes:
        while (cut := self.held.find(b"\n", self.at)) < 0 and self.more():
            pass
        return self.read(cut + 1 - self.at if cut >= 0 else len(self.held) - self.at)

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        self.place += len(out)
        return out

    def skip(self, n: int) -> None:
        here = min(n, len(self.held) - self.at)
        self.at += here
        self.place += n
        if n > here:
            self.source.seek(self.place)
            self.held, self.at = b"", 0


class Unzipped(Plain):
    """The same of a file of gzip members; places are those of the bytes unzipped."""

    def __init__(self, source):
        super().__init__(source)
        self.member, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            part = self.rest or self.source.read(1 << 16)
            if not part:
                return False
            out = self.member.decompress(part)
            self.rest = self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
                self.rest = self.rest.lstrip(b"\0")
            if out:
                self.held, self.at = self.held[self.at :] + out, 0
                return True

    def skip(self, n: int) -> None:
        while n > 0 and (gone := len(self.read(min(n, 1 << 16)))):
            n -= gone


def headers(source) -> dict[str, str]:
    """The header fields up to the empty line, by lower-case name; of a folded field the lines are joined."""
    out, key = {}, ""
    while (line := source.line()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace")
        if line[:1] in b" \t" and key:
            out[key] += " " + text.strip()
            continue
        key, _, value = text.partition(":")
        key = key.strip().lower()
        out[key] = value.strip()
    return out


def number(urn: str | None) -> int | None:
    """Of an identifier that was written here; None of others."""
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def hex_digest(value: str | None) -> str | None:
    """A SHA-1 digest field as lower-case hex, from hex or base 32; other algorithms keep their name."""
    if not value:
        return None
    kind, _, digest = value.rpartition(":")
    if kind.lower() not in ("", "sha1"):
        return value
    if len(digest) == 32:
        try:
            return base64.b32decode(digest.upper()).hex()
        except ValueError:
            return value
    return digest.lower()


TESTS = {
    EqualTo: lambda x, v: x is not None and x == v, In: lambda x, v: x is not None and x in v, IsNull: lambda x, _: x is None, IsNotNull: lambda x, _: x is not None,
    GreaterThan: lambda x, v: x is not None and x > v, GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v, LessThanOrEqual: lambda x, v: x is not None and x <= v,
}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        """Takes the predicates on header fields and hands back the others."""
        for f in filters:
            kind, name = type(f), ".".join(getattr(f, "attribute", ()))
            if kind in TESTS and name in FIELDS:
                self.tests.append((kind, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        files, root = opened(self.path)
        if files.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
            found = files.get_file_info(pafs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == pafs.FileType.Directory else [files.get_file_info(root)]
            names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
            return [Stretch(n, 0, None) for n in names]
        with files.open_input_stream(f"{root}/{MANIFEST}") as listed:
            found = json.loads(listed.read())
        return [Stretch(f"{root}/{name}", a, b) for name, marks, size in found for a, b in zip(marks, [*marks[1:], size], strict=True)]

    def read(self, partition):
        if partition is None:  # an archive without records
            return
        files, _ = opened(self.path)
        rows, size = [], 0
        with files.open_input_file(partition.name) as file:
            source = Unzipped(file) if partition.name.endswith(".gz") else Plain(file, partition.start)
            while partition.end is None or source.place < partition.end:
                row = self.record(source, partition.name)
                if row is None:
                    break
                if row:
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= ROWS or size >= BATCH:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def record(self, source, name: str) -> dict | None:
        """The next record as a row, {} if it fails the predicates, None at the end. Its payload is read last, if at all."""
        while (version := source.line()) in (b"\r\n", b"\n"):
            pass
        if not version:
            return None
        if not version.startswith(b"WARC/"):
            raise ValueError(f"damaged record at {source.place - len(version)} of {name}")
        fields = headers(source)
        left = int(fields["content-length"])
        row = {
            "page_id": number(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
            "payload_digest": hex_digest(fields.get("warc-payload-digest")), "refers_to": number(fields.get("warc-refers-to")), "record_id": fields.get("warc-record-id"), "payload": None,
        }
        declared = None
        if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            # the HTTP header is short; it is read before the payload is
            before = source.place
            source.line()
            declared = headers(source).get("content-length")
            left -= source.place - before
        revisit = row["record_type"] == "revisit"
        row["payload_bytes"] = int(declared) if revisit and declared and declared.isdigit() else left
        if not all(TESTS[kind](row[field], value) for kind, field, value in self.tests):
            source.skip(left)
            return {}
        if not self.payload or revisit:
            source.skip(left)
            return row
        row["payload"] = source.read(left)
        ours = row["page_id"] is not None and row["payload_digest"]
        if len(row["payload"]) != left or ours and hashlib.sha1(row["payload"]).hexdigest() != row["payload_digest"]:
            raise ValueError(f"damaged record before {source.place} of {name}")
        return row

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        types = {"page_id": pa.int64(), "target_uri": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "record_id": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder); df.write.format("warc").save(folder)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to: equal payloads revisit the one of the largest page_id."""
    scratch = Scratch(pages.sparkSession, "warc")
    keyed = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumn("payload_digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    same = keyed.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("payload_digest", "size").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    same = scratch.put(same.filter("n > 1 and kept is not null").drop("n"))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    out = join_sized(keyed, same, ["payload_digest", "size"], "left")
    return out.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Writes the archives to the shared folder and reads them back, checking every payload's digest."""
    register(spark)
    path = new_path(spark, "warc-archive")
    planned(table(sf_dir, "pages", spark, "page_id", "url", "html")).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND kept IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND kept IS DISTINCT FROM page_id THEN kept END AS refers_to FROM g
"""
