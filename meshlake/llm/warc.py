"""WARC archives: monolithic gzip writer, normaliser with a sidecar offset index, and indexed reader.

``write_archives`` writes one whole-file gzip stream per partition. ``normalise`` inflates each such stream once, writes every
record again as a gzip member of its own and lists the members in a sidecar (offset, length, type and record id a line).
``read_archives`` seeks to each listed member and parses it.

Payloads that occur more than once (SHA-1 of the bytes, ``least_bytes`` or longer) are written in full by the page with the largest id;
the others become revisit records that refer to it. The response of a digest is found by a pre-aggregated maximum and joined
back by a broadcast of checked size or else by a join that Spark can split at a hot digest.

Files go to the shared folder under a name of the task attempt and are renamed when complete; only names that a committed
task has written to the manifest table are read, so attempts that fail or run twice leave no trace in a result. A task
holds one record at a time.

Defined cases: a null html is an empty payload; a null or empty url becomes urn:page:<id>; unprintable characters of a url are
percent-encoded; a null page_id is smaller than all others and reads back as null; of rows that repeat the largest page_id and payload each is a
response; a damaged or cut archive fails; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh_path, join_bounded, local_path, written

BROADCAST_DIGESTS = 500_000
CHUNK = 1 << 20
EMPTY_SHA1 = base64.b32encode(hashlib.sha1(b"").digest()).decode()
#: Fixed value: the profile that the WARC 1.1 standard gives for revisits with an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
READ = "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_length long, payload binary"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind} | headers | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    headers = {"WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE, "X-Payload-Length": str(len(payload))}, http)


def read_head(stream) -> tuple[bytes, dict[str, str]] | None:
    """The next record's head, as written and parsed; None at the end."""
    line = stream.readline()
    while line == b"\r\n":
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()) != b"\r\n":
        if not line.endswith(b"\r\n"):
            raise EOFError("the archive ends inside a record's head")
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join(raw) + b"\r\n", fields


def page_of(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number.lstrip("-").isdigit() else None


def parse(head: dict[str, str], block: bytes) -> tuple:
    """A row of READ. The payload of a response has its digest checked."""
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    payload, length = None, int(head.get("x-payload-length", -1))
    if head["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        length = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{head.get('warc-record-id')}: the payload differs from its digest")
    return page_of(head.get("warc-record-id")), head["warc-type"], head.get("warc-target-uri"), page_of(head.get("warc-refers-to")), digest, length, payload


def _attempt_file(folder: str, ending: str) -> str:
    os.makedirs(folder, exist_ok=True)
    t = TaskContext.get()
    return f"{folder}/part-{t.partitionId():06d}-{t.stageId()}-{t.taskAttemptId()}{ending}"


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 1, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Writes the columns page_id, url and html; returns the manifest of the whole-file gzip archives."""
    spark = pages.sparkSession
    folder = local_path(fresh_path(spark, "warc"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    shared = base.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha", "response")
    shared = written(shared, "warc-digests")
    told = join_bounded(base, shared, "sha", "left", shared.count(), broadcast_digests)
    # A group of nulls alone has no largest id: all of its records are responses.
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))

    def run(batches):
        path, n = _attempt_file(folder, ".warc.gz"), 0
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        with open(path + ".tmp", "wb") as out:
            out.write(squeeze.compress(record("warcinfo", {"WARC-Record-ID": "<urn:archive>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"software: meshlake\r\n")))
            for b in batches:
                for page, url, payload, ref in zip(*(c for c in b.columns), strict=True):
                    out.write(squeeze.compress(page_record(page.as_py(), url.as_py(), payload.as_py(), ref.as_py(), date)))
                    n += 1
            out.write(squeeze.flush())
        os.replace(path + ".tmp", path)
        yield _rows(MANIFEST, [(path, n)])

    return written(told.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, MANIFEST), "warc-manifest")


def normalise_file(source: str, target: str, level: int = 6) -> int:
    """Rewrites ``source`` as ``target`` with a member per record, and its sidecar ``target``.idx. Returns the number of records."""
    n = at = 0
    with gzip.open(source, "rb") as stream, open(target + ".tmp", "wb") as out, open(target + ".idx.tmp", "w", encoding="utf-8") as index:
        while found := read_head(stream):
            raw, head = found
            squeeze, left, size = zlib.compressobj(level, zlib.DEFLATED, 31), int(head["content-length"]), 0
            size += out.write(squeeze.compress(raw))
            while left:
                data = stream.read(min(left, CHUNK))
                if not data:
                    raise EOFError(f"{source} ends inside a record")
                left -= len(data)
                size += out.write(squeeze.compress(data))
            size += out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
            index.write(f"{at}\t{size}\t{head.get('warc-type', '-')}\t{head.get('warc-record-id', '-')}\n")
            at, n = at + size, n + 1
    os.replace(target + ".tmp", target)
    os.replace(target + ".idx.tmp", target + ".idx")
    return n


def one_a_task(manifest: DataFrame) -> DataFrame:
    """The paths, an archive a partition: a scan would pack many small manifest files into one task, whatever the size of the archives."""
    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")


def normalise(manifest: DataFrame, level: int = 6) -> DataFrame:
    """Manifest of the rewritten archives; each has its index beside it."""
    folder = local_path(fresh_path(manifest.sparkSession, "warc-members"))

    def run(batches):
        for b in batches:
            rows = []
            for source in b.column(0).to_pylist():
                target = _attempt_file(folder, f"-{os.path.basename(source)}")
                rows.append((target, normalise_file(source, target, level)))
            yield _rows(MANIFEST, rows)

    return written(one_a_task(manifest).mapInArrow(run, MANIFEST), "warc-member-manifest")


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every page record, by its entry in the index (columns READ; the payload is null for revisits)."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with open(path + ".idx", encoding="utf-8") as index, open(path, "rb") as archive:
                    for line in index:
                        at, length, kind, _ = line.rstrip("\n").split("\t")
                        if kind not in ("response", "revisit"):
                            continue
                        archive.seek(int(at))
                        data = gzip.decompress(archive.read(int(length)))
                        head_end = data.index(b"\r\n\r\n") + 4
                        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[:head_end].decode("utf-8", "replace").split("\r\n")[1:]))
                        rows.append(parse(head, data[head_end : head_end + int(head["content-length"])]))
                        size += len(data)
                        if size >= batch_bytes:
                            yield _rows(READ, rows)
                            rows, size = [], 0
                yield _rows(READ, rows)

    return one_a_task(manifest).mapInArrow(run, READ)
