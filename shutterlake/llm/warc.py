"""WARC archives of page records, and a normaliser for archives that are one gzip stream.

A record that is to be found by its offset needs a gzip member of its own.  The
normaliser inflates a whole-file stream once, cuts it at record lengths, writes
every record as its own member and puts ``offset, length, kind, id`` lines into
a sidecar index.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

VERSION = b"WARC/1.1"
MIN_REVISIT = 100
CHUNK = 1 << 20
#: A revisit names the record it repeats and the bytes and digest of the payload it leaves out.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(page_id) -> str:
    """A record id that holds the page's id."""
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record_id: str):
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


ESCAPED = {"%": "%25", "\r": "%0D", "\n": "%0A"}


def one_line(s: str) -> str:
    """Header values hold no line breaks and no white space at their ends: these and percent signs are escaped."""
    out = "".join(ESCAPED.get(c, c) for c in s) if any(c in s for c in ESCAPED) else s
    left = len(out) - len(out.lstrip(" \t"))
    right = len(out.rstrip(" \t"))
    blank = {" ": "%20", "\t": "%09"}
    return "".join(blank[c] for c in out[:left]) + out[left:right] + "".join(blank[c] for c in out[max(left, right) :])


def original(s: str) -> str:
    return re.sub("%(25|0D|0A|20|09)", lambda m: chr(int(m[1], 16)), s)


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None, *, record_id: str | None = None, date: str = "1970-01-01T00:00:00Z", refers_to_url: str | None = None) -> bytes:
    """A whole record; its id is made from the page's unless given. Revisits name the page that they repeat and its url."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id or urn(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Bytes", str(len(payload))), ("X-Page", urn(page_id))]
    if url is not None:
        head.append(("WARC-Target-URI", one_line(url)))
    if kind == "revisit":
        head += [("X-Refers-To-Page", urn(refers_to)), ("WARC-Refers-To-Date", date), ("WARC-Profile", REVISIT_PROFILE)]
        if refers_to_url is not None:
            head.append(("WARC-Refers-To-Target-URI", one_line(refers_to_url)))
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + payload + b"\r\n\r\n"


def header(lines: bytes) -> dict[str, str]:
    first, *rest = lines.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.lower(): v.strip(" \t") for k, _, v in (x.decode().partition(":") for x in rest if x)}


class _Inflated:
    """The bytes of a gzip file, whole streams and members alike, read once from front to back."""

    def __init__(self, source):
        self.source, self.stream, self.rest, self.buffer = source, zlib.decompressobj(31), b"", bytearray()
        self.begun = False

    def _more(self) -> bool:
        data = self.rest or self.source.read(CHUNK)
        if not data:
            if self.begun and not self.stream.eof:
                raise ValueError("the archive is cut: a gzip stream does not end")
            return False
        if self.stream.eof:
            self.stream = zlib.decompressobj(31)
        self.begun = True
        self.buffer += self.stream.decompress(data, CHUNK * 4)
        self.rest = self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail
        if not self.rest and not self.stream.eof:
            # What the bound on output has held back.
            while more := self.stream.decompress(b"", CHUNK * 4):
                self.buffer += more
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("archive ends within a record")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload) of each record of an open gzip file."""
    data = _Inflated(source)
    while (lines := data.until(b"\r\n\r\n")) is not None:
        head = header(lines.lstrip(b"\r\n"))
        payload = data.exactly(int(head["content-length"]))
        data.exactly(4)
        yield head, payload


def normalise(source, archive, index, level: int = 6) -> tuple[int, int]:
    """Rewrites a gzip archive with a member for each record and a line for each in the index; (records, bytes)."""
    data, n, offset = _Inflated(source), 0, 0
    while (lines := data.until(b"\r\n\r\n")) is not None:
        lines = lines.lstrip(b"\r\n")
        head = header(lines)
        raw = lines + b"\r\n\r\n" + data.exactly(int(head["content-length"]) + 4)
        member = gzip.compress(raw, level, mtime=0)
        archive.write(member)
        index.write(f"{offset}\t{len(member)}\t{head['warc-type']}\t{head['warc-record-id']}\n".encode())
        n, offset = n + 1, offset + len(member)
    return n, offset


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index line."""
    source.seek(offset)
    raw = gzip.decompress(source.read(length))
    lines, _, rest = raw.partition(b"\r\n\r\n")
    head = header(lines)
    return head, rest[: int(head["content-length"])]


def label(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``id, url, payload, digest, refers_to, refers_to_url``: the last two are null for responses.

    Least ids by digest are counted map-side first, and only digests that repeat
    are joined back, by a join that adaptive execution splits at hot digests.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    first = (
        rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    )
    again = F.col("id") != F.col("first.id")
    return rows.join(first, "digest", "left").select(
        "id", "url", F.encode("html", "utf-8").alias("payload"), "digest", F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_to_url")
    )


def write_archives(labelled: DataFrame, folder: str, *, level: int = 6) -> list:
    """Each partition's records as one gzip stream, normalised at once; a manifest row an archive.

    Record ids are made from the run, the partition and the record's number: unique, and the same if a task is tried again.
    """
    run, date = uuid.uuid4(), datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        part = TaskContext.get().partitionId()
        raw, path, n = f"{folder}/whole-{part:06d}.warc.gz", f"{folder}/pages-{part:06d}.warc.gz", 0
        with store.writing(raw) as out:
            stream = zlib.compressobj(1, wbits=31)
            for batch in batches:
                for page_id, url, payload, digest, refers_to, refers_to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    name = f"<urn:uuid:{uuid.uuid5(run, f'{part}/{n}')}>"
                    kind = "response" if refers_to is None else "revisit"
                    out.write(stream.compress(record(kind, page_id, url, payload, digest, refers_to, record_id=name, date=date, refers_to_url=refers_to_url)))
                    n += 1
            out.write(stream.flush())
        if n:
            with store.reading(raw) as source, store.writing(path) as archive, store.writing(f"{path}.idx") as index:
                n, _ = normalise(source, archive, index, level)
        store.remove(raw)
        yield pa.RecordBatch.from_pydict({"path": pa.array([path] * bool(n), pa.string()), "n": pa.array([n] * bool(n), pa.int64())})

    return sorted(labelled.mapInArrow(write, "path string, n long").collect())


def read_archives(spark, paths: list[str]) -> DataFrame:
    """Every record's ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, stored_bytes`` by its index line.

    The digest of a response is taken anew from the payload; it must be the one in the header.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, stored_bytes long"

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.reading(f"{path}.idx") as f:
                    lines = f.read().decode().splitlines()
                with store.reading(path) as f:
                    for line in lines:
                        offset, length, kind, name = line.split("\t")
                        head, payload = read_member(f, int(offset), int(length))
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        n = int(head["x-payload-bytes"])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or n != len(payload)):
                            raise ValueError(f"{path}: record {name} is damaged")
                        refers_to = page_of(head["x-refers-to-page"]) if kind == "revisit" else None
                        url = head.get("warc-target-uri")
                        rows.append((page_of(head["x-page"]), url and original(url), kind, n, digest, refers_to, len(payload)))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(read, schema)


def archive_table(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages to archives and reads them back, a row a page.

    Equal payloads of at least 100 bytes: the smallest id responds, the others
    revisit it; rows that repeat the smallest id all respond.  A null payload is
    empty, a null id stays null (and responds).  No pages: no rows.  Urls may
    hold anything; further columns are not looked at.
    """
    spark = pages.sparkSession
    manifest = write_archives(label(pages, id_col=id_col, url_col=url_col, html_col=html_col), store.new_folder(spark, "warc"))
    return read_archives(spark, [m["path"] for m in manifest]).withColumnRenamed("page_id", id_col)


