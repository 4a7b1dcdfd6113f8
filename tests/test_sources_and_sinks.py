"""Paged sources against a local service that fails, and the sink's commits."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_images_and_stages import tiff

from shutterlake.sources import exif, paged, sink

ITEMS = [{"name": f"n{k}", "stars": k % 7 if k % 5 else None, "pushed": f"2024-01-{k % 28 + 1:02}"} for k in range(57)]


@pytest.fixture
def service():
    """Serves ITEMS by pages; each page fails as often as ``fails`` says before it answers."""
    state = {"fails": 1, "asked": [], "items": list(ITEMS)}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            page, size = int(query["page"]), int(query["per_page"])
            state["asked"].append((page, size, query.get("since")))
            if size > 1 and sum(a[:2] == (page, size) for a in state["asked"]) <= state["fails"]:
                self.send_error(503)
                return
            rows = [i for i in state["items"] if i["pushed"] >= query.get("since", "")]
            body = json.dumps({"total": len(rows), "items": rows[(page - 1) * size : page * size]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/search"
    yield state
    server.shutdown()


def register(spark, service, name, attempts=3, most=None, pushable=()):
    url = service["url"]

    def connect(where):
        from shutterlake.sources.paged import JsonPages

        since = where.get(("pushed", ">="))
        return JsonPages(url, ["name", "stars", "pushed"], params={"since": since} if since else {}, per_page=10, most=most)

    spark.dataSource.register(paged.paged_source(name, "name string, stars long, pushed string", connect, pushable=pushable, attempts=attempts, base=0.01))


def test_all_pages_come_once_though_each_fails_first(spark, service):
    register(spark, service, "hits1")
    rows = spark.read.format("hits1").option("pages_per_partition", 4).load()
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(r["name"] for r in rows.collect()) == sorted(i["name"] for i in ITEMS)


def test_filters_reach_the_service(spark, service):
    register(spark, service, "hits2", pushable=[("pushed", ">=")])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = sorted(r["name"] for r in spark.read.format("hits2").load().where("pushed >= '2024-01-20' and stars > 2").collect())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert got == sorted(i["name"] for i in ITEMS if i["pushed"] >= "2024-01-20" and (i["stars"] or 0) > 2)
    assert {a[2] for a in service["asked"]} == {"2024-01-20"}


def test_a_page_that_keeps_failing_ends_the_job(spark, service):
    register(spark, service, "hits3", attempts=2)
    service["fails"] = 5
    with pytest.raises(PySparkException, match="2 attempts failed"):
        spark.read.format("hits3").load().collect()


def test_delays_grow():
    waited = []

    class Broken:
        def page(self, cursor):
            raise OSError("no")

    with pytest.raises(paged.GaveUp, match="page 7: 4 attempts"):
        paged.fetched(Broken(), 7, attempts=4, base=2.0, wait=waited.append)
    assert waited == [2.0, 4.0, 8.0]


def test_the_first_valid_rows(spark, service):
    register(spark, service, "hits4", most=33)
    rows = spark.read.format("hits4").option("take", 6).load()
    assert rows.count() == 6 * 3 + 3
    some = paged.take(spark.read.format("hits4").load().withColumn("n", F.substring("name", 2, 9).cast("int")), 8, order="n", needed=["name", "stars"])
    assert [r["n"] for r in some.collect()] == [i for i in range(33) if i % 5][:8]


def test_a_stream_goes_on_where_it_was(spark, service, tmp_path):
    register(spark, service, "hits5")
    service["items"] = ITEMS[:30]

    def run():
        q = spark.readStream.format("hits5").load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == sorted(i["name"] for i in ITEMS[:30])
    service["items"], asked = ITEMS[:50], len(service["asked"])
    assert run() == sorted(i["name"] for i in ITEMS[:50])
    assert {a[0] for a in service["asked"][asked:] if a[1] > 1} == {4, 5}


# --- the sink ---------------------------------------------------------------------------


def found(root):
    return sorted(p.relative_to(root).as_posix().partition("/")[2] for p in root.rglob("*") if p.is_file() and p.parent != root)


def save(rows, root, mode="append"):
    rows.sparkSession.dataSource.register(sink.FileSink)
    rows.write.format("files").mode(mode).option("path", f"file://{root}").save()


def test_files_appear_together_under_safe_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", b"one"), ("../../up.txt", b"two"), ("c.txt", b""), (None, b"x"), ("d", None)], "key string, data binary").repartition(3)
    save(rows, tmp_path / "out")
    assert found(tmp_path / "out") == ["a/b.bin", "c.txt", "up.txt"] and not (tmp_path / "up.txt").exists()
    save(rows.limit(0), tmp_path / "out")
    save(spark.createDataFrame([("e", b"5")], "key string, data binary"), tmp_path / "out")
    assert found(tmp_path / "out") == ["a/b.bin", "c.txt", "e", "up.txt"]
    save(spark.createDataFrame([("f", b"6")], "key string, data binary"), tmp_path / "out", "overwrite")
    assert found(tmp_path / "out") == ["f"]


@pytest.mark.parametrize("bad", [[("x", b"1"), ("x", b"2")], [("/..", b"1")]])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"k{i}", b"v") for i in range(20)] + bad, "key string, data binary").coalesce(1)
    with pytest.raises(PySparkException):
        save(rows, tmp_path / "out")
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_a_retried_task_leaves_one_file(tmp_path, monkeypatch):
    class Task:
        def partitionId(self):
            return 3

    monkeypatch.setattr(sink.TaskContext, "get", classmethod(lambda cls: Task()))
    writer = sink.FileWriter(f"file://{tmp_path}/out", False)

    def broken():
        yield {"key": "a", "data": b"1"}
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    writer.write(iter([{"key": "a", "data": b"1"}]))  # another attempt whose message is lost
    kept = writer.write(iter([{"key": "a", "data": b"1"}]))
    writer.commit([kept, None])
    assert found(tmp_path / "out") == ["a"] and not list((tmp_path / "out").rglob("*-*/*/*"))


@pytest.mark.parametrize("kind", ["jpg", "png"])
def test_metadata_is_spliced_in(spark, tmp_path, kind):
    import struct
    import zlib

    block = tiff("<", [(0x0112, 3, 6)], [(0x9003, 2, "2024:01:02 00:00:01"), (0x8827, 3, 400)])
    if kind == "jpg":
        plain = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x0aExif\0\0xx\xff\xdb\x00\x03q\xff\xda\x00\x02scan\xff\xd9"
    else:
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        plain = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"0" * 13) + chunk(b"eXIf", b"old") + chunk(b"IDAT", b"data") + chunk(b"IEND", b"")
    icc = bytes(range(256)) * 300
    made = sink.with_metadata(sink.with_metadata(plain, block, icc), block, icc)
    assert made.endswith(plain[-13:]) and made.count(block) == 1
    if kind == "jpg":
        segments, _ = sink.jpeg_segments(made)
        assert [m for m, _ in segments] == [0xE0, 0xE1, 0xE2, 0xE2, 0xDB] and b"".join(b[14:] for m, b in segments if m == 0xE2) == icc
    save(spark.createDataFrame([(f"p.{kind}", made)], "key string, data binary"), tmp_path / "out")
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.is_dir() and p.name.startswith("part-")]
    (row,) = exif.read_exif(spark, f"file://{part}").collect()
    assert (row["orientation"], row["taken"], row["iso"]) == (6, "2024:01:02 00:00:01", 400)


def test_documents_written_as_files(spark):
    from shutterlake import catalog

    assert catalog.queries()["files_roundtrip"](spark, "/root/testdata/sf0.001").count() == 200
