import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import imaging
from shutterlake.plans import stages
from shutterlake.sources import files


@pytest.fixture
def photo():
    r = np.random.default_rng(4)
    y, x = np.mgrid[0:48, 0:64]
    return np.clip(np.stack([x * 3, y * 4, (x + y) * 2], -1) + r.integers(0, 9, (48, 64, 3)), 0, 255).astype(np.uint8)


def test_known_colours():
    red = np.array([[[0, 0, 255], [255, 0, 0], [255, 255, 255], [0, 0, 0]]], np.uint8)
    assert imaging.hsv(red)[0].tolist() == [[0, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert imaging.gray(red)[0].tolist() == [76, 29, 255, 0]
    assert imaging.lab(red)[0, 2].tolist() == [255, 128, 128] and imaging.lab(red)[0, 0].tolist() == [136, 208, 195]


def test_colours_go_there_and_back(photo):
    assert np.abs(imaging.from_lab(imaging.lab(photo)).astype(int) - photo).mean() < 3
    x = imaging.hsv(photo).astype(np.float32)
    assert np.abs(imaging.from_hsv(x[..., 0], x[..., 1] / 255, x[..., 2] / 255).astype(int) - photo).max() < 12


def test_neighbourhoods():
    flat = np.full((9, 11), 7.0, np.float32)
    assert np.allclose(imaging.gaussian(flat, 1.5), 7) and np.allclose(imaging.box(flat, 5), 7) and np.allclose(imaging.laplacian(flat), 0)
    ramp = np.arange(30, dtype=np.float32).reshape(5, 6)
    want = np.array([[ramp[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean() for x in range(6)] for y in range(5)])
    assert np.allclose(imaging.box(ramp, 3)[1:-1, 1:-1], want[1:-1, 1:-1])
    dot = np.zeros((7, 7), np.uint8)
    dot[3, 3] = 255
    assert (imaging.dilate(dot, 3) > 0).sum() == 9 and (imaging.erode(imaging.dilate(dot, 3), 3) == dot).all()


def test_components_are_eight_connected():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], np.uint8)
    label, boxes = imaging.components(mask)
    assert label.max() == 4 and sorted(b[0] for b in boxes) == [1, 1, 2, 2] and label[0, 0] == label[1, 1]
    assert imaging.components(np.zeros((3, 3), np.uint8))[1].shape == (0, 5)


def test_maps_that_change_nothing(photo):
    for same in (imaging.saturation(photo, 0.0), imaging.vibrance(photo, 0.0)):
        assert np.abs(same.astype(int) - photo).max() < 12
    for same in (imaging.highlights(photo, 0.0), imaging.unsharp(photo, 0.0), imaging.white_balance(photo), imaging.texture(photo, 0.0)):
        assert np.abs(same.astype(int) - photo).max() <= 1
    assert (imaging.gamma(photo, 1.0).astype(int) - photo).max() <= 0


def test_scores(photo):
    assert imaging.psnr(photo, photo) == float("inf") and imaging.ssim(photo, photo) == pytest.approx(1)
    assert imaging.colour_cast(np.zeros((4, 4, 3), np.uint8)) == {"score": 0.0, "cast": None}
    assert imaging.colour_cast(np.full((40, 40, 3), 90, np.uint8))["score"] == pytest.approx(10)
    assert imaging.noise(np.full((20, 20, 3), 90, np.uint8))["score"] == 10
    assert imaging.photo_features(photo).shape == (176,) and set(imaging.perceptual_hash(photo)) <= {0.0, 1.0}


def test_png_goes_there_and_back(photo, spark, tmp_path):
    (tmp_path / "sky").mkdir()
    (tmp_path / "sky" / "a_input.PNG").write_bytes(files.encode_png(photo))
    (tmp_path / "a_target.png").write_bytes(files.encode_png(photo[..., 0]))
    (tmp_path / "broken.png").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    root = f"file://{tmp_path}"
    assert files.find_images(spark, root, recursive=True).count() == 3 and files.find_images(spark, root).count() == 2
    read = {r["path"].rpartition("/")[2]: r["image"] for r in files.read_images(spark, root, recursive=True).collect()}
    assert (stages.to_array(read["a_input.PNG"]) == photo).all() and (stages.to_array(read["a_target.png"]) == photo[..., 0]).all() and read["broken.png"] is None
    named = files.folder_or_list(spark, [f"{root}/a_target.png", f"{root}/note.txt"])
    assert [r["path"].rpartition("/")[2] for r in named.collect()] == ["a_target.png"]
    again = files.read_images(spark, root, recursive=True).where("image is not null").select("path", files.png("image").alias("f")).collect()
    assert {r["path"].rpartition("/")[2]: bytes(r["f"]) for r in again}["a_input.PNG"] == files.encode_png(photo)
    assert files.pairs(files.find_images(spark, root, recursive=True)).select("key").collect()[0][0] == "a"
    assert {(r["category"]) for r in files.assets(spark, root).collect()} == {"sky", "uncategorized"}


def test_columns_of_sources(spark):
    row = spark.range(1).select(
        files.exif_time(F.lit("2024:01:02 00:00:01")).alias("t"), files.exif_time(F.lit("no")).alias("u"), files.rational(F.lit(1.0), F.lit(0)).alias("r"),
        files.safe_key(F.lit("a/../b//c")).alias("k"), files.safe_key(F.lit("../..")).alias("n"),
    ).first()
    assert tuple(row) == (1704153601, None, 0.0, "a/b/c", None)


def test_stages_fold(photo, spark):
    registry = stages.builtin()

    @registry.register("fails")
    def fails(image, context):
        raise RuntimeError("no")

    registry.register("nothing", lambda image, context: "x")
    image, told = registry.run(photo, ["gamma", "missing", "fails", "nothing", "unsharp"], {"gamma": {"value": 1.2}})
    assert [(t.name, t.applied, t.skipped, bool(t.error)) for t in told] == [("gamma", True, False, False), ("missing", False, True, False), ("fails", False, False, True), ("nothing", False, True, False), ("unsharp", True, False, False)]
    assert len(registry.run(photo, ["fails", "gamma"], halt=True)[1]) == 1
    with pytest.raises(KeyError):
        registry.run(photo, ["missing"], strict=True)
    jobs = spark.createDataFrame([("j", stages.to_struct(photo), ["gamma", "missing"], None, None)], f"job_id string, image {stages.IMAGE}, stages array<string>, params string, seed long")
    out = stages.run_jobs(jobs, stages.builtin()).first()
    assert (stages.to_array(out["image"]) == imaging.gamma(photo)).all() and [r["skipped"] for r in out["report"]] == [False, True]


def tiff(order, entries, sub):
    """A TIFF structure of (tag, type, values) entries in two directories."""
    import struct

    made = {2: lambda v: v.encode() + b"\0", 3: lambda v: struct.pack(order + "H", v), 4: lambda v: struct.pack(order + "I", v), 5: lambda v: struct.pack(order + "II", *v), 10: lambda v: struct.pack(order + "ii", *v)}
    sizes = {2: 1, 3: 2, 4: 4, 5: 8, 10: 8}
    out, tail = b"", b""
    first = 8
    second = first + 2 + 12 * (len(entries) + 1) + 4
    data_at = second + 2 + 12 * len(sub) + 4
    for group in ([*entries, (0x8769, 4, second)], sub):
        out += struct.pack(order + "H", len(group))
        for tag, kind, value in group:
            body = made[kind](value)
            count = len(body) // sizes[kind]
            if len(body) <= 4:
                out += struct.pack(order + "HHI", tag, kind, count) + body.ljust(4, b"\0")
            else:
                out += struct.pack(order + "HHII", tag, kind, count, data_at + len(tail))
                tail += body
        out += struct.pack(order + "I", 0)
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, first) + out + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_metadata_of_files(spark, tmp_path, order):
    import struct

    from shutterlake.sources import exif

    block = tiff(order, [(0x0112, 3, 6), (0x0132, 2, "2024:01:02 00:00:09")], [(0x9003, 2, "2024:01:02 00:00:01"), (0x9204, 10, (-2, 3)), (0x8827, 3, 400), (0x829A, 5, (1, 250)), (0x829D, 5, (28, 10)), (0xA434, 2, "Canon RF 15-35mm"), (0x920A, 5, (15, 0))])
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.tif").write_bytes(block)
    (tmp_path / "c.jpg").write_bytes(jpeg[:60])
    (tmp_path / "d.png").write_bytes(b"no image")
    rows = {r["path"].rpartition("/")[2]: r for r in exif.read_exif(spark, f"file://{tmp_path}").withColumn("ts", exif.capture_time(F.col("taken"), F.col("changed"))).withColumn("profile", exif.lens_profile(F.col("lens"))).collect()}
    for name in ("a.jpg", "b.tif"):
        r = rows[name]
        assert (r["orientation"], r["taken"], r["iso"], r["lens"], r["focal_mm"], r["ts"], r["profile"]) == (6, "2024:01:02 00:00:01", 400, "Canon RF 15-35mm", 0.0, 1704153601.0, "canon_rf_15_35")
        assert (r["bias_ev"], r["exposure_s"], r["f_number"]) == (pytest.approx(-2 / 3), 0.004, 2.8)
    assert rows["d.png"]["orientation"] is None and rows["d.png"]["ts"] is None and rows["c.jpg"]["iso"] is None


def test_orientations():
    x = np.arange(6).reshape(2, 3)
    seen = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.T, 6: np.rot90(x, -1), 7: x[::-1, ::-1].T, 8: np.rot90(x), 9: x}
    for k, want in seen.items():
        assert files.with_orientation(x, k).tolist() == want.tolist(), k


def test_report_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, 'a "x", y', 1.5)], "n int, name string, seconds double")
    files.write_report(rows, f"{tmp_path}/r", order="n", comments=["one", "two", "three"], summary=["total", 2])
    (part,) = [p for p in (tmp_path / "r").iterdir() if p.name.startswith("part")]
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines() == ["# one", "# two", "# three", "name,seconds", '"a ""x"", y",1.5', "b,", "total,2"]


def test_deliveries(spark, tmp_path):
    from shutterlake.streaming import jobs

    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int").coalesce(1)
    log = f"{tmp_path}/log"

    def attempt(values):
        with open(log, "a") as f:
            f.write(f"{values[0]}\n")
        seen = open(log).read().split().count(str(values[0]))
        if values[0] == 4 and seen < 3:
            raise TimeoutError
        return {1: 204, 2: 404, 3: 429, 4: 200}[values[0]]

    out = jobs.deliver_rows(rows, attempt, wait=lambda s: None).collect()
    assert [tuple(r) for r in out] == [(1, "delivered", 1), (2, "gave_up", 1), (3, "exhausted", 6), (4, "delivered", 3)]


def test_streams(spark, tmp_path):
    from shutterlake.streaming import jobs

    schema = "g string, ts timestamp, ev double, item string, status string"
    start = 1_700_000_000
    shots = [("a", start + k, e, f"a{k}", "queued") for k, e in enumerate([0.0, 1.0, 2.0, 0.0, 1.0])] + [("a", start + 60, 0.0, "a9", "done"), ("b", start, None, "b0", "failed"), ("a", start + 600, 0.0, "end", "late")]
    spark.createDataFrame(shots, "g string, t long, ev double, item string, status string").selectExpr("g", "timestamp_seconds(t) ts", "ev", "item", "status").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def rows_of(frame, mode):
        q = frame.writeStream.format("memory").queryName("t").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{mode}{frame.columns}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table("t").collect()))

    assert rows_of(jobs.bracket_stream(stream, group="g", ts="ts", ev="ev", item="item"), "append") == [("a", ["a0", "a1", "a2"]), ("a", ["a3", "a4"])]
    bursts = rows_of(jobs.burst_stream(stream, group="g", ts="ts").select("g", "n"), "append")
    assert bursts == [("a", 1), ("a", 5), ("b", 1)]
    assert rows_of(jobs.latest_status(stream, key="g", ts="ts", status="status").select("g", "status"), "complete") == [("a", "late"), ("b", "failed")]


def test_kernels_by_their_formulas():
    r = np.random.default_rng(5)
    img = r.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    x = imaging.hsv(img).astype(float)
    boost = (255 - x[..., 1]) / 255 * 0.5
    want = imaging.from_hsv(x[..., 0], np.clip(x[..., 1] * (1 + boost) + 30 * boost, 0, 255) / 255, x[..., 2] / 255)
    assert np.abs(imaging.vibrance(img, 0.5).astype(int) - want).max() <= 1
    assert imaging.composition(np.full((5, 5, 3), 110, np.uint8))["score"] == 5.5
    assert imaging.composition(np.full((5, 5, 3), 35, np.uint8))["score"] == pytest.approx(0.55 * (10 - 0.08 * 100))
    assert imaging.quadrants(np.arange(16.0).reshape(4, 4))[:4].tolist() == [2.5, pytest.approx(np.std([0, 1, 4, 5])), 0.0, 5.0]


def test_edges_and_halos():
    step = np.zeros((30, 40), np.uint8)
    step[:, 20:] = 200
    found = imaging.edges(step, 80, 200) > 0
    assert found.any(axis=1).all() and set(np.nonzero(found)[1]) <= {19, 20} and (found.sum(axis=1) == 1).all()
    faint = (step // 200 * 10).astype(np.uint8)
    assert not imaging.edges(faint, 80, 200).any()
    flat = np.full((30, 40, 3), 90, np.uint8)
    assert imaging.halo(flat)["score"] == 9.5 and imaging.halo(np.repeat(step[..., None], 3, 2))["score"] < 5
    assert imaging.colour_richness(flat)["score"] == 4.5 and imaging.sky(flat, False)["score"] is None and imaging.sky(flat + 100, True)["score"] == 5.5


def test_audit_of_every_part(spark):
    from shutterlake import catalog

    rows = catalog.queries()["image_audit"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r["photo_id"] for r in rows}) == 200
    for r in rows:
        weak = [w for w in r["weak"].split(",") if w]
        assert 0 < r["overall"] <= 10 and len(weak) <= 3 and "vertical_alignment" not in weak and (r["photo_id"] % 3 == 0 or "sky_quality" not in weak)
        assert r["summary"].startswith(("Solid", "Strong", "Exterior" if r["photo_id"] % 3 == 0 else "Interior", "Listing"))
