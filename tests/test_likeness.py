"""Perceptual hashes, near hashes and projections against plain formulas."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from shutterlake.operators import likeness, vectors


def plain_reduced(img, rows, columns):
    h, w = img.shape
    share = lambda n, cells: np.array([[max(0.0, min(p + 1, (k + 1) * n / cells) - max(p, k * n / cells)) for p in range(n)] for k in range(cells)])
    return share(h, rows) @ img @ share(w, columns).T * (rows * columns) / (h * w)


def plain_frequencies(cells):
    n = len(cells)
    basis = np.array([[math.cos((2 * i + 1) * u * math.pi / (2 * n)) * math.sqrt((1 if u == 0 else 2) / n) for i in range(n)] for u in range(n)])
    return (basis @ cells @ basis.T)[:8, :8]


def frames(spark, photos):
    rows = [(k, y, x, float(img[y, x])) for k, img in photos.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "photo_id int, y int, x int, v double").repartition(4), spark.createDataFrame([(k, *i.shape) for k, i in photos.items()], "photo_id int, h int, w int")


def test_hashes_follow_the_formula(spark):
    r = np.random.default_rng(7)
    photos = {k: r.integers(0, 256, s) for k, s in enumerate([(32, 32), (40, 50), (64, 33), (70, 90)])}
    pixels, sizes = frames(spark, photos)
    cells = {}
    for row in likeness.reduced(pixels, sizes, F.col("v")).collect():
        cells.setdefault(row["photo_id"], np.zeros((32, 32)))[row["i"], row["j"]] = row["v"]
    assert all(np.allclose(cells[k], plain_reduced(img, 32, 32)) for k, img in photos.items())
    got = {row["photo_id"]: row["bits"] for row in likeness.perceptual_hash(pixels, sizes, F.col("v")).collect()}
    for k, img in photos.items():
        f = plain_frequencies(plain_reduced(img, 32, 32))
        assert got[k] == (f.ravel() > np.median(f[1:])).astype(int).tolist()


def test_near_hashes_are_all_pairs_within_the_distance(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2, (12, 64))
    made = [base[r.integers(12)] ^ (r.random(64) < r.choice([0.0, 0.03, 0.08, 0.15])) for _ in range(150)]
    frame = spark.createDataFrame([(k, m.astype(int).tolist()) for k, m in enumerate(made)], "photo_id int, bits array<int>")
    for within in (0, 3, 8):
        got = sorted(map(tuple, likeness.near_hashes(frame, within).collect()))
        texts = sorted({"".join(map(str, m.astype(int))) for m in made})
        want = [(a, b, d) for a, b in itertools.combinations(texts, 2) if (d := sum(x != y for x, y in zip(a, b, strict=True))) <= within]
        assert got == sorted(want)


def test_projection_keeps_lengths_and_angles(spark):
    r = np.random.default_rng(3)
    rows = [(k, 7, int(b), float(v)) for k in range(40) for b, v in zip(r.choice(1024, 20, replace=False), r.normal(size=20), strict=True)]
    rows += [(100, 7, 3, 0.0)]
    frame = spark.createDataFrame(rows, "user long, seed int, bucket int, value double")
    found = {}
    for row in vectors.projected(frame.repartition(5), "user", F.col("seed")).collect():
        found.setdefault(row["user"], np.zeros(256))[row["place"]] = row["value"]
    again = {}
    for row in vectors.projected(frame.coalesce(1), "user", F.col("seed")).collect():
        again.setdefault(row["user"], np.zeros(256))[row["place"]] = row["value"]
    assert all(np.allclose(found[k], again[k], atol=1e-12) for k in found) and not found[100].any()
    dense = {k: np.zeros(1024) for k in range(40)}
    for k, _, b, v in rows[:-1]:
        dense[k][b] = v
    errors = []
    for a, b in itertools.combinations(range(40), 2):
        assert abs(np.linalg.norm(found[a]) - 1) < 1e-9
        errors.append(found[a] @ found[b] - dense[a] @ dense[b] / np.linalg.norm(dense[a]) / np.linalg.norm(dense[b]))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09
    other = {row["place"]: row["value"] for row in vectors.projected(frame.where("user = 1"), "user", F.lit(8)).collect()}
    assert not np.allclose([other[k] for k in range(256)], found[1])


def test_counter_normals_are_normal(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(vectors.counter_normal(F.lit(5), F.col("id"))).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs((x**3).mean()) < 0.1 and abs((x**4).mean() - 3) < 0.25


def test_signatures_follow_the_formula(spark):
    r = np.random.default_rng(9)
    shapes = {1: (64, 96), 2: (70, 122), 3: (130, 200), 4: (80, 100)}
    photos = {k: r.integers(0, 256, (*s, 3)) for k, s in shapes.items()}
    photos[4][:] = (9, 9, 9)
    rows = [(k, y, x, *map(int, img[y, x])) for k, img in photos.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    pixels = spark.createDataFrame(rows, "photo_id int, y int, x int, b int, g int, r int").repartition(4)
    sizes = spark.createDataFrame([(k, *s) for k, s in shapes.items()], "photo_id int, h int, w int")
    got = {x["photo_id"]: x for x in likeness.signatures(pixels, sizes).collect()}
    for k, img in photos.items():
        small = [np.rint(np.round(plain_reduced(img[..., c].astype(float), 64, 96), 6)) for c in range(3)]
        grey = np.rint((114 * small[0] + 587 * small[1] + 299 * small[2]) / 1000).astype(int)
        upto = np.cumsum(np.bincount(grey.ravel(), minlength=256))
        least = upto[grey.min()]
        want = grey if least == 6144 else np.rint((upto[grey] - least) * 255 / (6144 - least)).astype(int)
        assert got[k]["thumb"] == want.ravel().tolist() and (got[k]["h"], got[k]["w"]) == shapes[k]
        assert math.isclose(got[k]["brightness"], img.max(axis=2).mean())
    both = spark.createDataFrame([(got[1]["thumb"], got[2]["thumb"]), (got[1]["thumb"], got[4]["thumb"])], "a array<short>, b array<short>")
    c = [x[0] for x in both.select(likeness.correlation(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(c[0], np.corrcoef(got[1]["thumb"], got[2]["thumb"])[0, 1], abs_tol=1e-12) and c[1] is None
    assert bytes(both.select(likeness.packed(F.col("a"))).first()[0]) == bytes(got[1]["thumb"])
