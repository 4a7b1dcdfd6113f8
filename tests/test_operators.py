"""Borders that the standard tables don't reach."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.functions import jsonops
from shutterlake.operators import relational, scoring, sessions, statistics, vectors


def values(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_a_gap_must_be_exceeded_and_null_times_never_cut(spark):
    shots = spark.createDataFrame([("a", 1, 0), ("a", 2, 6_000_000), ("a", 3, 12_000_001), ("a", 4, None)], "g string, i int, us long")
    out = {r["i"]: r["burst"] for r in sessions.bursts(shots, group="g", ts_us="us", order="i").collect()}
    assert out == {4: 0, 1: 0, 2: 0, 3: 1} or out == {1: 0, 4: 0, 2: 0, 3: 1}


def test_brackets_fold_in_time_order(spark):
    shots = spark.createDataFrame([("a", k, k * 1_000_000, ev) for k, ev in enumerate([0, 1, 2, 0, 1, 1])] + [("b", 9, 5, 0)], "g string, i int, us long, ev int")
    out = {r["i"]: r["bracket"] for r in sessions.stateful_brackets(shots, group="g", ts_us="us", ev="ev", item="i").collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: -1, 9: -1}


def test_shots_without_a_time_are_singles_and_unknown_exposures_join_nothing(spark):
    shots = spark.createDataFrame([("a", 0, None, 0), ("a", 1, None, 1), ("a", 2, 0, None), ("a", 3, 1, 1), ("a", 4, 2, 2), ("a", 5, 3, None), ("a", 6, 4, 1), ("a", 7, 9_000_000, 2)], "g string, i int, us long, ev int")
    out = {r["i"]: r["bracket"] for r in sessions.stateful_brackets(shots, group="g", ts_us="us", ev="ev", item="i").collect()}
    # An unknown exposure may begin a bracket (2); the next one (5) begins another, of one known exposure only.
    assert out == {0: -1, 1: -1, 2: 0, 3: 0, 4: 0, 5: -1, 6: -1, 7: -1}


def brute_scan(shots, same, window, forced):
    out, i, task = {}, 0, 0
    spread = lambda v: max(v) - min(v) if len(v) > 1 else -1
    while i < len(shots):
        run = [shots[i]]
        for other in shots[i + 1 : i + window]:
            if not same(run[0], other):
                break
            run.append(other)
        group = []
        if forced:
            evs = [s[2] for s in run if s[2] is not None]
            if len(run) == window and (spread(evs) >= 0.5 or spread([s[3] for s in run]) >= 12):
                group = run
        else:
            for test in (lambda c: spread([s[2] for s in c if s[2] is not None]) >= 1, lambda c: spread([s[3] for s in c]) >= 18):
                group = group or next((run[:n] for n in (5, 4, 3, 2) if len(run) >= n and test(run[:n])), [])
        group = group or [shots[i]]
        best = min(group, key=lambda s: abs(s[3] - 128))[0]
        out.update({s[0]: (task, best) for s in group})
        i, task = i + len(group), task + 1
    return out


def statistics_of(a, b):
    import statistics

    return statistics.correlation(a, b)


@pytest.mark.parametrize("forced", [False, True])
def test_scan_against_the_rule_on_lists(spark, forced):
    import random

    r = random.Random(3)
    rows, want = [], {}
    for g in range(6):
        us, shots = 0, []
        for k in range(40):
            us += r.choice([500_000, 2_000_000, 4_000_000, 9_000_000])
            look = r.choice([[1, 5, 9, 255], [2, 5, 10, 250], [200, 3, 4, 8], [7, 7, 7, 7], None])
            shots.append((g * 100 + k, us if r.random() < 0.9 else None, r.choice([None, 0.0, 0.5, 1.0, -1.0]), float(r.choice([100, 105, 120, 128, 150])), look, r.choice([60, 60, 60, 80])))
        shots.sort(key=lambda s: (s[1] is not None, s[1] or 0, s[0]))
        rows += [(g, *s) for s in shots]

        def same(a, b):
            apart = None if a[1] is None or b[1] is None else b[1] - a[1]
            looks = bool(a[4] and b[4] and len({*a[4]}) > 1 and len({*b[4]}) > 1 and statistics_of(a[4], b[4]) >= 0.93)
            return a[5] == b[5] and (looks if apart is None else apart <= 3e6 or (apart <= 6e6 and looks))

        want.update({k: (g, *v) for k, v in brute_scan(shots, same, 3 if forced else 5, forced).items()})
    frame = spark.createDataFrame(rows, "g int, i int, us long, ev double, light double, thumb array<short>, h int")
    out = sessions.greedy_brackets(frame, group="g", ts_us="us", item="i", ev="ev", brightness="light", thumb="thumb", shape=("h",), window=3 if forced else 5, forced=forced)
    assert {x["i"]: (x["g"], x["task"], x["reference"]) for x in out.collect()} == want
    pairs = sessions.scene_pairs(frame, group="g", ts_us="us", item="i", shape=("h",))
    timed = [s for s in rows if s[2] is not None]
    near = lambda a, b: a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 6e6 and same(*sorted((a[1:], b[1:]), key=lambda s: s[1]))
    assert sorted((x["a"], x["b"]) for x in pairs.collect()) == sorted((a[1], b[1]) for a in timed for b in timed if near(a, b))


def test_a_box_stays_unless_it_overlaps_by_more_than_the_limit(spark):
    boxes = spark.createDataFrame([("p", 1, 0, 0, 10, 10), ("p", 2, 0, 0, 10, 3), ("p", 3, 20, 20, 5, 5), ("p", 4, 0, 0, 10, 4)], "g string, i int, x int, y int, w int, h int")
    assert values(sessions.greedy_boxes(boxes, group="g", item="i")) == [("p", 1), ("p", 2), ("p", 3)]


def test_brackets_are_named_after_the_shot_nearest_to_no_compensation(spark):
    rows = spark.createDataFrame([(1, "a", -2.0), (1, "b", 0.3), (1, "c", -0.3), (2, "d", None)], "g int, s string, ev double")
    out = values(sessions.bracket_labels(rows, "g", item="s", ev="ev", order="s").select("reference", "label"))
    assert out == [("b", "b_ev[-2.0..+0.3]_n=3"), ("d", "d_ev[+0.0..+0.0]_n=1")]


def test_updates_keep_what_they_leave_null(spark):
    old = spark.createDataFrame([(1, "queued", None), (2, "queued", "e")], "id int, status string, error string")
    new = spark.createDataFrame([(1, "done", None), (2, None, "f"), (3, "x", "y")], "id int, status string, error string")
    assert values(relational.partial_update(old, new, "id", ["status", "error"])) == [(1, "done", None), (2, "queued", "f")]
    with pytest.raises(Exception, match="no record has the key 3"):
        relational.partial_update(old, new, "id", ["status", "error"], strict=True).collect()
    assert values(relational.partial_update(old, new.where("id < 3"), "id", ["status", "error"], strict=True)) == [(1, "done", None), (2, "queued", "f")]
    assert values(relational.duplicate_keys(new.union(new.where("id = 3")), old, "id")) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        relational.list_recent(old, "status", "id", 501)


def test_maps_merge_with_the_new_one_winning(spark):
    row = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3') as y, cast(null as map<string,string>) as z")
    got = row.select(relational.merge_maps(F.col("x"), F.col("y")).alias("m"), relational.merge_maps(F.col("z"), F.col("y")).alias("n")).first()
    assert got["m"] == {"a": "1", "b": "3"} and got["n"] == {"b": "3"}


def test_grades_and_means(spark):
    scores = spark.createDataFrame([(1, "exposure", 9.0, True), (1, "halo", 7.0, True), (1, "noise", None, True), (2, "halo", 5.0, False)], "k int, category string, score double, applicable boolean")
    out = {r["k"]: (r["overall"], r["grade"], r["weak"]) for r in scoring.scorecard(scores, "k").collect()}
    assert out[1] == (pytest.approx(8.08), "B", "halo") and out[2] == (0.0, "D", "")


def test_zero_vectors_and_k(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert values(vectors.top_k(rows, rows.where("vec_id = 0"), 5)) == [(0, 0, 0.0, 1), (0, 1, 0.0, 2)]
    assert vectors.top_k(rows, rows, 0).collect() == []


def test_equal_inputs_have_infinite_psnr(spark):
    row = spark.sql("select array(1.0D, 2.0D) as a, array(1.0D, 2.0D) as b")
    m = statistics.pair_metrics(F.col("a"), F.col("b"))
    assert row.select(*[c.alias(k) for k, c in m.items()]).first().asDict() == {"mse": 0.0, "mae": 0.0, "psnr": float("inf"), "ssim": pytest.approx(1.0)}


def test_json_leaves(spark):
    texts = ['{"a": [1, {"b": "x"}], "c": null, "d": true, "e{[": "]}", "f": {}, "g": []}', "7", '"s"', "nope", None, "[[1],[[2.5]]]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, pos string")
    want = [(0, "a[0]", 1.0), (0, "a[1].b=x", 1.0), (0, "c", 0.0), (0, "d", 1.0), (0, "e{[=]}", 1.0), (1, "", 7.0), (2, "=s", 1.0), (5, "[0][0]", 1.0), (5, "[1][0][0]", 2.5)]
    assert values(jsonops.json_leaves(rows, "key", "pos")) == want
    assert jsonops.json_leaves(rows.limit(0), "key", "pos").collect() == []
    texts = [r["c"] for r in rows.orderBy("key").select(jsonops.canonical_json(F.col("pos")).alias("c")).collect()]
    assert texts == ['{"a":[1,{"b":"x"}],"c":null,"d":true,"e{[":"]}","f":{},"g":[]}', "7", '"s"', None, None, "[[1],[[2.5]]]"]


def test_seeds_of_large_numbers_beside_nulls(spark):
    import hashlib

    rows = spark.createDataFrame([(2**53 + 1, "x"), (None, "x"), (-3, "é")], "s long, n string").coalesce(1)
    want = [None if s is None else int.from_bytes(hashlib.blake2b(f"{s}:{n}".encode(), digest_size=4).digest(), "big") for s, n in rows.collect()]
    assert [r["v"] for r in rows.select(jsonops.stage_seed(F.col("s"), F.col("n")).alias("v")).collect()] == want and want[0] == 3273987216


def test_signatures_and_their_window(spark):
    import hashlib
    import hmac

    row = spark.createDataFrame([(1000, "body")], "t long, b string").select(jsonops.signer("key")(F.col("t"), F.col("b")).alias("s"), F.col("t"))
    made = hmac.new(b"key", b"1000.body", hashlib.sha256).hexdigest()
    fits = lambda now, given: row.select(jsonops.fresh_and_equal(F.col("t"), F.lit(now), F.lit(given), F.col("s"))).first()[0]
    assert fits(1300, made) and not fits(1301, made) and not fits(1000, made[:-1] + "x")


def test_reports_read_what_is_there(spark):
    text = spark.createDataFrame([('{"stages":[{"name":"x","applied":true},null,{"error":"e"}]}',), ("{",), (None,)], "t string")
    got = [r["s"] for r in text.select(jsonops.from_report(F.col("t")).alias("s")).collect()]
    assert [s["name"] for s in got[0]] == ["x", ""] and got[0][1]["error"] == "e" and not got[0][0]["skipped"] and got[1] == [] and got[2] == []


def test_any_number_of_queries_is_searched(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5 + 1), float(i % 3)], i % 2) for i in range(60)], "vec_id long, embedding array<float>, label int").repartition(3)
    asked = rows.where("vec_id % 4 = 0")
    want = values(vectors.top_k(rows, asked, 5, keep=F.col("label") == 1))
    assert len(want) == 15 * 5
    monkeypatch.setattr(vectors, "MAX_QUERIES", 4)
    got = vectors.top_k(rows, asked, 5, keep=F.col("label") == 1)
    assert values(got) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_searches_give_what_each_pair_of_vectors_gives(spark, monkeypatch):
    """Equal, zero, long, null and infinite vectors; blocks of two queries, in one set and in cells."""
    made = [[float(i % 7 - 3), float(i % 5), float(i % 3)] for i in range(40)] + [[0.0, 0.0, 0.0], [1.0, 2.0], [], None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0], [1e-30, 0.0, 0.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(made)], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.where("vec_id % 3 = 0")
    pairs = rows.crossJoin(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    scored = pairs.select("query_id", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    want = values(scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 4"))
    monkeypatch.setattr(vectors, "AT_ONCE", 2)
    assert repr(values(vectors.top_k(rows, asked, 4))) == repr(want)
    monkeypatch.setattr(vectors, "MAX_QUERIES", 3)
    monkeypatch.setattr(vectors, "ROWS", 5)
    assert repr(values(vectors.top_k(rows, asked, 4))) == repr(want)
    assert vectors.top_k(rows, rows.limit(0), 4).collect() == [] and vectors.top_k(rows.limit(0), asked, 4).collect() == []


def test_searches_are_scored_as_matrices(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    plan = vectors.top_k(rows, rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_overlaps_of_masks_add_up(spark):
    masks = spark.createDataFrame([(1, "wall", *[1.0] * 6), (1, "floor", *[1.0] * 6), (2, "light", *[1.0] * 6)], "photo int, class string, " + ", ".join(f"{m} double" for m in scoring.MASK_METRICS))
    overlaps = spark.createDataFrame([(1, 0.05), (1, 0.06), (1, 0.2), (9, 0.5)], "photo int, iou double")
    out = {r["photo"]: (r["overall"], r["verdict"]) for r in scoring.mask_report(masks, "photo", overlaps=overlaps).collect()}
    assert out == {1: (pytest.approx(0.74), "review"), 2: (pytest.approx(0.3), "fail")}


def test_coverage_above_the_range_costs_half_as_much(spark):
    share = lambda name, v: spark.range(1).select(scoring.coverage_score(F.lit(name), F.lit(v)).alias("s")).first()["s"]
    assert [round(share(*x), 4) for x in (("wall", 0.1), ("wall", 0.5), ("floor", 0.6), ("crown", 0.2), ("rug", 9.0))] == [0.5, 1.0, 0.75, 0.0, 1.0]


def test_revocation_and_touch_times(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, at int")
    now, one = F.lit(9), F.col("id") < 3
    assert [tuple(r) for r in rows.select(relational.revoke(F.col("at"), one, now).alias("r"), relational.touch(F.col("at"), F.col("id") == 1, now).alias("t")).collect()] == [(9, 9), (5, 5)]


def test_json_numbers_and_genes(spark):
    from shutterlake.operators import decisions

    rows = spark.createDataFrame([(1, '{"texture": {"fine": true, "mid": "0.9"}, "sharpen_sigma": 99}'), (1, '{"agent": "cleanup", "texture": {"fine": 0.1}}'), (1, "no json"), (2, None)], "k int, params string")
    base = {"fine": 0.5, "mid": 0.3, "sharpen_sigma": 1.0}
    out = {(r["k"], r["field"]): round(r["value"], 6) for r in decisions.blend_genes(base, rows, "k").collect()}
    assert out == {(1, "fine"): 0.7, (1, "mid"): 0.3, (1, "sharpen_sigma"): 3.0, (2, "fine"): 0.5, (2, "mid"): 0.3, (2, "sharpen_sigma"): 1.0}


def test_a_seeded_pick_does_not_depend_on_the_partitions(spark):
    from shutterlake.operators import decisions

    rows = spark.createDataFrame([(k % 3, k) for k in range(60)], "g int, i int")
    picked = [sorted(map(tuple, decisions.pick_seeded(rows.repartition(n), "g", "i", s).collect())) for n in (1, 7) for s in (1, 2)]
    assert picked[0] == picked[2] != picked[1] == picked[3]


def test_rules_of_border_values(spark):
    from shutterlake.operators import decisions as d

    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    lit = F.lit
    p = one(d.preflight(lit(60.0), lit(0.7), lit(8.0), lit(12.0), lit(60.0), lit(14.0), lit(720)))
    assert (p["name"], p["warnings"], p["action"]) == ("warn", ["soft", "uneven_focus", "highlights_clipped", "shadows_clipped", "cast", "small"], "review")
    assert one(d.preflight(*[lit(v) for v in (500.0, 0.0, 0.0, 0.0, 34.9, 0.0, 2000)]))["action"] == "retake_dark"
    assert one(d.best_label(F.create_map(lit("b"), lit(1.0), lit("a"), lit(1.0))))["label"] == "b"
    assert tuple(one(d.best_label(F.create_map().cast("map<string,double>")))) == ("unknown", 0.0)
    assert [one(d.api_key(lit(k))) and tuple(one(d.api_key(lit(k)))) for k in ("key_live_" + "a1" * 16, "key_live_" + "a" * 31, "x")] == [("live", "a1" * 16), None, None]
    assert [tuple(one(d.id_and_label(lit(s)))) for s in ("12_angle_left", "loose", "_x")] == [("12", "angle_left"), ("", "loose"), ("", "_x")]


def test_photo_ids_are_made_of_bytes(spark):
    import hashlib

    import numpy as np

    bits = [1, 0, 1] + [0] * 61
    row = spark.createDataFrame([(480, 300_000, 3, bits)], "h int, w int, c int, f array<int>")
    want = hashlib.sha1(b"photo" + np.array([480, 300_000, 3], "<i8").tobytes() + np.array(bits, "<f4").tobytes()).hexdigest()
    assert row.select(jsonops.photo_id(*[F.col(k) for k in "hwcf"]).alias("i")).first()["i"] == want


def test_replies_of_all_kinds(spark):
    from shutterlake.operators import regions

    texts = ['{"points": [[10, 20], [5000, -3], ["x", 1], [7]]}', 'so: {"window": [3.9, 4], "lamp": [[1, 2]], "note": "x", "none": []} end', '{"points": []}', "nothing", None, "[1, 2]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    got = [r["m"] for r in rows.select(regions.reply_points(F.col("t"), F.lit(100), F.lit(200)).alias("m")).collect()]
    plain = [{k: [tuple(p) for p in v] for k, v in (m or {}).items()} for m in got]
    assert plain == [{"ceiling": [(10, 20), (199, 0)]}, {"window": [(3, 4)], "lamp": [(1, 2)]}, {}, {}, {}, {}]


def test_borders_of_second_differences_mirror(spark):
    import numpy as np

    from shutterlake.operators import regions

    x = np.random.default_rng(2).integers(0, 99, (5, 4)).astype(float)
    wide = np.pad(x, 1, mode="reflect")
    want = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * x
    rows = spark.createDataFrame([(1, y, k, float(x[y, k])) for y in range(5) for k in range(4)], "photo_id int, y int, x int, v double")
    got = {(r["y"], r["x"]): r["lap"] for r in regions.laplacians(rows, F.col("v")).collect()}
    assert all(got[y, k] == want[y, k] for y in range(5) for k in range(4))
