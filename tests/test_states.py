"""Job states as a stream, over micro-batches and a restart."""

import random

import pytest

from shutterlake.streaming import states

MINUTE = 60


@pytest.fixture
def feed(spark, tmp_path):
    """Writes a file of updates (key, minute, status) and runs the stream over what is new."""
    states.use_state_store(spark)
    (tmp_path / "in").mkdir()
    count = [0]

    def run(*batches):
        for rows in batches:
            count[0] += 1
            made = spark.createDataFrame([(k, int(t * MINUTE), s, "extra") for k, t, s in rows], "job string, t long, state string, key string").selectExpr("job", "timestamp_seconds(t) at", "state", "key")
            made.coalesce(1).write.parquet(f"{tmp_path}/new{count[0]}")
            (part,) = (tmp_path / f"new{count[0]}").glob("part*")
            part.rename(tmp_path / "in" / f"{count[0]:03}.parquet")
        stream = spark.readStream.schema("job string, at timestamp, state string, key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        moves = states.job_states(stream, key="job", ts="at", status="state", late="5 minutes", idle="60 minutes", keep="120 minutes")
        q = moves.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(180)
        assert q.exception() is None and not q.isActive
        return sorted(repr((r["key"], r["before"], r["status"], int(r["s"] // MINUTE), r["outcome"])) for r in spark.read.parquet(f"{tmp_path}/out").selectExpr("*", "unix_seconds(ts) s").collect())

    return run


def test_order_repeats_refusals_and_expiry_over_a_restart(feed):
    got = feed(
        [("a", 1, "queued"), ("b", 2, "running"), ("c", 1, "queued"), ("d", 1, "completed"), (None, 1, "queued"), ("e", 1, "queued"), ("e", 2, "paused")],
        [("a", 2, "running"), ("a", 2, "running"), ("a", 1, "queued"), ("b", 1, "queued"), ("e", 3, "failed"), ("e", 4, "completed")],
    )
    want = [
        ("a", None, "queued", 1, "moved"), ("a", "queued", "running", 2, "moved"), ("b", None, "queued", 1, "moved"), ("b", "queued", "running", 2, "moved"), ("c", None, "queued", 1, "moved"),
        ("e", None, "queued", 1, "moved"), ("e", "queued", "failed", 3, "moved"), ("e", "queued", "paused", 2, "refused"), ("e", "failed", "completed", 4, "refused"),
    ]
    assert got == sorted(map(repr, want))
    # A restart goes on with the states that were kept: a finishes, c and d expire, repeats stay dropped.
    got = feed([("a", 3, "completed"), ("b", 2, "running")], [("z", 100, "queued")], [("z", 101, "running")])
    want += [("a", "running", "completed", 3, "moved"), ("z", None, "queued", 100, "moved"), ("z", "queued", "running", 101, "moved")]
    want += [("b", "running", "expired", 2, "moved"), ("c", "queued", "expired", 1, "moved"), ("d", None, "completed", 1, "refused"), ("d", None, "expired", 1, "moved")]
    assert got == sorted(map(repr, want))
    # Finished jobs are forgotten after a while: their name can be used again.
    got = feed([("z", 102, "failed"), ("y", 300, "queued")], [("a", 301, "queued"), ("y", 301, "queued")])
    want += [("z", "running", "failed", 102, "moved"), ("y", None, "queued", 300, "moved"), ("a", None, "queued", 301, "moved")]
    assert got == sorted(map(repr, want))


def test_any_split_of_updates_gives_the_same_moves():
    r = random.Random(1)
    for _ in range(500):
        path = ["queued", "running", r.choice(["completed", "failed"])][: r.randrange(1, 4)]
        updates = [(k, s) for k, s in enumerate(path)]
        updates += [r.choice(updates) for _ in range(3)]
        r.shuffle(updates)
        status, waiting, moves = None, [], []
        for u in updates:
            status, waiting, new = states.advance(status, waiting, [u])
            moves += new
        assert status == path[-1] and not waiting and all(m[3] == "moved" for m in moves)
        # A failure may come before the word that the job runs, which is then passed over.
        assert [m[1] for m in moves] == path or path[-1] == "failed" and [m[1] for m in moves] == ["queued", "failed"]


def test_all_at_once(spark):
    from shutterlake import catalog

    got = {}
    for row in catalog.queries()["job_moves"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(row["key"], []).append((row["ts"], row["status"], row["outcome"]))
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("user_id", "ts").collect()
    want = {}
    for row in rows:
        name = catalog.JOB_STATES.get(row["event_type"])
        if name:
            want.setdefault(str(row["user_id"]), set()).add((row["ts"], name))
    assert {k for k, v in want.items() if v} == set(got)
    for key, moves in got.items():
        done = [s for _, s, o in moves if o == "moved"]
        assert done == ["queued", "running", "completed", "failed"][: len(done)] or done in (["queued", "failed"], ["queued", "running", "failed"])
        first = sorted(t for t, s in want[key] if s == "queued")
        assert bool(first) == bool(done) and (not done or moves[0][0] == first[0])
