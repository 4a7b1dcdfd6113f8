"""Approximate nearest neighbours by inner product: inverted lists scanned a block of columns at a time.

**Index.** Equal vectors are one class (its least ids stand for it).  A coordinate
that brings every vector to the greatest length turns the largest inner product
into the least distance.  A sample of at most ``SAMPLE`` vectors gives the centres
of the lists and, from its own neighbours, how many lists are to be probed for
``recall``; every class is in one list.

**Search.** Vectors are turned by one random rotation, so that the first d of D
coordinates estimate a distance: D/d times their part.  A list's vectors are scanned
by blocks of ``BLOCK`` columns; after each block a hypothesis test abandons
candidates whose estimate exceeds the query's best distance by more than chance
allows, ``(1 + EPSILON / sqrt(d)) ** 2`` times.  The first best distance of a query is
the one within the sample's part of the lists it probes.  What is left is scored in double precision on the
original vectors.

**Cells.** A list's rows and the queries that probe it meet in cells of at most about
``ROWS`` rows and ``QUERIES`` queries, so a list that holds a third of all rows is many
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm import store

#: Most vectors, and most values, of the sample that is fitted on the driver.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
#: Most lists; there are about half the root of the classes.
LISTS = 1024
#: Columns of a block, and the test's width.
BLOCK, EPSILON = 16, 2.1
#: Further vectors of the sample that must be as near as a query's first best distance.
SPARE = 4
#: Rows and queries of a cell.
ROWS, QUERIES = 8192, 2048
#: Rows of a cell that are scanned at once.
SLICE = 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vector`` of rows with an id and a vector without nulls, infinities and NaN that isn't zero."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``class, ids, vector``: equal vectors once, with their ``keep`` least ids in order; ``class`` is the least.

    Only the least ids of each task's copies are shuffled.
    """
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    least = rows.withColumn("_place", place).where(F.col("_place") <= keep)
    return least.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "vector")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


class Space:
    """The rotated space: a coordinate for the missing length, then one random rotation."""

    def __init__(self, width: int, longest: float, seed: int = 7):
        self.width, self.longest = width + 1, longest
        self.turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((width + 1, width + 1)))[0]

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]) @ self.turn

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.turn[:-1]


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Means of the sample's vectors by list; a list that loses all takes a vector of the sample."""
    r = np.random.default_rng(seed)
    means = sample[r.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        of = distances(sample, means).argmin(1)
        n = np.bincount(of, minlength=lists)
        total = np.zeros_like(means)
        np.add.at(total, of, sample)
        means = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sample[r.choice(len(sample), lists)])
    return means


def probes_for(sample: np.ndarray, asked: np.ndarray, means: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that this share of the k nearest of the sample is met.

    ``asked``: the sample's vectors as queries.  Of all vectors the k nearest are nearer than of the sample, and lie in nearer lists.
    """
    some = np.unique(np.linspace(0, len(sample) - 1, min(len(sample), 256)).astype(int))
    near = distances(asked[some], sample)
    near[np.arange(len(some)), some] = np.inf
    near = near.argsort(1)[:, : min(k, len(sample) - 1)]
    place = distances(asked[some], means).argsort(1).argsort(1)
    needed = np.sort(place[np.arange(len(some))[:, None], distances(sample, means).argmin(1)[near]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def scan(rows: np.ndarray, asked: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among the k nearest rows of a query, by distances in the rotated space.

    ``best``: a distance of each query beyond which nothing is wanted.  Sliced by rows,
    then by blocks of columns; a query's best distance shrinks with each slice.
    """
    width = rows.shape[1]
    slack = 1e-9 * (1 + float((rows[:1] ** 2).sum()))
    limit = best.copy()
    found_q, found_r, found_d = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    for start in range(0, len(rows), SLICE):
        part = rows[start : start + SLICE]
        near = np.zeros((len(asked), len(part)))
        pairs = None
        for a in range(0, width, BLOCK):
            b = min(width, a + BLOCK)
            if pairs is None:
                near += distances(asked[:, a:b], part[:, a:b])
                values, limits = near, limit[:, None]
            else:
                q, r = pairs
                near += ((asked[q, a:b] - part[r, a:b]) ** 2).sum(1)
                values, limits = near, limit[q]
            # The last block's values are the distances themselves.
            wide = (1 + EPSILON / np.sqrt(b)) ** 2 * b / width if b < width else 1.0
            alive = values <= limits * wide + slack
            if pairs is not None:
                pairs, near = (q[alive], r[alive]), near[alive]
            elif b == width or np.count_nonzero(alive) < alive.size / 8:
                pairs = np.nonzero(alive)
                near = near[pairs]
        q, r = pairs
        found_q, found_r, found_d = np.concatenate([found_q, q]), np.concatenate([found_r, r + start]), np.concatenate([found_d, near])
        order = np.lexsort([found_d, found_q])
        found_q, found_r, found_d = found_q[order], found_r[order], found_d[order]
        first = np.searchsorted(found_q, np.arange(len(asked)))
        ends = np.append(first[1:], len(found_q))
        full = ends - first >= k
        limit[full] = np.minimum(limit[full], found_d[first[full] + k - 1])
        kept = found_d <= limit[found_q] + slack
        found_q, found_r, found_d = found_q[kept], found_r[kept], found_d[kept]
    return found_q, found_r


def scores(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, step: int = 100_000) -> np.ndarray:
    """Inner products of pairs in double precision, summed from the first component to the last."""
    out = np.zeros(len(q))
    for k in range(0, len(q), step):
        out[k : k + step] = np.add.reduce(np.ascontiguousarray((queries[q[k : k + step]] * rows[r[k : k + step]]).T), axis=0)
    return out


def build(rows: DataFrame, *, k: int, recall: float):
    """``(index, space, means, sample, sizes, probes)``: ``index`` has ``class, ids, vector, list`` for every class; None without rows.

    Only vectors of the commonest width take part.
    """
    shapes = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square"))
    shape = shapes.orderBy(F.desc("n"), F.desc("width")).first()
    if shape is None:
        return None
    known = store.materialize(classes(rows.where(F.size("vector") == shape["width"]), k + 1), "classes")
    n = known.count()
    space = Space(shape["width"], float(np.sqrt(shape["square"])))
    wanted = max(1, min(SAMPLE, SAMPLE_VALUES // shape["width"]))
    # Chosen by a hash of the id, so that the sample is the same however rows are dealt; its size varies by a few roots.
    chosen = known.where(F.pmod(F.xxhash64("class"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, wanted / n))).select("class", "vector").orderBy("class")
    raw = _matrix(chosen.toArrow().column("vector"))
    if not len(raw):
        raw = _matrix(known.orderBy("class").limit(1).select("vector").toArrow().column("vector"))
    sample, asked = space.rows(raw), space.queries(raw)
    means = centres(sample, max(1, min(LISTS, len(sample), round(n**0.5 / 2))))
    probes = probes_for(sample, asked, means, k, recall)

    def assign(batches):
        for batch in batches:
            of = distances(space.rows(_matrix(batch.column("vector"))), means).argmin(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], names=["class", "ids", "vector", "list"])

    kind = known.schema["vector"].dataType.simpleString()
    index = store.materialize(known.mapInArrow(assign, f"class long, ids array<long>, vector {kind}, list int"), "lists")
    sizes = np.zeros(len(means), np.int64)
    for row in index.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    return index, space, means, sample, sizes, probes


def plan_probes(asked: DataFrame, space: Space, means: np.ndarray, sample: np.ndarray, sizes: np.ndarray, probes: int, k: int) -> DataFrame:
    """``class, vector, best, list``: the lists that each query probes and the distance of the sample's k-th nearest there (and ``SPARE`` more, as the test may err).

    Further lists are probed until these hold k rows several times over, so few rows are found whole.
    """
    least = min(int(sizes.sum()), 8 * k)
    lists_of = distances(sample, means).argmin(1)
    place = k - 1 + SPARE
    kind = asked.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = space.queries(_matrix(part.column("vector")))
                order = distances(x, means).argsort(1)
                held = np.cumsum(sizes[order], axis=1)
                n = np.maximum(probes, (held < least).sum(1) + 1).clip(max=len(means))
                of = np.repeat(np.arange(len(x)), n)
                # Only the sample's vectors in probed lists count: so many rows at least are as near.
                near = np.where(order.argsort(1)[:, lists_of] < n[:, None], distances(x, sample), np.inf)
                best = np.partition(near, place, axis=1)[:, place] if len(sample) > place else np.full(len(x), np.inf)
                lists = np.concatenate([o[:j] for o, j in zip(order, n, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("class").take(pa.array(of)), part.column("vector").take(pa.array(of)), pa.array(best[of]), pa.array(lists, pa.int32())], names=["class", "vector", "best", "list"])

    return asked.mapInArrow(run, f"class long, vector {kind}, best double, list int")


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.97) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``asked`` the k rows of ``vectors`` of largest inner product that are found, nearest first, ties to the smaller id.

    ``asked`` are rows of ``vectors``; a query's own id is never among its results.  Null
    ids, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part, nor do vectors of another width than most.  Rows of one id and one
    vector count once; other vectors of that id are rows of their own.  With fewer than
    k other rows all are found.  No rows, or no queries, give none; other columns are not looked at.
    ``recall``: the share of the sample's neighbours that probed lists must meet.
    """
    spark = vectors.sparkSession
    built = build(usable(vectors, id_col, vec_col), k=k, recall=recall)
    if built is None or k <= 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, space, means, sample, sizes, probes = built
    keep = k + 1
    rows = index.select(F.col("class").alias("row_class"), "ids", F.col("vector").alias("row"), "list")
    queries = usable(asked, id_col, vec_col).withColumnRenamed("id", "query_id").join(index.select("class", "vector"), "vector").select("query_id", "class").distinct()
    queries = store.materialize(queries, "queries")
    wanted = index.join(queries.select("class").distinct(), "class", "left_semi").select("class", "vector")
    plans = store.materialize(plan_probes(wanted, space, means, sample, sizes, probes, keep), "probes")
    # A row for each list: into how many parts its rows and its queries are dealt.
    counted = {r["list"]: r["count"] for r in plans.groupBy("list").count().collect()}
    parts = spark.createDataFrame([(j, max(1, -(-int(sizes[j]) // ROWS)), -(-n // QUERIES)) for j, n in counted.items()], "list int, row_parts int, query_parts int")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = F.broadcast(parts)
    left = rows.join(dealt, "list").withColumn("i", part("row_class", "row_parts")).withColumn("j", upto("query_parts")).select("list", "i", "j", "row_class", "row")
    right = plans.join(dealt, "list").withColumn("j", part("class", "query_parts")).withColumn("i", upto("row_parts")).select("list", "i", "j", "class", "vector", "best")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"class": pa.array([], pa.int64()), "row_class": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(a) or not len(b):
            return empty
        x, y = _matrix(a.column("row")), _matrix(b.column("vector"))
        q, r = scan(space.rows(x), space.queries(y), b.column("best").to_numpy(), keep)
        return pa.table([b.column("class").combine_chunks().take(pa.array(q)), a.column("row_class").combine_chunks().take(pa.array(r)), pa.array(scores(y, x, q, r))], names=["class", "row_class", "score"])

    hits = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(search, "class long, row_class long, score double")
    by_class = Window.partitionBy("class").orderBy(F.desc("score"), "row_class")
    top = hits.withColumn("_place", F.row_number().over(by_class)).where(F.col("_place") <= keep).drop("_place")
    # The copies of each class found, then the first k + 1 rows of each query's class: one of them may be the query's own.
    spread = top.join(rows.select("row_class", "ids"), "row_class").select("class", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    best = spread.withColumn("_place", F.row_number().over(by_row)).where(F.col("_place") <= keep + k)
    listed = best.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("_place", "vec_id", "score"))).alias("_found"))
    mine = queries.join(listed, "class").select("query_id", F.filter("_found", lambda x: x["vec_id"] != F.col("query_id")).alias("_found"))
    ranked = mine.select("query_id", F.posexplode(F.slice("_found", 1, k)).alias("_k", "_hit"))
    return ranked.select("query_id", (F.col("_k") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))
