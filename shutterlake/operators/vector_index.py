"""A vector index for collections too large to scan: inverted lists, product-quantised codes, exact re-ranking.

``build`` fits a coarse quantiser and the code books on a bounded sample and writes a
table partitioned by list with every row in it.  ``search`` plans the lists each query
probes, sums table look-ups over the codes of these lists, keeps the best ``pool`` of
each query and ranks them again by the exact score.  Rows and queries of a list meet in
cells of bounded size; nothing is paired with everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.vectors import cosine
from shutterlake.session import settled

#: Most vectors, and most values, of the sample that is fitted on the driver.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
#: Most lists; there are about half the root of the rows.
LISTS = 1024
#: Components of a sub-vector, and codes of a book (a byte).
PART, CODES = 4, 256
#: Rows and queries of a cell, and queries that are scored at once.
ROWS, QUERIES, AT_ONCE = 8192, 2048, 128


@dataclass
class Quantiser:
    """Centres of the lists, books of codes for what is left of a vector there, lists to probe and rows to score exactly."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int = 1
    pool: int = 1

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a : a + PART] for a in range(0, self.width, PART)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        of = nearest_centre(x, self.centres)
        left = x - self.centres[of]
        return of, np.column_stack([nearest_centre(p, b) for p, b in zip(self.parts(left), self.books, strict=True)]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the codes: queries x parts x codes."""
        made = np.zeros((len(q), len(self.books), CODES), np.float32)
        for k, (p, b) in enumerate(zip(self.parts(q), self.books, strict=True)):
            made[:, k, : len(b)] = p @ b.T
        return made

    def about(self, q: np.ndarray, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products by table look-up: queries x rows, of rows with their lists and codes."""
        tables = self.tables(q)
        near = (q @ self.centres.T).astype(np.float32)[:, of]
        for p in range(codes.shape[1]):
            near += tables[:, p].take(codes[:, p], axis=1)
        return near


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length == 0, 1, length)


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to what is the same for all centres."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return gaps(x, centres).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = nearest_centre(x, centres)
        n = np.bincount(of, minlength=k)
        total = np.column_stack([np.bincount(of, x[:, j], k) for j in range(x.shape[1])])
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[r.choice(len(x), k)])
    return centres


def fit(sample: np.ndarray, lists: int, *, k: int, recall: float) -> Quantiser:
    """Fitted on unit vectors; ``probes`` and ``pool`` follow from vectors of the sample as queries.

    ``probes``: lists, nearest first, that hold this share of their k nearest.  Nearer
    neighbours lie in nearer lists, and of all rows they are nearer than of a sample.
    ``pool``: twice the rows, best look-ups first, among which this share is.
    """
    centres = k_means(sample, lists)
    of = nearest_centre(sample, centres)
    left = sample - centres[of]
    made = Quantiser(centres, [k_means(left[:, a : a + PART], CODES) for a in range(0, sample.shape[1], PART)])
    some = np.unique(np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int))
    near = (-(sample[some] @ sample.T)).argsort(1)[:, :k]
    rows = np.arange(len(some))[:, None]


    def enough(places: np.ndarray) -> int:
        """As many first places as hold the share."""
        return int(np.sort(places.ravel())[min(places.size - 1, int(np.ceil(recall * places.size)))]) + 1

    order = lambda cost: cost.argsort(1, kind="stable").argsort(1)
    made.probes = enough(order(gaps(sample[some], centres))[rows, of[near]])
    made.pool = 2 * enough(order(-made.about(sample[some], *made.encode(sample)))[rows, near])
    return made


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def checked(vectors: DataFrame, vec_col: str, width: int) -> DataFrame:
    """The same rows; a vector of another width, or with a null in it, fails the job that meets it."""
    v = F.col(vec_col)
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull())
    said = F.concat(F.lit("vector of "), F.coalesce(F.size(v), F.lit(0)).cast("string"), F.lit(f" components, {width} are wanted, none of them null"))
    return vectors.withColumn(vec_col, F.when(F.coalesce(good, F.lit(False)), v).otherwise(F.raise_error(said)))


def upsert_points(stored: DataFrame, incoming: DataFrame, *, width: int, order: str, id_col: str = "id", vec_col: str = "vector", payload_col: str = "payload") -> DataFrame:
    """``id_col, vec_col, payload_col``: stored points, replaced by the newest incoming one of their id (by ``order``; null is oldest).

    The payload is the id under its column's name and the incoming map over it (its keys win).
    Vectors are checked for their width.
    """
    columns = [id_col, vec_col, payload_col]
    newest = incoming.groupBy(id_col).agg(F.max_by(F.struct(vec_col, payload_col), F.struct(F.col(order))).alias("_p"))
    new = checked(newest.select(id_col, f"_p.{vec_col}", f"_p.{payload_col}"), vec_col, width)
    own = F.create_map(F.lit(id_col), F.col(id_col).cast("string"))
    given = F.coalesce(F.col(payload_col), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k)), given)
    kept = stored.select(*columns).join(newest.select(id_col), id_col, "left_anti")
    return kept.unionByName(new.withColumn(payload_col, merged))


def build(vectors: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), k: int = 10, recall: float = 0.97, sample: int = SAMPLE) -> Quantiser | None:
    """Writes the index of all rows below ``path``: ``id_col, codes`` and the columns ``keep``, partitioned by ``list``.

    At most about ``sample`` vectors, chosen by a hash of their id, are fitted on the driver.
    The width is that of the first vector met; others fail.  None without rows.
    """
    rows = vectors.select(id_col, vec_col, *keep).where(F.col(vec_col).isNotNull())
    first = rows.select(F.size(vec_col)).first()
    if first is None:
        return None
    n = rows.count()
    wanted = max(1, min(sample, SAMPLE_VALUES // max(1, first[0])))
    chosen = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < int((1 << 32) * min(1.0, wanted / n)))
    x = checked(chosen, vec_col, first[0]).orderBy(id_col).select(vec_col).toArrow().column(0)
    x = x if len(x) else checked(rows, vec_col, first[0]).limit(1).select(vec_col).toArrow().column(0)
    quantiser = fit(unit(_matrix(x)), max(1, min(LISTS, round(n**0.5 / 2))), k=k, recall=recall)

    def encode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                of, codes = quantiser.encode(unit(_matrix(b.column(vec_col))))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in (id_col, *keep)] + [packed, pa.array(of, pa.int32())], names=[id_col, *keep, "codes", "list"])

    kinds = dict(rows.dtypes)
    made = checked(rows, vec_col, first[0]).mapInArrow(encode, ", ".join(f"{c} {kinds[c]}" for c in (id_col, *keep)) + ", codes binary, list int")
    # A list is one file or, if it is large, several.
    made.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(max(1, n // (LISTS * ROWS))))).write.partitionBy("list").parquet(path)
    return quantiser


def search(quantiser: Quantiser, path: str, vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: Column | None = None, pool: int | None = None, probes: int | None = None, score: Callable[[Column, Column], Column] = cosine, rounded: int = 6) -> DataFrame:
    """``query_id, id_col, score, rank``: the k best rows of each query that are found, by the exact score, ties by id.

    ``keep``: a test on the index's columns.  ``pool``: rows of each query that are scored
    exactly (ten times k, or what the sample asks for); without ``keep`` more lists are probed until they hold as many.
    ``score`` takes a row's and the query's vector.
    """
    spark = vectors.sparkSession
    pool, probes = max(k, pool or max(10 * k, quantiser.pool)), probes or quantiser.probes
    index = spark.read.parquet(path)
    sizes = np.zeros(len(quantiser.centres), np.int64)
    for row in index.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    least = min(int(sizes.sum()), pool)
    asked = checked(queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query")), "query", quantiser.width)
    kinds = dict(asked.dtypes)

    def plan(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                q = unit(_matrix(b.column("query")))
                order = gaps(q, quantiser.centres).argsort(1)
                n = np.maximum(probes, (np.cumsum(sizes[order], 1) < least).sum(1) + 1).clip(max=len(sizes))
                of = pa.array(np.repeat(np.arange(len(q)), n))
                lists = np.concatenate([o[:m] for o, m in zip(order, n, strict=True)])
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(of), b.column("query").take(of), pa.array(lists, pa.int32())], names=["query_id", "query", "list"])

    plans = settled(asked.mapInArrow(plan, f"query_id {kinds['query_id']}, query {kinds['query']}, list int"))
    met = {r["list"]: r["count"] for r in plans.groupBy("list").count().collect()}
    parts = F.broadcast(spark.createDataFrame([(j, -(-max(1, int(sizes[j])) // ROWS), -(-n // QUERIES)) for j, n in met.items()], "list int, row_parts int, query_parts int"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Lists that nobody probes are not read: the join's keys prune the table's partitions.
    left = (index if keep is None else index.where(keep)).join(parts, "list").withColumn("i", part(id_col, "row_parts")).withColumn("j", every("query_parts")).select("list", "i", "j", id_col, "codes")
    right = plans.join(parts, "list").withColumn("j", part("query_id", "query_parts")).withColumn("i", every("row_parts")).select("list", "i", "j", "query_id", "query")

    def look_up(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(wanted):
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1)
            ids, names = rows.column(id_col).combine_chunks(), wanted.column("query_id").combine_chunks()
            q = unit(_matrix(wanted.column("query")))
            of_list = np.full(len(codes), wanted.column("list")[0].as_py())
            for a in range(0, len(q), AT_ONCE):
                near = quantiser.about(q[a : a + AT_ONCE], of_list, codes)
                best = np.argpartition(-near, pool - 1, axis=1)[:, :pool] if len(codes) > pool else np.tile(np.arange(len(codes)), (len(near), 1))
                of = np.repeat(np.arange(len(near)), best.shape[1])
                found.append(pa.table([names.take(pa.array(of + a)), ids.take(pa.array(best.ravel())), pa.array(near[of, best.ravel()])], names=["query_id", id_col, "about"]))
        return pa.concat_tables(found) if found else pa.table({"query_id": wanted.column("query_id").slice(0, 0), id_col: rows.column(id_col).slice(0, 0), "about": pa.array([], pa.float32())})

    kind = dict(vectors.dtypes)[id_col]
    hits = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(look_up, f"query_id {kinds['query_id']}, {id_col} {kind}, about float")
    some = hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), id_col))).where(F.col("_k") <= pool)
    exact = some.join(vectors.select(id_col, F.col(vec_col).alias("_row")), id_col).join(asked, "query_id")
    scored = exact.select("query_id", id_col, F.round(score(F.col("_row"), F.col("query")), rounded).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
