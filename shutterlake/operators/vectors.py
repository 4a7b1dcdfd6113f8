"""Exact vector search and retrieval through it, as matrices and column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.session import dealt

#: Rows of a query set that may be sent to all executors.
MAX_QUERIES = 10_000
#: Queries that meet a task's rows at once, and rows of a cell.
AT_ONCE, ROWS = 256, 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, least: float = 1e-9) -> Column:
    """Unit length; a vector shorter than ``least`` stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n < least, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: Column | None = None, rounded: int = 6) -> DataFrame:
    """``query_id, id_col, score, rank``: the k nearest rows of each query by cosine, ties by id.

    Rows are dealt over tasks, and some queries at a time meet a task's rows as matrices.  Up to
    ``MAX_QUERIES`` queries go to every task; a larger set meets the rows in cells of so many queries
    and ``ROWS`` rows.  Ranks are cut within each before any shuffle.  Vectors with nulls or
    components that aren't finite, or of another width than the first query, meet the others pair by pair.
    """
    if k <= 0:
        return vectors.limit(0).select(F.col(id_col).alias("query_id"), id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("_query"))
    rows = (vectors if keep is None else vectors.where(keep)).select(id_col, vec_col)
    n = queries.limit(MAX_QUERIES + 1).count()
    small = n <= MAX_QUERIES
    first = asked.where(F.size("_query") > 0).select(F.size("_query")).first()
    width = first[0] if first else 0
    plain = lambda c: F.coalesce((F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    kind = dict(vectors.dtypes)[id_col]
    names = ["query_id", id_col, "score"]
    schema = f"query_id {kind}, {id_col} {kind}, score double"

    def scored(rows: pa.Table, ids: pa.Array, wanted: np.ndarray) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column(id_col), null_placement="at_start"))
        names_of, found = rows.column(id_col).combine_chunks(), nearest(matrix(rows.column(vec_col)), wanted, k, rounded)
        made = [pa.table([ids.take(pa.array(a)), names_of.take(pa.array(b)), pa.array(c)], names=names) for a, b, c in found]
        return pa.concat_tables(made) if made else pa.table([ids.slice(0, 0), names_of.slice(0, 0), pa.array([], pa.float64())], names=names)

    fit, meant = rows.where(plain(vec_col)), asked.where(plain("_query"))
    if small:
        # A file of few rows would be one task; tasks are bounded by the scores that they hold at once.
        fit = dealt(rows, id_col, max(1, min(n, AT_ONCE))).where(plain(vec_col))
        held = meant.toArrow()
        ids, wanted = held.column("query_id").combine_chunks(), matrix(held.column("_query"))

        def score(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from scored(pa.Table.from_batches([batch]), ids, wanted).to_batches()

        hits = fit.mapInArrow(score, schema)
    else:
        parts, blocks = -(-max(1, rows.count()) // ROWS), -(-asked.count() // MAX_QUERIES)
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cell = lambda frame: frame.repartition(parts * blocks, "_i", "_j").groupBy("_i", "_j")
        left = cell(fit.withColumn("_i", part(id_col, parts)).withColumn("_j", every(blocks)))
        right = cell(meant.withColumn("_j", part("query_id", blocks)).withColumn("_i", every(parts)))

        def meet(rows: pa.Table, wanted: pa.Table) -> pa.Table:
            return scored(rows, wanted.column("query_id").combine_chunks(), matrix(wanted.column("_query")))

        hits = left.cogroup(right).applyInArrow(meet, schema)
    odd = rows.where(~plain(vec_col))
    for some, others in ((odd, asked), (rows.where(plain(vec_col)), asked.where(~plain("_query")))):
        if not (some.isEmpty() or others.isEmpty()):
            pairs = some.join(F.broadcast(others), F.lit(True)) if small else some.hint("shuffle_replicate_nl").crossJoin(others)
            hits = hits.unionByName(pairs.select("query_id", id_col, F.round(cosine(F.col(vec_col), F.col("_query")), rounded).alias("score")))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def nearest(rows: np.ndarray, wanted: np.ndarray, k: int, rounded: int):
    """Places of queries and rows, and their cosine: the k best rows of each query, ties by the row's place; ``AT_ONCE`` queries at a time."""
    if not (len(rows) and len(wanted)):
        return
    size, own = np.sqrt((rows * rows).sum(1)), np.sqrt((wanted * wanted).sum(1))
    n, scale = len(rows), 10.0**rounded
    for at in range(0, len(wanted), AT_ONCE):
        sizes = own[at : at + AT_ONCE, None] * size
        cosines = wanted[at : at + AT_ONCE] @ rows.T / np.where(sizes == 0, 1.0, sizes)
        whole = np.copysign(np.floor(np.abs(cosines) * scale + 0.5), cosines)
        if n <= k:
            best = np.broadcast_to(np.arange(n), whole.shape)
        elif scale * n < 1 << 52:
            # Whole numbers that doubles hold: the score first, then the place.
            best = np.argpartition(np.arange(n) - whole * n, k - 1, axis=1)[:, :k]
        else:
            best = np.argsort(-whole, axis=1, kind="stable")[:, :k]
        yield at + np.repeat(np.arange(len(whole)), best.shape[1]), best.ravel(), (np.take_along_axis(whole, best, 1) / scale).ravel() + 0.0


def retrieve(hits: DataFrame, items: DataFrame, *, item_col: str, agent_col: str, agent: str, k: int) -> DataFrame:
    """Items behind ranked hits: first-seen distinct ones of the agent (or of none), the first k in rank order.

    ``hits`` has query_id, rank and ``item_col``; a JSON object in ``params`` is required of an item.
    """
    first = hits.groupBy("query_id", item_col).agg(F.min("rank").alias("rank"))
    fit = items.where((F.col(agent_col).isNull()) | (F.col(agent_col) == agent)).where(F.col("params").rlike(r"^\s*\{"))
    rank = Window.partitionBy("query_id").orderBy("rank")
    return first.join(fit, item_col).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


# --- random projection --------------------------------------------------------------


def counter_normal(*counters: Column) -> Column:
    """A standard normal number that depends on the counters alone: a digest of them makes two uniform numbers, and these one normal."""
    digest = F.sha1(F.concat_ws(":", *[c.cast("string") for c in counters]))
    uniform = lambda at: (F.conv(F.substr(digest, F.lit(at), F.lit(12)), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(uniform(13) * (2 * math.pi))


def projected(features: DataFrame, key: str, seed: Column, *, width: int = 256, index: str = "bucket", value: str = "value") -> DataFrame:
    """``key, place, value``: sparse features turned into ``width`` values of unit length by a Gaussian matrix that is never held.

    The matrix of a key is made from ``seed`` (a column of ``features``, the same for all rows of
    a key), the feature's index and the place, so it is the same on every machine.  A key
    whose features are all 0 gets zeros; null keys get none.  Features are dealt by key over as
    many tasks as bound the rows each makes; those of one key are in one task.
    """
    rows = features.select(key, seed.alias("_seed"), F.col(index).alias("_i"), F.col(value).alias("_v"))
    # Features are few bytes, so Spark would plan few tasks for them; each becomes ``width`` rows, and a key's rows stay where they are made.
    rows = dealt(rows, key, width).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    sums = rows.groupBy(key, "place").agg(F.sum(F.col("_v") * counter_normal(F.col("_seed"), F.col("_i"), F.col("place"))).alias("value"))
    size = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return sums.withColumn("_size", size).where(F.col(key).isNotNull()).select(key, "place", F.when(F.col("_size") > 0, F.col("value") / F.col("_size")).otherwise(0.0).alias("value"))
