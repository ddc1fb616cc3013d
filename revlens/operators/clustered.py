"""Clustered vector index: top-k that visits lists by their distance bound.

``build`` deals unit vectors to ``n_lists`` lists by the nearest of as many
centroids (spherical k-means; first centroids from a bounded sample, every
round over all rows) and writes the rows partitioned by list, beside a table of
the lists: centroid, number of rows, greatest and mean distance to the centroid.

``search`` works in two steps, each a join of vector blocks on the list (and the
filter values):

1. every question visits the lists whose centroids are nearest, until these
   hold some times k rows; its k-th best score so far bounds what it needs;
2. by the triangle inequality no row of a list is nearer than the distance to
   its centroid less its greatest distance from it.  Lists where that is not
   below the distance of the k-th score are left out, all others are visited.

With ``exact`` the result is that of ``topk_cosine``, row for row.  Otherwise a
list counts as far as its rows lie on average, which leaves out more lists and
may miss rows near a list's edge; every row is in the index either way.

What reaches the driver is bounded by ``n_lists`` (centroids, list numbers).
Rows with a vector that is NULL, of another length than ``dim``, with a NaN or
of norm 0 have no score and are not in the index.  Equal vectors share a list,
and a list of a third of all rows is scored block by block like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.retrieve import best_of, scored_blocks

ROUNDS = 3
#: Rows per list of the sample from which the first centroids are taken.
SAMPLE = 16
#: Rows that the first step visits for each of the k best, at least.
ENOUGH = 8
#: Room for rounding: scores are ranked at ten decimals.
EPS = 1e-9


@dataclass
class Index:
    """Where an index lies, and its columns."""

    path: str
    id_col: str
    key_cols: tuple[str, ...]
    dim: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a usable vector, their unit vectors)."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(size == dim)
    m = np.asarray(column.take(pa.array(at)).flatten().fill_null(np.nan), np.float64).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(1))
    good = np.flatnonzero(norm > 0)
    return at[good], m[good] / norm[good, None]


def _first_centroids(rows: DataFrame, vec_col: str, dim: int, n_lists: int, seed: int) -> np.ndarray:
    """Distinct vectors of a bounded sample, each far from those before it."""
    sample = rows.where(F.size(vec_col) == dim).orderBy(F.xxhash64(vec_col, F.lit(seed))).select(vec_col).limit(SAMPLE * n_lists)
    _, m = _units(pa.array([r[0] for r in sample.collect()], pa.list_(pa.float64())), dim)
    if not len(m):
        return np.zeros((0, dim))
    chosen, near = [0], m @ m[0]
    while len(chosen) < min(n_lists, len(m)) and near.min() < 1 - EPS:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, m @ m[chosen[-1]])
    return m[chosen]


def _refined(rows: DataFrame, vec_col: str, centroids: np.ndarray) -> np.ndarray:
    """One round over all rows; each task sends one row of sums for a list that it has met."""
    n, dim = centroids.shape
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n, dim)), np.zeros(n, np.int64)
        for b in batches:
            _, m = _units(b.column(0), dim)
            if len(m):
                home = (m @ held.value.T).argmax(1)
                order = np.argsort(home, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(home[order]) > 0))
                total[home[order][heads]] += np.add.reduceat(m[order], heads)
                count += np.bincount(home, minlength=n)
        met = np.flatnonzero(count)
        yield from pa.table({"list": pa.array(met, pa.int32()), "x": pa.array(list(total[met]), pa.list_(pa.float64()))}).to_batches()

    sums = rows.select(F.col(vec_col).cast("array<double>")).mapInArrow(run, "list int, x array<double>")
    sums = sums.select("list", F.posexplode("x").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("x")).collect():
        v = np.array([p.x for p in r.x])
        if np.sqrt(v @ v) > EPS:
            out[r.list] = v / np.sqrt(v @ v)
    return out


def build(rows: DataFrame, path: str, *, id_col: str = "id", vec_col: str = "vector", key_cols: Sequence[str] = (), dim: int, n_lists: int = 64, rounds: int = ROUNDS, seed: int = 1) -> Index:
    """Write the index of ``rows`` at ``path``."""
    spark = rows.sparkSession
    centroids = _first_centroids(rows, vec_col, dim, n_lists, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _refined(rows, vec_col, centroids)
    held = spark.sparkContext.broadcast(centroids)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols)))
    schema = T.StructType([*rows.schema.fields, T.StructField("far", T.DoubleType()), T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = _units(b.column(1), dim)
            if len(at) and len(held.value):
                cos = m @ held.value.T
                home = cos.argmax(1)
                far = np.sqrt(((m - held.value[home]) ** 2).sum(1))
                kept = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(far), pa.array(home.astype(np.int32))], schema.names)

    dealt = rows.mapInArrow(run, schema)
    # a list's rows in few files, also where one list holds much of the table
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(n, "list", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("list").parquet(f"{path}/rows")
    stats = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("list").agg(F.count("far").alias("n"), F.max("far").alias("greatest"), F.avg("far").alias("mean"))
    book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    book.join(stats, "list").write.parquet(f"{path}/lists")
    return Index(path, id_col, tuple(key_cols), dim)


def _visits(asked: DataFrame, lists: list, k: int, radius: str | None, limits: bool) -> DataFrame:
    """Questions with the lists that they visit: the nearest centroids (``radius`` None), or all whose bound
    leaves room for a score that counts, but for those visited before."""
    centroids = np.array([r.centroid for r in lists]).reshape(len(lists), -1)
    number, size = np.array([r["list"] for r in lists]), np.array([r.n for r in lists])
    far = np.array([r[radius] for r in lists]) if radius else None
    held = asked.sparkSession.sparkContext.broadcast((centroids, number, size, far))
    schema = T.StructType([*(f for f in asked.schema.fields if f.name != "_least"), T.StructField("_qlist", T.IntegerType())])
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, number, size, far = held.value
        for b in batches:
            at, m = _units(b.column(names.index("_qvec")), centroids.shape[1])
            cos = m @ centroids.T
            order = np.argsort(-cos, axis=1, kind="stable")
            ahead = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros(cos.shape, bool)
            np.put_along_axis(first, order, ahead < ENOUGH * k, axis=1)
            go = first
            if limits:
                least = np.asarray(b.column(names.index("_least")).take(pa.array(at)).fill_null(-2.0))
                d = np.sqrt(((m * m).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * cos).clip(0))
                bound = (d - far).clip(0)
                go = (1 - bound * bound / 2 + EPS >= least[:, None]) & ~first
            row, col = np.nonzero(go)
            cols = [b.column(names.index(f.name)).take(pa.array(at[row])) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(number[col].astype(np.int32))], schema.names)

    return asked.mapInArrow(run, schema)


def search(index: Index, questions: DataFrame, k: int, *, exact: bool = False, q_id_col: str = "query_id", q_vec_col: str = "query_vector", q_key_cols: Sequence[str] = ()) -> DataFrame:
    """``q_id_col, rank, id, score`` of the k best rows of every question, under equality of the keys."""
    spark = questions.sparkSession
    if len(q_key_cols) != len(index.key_cols):
        raise ValueError("a question needs a value for every key of the index")
    lists = index.lists(spark).orderBy("list").collect()  # n_lists at most
    asked = questions.where(F.size(q_vec_col) == index.dim)
    for c in q_key_cols:
        asked = asked.where(F.col(c).isNotNull())
    asked = asked.select(F.col(q_id_col).alias("_qid"), F.col(q_vec_col).cast("array<double>").alias("_qvec"), *(F.col(c).alias(f"_qk{i}") for i, c in enumerate(q_key_cols)))
    if not lists:
        empty = asked.where("false").select("_qid", F.lit(0).alias("rank"), "_qid", F.lit(0.0).alias("score"))
        return empty.toDF(q_id_col, "rank", index.id_col, "score")
    asked = asked.checkpoint()
    rows = index.rows(spark)
    corpus = rows.select(F.col("id").alias("_cid"), F.col("vector").alias("_cvec"), F.col("list").alias("_clist"), *(F.col(f"k{i}").alias(f"_ck{i}") for i in range(len(q_key_cols))))
    keys = ["list", *(f"k{i}" for i in range(len(q_key_cols)))]

    def step(visits: DataFrame) -> DataFrame:
        visits = visits.checkpoint()
        wanted = [r[0] for r in visits.select("_qlist").distinct().collect()]  # folders that are read
        return scored_blocks(corpus.where(F.col("_clist").isin(wanted)), visits, k, keys)

    found = best_of(step(_visits(asked, lists, k, None, False)), k).drop("rank").checkpoint()
    least = found.groupBy("_qid").agg(F.when(F.count("score") >= k, F.min("score")).alias("_least")).withColumnRenamed("_qid", "_of")
    asked = asked.join(least, F.col("_qid") == F.col("_of"), "left").drop("_of")
    more = step(_visits(asked, lists, k, "greatest" if exact else "mean", True))
    out = best_of(found.unionByName(more), k)
    return out.select(F.col("_qid").alias(q_id_col), "rank", F.col("_cid").alias(index.id_col), "score")


def visited(index: Index, questions: DataFrame, k: int, exact: bool = False, **names) -> float:
    """Share of the index's rows that questions score on average, for tuning ``n_lists``."""
    spark = questions.sparkSession
    lists = index.lists(spark).orderBy("list").collect()
    q_id, q_vec = names.get("q_id_col", "query_id"), names.get("q_vec_col", "query_vector")
    found = search(index, questions, k, exact=exact, **names)
    least = found.groupBy(F.col(q_id).alias("_qid")).agg(F.when(F.count("score") >= k, F.min("score")).alias("_least"))
    asked = questions.select(F.col(q_id).alias("_qid"), F.col(q_vec).cast("array<double>").alias("_qvec")).join(least, "_qid", "left")
    both = _visits(asked.drop("_least"), lists, k, None, False).unionByName(_visits(asked, lists, k, "greatest" if exact else "mean", True))
    size = spark.createDataFrame([(r["list"], r.n) for r in lists], "_qlist int, n long")
    total = sum(r.n for r in lists)
    r = both.join(size, "_qlist").agg(F.sum("n"), F.countDistinct("_qid")).first()
    return (r[0] or 0) / max(1, total * (r[1] or 1))
