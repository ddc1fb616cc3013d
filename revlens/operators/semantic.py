"""Text vectors fitted on the corpus (E2): latent semantic analysis by a distributed randomized SVD.

Words that occur in the same texts get similar vectors, so a question finds a text that says the same in other
words, which the lexical embedder cannot.  :func:`fit` returns an :class:`LsaModel`, whose :meth:`LsaModel.embed`
is an ``embedder`` of ``build_index`` and ``AnswerConfig``.

* A word's feature is its hash modulo ``features``; a text's row holds ``(1 + log count) * idf``, normalised.
* The subspace of the greatest singular values comes from power rounds: every task multiplies its rows with the
  basis and adds up ``rows^T (rows basis)``, some rows at a time as dense products over the features they hold.
  The sums of all tasks are added as a tree, by ranges of features: no group gets more than ``FAN_IN`` pieces.
* The texts are split once, into features in the scratch folder, which every round reads.

The basis (``features`` x ``dim + OVERSAMPLE`` numbers of four bytes, 26 MB by default) is the model: it does not
grow with the corpus, is sent to the executors and orthonormalised on the driver between rounds.

Texts without words, and NULL, have no vector (NULL).  Directions that the corpus does not fill (fewer texts than
``dim``) are zero, so a vector always has ``dim`` numbers.  A text none of whose words the corpus weighs (unknown, or
in every text) has no vector either.  Very long texts are one sparse row; an empty table gives a model without
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.text import words
from revlens.operators.embed import DEFAULT_DIM
from revlens.operators.joins import spread
from revlens.session import scratch_path

FEATURES = 1 << 14
OVERSAMPLE = 16
ROUNDS = 2
#: Pieces that one group of the tree adds.
FAN_IN = 32
#: Features in a range of the sums.
RANGE = 1 << 10
#: Rows that are multiplied at a time.
ROWS = 256


def _features(text_col: str, features: int):
    return F.transform(words(text_col), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def _weighted(lists: pa.Array, idf: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows at a time: the rows' places, the features they hold, and the normalised weights as a dense matrix."""
    size = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
    values = np.asarray(lists.flatten(), np.int64)
    ends = np.cumsum(size)
    for first in range(0, len(size), ROWS):
        last = min(first + ROWS, len(size))
        part = values[ends[first] - size[first]:ends[last - 1]]
        row = np.repeat(np.arange(last - first), size[first:last])
        held, column = np.unique(part, return_inverse=True)
        dense = np.bincount(row * len(held) + column, minlength=(last - first) * len(held)).reshape(last - first, -1).astype(np.float32)
        np.log1p(dense, out=dense, where=dense > 1)  # one occurrence stays 1, more grow slowly
        dense *= idf[held]
        norm = np.sqrt((dense * dense).sum(1, keepdims=True))
        yield slice(first, last), held, np.divide(dense, norm, out=dense, where=norm > 0)


def _add_up(pieces: DataFrame, n: int) -> DataFrame:
    """Sums of the pieces ``(part, range, data)`` of ``n`` tasks by range, added as a tree."""
    schema = "part int, range int, data binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py(), np.float32) for x in table["data"]), np.float32(0))
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "range": table["range"][:1].cast(pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    while n > 1:
        n = -(-n // FAN_IN)
        pieces = pieces.select(F.pmod("part", F.lit(n)).cast("int").alias("part"), "range", "data").groupBy("part", "range").applyInArrow(add, schema)
    return pieces


def _gram(lists: DataFrame, idf: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """``rows^T rows basis`` over all rows of the corpus."""
    spark = lists.sparkSession
    sent = spark.sparkContext.broadcast((idf, basis.astype(np.float32)))
    features, width = basis.shape

    def run(batches):
        from pyspark import TaskContext

        weights, base = sent.value
        total = np.zeros((features, width), np.float32)
        for b in batches:
            for _, held, dense in _weighted(b.column(0), weights):
                total[held] += dense.T @ (dense @ base[held])
        part = TaskContext.get().partitionId()
        for k in range(0, features, RANGE):
            if total[k:k + RANGE].any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k // RANGE], pa.int32()), pa.array([total[k:k + RANGE].tobytes()], pa.binary())], ["part", "range", "data"])

    pieces = lists.mapInArrow(run, "part int, range int, data binary")
    out = np.zeros((features, width))
    for r in _add_up(pieces, n).select("range", "data").collect():
        out[r.range * RANGE:(r.range + 1) * RANGE] = np.frombuffer(r.data, np.float32).reshape(-1, width)
    sent.unpersist()
    return out


@dataclass
class LsaModel:
    """``idf`` and ``basis`` (one row a feature) of a fitted corpus."""

    idf: np.ndarray
    basis: np.ndarray

    @property
    def dim(self) -> int:
        return self.basis.shape[1]

    def embed(self, df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
        """``df`` with the vector of ``text_col`` (unit length) as ``out_col``, which replaces a column of that name."""
        spark = df.sparkSession
        sent = spark.sparkContext.broadcast((self.idf, self.basis))
        dim, features = self.dim, len(self.idf)
        df = spread(df)
        lists = "_features"
        while lists in df.columns:
            lists += "_"
        rest = [f for f in df.schema.fields if f.name != out_col]
        schema = T.StructType([*rest, T.StructField(out_col, T.ArrayType(T.FloatType()))])
        at = [df.columns.index(f.name) for f in rest]

        def run(batches):
            weights, basis = sent.value
            for b in batches:
                vectors = np.zeros((b.num_rows, dim), np.float32)
                for rows, held, dense in _weighted(b.column(b.num_columns - 1), weights):
                    vectors[rows] = dense @ basis[held]
                norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
                known = norm > 1e-9
                vectors[known] /= norm[known, None]
                ends = np.concatenate([[0], np.cumsum(np.where(known, dim, 0))]).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors[known].ravel()), mask=pa.array(~known))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), array], [*(f.name for f in rest), out_col])

        return df.withColumn(lists, _features(text_col, features)).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as a table, a row a feature (a shared folder)."""
        rows = [(i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(self.idf, self.basis))]
        spark.createDataFrame(rows, "feature int, idf float, vector array<float>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LsaModel:
        t = spark.read.parquet(path).orderBy("feature").toArrow()
        return cls(np.asarray(t["idf"], np.float32), np.stack([np.asarray(v.values, np.float32) for v in t["vector"]]))


def fit(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM, features: int = FEATURES, rounds: int = ROUNDS, seed: int = 7) -> LsaModel:
    """The model of all texts of ``df``, which is read once: the rounds read the features of its words."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "lsa-features")
    spread(df.select(text_col)).select(_features(text_col, features).alias("_features")).write.parquet(path)
    lists = spread(spark.read.schema("_features array<int>").parquet(path))
    n = lists.rdd.getNumPartitions()
    count = lists.agg(F.count_if(F.size("_features") > 0)).first()[0]
    seen = np.zeros(features)
    for r in lists.select(F.explode(F.array_distinct("_features")).alias("f")).groupBy("f").count().collect():  # one row a feature
        seen[r["f"]] = r["count"]
    idf = np.where(seen > 0, np.log((1 + count) / np.maximum(seen, 1)), 0).astype(np.float32)
    width = min(dim + OVERSAMPLE, features)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)) * (idf > 0)[:, None])[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_gram(lists, idf, basis, n))[0]
    values, turn = np.linalg.eigh(basis.T @ _gram(lists, idf, basis, n))
    order = np.argsort(-values)[:dim]
    basis = basis @ turn[:, order]
    basis[:, values[order] <= max(values.max(), 0) * 1e-5] = 0  # directions the corpus does not fill
    out = np.zeros((features, dim), np.float32)
    out[:, :basis.shape[1]] = basis
    return LsaModel(idf, out)
