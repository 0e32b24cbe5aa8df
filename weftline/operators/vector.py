"""Cosine search over float arrays, in double precision: native for one query, by products of blocks for many."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..ship import ship_package

#: Vectors of a block, at most and on average, as keys are dealt by hash, and their bytes in double precision.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Pairs that are looked at together.
TILE = 1 << 20
#: Digits of a score of `similar`.
DIGITS = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_norm(vectors: DataFrame, embedding: str) -> DataFrame:
    """Vectors of norm zero and null ones go."""
    return vectors.withColumn("_norm", norm(F.col(embedding))).where("_norm > 0")


def topk(vectors: DataFrame, query: list[float], k: int, threshold: float = -1.0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, score of the k nearest to one query; the query is a literal, so no join."""
    size = sum(x * x for x in query) ** 0.5
    scored = with_norm(vectors, embedding).select(key, (dot(F.col(embedding), F.lit([float(x) for x in query])) / (F.col("_norm") * size)).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.col("score").desc(), key).limit(k)


def similar(vectors: DataFrame, queries: DataFrame, k: int, threshold: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query, vec, score, rank: each query's k nearest of at least threshold, itself excluded. A block of vectors
    meets a block of queries in a task, whose product names the few pairs that are scored in full; vectors of
    other lengths have no score. A block's k nearest of a query are cut before they are ranked."""
    ship_package(vectors.sparkSession)
    q = with_norm(queries, embedding).where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(embedding).alias("_v"), F.size(embedding).alias("_n"), "_norm")
    v = with_norm(vectors, embedding).where(F.col(key).isNotNull()).select(F.col(key).alias("vec"), F.col(embedding).alias("_v"), F.size(embedding).alias("_n"), "_norm")
    sizes = [x.agg(F.count("*").alias("rows"), F.max(F.size(embedding)).alias("n")).first() for x in (queries, vectors)]
    size = max(1, min(BLOCK, BLOCK_BYTES // max(1, *(8 * (x["n"] or 0) for x in sizes))))
    asked, given = (max(1, -(-x["rows"] // size)) for x in sizes)

    def spread(df: DataFrame, own: str, other: str, blocks: int, others: int) -> DataFrame:
        """Each row in its block, once for each block of the other side."""
        dealt = df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(blocks)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("_n", "_asked", "_given")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, k, threshold)

    cells = spread(q, "_asked", "_given", asked, given).cogroup(spread(v, "_given", "_asked", given, asked))
    schema = StructType([q.schema["query"], v.schema["vec"], StructField("score", DoubleType())])
    scored = cells.applyInArrow(run, schema).withColumn("score", F.round("score", DIGITS)).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, norms, vectors of length one, and whether a row is beyond what single precision can tell."""
    values = rows["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    all_, norms = values.astype(np.float64).reshape(rows.num_rows, -1), rows["_norm"].to_numpy()
    with np.errstate(all="ignore"):
        unit = all_ / norms[:, None]
        odd = ~((norms > 1e-150) & (norms < 1e150) & np.isfinite(unit).all(axis=1))
    unit[odd] = 0
    return all_, norms, unit.astype(np.float32), odd


def _rounded(score: np.ndarray) -> np.ndarray:
    """As Spark's round: half up in decimal notation, which matters next to a half only."""
    scaled = score * 10**DIGITS + 0.5
    out = np.floor(scaled) / 10**DIGITS
    near = np.flatnonzero(np.abs(scaled - np.rint(scaled)) < 1e-6)
    values, where = np.unique(score[near], return_inverse=True)
    exact = [float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) for x in values.tolist()]
    out[near] = np.array(exact, np.float64)[where]
    return out


def _nearest(asked: pa.Table, given: pa.Table, k: int, threshold: float) -> pa.Table:
    """query, vec, score of the k nearest in a block. A product in single precision finds all that can be among
    them by their rounded score; these are scored in double precision, part by part as `dot` does."""
    keys = pa.concat_arrays([*asked["query"].chunks, *given["vec"].chunks])
    code = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)
    mine, theirs = code[: asked.num_rows], code[asked.num_rows :]
    found_q, found_v, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if asked.num_rows and given.num_rows:
        q, q_norm, q_unit, q_odd = _matrix(asked)
        v, v_norm, v_unit, v_odd = _matrix(given)
        step = max(1, TILE // len(v))
        for at in range(0, len(q), step):
            rows = slice(at, at + step)
            near = q_unit[rows] @ v_unit.T
            near[q_odd[rows]] = near[:, v_odd] = -np.inf
            same = np.nonzero(np.isin(mine[rows], theirs))[0]
            for i in same:
                near[i, theirs == mine[at + i]] = -np.inf
            least = np.full(len(near), threshold, np.float64)
            if near.shape[1] > k:
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
            near[q_odd[rows]] = near[:, v_odd] = np.inf
            for i in same:
                near[i, theirs == mine[at + i]] = -np.inf
            # What is a unit of the last digit below the k-th is behind it when rounded; slack is above the error of near.
            slack = (q.shape[1] + 8) * 2.0**-22
            i, j = np.nonzero((near >= (least - 10.0**-DIGITS - slack)[:, None]) & (near > -np.inf))
            i += at
            with np.errstate(all="ignore"):
                score = np.zeros(len(i))
                for part in range(q.shape[1]):
                    score += v[j, part] * q[i, part]
                score /= v_norm[j] * q_norm[i]
                rounded = _rounded(score)
            rounded[np.isnan(score)] = np.inf  # the largest double in Spark's order
            kept = rounded >= threshold
            i, j, score, rounded = i[kept], j[kept], score[kept], rounded[kept]
            order = np.lexsort((theirs[j], -rounded, i))
            i, j, score = i[order], j[order], score[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            found_q.append(i[nth < k])
            found_v.append(j[nth < k])
            found.append(score[nth < k])
    take = lambda table, name, at: table[name].combine_chunks().take(pa.array(np.concatenate(at)))
    return pa.table({"query": take(asked, "query", found_q), "vec": take(given, "vec", found_v), "score": np.concatenate(found)})


def missing(entities: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Entities without a vector."""
    return entities.join(vectors.select(key), key, "left_anti")
