"""PCA whitening of vectors with MLlib's block matrices.

Vectors become exact integers, and each distinct one counts once in the fit. The
centred rows, indexed without gaps, become distributed blocks; the transpose
times the blocks is the scatter matrix, of which the driver holds only dimension
by dimension numbers; its eigenvectors give the whitening matrix, and the blocks
times it are the whitened rows. MLlib's product gathers the places of all blocks
on the driver, so large tables are multiplied slab by slab, a bounded number of
blocks each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.session import stage_table

#: Bytes of a block of centred rows.
BLOCK_BYTES = 4 << 20
#: Blocks in a slab; bounds what the driver learns about blocks at once.
SLAB_BLOCKS = 16384
#: Blocks that meet in one task of the scatter product.
_BLOCKS_PER_TASK = 4
_COLUMNS = 1024
_PART_BITS = 33  # of Spark's increasing ids: the row inside its partition


@dataclass
class Indexed:
    """A written table whose rows have an `_id`, and the row counts of its partitions by number."""

    table: DataFrame
    counts: dict[int, int]

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    def slabs(self, most: int) -> list[DataFrame]:
        """The rows as slabs of about `most` rows, each with an `index` from 0 without gaps.

        A slab is a run of whole partitions of the writer, picked by the range of
        ids, so the scan skips the files of other slabs.
        """
        runs: list[list[int]] = []
        size = most
        for part in sorted(self.counts):
            if size + self.counts[part] > most:
                runs.append([])
                size = 0
            runs[-1].append(part)
            size += self.counts[part]
        spark, out = self.table.sparkSession, []
        for run in runs:
            before, starts = 0, []
            for part in run:
                starts.append((part, before))
                before += self.counts[part]
            starts_frame = F.broadcast(spark.createDataFrame(starts, "_part bigint, _before bigint"))  # one row a partition
            mask = (1 << _PART_BITS) - 1
            rows = self.table.filter(F.col("_id").between(run[0] << _PART_BITS, (run[-1] << _PART_BITS) + mask))
            rows = rows.withColumn("_part", F.shiftright("_id", _PART_BITS)).join(starts_frame, "_part")
            out.append(rows.withColumn("index", F.col("_before") + F.col("_id").bitwiseAND(mask)).drop("_part", "_before", "_id"))
        return out


def indexed(df: DataFrame) -> Indexed:
    table = stage_table(df.withColumn("_id", F.monotonically_increasing_id()))
    counts = table.groupBy(F.shiftright("_id", _PART_BITS).alias("part")).count().collect()  # one row a partition
    return Indexed(table, {r["part"]: r["count"] for r in counts})


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


@dataclass
class Fit:
    """What a fit list of n distinct integer rows gives: sums, eigenvalues falling, unit components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _centred(x: Column, n: int, sums: list[int]) -> Column:
    """(n * x - S), exact."""
    totals = F.lit(np.array(sums, np.int64))
    return F.transform(x, lambda v, i: v * F.lit(n) - F.get(totals, i))


def _rows_in_block(width: int, block_bytes: int) -> int:
    return max(1, block_bytes // (8 * width))


def _blocks(slab: DataFrame, n: int, sums: list[int], rows_in_block: int) -> BlockMatrix:
    """The slab's centred rows, (x - S/n), as blocks; n is the fit's."""
    centred = F.transform(_centred(F.col("x"), n, sums), lambda v: v / F.lit(float(n)))
    rows = slab.select("index", array_to_vector(centred).alias("vector"))
    rows = MLUtils.convertVectorColumnsFromML(rows, "vector")
    return IndexedRowMatrix(rows, 0, len(sums)).toBlockMatrix(rows_in_block, _COLUMNS)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times blocks, in tasks of a few blocks each."""
    splits = max(1, blocks.numRowBlocks // _BLOCKS_PER_TASK)
    turned = blocks.transpose()
    java = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _times(blocks: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    """Blocks times a small matrix."""
    spark_context = blocks._java_matrix_wrapper._sc
    width, k = matrix.shape
    parts = [((i // _COLUMNS, 0), DenseMatrix(len(p), k, p.ravel(order="F").tolist())) for i in range(0, width, _COLUMNS) for p in [matrix[i : i + _COLUMNS]]]
    return blocks.multiply(BlockMatrix(spark_context.parallelize(parts, 1), _COLUMNS, k, width, k))


def fit(rows: Indexed, sums: list[int], components: int, block_bytes: int = BLOCK_BYTES, slab_blocks: int = SLAB_BLOCKS) -> Fit:
    """The largest principal components of distinct integer rows `x`; those without variance are left out."""
    n, width = rows.n, len(sums)
    size = _rows_in_block(width, block_bytes)
    scatter = sum(_scatter(_blocks(slab, n, sums, size)) for slab in rows.slabs(size * slab_blocks))
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2.0 * n))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    some = int(np.sum(values > max(values[0], 0.0) * width * 1e-14)) if values[0] > 0 else 0
    k = min(components, some)
    return Fit(n, sums, values[:k], vectors[:, :k], float(np.trace(scatter) / n))


def identity_error(rows: Indexed, found: Fit, block_bytes: int = BLOCK_BYTES, slab_blocks: int = SLAB_BLOCKS) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from the projected rows."""
    size = _rows_in_block(len(found.sums), block_bytes)
    covariance = sum(_scatter(_times(_blocks(slab, found.n, found.sums, size), found.matrix())) for slab in rows.slabs(size * slab_blocks))
    return float(np.abs(covariance / found.n - np.eye(len(found.values))).max())


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = 16,
    block_bytes: int = BLOCK_BYTES, slab_blocks: int = SLAB_BLOCKS,
) -> DataFrame:
    """(key, component INT from 1, n, deviation BIGINT, whitened, explained, identity_error DOUBLE).

    Entries c become x = floor(scale * c) + offset; x, its sums and deviations
    must fit in BIGINT. A row per usable vector and component. Vectors that are
    null, empty or hold null or non-finite entries take no part, nor do vectors of
    another length than the commonest (the longer of equally common ones).
    Components without variance are none: equal vectors only, or one row, give an
    empty result, as does an empty table. Repeated rows and keys are whitened as
    often as they come but fitted once; null keys stay; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    v = F.col(f"`{vector}`")
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(offset).cast("bigint"))
    rows = indexed(vectors.filter(usable(v)).select(F.col(f"`{key}`").alias("_key"), x.alias("x")))
    nothing = spark.createDataFrame(
        [], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    length = rows.table.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return nothing
    alike = rows.table.filter(F.size("x") == length.n)
    if alike.count() < rows.n:
        rows = indexed(alike.drop("_id"))
    distinct = indexed(rows.table.select("x").distinct())
    sums = distinct.table.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()  # one row a dimension
    found = fit(distinct, [r.s for r in sums], components, block_bytes, slab_blocks)
    if not len(found.values):
        return nothing
    error = identity_error(distinct, found, block_bytes, slab_blocks)
    size = _rows_in_block(length.n, block_bytes)
    explained = F.lit((found.values / found.trace).astype(np.float64))
    squares = F.aggregate(_centred(F.col("x"), found.n, found.sums), F.lit(0).cast("bigint"), lambda a, y: a + y * y)
    out = None
    for slab in rows.slabs(size * slab_blocks):
        projected = _times(_blocks(slab, found.n, found.sums, size), found.matrix()).toIndexedRowMatrix()
        values = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
        values = values.select("index", F.posexplode(vector_to_array("vector")).alias("i", "whitened"))
        part = slab.select("index", F.col("_key").alias(key), squares.alias("deviation")).join(values, "index").select(
            key, (F.col("i") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"),
        )
        out = part if out is None else out.unionByName(part)
    return out
