"""Exact nearest vectors of a stated set of queries.

Queries reach tasks in blocks of bounded bytes and number; a batch of vectors meets a block in one matrix product, and a task keeps
the best rows of each query. What is left is scored again by built-in functions, so that results don't depend on how
products of matrices are summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .patterns import CELLS, MOST_WAITING, best, leading, spread
from .tables import all_of

BLOCK_BYTES, BLOCK_QUERIES = 16 << 20, 2_000
#: Rows that a task hands on beyond the k best, in case sums that differ in their last bits order them otherwise.
SPARE = 16


def _dense(own: pa.Array, dim: int | None) -> np.ndarray:
    """Rows of numbers, or of (slot, weight) of which all others are 0."""
    if dim is None:
        return own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
    out, flat = np.zeros((len(own), dim)), own.flatten()
    row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
    out[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
    return out


def _blocks(queries: DataFrame, size: int, dim: int | None) -> Iterator[tuple[list, np.ndarray]]:
    ids, held = [], []
    for row in queries.toLocalIterator():
        ids.append(row["question_id"])
        if dim is None:
            held.append(np.asarray(row["embedding"], np.float64))
        else:
            held.append(np.zeros(dim))
            held[-1][[x[0] for x in row["embedding"]]] = [x[1] for x in row["embedding"]]
        if len(held) * held[0].nbytes >= size or len(held) >= BLOCK_QUERIES:
            yield ids, np.vstack(held)
            ids, held = [], []
    if held:
        yield ids, np.vstack(held)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, keys: tuple[str, ...] = ("vec_id",), block_bytes: int = BLOCK_BYTES, digits: int | None = None, dim: int | None = None) -> DataFrame:
    """question_id, keys, score and rank of the k vectors of the largest cosine, equal ones by their keys.

    queries: question_id and embedding; vectors: keys and embedding, of one length, or with dim arrays of (slot, weight).
    A vector of zeros scores 0. With digits, scores are those of the matrix product, rounded before they are ranked."""
    queries, vectors = queries.select("question_id", "embedding").where("embedding is not null"), spread(vectors.select(*keys, "embedding").where("embedding is not null"))
    spare = 0 if digits is not None else SPARE
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"question_id {queries.schema['question_id'].dataType.simpleString()}, {', '.join(f'{c} {kinds[c]}' for c in keys)}, score double"
    id_type = to_arrow_type(queries.schema["question_id"].dataType)
    order = [("score", "descending"), *((c, "ascending") for c in keys)]

    def passed(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = block.value
            asked, held, least = _unit(asked), None, np.full(len(ids), -np.inf)
            step = max(1, CELLS // len(ids))
            waiting, many = [], 0
            for whole in batches:
                for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                    own = batch.column("embedding")
                    scores = np.round(_unit(_dense(own, dim)) @ asked.T, 12 if digits is None else digits)
                    row, q = leading(scores, least, k + spare)
                    at = pa.array(row)
                    waiting.append(pa.table({"q": q, "score": scores[row, q], **{c: batch.column(c).take(at) for c in keys}}))
                    many += len(row)
                    if held is None or many >= MOST_WAITING:
                        held, full, last = best(pa.concat_tables([*([held] if held is not None else []), *waiting]), k + spare, order)
                        least[full] = last
                        waiting, many = [], 0
            if waiting:
                held, _, _ = best(pa.concat_tables([held, *waiting]), k + spare, order)
            if held is not None and held.num_rows:
                out = pa.table({"question_id": pa.array([ids[x] for x in held["q"].to_pylist()], id_type), **{c: held[c] for c in (*keys, "score")}})
                yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        return run

    context = vectors.sparkSession.sparkContext
    parts = [vectors.mapInArrow(passed(context.broadcast(b)), schema) for b in _blocks(queries, block_bytes, dim)]
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], schema)
    for more in parts[1:]:
        found = found.unionByName(more)
    if digits is None:
        # the vectors themselves are fetched once for the few that are left
        near = Window.partitionBy("question_id").orderBy(F.desc("score"), *keys)
        few = found.withColumn("k_", F.row_number().over(near)).where(F.col("k_") <= k + spare).select("question_id", *keys).distinct()
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        same = all_of([F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys])
        both = few.withColumnsRenamed({c: f"{c}_" for c in keys}).join(vectors, same).join(queries.withColumnRenamed("embedding", "q"), "question_id")
        norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("q"), F.col("q")))
        found = both.select("question_id", *keys, F.when(norm > 0, dot(F.col("embedding"), F.col("q")) / norm).otherwise(0.0).alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *keys))).where(F.col("rank") <= k)
