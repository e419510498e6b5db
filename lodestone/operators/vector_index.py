"""A vector index kept in Parquet tables: cells around centres with their radii, and exact top-k that skips cells.

Vectors are kept at unit length, so the likeness (cosine) of two is 1 - d^2 / 2 of their distance d. A cell holds the
vectors nearest to its centre and knows its radius, the largest distance of these. By the triangle inequality a vector of
a cell is no nearer to a question than the centre's distance less the radius; cells that cannot hold one of the k best
are not read. A cell is a folder, so skipping one skips its files.

Tables are kept by turns, like the full-text index: add() writes new and changed vectors and ids to forget, and what an
id had before is out of date. A turn that is written again replaces itself.

Defined results: null vectors and those of another length than the index's are left out; a vector of zeros stays zeros
and has likeness 0 to all; an id that repeats in a turn is an error of the caller; equal scores go by id; a question of
another length is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.vectors import doubles, normalized
from lodestone.sources.scratch import Scratch

#: Cells at most, and vectors a cell should hold at least. Centres are literals of the plan.
CELLS, CELL = 256, 64
#: Nearest cells that are scored first, to learn what the k-th best score is at least.
FIRST_CELLS = 2
#: Likenesses that a task works out at once.
PAIRS = 1 << 20
TABLES = {
    "centres": "cell int, centre array<double>",
    "cells": "cell int, radius double, n long",
    "ids": "id long, gone boolean",
    "stale": "id long, of_turn int",
    "vectors": "id long, v array<double>, cell int",
}


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    dims: int
    id_type: str = "long"

    def schema(self, table: str) -> str:
        return TABLES[table].replace("id long", f"id {self.id_type}")

    def read(self, table: str) -> DataFrame:
        """A table over all turns; empty where none was written."""
        schema = self.schema(table) + ", turn int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, table: str, turn: int, *by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{table}/turn={turn}")

    def centres(self) -> np.ndarray:
        """CELLS rows at most."""
        rows = self.read("centres").where("turn = 0").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows], float).reshape(len(rows), self.dims)

    def usable(self, vectors: DataFrame, vector: str, id_: str) -> DataFrame:
        fits = (F.size(vector) == self.dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
        return vectors.where(fits).select(F.col(id_).cast(self.id_type).alias("id"), normalized(doubles(F.col(vector))).alias("v"))

    def build(self, vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id", cells: int | None = None) -> None:
        """Turn 0. The centres are the vectors whose ids have the smallest hashes."""
        rows = self.usable(vectors, vector, id_)
        cells = cells or min(CELLS, max(1, rows.count() // CELL))
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(cells)
        self._write(picked.select((F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")) - 1).alias("cell"), F.col("v").alias("centre")), "centres", 0)
        self.add(vectors, 0, vector=vector, id_=id_)

    def add(self, vectors: DataFrame, turn: int, gone: DataFrame | None = None, vector: str = "embedding", id_: str = "vec_id") -> None:
        """Writes a turn: new and changed vectors, and ids (id) to forget. Its cells' radii are written last and make it known."""
        rows, centres, dims = self.usable(vectors, vector, id_), self.centres(), self.dims

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dims)
                far = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
                cell = far.argmin(1) if len(centres) else np.zeros(len(x), int)
                away = np.sqrt(((x - centres[cell]) ** 2).sum(1)) if len(centres) else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["id", "v", "cell", "away"])

        placed = rows.mapInArrow(nearest, f"id {self.id_type}, v array<double>, cell int, away double")
        self._write(placed.hint("rebalance", "cell"), "vectors", turn, "cell")
        written = self.spark.read.schema(self.schema("vectors") + ", away double").parquet(f"{self.folder}/vectors/turn={turn}")
        ids = written.select("id", F.lit(False).alias("gone"))
        if gone is not None:
            ids = ids.unionByName(gone.select(F.col("id").cast(self.id_type).alias("id")).distinct().join(ids.select("id"), "id", "left_anti").withColumn("gone", F.lit(True)))
        self._write(ids, "ids", turn)
        told = self.read("ids")
        last = told.where(F.col("turn") < turn).join(told.where(F.col("turn") == turn).select("id"), "id", "left_semi").groupBy("id").agg(F.max("turn").alias("of_turn"), F.max_by("gone", "turn").alias("was_gone"))
        self._write(last.where("NOT was_gone").select("id", "of_turn"), "stale", turn)
        self._write(written.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")), "cells", turn)

    def live(self) -> DataFrame:
        """(id, v) of what is up to date."""
        rows = self.read("vectors").join(F.broadcast(self.read("cells").select("turn", "cell")), ["turn", "cell"], "left_semi")
        return rows.join(self._stale(), ["id", "turn"], "left_anti").select("id", "v")

    def _stale(self) -> DataFrame:
        return self.read("stale").select("id", F.col("of_turn").alias("turn"))

    def search(self, questions: DataFrame, k: int = 10, vector: str = "embedding", id_: str = "query_id") -> DataFrame:
        """questions (query_id, embedding) -> (query_id, id, score, rank). The result is that of comparing every vector."""
        return self.searched(questions, k, vector, id_)[0]

    def searched(self, questions: DataFrame, k: int = 10, vector: str = "embedding", id_: str = "query_id") -> tuple[DataFrame, DataFrame, DataFrame]:
        """search(), the likeness that each cell can reach for each question, and the cells that were read."""
        scratch, centres, dims = Scratch(self.spark, "vector-index"), self.centres(), self.dims
        fits = F.when(F.size(vector) == dims, doubles(F.col(vector))).otherwise(F.raise_error(F.lit("a question has another length than the index")).cast("array<double>"))
        asked = scratch.write(questions.where(F.col(vector).isNotNull()).select(F.col(id_).alias("query_id"), normalized(fits).alias("q")), "asked")

        def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dims)
                for at in range(0, len(x), 1024):
                    far = np.sqrt(((x[at : at + 1024, None] - centres[None]) ** 2).sum(2))
                    n = len(far)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).take(np.repeat(np.arange(n), len(centres))), pa.array(np.tile(np.arange(len(centres)), n), pa.int32()), pa.array(far.reshape(-1))], names=["query_id", "cell", "far"])

        kind = dict(asked.dtypes)["query_id"]
        near = asked.mapInArrow(distances, f"query_id {kind}, cell int, far double").join(F.broadcast(self.read("cells")), "cell")  # CELLS rows a turn
        least = F.greatest(F.lit(0.0), F.col("far") - F.col("radius"))
        # A vector of zeros has likeness 0 and lies at distance 1 of every question, where 1 - d^2 / 2 is larger.
        bounds = scratch.write(near.select("query_id", "turn", "cell", (1 - least * least / 2).alias("bound")), "bounds")

        def in_cell(wanted: pa.Table, rows: pa.Table) -> pa.Table:
            """Of each question of a cell the k best vectors and what rounding may rank with them. A question and a vector come once each, not once a pair."""
            q, v = (_matrix(t.column(i).combine_chunks(), dims) for t, i in ((wanted, 3), (rows, 3)))
            found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            step = max(1, PAIRS // max(1, len(v)))
            for at in range(0, len(q) if len(v) else 0, step):
                s = q[at : at + step] @ v.T
                least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k, None] - 2e-9 if len(v) > k else -np.inf
                i, j = np.nonzero(~(s < least))
                found.append((i + at, j, s[i, j]))
            i, j, s = (np.concatenate(x) for x in zip(*found))
            columns = [wanted.column("query_id").take(pa.array(i)), rows.column("turn").take(pa.array(j)), rows.column("id").take(pa.array(j)), pa.array(s)]
            return pa.Table.from_arrays(columns, names=["query_id", "turn", "id", "score"])

        def scores(cells: DataFrame) -> DataFrame:
            """At least the k best of each question and cell."""
            listed = [r["cell"] for r in cells.select("cell").distinct().collect()]  # CELLS at most
            rows = self.read("vectors").where(F.col("cell").isin(listed)).join(self._stale(), ["id", "turn"], "left_anti").select("turn", "cell", "id", "v")
            wanted = cells.join(asked, "query_id").select("turn", "cell", "query_id", "q")
            pairs = wanted.groupBy("turn", "cell").cogroup(rows.groupBy("turn", "cell"))
            return pairs.applyInArrow(in_cell, f"query_id {kind}, turn int, id {self.id_type}, score double").withColumn("score", F.round("score", 9))

        best = lambda rows, by, top: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= top)
        tried = best(bounds, [F.desc("bound"), "turn", "cell"], FIRST_CELLS).select("query_id", "turn", "cell")
        floors = best(scores(tried), [F.desc("score"), "id"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        kept = bounds.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-8 >= F.col("floor"))).select("query_id", "turn", "cell")
        kept = scratch.write(kept, "kept")
        return best(scores(kept), [F.desc("score"), "id"], k).select("query_id", "id", "score", "rank"), bounds, kept
