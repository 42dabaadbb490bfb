"""An inverted-file index over vectors: lists around seeded centroids, probed by angle bounds, so that no neighbour is lost."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.lineage import cut

#: Angles are widened by this, far above the rounding of a cosine.
SLACK = 1e-6
#: A task meets at most about so many vectors of a list with so many queries at once.
ROWS, QUERIES = 2048, 1024


def _unit(column: pd.Series, dims: int) -> np.ndarray:
    """Rows of length 1, filled up with zeros; zero vectors stay zero."""
    x = np.zeros((len(column), dims))
    for k, v in enumerate(column):
        x[k, : min(len(v), dims)] = v[:dims]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def spherical_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k directions that the rows of x gather around: Lloyd's rounds from seeded rows; an empty one keeps its place."""
    at = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(length > 0, sums / np.where(length > 0, length, 1), at)
    return at


@dataclass
class InvertedFile:
    """Every vector (id, vector) in the list of its nearest centroid, with its angle to it.

    Centroids are fitted on a sample of at most `sample` vectors, the first by a seeded hash; all vectors are indexed. There
    are about sqrt(rows) lists, `most_lists` at most; what the driver holds is a row per list.
    """

    dims: int
    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray = field(repr=False)
    size: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", vector_col: str = "vector", most_lists: int = 1024, sample: int = 20_000, rounds: int = 5, seed: int = 11) -> "InvertedFile":
        """Rows without a vector, or with null components, are in no list; vectors of other lengths are filled up with zeros."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
        dims, k = facts["dims"] or 1, max(1, min(most_lists, math.isqrt(facts["n"])))
        chosen = rows.select("vector", F.xxhash64(F.lit(seed), "id", "vector").alias("h")).orderBy("h").limit(sample).toPandas()  # `sample` rows
        centroids = spherical_means(_unit(chosen["vector"], dims), k, rounds, seed) if len(chosen) else np.zeros((1, dims))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _unit(batch["vector"], dims)
                near = (x @ centroids.T).argmax(axis=1)
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, centroids[near]), -1, 1))
                yield pd.DataFrame({"id": batch["id"], "vector": batch["vector"], "list": near, "angle": angle})

        kind = docs.schema[id_col].dataType.simpleString()
        lists = cut(rows.mapInPandas(place, f"id {kind}, vector array<double>, list int, angle double"))
        radius, size = np.full(len(centroids), -np.inf), np.zeros(len(centroids), np.int64)
        for r in lists.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row per list
            radius[r["list"]], size[r["list"]] = r["radius"], r["n"]
        return cls(dims, lists, centroids, radius, size)

    def pairs(self, queries: DataFrame, least_cosine: float, id_col: str = "query_id", vector_col: str = "vector") -> DataFrame:
        """query_id, doc_id, cosine of all pairs whose cosine is `least_cosine` (over 0) or more.

        If a query and a vector are at most `limit` apart, the query is at most `limit` and the list's radius from its
        centroid, and their angles to the centroid differ by at most `limit`: other lists are not probed and other rows
        of a list not multiplied. Lists and their queries meet in blocks of bounded size. Rows without a vector have no pair.
        """
        limit, dims, centroids, radius = math.acos(least_cosine) + SLACK, self.dims, self.centroids, self.radius
        blocks = -(-self.size // ROWS)

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in range(0, len(batch), QUERIES):
                    own = batch.iloc[part : part + QUERIES]
                    angle = _angles(_unit(own["vector"], dims), centroids)
                    row, at = np.nonzero(angle - radius[None, :] <= limit)
                    yield pd.DataFrame({"id": own["id"].to_numpy()[row], "vector": own["vector"].to_numpy()[row], "list": at, "angle": angle[row, at]})

        def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            near = np.abs(q["angle"].to_numpy()[:, None] - d["angle"].to_numpy()[None, :]) <= limit
            row, at = np.nonzero(near & (_unit(q["vector"], dims) @ _unit(d["vector"], dims).T >= least_cosine - SLACK)) if len(q) and len(d) else (np.zeros(0, int),) * 2
            return pd.DataFrame({"query_id": q["id"].to_numpy()[row], "doc_id": d["id"].to_numpy()[at]})

        kinds = queries.schema[id_col].dataType.simpleString(), self.lists.schema["id"].dataType.simpleString()
        asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
        probes = cut(asked.mapInPandas(probe, f"id {kinds[0]}, vector array<double>, list int, angle double"))
        parts = self.lists.sparkSession.createDataFrame([(k, int(b)) for k, b in enumerate(blocks)], "list int, blocks int")
        shares = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))
        # a row per list on either side
        q = probes.join(F.broadcast(parts), "list").join(F.broadcast(shares), "list").withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int"))
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        d = self.lists.join(F.broadcast(parts), "list").join(F.broadcast(shares), "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        d = d.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        keys, columns = ["list", "block", "share"], ["list", "block", "share", "id", "vector", "angle"]
        return q.select(*columns).groupBy(*keys).cogroup(d.select(*columns).groupBy(*keys)).applyInPandas(meet, f"query_id {kinds[0]}, doc_id {kinds[1]}")
