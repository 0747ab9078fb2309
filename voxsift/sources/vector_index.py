"""An inverted file of vectors: rows stored under the centre nearest to them, searches read the folders of few centres."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxsift.functions.vectors import DECIMALS, batch_matrix, best_match, unit
from voxsift.operators.ranking import top_k
from voxsift.operators.vector_search import unit_vectors
from voxsift.sources import versions

#: Centres of an index; they are sent to every task.
MOST_CENTRES = 16_384
#: Rows that centres are fitted on, about; all rows are indexed.
SAMPLE_ROWS = 200_000
#: Rows of a folder and queries compared with it at once.
SLICE_ROWS, BLOCK_QUERIES = 20_000, 1_000
#: Folder of rows whose vector has no direction; they are never found.
NOWHERE = -1


def fit_centres(rows: DataFrame, centres: int, key: str = "review_id", vector: str = "vector", most: int = SAMPLE_ROWS, seed: int = 1) -> DataFrame:
    """``centre, vector``: k-means by the cosine, on about ``most`` rows chosen by a hash of the key (all, where there are
    fewer). Fitted once; the index keeps them."""
    share = F.lit(min(1.0, most / max(1, rows.count())))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = unit_vectors(rows.where(place < share), vector).select(array_to_vector("_unit").alias("features"))
    model = KMeans(k=centres, seed=seed, distanceMeasure="cosine").fit(sample)
    found = [(n, [float(x) for x in c]) for n, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(found, "centre int, vector array<double>")


class VectorIndex:
    """A written index: ``rows/centre=/slice=`` and ``centres``."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str):
        self.spark, self.path, self.key, self.vector = spark, path, key, vector

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @cached_property
    def centres(self) -> list[tuple[int, list[float]]]:
        """In the order of their numbers; MOST_CENTRES at most."""
        return sorted((r["centre"], r["vector"]) for r in self.spark.read.parquet(f"{self.path}/centres").collect())

    def nearest_centres(self, vector: Column, probes: int) -> Column:
        """The ``probes`` centres nearest to a vector, nearest first; equally near ones by their number."""
        numbers, matrix = np.array([n for n, _ in self.centres]), np.stack([unit(v) for _, v in self.centres])

        @F.arrow_udf("array<int>")
        def nearest(vectors: pa.Array) -> pa.Array:
            at, scaled = batch_matrix(vectors, matrix.shape[1])
            order = np.argsort(np.round(1 - scaled @ matrix.T, DECIMALS), axis=1, kind="stable")[:, :probes]
            found: list = [None] * len(vectors)
            for row, own in zip(at, numbers[order]):
                found[row] = own
            return pa.array(found, pa.list_(pa.int32()))

        return nearest(vector)

    def search(self, queries: DataFrame, k: int, probes: int, query_key: str = "query", query_vector: str = "vector") -> DataFrame:
        """query, key, distance, rank: the ``k`` nearest rows of each query among those of its ``probes`` nearest centres.

        Distances are exact; with as many probes as centres the search is. Only folders of probed centres are read. A
        folder's rows and a block of its queries meet in one task as a matrix product, so neither a centre with many
        rows nor one with many queries is one task's work. Queries without a direction find nothing.
        """
        asked = queries.select(F.col(query_key).alias("query"), F.col(query_vector).alias("asked"))
        asked = asked.withColumn("centre", F.explode(self.nearest_centres(F.col("asked"), probes)))
        per_centre = asked.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per centre
        blocks = self.spark.createDataFrame([(r["centre"], -(-r["n"] // BLOCK_QUERIES)) for r in per_centre], "centre int, blocks long")
        held = self.rows.where(F.col("centre").isin([r["centre"] for r in per_centre]))
        slices = held.select("centre", "slice").distinct()
        one = asked.join(F.broadcast(blocks), "centre").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
        one = one.join(slices, "centre").select("centre", "slice", "block", "query", "asked")
        two = held.join(F.broadcast(blocks), "centre").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        two = two.select(F.col("centre").alias("c"), F.col("slice").alias("s"), F.col("block").alias("b"), self.key, self.vector)
        dim = len(self.centres[0][1]) if self.centres else 1
        types = {f.name: f.dataType.simpleString() for f in (*one.schema.fields, *two.schema.fields)}

        def near(wanted: pa.Table, rows: pa.Table) -> pa.Table:
            at, scaled = batch_matrix(rows[self_vector].combine_chunks(), dim)
            of, asks = batch_matrix(wanted["asked"].combine_chunks(), dim)
            keys, names = rows[self_key].combine_chunks().take(pa.array(at)), wanted["query"].combine_chunks()
            out = []
            for query, row in zip(of, np.round(1 - asks @ scaled.T, DECIMALS)):
                few = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                table = pa.table({"key": keys.take(pa.array(few)), "distance": row[few]})
                table = table.take(pc.sort_indices(table, [("distance", "ascending"), ("key", "ascending")])[:k])
                out.append(table.add_column(0, "query", pa.repeat(names[int(query)], len(table))))
            return pa.concat_tables(out) if out else pa.table({"query": names[:0], "key": keys[:0], "distance": np.empty(0)})

        self_key, self_vector = self.key, self.vector
        found = one.groupBy("centre", "slice", "block").cogroup(two.groupBy("c", "s", "b")).applyInArrow(
            near, f"query {types['query']}, key {types[self.key]}, distance double"
        )
        best = top_k(found, k, [F.asc("distance"), F.asc("key")], F.col("key"), by=["query"], rank="rank")
        return best.select("query", F.col("key").alias(self.key), "distance", "rank")


def publish_vector_index(rows: DataFrame, centres: DataFrame, root: str, key: str = "review_id", vector: str = "vector", slice_rows: int = SLICE_ROWS) -> VectorIndex:
    """Store every row under the centre nearest to its vector and make the index the current one under ``root``.

    ``centres`` are ``centre, vector``, from ``fit_centres`` or the caller's own; equally near ones go to the smaller
    number. A centre with many rows has several folders of about ``slice_rows`` rows. Rows without a usable vector are kept
    and never found. Columns of ``rows`` named ``centre`` or ``slice`` are replaced.
    """
    known = sorted((r["centre"], r["vector"]) for r in centres.select("centre", "vector").limit(MOST_CENTRES + 1).collect())
    if not 0 < len(known) <= MOST_CENTRES:
        raise ValueError(f"an index has from 1 to {MOST_CENTRES} centres")
    spark = rows.sparkSession
    version = versions.new_version(root)
    path = f"{root}/{version}"
    spark.createDataFrame(known, "centre int, vector array<double>").coalesce(1).write.parquet(f"{path}/centres")
    numbers = F.array(*[F.lit(n) for n, _ in known])
    match = best_match(F.col(vector), [n for n, _ in known], [v for _, v in known])
    placed = rows.drop("centre", "slice").withColumn("_match", match)
    placed = placed.withColumn("centre", F.when(F.col("_match.place").isNull(), NOWHERE).otherwise(F.get(numbers, F.col("_match.place"))).cast("int")).drop("_match")
    counts = placed.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices"))
    sizes = spark.createDataFrame(counts.collect(), "centre int, slices long")  # a row per centre
    cut = placed.join(F.broadcast(sizes), "centre").withColumn("slice", F.pmod(F.xxhash64(key), F.col("slices")).cast("int")).drop("slices")
    cut.repartition("centre", "slice").sortWithinPartitions("centre", "slice").write.partitionBy("centre", "slice").parquet(f"{path}/rows")
    versions.publish(spark, root, version)
    return VectorIndex(spark, path, key, vector)


def open_vector_index(spark: SparkSession, root: str, key: str = "review_id", vector: str = "vector") -> VectorIndex:
    path = versions.current(spark, root)
    if path is None:
        raise ValueError(f"no index under {root}")
    return VectorIndex(spark, path, key, vector)
