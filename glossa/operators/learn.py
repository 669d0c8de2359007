"""Training sets, splits and a logistic scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint
from glossa.operators.evaluate import KEY


def label_join(candidates: DataFrame, gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Candidates with label and origin: gold pairs are 1, else the document's silver label; the others are left out, not negative."""
    g = gold.select(*KEY).distinct().withColumn("g", F.lit(1.0))
    rows = candidates.join(g, KEY, "left").join(silver, "doc_id", "left")
    label = F.coalesce("g", "silver")
    return rows.withColumn("label", label).withColumn("origin", F.when(F.col("g").isNotNull(), "gold").otherwise("silver")).filter("label IS NOT NULL").drop("g", "silver")


def hash_split(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, split: train, dev and test in proportion 8, 1, 1 by a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "doc_id"), 256), 1, 8), 16, 10).cast("long") % 10
    return docs.select("doc_id", F.when(h < 8, "train").when(h == 8, "dev").otherwise("test").alias("split")).distinct()


def split_problems(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, problem: documents of no split, or of several."""
    n = manifest.groupBy("doc_id").agg(F.count_distinct("split").alias("n"))
    problem = F.when(F.col("n").isNull(), "unassigned").when(F.col("n") > 1, "several")
    return rows.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", problem.alias("problem")).filter("problem IS NOT NULL")


def split_counts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    return rows.join(manifest, "doc_id").groupBy("split", "origin").agg(F.count(F.lit(1)).alias("n"))


#: Different rows (features, label) up to this number are fitted on the driver, as a count has checked; more are fitted where they are.
DRIVER_ROWS = 200_000


def logistic_fit(rows: DataFrame, names: list[str], iterations: int = 500, rate: float = 0.1, l2: float = 0.0, balanced: bool = False) -> dict[str, float]:
    """Full-batch gradient descent from zero on all rows; ``balanced`` weighs each class by rows / (2 * rows of the class).

    Equal rows are added up once. If few enough different ones are left, they are the whole problem and the steps run on the driver; otherwise each
    step is one pass over a checkpoint, every task giving the sum of its gradients.
    """
    label = F.col("label").cast("double")
    same = rows.groupBy(*[F.col(n).cast("double").alias(n) for n in names], label.alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    same = checkpoint(same)
    about = same.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("all"), F.sum(F.when(F.col("label") >= 0.5, F.col("rows")).otherwise(0)).alias("ones")).first()
    total, ones = about["all"] or 0, about["ones"] or 0
    if not total:
        raise ValueError("a fit needs rows")
    heavy = {True: total / (2 * ones) if ones else 0.0, False: total / (2 * (total - ones)) if total > ones else 0.0} if balanced else {True: 1.0, False: 1.0}
    ordered = [*names, "label", "rows"]

    def gradient(m: np.ndarray, w: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.ones((len(m), 1)), m[:, : len(names)]], 1)
        z = x @ w
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        weight = np.where(m[:, -2] >= 0.5, heavy[True], heavy[False]) * m[:, -1]
        return ((p - m[:, -2]) * weight) @ x

    w = np.zeros(len(names) + 1)
    few = about["n"] <= DRIVER_ROWS
    matrix = same.select(*ordered).orderBy(*ordered).toPandas().to_numpy(float) if few else None
    spread = None if few else checkpoint(same.select(*ordered).repartition(same.sparkSession.sparkContext.defaultParallelism))
    for _ in range(iterations):
        if few:
            step = gradient(matrix, w)
        else:
            def part(batches, w=w):
                total = np.zeros(len(w))
                for batch in batches:
                    total += gradient(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ordered], 1), w)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(total)], names=["i", "g"])

            found = spread.mapInArrow(part, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
            step = np.array([x["g"] for x in sorted(found, key=lambda x: x["i"])])
        penalty = np.concatenate([[0.0], l2 * w[1:]])
        w = w - rate * (step / total + penalty)
    return dict(zip(["bias", *names], w.tolist(), strict=True))


def fit_frame(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(n, round(w, 6)) for n, w in weights.items()], "name string, weight double")


def child_seed(seed: Column, component: Column) -> Column:
    """First eight bytes of sha256("seed:component") as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, component), 256), 1, 16), 16, 10).cast("decimal(20,0)")
