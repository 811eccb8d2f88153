"""A tree of clustered embeddings with summarised parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake.scratch import cut


def build_tree(leaves: DataFrame, levels: int = 3, most: int = 256, components: int = 8, seed: int = 42, summarize: Callable[[Column], Column] | None = None, read: int = 64) -> DataFrame:
    """``(id, level, text, vector, children)`` of leaves ``(id, text, vector)`` and all summary levels.

    Each level clusters the one below with a Gaussian mixture over its principal
    components, as many clusters as its size can fill, up to ``most``; a
    parent's text is the summary of the first ``read`` of its children's (by
    default their first words), so no row gathers a whole cluster's texts; its
    vector is the mean of all.  Building stops when a level has a single node.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    summarize = summarize or (lambda t: F.array_join(F.slice(F.split(t, " "), 1, 64), " "))
    level = leaves.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("level"), "text", "vector", F.array().cast("array<string>").alias("children"))
    tree = level = cut(level, "tree")
    for depth in range(1, levels + 1):
        n = level.count()
        if n <= 1:
            break
        dims = level.select(F.size("vector").alias("d")).first()["d"]
        features = level.withColumn("whole", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
        axes = min(components, dims)
        k = max(1, min(most, n // (4 * axes)))
        if k > 1:
            features = PCA(k=axes, inputCol="whole", outputCol="features").fit(features).transform(features)
            grouped = GaussianMixture(k=k, seed=seed, maxIter=20).fit(features).transform(features).withColumnRenamed("prediction", "cluster")
        else:
            grouped = features.withColumn("cluster", F.lit(0))
        nth = F.row_number().over(W.partitionBy("cluster").orderBy("id"))
        grouped = grouped.withColumn("read", F.when(nth <= read, F.struct("id", "text")))
        up = grouped.groupBy("cluster").agg(
            F.sort_array(F.collect_list("read")).alias("kids"),
            F.sort_array(F.collect_list("id")).alias("children"),
            F.array(*[F.avg(F.col("vector")[i]) for i in range(dims)]).alias("vector"),
        )
        text = summarize(F.array_join(F.transform("kids", lambda x: x["text"]), " "))
        level = cut(up.select(F.concat(F.lit(f"L{depth}-"), F.col("cluster").cast("string")).alias("id"), F.lit(depth).alias("level"), text.alias("text"), F.col("vector").cast(tree.schema["vector"].dataType).alias("vector"), "children"), "tree")
        tree = tree.unionByName(level)
    return tree
