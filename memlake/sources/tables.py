"""Parquet tables: provided ones, idempotent appends, lookups, result sinks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from memlake.functions.ids import hash_id
from memlake.operators.vector_store import predicate
from memlake.scratch import cut

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer than half as many partitions; unchanged otherwise.

    For work that is heavy per row on an input of few row groups.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 < n else df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table of texts, spread."""
    return spread(table(spark, sf_dir, name))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def sample(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """``n`` rows by the order of a seeded hash; the same ones on each run and in any engine with MD5."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def source_split(df: DataFrame, source: str, limit: int | None = None, order: str = "row_idx") -> DataFrame:
    """The first rows of one source of a sample table."""
    out = df.where(F.col("metadata.source") == source).orderBy(order)
    return out.limit(limit) if limit else out


def as_list(c: Column) -> Column:
    """A scalar as a list of one; null and empty as an empty list."""
    return F.when(c.isNotNull() & (c.cast("string") != ""), F.array(c)).otherwise(F.array().cast("array<string>"))


def question_pairs(df: DataFrame, key: str = "context_id") -> DataFrame:
    """``(key, pos, question, answers)`` of parallel lists.

    Several questions and answers are paired by position, to the shorter list's
    end; otherwise the only question gets all answers.
    """
    q, a = F.col("questions"), F.col("answers")
    many = (F.size(q) > 1) & (F.size(a) > 1)
    n = F.least(F.size(q), F.size(a))
    zipped = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.try_element_at(q, i).alias("question"), F.array(F.try_element_at(a, i)).alias("answers")))
    one = F.array(F.struct(F.try_element_at(q, F.lit(1)).alias("question"), a.alias("answers")))
    return df.select(key, F.posexplode(F.when(many, zipped).otherwise(one)).alias("pos", "p")).select(key, "pos", "p.*")


def picked(top: Column, meta: Column, i: Column) -> Column:
    """Entry ``i`` of the first list that is not empty; null past its end."""
    return F.try_element_at(F.when(F.size(top) > 0, top).otherwise(meta), i + 1)


def instances(df: DataFrame, ids: list[Any] | None = None, positions: list[int] | None = None, id_col: str = "id") -> DataFrame:
    """Rows by ids or by positions in id order."""
    if ids is not None:
        return df.where(F.col(id_col).isin(ids))
    return numbered(df, id_col, "__pos").where(F.col("__pos").isin(positions or [])).drop("__pos")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with each row's position by ``order``, from 0.

    Rows are ranged into a written table and numbered within each range; ranges
    start behind the rows of those before them, of which there are as many as
    shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__start"))
    within = F.row_number().over(W.partitionBy("__range").orderBy(order)) - 1
    return ranged.withColumn("__k", within).join(starts, "__range").withColumn(name, F.col("__start") + F.col("__k")).select(*df.columns, name)


def hashed(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Rows with ``hash_id``; the first of equal texts."""
    return df.withColumn("hash_id", hash_id(F.col(text_col), prefix)).dropDuplicates(["hash_id"])


def missing(new: DataFrame, stored: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows whose key is not stored yet."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def insert_missing(spark: SparkSession, path: str, new: DataFrame, key: str = "hash_id") -> int:
    """Appends the rows that a table does not hold; returns how many."""
    add = missing(new, spark.read.parquet(path), key) if exists(spark, path) else new.dropDuplicates([key])
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    add.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def lookup(stored: DataFrame, keys: list[str], key: str = "hash_id") -> DataFrame:
    """Rows in the order of the keys asked for."""
    asked = stored.sparkSession.createDataFrame(list(enumerate(keys)), f"pos int, {key} string")
    return stored.join(asked, key).orderBy("pos").drop("pos")


def save_results(df: DataFrame, path: str, run: str) -> None:
    """Writes a run's results in place of any it had; the run is a partition column, not part of a name."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def load_results(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run") == run)


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def filtered_table(spark: SparkSession, name: str, filters: dict[str, Any] | None = None) -> DataFrame:
    """A catalog table with equality and IN filters; only plain identifiers are names."""
    if not all(p.isidentifier() for p in name.split(".")):
        raise ValueError(f"not a table name: {name}")
    return spark.table(name).where(predicate(filters))


def insert_rows(df: DataFrame, name: str) -> int:
    n = df.count()
    df.write.mode("append").saveAsTable(name)
    return n


def reflect(tables: dict[str, DataFrame], keys: dict[str, str] | None = None, foreign: dict[str, list[tuple[str, str, str]]] | None = None) -> dict[str, dict]:
    """Columns, primary and foreign keys of tables; keys are declared, types are read."""
    return {name: {"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema], "primary_key": (keys or {}).get(name), "foreign_keys": [{"column": c, "ref_table": t, "ref_column": r} for c, t, r in (foreign or {}).get(name, [])]} for name, df in tables.items()}


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 16, **options: str) -> DataFrame:
    """A relational table, read in ranges of ``column`` where one is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column:
        r = r.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return r.load()
