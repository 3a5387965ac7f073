"""Tab-separated sinks with the texts that the formats use for unknown and infinite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.operators.gene_expression import Matrix


def as_text(df: DataFrame, name: str) -> Column:
    """A column's text: ``nan``, ``inf`` and ``-inf`` for those, ``nan`` for null numbers."""
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
    if kind in ("int", "bigint"):
        return F.coalesce(c.cast("string"), F.lit("nan"))
    return F.coalesce(c.cast("string"), F.lit(""))


def write_tsv(df: DataFrame, path: str, names: list[str] | None = None, single: bool = False) -> None:
    """Header and rows; ``single`` gives one file (small tables), else one per partition."""
    out = df.select(*[as_text(df, c).alias(n) for c, n in zip(df.columns, names or df.columns)])
    (out.coalesce(1) if single else out).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("comment", "\u0001").option("emptyValue", "").option("nullValue", "").csv(path)


def write_matrix(matrix: Matrix, path: str, single: bool = True) -> None:
    """Rows in the features' order under a header line, whatever the number of samples."""
    key = [F.col(c).cast("string") for c in ("contig", "start", "stop", "name")]
    lines = matrix.rows.select("feature", F.concat_ws("\t", *key, F.array_join("cells", "\t")).alias("value"))
    start = ["#contig", "start", "stop", "name"]
    if isinstance(matrix.names, DataFrame):
        own = F.transform(F.array_sort(F.collect_list(F.struct("place", "sample"))), lambda s: s["sample"])
        header = matrix.names.agg(F.concat_ws("\t", *map(F.lit, start), own).alias("value")).withColumn("_line", F.lit(0))
    else:
        header = ["\t".join([*start, *map(str, matrix.names)])]
    _with_header(lines, header, ["feature"], path, single)


def write_lines(df: DataFrame, header: list[str], path: str, single: bool = False) -> None:
    """Header lines and one column ``value`` in the order of contig and pos, as one folder
    whose files, in the order of their names, are the text; ``single``: as one file in it."""
    _with_header(df, header, ["contig", "pos"], path, single)


def write_shards(df: DataFrame, line: Column, header: DataFrame, path: str) -> None:
    """One gzipped text for each ``shard`` of ``df``, in a folder of its own: the lines of ``header`` (shard,
    _line, value), then ``line`` of each row in the order of contig and pos. Lines are made where
    they are written: what is dealt and sorted are the columns of ``df``."""
    both = df.unionByName(header, allowMissingColumns=True)
    # dealt by a hash of the shard: where both tables are dealt by the shard itself Spark leaves this step out and keeps their tasks apart
    rows = both.repartition(F.xxhash64("shard")).sortWithinPartitions("shard", F.col("_line").asc_nulls_last(), "contig", "pos")
    value = F.when(F.col("_line").isNull(), line).otherwise(F.col("value")).alias("value")
    rows.select("shard", value).write.mode("overwrite").partitionBy("shard").option("compression", "gzip").text(path)


def _with_header(df: DataFrame, header: list[str] | DataFrame, by: list[str], path: str, single: bool) -> None:
    """``header``: lines, or a table of them (_line, value)."""
    spark = df.sparkSession
    top = header if isinstance(header, DataFrame) else spark.createDataFrame(list(enumerate(header)), "_line int, value string")
    rows = df.select("value", *by, F.lit(None).cast("int").alias("_line")).unionByName(top, allowMissingColumns=True)
    order = [F.col("_line").asc_nulls_last(), *by]
    if single:
        rows = rows.coalesce(1).sortWithinPartitions(*order)
    else:
        rows = rows.orderBy(*order)
    rows.select("value").write.mode("overwrite").text(path)
