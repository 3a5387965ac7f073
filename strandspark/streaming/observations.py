"""Allele counts and phasing over a stream of aligned reads.

Reads arrive as files of SAM text; the sites are a static table. Distinct reads
are exact: an observation counts once per read, site and class.

Where the files come about in the order of coordinates, a coordinate takes the place of
event time: its watermark stays a given number of bases behind the furthest site seen,
what lies behind is final, and its state is dropped. Phasing needs whole components, so
observations are kept by contig until the reads have left it, phased then, and dropped;
reads that come to a contig after that are set aside, not lost. A read of the contig
``END`` (see :func:`write_end`) tells that no others follow. Files in any order are safe
with a lag, or a number of contigs to wait for, that covers them all: then everything is
final at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandspark.config import PhaseConfig
from strandspark.operators import edges, phasing
from strandspark.operators.observe import observe
from strandspark.runtime import written
from strandspark.sources.readers import sam_columns

#: The contig after all others; its one read ends a stream.
END = "*end*"
#: Coordinates between the beginnings of two contigs, over any contig's length; one is a second of event time.
STEP = 1 << 32


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Reads of SAM files as they come into a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return sam_columns(lines.withColumn("bam", F.lit(0)), "bam")


def allele_counts(reads: DataFrame, sites: DataFrame, baseq: int = 10) -> DataFrame:
    """Running reads per site and allele class (update mode): stream-static join, then a
    stateful distinct on (read, site, class)."""
    obs = observe(reads, sites, baseq).where("cls < 2").dropDuplicates(["read_id", "contig", "variant_id", "cls"])
    return obs.groupBy("contig", "variant_id", "cls").agg(F.count(F.lit(1)).alias("reads"))


def collect_observations(reads: DataFrame, sites: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, baseq: int = 10) -> StreamingQuery:
    """Append observations to a table; ``then`` gets the whole table after each batch."""

    def batch(df: DataFrame, number: int) -> None:
        observe(df, sites, baseq).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then is not None:
            then(df.sparkSession.read.parquet(path))

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_end(spark: SparkSession, folder: str) -> None:
    """Add the file that ends a stream to its folder."""
    line = "\t".join(["end", "3", END, "1", "255", "1M", "=", "1", "0", "A", "I"])
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(folder)


def _ending(sites: DataFrame) -> DataFrame:
    """The sites, and one for the read that ends the stream."""
    own = sites.select("contig", "variant_id", "pos", "ref_len", "alleles")
    end = sites.sparkSession.createDataFrame([(END, END, 1, 1, ["A", "C"])], "contig string, variant_id string, pos long, ref_len int, alleles array<string>")
    return own.unionByName(end)


def coordinate(contig: Column, pos: Column, contigs: list[str]) -> Column:
    """Place of a position in the order of the contigs, as a time; null on an unknown contig."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate([*contigs, END]) for x in (c, i)])
    return F.timestamp_seconds(F.element_at(rank, contig).cast("long") * STEP + pos)


def final_counts(reads: DataFrame, sites: DataFrame, contigs: list[str], lag: int, baseq: int = 10) -> DataFrame:
    """(contig, variant_id, cls, reads), each once and for good (append mode), when the stream is
    ``lag`` bases past the site. Reads further behind than that no longer count.

    ``lag`` covers the longest stretch from a read's first to its last base, and how far files
    are out of order. State is kept for that stretch only.
    """
    obs = observe(reads, _ending(sites), baseq).where("cls < 2").withColumn("place", coordinate(F.col("contig"), F.col("pos"), contigs))
    once = obs.withWatermark("place", f"{lag} seconds").dropDuplicates(["read_id", "contig", "variant_id", "cls", "place"])
    return once.groupBy("place", "contig", "variant_id", "cls").agg(F.count(F.lit(1)).alias("reads")).where(F.col("contig") != END).drop("place")


def phase_observations(obs: DataFrame, sites: DataFrame, config: PhaseConfig) -> DataFrame:
    """Phased variants of the contigs of ``obs``; noise and score cutoffs are each contig's own."""
    kept = edges.keep_scores(obs, config.as_q_cutoff, ["bam", "contig"])
    alive = edges.surviving(edges.pair_tests(kept, sites, by=["contig"]), config.cc_threshold)
    return phasing.phase(alive, written(phasing.blocks_of(alive), "blocks"), config.max_block_size, config.compat)


def phase_as_contigs_close(reads: DataFrame, sites: DataFrame, contigs: list[str], path: str, checkpoint: str, config: PhaseConfig = PhaseConfig(), wait: int = 0) -> StreamingQuery:
    """Phase each contig once when reads of the contig ``wait + 1`` places later, or the end, have come.

    Under ``path``: ``open`` (observations of open contigs, by batch), ``phased`` (by contig, as
    they close) and ``late`` (observations of closed contigs). A batch that is done again
    replaces what it had written.
    """
    every = _ending(sites)
    rank = {c: i for i, c in enumerate(contigs)}

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fs, at = _files(spark, path)
        closed = {c for c in contigs if fs.exists(at(f"phased/contig={_escaped(c)}"))}
        obs = observe(df, every, config.baseq)
        obs.where(~F.col("contig").isin(list(closed))).write.mode("overwrite").partitionBy("contig").parquet(f"{path}/open/batch={number}")
        if closed and not (late := obs.where(F.col("contig").isin(list(closed)))).isEmpty():
            late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        seen = [r["rname"] for r in df.select("rname").distinct().collect()]  # names of contigs
        reached = len(contigs) + wait + 1 if END in seen else max((rank[c] for c in seen if c in rank), default=0)
        due = [c for c in contigs if rank[c] + wait < reached and c not in closed]
        if not due or not fs.exists(at("open")):
            return
        kept = spark.read.option("basePath", f"{path}/open").schema(f"{_ddl(obs)}, batch long").parquet(f"{path}/open")
        now = kept.where(F.col("contig").isin(due)).drop("batch")
        phased = phase_observations(now, sites, config)
        phased.write.mode("append").partitionBy("contig").parquet(f"{path}/phased.new-{number}")
        for c in due:  # a contig without phased variants is closed as well
            new, old = at(f"phased.new-{number}/contig={_escaped(c)}"), at(f"phased/contig={_escaped(c)}")
            fs.mkdirs(old.getParent())
            fs.rename(new, old) if fs.exists(new) else fs.mkdirs(old)
            for folder in fs.globStatus(at(f"open/batch=*/contig={_escaped(c)}")) or []:
                fs.delete(folder.getPath(), True)
        fs.delete(at(f"phased.new-{number}"), True)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    """The file system of ``path``, and its paths by relative name."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _escaped(contig: str) -> str:
    """A contig's name as Spark writes it in the name of a folder."""
    return "".join(c if ord(c) > 31 and c not in "\"#%'*/:=?\\\x7f{[]^" else f"%{ord(c):02X}" for c in contig)
