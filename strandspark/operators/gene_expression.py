"""Haplotype counts to gene-level allelic expression, and the cohort's matrix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.config import GeneConfig
from strandspark.functions.stats import log2_afc
from strandspark.operators.intervals import nested_overlaps
from strandspark.operators.scans import numbered
from strandspark.runtime import written


def by_separator(separator: str) -> Callable[[Column], Column]:
    """Position of a variant id ``contig<sep>pos<sep>ref<sep>alt``; the contig holds no separator."""
    return lambda v: F.get(F.split(v, F.lit(f"\\Q{separator}\\E")), F.lit(1)).cast("long")


def feature_reads(counts: DataFrame, features: DataFrame, position: Callable[[Column], Column], width: int = 10_000) -> DataFrame:
    """Pairs of a block row and a feature that it overlaps, with the distinct reads of
    the variants inside the feature (its end included, as the block test is not).

    Blocks of one variant have no read lists; their counts stand.
    """
    own = counts.where("totalCount > 0").withColumn("_from", F.col("start") - 1).withColumnRenamed("start", "_start").withColumnRenamed("stop", "_stop")
    f = features.select("contig", "name", F.col("start").alias("f_start"), F.col("stop").alias("f_stop"), "feature")
    pairs = nested_overlaps(own, f, ["contig"], "_from", "_stop", "f_start", "f_stop", width)
    names = F.split("variants", ",")
    inside = F.filter(F.transform(names, lambda v, i: F.struct(v.alias("v"), i.alias("i"), (position(v) - 1).alias("p"))), lambda s: (s["p"] >= F.col("f_start")) & (s["p"] <= F.col("f_stop")))
    pairs = pairs.withColumn("_in", inside)

    def reads(lists: str, single: str) -> Column:
        of = F.flatten(F.transform("_in", lambda s: F.split(F.coalesce(F.get(F.split(F.col(lists), ";"), s["i"].cast("int")), F.lit("")), ",")))
        many = F.size(F.array_distinct(F.filter(of, lambda r: r != ""))).cast("long")
        return F.when(F.size(names) > 1, many).when(F.size("_in") > 0, F.col(single)).otherwise(F.lit(0)).cast("long")

    pairs = pairs.withColumns({"a": reads("aReads", "aCount"), "b": reads("bReads", "bCount"), "used": F.transform("_in", lambda s: s["v"])})
    return pairs.drop("_in", "_from", "f_start", "f_stop")


def gene_counts(counts: DataFrame, features: DataFrame, config: GeneConfig = GeneConfig(), position: Callable[[Column], Column] | None = None, width: int = 10_000) -> DataFrame:
    """Every feature in every file: phased blocks summed by genome-wide haplotype, or the
    one best unphased block if that has more reads.

    ``counts`` carries ``ord``, the order of its rows (ties between unphased blocks go to
    the first); ``features`` carries ``feature``, the order of the features.
    """
    pairs = feature_reads(counts, features, position or by_separator(config.id_separator), width)
    phased = (F.col("blockGWPhase") != "0/1") & (F.col("gwStat") >= config.gw_cutoff)
    if config.min_haplo_maf > 0:
        phased = phased & (F.col("max_haplo_maf") >= config.min_haplo_maf)
    swap = F.col("blockGWPhase") == "1|0"
    x = pairs.withColumns({"phased": phased, "pa": F.when(swap, F.col("b")).otherwise(F.col("a")), "pb": F.when(swap, F.col("a")).otherwise(F.col("b"))})
    loose = ~F.col("phased") & (F.col("a") + F.col("b") > 0)
    best = F.max_by(F.struct("a", "b", "used"), F.when(loose, F.struct((F.col("a") + F.col("b")).alias("t"), (-F.col("ord")).alias("o"))))
    used = F.array_sort(F.collect_list(F.when(F.col("phased"), F.struct("ord", "used"))))
    per = x.groupBy("feature", "bam").agg(F.sum(F.when(F.col("phased"), F.col("pa"))).alias("pa"), F.sum(F.when(F.col("phased"), F.col("pb"))).alias("pb"), F.flatten(F.transform(used, lambda s: s["used"])).alias("pv"), best.alias("best"))
    grid = features.crossJoin(F.broadcast(counts.select("bam").distinct()))  # every feature in every file
    g = grid.join(per, ["feature", "bam"], "left").withColumns({"pa": F.coalesce("pa", F.lit(0)), "pb": F.coalesce("pb", F.lit(0)), "ua": F.coalesce("best.a", F.lit(0)), "ub": F.coalesce("best.b", F.lit(0))})
    use = F.col("pa") + F.col("pb") >= F.col("ua") + F.col("ub")
    none = F.array().cast("array<string>")
    g = g.withColumns({"aCount": F.when(use, F.col("pa")).otherwise(F.col("ua")), "bCount": F.when(use, F.col("pb")).otherwise(F.col("ub")), "gw_phased": use.cast("int"), "v": F.when(use, F.coalesce("pv", none)).otherwise(F.coalesce("best.used", none))})
    g = g.withColumn("totalCount", F.col("aCount") + F.col("bCount")).where(F.col("totalCount") >= config.min_cov)
    return g.select("contig", "start", "stop", "name", "aCount", "bCount", "totalCount", log2_afc(F.col("aCount"), F.col("bCount")).alias("log2_aFC"), F.size("v").alias("n_variants"), F.array_join("v", ",").alias("variants"), "gw_phased", "bam")


def complete_samples(genes: DataFrame, features: DataFrame) -> DataFrame:
    """Samples (``bam``) whose genes are exactly the feature file's, once each."""
    n = features.select(F.count(F.lit(1)).alias("features"))
    own = genes.join(features.select("contig", "start", "stop", "name").distinct(), ["contig", "start", "stop", "name"], "left_semi").groupBy("bam").agg(F.count(F.lit(1)).alias("found"))
    every = genes.groupBy("bam").agg(F.count(F.lit(1)).alias("rows"))
    return own.join(every, "bam").crossJoin(F.broadcast(n)).where("found = features and rows = features").select("bam")


@dataclass
class Matrix:
    """A gene by sample matrix of any width: the samples' names (or, where they are too many for a list, a
    table of place and sample), and rows of contig, start, stop, name, feature and ``cells``, an array
    with a cell for each name."""

    names: list | DataFrame
    rows: DataFrame

    def wide(self, names: list | None = None) -> DataFrame:
        """One column a sample, in the features' order."""
        at = {n: i for i, n in enumerate(self.names)}
        cells = [(F.get("cells", F.lit(at[n])) if n in at else F.lit(None).cast("string")).alias(str(n)) for n in (self.names if names is None else names)]
        return self.rows.orderBy("feature").select("contig", "start", "stop", "name", *cells)


def cell_counts(cells: DataFrame, names: list | DataFrame) -> DataFrame:
    """(contig, start, stop, name, sample, a, b) of rows with ``cells``, an array by the place of ``names``
    (or of the table's ``sample``)."""
    places = names if isinstance(names, DataFrame) else F.broadcast(cells.sparkSession.createDataFrame([(i, str(n)) for i, n in enumerate(names)], "place int, sample string"))
    part = lambda i: F.get(F.split("cell", "[|]"), F.lit(i)).try_cast("long")
    long = cells.select("contig", "start", "stop", "name", F.posexplode("cells").alias("place", "cell")).join(places, "place")  # one row a sample
    return long.select("contig", "start", "stop", "name", "sample", part(0).alias("a"), part(1).alias("b"))


def matrix_cells(genes: DataFrame, features: DataFrame, phased_only: bool = False) -> Matrix:
    """Cells ``a|b`` of all complete samples; ``phased_only``: ``0|0`` where not phased.

    Samples get places in the order of their names, and a gene's cells are filled into one array by place
    in one aggregation; nothing grows with the number of columns but the rows themselves.
    """
    cell = F.concat(F.col("aCount").cast("string"), F.lit("|"), F.col("bCount").cast("string"))
    if phased_only:
        cell = F.when(F.col("gw_phased") == 1, cell).otherwise("0|0")
    complete = written(complete_samples(genes, features), "complete-samples")
    names = sorted(r["bam"] for r in complete.collect())  # the header line's names
    kind = dict(genes.dtypes)["bam"]
    places = genes.sparkSession.createDataFrame(list(enumerate(names)), f"place int, bam {kind}")
    own = genes.join(places, "bam").select("contig", "start", "stop", "name", "place", cell.alias("cell"))
    filled = own.groupBy("contig", "start", "stop", "name").agg(F.array_sort(F.collect_list(F.struct("place", "cell"))).alias("x"))
    dense = F.transform("x", lambda s: s["cell"])
    # a gene that stands twice in a file has cells of one place more than once: the first counts
    by_place = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.get(F.filter("x", lambda s: s["place"] == i), F.lit(0))["cell"])
    exact = (F.size("x") == len(names)) & (F.size(F.array_distinct(F.transform("x", lambda s: s["place"]))) == len(names))
    filled = filled.select("contig", "start", "stop", "name", F.when(exact, dense).otherwise(by_place).alias("cells"))
    rows = features.select("contig", "start", "stop", "name", "feature").join(filled, ["contig", "start", "stop", "name"])
    return Matrix(names, written(rows, "matrix-rows"))  # what puts them in order reads them twice


def matrix(genes: DataFrame, features: DataFrame, samples: list | None = None, phased_only: bool = False) -> DataFrame:
    """The matrix with a column for each sample (of those given, if any)."""
    return matrix_cells(genes, features, phased_only).wide(samples)


def with_order(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Number the rows by these columns, from 0 (for tables without a file order)."""
    return numbered(df, name, *by)
