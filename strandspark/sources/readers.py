"""Readers of the text formats; each gives typed columns and keeps nothing on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.operators.gene_expression import cell_counts
from strandspark.sources.bgzf import Regions, comment_lines, is_blocked, is_indexed, read_lines, whole_contigs, windows_of

VCF_COLUMNS = ("contig", "pos", "rsid", "ref", "alt", "qual", "filter", "info", "format")
COUNTS = (
    "contig string, start long, stop long, variants string, variantCount long, variantsBlacklisted string, variantCountBlacklisted long, haplotypeA string, haplotypeB string, "
    "aCount long, bCount long, totalCount long, blockGWPhase string, gwStat double, max_haplo_maf double, bam string, aReads string, bReads string"
)
GENES = "contig string, start long, stop long, name string, aCount long, bCount long, totalCount long, log2_aFC double, n_variants int, variants string, gw_phased int, bam string"
PAIRS = "gene_id string, var_id string, var_contig string, var_pos long, var_ref string, var_alt string"
SAMPLES = "vcf_sample string, bed_sample string"
#: Places of the annotation file's columns, from 0.
CADD_FIELDS = {"contig": 0, "pos": 1, "alt": 4, "effect": 10, "gene": 92, "name": 95}


def _comments(spark: SparkSession, path: str, start: str) -> list[str]:
    """Lines that begin with ``start``; a header is small. Only the beginning of a block-gzipped
    file is looked at."""
    if is_blocked(path):
        return [x for x in comment_lines(path) if x.startswith(start)]
    return [r["value"] for r in spark.read.text(path).where(F.startswith("value", F.lit(start))).collect()]


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a variant file: the first line that begins with ``#CHR``."""
    line = _comments(spark, path, "#CHR")
    if not line:
        raise ValueError(f"{path} has no #CHROM line")
    return line[0].split("\t")


def vcf_comments(spark: SparkSession, path: str) -> list[str]:
    """The ``##`` lines, in order."""
    return _comments(spark, path, "##")


def regions_for(path: str, sites: DataFrame, contig: str = "contig", pos: str = "pos") -> Regions | None:
    """Where an indexed file has to be read for these sites; None (all of it) without an index."""
    return windows_of(sites, contig, pos) if is_indexed(path) else None


def _fields(spark: SparkSession, path: str, drop_lines: str | None = None, regions: Regions | None = None) -> DataFrame:
    lines = read_lines(spark, path, regions)
    if drop_lines:
        lines = lines.where(~F.col("value").rlike(drop_lines))
    return lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))


def read_vcf(spark: SparkSession, path: str, sample: str, prefix: str = "", chrom: str | None = None, compat: bool = False) -> DataFrame:
    """Rows of one sample: the nine fixed columns and ``sample``; plain or (block) gzipped,
    of an indexed file only the contigs of ``chrom``.

    ``compat`` drops raw lines that hold ``0|0`` or ``1|1`` anywhere.
    """
    names = vcf_header(spark, path)
    if sample not in names[9:]:
        raise ValueError(f"{path} has no sample {sample}")
    c = _fields(spark, path, r"0[|]0|1[|]1" if compat else None, whole_contigs(chrom))
    at = [F.get("c", F.lit(i)).alias(n) for i, n in enumerate(VCF_COLUMNS)] + [F.get("c", F.lit(names.index(sample))).alias("sample")]
    out = c.select(*at).withColumn("pos", F.col("pos").try_cast("long"))
    if chrom:
        out = out.where(F.col("contig").isin(chrom.split(",")))
    return out.withColumn("contig", F.concat(F.lit(prefix), "contig")) if prefix else out


def read_genotypes(spark: SparkSession, path: str, regions: Regions | None = None, phased_only: bool = False) -> DataFrame:
    """(contig, pos, id, ref, alt, vcf_sample, gt) of all samples; ``regions`` thin what is read
    of an indexed file, and ``phased_only`` leaves out cells without a ``|`` before they are rows. A
    pattern (with ``*``) stands for files of different sites, each with the samples of its own header."""
    if "*" in path:
        return _genotypes_of_files(spark, path, phased_only)
    names = vcf_header(spark, path)[9:]
    c = _fields(spark, path, regions=regions)
    cells = F.arrays_zip(F.split(F.lit("\t".join(names)), "\t").alias("n"), F.slice("c", 10, len(names)).alias("v"))  # one constant, however many
    if phased_only:
        cells = F.filter(cells, lambda x: F.contains(x["v"], F.lit("|")))
    return _genotypes(c.select(*_site(), F.explode(cells).alias("x")).select("*", "x.n", "x.v"))


def _site() -> list[Column]:
    return [F.get("c", F.lit(i)).alias(n) for i, n in ((0, "contig"), (1, "pos"), (2, "id"), (3, "ref"), (4, "alt"), (8, "format"))]


def _genotypes_of_files(spark: SparkSession, pattern: str, phased_only: bool) -> DataFrame:
    """As :func:`read_genotypes`, of many files: cells meet their own file's header by its path (64 bits
    of it) and their place in the line, after those that nobody asks for have gone."""
    lines = spark.read.text(pattern).select("value", F.xxhash64("_metadata.file_path").alias("file"))
    names = lines.where(F.startswith("value", F.lit("#CHR"))).select("file", F.split("value", "\t").alias("names"))
    c = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select("file", F.split("value", "\t").alias("c"))
    cells = c.select("file", *_site(), F.posexplode("c").alias("place", "v")).where(F.col("place") >= 9)
    if phased_only:
        cells = cells.where(F.contains("v", F.lit("|")))
    return _genotypes(cells.join(names, "file").withColumn("n", F.get("names", F.col("place"))).where("n is not null"))


def _genotypes(cells: DataFrame) -> DataFrame:
    """Cells of samples (n: name, v: text) with their genotype."""
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    gt = F.when(at > 0, F.get(F.split("v", ":"), at - 1))
    return cells.select("contig", F.col("pos").try_cast("long").alias("pos"), "id", "ref", "alt", F.col("n").alias("vcf_sample"), gt.alias("gt"))


def file_numbers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bam): the files behind ``paths`` (files, folders or patterns) as Spark names them,
    and the place of each in the list; one row a file."""
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for i, path in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        for found in fs.globStatus(p) or []:
            for f in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
                rows += [(name, i) for name in {f.getPath().toString(), f.getPath().toUri().toString()}]
    return spark.createDataFrame(rows, "path string, bam int")


def same_path(name: Column) -> Column:
    """A file's address with one slash after the scheme, as ``file:/a`` and ``file:///a`` are the same."""
    return F.regexp_replace(name, "^([a-z0-9]+):/{3}", "$1:/")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, bam, path, first): lines of all files in one scan; ``first``: from a file's beginning."""
    numbers = file_numbers(spark, paths).select(same_path(F.col("path")).alias("path"), "bam").distinct()
    lines = spark.read.text(list(dict.fromkeys(paths))).select("value", same_path(F.col("_metadata.file_path")).alias("path"), (F.col("_metadata.file_block_start") == 0).alias("first"))
    return lines.join(F.broadcast(numbers), "path")  # one row a file, made from the list


def sam_columns(lines: DataFrame, *others: str) -> DataFrame:
    """Columns of SAM lines (``value``), and the columns ``others``."""
    c = lines.where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("c"), *others).where(F.size("c") >= 11)
    tags = F.filter(F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.startswith(t, F.lit("AS:")))
    col = lambda k: F.get("c", F.lit(k))
    score = F.try_element_at(F.split(F.try_element_at(tags, F.lit(-1)), ":"), F.lit(3)).try_cast("int")
    return c.select(col(0).alias("qname"), col(1).try_cast("int").alias("flag"), col(2).alias("rname"), col(3).try_cast("long").alias("pos"), col(4).try_cast("int").alias("mapq"), col(5).alias("cigar"), col(8).try_cast("int").alias("tlen"), col(9).alias("seq"), col(10).alias("qual"), score.alias("as_score"), *others)


def read_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Aligned reads of SAM text files, in one scan; ``bam`` is the file's place in ``paths``. The
    last AS tag is the score, null without one."""
    return sam_columns(numbered_lines(spark, paths), "bam")


def sam_contigs(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).where(F.startswith("value", F.lit("@SQ"))).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("c")).collect()
    return [r["c"] for r in rows]


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Half-open intervals: contig, start, stop, name (null where there is no fourth column)."""
    c = _fields(spark, path)
    return c.select(F.get("c", F.lit(0)).alias("contig"), F.get("c", F.lit(1)).try_cast("long").alias("start"), F.get("c", F.lit(2)).try_cast("long").alias("stop"), F.get("c", F.lit(3)).alias("name"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Named intervals with ``feature``, their order in the file."""
    return read_bed(spark, path).withColumn("feature", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with a header, columns taken by name and typed by ``schema``."""
    lines = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    missing = [x.split()[0] for x in schema.split(", ") if x.split()[0] not in lines.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return lines.select(*[F.col(n).try_cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Haplotypic counts with ``ord``, the order of the rows; empty lists are empty texts."""
    out = read_table(spark, path, COUNTS).na.fill("", ["aReads", "bReads", "variants", "variantsBlacklisted", "haplotypeA", "haplotypeB"])
    return out.withColumn("ord", F.monotonically_increasing_id())


def read_tables(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Tab-separated texts with headers, all files of a pattern in one scan; each file's columns
    are taken by its own header's names. Files whose header lacks one of them are left out."""
    fields = [x.split() for x in schema.split(", ")]
    names = F.array(*[F.lit(n) for n, _ in fields])
    cells = numbered_lines(spark, [pattern]).where("value <> ''").select("path", "first", F.split("value", "\t").alias("c"))
    is_header = F.col("first") & (F.size(F.array_intersect("c", names)) == len(fields))
    header = cells.where(is_header).groupBy("path").agg(F.first("c").alias("h")).select("path", F.transform(names, lambda n: F.array_position("h", n).cast("int") - 1).alias("at"))
    rows = cells.where(~is_header).join(header, "path")
    return rows.select(*[F.get("c", F.get("at", F.lit(i))).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def read_gene_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Gene tables of all files named ``*.txt*`` that have the columns ``bam`` and ``gw_phased``."""
    pattern = f"{folder}/*.txt*"
    if file_numbers(spark, [pattern]).isEmpty():
        return spark.createDataFrame([], GENES)
    return read_tables(spark, pattern, GENES)


def read_matrix(spark: SparkSession, path: str, genes: DataFrame | None = None, chrom: str | None = None) -> DataFrame:
    """(contig, start, stop, name, sample, a, b) of a gene by sample matrix of any width: cells are
    taken from the split line by their place, without a column for each sample. Only the given
    genes (column ``gene_id``) and contigs; an indexed file is read at these only."""
    if is_blocked(path):
        head = spark.createDataFrame([(x,) for x in _comments(spark, path, "#")[:1]], "value string")
    else:
        head = spark.read.text(path).where(F.startswith("value", F.lit("#"))).withColumn("_n", F.monotonically_increasing_id()).orderBy("_n").limit(1)
    if head.isEmpty():
        raise ValueError(f"{path} has no header")
    names = head.select(F.posexplode(F.slice(F.split("value", "\t"), 5, 1 << 30)).alias("place", "sample"))
    rows = _fields(spark, path, regions=whole_contigs(chrom)).select(F.get("c", F.lit(0)).alias("contig"), F.get("c", F.lit(1)).try_cast("long").alias("start"), F.get("c", F.lit(2)).try_cast("long").alias("stop"), F.get("c", F.lit(3)).alias("name"), F.slice("c", 5, F.greatest(F.size("c") - 4, F.lit(0))).alias("cells"))
    if chrom:
        rows = rows.where(F.col("contig").isin(chrom.split(",")))
    if genes is not None:
        rows = rows.join(genes.select(F.col("gene_id").alias("name")), "name", "left_semi")
    return cell_counts(rows, names)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample map; of equal vcf samples the last line stays."""
    own = read_table(spark, path, SAMPLES).withColumn("ord", F.monotonically_increasing_id())
    return own.groupBy("vcf_sample").agg(F.max_by("bed_sample", "ord").alias("bed_sample"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, PAIRS).withColumn("xindex", F.monotonically_increasing_id())


def read_cadd(spark: SparkSession, path: str, regions: Regions | None = None) -> DataFrame:
    """Annotations per contig, position and alternative; ``ord`` is the row's order. ``regions``
    thin what is read of an indexed file."""
    c = _fields(spark, path, regions=regions)
    cols = [F.get("c", F.lit(i)).alias(n) for n, i in CADD_FIELDS.items()]
    out = c.select(*cols, F.element_at("c", -1).try_cast("double").alias("phred"))
    return out.withColumn("pos", F.col("pos").try_cast("long")).withColumn("ord", F.monotonically_increasing_id())


def read_frequencies(spark: SparkSession, path: str, field: str = "AF", regions: Regions | None = None) -> DataFrame:
    """(contig, pos, alts, afs, ord) of a variant file's INFO field; one value or a list.
    ``regions`` thin what is read of an indexed file."""
    from strandspark.functions.fields import info_map

    c = _fields(spark, path, regions=regions).select(F.get("c", F.lit(0)).alias("contig"), F.get("c", F.lit(1)).try_cast("long").alias("pos"), F.split(F.get("c", F.lit(4)), ",").alias("alts"), info_map(F.get("c", F.lit(7)))[field].alias("af"))
    return c.select("contig", "pos", "alts", F.transform(F.split("af", ","), lambda x: x.try_cast("double")).alias("afs"), F.monotonically_increasing_id().alias("ord"))


def known_contigs(df: DataFrame) -> DataFrame:
    return df.select("contig").distinct()


def check_contigs(df: DataFrame, separator: str) -> DataFrame:
    """Fail on a contig that holds the id separator or a colon."""
    bad: Column = F.contains("contig", F.lit(separator)) | F.contains("contig", F.lit(":"))
    return df.withColumn("contig", F.when(bad, F.raise_error(F.concat(F.lit("contig holds a separator: "), "contig")).cast("string")).otherwise(F.col("contig")))
