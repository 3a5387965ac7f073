"""Queries of the phasing core over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import fields, stats
from strandspark.operators import edges as E
from strandspark.operators import haplotypes as H
from strandspark.operators import intervals, phasing, splitting
from strandspark.plans.adapters import duck, view
from strandspark.runtime import ship, written

THRESHOLD = 0.01


class Case:
    """One view's tables and what is derived from them, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, threshold: float = THRESHOLD):
        ship(spark)
        self.obs, self.variants = view(spark, sf_dir, f"obs_{name}"), view(spark, sf_dir, f"var_{name}")
        self.threshold = threshold

    @property
    def tests(self) -> DataFrame:
        return E.pair_tests(self.obs, self.variants)

    def edges(self) -> DataFrame:
        """Surviving connections. Their prior phases are not asked for, and observations are joined
        with their dimension once, for noise, pairs and what reads them after that (no scores)."""
        self.obs = written(self.obs.drop("as_score", "mapq"), "observations")
        return written(E.surviving(E.pair_tests(self.obs), self.threshold), "edges")

    def phased(self, edges: DataFrame, most: int = 15) -> DataFrame:
        return written(phasing.phase(edges, written(phasing.blocks_of(edges), "blocks"), most), "phased")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def chain(name: str, threshold: float = THRESHOLD) -> str:
    """CTEs from observations to blocks, for DuckDB; ends without a comma."""
    return f"""obs AS ({duck("obs_" + name)}), var AS ({duck("var_" + name)}),
m AS (SELECT contig, variant_id, count(*) FILTER (cls < 2) AS ok, count(*) FILTER (cls = 2) AS bad FROM obs GROUP BY ALL),
noise AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / (2.0 * sum(ok + bad)), 0) AS e FROM m WHERE ok > 0 AND bad < 0.05 * (ok + bad)),
d AS (SELECT DISTINCT contig, read_id, variant_id, pos, cls FROM obs),
cells AS (
  SELECT a.contig, a.variant_id AS variant_a, a.pos AS pos_a, b.variant_id AS variant_b, b.pos AS pos_b,
    {", ".join(f"count(*) FILTER (a.cls = {i} AND b.cls = {j}) AS c{i}{j}" for i in range(3) for j in range(3))}
  FROM d a JOIN d b ON a.contig = b.contig AND a.read_id = b.read_id AND a.pos < b.pos GROUP BY ALL HAVING c00 + c01 + c10 + c11 > 0),
con AS (
  SELECT contig, variant_a, pos_a, variant_b, pos_b, greatest(c00 + c11, c01 + c10) AS s, c00 + c11 + c01 + c10 + c02 + c12 + c20 + c21 + c22 AS n,
    CASE WHEN c00 + c11 > c01 + c10 THEN 0 WHEN c01 + c10 > c00 + c11 THEN 1 ELSE -1 END AS config FROM cells),
tests AS (
  SELECT con.*, va.phase0 AS fa, vb.phase0 AS fb, CASE WHEN s = 0 THEN 0 WHEN s = n THEN 1 ELSE
    list_sum(list_transform(range(0, s + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1 - (6 * e + 10 * e * e)) + (n - i) * ln(6 * e + 10 * e * e)))) END AS p
  FROM con CROSS JOIN noise LEFT JOIN var va ON va.contig = con.contig AND va.variant_id = variant_a LEFT JOIN var vb ON vb.contig = con.contig AND vb.variant_id = variant_b),
edges AS (SELECT * FROM tests WHERE p >= {threshold}),
adj AS (SELECT contig, pos_a AS u, pos_b AS v FROM edges UNION SELECT contig, pos_b, pos_a FROM edges),
reach AS (SELECT contig, u AS x, u AS y FROM adj UNION SELECT r.contig, r.x, adj.v FROM reach r JOIN adj ON adj.contig = r.contig AND adj.u = r.y),
comp AS (SELECT contig, x AS pos, min(y) AS block FROM reach GROUP BY ALL),
bv AS (SELECT contig, pos, block, row_number() OVER (PARTITION BY contig, block ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY contig, block) AS n FROM comp),
ie AS (SELECT e.contig, a.block, a.idx AS ia, b.idx AS ib, config FROM edges e JOIN bv a ON a.contig = e.contig AND a.pos = pos_a JOIN bv b ON b.contig = e.contig AND b.pos = pos_b WHERE config >= 0),
sizes AS (SELECT DISTINCT contig, block, CAST(n AS INT) AS n FROM bv),
codes AS (SELECT contig, block, n, unnest(range(0, 1 << (n - 1))) AS code FROM sizes),
score AS (SELECT c.contig, c.block, c.n, code, count(*) FILTER (xor((code >> CAST(n - 1 - ia AS INT)) & 1, (code >> CAST(n - 1 - ib AS INT)) & 1) = config) AS s FROM codes c LEFT JOIN ie ON ie.contig = c.contig AND ie.block = c.block GROUP BY ALL),
best AS (SELECT contig, block, n, max(code) AS code FROM (SELECT *, max(s) OVER (PARTITION BY contig, block) AS top FROM score) WHERE s = top GROUP BY contig, block, n HAVING count(*) = 1),
ph AS (SELECT bv.contig, bv.block, bv.pos, CAST(bv.pos AS VARCHAR) AS variant_id, bv.idx, CAST((code >> CAST(bv.n - 1 - idx AS INT)) & 1 AS INT) AS hap_a FROM bv JOIN best ON best.contig = bv.contig AND best.block = bv.block),
pv AS (SELECT ph.*, rsid, ref, alt, phase0, maf, blacklisted, CASE WHEN hap_a = 0 THEN phase0 ELSE 1 - phase0 END AS f, CASE WHEN hap_a = 0 THEN ref ELSE alt END AS on_a, CASE WHEN hap_a = 0 THEN alt ELSE ref END AS on_b FROM ph JOIN var ON var.contig = ph.contig AND var.variant_id = ph.variant_id),
hr AS (SELECT DISTINCT ph.contig, ph.block, ph.variant_id, ph.idx, bam, read_id, CASE WHEN cls = hap_a THEN 'a' ELSE 'b' END AS hap FROM ph JOIN obs ON obs.contig = ph.contig AND obs.variant_id = ph.variant_id WHERE cls < 2)"""


def gw_sql(method: int) -> str:
    """CTE ``gw`` over ``pv``: confidence and corrected haplotype of each block."""
    by_maf = "CASE WHEN m0 + m1 > 0 THEN greatest(m0, m1) / (m0 + m1) ELSE greatest(mean, 1 - mean) END" if method else "greatest(mean, 1 - mean)"
    to_maj = "CASE WHEN mean < 0.5 THEN 0 WHEN mean > 0.5 THEN 1 END"
    to = f"CASE WHEN m0 + m1 > 0 THEN CASE WHEN m0 > m1 THEN 0 WHEN m1 > m0 THEN 1 END ELSE {to_maj} END" if method else to_maj
    return f"""g0 AS (SELECT contig, block, count(f) AS known, count(*) AS n, count(DISTINCT f) AS kinds, avg(f) AS mean, max(maf) AS max_maf,
    coalesce(sum(maf) FILTER (f = 0), 0) AS m0, coalesce(sum(maf) FILTER (f = 1), 0) AS m1 FROM pv GROUP BY ALL),
gw AS (SELECT contig, block, CAST(CASE WHEN known = 0 THEN 0.5 WHEN known = n AND kinds = 1 THEN 1.0 ELSE {by_maf} END AS DOUBLE) AS gw_confidence,
    CASE WHEN known > 0 AND NOT (known = n AND kinds = 1) THEN {to} END AS gw, CAST(kinds <= 1 AS INT) AS phase_concordant, max_maf FROM g0)"""


R = "WITH RECURSIVE "


@query("allelic_counts", f"""WITH obs AS ({duck("obs_t")})
SELECT contig, pos, variant_id, count(DISTINCT read_id) FILTER (cls = 0) AS ref_count, count(DISTINCT read_id) FILTER (cls = 1) AS alt_count,
  count(DISTINCT read_id) FILTER (cls = 0) + count(DISTINCT read_id) FILTER (cls = 1) AS total_count FROM obs WHERE cls < 2 GROUP BY ALL""")
def allelic_counts(spark, sf_dir):
    return E.allelic_counts(view(spark, sf_dir, "obs_t"))


@query("mapq_dup_filter", f"""SELECT contig, read_id, variant_id, cls FROM ({duck("obs_s")}) WHERE mapq >= 5 AND NOT (read_id & 1024) <> 0 AND (read_id & 2) = 2""")
def mapq_dup_filter(spark, sf_dir):
    from strandspark.operators.observe import read_filter

    return view(spark, sf_dir, "obs_s").where(read_filter(F.col("read_id"), F.col("mapq"), mapq=5, paired=True, remove_dups=True)).select("contig", "read_id", "variant_id", "cls")


@query("as_quantile_cutoff", f"""WITH obs AS ({duck("obs_s")}), cut AS (SELECT bam, quantile_cont(as_score, 0.05) AS cutoff FROM obs GROUP BY bam)
SELECT bam, cutoff, count(*) AS rows_kept FROM obs JOIN cut USING (bam) WHERE as_score >= cutoff GROUP BY ALL""")
def as_quantile_cutoff(spark, sf_dir):
    obs = view(spark, sf_dir, "obs_s")
    kept = E.keep_scores(obs, 0.05).groupBy("bam").agg(F.count(F.lit(1)).alias("rows_kept"))
    return E.score_cutoff(obs, 0.05).join(kept, "bam")


@query("noise_rate", f"""WITH obs AS ({duck("obs_s")}), m AS (SELECT contig, variant_id, count(*) FILTER (cls < 2) AS ok, count(*) FILTER (cls = 2) AS bad FROM obs GROUP BY ALL)
SELECT round(CAST(sum(bad) AS DOUBLE) / (2.0 * sum(ok + bad)), 9) AS noise FROM m WHERE ok > 0 AND bad < 0.05 * (ok + bad)""")
def noise_rate(spark, sf_dir):
    return E.noise_rate(view(spark, sf_dir, "obs_s")).select(F.round("noise", 9).alias("noise"))


@query("low_mismatch_variants", f"""SELECT * FROM (SELECT contig, variant_id, count(*) FILTER (cls < 2) AS matches, count(*) FILTER (cls = 2) AS mismatches FROM ({duck("obs_b")}) GROUP BY ALL) WHERE matches > 0 AND mismatches < 0.05 * (matches + mismatches)""")
def low_mismatch(spark, sf_dir):
    m = E.variant_matches(view(spark, sf_dir, "obs_b"))
    return m.where((F.col("matches") > 0) & (F.col("mismatches") < E.MAX_MISMATCH * (F.col("matches") + F.col("mismatches"))))


@query("variant_pairs", R + chain("p") + " SELECT contig, variant_a, variant_b FROM cells")
def variant_pairs(spark, sf_dir):
    return E.pair_cells(view(spark, sf_dir, "obs_p")).select("contig", "variant_a", "variant_b")


@query("pair_cells", R + chain("s") + " SELECT * FROM cells")
def pair_cells(spark, sf_dir):
    return E.pair_cells(view(spark, sf_dir, "obs_s"))


_TEST = """SELECT contig, variant_a, variant_b, s AS supporting_connections, n AS total_connections, round(p, 6) AS conflicting_configuration_p,
CASE WHEN config < 0 OR fa IS NULL OR fb IS NULL THEN '.' WHEN (config = 0) = (fa = fb) THEN '1' ELSE '0' END AS phase_concordant FROM tests"""


def _tests(case: Case) -> DataFrame:
    return case.tests.select("contig", "variant_a", "variant_b", "supporting_connections", "total_connections", F.round("p", 6).alias("conflicting_configuration_p"), "phase_concordant")


@query("pair_test", R + chain("s") + " " + _TEST)
def pair_test(spark, sf_dir):
    return _tests(Case(spark, sf_dir, "s"))


@query("pair_test_wide", R + chain("b") + " " + _TEST)
def pair_test_wide(spark, sf_dir):
    return _tests(Case(spark, sf_dir, "b"))


@query("binom_p", """WITH x AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, CAST(l_linenumber * 7 AS BIGINT) AS k, CAST(l_discount AS DOUBLE) / 5 + 0.84 AS p FROM lineitem)
SELECT n, k, round(p, 4) AS p, round(CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) END, 6) AS cdf FROM x""")
def binom_p(spark, sf_dir):
    from strandspark.runtime import table

    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("n"), (F.col("l_linenumber") * 7).cast("long").alias("k"), (F.col("l_discount") / 5 + 0.84).alias("p")).distinct()
    return x.select("n", "k", F.round("p", 4).alias("p"), F.round(stats.binomial_cdf(F.col("k"), F.col("n"), F.col("p")), 6).alias("cdf"))


@query("edge_drop", R + chain("s") + " SELECT contig, variant_a, variant_b, config FROM edges")
def edge_drop(spark, sf_dir):
    return E.surviving(Case(spark, sf_dir, "s").tests, THRESHOLD).select("contig", "variant_a", "variant_b", "config")


@query("components", R + chain("p") + " SELECT contig, CAST(pos AS VARCHAR) AS variant_id, CAST(block AS VARCHAR) AS block, CAST(idx AS INT) AS idx FROM bv")
def components(spark, sf_dir):
    return phasing.blocks_of(Case(spark, sf_dir, "p").edges()).select("contig", "variant_id", "block", "idx")


@query("components_wide", R + chain("b", 0.1) + " SELECT contig, block, count(*) AS variants FROM (SELECT contig, CAST(block AS VARCHAR) AS block FROM bv) GROUP BY ALL")
def components_wide(spark, sf_dir):
    return phasing.blocks_of(Case(spark, sf_dir, "b", 0.1).edges()).groupBy("contig", "block").agg(F.count(F.lit(1)).alias("variants"))


@query("unconnected_variants", R + chain("s") + " SELECT contig, variant_id FROM var WHERE (contig, pos) NOT IN (SELECT (contig, pos) FROM bv)")
def unconnected(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    return case.variants.join(phasing.blocks_of(case.edges()).select("contig", "variant_id"), ["contig", "variant_id"], "left_anti").select("contig", "variant_id")


@query("block_phase_small", R + chain("s") + " SELECT contig, variant_id, idx::INT AS idx, hap_a FROM ph")
def block_phase_small(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    return case.phased(case.edges()).select("contig", "variant_id", "idx", "hap_a")


@query("concordant_blocks", R + chain("t") + """, ok AS (SELECT contig, block FROM (SELECT s.contig, s.block, max(s.s) AS top FROM score s GROUP BY ALL) JOIN (SELECT contig, block, count(*) AS n FROM ie GROUP BY ALL) USING (contig, block) WHERE top = n)
SELECT ph.contig, CAST(ph.block AS VARCHAR) AS block, string_agg(CAST(hap_a AS VARCHAR), '' ORDER BY idx) AS hap_a, translate(string_agg(CAST(hap_a AS VARCHAR), '' ORDER BY idx), '01', '10') AS hap_b FROM ph JOIN ok ON ok.contig = ph.contig AND ok.block = ph.block GROUP BY ALL""")
def concordant_blocks(spark, sf_dir):
    case = Case(spark, sf_dir, "t")
    edges = case.edges()
    blocks = written(phasing.blocks_of(edges), "blocks")
    phased = written(phasing.phase(edges, blocks), "phased")
    # of a block that no assignment satisfies whole the stretches may each be satisfied; only whole blocks count
    size = blocks.groupBy("contig", "block").agg(F.count(F.lit(1)).alias("n"))
    own = phased.groupBy("contig", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = H.block_edges(phased, edges).where("edges_supporting = edges_total").join(own.join(size, ["contig", "block", "n"]).select(*H.BLOCK), H.BLOCK, "left_semi")
    text = F.array_join(H.ordered(F.col("hap_a").cast("string")), "")
    out = phased.join(whole, H.BLOCK).groupBy("contig", F.col("part").alias("block")).agg(text.alias("hap_a"))
    return out.withColumn("hap_b", fields.complement(F.col("hap_a")))


@query("weak_points", R + chain("p", 0.1) + """ SELECT bv.contig, CAST(bv.block AS VARCHAR) AS block, CAST(bv.idx AS INT) AS at, count(*) AS crossing
FROM bv JOIN (SELECT e.contig, a.block, a.idx AS ia, b.idx AS ib FROM edges e JOIN bv a ON a.contig = e.contig AND a.pos = pos_a JOIN bv b ON b.contig = e.contig AND b.pos = pos_b) x
  ON x.contig = bv.contig AND x.block = bv.block AND ia < bv.idx AND bv.idx <= ib WHERE bv.idx >= 2 AND bv.idx <= bv.n - 2 GROUP BY ALL""")
def weak_points(spark, sf_dir):
    """Connections over each inner point."""
    case = Case(spark, sf_dir, "p", 0.1)
    nodes, edges = indexed(case)
    n = nodes.groupBy(*splitting.KEY).agg(F.count(F.lit(1)).alias("n"))
    return splitting.crossing_counts(nodes, edges).join(n, splitting.KEY).where("at >= 2 and at <= n - 2 and crossing > 0").select("contig", "block", "at", "crossing")


def indexed(case: Case) -> tuple[DataFrame, DataFrame]:
    """(contig, block, idx) of all connected variants, and connections between their places."""
    edges = case.edges()
    blocks = written(phasing.blocks_of(edges), "blocks")
    at = blocks.select("contig", "variant_id", "block", "idx")
    e = edges.join(at.toDF("contig", "variant_a", "block", "ia"), ["contig", "variant_a"]).join(at.drop("block").toDF("contig", "variant_b", "ib"), ["contig", "variant_b"])
    return blocks.select("contig", "block", "idx"), written(e.select("contig", "block", "ia", "ib", "config"), "block-edges")


#: CTEs after ``chain`` that cut blocks greedily point by point, phase the fragments and merge them in order.
_CUTS = """,
ae AS (SELECT e.contig, a.block, a.idx AS ia, b.idx AS ib, config FROM edges e JOIN bv a ON a.contig = e.contig AND a.pos = pos_a JOIN bv b ON b.contig = e.contig AND b.pos = pos_b),
cross_ AS (SELECT bv.contig, bv.block, bv.n, bv.idx AS spot, count(*) AS c FROM bv JOIN ae ON ae.contig = bv.contig AND ae.block = bv.block AND ia < bv.idx AND bv.idx <= ib WHERE bv.idx >= 2 AND bv.idx <= bv.n - 2 GROUP BY ALL),
turn AS (SELECT contig, block, spot, c, row_number() OVER (PARTITION BY contig, block ORDER BY c, spot) AS k FROM cross_),
greedy AS (
  SELECT contig, block, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS chosen FROM sizes
  UNION ALL SELECT g.contig, g.block, t.k, CASE WHEN list_contains(chosen, t.spot - 1) OR list_contains(chosen, t.spot + 1) THEN chosen ELSE list_append(chosen, t.spot) END FROM greedy g JOIN turn t ON t.contig = g.contig AND t.block = g.block AND t.k = g.k + 1),
picked AS (SELECT contig, block, unnest(chosen) AS spot FROM (SELECT contig, block, arg_max(chosen, k) AS chosen FROM greedy GROUP BY ALL)),
pc AS (SELECT picked.*, c FROM picked JOIN cross_ USING (contig, block, spot)),
lev AS (SELECT s.contig, s.block, s.n, l FROM sizes s JOIN (SELECT contig, block, max(c) AS top FROM cross_ GROUP BY ALL) m USING (contig, block), unnest(range(1, top + 1)) AS u(l)),
ends AS (SELECT lev.contig, lev.block, lev.n, l, spot FROM lev JOIN pc USING (contig, block) WHERE c <= l UNION ALL SELECT contig, block, n, l, 0 FROM lev UNION ALL SELECT contig, block, n, l, n FROM lev),
gaps AS (SELECT contig, block, l, max(spot - before) AS longest FROM (SELECT *, lag(spot) OVER (PARTITION BY contig, block, l ORDER BY spot) AS before FROM ends) GROUP BY ALL),
stop AS (SELECT contig, block, coalesce(min(l) FILTER (longest <= 15), max(l)) AS l FROM gaps GROUP BY ALL),
cuts AS (SELECT pc.contig, pc.block, pc.spot FROM pc JOIN stop USING (contig, block) WHERE c <= l)"""
_STRETCHES = _CUTS + """,
sided AS (SELECT contig, block, pos, 0 AS s FROM bv WHERE idx = 0 UNION SELECT x.contig, x.block, bv.pos, xor(s, config) FROM sided x JOIN bv o ON o.contig = x.contig AND o.pos = x.pos JOIN (SELECT contig, block, ia, ib, config FROM ae UNION ALL SELECT contig, block, ib, ia, config FROM ae) e ON e.contig = x.contig AND e.block = x.block AND e.ia = o.idx AND e.config >= 0 JOIN bv ON bv.contig = e.contig AND bv.block = e.block AND bv.idx = e.ib),
agreed AS (SELECT contig, block FROM sided JOIN sizes USING (contig, block) GROUP BY contig, block, n HAVING count(*) = n AND count(DISTINCT pos) = n),
fr AS (SELECT bv.contig, bv.block, bv.pos, bv.idx, coalesce(max(spot), 0) AS f FROM bv LEFT JOIN cuts ON cuts.contig = bv.contig AND cuts.block = bv.block AND spot <= bv.idx WHERE (bv.contig, bv.block) NOT IN (SELECT (contig, block) FROM agreed) GROUP BY ALL),
fs AS (SELECT contig, block, f, count(*) AS m FROM fr GROUP BY ALL),
fe AS (SELECT e.contig, e.block, e.ia, e.ib, e.config, a.f AS fa, b.f AS fb FROM ae e JOIN fr a ON a.contig = e.contig AND a.block = e.block AND a.idx = ia JOIN fr b ON b.contig = e.contig AND b.block = e.block AND b.idx = ib WHERE config >= 0),
fcode AS (SELECT contig, block, f, m, unnest(range(0, CAST(1 AS BIGINT) << (m - 1))) AS code FROM fs),
fscore AS (SELECT k.contig, k.block, k.f, k.m, code, count(*) FILTER (xor((code >> CAST(m - 1 - (ia - k.f) AS INT)) & 1, (code >> CAST(m - 1 - (ib - k.f) AS INT)) & 1) = config) AS s FROM fcode k LEFT JOIN fe ON fe.contig = k.contig AND fe.block = k.block AND fa = k.f AND fb = k.f GROUP BY ALL),
fbest AS (SELECT contig, block, f, m, CASE WHEN count(*) = 1 THEN max(code) END AS code FROM (SELECT *, max(s) OVER (PARTITION BY contig, block, f) AS top FROM fscore) WHERE s = top GROUP BY ALL),
fx AS (SELECT fr.*, CAST((code >> CAST(m - 1 - (idx - fr.f) AS INT)) & 1 AS INT) AS x FROM fr JOIN fbest b ON b.contig = fr.contig AND b.block = fr.block AND b.f = fr.f),
fw AS (SELECT fe.contig, fe.block, greatest(fa, fb) AS f, least(fa, fb) AS g, sum(CASE WHEN xor(a.x, b.x) = config THEN 1 ELSE -1 END) AS w FROM fe JOIN fx a ON a.contig = fe.contig AND a.block = fe.block AND a.idx = ia JOIN fx b ON b.contig = fe.contig AND b.block = fe.block AND b.idx = ib WHERE fa <> fb AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL),
fl AS (SELECT b.contig, b.block, b.f, code IS NOT NULL AS known, row_number() OVER (PARTITION BY b.contig, b.block ORDER BY b.f) AS k, coalesce(ws, []) AS ws FROM fbest b LEFT JOIN (SELECT contig, block, f, list(struct_pack(g := g, w := w)) AS ws FROM fw GROUP BY ALL) w ON w.contig = b.contig AND w.block = b.block AND w.f = b.f),
merged AS (
  SELECT contig, block, k, f AS spot, f, known, CAST([struct_pack(f := f, o := 0)] AS STRUCT(f BIGINT, o INT)[]) AS held, 0 AS o FROM fl WHERE k = 1
  UNION ALL SELECT contig, block, k, CASE WHEN joins THEN spot ELSE f END, f, known, CASE WHEN joins THEN list_append(held, struct_pack(f := f, o := o)) ELSE [struct_pack(f := f, o := 0)] END, CASE WHEN joins THEN o ELSE 0 END FROM (
    SELECT *, CASE WHEN score < 0 THEN 1 ELSE 0 END AS o, was AND known AND score <> 0 AS joins FROM (
      SELECT n.contig, n.block, n.k, m.spot, n.f, n.known, m.known AS was, m.held,
        coalesce(list_sum(list_transform(n.ws, lambda e: e.w * coalesce(list_sum(list_transform(list_filter(m.held, lambda h: h.f = e.g), lambda h: 1 - 2 * h.o)), 0))), 0) AS score
      FROM merged m JOIN fl n ON n.contig = m.contig AND n.block = m.block AND n.k = m.k + 1)))"""


@query("block_cuts", R + chain("p", 0.1) + _CUTS + " SELECT contig, CAST(block AS VARCHAR) AS block, CAST(spot AS INT) AS at FROM cuts")
def block_cuts(spark, sf_dir):
    """Where blocks are cut so that no fragment is over 15 variants."""
    return splitting.cut_points(*indexed(Case(spark, sf_dir, "p", 0.1)), 15).select("contig", "block", "at")


@query("weak_point_phasing", R + chain("p", 0.1) + _STRETCHES + """
SELECT bv.contig, CAST(min(bv.pos) OVER (PARTITION BY bv.contig, bv.block, st.spot) AS VARCHAR) AS part, CAST(bv.pos AS VARCHAR) AS variant_id, CAST(bv.idx - st.spot AS INT) AS idx, st.hap_a FROM (
  SELECT contig, block, pos, 0 AS spot, s AS hap_a FROM sided WHERE (contig, block) IN (SELECT (contig, block) FROM agreed)
  UNION ALL SELECT fx.contig, fx.block, fx.pos, m.spot, xor(x, o) FROM fx JOIN merged m ON m.contig = fx.contig AND m.block = fx.block AND m.f = fx.f WHERE m.known) st
JOIN bv ON bv.contig = st.contig AND bv.pos = st.pos""")
def weak_point_phasing(spark, sf_dir):
    """Blocks that need splitting and merging."""
    case = Case(spark, sf_dir, "p", 0.1)
    return case.phased(case.edges()).select("contig", "part", "variant_id", "idx", "hap_a")


@query("large_block_phasing", SQL["weak_point_phasing"])
def large_block_phasing(spark, sf_dir):
    """The same phase, with every block in pieces as very large ones are."""
    case = Case(spark, sf_dir, "p", 0.1)
    edges = case.edges()
    return phasing.phase(edges, written(phasing.blocks_of(edges), "blocks"), large=0).select("contig", "part", "variant_id", "idx", "hap_a")


@query("block_edges", R + chain("s") + """ SELECT ph.contig, CAST(ph.block AS VARCHAR) AS block, CAST(count(*) FILTER (xor(a.hap_a, b.hap_a) = config) AS DOUBLE) AS edges_supporting, CAST(count(*) AS DOUBLE) AS edges_total
FROM (SELECT DISTINCT contig, block FROM ph) ph JOIN ie ON ie.contig = ph.contig AND ie.block = ph.block JOIN ph a ON a.contig = ie.contig AND a.block = ie.block AND a.idx = ia JOIN ph b ON b.contig = ie.contig AND b.block = ie.block AND b.idx = ib GROUP BY ALL""")
def block_edges(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    edges = case.edges()
    return H.block_edges(case.phased(edges), edges).withColumnRenamed("part", "block")


def _gw(method: int):
    def run(spark, sf_dir):
        case = Case(spark, sf_dir, "s")
        gw = H.genome_phase(case.phased(case.edges()), case.variants, method)
        return gw.select("contig", F.col("part").alias("block"), F.round("gw_confidence", 9).alias("gw_confidence"), "gw", "phase_concordant", F.round("max_maf", 9).alias("max_maf"))

    return run


_GW = " SELECT contig, CAST(block AS VARCHAR) AS block, round(gw_confidence, 9) AS gw_confidence, CAST(gw AS INT) AS gw, phase_concordant, round(max_maf, 9) AS max_maf FROM gw"
query("gw_majority", R + chain("s") + ", " + gw_sql(0) + _GW)(_gw(0))
query("gw_maf_weighted", R + chain("s") + ", " + gw_sql(1) + _GW)(_gw(1))


@query("hap_counts", R + chain("s") + " SELECT contig, CAST(block AS VARCHAR) AS block, count(DISTINCT read_id) FILTER (hap = 'a') AS reads_hap_a, count(DISTINCT read_id) FILTER (hap = 'b') AS reads_hap_b FROM hr GROUP BY ALL")
def hap_counts(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    return H.reads_per_haplotype(H.haplotype_reads(case.phased(case.edges()), case.obs)).withColumnRenamed("part", "block")


_HAPS = ", " + gw_sql(0) + """,
t AS (SELECT pv.contig, pv.block, min(pos) AS start, max(pos) AS stop, count(*) AS variants, string_agg(rsid, ',' ORDER BY idx) AS variant_ids,
  string_agg(on_a, ',' ORDER BY idx) || '|' || string_agg(on_b, ',' ORDER BY idx) AS variant_alleles,
  string_agg(coalesce(CAST(f AS VARCHAR), '-'), '' ORDER BY idx) || '|' || string_agg(coalesce(CAST(1 - f AS VARCHAR), '-'), '' ORDER BY idx) AS annotated_phase,
  string_agg(coalesce(CAST(coalesce(gw, f) AS VARCHAR), '-'), '' ORDER BY idx) || '|' || string_agg(coalesce(CAST(1 - coalesce(gw, f) AS VARCHAR), '-'), '' ORDER BY idx) AS gw_phase,
  any_value(phase_concordant) AS phase_concordant, any_value(gw_confidence) AS gw_confidence FROM pv JOIN gw ON gw.contig = pv.contig AND gw.block = pv.block GROUP BY ALL),
be AS (SELECT ie.contig, ie.block, count(*) FILTER (xor(a.hap_a, b.hap_a) = config) AS es, count(*) AS et FROM ie JOIN ph a ON a.contig = ie.contig AND a.block = ie.block AND a.idx = ia JOIN ph b ON b.contig = ie.contig AND b.block = ie.block AND b.idx = ib GROUP BY ALL),
hc AS (SELECT contig, block, count(DISTINCT read_id) FILTER (hap = 'a') AS ra, count(DISTINCT read_id) FILTER (hap = 'b') AS rb FROM hr GROUP BY ALL)
SELECT t.contig, start, stop, stop - start AS length, variants, variant_ids, variant_alleles, coalesce(ra, 0) AS reads_hap_a, coalesce(rb, 0) AS reads_hap_b, coalesce(ra, 0) + coalesce(rb, 0) AS reads_total,
  CAST(coalesce(es, 0) AS DOUBLE) AS edges_supporting, CAST(coalesce(et, 0) AS DOUBLE) AS edges_total, annotated_phase, phase_concordant, gw_phase, round(gw_confidence, 9) AS gw_confidence
FROM t LEFT JOIN be ON be.contig = t.contig AND be.block = t.block LEFT JOIN hc ON hc.contig = t.contig AND hc.block = t.block"""


def haplotype_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    case = Case(spark, sf_dir, name)
    edges = case.edges()
    phased = case.phased(edges)
    gw = H.genome_phase(phased, case.variants, 0)
    return H.haplotypes(phased, case.variants, case.obs, edges, gw).withColumn("gw_confidence", F.round("gw_confidence", 9))


@query("haplotypes", R + chain("s") + _HAPS)
def haplotypes(spark, sf_dir):
    return haplotype_table(spark, sf_dir, "s")


_HC = ", " + gw_sql(0) + """,
used AS (SELECT hr.* FROM hr JOIN pv ON pv.contig = hr.contig AND pv.block = hr.block AND pv.variant_id = hr.variant_id WHERE NOT blacklisted),
cnt AS (SELECT contig, block, bam, count(DISTINCT read_id) FILTER (hap = 'a') AS "aCount", count(DISTINCT read_id) FILTER (hap = 'b') AS "bCount" FROM used GROUP BY ALL),
t AS (SELECT pv.contig, pv.block, min(pos) AS start, max(pos) AS stop, coalesce(string_agg(variant_id, ',' ORDER BY idx) FILTER (NOT blacklisted), '') AS variants, count(*) FILTER (NOT blacklisted) AS "variantCount",
  coalesce(string_agg(variant_id, ',' ORDER BY idx) FILTER (blacklisted), '') AS "variantsBlacklisted", count(*) FILTER (blacklisted) AS "variantCountBlacklisted",
  coalesce(string_agg(on_a, ',' ORDER BY idx) FILTER (NOT blacklisted), '') AS "haplotypeA", coalesce(string_agg(on_b, ',' ORDER BY idx) FILTER (NOT blacklisted), '') AS "haplotypeB",
  CASE arg_min(struct_pack(x := coalesce(gw, f)), idx).x WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' ELSE '0/1' END AS "blockGWPhase", any_value(gw_confidence) AS gw_confidence, any_value(max_maf) AS max_maf
  FROM pv JOIN gw ON gw.contig = pv.contig AND gw.block = pv.block GROUP BY ALL)"""


@query("hap_counts_by_bam", R + chain("s") + _HC + """ SELECT t.contig, start, stop, variants, "variantCount", "variantsBlacklisted", "variantCountBlacklisted", "haplotypeA", "haplotypeB", "aCount", "bCount", "aCount" + "bCount" AS "totalCount",
  "blockGWPhase", round(gw_confidence, 9) AS "gwStat", round(max_maf, 9) AS max_haplo_maf, bam FROM t JOIN cnt ON cnt.contig = t.contig AND cnt.block = t.block WHERE "aCount" + "bCount" > 0""")
def hap_counts_by_bam(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    phased = case.phased(case.edges())
    out = H.haplotypic_counts(phased, case.variants, case.obs, H.genome_phase(phased, case.variants, 0))
    return out.drop("aReads", "bReads").withColumns({"gwStat": F.round("gwStat", 9), "max_haplo_maf": F.round("max_haplo_maf", 9)})


@query("read_index_lists", R + chain("s") + _HC + """, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY contig, block, bam, hap ORDER BY read_id) - 1 AS r FROM used),
per AS (SELECT contig, block, bam, variant_id, idx, string_agg(DISTINCT CASE WHEN hap = 'a' THEN r END, ',' ORDER BY CASE WHEN hap = 'a' THEN r END) AS a, string_agg(DISTINCT CASE WHEN hap = 'b' THEN r END, ',' ORDER BY CASE WHEN hap = 'b' THEN r END) AS b FROM ranked GROUP BY ALL),
grid AS (SELECT pv.contig, pv.block, variant_id, idx, bam FROM pv JOIN (SELECT DISTINCT contig, block, bam FROM used) u ON u.contig = pv.contig AND u.block = pv.block WHERE NOT blacklisted)
SELECT grid.contig, CAST(min(CAST(grid.block AS BIGINT)) AS VARCHAR) AS block, grid.bam, string_agg(coalesce(a, ''), ';' ORDER BY grid.idx) AS "aReads", string_agg(coalesce(b, ''), ';' ORDER BY grid.idx) AS "bReads"
FROM grid LEFT JOIN per ON per.contig = grid.contig AND per.block = grid.block AND per.bam = grid.bam AND per.variant_id = grid.variant_id GROUP BY grid.contig, grid.block, grid.bam""")
def read_index_lists(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    phased = case.phased(case.edges())
    out = H.haplotypic_counts(phased, case.variants, case.obs, H.genome_phase(phased, case.variants, 0))
    first = phased.where("idx = 0").select("contig", F.col("pos").alias("start"), F.col("part").alias("block"))
    return out.join(first, ["contig", "start"]).select("contig", "block", "bam", "aReads", "bReads")


@query("allele_config", R + chain("s") + """ SELECT a.variant_id AS variant_a, a.rsid AS rsid_a, b.variant_id AS variant_b, b.rsid AS rsid_b,
  CASE WHEN (a.on_a = a.ref) = (b.on_b = b.ref) THEN 'trans' ELSE 'cis' END AS configuration FROM pv a JOIN pv b ON a.contig = b.contig AND a.block = b.block AND a.variant_id <> b.variant_id""")
def allele_config(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    return H.allele_config(case.phased(case.edges()), case.variants)


_LINKS = ", ".join(f"({i}, {j}, {m}, 'c{i if not m else 1 - i}{j if not m else 1 - j}')" for m in (0, 1) for i in (0, 1) for j in (0, 1))


@query("network_links", R + chain("s") + f""", x(i, j, inferred, c) AS (VALUES {_LINKS})
SELECT variant_a || ':' || i AS "variantA", variant_b || ':' || j AS "variantB", CASE c WHEN 'c00' THEN c00 WHEN 'c01' THEN c01 WHEN 'c10' THEN c10 ELSE c11 END AS connections, inferred
FROM cells JOIN ph a ON a.contig = cells.contig AND a.variant_id = variant_a JOIN ph b ON b.contig = cells.contig AND b.variant_id = variant_b AND b.block = a.block CROSS JOIN x
WHERE CASE c WHEN 'c00' THEN c00 WHEN 'c01' THEN c01 WHEN 'c10' THEN c10 ELSE c11 END > 0""")
def network_links(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    return H.network_links(E.pair_cells(case.obs), case.phased(case.edges()))


@query("network_nodes", R + chain("s") + f""", x(i, j, inferred, c) AS (VALUES {_LINKS}),
l AS (SELECT a.contig, a.variant_id AS va, i, b.variant_id AS vb, j FROM cells JOIN ph a ON a.contig = cells.contig AND a.variant_id = variant_a JOIN ph b ON b.contig = cells.contig AND b.variant_id = variant_b AND b.block = a.block CROSS JOIN x
  WHERE CASE c WHEN 'c00' THEN c00 WHEN 'c01' THEN c01 WHEN 'c10' THEN c10 ELSE c11 END > 0),
n AS (SELECT va AS v, i AS a FROM l UNION SELECT vb, j FROM l)
SELECT v || ':' || a AS id, CAST(idx AS INT) AS index, CASE WHEN a = hap_a THEN 'A' ELSE 'B' END AS assigned_hap FROM n JOIN ph ON ph.variant_id = v""")
def network_nodes(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    phased = case.phased(case.edges())
    return H.network_nodes(H.network_links(E.pair_cells(case.obs), phased), phased)


@query("singletons", R + chain("s") + """, c AS (SELECT contig, variant_id, count(DISTINCT read_id) FILTER (cls = 0) AS ra, count(DISTINCT read_id) FILTER (cls = 1) AS rb FROM obs WHERE cls < 2 GROUP BY ALL)
SELECT contig, pos - 1 AS start, pos AS stop, rsid AS variant_ids, ref || '|' || alt AS variant_alleles, ra AS reads_hap_a, rb AS reads_hap_b, ra + rb AS reads_total, coalesce(CAST(phase0 AS VARCHAR) || '|' || CAST(1 - phase0 AS VARCHAR), '-|-') AS annotated_phase
FROM var JOIN c USING (contig, variant_id) WHERE (contig, variant_id) NOT IN (SELECT (contig, variant_id) FROM ph)""")
def singletons(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    out = H.singleton_haplotypes(case.variants, case.phased(case.edges()), case.obs)
    return out.select("contig", "start", "stop", "variant_ids", "variant_alleles", "reads_hap_a", "reads_hap_b", "reads_total", "annotated_phase")


@query("singleton_counts", R + chain("s") + """, c AS (SELECT contig, variant_id, bam, count(DISTINCT read_id) FILTER (cls = 0) AS ra, count(DISTINCT read_id) FILTER (cls = 1) AS rb FROM obs WHERE cls < 2 AND bam <> 1 GROUP BY ALL)
SELECT contig, pos AS start, variant_id AS variants, ra AS "aCount", rb AS "bCount", ra + rb AS "totalCount", CASE phase0 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' ELSE '0/1' END AS "blockGWPhase", round(maf, 9) AS max_haplo_maf, bam
FROM var JOIN c USING (contig, variant_id) WHERE NOT blacklisted AND (contig, variant_id) NOT IN (SELECT (contig, variant_id) FROM ph)""")
def singleton_counts(spark, sf_dir):
    case = Case(spark, sf_dir, "s")
    out = H.singleton_counts(case.variants, case.phased(case.edges()), case.obs, excluded=(1,))
    return out.select("contig", "start", "variants", "aCount", "bCount", "totalCount", "blockGWPhase", F.round("max_haplo_maf", 9).alias("max_haplo_maf"), "bam")


@query("bam_name_dedup", f"""WITH b AS (SELECT bam, regexp_replace(list_extract(string_split(path, '/'), -1), '\\.bam$', '') AS base FROM ({duck("bams")}))
SELECT bam, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '.' || row_number() OVER (PARTITION BY base ORDER BY bam) ELSE base END AS name FROM b""")
def bam_name_dedup(spark, sf_dir):
    return E.bam_names(view(spark, sf_dir, "bams"))


@query("union_contigs", f"""SELECT contig, pos, variant_id, rsid FROM ({duck("var_s")}) ORDER BY contig, pos""")
def union_contigs(spark, sf_dir):
    v = view(spark, sf_dir, "var_s").select("contig", "pos", "variant_id", "rsid")
    even, odd = v.where(F.col("contig").cast("int") % 2 == 0), v.where(F.col("contig").cast("int") % 2 == 1)
    return even.unionByName(odd).orderBy("contig", "pos")


_OVER = f"WITH p AS ({duck('points')}), s AS ({duck('spans')}) "


@query("blacklist_anti", f"""WITH v AS ({duck("var_s")}), x AS ({duck("bans")}) SELECT contig, variant_id, pos FROM v WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.contig = v.contig AND pos - 1 < stop AND start < pos)""")
def blacklist_anti(spark, sf_dir):
    v = view(spark, sf_dir, "var_s").select("contig", "variant_id", "pos", (F.col("pos") - 1).alias("site"))
    return intervals.not_overlapping(v, view(spark, sf_dir, "bans"), ["contig", "variant_id"], ["contig"], "site", "pos", "start", "stop", 50).drop("site")


@query("blacklist_semi", f"""WITH v AS ({duck("var_s")}), x AS ({duck("bans")}) SELECT contig, variant_id, pos FROM v WHERE EXISTS (SELECT 1 FROM x WHERE x.contig = v.contig AND pos - 1 < stop AND start < pos)""")
def blacklist_semi(spark, sf_dir):
    v = view(spark, sf_dir, "var_s").select("contig", "variant_id", "pos", (F.col("pos") - 1).alias("site"))
    return intervals.overlapping(v, view(spark, sf_dir, "bans"), ["contig", "variant_id"], ["contig"], "site", "pos", "start", "stop", 50).drop("site")


@query("feature_overlap", _OVER + "SELECT s.contig, span_id, count(*) AS points, CAST(sum(event_id) AS BIGINT) AS total FROM s JOIN p ON s.contig = p.contig AND start < next_spot AND spot < stop GROUP BY ALL")
def feature_overlap(spark, sf_dir):
    """Points in long spans: whole bins by their sums, single points at the ends only."""
    sums = {"points": F.lit(1), "total": F.col("event_id")}
    return intervals.point_sums(view(spark, sf_dir, "spans"), view(spark, sf_dir, "points"), ["contig", "span_id"], ["contig"], "start", "stop", "spot", sums, 64)
