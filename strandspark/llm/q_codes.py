"""Query and SQL of vector code compression."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.codes import CodeConfig, compress, with_label_error
from strandspark.runtime import ship, table

NAME = "op12_vector_codes"
CONFIG = CodeConfig()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    done = compress(table(spark, sf_dir, "embeddings"), CONFIG)
    return with_label_error(done.rows).select("vec_id", "code", "error", "label_error", F.lit(done.sha256()).alias("codebooks_sha256"))


def sql(config: CodeConfig = CONFIG) -> str:
    """Plain Lloyd rounds: all distances in each."""
    out = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({config.scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {config.parts}) + 1 : (p + 1) * (len(x) // {config.parts})] AS x FROM v CROSS JOIN (SELECT unnest(range({config.parts})) AS p)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v QUALIFY e < {config.entries}),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM q JOIN s ON s.r = q.r)"""
    d = "CAST(list_sum(list_transform(list_zip(q.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(config.rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT r, p, x, (min(struct_pack(d := d, e := e))).e AS e, min(d) AS d FROM (SELECT q.r, q.p, q.x, b.e, {d} AS d FROM q JOIN b{i} b ON b.p = q.p) GROUP BY r, p, x)"""
        if i < config.rounds:
            out += f""",
m{i} AS (SELECT p, e, list(CAST(floor(CAST(t AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS c FROM (SELECT p, e, j, sum(c) AS t, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY ALL) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)"""
    n = config.rounds
    return (
        out
        + f""",
k AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{n} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{n})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN k ON k.r = v.r CROSS JOIN books"""
    )


SQL = sql()
