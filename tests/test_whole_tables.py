"""Queries take their whole tables."""

from strandspark.plans.adapters import view

SF = "/root/testdata/sf0.001"


def test_points(spark):
    assert view(spark, SF, "points").count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_coding(spark):
    assert view(spark, SF, "coding").count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_bams(spark):
    assert view(spark, SF, "bams").count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_resamples(spark, monkeypatch):
    from strandspark.plans import study_queries

    seen = []
    monkeypatch.setattr(study_queries.cis_effect, "effects", lambda rows, pairs, config: seen.append(config.bs) or rows)
    study_queries.cis_var_effects(spark, SF)
    assert seen == [10_000]
