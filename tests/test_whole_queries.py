"""Registered queries do not leave out a part of their input."""

from __future__ import annotations

import os

import pyspark.sql.functions as F

from kgloom.plans import catalog
from kgloom.session import table

SF = "/root/testdata/sf0.001"


def test_references_of_every_violated_rule(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "part.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    part = table(spark, SF, "part")
    dear = part.agg(F.min("p_partkey")).first()[0]
    part.withColumn("p_retailprice", F.when(F.col("p_partkey") == dear, F.lit(1900.5)).otherwise(F.col("p_retailprice").cast("double")).cast(part.schema["p_retailprice"].dataType)).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.rule_source_refs(spark, str(tmp_path)).where("rule_id = 'r2'")
    regions = table(spark, SF, "region").count()
    assert got.count() == regions > 0 and got.where("source_ref LIKE '% · retailPrice = 1900.5%'").count() == regions


def test_texts_of_every_format_are_converted(spark):
    d = table(spark, SF, "documents").where(F.col("text").isNotNull())
    assert d.where("source_format IS DISTINCT FROM 'md'").count() > 0
    assert catalog.converted_documents(spark, SF).count() == d.count()
    assert "converted_documents" in catalog.oracle_sql()
