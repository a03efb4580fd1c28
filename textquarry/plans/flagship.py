"""The flagship query: integration, providers and findings of each application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import detectors as D
from textquarry.plans import overlay
from textquarry.plans.detection import INTEGRATION, LEX, PROVIDERS
from textquarry.sources.staging import staged


def app_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = overlay.sources(spark, sf_dir)
    lexical = staged(D.lexical_matches(src))  # small rows, from which all below is made
    providers = staged(D.detected_providers(lexical))
    confirmed = D.integration(lexical, D.structural_evidence(src, providers))
    counts = D.dedup_findings(D.lexical_findings(lexical)).groupBy("app_id").agg(F.count_if(F.col("kind") == "llm_endpoint").alias("n_endpoints"), F.count_if(F.col("kind") == "llm_sdk_reference").alias("n_sdk_references"))
    apps = src.select("app_id").distinct()
    joined = apps.join(confirmed, "app_id", "left").join(providers, "app_id", "left").join(counts, "app_id", "left")
    return joined.select("app_id", F.coalesce("confirmed", F.lit(False)).alias("is_llm_integrated"), F.coalesce(F.array_join("detected_providers", "|"), F.lit("")).alias("providers"), F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"), F.coalesce("n_sdk_references", F.lit(0)).alias("n_sdk_references"))


SQL = f"""WITH {LEX}, {PROVIDERS}, {INTEGRATION},
found AS (SELECT DISTINCT app_id, is_endpoint, provider, matched FROM lex),
counts AS (SELECT app_id, count(*) FILTER (is_endpoint) AS e, count(*) FILTER (NOT is_endpoint) AS s FROM found GROUP BY 1)
SELECT a.app_id, coalesce(confirmed, false) AS is_llm_integrated, coalesce(providers, '') AS providers, coalesce(e, 0) AS n_endpoints, coalesce(s, 0) AS n_sdk_references
FROM (SELECT DISTINCT app_id FROM sources) a LEFT JOIN integ USING (app_id) LEFT JOIN prov USING (app_id) LEFT JOIN counts USING (app_id)"""
