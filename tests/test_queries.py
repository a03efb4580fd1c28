"""Queries against their SQL on the smallest tables."""

import math
import os

import pytest

from textquarry.plans import catalogue

SF = "/root/testdata/sf0.001"
#: One or two of each group; the rest are compared by the driver.
SOME = ["a7_index_read", "a32_evidence_text", "j1_bounded_run", "j9_retention", "d16_finding_counters", "d17_prevalence", "j1_event_stream", "i1_lexical_endpoints", "b3_llm_confirmed", "e1_dedup_findings", "i8_rag_paths", "h15_classify_prompt", "h2_ai_signals", "e2_dedup_by_package", "e6_largest_remainder", "l1_stratified_sample", "j2_ledger_state", "c3_confusion", "d11_credential_summary", "d5_by_provider_and_kind", "h30_wilson", "f7_content_order", "i6_prompt_components", "d18_sensitivity_of_findings", "h11_match_offsets", "a13_a21_result_documents", "j2_state_stream_totals", "a18_d25_audit_tally"]


def plain(x):
    if hasattr(x, "isoformat"):
        return str(x)
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are needed")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    b = sorted(repr([plain(x) for x in r]) for r in want.fetchall())
    assert a == b
    assert a


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
