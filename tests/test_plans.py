"""Physical-plan properties that matter at scale (checked on executedPlan)."""

import re

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))


def test_cleaned_table_is_one_pruned_scan(spark):
    p = _plan(spark, "clean_flows")
    assert _exchanges(p) == 0 and p.count("FileScan parquet") == 1
    assert "props:string" in p and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string>" in p


def test_first_rows_per_file_limit_before_shuffle(spark):
    p = _plan(spark, "head_per_file")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_documents_text_never_read(spark):
    p = _plan(spark, "target_encode")
    for schema in re.findall(r"ReadSchema: (struct<[^>]*>)", p):
        assert "text" not in schema


def test_crosstab_single_exchange(spark):
    assert _exchanges(_plan(spark, "crosstab_proto_label")) == 1


def test_roc_reads_materialised_scores(spark):
    assert "FileScan parquet" not in _plan(spark, "roc_curve")


def test_split_rank_no_single_partition(spark):
    p = _plan(spark, "stratified_split")
    assert "SinglePartition" not in p
