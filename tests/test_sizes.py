"""What only shows on larger tables: ids beyond the width of a code."""

import duckdb
from oracle_check import compare

import __spark_entry__ as contract


def check(name, table, select, spark, sf, path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace ({select}) from '{sf}/{table}.parquet') to '{path}/{table}.parquet' (format parquet)")
    con.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    ok, message = compare(name, contract.queries()[name], contract.oracle_sql()[name], spark, con, str(path))
    assert ok, message


def test_programmes_that_share_a_code_keep_their_histories(spark, sf, tmp_path):
    check("program_store", "part", "p_partkey % 100 + case when p_partkey < 100 then 100000 else 1000000 end as p_partkey", spark, sf, tmp_path)


def test_codes_of_several_places_read_the_words_of_each(spark, sf, tmp_path):
    ids = "event_id % 100 + case when event_id < 500 then 100000 else 1000000 + event_id // 100 * 100 end as event_id, event_id % 4 as user_id"
    check("sieve_boxes", "events", ids, spark, sf, tmp_path)


def test_costly_rows_of_one_row_group_are_dealt_over_all_cores(spark, sf):
    from cutline.plans import evaluation, shapes

    cores = spark.sparkContext.defaultParallelism
    assert shapes.record_normalise(spark, sf).rdd.getNumPartitions() >= cores
    assert evaluation.part_rows(spark, sf).rdd.getNumPartitions() >= cores


def test_catalogues_are_read_without_a_join(spark, sf):
    from cutline.plans import shapes

    plan = shapes.dated_catalogue(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
