"""Readers and writers by round trip: given tables are written in each format and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..session import shared_dir, table
from ..sources import readers, writers
from . import query

SHARD_ROWS = 10_000
"""Rows of one document, about: a document is one string when written and one task when read."""
LEAST_SHARDS = 16


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _sharded(rows: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """``rows`` dealt by key over as many shards as the rows of ``source`` ask for, with the number of the shard."""
    shards = max(LEAST_SHARDS, -(-source.count() // SHARD_ROWS))
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).repartition(shards, "shard")


def _write_shards(rows: DataFrame, document, path: str) -> str:
    """One document per shard, each in its own file; ``document`` makes it from the shard's rows."""
    rows.groupBy("shard").agg(document.alias("value")).write.partitionBy("shard").text(path)
    return path


@query(
    "region_store",
    """
select cast(n_nationkey as varchar) as id, lpad(cast(n_nationkey as varchar), 3, '0') as code, n_name as name,
  case when n_nationkey % 2 = 0 then 'x' else '' end as type, r_name as area, 'http://h/' || n_name as zsjz_url
from nation join region on r_regionkey = n_regionkey
""",
)
def region_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their institutions as nested documents, read back flat."""
    key = F.col("n_nationkey").cast("string")
    school = F.struct(
        key.alias("id"), F.lpad(key, 3, "0").alias("code"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, "x").alias("yxtx"), F.concat(F.lit("http://h/"), "n_name").alias("zsjz"),
    )
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = rows.groupBy("r_regionkey", "r_name").agg(F.collect_list(school).alias("schools"))
    one = F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("areaName"), "schools")).alias("data")))
    return readers.read_regions(spark, _write_shards(_sharded(regions, "r_regionkey", regions), one, _folder(spark, "regions")))


@query(
    "region_supplier_store",
    """
select cast(s_suppkey as varchar) as id, lpad(cast(n_nationkey as varchar), 3, '0') as code, s_name as name,
  case when s_suppkey % 2 = 0 then 'x' else '' end as type, r_name as area, 'http://h/' || s_suppkey as zsjz_url
from supplier join nation on s_nationkey = n_nationkey join region on r_regionkey = n_regionkey
""",
)
def region_supplier_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of any number of institutions; a region lies in as many documents as it needs."""
    key = F.col("s_suppkey").cast("string")
    school = F.struct(
        key.alias("id"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("code"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, "x").alias("yxtx"), F.concat(F.lit("http://h/"), key).alias("zsjz"),
    )
    supplier = table(spark, sf_dir, "supplier")
    rows = supplier.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = _sharded(rows, "s_suppkey", supplier).groupBy("shard", "r_regionkey", "r_name").agg(F.collect_list(school).alias("schools"))
    one = F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("areaName"), "schools")).alias("data")))
    return readers.read_regions(spark, _write_shards(regions, one, _folder(spark, "regions")))


@query(
    "institution_store",
    "select cast(s_suppkey as varchar) as id, s_name as name, cast(s_nationkey as varchar) as area from supplier where s_suppkey % 5 <> 0",
)
def institution_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution arrays; rows with a blank id go."""
    row = F.struct(
        F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("area"),
    )
    supplier = table(spark, sf_dir, "supplier")
    path = _write_shards(_sharded(supplier, "s_suppkey", supplier), F.to_json(F.collect_list(row)), _folder(spark, "institutions"))
    return readers.read_institutions(spark, path).select("id", "name", "area")


@query(
    "result_store",
    """
select cast(c_custkey as varchar) as school_id, c_name as school_name, case when c_acctbal > 0 then 'success' else 'failed' end as status,
  cast(floor(c_acctbal) as integer) as raw_text_length, c_mktsegment || '|' || c_name as majors, true as stamped from customer
""",
)
def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, K1: a keyed result store read into rows, written as a new version and read again."""
    value = F.struct(
        F.col("c_name").alias("school_name"),
        F.when(F.col("c_acctbal") > 0, "success").otherwise("failed").alias("status"),
        F.floor("c_acctbal").cast("int").alias("raw_text_length"),
        F.struct(F.lit(True).alias("found"), F.array("c_mktsegment", "c_name").alias("majors")).alias("extraction"),
    )
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), value)))
    document = F.to_json(F.struct(F.lit("x").alias("last_updated"), entries.alias("schools")))
    customer = table(spark, sf_dir, "customer")
    store = readers.read_results(spark, _write_shards(_sharded(customer, "c_custkey", customer), document, _folder(spark, "results")))
    version = _folder(spark, "version")
    writers.write_store(store, version)
    again = readers.read_table(spark, version)
    return again.select(
        "school_id", "school_name", "status", "raw_text_length", F.array_join("extraction.majors", "|").alias("majors"),
        F.col("last_updated").isNotNull().alias("stamped"),
    )


@query(
    "program_store",
    """
select lpad(cast(p_partkey as varchar), 6, '0') as program_code, 'A' || p_partkey as apply_code, cast(y.y as integer) as year,
  cast(p_size + y.y as integer) as page, p_type as kind
from part, (values (112), (113)) y(y) where p_partkey % 2 = 0 or y.y = 113
""",
)
def program_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories nested to one document per programme, stored, read and unnested again."""
    part = table(spark, sf_dir, "part").withColumn("program_code", F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    years = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(112), F.lit(113))).otherwise(F.array(F.lit(113)))
    # Codes have six digits, so from a million parts on programmes share theirs: the second code tells them apart.
    apply_code = F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("apply_code")
    base = part.select("program_code", apply_code)
    star = part.select("program_code", apply_code, F.col("p_type").alias("kind"), "p_size", F.explode(years).alias("year"))
    star = star.select("program_code", "apply_code", "year", (F.col("p_size") + F.col("year")).alias("page"), "kind")
    taken = base.select("apply_code", F.lit(113).alias("year"), F.lit("q").alias("quota_type"))
    documents = writers.program_documents(base, star, taken)
    pair = F.concat(F.lit('"'), F.get_json_object("document", "$.apply_code"), F.lit('":'), "document")
    whole = F.concat(F.lit('{"programs":{'), F.array_join(F.collect_list(pair), ","), F.lit("}}"))
    store = readers.read_programs(spark, _write_shards(_sharded(documents, "program_code", part), whole, _folder(spark, "programs")))
    return readers.history_long(store, "star_history").select("program_code", "apply_code", "year", "page", "kind")


@query(
    "fragment_cache",
    """
select o_orderkey, cast(year(o_orderdate) as integer) as year, substr(o_orderpriority, 1, 1) as school_code,
  case when year(o_orderdate) = 1995 then 'new' else 'old' end as v, true as from_partition
from orders
""",
)
def fragment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned cache of which one year is written again."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).alias("school_code"), F.lit("old").alias("v")
    )
    root = _folder(spark, "fragments")
    writers.write_fragments(rows, root)
    writers.write_fragments(rows.filter("year = 1995").withColumn("v", F.lit("new")), root)
    found = readers.read_fragments(spark, root, "o_orderkey bigint, v string, year int, school_code string")
    same = F.col("fragment").contains(F.concat(F.lit("year="), F.col("year").cast("string"), F.lit("/school_code="), "school_code"))
    return found.select("o_orderkey", "year", "school_code", "v", same.alias("from_partition"))


@query(
    "csv_round_trip",
    """
select c_custkey, c_name || ', "' || c_mktsegment || '"' as note, form from customer, (values ('plain'), ('quoted')) f(form)
""",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: CSV with a BOM, and with every cell quoted, read back."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("note")
    )
    out = []
    for form, quoted in (("plain", False), ("quoted", True)):
        path = _folder(spark, "csv")
        writers.write_csv(rows, path, ["c_custkey", "note"], quote_all=quoted, bom=not quoted)
        back = spark.read.option("header", True).option("escape", '"').csv(path)
        back = back.toDF("c_custkey", "note").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "note", F.lit(form).alias("form"))
        out.append(back)
    return out[0].unionByName(out[1])


@query(
    "history_payload",
    """
select cast(year(o_orderdate) as integer) as year, count(*) as n, cast(min(o_orderkey) as bigint) as first_key,
  count(*) filter (o_orderstatus = 'F') as done
from orders group by year(o_orderdate)
""",
)
def history_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: flat rows and their summary side by side, read back and joined."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    summary = rows.groupBy("year").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    path = _folder(spark, "history")
    writers.write_history(rows, summary, path)
    flat = readers.read_table(spark, f"{path}/rows").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))
    return flat.join(readers.read_table(spark, f"{path}/summary"), "year").select("year", "n", "first_key", "done")


@query("json_report", "select count(*) as total, count(*) filter (c_acctbal > 0) as good, max(c_custkey) as last from customer")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: a report document of aggregates, written as text and parsed again."""
    customer = table(spark, sf_dir, "customer")
    path = _folder(spark, "report")
    report = writers.report_row(customer, total=F.count(F.lit(1)), good=F.count_if(F.col("c_acctbal") > 0), last=F.max("c_custkey"))
    writers.write_json_rows(report, path)
    parsed = spark.read.text(path).select(F.from_json("value", "total bigint, good bigint, last bigint").alias("r"))
    return parsed.select("r.*")


@query("name_list", "select distinct p_name as value from part")
def name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: distinct names, one per line."""
    path = _folder(spark, "names")
    writers.write_names(table(spark, sf_dir, "part"), "p_name", path)
    return spark.read.text(path)


@query(
    "report_files",
    """
with r as (select p_partkey, p_size as pos, lpad(cast(p_partkey % 40 as varchar), 3, '0') as code, p_name, p_partkey % 3 as form from part
           where p_partkey % 5 <> 0),
l as (select *, case when form = 0 then code else '' end as named, 'http://h/Standard_' || code || '.pdf' as pdf_url from r),
f as (select *, row_number() over (partition by named, pdf_url order by p_partkey, pos) as rn from l)
select 112 as year, code as school_code, p_name as school_name, pdf_url from f where rn = 1
""",
)
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files of index links; the code comes from the text, else from the URL."""
    code = F.lpad((F.col("p_partkey") % 40).cast("string"), 3, "0")
    links = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").alias("pos"),
        F.when(F.col("p_partkey") % 5 == 0, "list.html").otherwise("report.PDF").alias("href"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("("), code, F.lit(") "), "p_name")).otherwise(F.col("p_name")).alias("link_text"),
        F.concat(F.lit("http://h/Standard_"), code, F.lit(".pdf")).alias("link_url"),
    )
    return pages.report_files(links, "p_partkey", F.lit(112))


@query(
    "catalog_rows",
    """
select s_suppkey, lpad(cast(s_suppkey as varchar), 5, '0') as program_code, s_name as school_name, 'Prog ' || s_nationkey as program_name,
  s_nationkey as grp from supplier
""",
)
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold catalogue entries with a five-digit code; the first entry of a code wins."""
    code = F.concat(F.lit("("), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(")"))
    html = F.concat(
        F.lit("<p><b>no code</b><b>"), "s_name", F.lit("<br>Prog "), F.col("s_nationkey").cast("string"), code,
        F.lit("</b><strong>Other<br>Late "), code, F.lit("</strong></p>"),
    )
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("grp"), html.alias("html"))
    return pages.catalog_rows(df, "s_suppkey", "html", "grp")


@query(
    "distribution_rows",
    """
select o_orderkey, apply_code, dept_name, quota_type, min_distribution from (
  select o_orderkey, lpad(cast(o_custkey as varchar), 6, '0') as apply_code, o_orderpriority as dept_name, o_orderstatus as quota_type,
    'd' || o_orderkey as min_distribution, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1
""",
)
def distribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed rows of distribution tables; the last row of a code wins."""
    cells = ["o_orderpriority", "o_orderstatus", F.lit("x"), F.lit("y"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))]
    code = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    row = F.concat(F.lit("<tr><td>"), code, *[x for c in cells for x in (F.lit("</td><td>"), c)], F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>code</th></tr><tr><td>1</td><td>2</td></tr>"), row, F.lit("</table>"))
    return pages.distribution_rows(table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html")), "o_orderkey", "html")
