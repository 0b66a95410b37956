"""Nested JSON, keyed stores and cached fragments as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocab as V

SUBJECT = "struct<standard:string,min_score:int>"
SUBJECTS = "struct<" + ",".join(f"{k}:{SUBJECT}" for k in V.SUBJECT_KEYS) + ">"
DEPARTMENT = f"struct<department:string,subjects:{SUBJECTS},notes:string,majors:array<string>>"
EXTRACTION = (
    f"struct<found:boolean,year:int,application_deadline:string,general_requirements:{SUBJECTS},"
    f"department_requirements:array<{DEPARTMENT}>,other_conditions:array<string>,contact:string,notes:string,"
    "confidence:string,majors:array<string>,error:string>"
)
RESULT = (
    "struct<school_id:string,school_name:string,area:string,type:string,tier:string,tier_source:string,"
    "taiwan_recognized:boolean,taiwan_source:string,processed_at:string,source_url:string,source:string,status:string,"
    "error:string,raw_text_length:int,related_links:array<struct<url:string,text:string,score:int,is_attachment:boolean>>,"
    f"image_links:array<string>,extraction:{EXTRACTION}>"
)
INSTITUTION = "id string, code string, name string, type string, area string, zsjz_url string, tier string, tier_source string, taiwan_recognized boolean, taiwan_source string"
REGIONS = "data array<struct<areaName:string,schools:array<struct<id:string,code:string,name:string,yxtx:string,zsjz:string>>>>"
VALUE = "struct<num:double,txt:string>"
PROGRAM = (
    "struct<program_code:string,school_code:string,star_group:int,school_name:string,program_name:string,apply_code:string,"
    "star_current:struct<requirements:map<string,string>,tie_break_items:array<string>,group_name:string>,"
    f"star_history:map<string,struct<page:int,kind:string,round1:array<string>,round2:array<string>>>,"
    "apply_current:struct<stage1:array<struct<subject:string,standard:string,multiplier:string>>,tie_break:string>,"
    "apply_history:map<string,struct<dept_name:string,quota_type:string,min_distribution:string>>,"
    "apply_sieve_history:map<string,struct<min_orders:array<struct<order:int,expr:string,min_score:int,raw:string>>,oversubscribe:boolean>>>"
)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region document flattened to one row per institution."""
    doc = spark.read.schema(REGIONS).option("multiLine", True).json(path)
    region = doc.select(F.explode("data").alias("r"))
    return region.select(F.col("r.areaName").alias("area"), F.explode("r.schools").alias("s")).select(
        "s.id",
        "s.code",
        "s.name",
        F.coalesce("s.yxtx", F.lit("")).alias("type"),
        F.coalesce("area", F.lit("")).alias("area"),
        F.col("s.zsjz").alias("zsjz_url"),
    )


def read_institutions(spark: SparkSession, path: str) -> DataFrame:
    """Institution array; ids become strings, blank ids go."""
    rows = spark.read.schema(INSTITUTION).option("multiLine", True).json(path)
    return rows.withColumn("id", F.trim("id")).filter("id <> ''")


def _keyed(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """A keyed document as (key, value) rows. ``path`` may be many store files: one
    document is one task, so large stores are written as shards (see writers)."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{field} map<string,{value}>").alias("d"))
    return doc.select(F.explode(f"d.{field}").alias("key", "v"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """S3: keyed result store to one row per institution."""
    rows = _keyed(spark, path, "schools", RESULT)
    return rows.select(
        F.coalesce("v.school_id", "key").alias("school_id"),
        *[F.col(f"v.{x}").alias(x) for x in _fields(RESULT) if x != "school_id"],
    )


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """Programme document to one row per programme."""
    rows = _keyed(spark, path, "programs", PROGRAM)
    return rows.select(
        F.coalesce("v.program_code", "key").alias("program_code"),
        *[F.col(f"v.{x}").alias(x) for x in _fields(PROGRAM) if x != "program_code"],
    )


def history_long(programs: DataFrame, column: str) -> DataFrame:
    """A per-year map as one row per (programme, year)."""
    return programs.select("program_code", "apply_code", F.explode(column).alias("_y", "_e")).select(
        "program_code", "apply_code", F.col("_y").cast("int").alias("year"), "_e.*"
    )


KEYWORD_GROUP = "struct<label:string,keywords:array<string>>"
REFERENCE_SET = "name string, set_name string, precedence int"


def read_keyword_groups(spark: SparkSession, path: str) -> DataFrame:
    """Documents ``{"groups": {id: {"label": …, "keywords": […]}}}`` to (group_name, label, keyword) rows."""
    rows = _keyed(spark, path, "groups", KEYWORD_GROUP)
    return rows.select(F.col("key").alias("group_name"), "v.label", F.explode("v.keywords").alias("keyword"))


def read_reference_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, set_name, precedence) rows, one JSON object a line; rows without a name or a set go."""
    return spark.read.schema(REFERENCE_SET).json(path).filter("name is not null and set_name is not null")


def read_fragments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Partitioned fragment folders (year=…/school_code=…), with the file each row came from."""
    return spark.read.schema(schema).json(root).select("*", F.col("_metadata.file_path").alias("fragment"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Harvested pages and documents."""
    return spark.read.parquet(path)


def _fields(ddl: str) -> list[str]:
    return StructType.fromDDL("r " + ddl)["r"].dataType.fieldNames()
