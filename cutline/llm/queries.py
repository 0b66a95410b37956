"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, decontam, htmltext, langid, licences, lm, mixing, neardup, negatives, packing, spelling, toolcalls, toxicity
from .frames import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


LEAKS_SQL = r"""
WITH dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
bt AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM benchmark),
masks(mk, offs) AS (VALUES (0, [0, 1, 2, 5, 7, 9]), (1, [0, 1, 3, 4, 8, 9]), (2, [0, 2, 3, 6, 7, 9])),
bp AS (SELECT item_id, t, len(t) AS n, unnest(range(0, len(t))) AS q FROM bt WHERE len(t) >= 5),
dp AS (SELECT doc_id, t, len(t) AS m, unnest(range(0, len(t) - 4)) AS p FROM dt WHERE len(t) >= 5),
bs AS (SELECT item_id, t, n, q, mk, list_transform(offs, lambda o: t[q + o + 1]) AS seed FROM bp, masks WHERE n >= 10 AND q + 10 <= n
       UNION ALL SELECT item_id, t, n, q, 3, t[1:5] FROM bp WHERE n < 10 AND q = 0),
ds AS (SELECT doc_id, t, m, p, mk, list_transform(offs, lambda o: t[p + o + 1]) AS seed FROM dp, masks WHERE p + 10 <= m
       UNION ALL SELECT doc_id, t, m, p, 3, t[p + 1 : p + 5] FROM dp),
hits AS (SELECT DISTINCT doc_id, item_id, p, q, ds.t AS dt, bs.t AS it, m, n, least(n, 13) AS win, s.st
         FROM ds JOIN bs USING (mk, seed), (VALUES (-3), (-2), (-1), (0)) s(st)),
scored AS (SELECT doc_id, item_id, win, len(list_filter(range(0, win), lambda k: dt[p + st + k + 1] = it[q + st + k + 1])) AS matched
           FROM hits WHERE q + st >= 0 AND p + st >= 0 AND q + st + win <= n AND p + st + win <= m AND (st + win >= 10 OR n < 10))
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(win) AS BIGINT) AS "window"
FROM scored WHERE matched >= win * 0.8 GROUP BY doc_id, item_id
"""


@query("op1_spaced_seed_leaks", LEAKS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_toxicity_trees")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, model).drop("text")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


@query("op3_hyperminhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link(table(spark, sf_dir, "documents"), width=4)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
              (1.5::DOUBLE * (SELECT sum(source_size) FROM s0) - coalesce(sum(cap) OVER b, 0))
              / ((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER b, 0)) AS lv
       FROM s1 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST), b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT lv FROM s2 WHERE lv * weight <= cap ORDER BY pos LIMIT 1),
s3 AS (SELECT *, least(cap, coalesce((SELECT lv FROM lvl) * weight, cap)) AS target, least(4096, CAST(ceil(source_size / 25000.0::DOUBLE) AS BIGINT) + 1) AS shards FROM s2),
tot AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS m FROM s3),
sq AS (SELECT source, row_number() OVER (ORDER BY target / (2 * g.seat - 1) DESC, source NULLS LAST, g.seat) AS rk
       FROM s3, (SELECT unnest(range(1, (SELECT m FROM tot) + 1)) AS seat) g WHERE target > 0),
quota AS (SELECT source, count(*) AS quota FROM sq WHERE rk <= (SELECT m FROM tot) GROUP BY source),
placed AS (SELECT d.*, s3.source_size, s3.target, coalesce(q.quota, 0) AS quota,
                  CAST('0x' || substr(k, 1, 8) AS BIGINT) % s3.shards AS shard
           FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source LEFT JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
sh AS (SELECT source, shard, any_value(quota) AS quota, sum(size) AS words FROM placed GROUP BY source, shard),
shq AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY words / CAST(2 * g.seat - 1 AS DOUBLE) DESC, shard, g.seat) AS rk
        FROM sh, (SELECT unnest(range(1, (SELECT max(quota) FROM quota) + 1)) AS seat) g WHERE words > 0 AND g.seat <= sh.quota),
seats AS (SELECT source, shard, count(*) AS seats FROM shq WHERE rk <= quota GROUP BY source, shard),
run AS (SELECT p.*, sh.words, least(coalesce(s.seats, 0) * 16, 2 * sh.words) AS take,
               sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY k, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
        FROM placed p JOIN sh ON p.source IS NOT DISTINCT FROM sh.source AND p.shard = sh.shard
        LEFT JOIN seats s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard)
SELECT doc_id, size, source_size, target,
       CAST((take // greatest(words, 1)) * size + greatest(0, least(e, take % greatest(words, 1)) - (e - size)) AS BIGINT) AS taken
FROM run
"""


@query("op6_source_mix", MIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_language_codes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    found = langid.identify(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op4_projection_forest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_deleted_interpolation")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    held = F.pmod(F.floor(text_crc / 5), F.lit(10)) == 0
    fold_col = F.when(text_crc % 5 == 1, 0).when(held, 2).otherwise(1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("fold", fold_col)
    scored = lm.score(docs, "fold")
    return scored.select(
        F.col("id").alias("doc_id"), (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op8_licence_digests", licences.scan_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_digests(spark))


CALLS_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(min(text), '') AS text FROM conversations
                     WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn, role),
calls AS (SELECT conv_id, 'call-' || turn AS call_id, min(turn) AS turn, min(text) AS text, 'call-' || (turn - 2) AS parent, length(min(text)) % 3 AS tool
          FROM t WHERE role = 'user' GROUP BY conv_id, turn),
answers AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, min(text) AS content FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
args AS (SELECT *, CASE tool WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'plan' END AS name,
                length(text) AS n, CAST(length(text) AS VARCHAR) AS ns FROM calls),
made AS (SELECT *,
    CASE WHEN n % 7 = 0 THEN 'many' ELSE ns END AS lim,
    CASE tool WHEN 0 THEN '"limit":' || CASE WHEN n % 7 = 0 THEN '"many"' ELSE ns END || ',"query":' || CAST(to_json(text) AS VARCHAR)
              WHEN 1 THEN '"text":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN n % 4 = 0 THEN '' ELSE ',"to":"en"' END
              ELSE '"brief":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"note":' || CAST(to_json(text) AS VARCHAR) END AS args,
    CASE tool WHEN 0 THEN CASE WHEN n % 7 = 0 THEN 'type:limit' ELSE '' END
              WHEN 1 THEN CASE WHEN n % 4 = 0 THEN 'missing:to' ELSE '' END
              ELSE 'unknown:note' END AS errors FROM args),
deep AS (SELECT c.conv_id, c.call_id, CAST(0 AS BIGINT) AS depth FROM calls c
         WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.parent)
         UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM calls c JOIN deep d ON c.conv_id = d.conv_id AND c.parent = d.call_id),
placed AS (SELECT m.*, depth, row_number() OVER (PARTITION BY m.conv_id ORDER BY depth, turn, m.call_id) AS position
           FROM made m JOIN deep USING (conv_id, call_id))
SELECT coalesce(p.conv_id, a.conv_id) AS conv_id, coalesce(p.call_id, a.call_id) AS call_id, name,
       CASE WHEN p.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
       depth, position, errors,
       '{"arguments":{' || args || '},"id":"' || p.call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(a.content) AS VARCHAR), 'null') || '}' AS json
FROM placed p FULL JOIN answers a ON p.conv_id = a.conv_id AND p.call_id = a.call_id
"""

TOOLS = [
    ("search", "limit", "integer", True), ("search", "query", "string", True), ("translate", "text", "string", True),
    ("translate", "to", "string", True), ("plan", "brief", "boolean", True),
]


@query("op9_tool_calls", CALLS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call of a tool that its length picks, built on the user's turn before; the next assistant turn answers it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")

    def arguments(*pairs: tuple[str, object]) -> Column:
        return F.create_map(*[x if not isinstance(x, str) else F.lit(x) for pair in pairs for x in pair])

    search = arguments(("limit", F.when(n % 7 == 0, "many").otherwise(n.cast("string"))), ("query", F.col("text")))
    translate = F.when(n % 4 == 0, arguments(("text", F.col("text")))).otherwise(arguments(("text", F.col("text")), ("to", "en")))
    plan = arguments(("brief", F.when(n % 2 == 0, "true").otherwise("false")), ("note", F.col("text")))
    user = turns.filter("role = 'user' and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    calls = user.select(
        "conv_id",
        F.concat(F.lit("call-"), F.col("turn").cast("string")).alias("call_id"),
        "turn",
        F.when(n % 3 == 0, "search").when(n % 3 == 1, "translate").otherwise("plan").alias("name"),
        F.when(n % 3 == 0, search).when(n % 3 == 1, translate).otherwise(plan).alias("arguments"),
        F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string")).alias("parent"),
    )
    assistant = turns.filter("role = 'assistant' and turn is not null")
    results = assistant.select("conv_id", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return toolcalls.link(calls, results, spark.createDataFrame(TOOLS, "name string, field string, type string, required boolean"))


@query("op10_page_trees")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages)).select("page_id", "url", "text", "n_chars")


@query("op11_genetic_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    vocabulary = packing.Vocabulary(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@query("op12_hard_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), every=97)
