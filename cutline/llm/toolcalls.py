"""Linking tool calls with their results.

Calls and results are hash-joined by conversation and call id; calls are put in topological order
of the calls they build on; arguments are validated against the tools' schemas; each linked call
is serialised as canonical JSON (keys in order, no spaces, typed values).

DataFrame operations only. A call names at most one call that it builds on, so its depth comes
from pointer doubling: the rounds grow with the logarithm of the longest chain, and a chain that
closes on itself never reaches a root and is reported as a cycle. The order inside conversations
comes from one range-partitioned sort, so one conversation may hold most rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import global_rank
from .frames import once, written

_TYPES = {"integer": r"^-?(0|[1-9][0-9]{0,17})$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$", "boolean": r"^(true|false)$"}


def json_text(value: Column) -> Column:
    """A string as JSON, null as ``null``."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): calls between a call and its root, null on a cycle.

    ``calls`` has unique (conv_id, call_id) and ``parent``; a parent that does not exist is none.
    """
    known = calls.select("conv_id", F.col("call_id").alias("up"))
    state = calls.select("conv_id", "call_id", F.col("parent").alias("up")).join(known.withColumn("found", F.lit(True)), ["conv_id", "up"], "left")
    state = written(state.select("conv_id", "call_id", F.when(F.col("found"), F.col("up")).alias("up"), F.when(F.col("found"), F.lit(1)).otherwise(0).cast("bigint").alias("depth")), "calls")
    for _ in range(math.ceil(math.log2(state.count() + 1)) + 1):
        if not state.filter("up is not null").take(1):
            break
        next_up = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        joined = state.join(next_up, ["conv_id", "up"], "left")
        state = written(joined.select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "calls")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _errors() -> Column:
    """Problems of ``arguments`` under ``fields`` (array of field, type, required), in order."""
    missing = F.transform(
        F.filter("fields", lambda f: f["required"] & ~F.map_contains_key("arguments", f["field"])), lambda f: F.concat(F.lit("missing:"), f["field"])
    )

    def wrong(f: Column) -> Column:
        value = F.try_element_at("arguments", f["field"])
        fits = F.lit(True)
        for kind, pattern in _TYPES.items():
            fits = F.when(f["type"] == kind, value.rlike(pattern)).otherwise(fits)
        return F.map_contains_key("arguments", f["field"]) & ~F.coalesce(fits, F.lit(False))

    typed = F.transform(F.filter("fields", wrong), lambda f: F.concat(F.lit("type:"), f["field"]))
    names = F.transform("fields", lambda f: f["field"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys("arguments"), names)), lambda k: F.concat(F.lit("unknown:"), k))
    return F.when(F.col("fields").isNull(), F.array(F.lit("tool"))).otherwise(F.concat(missing, typed, extra))


def _canonical() -> Column:
    """The linked call as canonical JSON; numbers and booleans that fit their type stand bare."""

    def pair(e: Column) -> Column:
        kind = F.get(F.filter("fields", lambda f: f["field"] == e["key"]), 0)["type"]
        bare = F.lit(False)
        for name, pattern in _TYPES.items():
            bare = F.when(kind == name, e["value"].rlike(pattern)).otherwise(bare)
        return F.concat(json_text(e["key"]), F.lit(":"), F.when(F.coalesce(bare, F.lit(False)), e["value"]).otherwise(json_text(e["value"])))

    entries = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("arguments")), pair))
    parts = [F.lit('{"arguments":{'), entries, F.lit('},"id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("name"))]
    return F.concat(*parts, F.lit(',"result":'), json_text(F.col("content")), F.lit("}"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call id of a conversation: status, order, problems and canonical JSON.

    ``calls``: conv_id, call_id, turn, name, arguments (map of strings), parent; ``results``:
    conv_id, call_id, turn, content; ``schemas``: name, field, type, required. Of rows that repeat
    a call id the one with the smallest turn counts (then the smallest name or content). Rows
    without a conversation or call id cannot be linked and are left out. ``status`` is ``linked``,
    ``pending`` (no result) or ``orphan`` (no call: no depth, position, problems or JSON).
    ``position`` counts from 1 by depth, turn and id; calls on a cycle have none. ``errors`` joins
    ``missing:``, ``type:`` and ``unknown:`` fields, or is ``tool`` without a schema. Null
    arguments are none.
    """
    keys = ["conv_id", "call_id"]
    given = F.coalesce("arguments", F.expr("cast(map() as map<string,string>)"))
    flat = calls.filter("conv_id is not null and call_id is not null").withColumn("arguments", F.array_sort(F.map_entries(given)))
    flat = flat.groupBy(*keys).agg(F.min(F.struct("turn", "name", "parent", "arguments")).alias("c"))
    flat = written(flat.select(*keys, "c.turn", "c.name", "c.parent", F.map_from_entries("c.arguments").alias("arguments")), "tool-calls")
    answered = results.filter("conv_id is not null and call_id is not null").groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"))
    answered = answered.select(*keys, F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    fields = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))

    deep = depths(flat)
    ordered = global_rank(flat.select(*keys, "turn").join(deep, keys).filter("depth is not null"), [F.col("conv_id"), F.col("depth"), F.col("turn"), F.col("call_id")], "place")
    first = ordered.groupBy("conv_id").agg(F.min("place").alias("first"))
    places = ordered.join(first, "conv_id").select(*keys, "depth", (F.col("place") - F.col("first") + 1).alias("position"))

    rows = flat.withColumn("called", F.lit(True)).join(fields, "name", "left").join(places, keys, "left").join(answered, keys, "full")
    rows = rows.withColumn("status", F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "pending").otherwise("linked"))
    rows = rows.withColumn("errors", once(F.when(F.col("called"), F.array_join(_errors(), ","))))
    return rows.select(*keys, "name", "status", "depth", "position", "errors", F.when(F.col("called"), _canonical()).alias("json"))
