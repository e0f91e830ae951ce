"""Queries over OpenAPI operations and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

OPERATION = "struct<openapi_op:struct<method:string,path:string,operationId:string,summary:string,tags:array<string>,request_body:struct<refs:array<string>>,responses:map<string,struct<refs:array<string>>>,deprecated:boolean>>"
SCHEMA = "struct<openapi_schema:struct<name:string,type:string,properties:array<string>,required:array<string>,refs:array<string>,used_by_operations:array<string>>>"


def operations(sections: DataFrame) -> DataFrame:
    rows = sections.filter(F.contains("metadata", F.lit('"openapi_op"'))).select("id", "doc_path", F.from_json("metadata", OPERATION)["openapi_op"].alias("o"))
    refs = F.array_distinct(F.concat(F.coalesce("o.request_body.refs", F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform(F.map_values("o.responses"), lambda r: r["refs"])), F.array().cast("array<string>"))))
    return rows.select("id", "doc_path", "o.method", "o.path", F.col("o.operationId").alias("operation_id"), "o.summary", "o.tags", "o.deprecated", refs.alias("refs"))


def schemas(sections: DataFrame) -> DataFrame:
    rows = sections.filter(F.contains("metadata", F.lit('"openapi_schema"'))).select("id", "doc_path", F.from_json("metadata", SCHEMA)["openapi_schema"].alias("s"))
    return rows.select("id", "doc_path", "s.name", "s.type", "s.properties", "s.required", "s.refs", "s.used_by_operations")


def find_endpoint(ops: DataFrame, path: str | None = None, method: str | None = None, tag: str | None = None) -> DataFrame:
    if path:
        ops = ops.filter(paths.matches_glob(F.col("path"), path))
    if method:
        ops = ops.filter(F.col("method") == method.upper())
    return ops.filter(F.array_contains("tags", tag)) if tag else ops


def endpoints_by_tag(ops: DataFrame, tag: str | None = None) -> DataFrame:
    """tag, method, path of every operation under each of its tags; untagged ones under ``untagged``."""
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))
    each = ops.select(F.explode(tags).alias("tag"), "method", "path")
    return each.filter(F.col("tag") == tag) if tag else each


def using_schema(ops: DataFrame, name: str) -> DataFrame:
    return ops.filter(F.array_contains("refs", name)).select("id", "method", "path")


def schema_graph(found: DataFrame, name: str, max_depth: int = 5) -> DataFrame:
    """depth, name of every schema that one refers to, at its least depth."""
    edges = found.select(F.col("name").alias("a"), F.explode("refs").alias("b"))
    return found.sparkSession.sql(
        """
        WITH RECURSIVE walk(depth, name, seen) AS (
          SELECT 0, {start}, array({start})
          UNION ALL
          SELECT w.depth + 1, e.b, array_append(w.seen, e.b) FROM walk w JOIN {e} e ON e.a = w.name WHERE w.depth < {most} AND NOT array_contains(w.seen, e.b)
        ) SELECT min(depth) AS depth, name FROM walk GROUP BY name
        """,
        e=edges,
        start=name,
        most=max_depth,
    )
