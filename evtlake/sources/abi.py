"""Catalog of contract interfaces: a folder of JSON files becomes one row for each event member and view output.

Three shapes are read: an object whose "abi" is JSON text, one whose "abi" is a list, and a bare list. Events count if
their kind is struct; a member without a kind is data; the short name is the last '::' part. Views are functions with
state_mutability view, at the top or inside interfaces. Struct members and enum variants are rows too, for types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.felt import Types
from ..functions.selector import selector_column
from .config import held

_MEMBER = "struct<name:string,type:string,kind:string>"
_FUNCTION = f"type string, name string, kind string, state_mutability string, inputs array<{_MEMBER}>, outputs array<{_MEMBER}>, members array<{_MEMBER}>, variants array<{_MEMBER}>"
_ENTRY = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _FUNCTION.split(', '))}, items:array<struct<{', '.join(x.replace(' ', ':', 1) for x in _FUNCTION.split(', '))}>>>>"


def abi_files(spark: SparkSession, path: str) -> DataFrame:
    """abi_name (the file name without its ending) and entries."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)*$", 1).alias("abi_name"), F.trim("value").alias("text"))
    return abi_entries(files)


def abi_entries(files: DataFrame) -> DataFrame:
    """files: abi_name, text."""
    inner = F.get_json_object("text", "$.abi")
    listed = F.when(F.substring(F.trim("text"), 1, 1) == "[", F.col("text")).otherwise(inner)
    return files.select("abi_name", F.explode(F.from_json(listed, _ENTRY)).alias("e"))


def abi_catalog(entries: DataFrame) -> DataFrame:
    """Rows of ABI_MEMBER. Two events of one ABI with the same short name are an error (`checked`)."""
    nested = entries.select("abi_name", F.explode("e.items").alias("e"))
    flat = entries.select("abi_name", "e.type", "e.name", "e.kind", "e.state_mutability", "e.outputs", "e.members", "e.variants").unionByName(
        nested.select("abi_name", "e.type", "e.name", "e.kind", "e.state_mutability", "e.outputs", "e.members", "e.variants")
    )
    is_event = (F.col("type") == "event") & (F.col("kind") == "struct")
    is_view = (F.col("type") == "function") & (F.col("state_mutability") == "view")
    kind = F.when(is_event, "event").when(is_view, "function").when(F.col("type").isin("struct", "enum"), F.col("type"))
    members = F.when(is_view, F.col("outputs")).when(F.col("type") == "enum", F.col("variants")).otherwise(F.col("members"))
    rows = flat.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("short", F.element_at(F.split("name", "::"), -1))
    names = rows.where("kind IN ('event', 'function')").select("short").distinct().withColumn("selector", selector_column(F.col("short")))
    rows = rows.select("abi_name", "kind", F.col("name").alias("full_name"), "short", F.posexplode_outer(members).alias("pos", "m"))
    part = F.when(F.col("kind") == "event", F.coalesce("m.kind", F.lit("data"))).when(F.col("kind") == "function", F.lit("output")).otherwise(F.col("kind"))
    return rows.join(names, "short", "left").select(
        "abi_name", "kind", F.col("short").alias("name"), "full_name", "selector", part.alias("part"), F.col("pos").cast("int").alias("pos"), F.col("m.name").alias("member"), F.col("m.type").alias("type_name")
    )


def checked(catalog: DataFrame) -> DataFrame:
    """The catalog, computed once and held (interface files are a small table), or ValueError if short names collide."""
    out = held(catalog)
    full: dict[tuple[str, str], str] = {}
    for r in out.where("kind = 'event'").collect():
        if full.setdefault((r["abi_name"], r["name"]), r["full_name"]) != r["full_name"]:
            raise ValueError(f"events of {r['abi_name']} share the name {r['name']}")
    return out


def types_of(catalog: DataFrame) -> dict[str, Types]:
    """Struct and enum definitions by ABI (interface files, so a small table)."""
    out: dict[str, Types] = {}
    rows = catalog.where("kind IN ('struct', 'enum') AND member IS NOT NULL").collect()
    for r in sorted(rows, key=lambda r: (r["abi_name"], r["full_name"], r["pos"])):
        own = out.setdefault(r["abi_name"], Types())
        (own.structs if r["kind"] == "struct" else own.enums).setdefault(r["full_name"], []).append((r["member"], r["type_name"]))
    return out
