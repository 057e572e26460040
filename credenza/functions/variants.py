"""JSON bodies as VARIANT: parsed once, stored with their common paths as columns of their own, read by path.

Text that is no JSON is a null VARIANT. A path that a body lacks, or whose value doesn't fit the type, is null.
"""

from __future__ import annotations

from functools import reduce
from json import dumps as json_text

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A writer keeps the paths that many bodies have in typed columns, so that a reader of one path reads one column.
SHREDDING = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}


def parsed(json: Column) -> Column:
    return F.try_parse_json(json)


def at(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, path, kind)


def first_of(body: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the paths that the body has a value at; a blank text is none."""
    values = [at(body, p, kind) for p in paths]
    if kind == "string":
        values = [F.when(F.trim(v) != "", v) for v in values]
    return F.coalesce(*values)


def with_entry(json: Column, name: str, value: Column) -> Column:
    """The JSON object with one entry more, last, in place of any that has its name; what is no object is replaced by one of
    this entry alone. value: JSON, which keeps the order of its keys (a VARIANT sorts them)."""
    entries = F.from_json(json, "map<string,variant>")
    kept = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,variant>")), lambda k, _: k != name)
    # What is written here ends with the brace of the object itself.
    head = F.when(F.size(kept) == 0, F.lit("{")).otherwise(F.concat(F.regexp_replace(F.to_json(kept), r"\}$", ""), F.lit(",")))
    return F.concat(head, F.lit(json_text(name) + ":"), value, F.lit("}"))


def store(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows with VARIANT columns, their common paths as columns of their own, and reads them back."""
    spark = rows.sparkSession
    before = {name: spark.conf.get(name, None) for name in SHREDDING}
    for name, value in SHREDDING.items():
        spark.conf.set(name, value)
    try:
        rows.write.parquet(path)
    finally:
        reduce(lambda _, item: spark.conf.unset(item[0]) if item[1] is None else spark.conf.set(*item), before.items(), None)
    return spark.read.schema(rows.schema).parquet(path)
