"""Object ids and the pieces of names they are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """null where the value is empty."""
    return F.nullif(c, F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(blank(v) for v in values))


def dotted(*parts: Column) -> Column:
    """The filled parts joined by dots."""
    return F.concat_ws(".", *(blank(p) for p in parts))


def platform_id(platform: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{platform}:"), dotted(*parts))


def warehouse_id(project: Column, dataset: Column, table: Column) -> Column:
    """BIGQUERY.PROJECT.DATASET.TABLE in capitals; missing parts are left out."""
    return F.upper(F.concat(F.lit("BIGQUERY."), dotted(project, dataset, table)))


def reference_id(reference: Column, project: Column, dataset: Column) -> Column:
    """A reference of one, two or three parts, back-ticks dropped, completed by the context's project and dataset."""
    plain = F.replace(reference, F.lit("`"), F.lit(""))
    parts = F.size(F.split(plain, "\\."))
    full = F.when(parts >= 3, plain).when(parts == 2, F.concat(project, F.lit("."), plain)).otherwise(F.concat(project, F.lit("."), dataset, F.lit("."), plain))
    return F.concat(F.lit("bigquery:"), full)


def name_of(id_: Column) -> Column:
    return F.element_at(F.split(id_, "\\."), -1)


def schema_of(id_: Column) -> Column:
    """All but the last part; empty for a single part."""
    return F.regexp_extract(id_, "^(.*)\\.[^.]*$", 1)


def hash_id(id_: Column) -> Column:
    """A stable positive number of 63 bits."""
    return F.xxhash64(id_).bitwiseAND(F.lit((1 << 63) - 1))


def type_list(text: Column, prefix: str, name_key: str = "name", type_key: str = "data_type") -> Column:
    """'A, ,B' to [{name: prefix_1, data_type: A}, {name: prefix_3, data_type: B}]; blanks count before they are dropped."""
    items = F.transform(F.split(text, ","), lambda x, i: F.struct(F.concat(F.lit(f"{prefix}_"), (i + 1).cast("string")).alias("n"), F.trim(x).alias("t")))
    kept = F.filter(items, lambda x: x["t"] != "")
    maps = F.transform(kept, lambda x: F.create_map(F.lit(name_key), x["n"], F.lit(type_key), x["t"]))
    return F.coalesce(maps, F.array().cast("array<map<string,string>>"))


def dependency_type(object_type: Column) -> Column:
    return F.when(object_type == "VIEW", "VIEW").when(F.contains(object_type, F.lit("SCRIPT")), "UDF_INPUT").otherwise("ETL")


def string_list(text: Column) -> Column:
    """A JSON array of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
