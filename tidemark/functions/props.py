"""Reading dynamic properties (VARIANT) by path, by stored type and by shape.

Listing the paths of every row would multiply the rows by the number of leaves. A row's *shape*
(`schema_of_variant`) holds the same information and repeats across rows, so schema questions
are answered from the few distinct shapes, which partial aggregation collapses before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Stored type -> name shown in the schema catalog.
_SCALAR_TYPES = {
    "BIGINT": "Int64",
    "DOUBLE": "Float64",
    "FLOAT": "Float64",
    "STRING": "String",
    "BOOLEAN": "Bool",
    "DATE": "Date",
    "TIMESTAMP": "DateTime64(9)",
    "TIMESTAMP_NTZ": "DateTime64(9)",
}


# -- evaluation ------------------------------------------------------------


def fence(column: Column) -> Column:
    """The same value, marked so that no filter above it is pushed down through it.

    A filter on a parsed field would otherwise be rewritten in terms of the raw text, and every row
    would be parsed again for it.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def let(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, inside one expression."""
    return F.get(F.transform(F.array(column), use), F.lit(0))


# -- single paths ----------------------------------------------------------


def json_path(path: str, split: bool = True) -> str:
    """`cart.coupon` -> `$["cart"]["coupon"]`."""
    keys = path.split(".") if split else [path]
    return "$" + "".join(f"['{key}']" if '"' in key else f'["{key}"]' for key in keys)


def value_at(properties: Column, path: str, as_type: str = "variant") -> Column:
    """The value below a dotted path; a key that itself holds the dots is found too."""
    nested = F.try_variant_get(properties, json_path(path), as_type)
    if "." not in path:
        return nested
    return F.coalesce(nested, F.try_variant_get(properties, json_path(path, split=False), as_type))


def text_at(properties: Column, path: str) -> Column:
    """Any value as text; null when absent."""
    return value_at(properties, path, "string")


def double_at(properties: Column, path: str) -> Column:
    """The value cast to a double; null when absent or not a number."""
    return value_at(properties, path, "double")


def stored_as(document: Column, path: str, kind: str = "STRING") -> Column:
    """Text of the value only when it is *stored* as ``kind`` — a type test, not a cast."""
    return F.when(
        F.schema_of_variant(value_at(document, path)) == kind, value_at(document, path, "string")
    )


def text_stored(value: Column) -> Column:
    """Text of a value that is stored as text; null for every other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def children(value: Column) -> Column:
    """An object's entries as a map; null for every other kind of value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def has_nested(properties: Column) -> Column:
    """Whether an object holds an object or array one level down (top-level arrays are fine)."""
    below = F.map_values(children(properties))
    return F.coalesce(F.exists(below, lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<")), F.lit(False))


# -- shapes ----------------------------------------------------------------


def shape_of(properties: Column) -> Column:
    """The structure of one value, with every decimal precision folded into one number type."""
    return F.regexp_replace(F.schema_of_variant(properties), r"DECIMAL\(\d+,\d+\)", "DOUBLE")


# What a shape is made of: a key in backticks or plain, an opening, a type, a closing; the commas between are left out.
_TOKENS = r"`[^`]*(?:``[^`]*)*`: |[A-Za-z_][A-Za-z0-9_]*: |OBJECT<|ARRAY<|[A-Z_]+|>"


def _shape_tree(shape: Column) -> Column:
    """A shape as nested lists: `["{", ["key"], type, ...]` for an object, `["[", type]` for an array, a text for any other type."""

    def bare(key: Column) -> Column:
        return F.when(key.startswith("`"), F.replace(key.substr(F.lit(2), F.length(key) - 2), F.lit("``"), F.lit("`"))).otherwise(key)

    def written(token: Column) -> Column:
        return (
            F.when(token == "OBJECT<", F.lit(',["{"'))
            .when(token == "ARRAY<", F.lit(',["["'))
            .when(token == ">", F.lit("]"))
            .when(token.endswith(": "), F.concat(F.lit(","), F.to_json(F.array(let(F.regexp_replace(token, ": $", ""), bare)))))
            .otherwise(F.concat(F.lit(',"'), token, F.lit('"')))
        )

    text = F.array_join(F.transform(F.regexp_extract_all(shape, F.lit(_TOKENS), F.lit(0)), written), "")
    return F.try_parse_json(F.regexp_replace(text, "^,", ""))


def _levels(shape: Column) -> Column:
    """At least the depth of objects in a shape (the number of objects in it)."""
    return F.size(F.split(shape, "OBJECT<")) - 1


def _opened(entries: Column, levels: Column, below: Callable[[Column], Column]) -> Column:
    """Entries (path, value) with each object replaced, where it stands, by its own, level by level, inside one row.

    ``below`` gives the entries of a value, null where it has none. An entry that is no object is looked at once.
    """
    marked = lambda path, value, open_: F.struct(path.alias("path"), value.alias("value"), open_.alias("open"))
    first = F.transform(entries, lambda e: marked(e["path"], e["value"], F.lit(True)))

    def grow(e: Column) -> Column:
        nested = lambda found: F.when(
            F.size(found) > 0,
            F.transform(found, lambda c: marked(F.concat(e["path"], F.lit("."), c["path"]), c["value"], F.lit(True))),
        )
        return F.when(e["open"], F.coalesce(let(below(e["value"]), nested), F.array(marked(e["path"], e["value"], F.lit(False))))).otherwise(F.array(e))

    none = F.array().cast("array<int>")
    steps = let(levels, lambda n: F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(none))
    return F.aggregate(steps, first, lambda found, _: F.flatten(F.transform(found, grow)))


def leaf_rows(shapes: DataFrame, shape: str = "shape") -> DataFrame:
    """One row per leaf of each distinct shape: the other columns, `path`, `stored`.

    Nulls are stored as `VOID`, `{}` as `OBJECT<>`; an array is a leaf, told as the catalog's name of it. A shape that is
    no object has no leaf. Runs as built-ins over the distinct shapes.
    """
    items = lambda node: F.try_variant_get(node, "$", "array<variant>")

    def members(node: Column) -> Column:
        def pairs(found: Column) -> Column:
            places = F.sequence(F.lit(1), F.size(found) - 1, F.lit(2))
            is_object = (F.size(found) > 1) & (F.try_variant_get(F.get(found, F.lit(0)), "$", "string") == "{")
            pair = lambda n: F.struct(
                F.try_variant_get(F.get(found, n), "$[0]", "string").alias("path"), F.get(found, n + 1).alias("value")
            )
            return F.when(is_object, F.transform(places, pair))

        return let(items(node), pairs)

    opened = shapes.withColumn("_tree", _shape_tree(F.col(shape)))
    leaves = _opened(members(F.col("_tree")), _levels(F.col(shape)), members)
    kept = [c for c in shapes.columns if c != shape]
    # Fenced, as the filter that an explode brings along would walk the shape again below it.
    walked = opened.withColumn("_leaves", fence(leaves)).select(*kept, F.explode("_leaves").alias("_leaf"))
    exploded = walked.withColumn("stored", fence(let(F.to_json("_leaf.value"), _stored)))
    return exploded.select(*kept, F.col("_leaf.path").alias("path"), "stored")


def _stored(text: Column) -> Column:
    """Type of a leaf, by the JSON text of its tree: a scalar's own, `OBJECT<>`, or `Array(...)`."""
    arrays = r'^((?:\["\[",)*)'
    scalar = F.regexp_extract(text, arrays + '"([A-Z_]+)"', 2)
    element = F.when(scalar == "VOID", F.lit("Nullable(String)")).otherwise(
        F.coalesce(F.concat(F.lit("Nullable("), _scalar_name(scalar), F.lit(")")), F.lit("Dynamic"))
    )
    inner = F.when(text.rlike(arrays + r'\["\{"'), F.lit("JSON")).otherwise(element)
    depth = (F.length(F.regexp_extract(text, arrays, 1)) / 5).cast("int")
    array = lambda n: F.concat(F.repeat(F.lit("Array("), n), inner, F.repeat(F.lit(")"), n))
    return F.when(text.startswith('["[",'), let(depth, array)).when(text == '["{"]', F.lit("OBJECT<>")).otherwise(scalar)


def _scalar_name(stored: Column) -> Column:
    """Catalog name of a scalar type; null for a type without one."""
    names = F.create_map(*[F.lit(text) for pair in _SCALAR_TYPES.items() for text in pair])
    return F.try_element_at(names, stored)


def catalog_type(stored: Column) -> Column:
    """Catalog name of a stored type as `leaf_rows` gives it."""
    return F.when(stored.startswith("Array("), stored).otherwise(F.coalesce(_scalar_name(stored), F.initcap(stored)))


# -- whole documents -------------------------------------------------------


def flat_entries(properties: Column) -> Column:
    """`array<struct<path,value>>` with dotted names; arrays and empty objects stay values.

    Row-local, to the depth of each row: no explode, no shuffle and no look at the table beforehand.
    """

    def entries(value: Column) -> Column:
        return F.transform(F.map_entries(children(value)), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))

    opened = _opened(entries(properties), _levels(F.schema_of_variant(properties)), entries)
    return F.transform(opened, lambda e: F.struct(e["path"].alias("path"), e["value"].alias("value")))


def value_label(value: Column) -> Column:
    """Display text of a value: JSON for objects and arrays, a dash for null."""
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(text, F.lit("—"))


def field_type(stored: Column) -> Column:
    """Coarse display type of a stored type."""
    return (
        F.when(stored == "STRING", "string")
        .when(stored.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(stored == "BOOLEAN", "boolean")
        .when(stored.isNull() | (stored == "VOID"), "unknown")
        .otherwise("object")
    )


def as_object(pairs: list[tuple[str, Column]]) -> Column:
    """A VARIANT object of the given pairs whose value is not null."""
    keys = [F.lit(name) for name, _ in pairs]
    values = [F.to_variant_object(F.struct(value.alias("v"))) for _, value in pairs]
    picked = [F.try_variant_get(v, "$.v", "variant") for v in values]
    full = F.map_from_arrays(F.array(*keys), F.array(*picked))
    return F.to_variant_object(F.map_filter(full, lambda _, v: v.isNotNull() & ~F.is_variant_null(v)))
