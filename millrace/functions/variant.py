"""Strict JSON lines and typed fields of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TEXTS = ("name", "dish", "description")
LISTS = ("recipeIngredient", "recipeInstructions", "keywords")


def strict_json(c: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; null for any other.

    The parser by itself ignores what follows the value, so the text must also be the only item of an
    array and the value of an object.
    """
    alone = (F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(c))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def text_field(v: Column, name: str) -> Column:
    """A string field; anything that is no string is an empty text."""
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, f"$.{name}", "string")).otherwise("")


def list_field(v: Column, name: str) -> Column:
    """A list of strings: a string is a list of one, other items are empty texts, other values no list."""
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    kind = F.schema_of_variant(inner)
    items = F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(""))
    one = F.array(F.try_variant_get(v, f"$.{name}", "string"))
    return F.when(kind == "STRING", one).when(kind.startswith("ARRAY<"), items).otherwise(F.array().cast("array<string>"))


def records(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with `valid` (is JSON), `object` (is an object) and the raw fields of a recipe."""
    parsed = lines.withColumn("_v", strict_json(F.col(value)))
    v = F.col("_v")
    return parsed.withColumn("valid", v.isNotNull()).withColumn("object", is_object(v)).select(
        *[c for c in lines.columns], "valid", "object", *[text_field(v, n).alias(n) for n in TEXTS], *[list_field(v, n).alias(n) for n in LISTS]
    )
