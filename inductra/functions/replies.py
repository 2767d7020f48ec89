"""Reading model replies as JSON with the strictness of a browser's parser.

``from_json`` alone accepts text after the value and single quotes, and turns numbers
into strings. Here a reply counts as JSON only if it is one complete value, and each
field keeps its JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inductra.functions.text import _col

_STRICT = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": "_corrupt",
}


def reply_text(body: Column | str) -> Column:
    """First text part of a generate-content response body, trimmed by the caller."""
    return F.get_json_object(_col(body), "$.candidates[0].content.parts[0].text")


def _is_one_value(raw: Column) -> Column:
    """No text after the value.

    Between brackets the text must be a list of one; a stray ``]`` could close that list
    early, so text with a ``]`` must also pass inside an object, where it would break.
    """
    in_list = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    in_object = F.json_array_length(F.concat(F.lit('[{"v":'), raw, F.lit("}]"))) == 1
    return F.coalesce(in_list & (~raw.contains("]") | in_object), F.lit(False))


def parse_fields(raw: Column | str, *fields: str) -> Column:
    """The named top-level fields of an object as variants, plus a ``_corrupt`` mark."""
    schema = ", ".join([f"{f} variant" for f in fields] + ["_corrupt string"])
    return F.from_json(_col(raw), schema, _STRICT)


def json_kind(raw: Column | str, fields: Column) -> Column:
    """``object``, ``other`` (array, number, string, boolean), ``null`` or ``invalid``.

    ``fields`` is the ``parse_fields`` result for the same text.
    """
    raw = _col(raw)
    wrapped = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v variant, _corrupt string", _STRICT)
    return (
        F.when(~_is_one_value(raw), F.lit("invalid"))
        .when(raw.startswith("{"), F.when(fields["_corrupt"].isNull(), F.lit("object")).otherwise(F.lit("invalid")))
        .when(raw == "null", F.lit("null"))
        .when(wrapped["_corrupt"].isNull(), F.lit("other"))
        .otherwise(F.lit("invalid"))
    )


def _type_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_number(value: Column) -> Column:
    kind = _type_of(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL(")


def number_or_null(value: Column) -> Column:
    """The value as a double if it is a JSON number; ``"0.9"`` is not."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def string_or_null(value: Column) -> Column:
    return F.when(_type_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def is_truthy(value: Column) -> Column:
    """Truth of a JSON value as a browser sees it."""
    kind = _type_of(value)
    return (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(is_number(value), F.try_variant_get(value, "$", "double") != 0)
        .otherwise(F.lit(True))
    )
