"""Metadata filters: ``{field: value}`` or ``{field: {"$op": operand}}`` as Column predicates over a VARIANT column.

Values compare as dynamically typed ones do: numbers and booleans form one class, strings another, null equals null only;
an ordering between classes is false; a missing field satisfies nothing but ``{"$exists": false}``. Rows whose metadata is
SQL NULL never match. Every predicate is true or false, never NULL, so it may be negated.
"""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = tuple("$" + o for o in "eq exists gt gte in lt lte ne nin".split())
NUMBERS = r"^(BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def validate(spec: dict[str, Any]) -> None:
    for field, wanted in spec.items():
        if isinstance(wanted, dict):
            for op, operand in wanted.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op} for {field}")
                if op in ("$in", "$nin") and not isinstance(operand, (list, tuple, set, frozenset)):
                    raise ValueError(f"{op} needs a list")


def _field(meta: Column, name: str) -> Column:
    return F.try_variant_get(meta, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def _kind(f: Column) -> Column:
    return F.schema_of_variant(f)


def _canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _equal(f: Column, value: Any) -> Column:
    if value is None:
        return F.coalesce(F.is_variant_null(f), F.lit(False))
    if isinstance(value, (bool, int, float, Decimal)):
        if isinstance(value, int) and not isinstance(value, bool) and abs(value) > 2**53:
            same = F.try_variant_get(f, "$", "decimal(38,0)") == F.lit(Decimal(value))
        else:
            is_bool = _kind(f) == "BOOLEAN"
            same = F.when(is_bool, F.try_variant_get(f, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(f, "$", "double")) == F.lit(float(value))
        return F.coalesce(_kind(f).rlike(NUMBERS) & same, F.lit(False))
    if isinstance(value, str):
        return F.coalesce((_kind(f) == "STRING") & (F.try_variant_get(f, "$", "string") == F.lit(value)), F.lit(False))
    # lists and objects: the variant keeps keys sorted; its JSON text is compared with the value's
    return F.coalesce(_kind(f).rlike("^(ARRAY|OBJECT)") & (F.to_json(f) == F.lit(_canonical(value))), F.lit(False))


def _ordered(f: Column, op: str, value: Any) -> Column:
    tests = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
    if isinstance(value, str):
        return F.coalesce((_kind(f) == "STRING") & tests[op](F.try_variant_get(f, "$", "string"), F.lit(value)), F.lit(False))
    if isinstance(value, (bool, int, float, Decimal)):
        own = F.when(_kind(f) == "BOOLEAN", F.try_variant_get(f, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(f, "$", "double"))
        return F.coalesce(_kind(f).rlike(NUMBERS) & tests[op](own, F.lit(float(value))), F.lit(False))
    return F.lit(False)


def _test(f: Column, op: str, operand: Any) -> Column:
    there = f.isNotNull()
    if op == "$exists":
        return there if operand else ~there
    if op == "$eq":
        return there & _equal(f, operand)
    if op == "$ne":
        return there & ~_equal(f, operand)
    if op in ("$in", "$nin"):
        any_of = reduce(lambda a, b: a | b, (_equal(f, v) for v in operand), F.lit(False))
        return there & (any_of if op == "$in" else ~any_of)
    return there & _ordered(f, op, operand)


def predicate(spec: dict[str, Any] | None, meta: Column) -> Column:
    """The filter as a Column; None filters nothing."""
    if spec is None:
        return F.lit(True)
    validate(spec)
    out = meta.isNotNull()
    for name, wanted in spec.items():
        f = _field(meta, name)
        tests = wanted.items() if isinstance(wanted, dict) else [("$eq", wanted)]
        for op, operand in tests:
            out = out & _test(f, op, operand)
    return out
