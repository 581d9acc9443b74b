"""The codec's steps as Catalyst expressions over ``array`` columns: no Python, and the same in every SQL engine."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def made_once(column: Column) -> Column:
    """A generator that yields the column as it is: lambdas that read the result find a value, not an expression to repeat."""
    return F.explode(F.array(column))


def hadamard(df: DataFrame, v: str, dim: int, out: str) -> DataFrame:
    """``df`` with ``out`` for ``v``: the unsigned Hadamard rotation (``srht`` with seed 0), rounded to nine digits."""
    if dim & (dim - 1):
        raise ValueError("needs a power of two")
    others = [c for c in df.columns if c != v]
    signs = ";".join(",".join("-1" if (i & j).bit_count() & 1 else "1" for i in range(dim)) for j in range(dim))
    matrix = F.transform(F.split(F.lit(signs), ";"), lambda r: F.split(r, ",").cast("array<double>"))
    base = df.select(*others, made_once(F.col(v)).alias(v))
    row = lambda r: F.round(dot(F.col(v), r) / F.lit(math.sqrt(dim)), 9)
    return base.select(*others, made_once(F.transform(matrix, row)).alias(out))


def levels(v: Column, bits: int, value_range: float = 1.0) -> Column:
    r, top = float(value_range), float(2**bits - 1)
    return F.transform(v, lambda x: F.rint(F.round((F.least(F.greatest(x, F.lit(-r)), F.lit(r)) + r) / (2 * r) * top, 9)).cast("int"))


def dequantized(levels_: Column, bits: int, value_range: float = 1.0) -> Column:
    r, top = float(value_range), float(2**bits - 1)
    return F.transform(levels_, lambda n: n.cast("double") / top * 2 * r - r)


def packed_hex(levels_: Column, dim: int, bits: int) -> Column:
    """The packed code as upper-case hex: groups of 8 levels are ``bits`` bytes, the lowest bits first. dim is a multiple of 8."""
    groups = F.sequence(F.lit(0), F.lit(dim // 8 - 1))

    powers = F.array(*(F.lit(1 << (bits * k)) for k in range(8))).cast("array<bigint>")

    def group(g: Column) -> Column:
        weighted = F.zip_with(F.slice(levels_, g * 8 + 1, 8), powers, lambda n, p: n.cast("long") * p)
        value = F.aggregate(weighted, F.lit(0).cast("long"), lambda a, b: a + b)
        return F.array_join(F.array(*(F.lpad(F.hex(F.shiftright(value, 8 * b).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for b in range(bits))), "")

    return F.array_join(F.transform(groups, group), "")


def sketch_words(v: Column, dim: int, word: int = 32) -> Column:
    """Sign bits as words of 32 bits (bit j of a word is dimension 32 w + j)."""
    powers = F.array(*(F.lit(1 << j) for j in range(word))).cast("array<bigint>")

    def one(w: Column) -> Column:
        bits = F.zip_with(F.slice(v, w * word + 1, word), powers, lambda x, p: F.when(x >= 0, p).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.transform(F.sequence(F.lit(0), F.lit(-(-dim // word) - 1)), one)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def register_sql_functions(spark: SparkSession) -> None:
    """Names for SQL users: ``vec_quantize(v, bits, range)``, ``vec_hamming(a, b)`` and the table function ``chunk_text``."""
    from quillvec.functions import codec
    from quillvec.operators.chunking import ChunkText

    @F.pandas_udf(T.BinaryType())
    def quantize(v: pd.Series, bits: pd.Series, value_range: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec.quantize(np.asarray(x), int(b), float(r))[0].tobytes() for x, b, r in zip(v, bits, value_range)])

    @F.pandas_udf(T.IntegerType())
    def hamming_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else int(codec.hamming(np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8))[0]) for x, y in zip(a, b)], dtype="Int32")

    spark.udf.register("vec_quantize", quantize)
    spark.udf.register("vec_hamming", hamming_bytes)
    spark.udtf.register("chunk_text", ChunkText)
