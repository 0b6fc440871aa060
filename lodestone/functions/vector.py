"""Vector functions on ARRAY<DOUBLE> columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity from stored norms; 0 where a norm vanishes."""
    return F.when(norm_a * norm_b < 1e-10, 0.0).otherwise(dot(a, b) / (norm_a * norm_b))


def sign_code(v: Column, bits: int = 64) -> Column:
    """Bit i of word i // 64 is set where component i is positive: ARRAY<BIGINT>."""
    one = F.lit(1).cast("bigint")

    def word(w: Column) -> Column:
        part = F.slice(v, w * bits + 1, F.lit(bits))
        return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / bits).cast("int")), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def int8(v: Column) -> Column:
    """Components scaled so that the largest magnitude is 127, rounded to bytes."""
    most = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: F.when(most == 0, F.lit(0)).otherwise(F.round(x * 127 / most)).cast("tinyint"))
