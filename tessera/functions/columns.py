"""Column expressions: sizes, capacity units, segments, expiry."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The start and the factor of the hash that deals items to segments.
FNV_START, FNV_FACTOR = 1469598103934665603, 1099511628211


def number_text(column: Column, kind: T.DataType) -> Column:
    """A number as its canonical text."""
    text = column.cast("string")
    if isinstance(kind, T.IntegralType):
        return text
    plain = F.when(F.abs(column) < 1e15, column.cast("decimal(38,18)").cast("string")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def value_size(column: Column, kind: T.DataType, is_set: bool = False) -> Column:
    """Bytes of a value by the sizing rule; null if it is missing."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(column).cast("long")
    if isinstance(kind, T.NumericType):
        return F.octet_length(number_text(column, kind)).cast("long")
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNotNull(), F.lit(1).cast("long"))
    if isinstance(kind, T.ArrayType):
        extra = 0 if is_set else 1
        sizes = F.transform(column, lambda x: F.coalesce(value_size(x, kind.elementType), F.lit(1).cast("long")) + extra)
        return F.lit(3) + F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    if isinstance(kind, T.StructType):
        parts = [F.coalesce(F.lit(len(f.name.encode())) + value_size(column.getField(f.name), f.dataType) + 1, F.lit(0).cast("long")) for f in kind]
        return F.when(column.isNotNull(), sum(parts, F.lit(3).cast("long")))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.octet_length(e.key).cast("long") + value_size(e.value, kind.valueType) + 1)
        return F.lit(3) + F.aggregate(entries, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.octet_length(column.cast("string")).cast("long")


def item_size(df: DataFrame, sets: frozenset[str] = frozenset()) -> Column:
    """Bytes of an item: of the names and values of the attributes it has."""
    parts = [F.coalesce(F.lit(len(f.name.encode())) + value_size(F.col(f"`{f.name}`"), f.dataType, f.name in sets), F.lit(0).cast("long")) for f in df.schema]
    return sum(parts[1:], parts[0])


def read_units(size: Column, consistent: bool = True, transactional: bool = False) -> Column:
    units = F.ceil(size / 4096) * ((1.0 if consistent else 0.5) * (2 if transactional else 1))
    return F.greatest(F.lit(0.5), units.cast("double"))


def write_units(size: Column, transactional: bool = False) -> Column:
    return F.greatest(F.lit(1.0), (F.ceil(size / 1024) * (2 if transactional else 1)).cast("double"))


def live(ttl: Column, now: int) -> Column:
    """Not expired at ``now`` (epoch seconds): only whole numbers expire."""
    return ttl.isNull() | (ttl > now) | (ttl != F.floor(ttl))


def encoded_key(column: Column, tag: str) -> Column:
    """Hex of the order-preserving key bytes of a value: a type letter, then
    text with zero bytes escaped and a terminator, or a number's double."""
    if tag == "N":
        bits = F.hex(_double_bits(column.cast("double")))
        return F.concat(F.lit("4E"), F.lpad(bits, 16, "0"))
    raw = F.hex(column.cast("binary"))
    escaped = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(column.cast("binary")) - 1), lambda i: F.when(F.substring(raw, i * 2 + 1, F.lit(2)) == "00", "00FF").otherwise(F.substring(raw, i * 2 + 1, F.lit(2)))), ""), F.lit("0000"))
    return F.concat(F.lit("53" if tag == "S" else "42"), F.when(F.octet_length(column.cast("binary")) == 0, "0000").otherwise(escaped))


def _double_bits(d: Column) -> Column:
    """IEEE bits of a double, with the order of numbers made that of bytes."""
    size = F.abs(d)
    exponent = F.when(size == 0, 0).otherwise(F.floor(F.log2(size)))
    exponent = F.when(F.pow(F.lit(2.0), exponent) > size, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= size, exponent + 1).otherwise(exponent)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((exponent + 1023).cast("long"), 52) + fraction)
    return F.when(d < 0, F.bitwise_not(bits.bitwiseOR(F.lit(-(1 << 63))))).otherwise(bits.bitwiseOR(F.lit(-(1 << 63))))


def fnv1a(hex_bytes: Column) -> Column:
    """64-bit FNV hash of bytes given as hex, as decimal(20,0).

    Decimals, for 64-bit products that wrap raise an error in ANSI mode.  The
    low byte is the only one that the exclusive-or touches.
    """

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(hex_bytes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        low = F.pmod(h, F.lit(256).cast("decimal(20,0)")).cast("int")
        mixed = (h - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)")).cast("decimal(20,0)")
        # The factor is 2**40 + 435, so the product stays within 38 digits.
        product = (mixed.cast("decimal(24,0)") * F.lit(FNV_FACTOR).cast("decimal(13,0)")).cast("decimal(38,0)")
        return F.pmod(product, F.lit(Decimal(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")

    places = F.sequence(F.lit(0), (F.length(hex_bytes) / 2).cast("int") - 1)
    return F.aggregate(places, F.lit(FNV_START).cast("decimal(20,0)"), step)
