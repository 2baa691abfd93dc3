"""Merge operators: how the operands of a key become one value.

A fold maps (operand column, seq column) to an aggregate column. Those whose result does not
depend on the order of operands aggregate partially before the shuffle; the others collect a key's
operands, sort them by sequence number, and fold them in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fold = Callable[[Column, Column], Column]


def in_order(operand: Column, seq: Column) -> Column:
    """The operands of a group as an array, oldest first."""
    pairs = F.array_sort(F.collect_list(F.struct(seq.alias("seq"), operand.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def put(operand: Column, seq: Column) -> Column:
    """The newest operand."""
    return F.max_by(operand, seq)


def uint64add(operand: Column, seq: Column) -> Column:
    """The sum, which wraps at 64 bits; an operand that is no number counts as 0."""
    high, low = F.shiftrightunsigned(number(operand), 32), number(operand).bitwiseAND(F.lit(0xFFFFFFFF))
    low_sum = F.sum(low)
    high_sum = (F.sum(high) + F.shiftrightunsigned(low_sum, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(high_sum, 32).bitwiseOR(low_sum.bitwiseAND(F.lit(0xFFFFFFFF)))


def number(operand: Column) -> Column:
    return F.coalesce(operand.try_cast("long"), F.lit(0).cast("long"))


def largest(operand: Column, seq: Column) -> Column:
    """The largest operand, bytewise for text and binary."""
    return F.max(operand)


def bytesxor(operand: Column, seq: Column) -> Column:
    """XOR of 64-bit operands (as unsigned numbers of 8 bytes)."""
    return F.bit_xor(operand)


def xor_bytes(a: Column, b: Column) -> Column:
    """XOR of two binary values; the longer one's tail is kept."""
    def byte(x: Column, i: Column) -> Column:
        return F.conv(F.coalesce(F.nullif(F.substring(F.hex(x), F.lit(1), F.lit(0)), F.lit("")), F.substr(F.hex(x), i * 2 + 1, F.lit(2))), 16, 10).try_cast("int")

    n = F.greatest(F.octet_length(a), F.octet_length(b))
    digits = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.lpad(F.hex(F.coalesce(byte(a, i), F.lit(0)).bitwiseXOR(F.coalesce(byte(b, i), F.lit(0)))), 2, "0"),
    )
    return F.when(n == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(digits, "")))


def string_append(delimiter: str = ",") -> Fold:
    """All operands in order, joined."""
    return lambda operand, seq: F.array_join(in_order(operand.cast("string"), seq), delimiter)


def sort_list(operand: Column, seq: Column) -> Column:
    """Operands are lists of ints; the result is all of them, sorted."""
    return F.array_sort(F.flatten(F.collect_list(operand)))


def newest(n: int) -> Fold:
    """The newest n operands, newest first. (``reconcile.merged`` with ``newest=n`` keeps a key to n operands before they are collected.)"""
    return lambda operand, seq: F.slice(F.reverse(in_order(operand, seq)), 1, n)


def total(operand: Column, seq: Column) -> Column:
    """Counter: the sum of the deltas."""
    return F.sum(operand)


REGISTRY: dict[str, Fold] = {
    "put": put,
    "uint64add": uint64add,
    "max": largest,
    "bytesxor": bytesxor,
    "stringappend": string_append(),
    "stringappendtest": string_append(),
    "sortlist": sort_list,
    "counter": total,
}


def fold(name: str) -> Fold:
    """A registered merge operator by name."""
    try:
        return REGISTRY[name]
    except KeyError:
        raise ValueError(f"no merge operator {name}") from None


def register(name: str, how: Fold) -> None:
    REGISTRY[name] = how


def _prefixed(value: Column) -> Column:
    """Bytes after their length: seven bits a byte, lowest first, the high bit set on all but the last."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    part = lambda shift, more: F.lpad(F.hex(F.shiftright(n, shift).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if more else 0))), 2, "0")
    size = F.when(n < 1 << 7, part(0, False)).when(n < 1 << 14, F.concat(part(0, True), part(7, False)))
    size = size.when(n < 1 << 21, F.concat(part(0, True), part(7, True), part(14, False)))
    size = size.otherwise(F.concat(part(0, True), part(7, True), part(14, True), part(21, False)))
    return F.concat(F.unhex(size), raw)


def encode_operand(op: Column) -> Column:
    """An operand as bytes: the function's length and name, then the payload."""
    return F.concat(_prefixed(op["func"]), op["payload"].cast("binary"))


def encode_operands(operands: Column) -> Column:
    """A list of operands as bytes: each one's length and encoding."""
    each = F.transform(operands, lambda o: F.hex(_prefixed(encode_operand(o))))
    return F.unhex(F.array_join(each, ""))


def aggregate_merge(operands: Column) -> Column:
    """Named aggregates: operands are structs (func, payload) in order, oldest first.

    ``sum`` and ``mul`` fold numbers as text, ``last3`` comma-separated lists (three entries of the
    newest lists, each list in its own order), ``""`` puts. When the function changes, the result
    so far becomes the first operand of the new one. An unknown function or a payload that is no
    number ends in (func "error", the list of all encoded operands, see ``encode_operands``).
    """
    first = F.struct(F.lit("").alias("func"), F.lit(None).cast("string").alias("payload"), F.lit(False).alias("bad"))

    def step(acc: Column, op: Column) -> Column:
        func, value, old = op["func"], op["payload"], acc["payload"]
        a, b = old.try_cast("long"), value.try_cast("long")
        numeric = func.isin("sum", "mul")
        fresh = old.isNull()
        combined = (
            F.when(func == "", value)
            .when(func == "sum", F.when(fresh, value).otherwise((a + b).cast("string")))
            .when(func == "mul", F.when(fresh, value).otherwise((a * b).cast("string")))
            .when(
                func == "last3",
                F.array_join(F.slice(F.concat(F.split(value, ","), F.when(fresh, F.array().cast("array<string>")).otherwise(F.split(old, ","))), 1, 3), ","),
            )
        )
        bad = acc["bad"] | ~func.isin("", "sum", "mul", "last3") | (numeric & (b.isNull() | (~fresh & a.isNull())))
        return F.struct(func.alias("func"), combined.alias("payload"), bad.alias("bad"))

    def finish(acc: Column) -> Column:
        return F.struct(
            F.when(acc["bad"], F.lit("error")).otherwise(acc["func"]).alias("func"),
            F.when(acc["bad"], encode_operands(operands).cast("string")).otherwise(acc["payload"]).alias("payload"),
        )

    return F.aggregate(operands, first, step, finish)
