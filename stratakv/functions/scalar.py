"""Scalar functions: arithmetic, time, blobs, masks, collections, text folding, tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _whole(n: int) -> Column:
    """A literal beyond 64 bits."""
    return F.lit(str(n)).cast("decimal(38,0)")


def wrap(value: Column, kind: str) -> Column:
    """A whole number (as DECIMAL(38,0) or long) cut to the type's bits, as machine integers wrap."""
    bits = _BITS[kind]
    span, half = _whole(2**bits), _whole(2 ** (bits - 1))
    return (F.pmod(value.cast("decimal(38,0)") + half, span) - half).cast(kind)


def add(a: Column, b: Column, kind: str) -> Column:
    return wrap(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"), kind) if kind in _BITS else a + b


def subtract(a: Column, b: Column, kind: str) -> Column:
    return wrap(a.cast("decimal(20,0)") - b.cast("decimal(20,0)"), kind) if kind in _BITS else a - b


def multiply(a: Column, b: Column, kind: str) -> Column:
    if kind == "bigint":  # up to 127 bits: 38 digits
        return wrap(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), kind)
    return wrap(a.cast("decimal(10,0)") * b.cast("decimal(10,0)"), kind) if kind in _BITS else a * b


def divide(a: Column, b: Column, kind: str) -> Column:
    """Whole numbers are cut toward zero and division by zero is an error; doubles give infinity or NaN."""
    if kind in _BITS:
        a, b = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
        zero = F.raise_error(F.lit("division by zero")).cast("decimal(38,0)")
        quotient = F.floor(F.abs(a) / F.abs(b)).cast("decimal(38,0)")
        return F.when(b == 0, zero).otherwise(wrap(F.when((a < 0) != (b < 0), -quotient).otherwise(quotient), kind)).cast(kind)
    big = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, big).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign."""
    return a % b


def negate(a: Column, kind: str) -> Column:
    return subtract(F.lit(0), a, kind) if kind in _BITS else -a


_WIDTH = ["tinyint", "smallint", "int", "bigint", "varint"]


def result_type(a: str, b: str) -> str:
    """The type of an operation on two numeric types."""
    if "decimal" in (a, b):
        return "decimal"
    floats = {"float", "double"}
    if a in floats or b in floats:
        whole = [x for x in (a, b) if x not in floats]
        if "varint" in whole:
            return "decimal"
        return "double" if "double" in (a, b) or "bigint" in whole else "float"
    return max(a, b, key=lambda t: _WIDTH.index("bigint" if t == "counter" else t)).replace("counter", "bigint")


def in_type(f: Callable[[Column], Column], x: Column, kind: str) -> Column:
    """exp, log, log10 on a typed number: the result has the input's type (whole numbers are cut)."""
    y = f(x.cast("double"))
    return F.when(y >= 0, F.floor(y)).otherwise(F.ceil(y)).cast(kind) if kind in _BITS else y.cast(kind)


def round_half_up(x: Column) -> Column:
    """The nearest whole number; halves go up (-2.5 to -2)."""
    return F.floor(x + 0.5).cast("double")


def exp(x: Column, kind: str = "double") -> Column:
    return in_type(F.exp, x, kind)


def log(x: Column, kind: str = "double") -> Column:
    return in_type(F.ln, x, kind)


def log10(x: Column, kind: str = "double") -> Column:
    return in_type(F.log10, x, kind)


# --- durations and time ------------------------------------------------------

_UNITS = {"y": (12, 0, 0), "mo": (1, 0, 0), "w": (0, 7, 0), "d": (0, 1, 0), "h": (0, 0, 3600 * 10**9), "m": (0, 0, 60 * 10**9), "s": (0, 0, 10**9), "ms": (0, 0, 10**6), "us": (0, 0, 10**3), "µs": (0, 0, 10**3), "ns": (0, 0, 1)}


def parse_duration(text: str) -> tuple[int, int, int]:
    """(months, days, nanoseconds) of ``89h4m48s``, ``P1Y2M3DT4H``, ``P3W`` or ``P0001-02-03T04:05:06``."""
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text)
    total = [0, 0, 0]

    def take(n: int, unit: str) -> None:
        for i, u in enumerate(_UNITS[unit]):
            total[i] += sign * n * u

    if m := re.fullmatch(r"P(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)", body):
        for n, unit in zip(m.groups(), ("y", "mo", "d", "h", "m", "s"), strict=True):
            take(int(n), unit)
    elif m := re.fullmatch(r"P(\d+)W", body):
        take(int(m[1]), "w")
    elif m := re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", body):
        for n, unit in zip(m.groups(), ("y", "mo", "d", "h", "m", "s"), strict=True):
            take(int(n or 0), unit)
    elif body and re.fullmatch(r"(?:\d+(?:mo|ms|us|µs|ns|y|w|d|h|m|s))+", body, re.I):
        for n, unit in re.findall(r"(\d+)(mo|ms|us|µs|ns|y|w|d|h|m|s)", body, re.I):
            take(int(n), unit.lower())
    else:
        raise ValueError(f"no duration: {text}")
    return tuple(total)


def plus_duration(t: Column, duration: str, minus: bool = False) -> Column:
    """A timestamp plus (or minus) a duration: months, then days, then time of day."""
    months, days, nanos = parse_duration(duration)
    k = -1 if minus else 1
    return t + F.make_interval(F.lit(0), F.lit(k * months), F.lit(0), F.lit(k * days), F.lit(0), F.lit(0), F.lit(k * nanos / 1e9))


def date_plus(d: Column, duration: str, minus: bool = False) -> Column:
    """A date plus a duration of days or longer."""
    months, days, nanos = parse_duration(duration)
    if nanos:
        raise ValueError("a date needs a duration in days")
    k = -1 if minus else 1
    return F.date_add(F.add_months(d, k * months), k * days)


#: 100 ns units between the start of the Gregorian calendar and 1970.
GREGORIAN = 0x01B21DD213814000


def timeuuid_ticks(u: Column) -> Column:
    """100 ns units since the Gregorian start within a version 1 uuid's text."""
    hexed = F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8))
    return F.conv(hexed, 16, 10).cast("long")


def timeuuid_millis(u: Column) -> Column:
    ticks = timeuuid_ticks(u) - F.lit(GREGORIAN)
    return ((ticks - F.pmod(ticks, F.lit(10000))) / 10000).cast("long")  # exact: a multiple of 16 below 2^57


def timeuuid_timestamp(u: Column) -> Column:
    return F.timestamp_millis(timeuuid_millis(u))


def timeuuid_bound(millis: Column, largest: bool) -> Column:
    """The smallest or largest version 1 uuid text of a millisecond."""
    ticks = millis * 10000 + F.lit(GREGORIAN) + (9999 if largest else 0)
    h = F.lpad(F.hex(ticks), 16, "0")
    tail = "7f7f-7f7f7f7f7f7f" if largest else "8080-808080808080"
    return F.lower(F.concat(F.substring(h, 9, 8), F.lit("-"), F.substring(h, 5, 4), F.lit("-1"), F.substring(h, 2, 3), F.lit("-" + tail)))


# --- blobs --------------------------------------------------------------------

_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "timestamp": 8}


def as_blob(x: Column, kind: str) -> Column:
    """Big-endian bytes of a value."""
    if kind in ("text", "ascii", "varchar"):
        return F.encode(x, "utf-8")
    if kind == "boolean":
        return F.unhex(F.when(x, "01").otherwise("00"))
    n = F.unix_millis(x) if kind == "timestamp" else x.cast("long")
    return F.unhex(F.right(F.lpad(F.hex(n), 16, "0"), F.lit(2 * _BYTES[kind])))


def blob_as(b: Column, kind: str) -> Column:
    """The value of big-endian bytes; another length than the type's is an error."""
    if kind in ("text", "ascii", "varchar"):
        return F.decode(b, "utf-8")
    size = _BYTES[kind]
    wrong = F.raise_error(F.lit(f"a {kind} has {size} bytes")).cast("decimal(38,0)")
    n = F.when(F.octet_length(b) == size, F.conv(F.hex(b), 16, 10).cast("decimal(38,0)")).when(b.isNotNull(), wrong)
    signed = F.when(n >= _whole(2 ** (8 * size - 1)), n - _whole(2 ** (8 * size))).otherwise(n).cast("long")
    if kind == "boolean":
        return signed != 0
    return F.timestamp_millis(signed) if kind == "timestamp" else signed.cast(kind)


# --- masks --------------------------------------------------------------------

def mask_null(kind: T.DataType | str) -> Column:
    return F.lit(None).cast(kind)


def mask_default(kind: T.DataType | str) -> Column:
    """The type's constant, whatever the value (also for null)."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.StringType):
        return F.lit("****")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.DateType):
        return F.to_date(F.lit("1970-01-01"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(F.lit(0))
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    raise ValueError(f"no default mask for {kind.simpleString()}")


def mask_replace(value) -> Column:
    return F.lit(value)


def mask_inner(x: Column, begin: int | None, end: int | None, pad: str = "*") -> Column:
    """Keeps ``begin`` characters at the front and ``end`` at the back, pads what is between."""
    a, b = begin or 0, end or 0
    n = F.length(x)
    return F.when(n <= a + b, x).otherwise(F.concat(F.left(x, F.lit(a)), F.repeat(F.lit(pad), n - a - b), F.right(x, F.lit(b))))


def mask_outer(x: Column, begin: int | None, end: int | None, pad: str = "*") -> Column:
    """Pads ``begin`` characters at the front and ``end`` at the back, keeps what is between."""
    a, b = begin or 0, end or 0
    n = F.length(x)
    middle = F.substr(x, F.lit(a + 1), n - a - b)
    return F.when(n <= a + b, F.repeat(F.lit(pad), n)).otherwise(F.concat(F.repeat(F.lit(pad), F.lit(a)), middle, F.repeat(F.lit(pad), F.lit(b))))


_HASHES = {"SHA-256": lambda b: F.sha2(b, 256), "SHA-224": lambda b: F.sha2(b, 224), "SHA-384": lambda b: F.sha2(b, 384), "SHA-512": lambda b: F.sha2(b, 512), "SHA-1": F.sha1, "MD5": F.md5}


def mask_hash(blob: Column, algorithm: str = "SHA-256") -> Column:
    """The digest of a value's bytes, as a blob."""
    try:
        return F.unhex(_HASHES[algorithm.upper()](blob))
    except KeyError:
        raise ValueError(f"no hash algorithm {algorithm}") from None


# --- collections --------------------------------------------------------------

def list_append(x: Column, y: Column) -> Column:
    return F.concat(F.coalesce(x, F.slice(y, 1, 0)), y)


def list_prepend(x: Column, y: Column) -> Column:
    return F.concat(y, F.coalesce(x, F.slice(y, 1, 0)))


def list_set(x: Column, i: int, value: Column) -> Column:
    """Index from 0; one out of bounds is an error (as is a null list)."""
    bound = F.when(F.size(x) > i, F.lit(True)).otherwise(F.raise_error(F.lit(f"list index {i} out of bound")).cast("boolean"))
    return F.when(bound, F.transform(x, lambda v, k: F.when(k == i, value).otherwise(v)))


def list_remove(x: Column, values: Column) -> Column:
    """All elements that are among ``values`` go; order and repeats of the rest stay."""
    return F.filter(x, lambda v: ~F.array_contains(values, v))


def list_delete(x: Column, i: int) -> Column:
    return F.filter(x, lambda v, k: k != i)


def set_of(x: Column) -> Column:
    """A set: distinct elements in order."""
    return F.array_sort(F.array_distinct(x))


def set_add(x: Column, y: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(x, F.slice(y, 1, 0)), y))


def set_remove(x: Column, y: Column) -> Column:
    return F.array_except(x, y)


def map_of(m: Column) -> Column:
    """A map in the order of its keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def map_put(m: Column, other: Column) -> Column:
    """Entries of ``other`` win."""
    mine = F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(other), k))
    return map_of(F.map_concat(F.coalesce(mine, F.map_filter(other, lambda k, v: F.lit(False))), other))


def map_remove(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(keys, k))


def collection_count(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(x))


def collection_sum(x: Column, kind: str = "bigint") -> Column:
    return F.aggregate(x, F.lit(0).cast(kind), lambda s, v: (s + F.coalesce(v, F.lit(0))).cast(kind))


def collection_avg(x: Column, kind: str = "bigint") -> Column:
    """The mean in the elements' type; 0 for an empty collection."""
    mean = collection_sum(x, "double" if kind not in _BITS else kind) / F.size(x)
    mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)) if kind in _BITS else mean
    return F.when(F.size(x) == 0, F.lit(0)).otherwise(mean).cast(kind)


# --- text -----------------------------------------------------------------------

def _folded(s: pd.Series, normalize: bool, ascii_only: bool) -> pd.Series:
    import unicodedata

    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        if normalize:
            t = unicodedata.normalize("NFC", t)
        if ascii_only:
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return t

    return s.map(fold)


def analyzed(x: Column, case_sensitive: bool = True, normalize: bool = False, ascii_only: bool = False) -> Column:
    """Text as an index compares it: lower case, NFC, ASCII look-alikes, as asked for."""
    out = x if case_sensitive else F.lower(x)
    if not (normalize or ascii_only):
        return out

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return _folded(s, normalize, ascii_only)

    return fold(out)


def tokens(x: Column, stop_words: Sequence[str] = (), lower: bool = True) -> Column:
    """Words of a text without stop words."""
    words = F.regexp_extract_all(F.lower(x) if lower else x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


# --- partitioner token --------------------------------------------------------------

_M = (1 << 64) - 1
# Multipliers of the public Murmur3 hash (128 bits, x64).
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _fmix(k: int) -> int:
    k ^= k >> 33
    k = k * 0xFF51AFD7ED558CCD & _M
    k ^= k >> 33
    k = k * 0xC4CEB9FE1A85EC53 & _M
    return k ^ (k >> 33)


def murmur3_token(data: bytes) -> int:
    """First 64 bits of the 128-bit x64 Murmur3 hash, seed 0, with tail bytes taken as signed.

    The smallest long stands for no token, so it maps to the largest.
    """
    c1, c2, h1, h2 = _C1, _C2, 0, 0
    whole = len(data) // 16
    for i in range(whole):
        k1 = int.from_bytes(data[16 * i : 16 * i + 8], "little")
        k2 = int.from_bytes(data[16 * i + 8 : 16 * i + 16], "little")
        h1 ^= _rotl(k1 * c1 & _M, 31) * c2 & _M
        h1 = (_rotl(h1, 27) + h2) * 5 + 0x52DCE729 & _M
        h2 ^= _rotl(k2 * c2 & _M, 33) * c1 & _M
        h2 = (_rotl(h2, 31) + h1) * 5 + 0x38495AB5 & _M
    tail = [b - 256 if b > 127 else b for b in data[16 * whole :]]
    k1 = k2 = 0
    for i, b in enumerate(tail[8:]):
        k2 ^= (b << (8 * i)) & _M
    for i, b in enumerate(tail[:8]):
        k1 ^= (b << (8 * i)) & _M
    if len(tail) > 8:
        h2 ^= _rotl(k2 * c2 & _M, 33) * c1 & _M
    if tail:
        h1 ^= _rotl(k1 * c1 & _M, 31) * c2 & _M
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = h1 + h2 & _M
    h2 = h2 + h1 & _M
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = h1 + h2 & _M
    signed = h1 - (1 << 64) if h1 >> 63 else h1
    return (1 << 63) - 1 if signed == -(1 << 63) else signed


def token(*blobs: Column) -> Column:
    """The partitioner's token of a partition key given as blobs; null if any part is null.

    Several parts are joined as length (2 bytes), bytes, and a zero byte each.
    """

    @F.pandas_udf("long")
    def hashed(*parts: pd.Series) -> pd.Series:
        if len(parts) == 1:
            keys = [None if b is None else bytes(b) for b in parts[0]]
        else:
            joined = zip(*parts, strict=True)
            keys = [None if any(b is None for b in row) else b"".join(len(b).to_bytes(2, "big") + bytes(b) + b"\0" for b in row) for row in joined]
        out = pd.array([None] * len(keys), dtype="Int64")
        by_length: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            if k is not None:
                by_length.setdefault(len(k), []).append(i)
        for n, at in by_length.items():  # all keys of one length at once
            data = np.frombuffer(b"".join(keys[i] for i in at), dtype=np.uint8).reshape(len(at), n)
            out[at] = murmur3_tokens(data)
        return pd.Series(out)

    return hashed(*blobs)


def murmur3_tokens(data: np.ndarray) -> np.ndarray:
    """``murmur3_token`` of the rows of a byte matrix."""
    u = np.uint64
    rotl = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    c1, c2 = u(_C1), u(_C2)
    rows, n = data.shape
    h1, h2 = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64)
    whole = n // 16
    words = np.ascontiguousarray(data[:, : 16 * whole]).view("<u8").reshape(rows, 2 * whole)
    for i in range(whole):
        h1 ^= rotl(words[:, 2 * i] * c1, 31) * c2
        h1 = (rotl(h1, 27) + h2) * u(5) + u(0x52DCE729)
        h2 ^= rotl(words[:, 2 * i + 1] * c2, 33) * c1
        h2 = (rotl(h2, 31) + h1) * u(5) + u(0x38495AB5)
    tail = data[:, 16 * whole :].view(np.int8).astype(np.int64).view(np.uint64)
    k1, k2 = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64)
    for i in range(tail.shape[1]):
        if i < 8:
            k1 ^= tail[:, i] << u(8 * i)
        else:
            k2 ^= tail[:, i] << u(8 * (i - 8))
    if tail.shape[1] > 8:
        h2 ^= rotl(k2 * c2, 33) * c1
    if tail.shape[1]:
        h1 ^= rotl(k1 * c1, 31) * c2

    def fmix(k: np.ndarray) -> np.ndarray:
        k = (k ^ (k >> u(33))) * u(0xFF51AFD7ED558CCD)
        k = (k ^ (k >> u(33))) * u(0xC4CEB9FE1A85EC53)
        return k ^ (k >> u(33))

    h1, h2 = h1 ^ u(n), h2 ^ u(n)
    h1 = h1 + h2
    h2 = h2 + h1
    out = (fmix(h1) + fmix(h2)).view(np.int64)
    return np.where(out == np.iinfo(np.int64).min, np.iinfo(np.int64).max, out)


def fast_token(*keys: Column) -> Column:
    """A 64-bit token by a built-in hash, for layouts that need no agreement with other systems."""
    return F.when(F.greatest(*(k.isNull().cast("int") for k in keys)) == 0 if len(keys) > 1 else keys[0].isNotNull(), F.xxhash64(*keys))
