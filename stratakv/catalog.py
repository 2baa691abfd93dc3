"""What the engine knows about tables: keys, order, statics, masks, indexes, types, roles."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Native types of the query language as Spark types. Timeuuid, uuid, inet are text; time is
#: nanoseconds of the day; a duration is (months, days, nanos).
NATIVE: dict[str, T.DataType] = {
    "ascii": T.StringType(), "text": T.StringType(), "varchar": T.StringType(), "uuid": T.StringType(),
    "timeuuid": T.StringType(), "inet": T.StringType(), "boolean": T.BooleanType(), "tinyint": T.ByteType(),
    "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "counter": T.LongType(),
    "varint": T.DecimalType(38, 0), "decimal": T.DecimalType(38, 10), "float": T.FloatType(),
    "double": T.DoubleType(), "blob": T.BinaryType(), "date": T.DateType(), "time": T.LongType(),
    "timestamp": T.TimestampType(),
    "duration": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())]),
}


class InvalidRequest(ValueError):
    """A statement that the language's rules reject."""


class Unauthorized(PermissionError):
    """A statement that the role may not run."""


@dataclass
class Column:
    name: str
    type: str
    kind: str = "regular"  # partition, clustering, static, regular
    descending: bool = False
    mask: tuple[str, tuple] | None = None


@dataclass
class Cell:
    """A written value (None: a tombstone) with its write time and the second it expires."""

    value: Any
    wt: int
    expire_at: int | None = None
    ttl: int | None = None

    def beats(self, other: Cell | None) -> bool:
        """Newer wins; at one time a tombstone beats a value, and the greater value the smaller."""
        if other is None or self.wt != other.wt:
            return other is None or self.wt > other.wt
        if self.value is None or other.value is None:
            return self.value is None
        return repr(self.value) > repr(other.value) if type(self.value) is not type(other.value) else str(self.value) > str(other.value) if isinstance(self.value, (dict, list)) else self.value > other.value


@dataclass
class Row:
    """A row as statements wrote it: cells, the time it was last deleted, the time it was inserted."""

    cells: dict[str, Cell] = field(default_factory=dict)
    deleted_at: int = -1
    marker: Cell | None = None

    def write(self, name: str, cell: Cell) -> None:
        if cell.beats(self.cells.get(name)):
            self.cells[name] = cell

    def delete(self, wt: int) -> None:
        self.deleted_at = max(self.deleted_at, wt)

    def current(self, name: str, now: int) -> Cell | None:
        c = self.cells.get(name)
        if c is None or c.wt <= self.deleted_at or c.value is None or (c.expire_at is not None and c.expire_at <= now):
            return None
        return c

    def alive(self, now: int) -> bool:
        m = self.marker
        marked = m is not None and m.wt > self.deleted_at and (m.expire_at is None or m.expire_at > now)
        return marked or any(self.current(n, now) for n in self.cells)


@dataclass
class Table:
    """A table: a base DataFrame (bulk data, older than any statement) and rows written by statements."""

    name: str
    columns: dict[str, Column]
    base: DataFrame | None = None
    flushed: bool = False  # the base has write times, expiry and deletions (see Session.flush)
    default_ttl: int = 0
    rows: dict[tuple, Row] = field(default_factory=dict)
    statics: dict[tuple, Row] = field(default_factory=dict)
    base_deletes: list = field(default_factory=list)
    indexes: dict[str, tuple[str, str, dict]] = field(default_factory=dict)  # name -> column, target, options
    triggers: dict[str, Any] = field(default_factory=dict)
    source: tuple[str, list, str] | None = None  # of a view: base table, selected names, where text

    def of_kind(self, kind: str) -> list[Column]:
        return [c for c in self.columns.values() if c.kind == kind]

    @property
    def partition(self) -> list[str]:
        return [c.name for c in self.of_kind("partition")]

    @property
    def clustering(self) -> list[str]:
        return [c.name for c in self.of_kind("clustering")]

    @property
    def key(self) -> list[str]:
        return self.partition + self.clustering

    @property
    def counters(self) -> bool:
        return any(c.type == "counter" for c in self.columns.values())

    def indexed(self, column: str) -> bool:
        return any(c == column for c, _, _ in self.indexes.values())


@dataclass
class Function:
    name: str
    args: list[tuple[str, str]]
    returns: str
    language: str
    body: str
    null_in_null_out: bool


@dataclass
class Aggregate:
    name: str
    arg: str
    step: str
    state: str
    final: str | None
    initial: Any


@dataclass
class Catalog:
    keyspaces: dict[str, dict] = field(default_factory=lambda: {"ks": {}})
    current: str = "ks"
    tables: dict[tuple[str, str], Table] = field(default_factory=dict)
    types: dict[tuple[str, str], list[tuple[str, str]]] = field(default_factory=dict)
    functions: dict[tuple[str, str], list[Function]] = field(default_factory=dict)
    aggregates: dict[tuple[str, str], Aggregate] = field(default_factory=dict)
    roles: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    def qualified(self, name: str) -> tuple[str, str]:
        ks, _, t = name.rpartition(".")
        ks = ks or self.current
        if ks not in self.keyspaces:
            raise InvalidRequest(f"no keyspace {ks}")
        return ks, t

    def table(self, name: str) -> Table:
        try:
            return self.tables[self.qualified(name)]
        except KeyError:
            raise InvalidRequest(f"no table {name}") from None

    def spark_type(self, text: str) -> T.DataType:
        """The Spark type of a type's text: native, collection, tuple, vector, frozen or user type."""
        text = text.strip()
        head, _, rest = text.partition("<")
        head = head.strip().lower()
        if not rest:
            if head in NATIVE:
                return NATIVE[head]
            fields = self.types.get(self.qualified(text.strip('"')))
            if fields is None:
                raise InvalidRequest(f"no type {text}")
            return T.StructType([T.StructField(n, self.spark_type(t)) for n, t in fields])
        inner = _split_types(rest.rstrip()[:-1])
        if head == "frozen":
            return self.spark_type(inner[0])
        if head in ("list", "set"):
            return T.ArrayType(self.spark_type(inner[0]))
        if head == "vector":
            if not 0 < int(inner[1]) <= 8192:
                raise InvalidRequest("a vector has 1 to 8192 dimensions")
            return T.ArrayType(self.spark_type(inner[0]), False)
        if head == "map":
            return T.MapType(self.spark_type(inner[0]), self.spark_type(inner[1]))
        if head == "tuple":
            return T.StructType([T.StructField(f"_{i}", self.spark_type(t)) for i, t in enumerate(inner)])
        raise InvalidRequest(f"no type {text}")

    def schema(self, table: Table) -> T.StructType:
        return T.StructType([T.StructField(c.name, self.spark_type(c.type)) for c in table.columns.values()])

    def may(self, role: str | None, permission: str, on: str) -> bool:
        if role is None:
            return True
        have = self.roles.get(role, set())
        return bool({(permission, on), ("all", on), (permission, "*"), ("all", "*")} & have)


def _split_types(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]
