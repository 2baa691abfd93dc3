"""Statements to DataFrames: rules of the language, lowering of SELECT, writes, catalog statements.

A SELECT becomes one declarative plan over the table's base DataFrame, so filters and columns
reach the scan. Rows written by statements (a bounded, driver-side write buffer) are laid over the
base by a broadcast join on the key; ``flush`` turns them into a new base.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Aggregate, Catalog, Cell, Column, Function, InvalidRequest, Row, Table, Unauthorized
from ..functions import scalar
from ..operators import vectors
from ..storage import scratch
from . import parser as P

MAX_TTL = 20 * 365 * 24 * 3600
_AGGREGATES = {"count", "sum", "avg", "min", "max"}
_MONOTONIC = {"floor", "to_date"}
_WHOLE = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint"}


class Session:
    """Runs statements. ``clock`` gives the time in microseconds (write times, expiry, now())."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, clock: Callable[[], int] | None = None, role: str | None = None, guardrails: dict[str, int] | None = None):
        self.spark, self.catalog, self.role = spark, catalog or Catalog(), role
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.guardrails = guardrails or {}
        self.buffer_rows = 50_000  # rows that statements wrote; beyond them a table is flushed into the shared folder
        self.last = 0
        self.prepared: dict[str, Any] = {}
        self.index_classes: dict[str, Callable[[C, Any], C]] = {}
        self.trigger_classes: dict[str, Callable[[dict], list[str]]] = {}

    # -- entry points ---------------------------------------------------------------------------
    def execute(self, text: str, params: Sequence | dict | None = None) -> DataFrame | None:
        statement = self.prepared.get(text) or self.prepared.setdefault(text, P.parse(text))
        return self.run(statement, params if params is not None else ())

    def run(self, s, params) -> DataFrame | None:
        if isinstance(s, P.Select):
            self.check("select", s.table)
            return Lowering(self, s, params).plan()
        if isinstance(s, P.Ddl):
            return Definitions(self).run(s)
        writer = Writer(self, params)
        if isinstance(s, P.Batch):
            out = writer.batch(s)
        else:
            self.check("modify", s.table)
            out = writer.one(s)
        for name in {x.table for x in (s.statements if isinstance(s, P.Batch) else [s])}:
            self.spill(name)
        return out

    def check(self, permission: str, table: str) -> None:
        ks, t = self.catalog.qualified(table)
        if not (self.catalog.may(self.role, permission, f"{ks}.{t}") or self.catalog.may(self.role, permission, t)):
            raise Unauthorized(f"{self.role} may not {permission} {table}")

    def register(self, name: str, base: DataFrame, partition: Sequence[str], clustering: Sequence[str] = (), descending: Sequence[str] = (), statics: Sequence[str] = (), indexed: Sequence[str] = ()) -> Table:
        """A table over existing data, which counts as written before any statement."""
        names = {T.StringType: "text", T.IntegerType: "int", T.LongType: "bigint", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.TimestampType: "timestamp", T.DateType: "date", T.BinaryType: "blob", T.ShortType: "smallint", T.ByteType: "tinyint"}

        def name_of(kind: T.DataType) -> str:
            if isinstance(kind, T.ArrayType):
                return f"list<{name_of(kind.elementType)}>"
            if isinstance(kind, T.MapType):
                return f"map<{name_of(kind.keyType)}, {name_of(kind.valueType)}>"
            return names.get(type(kind), "text")

        columns = {}
        for f in base.schema.fields:
            kind = "partition" if f.name in partition else "clustering" if f.name in clustering else "static" if f.name in statics else "regular"
            columns[f.name] = Column(f.name, name_of(f.dataType), kind, f.name in descending)
        order = [*partition, *clustering, *(c for c in columns if c not in partition and c not in clustering)]
        table = Table(name, {c: columns[c] for c in order}, base)
        for c in indexed:
            table.indexes[f"{name}_{c}_idx"] = (c, "values", {})
        self.catalog.tables[self.catalog.qualified(name)] = table
        return table

    def now(self) -> int:
        return self.clock() // 1_000_000

    def tick(self) -> int:
        """A write time: the clock's, but later than that of every write before."""
        self.last = max(self.last + 1, self.clock())
        return self.last

    # -- values -----------------------------------------------------------------------------------
    def value(self, term, params, kind: T.DataType | None = None) -> Any:
        """A term without columns as a Python value of the Spark type."""
        tag = term[0]
        if tag == "lit":
            return convert(term[1], kind)
        if tag == "duration":
            m, d, n = scalar.parse_duration(term[1])
            return {"months": m, "days": d, "nanos": n}
        if tag == "bind":
            try:
                return convert(params[term[1]], kind)
            except (IndexError, KeyError, TypeError):
                raise InvalidRequest(f"no value for bind marker {term[1]}") from None
        if tag == "neg":
            return convert(-self.value(term[1], params), kind)
        if tag == "list":
            return [self.value(x, params, getattr(kind, "elementType", None)) for x in term[1]]
        if tag == "tuple":
            if isinstance(kind, T.StructType):
                return {f.name: self.value(x, params, f.dataType) for f, x in zip(kind.fields, term[1], strict=True)}
            return tuple(self.value(x, params) for x in term[1])
        if tag == "braces":
            if isinstance(kind, T.StructType):
                given = {k[1]: v for k, v in term[1]}
                return {f.name: self.value(given[f.name], params, f.dataType) if f.name in given else None for f in kind.fields}
            if term[1] and isinstance(term[1][0], tuple) and len(term[1][0]) == 2 and isinstance(term[1][0][0], tuple):
                pairs = {self.value(k, params, getattr(kind, "keyType", None)): self.value(v, params, getattr(kind, "valueType", None)) for k, v in term[1]}
                return dict(sorted(pairs.items()))
            if isinstance(kind, T.MapType):
                return {}
            return sorted({self.value(x, params, getattr(kind, "elementType", None)) for x in term[1]})
        if tag == "hint":
            return self.value(term[2], params, self.catalog.spark_type(term[1]))
        if tag == "op":
            a, b = self.value(term[2], params), self.value(term[3], params)
            return convert({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: int(a / b) if isinstance(a, int) and isinstance(b, int) else a / b, "%": lambda: a - b * int(a / b)}[term[1]](), kind)
        if tag == "call":
            if term[1] in ("now", "current_timeuuid", "currenttimeuuid"):
                return str(timeuuid(self.clock()))
            if term[1] == "uuid":
                return str(uuid.uuid4())
            moment = dt.datetime.fromtimestamp(self.clock() / 1e6, dt.timezone.utc)
            if term[1] in ("current_timestamp", "currenttimestamp"):
                return convert(moment, kind)
            if term[1] in ("current_date", "currentdate"):
                return moment.date()
            if term[1] in ("current_time", "currenttime"):
                return (self.clock() % 86_400_000_000) * 1000
            if term[1] in ("from_json", "fromjson"):
                return from_json(json.loads(self.value(term[2][0], params)), kind)
            row = self.spark.range(1).select(Expressions(self, None, params).column(term).alias("v")).first()
            return convert(row["v"], kind)
        raise InvalidRequest(f"no constant: {term}")

    # -- tables ---------------------------------------------------------------------------------------
    def live(self, table: Table, metadata: bool = False) -> DataFrame:
        """The table's current rows; with ``metadata`` also ``_wt_c`` and ``_ttl_c`` of regular columns.

        Rows that statements wrote lie over the base by key: the base without their keys (broadcast
        anti join, as the buffer is bounded), and their own rows merged with the base rows of just
        those keys. Predicates on keys reach the scan of the base on both sides.
        """
        if table.source:
            return self.view_rows(table)
        names = list(table.columns)
        others = [c.name for c in table.columns.values() if c.kind in ("regular", "static")]
        touched = bool(table.rows or table.statics)
        if table.base is None and not touched:
            base = self.spark.createDataFrame([], self.catalog.schema(table))
            return with_metadata(base, others) if metadata else base
        out = None
        if table.base is not None:
            base = self.base_rows(table)
            if touched:
                base = base.join(F.broadcast(self.written(table).select(*table.key)), table.key, "left_anti")
            if table.flushed:
                out = self.visible(table, base)
            else:
                out = with_metadata(base.select(*names), others) if metadata else base.select(*names)
        if touched:
            own = self.visible(table, self.overlaid(table))
            own = own if metadata or table.flushed else own.select(*names)
            out = own if out is None else out.unionByName(own)
        return out if metadata else out.select(*names)

    def base_rows(self, table: Table) -> DataFrame:
        """Rows of the base that no range delete removes, as they are stored."""
        base = table.base
        added = {c: self.catalog.spark_type(table.columns[c].type) for c in table.columns if c not in base.columns}
        if table.flushed:
            added |= {f"{p}_{c}": T.LongType() for c in list(added) for p in ("_wt", "_ex")}
        if added:  # columns that came after the data
            base = base.withColumns({c: F.lit(None).cast(t) for c, t in added.items()})
        for gone, wt in table.base_deletes:
            gone = F.coalesce(gone, F.lit(False))
            if table.flushed:
                newest = F.greatest(F.col("_mark_wt"), *(F.col(f"_wt_{c}") for c in table.columns if c not in table.key), F.lit(-1))
                gone = gone & (newest <= wt)
            base = base.where(~gone)
        return base

    def stored(self, table: Table, base: DataFrame) -> DataFrame:
        """Base rows with write times and expiry of cells and marker; bulk data counts as written at 0."""
        if table.flushed:
            return base
        others = [c for c in table.columns if c not in table.key]
        none = F.lit(None).cast("long")
        return base.select(
            *table.columns, *(F.when(F.col(c).isNotNull(), 0).cast("long").alias(f"_wt_{c}") for c in others), *(none.alias(f"_ex_{c}") for c in others),
            F.lit(0).cast("long").alias("_mark_wt"), none.alias("_mark_ex"), F.lit(-1).cast("long").alias("_del"),
        )

    def overlaid(self, table: Table) -> DataFrame:
        """The buffer's rows as stored rows, each cell the newer one of the buffer's and the base's."""
        memory = self.written(table)
        if table.base is None:
            return memory
        key, names = table.key, [c for c in memory.columns if c not in table.key]
        found = self.stored(table, self.base_rows(table).join(F.broadcast(memory.select(*key)), key, "left_semi"))
        both = memory.join(found.select(*key, *(F.col(c).alias(f"b_{c}") for c in names)), key, "left")

        def newer(c: str, wt: str) -> C:
            m, b = F.col(wt), F.col(f"b_{wt}")
            tie = F.lit(True)
            if wt == f"_wt_{c}" and not isinstance(memory.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)):
                tie = F.col(c).isNull() | F.coalesce(F.col(c) >= F.col(f"b_{c}"), F.lit(False))  # a tombstone, then the greater value
            return m.isNotNull() & (b.isNull() | (m > b) | ((m == b) & tie))

        cells = [c.name for c in table.columns.values() if c.kind in ("regular", "static")]
        pick = lambda c, wt, of: F.when(newer(of, wt), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
        return both.select(
            *key, *(pick(c, f"_wt_{c}", c) for c in cells), *(pick(f"_wt_{c}", f"_wt_{c}", c) for c in cells), *(pick(f"_ex_{c}", f"_wt_{c}", c) for c in cells),
            pick("_mark_wt", "_mark_wt", "_mark"), pick("_mark_ex", "_mark_wt", "_mark"), F.greatest("_del", "b__del").alias("_del"),
        )

    def visible(self, table: Table, rows: DataFrame) -> DataFrame:
        """Live rows of stored rows: names, _wt_c, _ttl_c."""
        now = F.lit(self.now())
        unexpired = lambda ex: F.col(ex).isNull() | (F.col(ex) > now)

        def shown(c: str) -> C:
            beyond = F.lit(True) if table.columns[c].kind == "static" else F.col(f"_wt_{c}") > F.col("_del")
            return F.col(c).isNotNull() & beyond & unexpired(f"_ex_{c}")

        regular = [c.name for c in table.of_kind("regular")]
        cells = regular + [c.name for c in table.of_kind("static")]
        alive = F.coalesce((F.col("_mark_wt") > F.col("_del")) & unexpired("_mark_ex"), F.lit(False))
        for c in regular:
            alive = alive | F.coalesce(shown(c), F.lit(False))
        value = lambda c: F.when(shown(c), F.col(c)).alias(c)
        return rows.where(alive).select(
            *(c if c in table.key else value(c) for c in table.columns),
            *(F.when(shown(c), F.col(f"_wt_{c}")).alias(f"_wt_{c}") for c in cells),
            *(F.when(shown(c), F.col(f"_ex_{c}") - now).alias(f"_ttl_{c}") for c in cells),
        )

    def written(self, table: Table) -> DataFrame:
        """Rows of the write buffer as stored rows: columns, _wt_c, _ex_c, _mark_wt, _mark_ex, _del."""
        key, schema, now = table.key, self.catalog.schema(table), self.now()
        regular, statics = [c.name for c in table.of_kind("regular")], [c.name for c in table.of_kind("static")]
        n = len(table.partition)
        shown = {k[:n] for k, r in table.rows.items() if r.alive(now)}
        rows = [(k, r, table.statics.get(k[:n], Row()), r.marker) for k, r in table.rows.items()]
        for p, s in table.statics.items():
            if p not in shown and table.base is None and (live := [x for c in statics if (x := s.current(c, now))]):
                rows.append((p + (None,) * (len(key) - n), Row(), s, max(live, key=lambda x: x.wt)))
        data = []
        for k, r, s, mark in rows:
            cells = [r.cells.get(c) for c in regular] + [x if (x := s.cells.get(c)) and x.wt > s.deleted_at else None for c in statics]
            data.append(
                (*k, *(x.value if x else None for x in cells), *(x.wt if x else None for x in cells), *(x.expire_at if x else None for x in cells),
                 mark.wt if mark else None, mark.expire_at if mark else None, r.deleted_at)
            )
        names = regular + statics
        fields = [T.StructField(c, schema[c].dataType) for c in key + names]
        fields += [T.StructField(f"{p}_{c}", T.LongType()) for p in ("_wt", "_ex") for c in names]
        fields += [T.StructField(c, T.LongType()) for c in ("_mark_wt", "_mark_ex", "_del")]
        return self.spark.createDataFrame(data, T.StructType(fields))

    def view_rows(self, view: Table) -> DataFrame:
        """A materialized view's rows: its base's rows re-keyed, with null keys left out."""
        base, names, where = view.source
        rows = self.live(self.catalog.table(base))
        for c in view.key:
            rows = rows.where(F.col(c).isNotNull())
        if where is not None:
            rows = rows.where(where)
        return rows.select(*names)

    def flush(self, name: str, path: str) -> None:
        """Writes the table's rows, clustered by key, and makes them its base.

        Write times, expiry and deletions are written with the cells, so what is written later is
        weighed against them as if nothing had been flushed.
        """
        table = self.catalog.table(name)
        rows = None
        if table.base is not None:
            rows = self.stored(table, self.base_rows(table))
            if table.rows or table.statics:
                rows = rows.join(F.broadcast(self.written(table).select(*table.key)), table.key, "left_anti")
        if table.rows or table.statics or rows is None:
            own = self.overlaid(table)
            rows = own if rows is None else rows.unionByName(own)
        rows.repartition(*(F.col(c) for c in table.partition)).sortWithinPartitions(*table.key).write.parquet(path)
        table.base, table.flushed = self.spark.read.schema(rows.schema).parquet(path), True
        table.rows, table.statics, table.base_deletes = {}, {}, []

    def spill(self, name: str) -> None:
        """Flushes a table whose buffer has more rows than the bound into the shared folder."""
        table = self.catalog.table(name)
        if len(table.rows) > self.buffer_rows and not table.statics:
            self.flush(name, scratch(self.spark, f"flush-{table.name}"))


def with_metadata(df: DataFrame, names: list[str]) -> DataFrame:
    wt = [F.when(F.col(c).isNotNull(), 0).cast("long").alias(f"_wt_{c}") for c in names]
    return df.select("*", *wt, *(F.lit(None).cast("long").alias(f"_ttl_{c}") for c in names))


def timeuuid(micros: int) -> uuid.UUID:
    """A version 1 uuid of a moment, with fixed node and clock sequence."""
    t = micros * 10 + scalar.GREGORIAN
    return uuid.UUID(fields=(t & 0xFFFFFFFF, (t >> 32) & 0xFFFF, (t >> 48) & 0x0FFF | 0x1000, 0x80, 0x80, 0x808080808080))


def convert(v: Any, kind: T.DataType | None) -> Any:
    """A literal as the Python value that Spark wants for a type."""
    if v is None or kind is None:
        return v
    if isinstance(kind, (T.TimestampType, T.DateType)):
        if isinstance(v, str):
            v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
        elif isinstance(v, int):
            v = dt.datetime.fromtimestamp(v / 1000, dt.timezone.utc)
        if isinstance(v, dt.datetime) and v.tzinfo is None and isinstance(kind, T.TimestampType):
            v = v.replace(tzinfo=dt.timezone.utc)
        return v.date() if isinstance(kind, T.DateType) and isinstance(v, dt.datetime) else v
    if isinstance(kind, T.LongType) and isinstance(v, str) and (m := re.fullmatch(r"(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?", v)):
        return ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 10**9 + int((m[4] or "").ljust(9, "0"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(v)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(v))
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        if isinstance(v, bool) or not isinstance(v, int):
            raise InvalidRequest(f"{v!r} is no {kind.simpleString()}")
        return v
    if isinstance(kind, T.StringType) and not isinstance(v, str):
        raise InvalidRequest(f"{v!r} is no text")
    if isinstance(kind, T.ArrayType):
        return [convert(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {convert(k, kind.keyType): convert(x, kind.valueType) for k, x in v.items()}
    return v


def from_json(v: Any, kind: T.DataType | None) -> Any:
    """A parsed JSON value as the type's Python value."""
    if v is None or kind is None:
        return v
    if isinstance(kind, T.BinaryType):
        return bytes.fromhex(v[2:])
    if isinstance(kind, T.StructType):
        given = v if isinstance(v, dict) else dict(zip(kind.fieldNames(), v))
        return {f.name: from_json(given.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [from_json(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {from_json(k if isinstance(kind.keyType, T.StringType) else json.loads(k), kind.keyType): from_json(x, kind.valueType) for k, x in v.items()}
    if isinstance(v, str) and isinstance(kind, (T.NumericType, T.BooleanType)):
        v = json.loads(v.lower() if isinstance(kind, T.BooleanType) else v)
    return convert(v, kind)


class Expressions:
    """Terms with columns as Spark columns, with the language's types and functions."""

    def __init__(self, session: Session, table: Table | None, params, df: DataFrame | None = None):
        self.s, self.table, self.params, self.df = session, table, params, df

    def type_of(self, x: C) -> T.DataType:
        base = self.df if self.df is not None else self.s.spark.range(1)
        return base.select(x.alias("v")).schema[0].dataType

    def literal(self, value: Any, kind: T.DataType) -> C:
        if value is None:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.ArrayType):
            return F.array(*(self.literal(v, kind.elementType) for v in value)).cast(kind)
        if isinstance(kind, T.MapType):
            flat = [x for k, v in value.items() for x in (self.literal(k, kind.keyType), self.literal(v, kind.valueType))]
            return F.create_map(*flat).cast(kind)
        if isinstance(kind, T.StructType):
            return F.struct(*(self.literal(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields))
        return F.lit(value).cast(kind)

    def typed(self, term, kind: T.DataType) -> C:
        """A term that must have a type: constants are converted, others cast."""
        if not has_columns(term):
            return self.literal(self.s.value(term, self.params, kind), kind)
        return self.column(term).cast(kind)

    def column(self, term) -> C:
        tag = term[0]
        if tag == "col":
            if self.table is not None and term[1] not in self.table.columns:
                raise InvalidRequest(f"no column {term[1]}")
            return F.col(f"`{term[1]}`")
        if tag in ("lit", "bind"):
            return F.lit(self.s.value(term, self.params))
        if tag == "hint":
            kind = self.s.catalog.spark_type(term[1])
            return self.typed(term[2], kind)
        if tag == "cast":
            kind = self.s.catalog.spark_type(term[2])
            return self.column(term[1]).cast(kind)
        if tag == "neg":
            x = self.column(term[1])
            return scalar.negate(x, _WHOLE.get(type(self.type_of(x)), "double"))
        if tag == "op":
            return self.operation(term)
        if tag in ("list", "tuple"):
            parts = [self.column(x) for x in term[1]]
            return F.array(*parts) if tag == "list" else F.struct(*(p.alias(f"_{i}") for i, p in enumerate(parts)))
        if tag == "braces":
            if term[1] and isinstance(term[1][0][0], tuple):
                return F.create_map(*(self.column(x) for pair in term[1] for x in pair))
            return scalar.set_of(F.array(*(self.column(x) for x in term[1])))
        if tag == "field":
            return self.column(term[1]).getField(term[2])
        if tag == "item":
            x = self.column(term[1])
            kind = self.type_of(x)
            if isinstance(kind, T.MapType):
                return F.try_element_at(x, self.typed(term[2], kind.keyType))
            return F.get(x, self.column(term[2]))
        if tag == "call":
            return self.call(term[1], term[2])
        raise InvalidRequest(f"no expression: {term}")

    def operation(self, term) -> C:
        _, op, left, right = term
        a, b = self.column(left) if left[0] != "duration" else None, None
        if right[0] == "duration":
            kind = self.type_of(a)
            how = scalar.date_plus if isinstance(kind, T.DateType) else scalar.plus_duration
            return how(a, right[1], op == "-")
        b = self.column(right)
        ka, kb = self.type_of(a), self.type_of(b)
        if isinstance(ka, T.StringType) and op == "+":
            return F.concat(a, b)
        # constants of whole numbers take the other side's type
        names = {**_WHOLE, T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "decimal"}
        na, nb = names.get(type(ka)), names.get(type(kb))
        if na is None or nb is None:
            raise InvalidRequest(f"no operation {ka.simpleString()} {op} {kb.simpleString()}")
        if left[0] == "lit" and na == "int":
            na = nb
        if right[0] == "lit" and nb == "int":
            nb = na
        kind = scalar.result_type(na, nb)
        if kind not in ("decimal", "varint"):
            a, b = a.cast(kind), b.cast(kind)
        f = {"+": scalar.add, "-": scalar.subtract, "*": scalar.multiply, "/": scalar.divide, "%": lambda x, y, k: scalar.modulo(x, y)}[op]
        return f(a, b, kind)

    def call(self, name: str, args: list) -> C:
        builtin = getattr(self, "f_" + name.replace("system.", ""), None)
        if builtin:
            return builtin(args)
        ks, f = self.s.catalog.qualified(name)
        own = self.s.catalog.functions.get((ks, f))
        if own:
            return self.user(own, args)
        agg = self.s.catalog.aggregates.get((ks, f))
        if agg:
            return self.user_aggregate(agg, args)
        raise InvalidRequest(f"no function {name}")

    def user(self, overloads: list[Function], args: list) -> C:
        for f in overloads:
            if len(f.args) == len(args) and all(self.fits(a, t) for a, (_, t) in zip(args, f.args, strict=True)):
                kinds = [self.s.catalog.spark_type(t) for _, t in f.args]
                return self.apply(f, [self.typed(a, k) for a, k in zip(args, kinds, strict=True)])
        raise InvalidRequest(f"no overload of {overloads[0].name} fits; use type casts to disambiguate")

    def fits(self, term, kind: str) -> bool:
        if not has_columns(term) and term[0] in ("lit", "bind", "neg"):
            try:
                self.s.value(term, self.params, self.s.catalog.spark_type(kind))
                return True
            except (InvalidRequest, ValueError, TypeError):
                return False
        return self.type_of(self.column(term)) == self.s.catalog.spark_type(kind)

    def apply(self, f: Function, args: list[C]) -> C:
        """A user function: an SQL expression over its argument names, or a Python expression."""
        kind = self.s.catalog.spark_type(f.returns)
        if f.language == "sql":
            out = substitute(f.body, {n: a for (n, _), a in zip(f.args, args, strict=True)}).cast(kind)
        elif f.language == "python":
            body, names = f.body.strip(), [n for n, _ in f.args]
            if isinstance(kind, T.StructType):  # a user type or tuple: a mapping or a sequence of its fields
                fields = kind.fieldNames()

                def build(*row):
                    out = eval(body, {}, dict(zip(names, row)))  # noqa: S307  the user's own function
                    return tuple(out.get(n) for n in fields) if isinstance(out, dict) else out

                out = F.udf(build, kind, useArrow=True)(*args)
            else:

                @F.pandas_udf(kind)
                def run(*columns: pd.Series) -> pd.Series:
                    code = compile(body, "<function>", "eval")
                    rows = zip(*(c.astype(object).where(c.notna(), None) for c in columns))
                    return pd.Series([eval(code, {}, dict(zip(names, row))) for row in rows])  # noqa: S307  the user's own function

                out = run(*args)
        else:
            raise InvalidRequest(f"no language {f.language}")
        if f.null_in_null_out and args:
            some = args[0].isNull()
            for a in args[1:]:
                some = some | a.isNull()
            out = F.when(~some, out)
        return out

    def user_aggregate(self, agg: Aggregate, args: list) -> C:
        find = lambda n: self.s.catalog.functions[self.s.catalog.qualified(n)][0]
        state = self.s.catalog.spark_type(agg.state)
        step, final = find(agg.step), find(agg.final) if agg.final else None
        value = self.typed(args[0], self.s.catalog.spark_type(agg.arg))
        order = F.struct(*self.table.key) if self.table is not None and self.table.key else F.lit(0)
        values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda p: p["v"])
        start = self.s.value(agg.initial, self.params, state) if agg.initial else None
        done = (lambda acc: self.apply(final, [acc])) if final else (lambda acc: acc)
        if step.language == "python":
            return done(self.folded(step, state, values, start))
        if final and final.language == "python":
            return done(F.aggregate(values, self.literal(start, state), lambda acc, v: self.apply(step, [acc, v])))
        initial = self.literal(start, state)
        return F.aggregate(values, initial, lambda acc, v: self.apply(step, [acc, v]), done)

    @staticmethod
    def folded(step: Function, state: T.DataType, values: C, start: Any) -> C:
        """A Python state function over an array of values in order."""
        body, names = step.body.strip(), [n for n, _ in step.args]
        strict, fields = step.null_in_null_out, state.fieldNames() if isinstance(state, T.StructType) else None

        def run(items):
            acc, code = start, compile(body, "<function>", "eval")
            for v in items:
                if not (strict and (acc is None or v is None)):
                    acc = eval(code, {}, dict(zip(names, (acc, v))))  # noqa: S307  the user's own function
            return tuple(acc.get(n) for n in fields) if fields and isinstance(acc, dict) else acc

        return F.udf(run, state, useArrow=True)(values)

    # -- built-in functions ---------------------------------------------------------------------
    def numeric(self, f, args: list) -> C:
        x = self.column(args[0])
        return f(x, _WHOLE.get(type(self.type_of(x)), self.type_of(x).simpleString()))

    def f_abs(self, a): return F.abs(self.column(a[0]))  # noqa: E704
    def f_floor(self, a): return F.floor(self.column(a[0]))  # noqa: E704
    def f_exp(self, a): return self.numeric(scalar.exp, a)  # noqa: E704
    def f_log(self, a): return self.numeric(scalar.log, a)  # noqa: E704
    def f_log10(self, a): return self.numeric(scalar.log10, a)  # noqa: E704

    def f_round(self, a):
        x = self.column(a[0])
        return x if type(self.type_of(x)) in _WHOLE else scalar.round_half_up(x)

    def f_token(self, a):
        blobs = []
        for x in a:
            c = self.column(x)
            kind = {**_WHOLE, T.StringType: "text", T.BooleanType: "boolean", T.TimestampType: "timestamp"}.get(type(self.type_of(c)))
            blobs.append(c if kind is None else scalar.as_blob(c, kind))
        return scalar.token(*blobs)

    def f_to_json(self, a):
        x = self.column(a[0])
        return json_text(x, self.type_of(x))

    f_tojson = f_to_json

    def f_from_json(self, a): raise InvalidRequest("from_json is no selector")  # noqa: E704
    f_fromjson = f_from_json

    def f_to_timestamp(self, a):
        x = self.column(a[0])
        return scalar.timeuuid_timestamp(x) if isinstance(self.type_of(x), T.StringType) else x.cast("timestamp")

    f_totimestamp = f_to_timestamp

    def f_to_unix_timestamp(self, a):
        x = self.column(a[0])
        return scalar.timeuuid_millis(x) if isinstance(self.type_of(x), T.StringType) else F.unix_millis(x.cast("timestamp"))

    f_tounixtimestamp = f_to_unix_timestamp

    def f_to_date(self, a): return F.to_date(self.f_to_timestamp(a))  # noqa: E704
    f_todate = f_to_date
    def f_min_timeuuid(self, a): return scalar.timeuuid_bound(F.unix_millis(self.typed(a[0], T.TimestampType())), False)  # noqa: E704
    def f_max_timeuuid(self, a): return scalar.timeuuid_bound(F.unix_millis(self.typed(a[0], T.TimestampType())), True)  # noqa: E704
    f_mintimeuuid, f_maxtimeuuid = f_min_timeuuid, f_max_timeuuid

    def constant(self, name: str) -> C:
        return F.lit(self.s.value(("call", name, []), self.params))

    def f_now(self, a): return self.constant("now")  # noqa: E704
    def f_uuid(self, a): return F.uuid()  # noqa: E704
    def f_current_timestamp(self, a): return self.constant("current_timestamp")  # noqa: E704
    def f_current_date(self, a): return self.constant("current_date")  # noqa: E704
    def f_current_time(self, a): return self.constant("current_time")  # noqa: E704
    def f_current_timeuuid(self, a): return self.constant("now")  # noqa: E704

    def similarity(self, which: str, args: list) -> C:
        a, b = ([self.s.value(x, self.params) if not has_columns(x) else self.column(x) for x in args])
        wrap = lambda v: vectors.vector(v) if isinstance(v, (list, tuple)) else v if isinstance(v, C) else F.lit(None).cast("array<float>")
        return vectors.SIMILARITIES[which](wrap(a), wrap(b))

    def f_similarity_cosine(self, a): return self.similarity("cosine", a)  # noqa: E704
    def f_similarity_euclidean(self, a): return self.similarity("euclidean", a)  # noqa: E704
    def f_similarity_dot_product(self, a): return self.similarity("dot_product", a)  # noqa: E704

    def f_mask_null(self, a): return scalar.mask_null(self.type_of(self.column(a[0])))  # noqa: E704
    def f_mask_default(self, a): return scalar.mask_default(self.type_of(self.column(a[0])))  # noqa: E704
    def f_mask_replace(self, a): return self.typed(a[1], self.type_of(self.column(a[0])))  # noqa: E704

    def cut_mask(self, f, a) -> C:
        rest = [self.s.value(x, self.params) for x in a[1:]]
        return f(self.column(a[0]), *rest)

    def f_mask_inner(self, a): return self.cut_mask(scalar.mask_inner, a)  # noqa: E704
    def f_mask_outer(self, a): return self.cut_mask(scalar.mask_outer, a)  # noqa: E704

    def f_mask_hash(self, a):
        x = self.column(a[0])
        kind = {**_WHOLE, T.StringType: "text", T.BooleanType: "boolean", T.TimestampType: "timestamp"}.get(type(self.type_of(x)))
        blob = x if kind is None else scalar.as_blob(x, kind)
        return scalar.mask_hash(blob, *(self.s.value(v, self.params) for v in a[1:]))

    def f_map_keys(self, a): return scalar.set_of(F.map_keys(self.column(a[0])))  # noqa: E704
    def f_map_values(self, a): return F.map_values(scalar.map_of(self.column(a[0])))  # noqa: E704
    def f_collection_count(self, a): return scalar.collection_count(self.column(a[0]))  # noqa: E704
    def f_collection_min(self, a): return F.array_min(self.column(a[0]))  # noqa: E704
    def f_collection_max(self, a): return F.array_max(self.column(a[0]))  # noqa: E704

    def element_kind(self, x: C) -> str:
        return _WHOLE.get(type(self.type_of(x).elementType), "double")

    def f_collection_sum(self, a): x = self.column(a[0]); return scalar.collection_sum(x, self.element_kind(x))  # noqa: E702, E704
    def f_collection_avg(self, a): x = self.column(a[0]); return scalar.collection_avg(x, self.element_kind(x))  # noqa: E702, E704

    # -- aggregates --------------------------------------------------------------------------------
    def f_count(self, a):
        return F.count(F.lit(1)) if a[0][0] in ("star", "lit") else F.count(self.column(a[0]))

    def f_sum(self, a):
        x = self.column(a[0])
        kind = self.type_of(x)
        if type(kind) in _WHOLE:
            return F.coalesce(scalar.wrap(F.sum(x.cast("decimal(28,0)")), _WHOLE[type(kind)]), F.lit(0).cast(kind))
        return F.coalesce(F.sum(x).cast(kind), F.lit(0).cast(kind))

    def f_avg(self, a):
        x = self.column(a[0])
        kind = self.type_of(x)
        mean = F.coalesce(F.avg(x), F.lit(0.0))
        if type(kind) in _WHOLE:
            mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean))
        return mean.cast(kind)

    def f_min(self, a): return F.min(self.column(a[0]))  # noqa: E704
    def f_max(self, a): return F.max(self.column(a[0]))  # noqa: E704

    # -- cell metadata --------------------------------------------------------------------------------
    def metadata(self, a, prefix: str) -> C:
        name = a[0][1]
        kind = self.table.columns[name].kind
        if kind in ("partition", "clustering"):
            raise InvalidRequest(f"no write time or TTL of the key column {name}")
        return F.col(f"_{prefix}_{name}")

    def f_writetime(self, a): return self.metadata(a, "wt")  # noqa: E704
    def f_maxwritetime(self, a): return self.metadata(a, "wt")  # noqa: E704
    def f_ttl(self, a): return self.metadata(a, "ttl")  # noqa: E704


def _blob_function(kind: str, to: bool):
    def f(self, a):
        x = self.column(a[0])
        return scalar.as_blob(x, kind) if to else scalar.blob_as(x, kind)

    return f


for _k in ("boolean", "tinyint", "smallint", "int", "bigint", "timestamp", "text", "ascii", "varchar"):
    for _n, _to in ((f"{_k}_as_blob", True), (f"blob_as_{_k}", False), (f"{_k}asblob", True), (f"blobas{_k}", False)):
        setattr(Expressions, "f_" + _n, _blob_function(_k, _to))


def substitute(body: str, args: dict[str, C]) -> C:
    """An SQL expression over named arguments, which are bound by a one-element transform."""
    if not args:
        return F.expr(body)
    names = list(args)
    row = F.struct(*(c.alias(n) for n, c in args.items()))
    text = re.sub(r"'(?:[^']|'')*'|\b(" + "|".join(names) + r")\b", lambda m: f"x.`{m[1]}`" if m[1] else m[0], body)
    return F.element_at(F.call_function("transform", F.array(row), F.expr(f"x -> {text}")), 1)


def json_text(x: C, kind: T.DataType) -> C:
    """JSON text of a value: blobs as 0x text, maps and structs as objects, sets as lists."""
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit('"0x'), F.lower(F.hex(x)), F.lit('"'))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(x)
    whole = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def has_columns(term) -> bool:
    if not isinstance(term, tuple) or not term:
        return False
    if term[0] == "col" or (term[0] == "call" and term[1] in _AGGREGATES | {"writetime", "ttl", "maxwritetime"}):
        return True
    return any(has_columns(x) if isinstance(x, tuple) else any(has_columns(y) if not (isinstance(y, tuple) and y and isinstance(y[0], tuple)) else any(map(has_columns, y)) for y in x) if isinstance(x, list) else False for x in term[1:])


def is_aggregate(session: Session, term) -> bool:
    if not isinstance(term, tuple) or not term:
        return False
    if term[0] == "call":
        if term[1] in _AGGREGATES or session.catalog.qualified(term[1]) in session.catalog.aggregates:
            return True
        return any(is_aggregate(session, a) for a in term[2])
    return any(is_aggregate(session, x) for x in term[1:] if isinstance(x, tuple))


def label(term) -> str:
    """The name that the language gives a selector."""
    if term[0] == "col":
        return term[1]
    if term[0] == "call":
        return f"{term[1]}({', '.join('*' if a[0] == 'star' else label(a) for a in term[2])})" if term[2] and term[2] != [("star",)] else ("count" if term[1] == "count" else f"{term[1]}()")
    if term[0] == "cast":
        return f"cast({label(term[1])} as {term[2]})"
    if term[0] == "field":
        return f"{label(term[1])}.{term[2]}"
    if term[0] == "item":
        return f"{label(term[1])}[{label(term[2])}]"
    if term[0] == "op":
        return f"{label(term[2])} {term[1]} {label(term[3])}"
    if term[0] in ("lit", "bind", "duration"):
        return repr(term[1]) if isinstance(term[1], str) and term[0] == "lit" else str(term[1])
    if term[0] == "hint":
        return f"({term[1]}){label(term[2])}"
    if term[0] == "neg":
        return f"-{label(term[1])}"
    return term[0]


class Lowering:
    """One SELECT: the rules it must obey, then its plan."""

    def __init__(self, session: Session, s: P.Select, params):
        self.session, self.s, self.params = session, s, params
        self.table = session.catalog.table(s.table)

    def plan(self) -> DataFrame:
        s, t = self.s, self.table
        equal = self.validate()
        meta = any(uses(x, {"writetime", "ttl", "maxwritetime"}) for x, _ in s.selectors)
        df = self.session.live(t, metadata=meta)
        ex = Expressions(self.session, t, self.params, df)
        for r in s.where:
            df = df.where(self.condition(r, ex))
        ex.df = df
        order = self.order(df, ex)
        if s.distinct:
            return self.distinct(df)
        selectors = self.selectors(ex)
        grouped = bool(s.group_by) or any(is_aggregate(self.session, x) for x, _ in selectors)
        if s.per_partition is not None and not grouped:
            n = self.positive(s.per_partition, "PER PARTITION LIMIT")
            clustering = [F.desc(c.name) if c.descending else F.asc(c.name) for c in t.of_kind("clustering")] or [F.lit(0)]
            at = F.row_number().over(Window.partitionBy(*t.partition).orderBy(*clustering))
            df = df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")
        if grouped:
            out = self.grouped(df, ex, selectors, equal)
        else:
            if order:
                df = df.orderBy(*order)
            out = df.select(*(self.one(x, ex).alias(n) for x, n in selectors))
            if s.limit is not None:
                # rows must be limited before the projection drops what orders them
                out = df.limit(self.positive(s.limit, "LIMIT")).select(*(self.one(x, ex).alias(n) for x, n in selectors))
        if grouped and s.limit is not None:
            out = out.limit(self.positive(s.limit, "LIMIT"))
        if s.json:
            names = [n if n.islower() or not n.isidentifier() else f'"{n}"' for n in out.columns]
            out = out.select(F.to_json(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(out.columns, names, strict=True))), {"ignoreNullFields": "false"}).alias("[json]"))
        return out

    def positive(self, term, what: str) -> int:
        n = self.session.value(term, self.params)
        if not isinstance(n, int) or n <= 0:
            raise InvalidRequest(f"{what} must be positive")
        return n

    def selectors(self, ex: Expressions) -> list[tuple[Any, str]]:
        out = []
        for x, alias in self.s.selectors:
            if x == ("star",):
                out += [(("col", c), c) for c in self.table.columns]
            else:
                out.append((x, alias or label(x)))
        for x, _ in out:
            if nested_aggregate(self.session, x):
                raise InvalidRequest("aggregates can't be nested")
        return out

    def one(self, term, ex: Expressions) -> C:
        """A selector's column, masked unless the role may see it."""
        if term[0] == "col":
            mask = self.table.columns[term[1]].mask if term[1] in self.table.columns else None
            if mask and not self.sees("unmask"):
                return ex.call(mask[0], [term, *mask[1]])
        return ex.column(term)

    def sees(self, permission: str) -> bool:
        may, role = self.session.catalog.may, self.session.role
        ks, t = self.session.catalog.qualified(self.s.table)
        return may(role, permission, t) or may(role, permission, f"{ks}.{t}")

    # -- rules ------------------------------------------------------------------------------------
    def validate(self) -> set[str]:
        """Checks restrictions; returns the columns fixed by equality."""
        s, t = self.s, self.table
        by: dict[str, list[P.Relation]] = {}
        for r in s.where:
            for c in r.columns:
                if r.kind != "index" and c not in t.columns:
                    raise InvalidRequest(f"no column {c}")
                by.setdefault(c, []).append(r)
                if r.kind != "index" and t.columns[c].mask and not (self.sees("unmask") or self.sees("select_masked")):
                    raise Unauthorized(f"{c} is masked")
        for c, rs in by.items():
            ops = [r.op for r in rs if r.kind == "plain"]
            if len([o for o in ops if o == "="]) > 1 or len([o for o in ops if o in (">", ">=")]) > 1 or len([o for o in ops if o in ("<", "<=")]) > 1:
                raise InvalidRequest(f"{c} is restricted more than once")
        equal = {c for c, rs in by.items() if any(r.op == "=" and r.kind in ("plain", "tuple") for r in rs)}
        fixed = equal | {c for c, rs in by.items() if any(r.op == "in" for r in rs)}
        if sum(r.kind == "index" for r in s.where) > 1:
            raise InvalidRequest("one index expression per query")
        if any(r.op == "is not null" for r in s.where):
            raise InvalidRequest("IS NOT NULL is for views only")
        filtering = False
        tokens = [r for r in s.where if r.kind == "token"]
        for r in tokens:
            if r.columns != t.partition:
                raise InvalidRequest("token() takes the whole partition key in order")
        restricted = [c for c in t.partition if c in by and not tokens]
        if restricted and (len(restricted) < len(t.partition) or not set(restricted) <= fixed):
            filtering = True
        scan = not restricted or len(restricted) < len(t.partition)
        gap = False
        for c in t.clustering:
            if c not in by:
                gap = True
                continue
            if any(r.kind == "tuple" for r in by[c]):
                continue
            if gap or scan:
                filtering = filtering or not t.indexed(c)
            if c not in fixed:
                gap = True
        for c, rs in by.items():
            if c in t.columns and t.columns[c].kind in ("regular", "static"):
                if any(r.op in ("!=", "like", "in") and r.kind == "plain" for r in rs) or not t.indexed(c):
                    filtering = True
        for r in s.where:
            if r.kind == "tuple":
                order = [t.clustering.index(c) for c in r.columns if c in t.clustering]
                if len(order) != len(r.columns) or order != list(range(order[0], order[0] + len(order))):
                    raise InvalidRequest("a tuple relation takes clustering columns in order")
                if not set(t.clustering[: order[0]]) <= fixed:
                    raise InvalidRequest("the clustering columns before a tuple relation must be fixed")
                filtering = filtering or scan
        if filtering and not s.allow_filtering:
            raise InvalidRequest("the query may need to filter much data: use ALLOW FILTERING")
        self.check_order(by, fixed)
        limit = self.session.guardrails.get("in_values")
        for r in s.where:
            if limit and r.op == "in" and r.term[0] == "tuple" and len(r.term[1]) > limit:
                raise InvalidRequest(f"more than {limit} values")
        if self.session.guardrails.get("group_by") == 0 and s.group_by:
            raise InvalidRequest("GROUP BY is switched off")
        return equal

    def check_order(self, by, fixed: set[str]) -> None:
        s, t = self.s, self.table
        plain = [(c, d) for c, d, ann in s.order_by if ann is None]
        if any(ann is not None for *_, ann in s.order_by):
            if len(s.order_by) > 1 or s.limit is None:
                raise InvalidRequest("ANN takes one column and a LIMIT")
            if not t.indexed(s.order_by[0][0]):
                raise InvalidRequest("ANN needs an index")
            if self.session.value(s.limit, self.params) > vectors.MAX_NEIGHBOURS:
                raise InvalidRequest(f"ANN returns at most {vectors.MAX_NEIGHBOURS} rows")
            return
        if not plain:
            return
        if not set(t.partition) <= fixed:
            raise InvalidRequest("ORDER BY needs the partition key restricted by = or IN")
        free = [c for c in t.of_kind("clustering")]
        names = [c for c, _ in plain]
        if names != [c.name for c in free[: len(names)]] and names != [c.name for c in free if c.name not in fixed][: len(names)]:
            raise InvalidRequest("ORDER BY takes clustering columns in order")
        turned = {d != t.columns[c].descending for c, d in plain}
        if len(turned) > 1:
            raise InvalidRequest("ORDER BY is the declared order or its reverse")

    # -- pieces -------------------------------------------------------------------------------------
    def condition(self, r: P.Relation, ex: Expressions) -> C:
        t, catalog = self.table, self.session.catalog
        if r.kind == "index":
            column, _, options = t.indexes[r.columns[0]]
            how = self.session.index_classes.get(options.get("class", ""))
            if how is None:
                raise InvalidRequest(f"no custom index {r.columns[0]}")
            return how(F.col(column), self.session.value(r.term, self.params))
        if r.kind == "token":
            left = ex.call("token", [("col", c) for c in r.columns])
            right = ex.column(r.term) if has_columns(r.term) or r.term[0] == "call" else F.lit(self.session.value(r.term, self.params))
            return compare(left, r.op, right)
        if r.kind == "tuple":
            kinds = [catalog.spark_type(t.columns[c].type) for c in r.columns]
            left = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(r.columns)))

            def right(values) -> C:
                return F.struct(*(ex.typed(v, k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))))

            if r.op == "in":
                return left.isin(*(right(v[1] if v[0] == "tuple" else [v]) for v in r.term[1]))
            return compare(left, r.op, right(r.term[1] if r.term[0] == "tuple" else [r.term]))
        name = r.columns[0]
        kind, x = catalog.spark_type(t.columns[name].type), F.col(f"`{name}`")
        if r.kind == "item":
            if not isinstance(kind, T.MapType):
                raise InvalidRequest(f"{name} is no map")
            return compare(F.try_element_at(x, ex.typed(r.key, kind.keyType)), r.op, ex.typed(r.term, kind.valueType))
        if r.kind == "field" and r.op == "in":
            return x.getField(r.key).isin(*(ex.typed(v, kind[r.key].dataType) for v in r.term[1]))
        if r.kind == "field":
            return compare(x.getField(r.key), r.op, ex.typed(r.term, kind[r.key].dataType))
        if r.op == "contains":
            if isinstance(kind, T.MapType):
                return F.array_contains(F.map_values(x), ex.typed(r.term, kind.valueType))
            if not isinstance(kind, T.ArrayType):
                raise InvalidRequest(f"{name} is no collection")
            return F.array_contains(x, ex.typed(r.term, kind.elementType))
        if r.op == "contains key":
            if not isinstance(kind, T.MapType):
                raise InvalidRequest(f"{name} is no map")
            return F.map_contains_key(x, ex.typed(r.term, kind.keyType))
        options = next((o for c, _, o in t.indexes.values() if c == name), {})
        analyze = {k: str(options.get(k, d)).lower() == "true" for k, d in (("case_sensitive", "true"), ("normalize", "false"), ("ascii", "false"))}
        if isinstance(kind, T.StringType) and r.op == "=" and (not analyze["case_sensitive"] or analyze["normalize"] or analyze["ascii"]):
            fold = lambda c: scalar.analyzed(c, analyze["case_sensitive"], analyze["normalize"], analyze["ascii"])
            return fold(x) == fold(ex.typed(r.term, kind))
        if r.op == "in":
            values = r.term[1] if r.term[0] == "tuple" else [("lit", v) for v in self.session.value(r.term, self.params)]
            return x.isin(*(self.session.value(v, self.params, kind) for v in values)) if values else F.lit(False)
        if t.columns[name].type == "timeuuid" and r.op in ("<", "<=", ">", ">="):
            return compare(scalar.timeuuid_ticks(x), r.op, scalar.timeuuid_ticks(ex.typed(r.term, kind)))
        return compare(x, r.op, ex.typed(r.term, kind))

    def order(self, df: DataFrame, ex: Expressions) -> list[C]:
        """ORDER BY, else token order for a limit, then clustering order."""
        s, t = self.s, self.table
        if s.order_by and s.order_by[0][2] is not None:
            name, _, query = s.order_by[0]
            options = next((o for c, _, o in t.indexes.values() if c == name), {})
            how = vectors.SIMILARITIES[str(options.get("similarity_function", "cosine")).lower()]
            score = how(F.col(name), vectors.vector(self.session.value(query, self.params)))
            return [F.desc(score), *(F.asc(c) for c in t.key)]
        asked = [F.desc(c) if d else F.asc(c) for c, d, _ in s.order_by]
        natural = [F.desc(c.name) if c.descending else F.asc(c.name) for c in t.of_kind("clustering")]
        if asked:
            named = {c for c, *_ in s.order_by}
            turned = any(d != t.columns[c].descending for c, d, _ in s.order_by)
            rest = [F.desc(c.name) if c.descending != turned else F.asc(c.name) for c in t.of_kind("clustering") if c.name not in named]
            return [*asked, *rest, *(F.asc(c) for c in t.partition)]
        if s.limit is None:
            return []
        one = all(any(r.kind == "plain" and r.op == "=" and r.columns == [c] for r in s.where) for c in t.partition)
        return natural if one else [F.asc(ex.call("token", [("col", c) for c in t.partition])), *(F.asc(c) for c in t.partition), *natural]

    def distinct(self, df: DataFrame) -> DataFrame:
        names = []
        for x, alias in self.s.selectors:
            if x[0] != "col" or self.table.columns[x[1]].kind not in ("partition", "static"):
                raise InvalidRequest("DISTINCT takes partition key and static columns")
            names.append((x[1], alias or x[1]))
        statics = [F.first(c, ignorenulls=True).alias(c) for c, _ in names if c not in self.table.partition]
        keys = df.groupBy(*self.table.partition)
        out = keys.agg(*statics) if statics else df.select(*self.table.partition).distinct()
        out = out.select(*(F.col(c).alias(n) for c, n in names))
        return out.limit(self.positive(self.s.limit, "LIMIT")) if self.s.limit is not None else out

    def grouped(self, df: DataFrame, ex: Expressions, selectors, equal: set[str]) -> DataFrame:
        t, s = self.table, self.s
        keys = []
        want = [c for c in t.key]
        for g in s.group_by:
            inner = g if g[0] == "col" else next((a for a in g[2] if a[0] == "col"), None) if g[0] == "call" else None
            if inner is None:
                raise InvalidRequest("GROUP BY takes primary key columns")
            if g[0] == "call" and g[1] not in _MONOTONIC:
                raise InvalidRequest("GROUP BY takes monotonic functions only")
            while want and want[0] != inner[1] and want[0] in equal:
                want.pop(0)
            if not want or want[0] != inner[1]:
                raise InvalidRequest("GROUP BY takes the primary key's columns in order")
            want.pop(0)
            keys.append(ex.column(g))
        if s.group_by and not set(t.partition) <= {g[1] for g in s.group_by if g[0] == "col"} | equal:
            raise InvalidRequest("GROUP BY takes the whole partition key")
        position = F.struct(*(scalar_order(c) for c in [t.columns[k] for k in t.key]))
        columns = []
        for x, n in selectors:
            c = self.one(x, ex)
            columns.append((c if is_aggregate(self.session, x) else F.min_by(c, position)).alias(n))
        return df.groupBy(*(k.alias(f"_g{i}") for i, k in enumerate(keys))).agg(*columns).drop(*(f"_g{i}" for i in range(len(keys)))) if keys else df.agg(*columns)


def scalar_order(c: Column) -> C:
    """A sortable form of a key column (descending numbers and times are negated)."""
    if not c.descending:
        return F.col(f"`{c.name}`")
    if c.type in ("timestamp", "date"):
        return -F.unix_micros(F.col(f"`{c.name}`").cast("timestamp"))
    return -F.col(f"`{c.name}`")


def uses(term, names: set[str]) -> bool:
    if not isinstance(term, tuple):
        return False
    if term[:1] == ("call",) and term[1] in names:
        return True
    return any(uses(x, names) for part in term[1:] for x in (part if isinstance(part, list) else [part]))


def nested_aggregate(session: Session, term) -> bool:
    if not isinstance(term, tuple) or not term:
        return False
    if term[0] == "call":
        top = term[1] in _AGGREGATES
        return (top and any(is_aggregate(session, a) for a in term[2])) or any(nested_aggregate(session, a) for a in term[2])
    return any(nested_aggregate(session, x) for x in term[1:] if isinstance(x, tuple))


def compare(a: C, op: str, b: C) -> C:
    if op == "like":
        return F.like(a, b)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


class Writer:
    """Modifications: into the table's write buffer, with triggers and conditions."""

    def __init__(self, session: Session, params):
        self.s, self.params, self.time = session, params, None

    def batch(self, b: P.Batch) -> DataFrame | None:
        tables = [self.s.catalog.table(x.table) for x in b.statements]
        if any(t.counters for t in tables) and (b.kind != "counter" or not all(t.counters for t in tables)):
            raise InvalidRequest("counter and other modifications can't share a batch")
        if b.kind == "counter" and not all(t.counters for t in tables):
            raise InvalidRequest("a counter batch takes counters only")
        self.time = self.s.value(b.timestamp, self.params) if b.timestamp is not None else self.s.tick()
        asks = [x for x in b.statements if self.conditional(x)]
        if asks:
            if len({(x.table, str(self.keys(x)[0])) for x in b.statements}) > 1:
                raise InvalidRequest("a conditional batch is about one partition")
            if not all(self.holds(x) for x in asks):
                return self.applied(False)
        for x in b.statements:
            self.s.check("modify", x.table)
            self.write(x)
        return self.applied(True) if asks else None

    def one(self, x) -> DataFrame | None:
        if self.conditional(x):
            if not self.holds(x):
                return self.applied(False)
            self.write(x)
            return self.applied(True)
        self.write(x)
        return None

    def applied(self, yes: bool) -> DataFrame:
        return self.s.spark.createDataFrame([(yes,)], "`[applied]` boolean")

    @staticmethod
    def conditional(x) -> bool:
        return getattr(x, "if_not_exists", False) or getattr(x, "if_exists", False) or bool(getattr(x, "conditions", []))

    # -- keys and current rows ----------------------------------------------------------------------
    def keys(self, x) -> tuple[Table, list[tuple]]:
        """The full primary keys (or, for deletes, prefixes) that a modification is about."""
        t = self.s.catalog.table(x.table)
        kinds = {c: self.s.catalog.spark_type(t.columns[c].type) for c in t.columns}
        if isinstance(x, P.Insert):
            given = self.insert_values(x, t)
            if any(given.get(c) is None for c in t.partition):
                raise InvalidRequest("an insert needs the partition key")
            return t, [tuple(given.get(c) for c in t.key)]
        by: dict[str, list] = {}
        for r in x.where:
            for i, c in enumerate(r.columns):
                if c not in t.key:
                    raise InvalidRequest(f"{c} is no key column")
                if r.kind == "tuple" and r.op == "=":
                    by[c] = [self.s.value(r.term[1][i], self.params, kinds[c])]
                elif r.op == "=":
                    by[c] = [self.s.value(r.term, self.params, kinds[c])]
                elif r.op == "in" and r.kind == "plain":
                    by[c] = [self.s.value(v, self.params, kinds[c]) for v in r.term[1]]
        if any(c not in by for c in t.partition):
            raise InvalidRequest("the partition key must be given by = or IN")
        out: list[tuple] = [()]
        for c in t.key:
            if c not in by:
                break
            out = [k + (v,) for k in out for v in by[c]]
        return t, out

    def insert_values(self, x: P.Insert, t: Table) -> dict[str, Any]:
        kinds = {c: self.s.catalog.spark_type(t.columns[c].type) for c in t.columns}
        if x.json is not None:
            given = {k.strip('"') if k.startswith('"') else k.lower(): v for k, v in json.loads(self.s.value(x.json, self.params)).items()}
            unknown = set(given) - set(kinds)
            if unknown:
                raise InvalidRequest(f"no column {sorted(unknown)[0]}")
            out = {c: from_json(v, kinds[c]) for c, v in given.items()}
            return out if x.json_unset else {c: out.get(c) for c in kinds}
        if len(x.columns) != len(x.values):
            raise InvalidRequest("as many values as columns are needed")
        for c in x.columns:
            if c not in kinds:
                raise InvalidRequest(f"no column {c}")
        return {c: self.s.value(v, self.params, kinds[c]) for c, v in zip(x.columns, x.values, strict=True)}

    def current(self, t: Table, key: tuple) -> dict[str, Any] | None:
        """The current row of a key, looked up in base and buffer."""
        df = self.s.live(t)
        for c, v in zip(t.key, key):
            df = df.where(F.col(f"`{c}`").eqNullSafe(F.lit(v)))
        row = df.first()
        return row.asDict(True) if row else None

    def holds(self, x) -> bool:
        t, keys = self.keys(x)
        row = self.current(t, keys[0])
        if getattr(x, "if_not_exists", False):
            return row is None
        if getattr(x, "if_exists", False):
            return row is not None
        for r in x.conditions:
            have = row.get(r.columns[0]) if row else None
            kind = self.s.catalog.spark_type(t.columns[r.columns[0]].type)
            if r.kind == "item":
                have = (have or {}).get(self.s.value(r.key, self.params)) if isinstance(have, dict) or have is None else have[self.s.value(r.key, self.params)]
                kind = getattr(kind, "valueType", getattr(kind, "elementType", None))
            if r.op == "contains":
                kind = getattr(kind, "elementType", getattr(kind, "valueType", None))
            elif r.op == "contains key":
                kind = kind.keyType
            if r.op == "in":
                ok = have in [self.s.value(v, self.params, kind) for v in r.term[1]]
            else:
                want = self.s.value(r.term, self.params, kind)
                if isinstance(have, dt.datetime) and have.tzinfo is None:
                    have = have.replace(tzinfo=dt.timezone.utc)
                ok = {"=": lambda: have == want, "!=": lambda: have != want, "<": lambda: have is not None and have < want, "<=": lambda: have is not None and have <= want, ">": lambda: have is not None and have > want, ">=": lambda: have is not None and have >= want, "contains": lambda: have is not None and want in (have.values() if isinstance(have, dict) else have), "contains key": lambda: have is not None and want in have}[r.op]()
            if not ok:
                return False
        return True

    # -- writes -----------------------------------------------------------------------------------------
    def write(self, x) -> None:
        t = self.s.catalog.table(x.table)
        if t.source:
            raise InvalidRequest("a view is read only")
        given = getattr(x, "timestamp", None)
        wt = self.s.value(given, self.params) if given is not None else self.time or self.s.tick()
        ttl = self.s.value(x.ttl, self.params) if getattr(x, "ttl", None) is not None else t.default_ttl
        if ttl is not None and (ttl < 0 or ttl > MAX_TTL):
            raise InvalidRequest("a TTL is from 0 to 20 years")
        if t.counters and (given is not None or (getattr(x, "ttl", None) is not None)):
            raise InvalidRequest("counters take no TTL and no timestamp")
        until = self.s.now() + ttl if ttl else None
        if isinstance(x, P.Insert):
            if t.counters:
                raise InvalidRequest("counters are updated, not inserted")
            self.insert(x, t, wt, until, ttl)
        elif isinstance(x, P.Update):
            self.update(x, t, wt, until, ttl)
        else:
            self.delete(x, t, wt)
        for name in t.triggers.values():
            for more in self.s.trigger_classes[name]({"table": t.name, "statement": x, "timestamp": wt}):
                self.s.execute(more)

    def put(self, t: Table, key: tuple, column: str, cell: Cell) -> None:
        n = len(t.partition)
        if t.columns[column].kind == "static":
            t.statics.setdefault(key[:n], Row()).write(column, cell)
        else:
            t.rows.setdefault(key, Row()).write(column, cell)

    def insert(self, x, t: Table, wt: int, until, ttl) -> None:
        given = self.insert_values(x, t)
        key = tuple(given.get(c) for c in t.key)
        if any(given.get(c) is None for c in t.partition):
            raise InvalidRequest("an insert needs the partition key")
        only_static = all(v is None for v in key[len(t.partition) :]) and bool(t.clustering)
        if only_static and any(t.columns[c].kind == "regular" and v is not None for c, v in given.items()):
            raise InvalidRequest("an insert needs the clustering columns")
        if not only_static:
            row = t.rows.setdefault(key, Row())
            row.marker = Cell(True, wt, until) if row.marker is None or wt >= row.marker.wt else row.marker
        for c, v in given.items():
            if c not in t.key:
                self.put(t, key, c, Cell(v, wt, until, ttl))

    def update(self, x: P.Update, t: Table, wt: int, until, ttl) -> None:
        t, keys = self.keys(x)
        for key in keys:
            statics = all(t.columns[c].kind == "static" for c, *_ in x.sets)
            if len(key) < len(t.key) and not statics:
                raise InvalidRequest("an update needs the whole primary key")
            now: dict | None = None
            for c, item, term in x.sets:
                if c not in t.columns or c in t.key:
                    raise InvalidRequest(f"{c} can't be set")
                kind = self.s.catalog.spark_type(t.columns[c].type)
                needs = item is not None or mentions(term, c)
                if needs and now is None:
                    now = self.current(t, key) or {}
                self.put(t, key, c, Cell(self.assigned(c, item, term, kind, now or {}, t.columns[c].type), wt, until, ttl))

    def assigned(self, c: str, item, term, kind: T.DataType, row: dict, declared: str) -> Any:
        """The new value of a column: whole, one element or field, or an operation on the old value."""
        old = row.get(c)
        is_set = declared.startswith(("set<", "frozen<set"))
        if item is not None:
            k = self.s.value(item, self.params)
            if isinstance(kind, T.MapType):
                out = dict(old or {})
                v = self.s.value(term, self.params, kind.valueType)
                out.pop(k, None) if v is None else out.update({k: v})
                return dict(sorted(out.items())) or None
            if isinstance(kind, T.StructType):
                return {**{f: None for f in kind.fieldNames()}, **(old or {}), k: self.s.value(term, self.params, kind[k].dataType)}
            if not old or not 0 <= k < len(old):
                raise InvalidRequest(f"list index {k} out of bound")
            v = self.s.value(term, self.params, kind.elementType)
            return [v if i == k else e for i, e in enumerate(old) if not (i == k and v is None)] or None
        if not mentions(term, c):
            return self.s.value(term, self.params, kind)
        _, op, left, right = term
        mine = left == ("col", c)
        other = right if mine else left
        if isinstance(kind, T.ArrayType):
            v = list(self.s.value(other, self.params, kind))
            if op == "-":
                return [e for e in old or [] if e not in v] or None
            out = [*(old or []), *v] if mine else [*v, *(old or [])]
            return sorted(set(out)) if is_set else out
        if isinstance(kind, T.MapType):
            if op == "-":
                gone = set(self.s.value(other, self.params))
                return {k: v for k, v in (old or {}).items() if k not in gone} or None
            return dict(sorted({**(old or {}), **self.s.value(other, self.params, kind)}.items()))
        v = self.s.value(other, self.params, kind)
        if declared != "counter":
            raise InvalidRequest(f"{c} is no counter and no collection")
        total = (old or 0) + (v if op == "+" else -v)
        return (total + 2**63) % 2**64 - 2**63

    def delete(self, x: P.Delete, t: Table, wt: int) -> None:
        t, keys = self.keys(x)
        ranges = [r for r in x.where if r.op not in ("=", "in")]
        for key in keys:
            if x.targets:
                now = self.current(t, key) or {}
                for c, item in x.targets:
                    if c in t.key:
                        raise InvalidRequest(f"{c} can't be deleted by itself")
                    value = None
                    if item is not None and now.get(c):
                        k = self.s.value(item, self.params)
                        old = now[c]
                        value = ({a: b for a, b in old.items() if a != k} if isinstance(old, dict) else [e for i, e in enumerate(old) if (e != k if t.columns[c].type.startswith("set") else i != k)]) or None
                    self.put(t, key, c, Cell(value, wt))
                continue
            if len(key) == len(t.key) and not ranges:
                t.rows.setdefault(key, Row()).delete(wt)
                continue
            ex = Expressions(self.s, t, self.params)
            low = Lowering(self.s, P.Select(x.table, []), self.params)
            gone = F.lit(True)
            for c, v in zip(t.key, key):
                gone = gone & (F.col(f"`{c}`") == F.lit(v))
            for r in ranges:
                gone = gone & low.condition(r, ex)
            for k, row in t.rows.items():
                if k[: len(key)] == key and all(self.inside(t, k, r) for r in ranges):
                    row.delete(wt)
            if len(key) == len(t.partition) and not ranges:
                t.statics.pop(key, None)
            t.base_deletes.append((gone, wt))

    def inside(self, t: Table, key: tuple, r: P.Relation) -> bool:
        kinds = [self.s.catalog.spark_type(t.columns[c].type) for c in r.columns]
        have = tuple(key[t.key.index(c)] for c in r.columns)
        terms = r.term[1] if r.kind == "tuple" else [r.term]
        want = tuple(self.s.value(v, self.params, k) for v, k in zip(terms, kinds, strict=True))
        return {"<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want}[r.op]


def mentions(term, column: str) -> bool:
    return isinstance(term, tuple) and term[:1] == ("op",) and ("col", column) in term[2:]


class Definitions:
    """Catalog statements."""

    def __init__(self, session: Session):
        self.s, self.c = session, session.catalog

    def run(self, d: P.Ddl) -> DataFrame | None:
        return getattr(self, d.verb.replace(" ", "_"))(d.parts)

    def _new(self, where: dict, key, p: dict, what: str) -> bool:
        """Whether to create; an existing object is an error unless IF NOT EXISTS (or OR REPLACE)."""
        if key in where and not p.get("replace"):
            if not p.get("if"):
                raise InvalidRequest(f"{what} {key} exists")
            return False
        return True

    def _gone(self, where: dict, key, p: dict, what: str) -> None:
        if where.pop(key, None) is None and not p.get("if"):
            raise InvalidRequest(f"no {what} {key}")

    def options(self, given: dict) -> dict:
        return {k: self.s.value(v, ()) if isinstance(v, tuple) else v for k, v in given.items() if k not in ("order",)}

    def use(self, p):
        if p["name"] not in self.c.keyspaces:
            raise InvalidRequest(f"no keyspace {p['name']}")
        self.c.current = p["name"]

    def truncate(self, p):
        t = self.c.table(p["name"])
        t.base, t.flushed, t.rows, t.statics, t.base_deletes = None, False, {}, {}, []

    def create_keyspace(self, p):
        if self._new(self.c.keyspaces, p["name"], p, "keyspace"):
            options = self.options(p["options"])
            if "replication" not in options:
                raise InvalidRequest("a keyspace needs replication options")
            self.c.keyspaces[p["name"]] = options

    def alter_keyspace(self, p):
        if p["name"] not in self.c.keyspaces:
            raise InvalidRequest(f"no keyspace {p['name']}")
        self.c.keyspaces[p["name"]] |= self.options(p["options"])

    def drop_keyspace(self, p):
        self._gone(self.c.keyspaces, p["name"], p, "keyspace")
        for where in (self.c.tables, self.c.types, self.c.functions, self.c.aggregates):
            for key in [k for k in where if k[0] == p["name"]]:
                del where[key]

    def create_table(self, p):
        key = self.c.qualified(p["name"])
        if not self._new(self.c.tables, key, p, "table"):
            return
        if p["key"] is None:
            raise InvalidRequest("a table needs a primary key")
        partition, clustering = p["key"]
        given = {n: (k, s, m) for n, k, s, m in p["columns"]}
        if len(given) != len(p["columns"]):
            raise InvalidRequest("a column is named twice")
        limit = self.s.guardrails.get("columns_per_table")
        if limit and len(given) > limit:
            raise InvalidRequest(f"more than {limit} columns")
        order = dict(p["options"].get("order", []))
        columns = {}
        for n in [*partition, *clustering, *(c for c in given if c not in partition and c not in clustering)]:
            if n not in given:
                raise InvalidRequest(f"no column {n}")
            kind, static, mask = given[n]
            self.c.spark_type(kind)
            role = "partition" if n in partition else "clustering" if n in clustering else "static" if static else "regular"
            if static and role in ("partition", "clustering"):
                raise InvalidRequest(f"the key column {n} can't be static")
            if role in ("partition", "clustering") and (kind in ("counter", "duration") or kind.startswith(("list", "set", "map"))):
                raise InvalidRequest(f"{kind} can't be in a primary key")
            columns[n] = Column(n, kind, role, bool(order.get(n, False)), mask)
        counters = [c for c in columns.values() if c.kind in ("regular", "static")]
        if any(c.type == "counter" for c in counters) and not all(c.type == "counter" for c in counters):
            raise InvalidRequest("counters and other columns can't share a table")
        if any(c.kind == "static" for c in columns.values()) and not clustering:
            raise InvalidRequest("static columns need clustering columns")
        options = self.options(p["options"])
        self.c.tables[key] = Table(key[1], columns, default_ttl=options.get("default_time_to_live", 0))

    def alter_table(self, p):
        t = self.c.table(p["name"])
        for n, kind, static, mask in p.get("add", []):
            if n in t.columns:
                raise InvalidRequest(f"column {n} exists")
            t.columns[n] = Column(n, kind, "static" if static else "regular", False, mask)
            if t.base is not None:
                t.base = t.base.withColumn(n, F.lit(None).cast(self.c.spark_type(kind)))
        for n in p.get("drop", []):
            if n in t.key:
                raise InvalidRequest(f"the key column {n} can't be dropped")
            del t.columns[n]
            for r in [*t.rows.values(), *t.statics.values()]:
                r.cells.pop(n, None)
        for old, new in p.get("rename", []):
            if old not in t.key:
                raise InvalidRequest("only key columns can be renamed")
            t.columns = {new if k == old else k: Column(new, c.type, c.kind, c.descending, c.mask) if k == old else c for k, c in t.columns.items()}
            t.base = t.base.withColumnRenamed(old, new) if t.base is not None else None
        if "mask" in p:
            t.columns[p["mask"][0]].mask = p["mask"][1]
        if "options" in p:
            t.default_ttl = self.options(p["options"]).get("default_time_to_live", t.default_ttl)

    def drop_table(self, p):
        key = self.c.qualified(p["name"])
        if any(v.source and self.c.qualified(v.source[0]) == key for v in self.c.tables.values()):
            raise InvalidRequest("a view needs the table")
        self._gone(self.c.tables, key, p, "table")

    def create_type(self, p):
        key = self.c.qualified(p["name"])
        if self._new(self.c.types, key, p, "type"):
            for _, kind in p["fields"]:
                self.c.spark_type(kind)
            self.c.types[key] = p["fields"]

    def alter_type(self, p):
        fields = self.c.types.get(self.c.qualified(p["name"]))
        if fields is None:
            raise InvalidRequest(f"no type {p['name']}")
        if "add" in p:
            fields.append(p["add"])
        for old, new in p.get("rename", []):
            fields[:] = [(new if n == old else n, k) for n, k in fields]

    def drop_type(self, p):
        self._gone(self.c.types, self.c.qualified(p["name"]), p, "type")

    def create_index(self, p):
        t = self.c.table(p["table"])
        if p["column"] not in t.columns:
            raise InvalidRequest(f"no column {p['column']}")
        kind = t.columns[p["column"]].type
        if p["target"] in ("keys", "entries") and not kind.startswith("map"):
            raise InvalidRequest(f"{p['target']} needs a map")
        name = p["name"] or f"{t.name}_{p['column']}_idx"
        if not self._new(t.indexes, name, p, "index"):
            return
        options = {str(k): v for o in p["options"].values() for k, v in dict(self.s.value(o, ())).items()} if p["options"] else {}
        t.indexes[name] = (p["column"], p["target"], options | {"class": p["using"]})

    def drop_index(self, p):
        for (ks, _), t in self.c.tables.items():
            if p["name"].rpartition(".")[2] in t.indexes and ks == self.c.qualified(p["name"])[0]:
                del t.indexes[p["name"].rpartition(".")[2]]
                return
        if not p["if"]:
            raise InvalidRequest(f"no index {p['name']}")

    def create_view(self, p):
        key = self.c.qualified(p["name"])
        if not self._new(self.c.tables, key, p, "view"):
            return
        select: P.Select = p["select"]
        base = self.c.table(select.table)
        partition, clustering = p["key"]
        names = list(base.columns) if select.selectors == [(("star",), None)] else [x[1] if x[0] == "col" else None for x, _ in select.selectors]
        if None in names or select.group_by or select.order_by or select.limit:
            raise InvalidRequest("a view selects plain columns")
        keys = [*partition, *clustering]
        missing = set(base.key) - set(keys)
        if missing:
            raise InvalidRequest(f"a view's key holds all of its base's key: {sorted(missing)[0]} is missing")
        if len([c for c in keys if c not in base.key]) > 1:
            raise InvalidRequest("a view's key holds at most one other column")
        if any(base.columns[c].kind == "static" or base.columns[c].type == "counter" for c in keys):
            raise InvalidRequest("a view's key takes no static columns and counters")
        not_null = {r.columns[0] for r in select.where if r.op == "is not null"} | {r.columns[0] for r in select.where if r.op == "="}
        if set(keys) - not_null:
            raise InvalidRequest(f"{sorted(set(keys) - not_null)[0]} needs IS NOT NULL")
        low = Lowering(self.s, P.Select(select.table, []), ())
        ex, where = Expressions(self.s, base, ()), None
        for r in select.where:
            if r.op != "is not null":
                c = low.condition(r, ex)
                where = c if where is None else where & c
        order = dict(p["options"].get("order", []))
        names = [*keys, *(n for n in names if n not in keys)]
        kinds = {n: "partition" if n in partition else "clustering" if n in clustering else "regular" for n in names}
        columns = {n: Column(n, base.columns[n].type, kinds[n], bool(order.get(n, False)), base.columns[n].mask) for n in names}
        self.c.tables[key] = Table(key[1], columns, source=(select.table, names, where))

    def alter_view(self, p):
        self.c.table(p["name"])

    def drop_view(self, p):
        key = self.c.qualified(p["name"])
        if key in self.c.tables and not self.c.tables[key].source:
            raise InvalidRequest(f"{p['name']} is a table")
        self._gone(self.c.tables, key, p, "view")

    def create_function(self, p):
        key = self.c.qualified(p["name"])
        kinds = [t for _, t in p["args"]]
        own = self.c.functions.setdefault(key, [])
        same = [f for f in own if [t for _, t in f.args] == kinds]
        if same and not p["replace"]:
            if p["if"]:
                return
            raise InvalidRequest(f"function {p['name']} exists")
        if p["language"] not in ("sql", "python"):
            raise InvalidRequest(f"no language {p['language']}")
        own[:] = [f for f in own if f not in same] + [Function(key[1], p["args"], p["returns"], p["language"], p["body"], p["null"])]

    def create_aggregate(self, p):
        key = self.c.qualified(p["name"])
        if not self._new(self.c.aggregates, key, p, "aggregate"):
            return
        for f in (p["step"], p["final"]):
            if f and not self.c.functions.get(self.c.qualified(f)):
                raise InvalidRequest(f"no function {f}")
        self.c.aggregates[key] = Aggregate(key[1], p["arg"], p["step"], p["state"], p["final"], p["initial"])

    def drop_function(self, p):
        key = self.c.qualified(p["name"])
        own = self.c.functions.get(key, [])
        hit = [f for f in own if p["signature"] is None or [t for _, t in f.args] == p["signature"]]
        if not hit and not p["if"]:
            raise InvalidRequest(f"no function {p['name']}")
        if len(hit) > 1:
            raise InvalidRequest("several functions have that name: give the argument types")
        own[:] = [f for f in own if f not in hit]

    def drop_aggregate(self, p):
        self._gone(self.c.aggregates, self.c.qualified(p["name"]), p, "aggregate")

    def create_trigger(self, p):
        t = self.c.table(p["table"])
        if self._new(t.triggers, p["name"], p, "trigger"):
            if p["using"] not in self.s.trigger_classes:
                raise InvalidRequest(f"no trigger class {p['using']}")
            t.triggers[p["name"]] = p["using"]

    def drop_trigger(self, p):
        self._gone(self.c.table(p["table"]).triggers, p["name"], p, "trigger")

    def create_role(self, p):
        if self._new(self.c.roles, p["name"], p, "role"):
            self.c.roles[p["name"]] = {("all", "*")} if self.options(p["options"]).get("superuser") else set()

    def drop_role(self, p):
        if p["name"] not in self.c.roles and not p["if"]:
            raise InvalidRequest(f"no role {p['name']}")
        self.c.roles.pop(p["name"], None)

    def grant(self, p):
        self.c.roles.setdefault(p["role"], set()).add((p["permission"], p["on"]))

    def revoke(self, p):
        self.c.roles.get(p["role"], set()).discard((p["permission"], p["on"]))

    def list_permissions(self, p):
        rows = [(r, a, on) for r, have in self.c.roles.items() for a, on in sorted(have) if p["role"] in (None, r)]
        return self.s.spark.createDataFrame(rows, "role string, permission string, resource string")
