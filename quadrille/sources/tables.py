"""Relational tables as a virtual graph, in typed mode: cells stay native columns, IRIs are template and key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, as_term, constant, from_fields
from ..plans.algebra import RDF, Iri, Lit, Triple, Var


@dataclass(frozen=True)
class Table:
    """A table: its frame or what opens it, key columns (joined by ``-``), foreign keys as column -> table name, and the names
    of its columns; with those it is opened only when a pattern reads it."""

    source: DataFrame | Callable[[], DataFrame]
    key: tuple[str, ...]
    links: dict[str, str] = field(default_factory=dict)
    names: tuple[str, ...] | None = None

    @cached_property
    def frame(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    @cached_property
    def columns(self) -> tuple[str, ...]:
        return self.names or tuple(f.name for f in self.frame.schema.fields if type(f.dataType) in KINDS)


KINDS = {T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.DoubleType: "double", T.FloatType: "double", T.StringType: "string", T.BooleanType: "boolean", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime", T.DateType: "date", T.DecimalType: "decimal"}


class TableMapping:
    """The direct mapping: subject ``base + table/key``, predicate ``base + column``, class ``base + table``. Foreign
    keys are IRIs of their table. Each table is also a named graph of its class IRI; nulls make no triple. All
    patterns of one subject become a single scan of its table, or the union of one scan for each table that it may be of;
    everything else falls back on ``quads``."""

    def __init__(self, tables: dict[str, Table], base: str = "http://example.org/"):
        self.tables, self.base = tables, base
        #: The tables that have each column.
        self.columns: dict[str, set[str]] = {}
        for name, t in tables.items():
            for c in t.columns:
                self.columns.setdefault(base + c, set()).add(name)
        self._quads = None

    def dataset(self, default: tuple[str, ...], named: tuple[str, ...]):
        from .quads import QuadsFrame

        return QuadsFrame(self.quads(), default, named)

    def key(self, name: str):
        key = self.tables[name].key
        return F.col(key[0]) if len(key) == 1 else F.concat_ws("-", *key)

    def template(self, name: str) -> str:
        return f"{self.base}{name}/"

    def value(self, name: str, column: str) -> Value:
        table = self.tables[name]
        if column in table.links:
            return Value("key", F.col(column), self.template(table.links[column]))
        kind = KINDS[type(table.frame.schema[column].dataType)]
        return Value(kind, F.col(column).cast("bigint") if kind == "integer" else (from_fields(F.col(column)) if isinstance(table.frame.schema[column].dataType, T.TimestampNTZType) else F.col(column)) if kind == "dateTime" else F.col(column).cast("double") if kind == "double" else F.col(column))

    def _tables_of(self, star: list[Triple], graph) -> list[str]:
        """The tables whose rows can be the subject of all these triples; none if a predicate is a variable."""
        found = set(self.tables)
        for t in star:
            if not isinstance(t.p, Iri):
                return []
            if t.p.value != RDF + "type":
                found &= self.columns.get(t.p.value, set())
            elif isinstance(t.o, Iri):
                found &= {t.o.value.removeprefix(self.base)}
        if isinstance(graph, Iri):
            found &= {graph.value.removeprefix(self.base)}
        # Subjects of two tables differ where no name goes on after the other and a slash.
        apart = len(found) < 2 or not any("/" in n for n in found)
        return [n for n in self.tables if n in found] if apart else []

    def bgp(self, triples: tuple[Triple, ...], graph, compiler):
        stars: dict = {}
        for t in triples:
            stars.setdefault(t.s, []).append(t)
        owners = {s: self._tables_of(star, graph) for s, star in stars.items()}
        if any(not o or not isinstance(s, Var | Iri) for s, o in owners.items()):
            from .quads import QuadsFrame

            quads = self.quads()
            return QuadsFrame(quads if graph is not None else quads.withColumn("g", F.lit(None).cast("string"))).bgp(triples, graph, compiler)
        scans = [reduce(compiler.union, [self._scan(o, s, star, graph, compiler) for o in owners[s]]) for s, star in stars.items()]
        rel = scans.pop(0)
        while scans:
            scans.sort(key=lambda r: not set(r.cells) & set(rel.cells))
            rel = compiler.join(rel, scans.pop(0))
        return rel

    def _scan(self, name: str, subject, star: list[Triple], graph, compiler):
        table = self.tables[name]
        df, cells = table.frame, {}
        own = Value("key", self.key(name), self.template(name))
        if isinstance(subject, Var):
            cells[subject.name] = own
        else:
            df = df.where(own.col.cast("string") == subject.value.removeprefix(own.template) if subject.value.startswith(own.template) else F.lit(False))
        for t in star:
            if t.p.value == RDF + "type":
                if isinstance(t.o, Var):
                    own_class = Value("iri", F.lit(self.base + name))
                    if t.o.name in cells:
                        df = df.where(compiler.same(cells[t.o.name], own_class))
                    else:
                        cells[t.o.name] = own_class
                elif not (isinstance(t.o, Iri) and t.o.value == self.base + name):
                    df = df.where(F.lit(False))
                continue
            column = t.p.value.removeprefix(self.base)
            v = self.value(name, column)
            if isinstance(t.o, Var):
                df = df.where(F.col(column).isNotNull())
                if t.o.name in cells:
                    df = df.where(compiler.same(cells[t.o.name], v))
                else:
                    cells[t.o.name] = v
            elif v.kind == "key" and isinstance(t.o, Iri):
                df = df.where(F.col(column).cast("string") == t.o.value.removeprefix(v.template) if t.o.value.startswith(v.template) else F.lit(False))
            elif isinstance(t.o, Lit) and constant(t.o).kind == v.kind:
                df = df.where(v.col == constant(t.o).col)
            else:
                df = df.where(compiler.same(v, constant(t.o)))
        if isinstance(graph, Var):
            own_graph = Value("iri", F.lit(self.base + name))
            if graph.name in cells:
                df = df.where(compiler.same(cells[graph.name], own_graph))
            else:
                cells[graph.name] = own_graph
        return compiler.rel(df, cells)

    def about(self, iris: tuple[str, ...]) -> DataFrame:
        """The triples (s, p, o) of some subjects, from the rows of their tables alone."""
        out = None
        for name, table in self.tables.items():
            keys = [i.removeprefix(self.template(name)) for i in iris if i.startswith(self.template(name))]
            if keys:
                one = TableMapping({name: Table(table.frame.where(self.key(name).cast("string").isin(keys)), table.key, table.links, table.names)}, self.base).everything()
                out = one if out is None else out.unionAll(one)
        return self.everything().where(F.lit(False)) if out is None else out

    def quads(self) -> DataFrame:
        """All triples as quads: a union of one scan for each predicate of each table."""
        if self._quads is None:
            parts = []
            for name, table in self.tables.items():
                subject = as_term(Value("key", self.key(name), self.template(name)))
                cells = {RDF + "type": Value("iri", F.lit(self.base + name))} | {self.base + c: self.value(name, c) for c in table.columns}
                # A part for each predicate: a pattern with a constant one prunes all other parts, and so their columns.
                for p, v in cells.items():
                    parts.append(table.frame.select(F.lit(self.base + name).alias("g"), subject.alias("s"), F.lit(p).alias("p"), as_term(v).alias("o")).where(F.col("o").isNotNull()))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionAll(p)
            self._quads = out
        return self._quads

    def graph_names(self) -> DataFrame:
        return SparkSession.active().createDataFrame([(self.base + n,) for n in self.tables], "g string")

    def everything(self) -> DataFrame:
        return self.quads().drop("g")
