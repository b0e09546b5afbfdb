"""Quads in a DataFrame ``g string, s term, p string, o term`` and readers of RDF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BLANK, IRI, LITERAL, Value
from ..plans.algebra import XSD, BNode, Iri, Lit, Triple, Var
from .documents import PARSERS, parse_turtle

TERM_TYPE = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("dt", T.StringType())])
SCHEMA = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", TERM_TYPE), T.StructField("p", T.StringType()), T.StructField("o", TERM_TYPE)])
_LINE = r"^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+)|\"((?:[^\"\\]|\\.)*)\"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?)\s*(?:<([^>]*)>|(_:\S+))?\s*\.\s*(?:#.*)?$"


def cell(t) -> tuple:
    match t:
        case Iri(value):
            return (IRI, value, None, None)
        case BNode(label):
            return (BLANK, label, None, None)
        case Lit(lex, lang, dt):
            return (LITERAL, lex, lang, None if dt == XSD + "string" or lang else dt)
    raise TypeError(t)


def from_triples(spark: SparkSession, quads: list) -> DataFrame:
    """A small table from (graph or None, Triple) pairs."""
    return spark.createDataFrame([(g, cell(t.s), t.p.value, cell(t.o)) for g, t in quads], SCHEMA)


def _unescaped(c):
    """The text of an escaped literal. Its escapes are those of a JSON string, besides \\' and the 8-digit form, of which
    the latter becomes a pair of 4-digit ones above the first 2 ** 16 characters."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\'", "$1'"), r"(?<!\\)((?:\\\\)*)\\U0000([0-9A-Fa-f]{4})", r"$1\\u$2")
    parts = F.split(plain, r"(?=\\U[0-9A-Fa-f]{8})")

    def joined(x):
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("bigint") - 0x10000
        high, low = F.lpad(F.hex((code / 1024).cast("bigint") + 0xD800), 4, "0"), F.lpad(F.hex(F.pmod(code, F.lit(1024)) + 0xDC00), 4, "0")
        return F.when(x.startswith("\\U"), F.concat(F.lit("\\u"), high, F.lit("\\u"), low, F.substring(x, F.lit(11), F.length(x)))).otherwise(x)

    paired = F.when(plain.contains("\\U"), F.array_join(F.transform(parts, joined), "")).otherwise(plain)
    read = F.get_json_object(F.concat(F.lit('{"v":"'), F.regexp_replace(paired, "\t", r"\\t"), F.lit('"}')), "$.v")
    wrong = F.raise_error(F.concat(F.lit("escapes of another form: "), F.substring(c, 1, 200))).cast("string")
    return F.when(c.contains("\\"), F.coalesce(read, wrong)).otherwise(c)


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """N-Triples or N-Quads, line by line in Spark. Blank node labels keep apart by file; comments and empty lines go,
    lines of another form fail the query. ``graph`` names the triples without a graph of their own."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.col("value").rlike(r"^\s*#"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    known = F.when(F.col("value").rlike(_LINE), True).otherwise(F.raise_error(F.concat(F.lit("not an N-Quads line: "), F.substring("value", 1, 200))).cast("boolean"))
    file = F.substring(F.md5(F.input_file_name()), 1, 8)
    blank = lambda c: F.concat(file, F.lit("."), c)
    none = F.lit(None).cast("string")
    make = lambda kind, lex, lang=none, dt=none: F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), lang.alias("lang"), dt.alias("dt"))
    literal = make(LITERAL, _unescaped(part(6)), F.nullif(part(7), F.lit("")), F.nullif(F.nullif(part(8), F.lit("")), F.lit(XSD + "string")))
    subject = F.when(part(2) != "", make(BLANK, blank(part(2)))).otherwise(make(IRI, part(1)))
    value = F.when(part(5) != "", make(BLANK, blank(part(5)))).when(F.col("value").rlike(r"^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+\""), literal).otherwise(make(IRI, part(4)))
    name = F.when(part(9) != "", part(9)).when(part(10) != "", part(10)).otherwise(F.lit(graph))
    return lines.where(known).select(name.alias("g"), subject.alias("s"), part(3).alias("p"), value.alias("o"))


def read_document(spark: SparkSession, path: str, format: str, graph: str | None = None) -> DataFrame:
    """Turtle, TriG or RDF/XML files, each parsed as a whole on an executor; blank node labels keep apart by file. ``graph``
    names the triples without a graph of their own."""

    def parse(frames):
        import hashlib

        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                mark = hashlib.md5(name.encode()).hexdigest()[:8]
                own = lambda t: BNode(f"{mark}.{t.label}") if isinstance(t, BNode) else t  # noqa: B023, E731
                rows = [(graph if g is None else g, cell(own(t.s)), t.p.value, cell(own(t.o))) for g, t in PARSERS[format](bytes(content).decode(), name)]
                named = lambda c: dict(zip(("kind", "lex", "lang", "dt"), c, strict=True))
                yield pd.DataFrame([(g, named(s), p, named(o)) for g, s, p, o in rows], columns=["g", "s", "p", "o"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def read_turtle(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    return read_document(spark, path, "turtle", graph)


def format_of(path: str, start: str = "") -> str:
    """The format of RDF data by the ending of the path, else by the first characters."""
    ending = path.rsplit(".", 1)[-1].lower()
    known = {"ttl": "turtle", "n3": "turtle", "turtle": "turtle", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "nt": "ntriples", "nq": "ntriples", "ntriples": "ntriples", "nquads": "ntriples"}
    if ending in known:
        return known[ending]
    start = start.lstrip()
    if start.startswith("<?xml") or "rdf:RDF" in start:
        return "rdfxml"
    return "turtle" if start.startswith(("@prefix", "@base", "PREFIX", "BASE")) else "ntriples"


class QuadsFrame:
    """A graph source over a quads DataFrame; a pattern without GRAPH meets the quads without a graph name."""

    def __init__(self, quads: DataFrame, default_graphs: tuple[str, ...] = (), named_graphs: tuple[str, ...] | None = None):
        self.quads, self.default_graphs, self.named_graphs = quads, default_graphs, named_graphs

    def dataset(self, default: tuple[str, ...], named: tuple[str, ...]) -> QuadsFrame:
        return QuadsFrame(self.quads, default, named)

    def visible(self, graph) -> DataFrame:
        if graph is None:
            if self.default_graphs or self.named_graphs:
                return self.quads.where(F.col("g").isin(*self.default_graphs)) if self.default_graphs else self.quads.where(F.lit(False))
            return self.quads.where(F.col("g").isNull())
        own = self.quads.where(F.col("g").isNotNull())
        if self.named_graphs is not None:
            own = own.where(F.col("g").isin(*self.named_graphs)) if self.named_graphs else own.where(F.lit(False))
        return own.where(F.col("g") == graph.value) if isinstance(graph, Iri) else own

    def bgp(self, triples: tuple[Triple, ...], graph, compiler):
        """The joined patterns: one filtered scan each, most bound first, then those that share a variable."""
        left = list(triples)
        rel, known = None, set()
        while left:
            names = lambda t: {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
            left.sort(key=lambda t: (bool(known) and not names(t) & known, len(names(t) - known), isinstance(t.p, Var)))
            t = left.pop(0)
            one = self._scan(t, graph, compiler)
            rel = one if rel is None else compiler.join(rel, one)
            known |= names(t)
        return rel

    def _scan(self, t: Triple, graph, compiler):
        df, cells = self.visible(graph), {}
        for column, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            c = F.col(column)
            if isinstance(x, Var):
                own = Value("iri" if column == "p" else "term", c)
                if x.name in cells:
                    df = df.where(compiler.same(cells[x.name], own))
                else:
                    cells[x.name] = own
            elif column == "p":
                df = df.where(c == x.value) if isinstance(x, Iri) else df.where(F.lit(False))
            else:
                kind, lex, lang, dt = cell(x)
                df = df.where((c["kind"] == kind) & (c["lex"] == lex))
                if kind == LITERAL:
                    df = df.where((F.lower(c["lang"]) == lang.lower() if lang else c["lang"].isNull()) & (c["dt"] == dt if dt else c["dt"].isNull()))
        if isinstance(graph, Var):
            own = Value("iri", F.col("g"))
            if graph.name in cells:
                df = df.where(compiler.same(cells[graph.name], own))
            else:
                cells[graph.name] = own
        return compiler.rel(df, cells)

    def graph_names(self) -> DataFrame:
        return self.visible(Var("g")).select("g").distinct()

    def everything(self) -> DataFrame:
        return self.visible(None).drop("g")


#: What tells quads apart, with a number made of it first, by which rows sort fast.
KEY = ["h", "kg", "sk", "sl", "p", "ok", "ol", "ox", "oy"]


def keyed(quads: DataFrame) -> DataFrame:
    """Quads as columns KEY, which are equal for equal ones, and the language tag as it is written."""
    rows = quads.select(F.coalesce("g", F.lit("")).alias("kg"), F.col("s.kind").alias("sk"), F.col("s.lex").alias("sl"), "p", F.col("o.kind").alias("ok"), F.col("o.lex").alias("ol"), F.coalesce(F.lower("o.lang"), F.lit("")).alias("ox"), F.coalesce("o.dt", F.lit("")).alias("oy"), F.col("o.lang").alias("lang"))
    return rows.withColumn("h", F.xxhash64(*KEY[1:]))


def unkeyed(rows: DataFrame) -> DataFrame:
    """The quads of ``keyed`` rows. A subject has no language and no datatype."""
    none = F.lit(None).cast("string")
    s = F.struct(F.col("sk").alias("kind"), F.col("sl").alias("lex"), none.alias("lang"), none.alias("dt"))
    o = F.struct(F.col("ok").alias("kind"), F.col("ol").alias("lex"), "lang", F.nullif("oy", F.lit("")).alias("dt"))
    return rows.select(F.nullif("kg", F.lit("")).alias("g"), s.alias("s"), "p", o.alias("o"))


def inside(graph: str):
    """Whether a quad is in a graph: its IRI, DEFAULT, NAMED or ALL."""
    g = F.col("g")
    return {"ALL": F.lit(True), "DEFAULT": g.isNull(), "NAMED": g.isNotNull()}.get(graph, F.coalesce(g == graph, F.lit(False)))


class Changed(QuadsFrame):
    """Quads after updates: those of ``base`` that are not in the graphs ``cleared`` and not ``gone`` (columns KEY), and those
    ``made``. Only what updates take out and put in is kept beside ``base``, which is read again and never copied.

    ``predicates`` are those that ``gone`` may have, None for any; ``few``: it has the triples of DELETE DATA alone.
    """

    def __init__(self, base: DataFrame | None, made: DataFrame | None = None, gone: DataFrame | None = None, cleared: frozenset = frozenset(), predicates: frozenset | None = frozenset(), few: bool = True):
        self.base, self.made, self.gone, self.cleared, self.predicates, self.few = base, made, gone, cleared, predicates, few
        parts = [d for d in (self._kept(), made) if d is not None]
        super().__init__(parts[0].select("g", "s", "p", "o").unionAll(parts[1]) if len(parts) == 2 else parts[0] if parts else SparkSession.active().createDataFrame([], SCHEMA))

    def _kept(self) -> DataFrame | None:
        if self.base is None:
            return None
        df = self.base
        for g in sorted(self.cleared):
            df = df.where(~inside(g))
        if self.gone is None:
            return df
        if self.few:
            return self._less(df, F.broadcast(self.gone))
        if self.predicates is None:
            return self._less(df, self.gone)
        hit = F.col("p").isin(*sorted(self.predicates))
        return df.where(~hit).select("g", "s", "p", "o").unionAll(self._less(df.where(hit), self.gone))

    @staticmethod
    def _less(df: DataFrame, keys: DataFrame) -> DataFrame:
        return unkeyed(keyed(df).join(keys, KEY, "left_anti"))

    def without(self, gone: DataFrame, predicates: frozenset | None, few: bool) -> Changed:
        """Less the quads ``gone``, of which all have one of ``predicates`` (None: any)."""
        keys = keyed(gone).select(*KEY)
        made = None if self.made is None else self._less(self.made, F.broadcast(keys) if few else keys)
        if self.base is None:
            return Changed(None, made)
        every = keys if self.gone is None else self.gone.unionAll(keys)
        either = None if predicates is None or self.predicates is None else self.predicates | predicates
        return Changed(self.base, made, every, self.cleared, either, few and self.few)

    def without_graph(self, graph: str) -> Changed:
        if graph == "ALL":
            return Changed(None)
        made = None if self.made is None else self.made.where(~inside(graph))
        return Changed(self.base, made, self.gone, self.cleared | {graph}, self.predicates, self.few)

    def plus(self, more: DataFrame, predicates: frozenset | None = None, graph: str | None = None, few: bool = False) -> Changed:
        """With the quads ``more``, each once, that are not there: all have one of ``predicates`` and are in ``graph`` (None:
        any). ``few``: they are so few that any task can hold them."""
        have = self.quads if graph is None else self.quads.where(inside(graph))
        have = have if predicates is None else have.where(F.col("p").isin(*sorted(predicates)))
        new, have = keyed(more), keyed(have).select(*KEY)
        if few:
            have = have.join(F.broadcast(new.select(*KEY)), KEY, "left_semi")
        else:
            new = new.repartition(*[F.col(k) for k in KEY])  # once for both steps, and no sort before it
        new = unkeyed(new.dropDuplicates(KEY).join(have, KEY, "left_anti"))
        return Changed(self.base, new if self.made is None else self.made.unionAll(new), self.gone, self.cleared, self.predicates, self.few)

    def cut(self, old: Changed) -> Changed:
        """With what is not as in ``old`` written to the context's checkpoint folder, so that plans do not grow."""
        made = self.made if self.made is old.made or self.made is None else self.made.checkpoint()
        gone = self.gone if self.gone is old.gone or self.gone is None else self.gone.checkpoint()
        return Changed(self.base, made, gone, self.cleared, self.predicates, self.few)


__all__ = ["Changed", "QuadsFrame", "cell", "format_of", "from_triples", "parse_turtle", "read_document", "read_ntriples", "read_turtle"]
