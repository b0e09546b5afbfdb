"""The engine: prepares SPARQL text, compiles it over a graph source and gives DataFrames, truth values or triples."""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import BLANK, IRI, LITERAL, TERM, as_term, text
from .operators.compiler import Compiler, Rel
from .plans import writer
from .plans.algebra import BNode, Iri, Query, Slice, Triple, Var, tree
from .plans.parser import LANGUAGES, SparqlSyntaxError, parse, parse_update
from .sources import formats
from .sources.protocol import Source
from .sources.quads import SCHEMA, Changed, QuadsFrame, format_of, from_triples, inside, read_document, read_ntriples
from .sources.tables import TableMapping


@dataclass
class Prepared:
    """A parsed query with the engine that runs it. ``limit`` and ``offset`` may be changed before it runs."""

    engine: Engine
    query: Query

    def tree(self) -> str:
        return tree(self.query.root)

    def to_sparql(self) -> str:
        return writer.query_text(self.query)

    def sliced(self, limit: int | None = None, offset: int = 0) -> Prepared:
        root = self.query.root.child if isinstance(self.query.root, Slice) else self.query.root
        return replace(self, query=replace(self.query, root=Slice(root, offset, limit), limit=limit, offset=offset))

    def relation(self, bindings: dict | None = None) -> Rel:
        return self.engine.compiler(self.query, bindings).compile(self.query.root)

    def dataframe(self, bindings: dict | None = None, terms: bool = False) -> DataFrame:
        """The bindings of a SELECT: one column a variable, native where its cells are, else the lexical form; with
        ``terms`` every cell as the struct (kind, lex, lang, dt)."""
        if self.query.form != "select":
            raise ValueError(f"{self.query.form} gives no bindings")
        r = self.relation(bindings)
        out = []
        for n in self.query.names:
            v = r.cells[n]
            out.append((as_term(v) if terms else v.col if v.kind not in ("term", "key") else text(v)).alias(n))
        return r.df.select(*out) if out else r.df

    def ask_dataframe(self, bindings: dict | None = None) -> DataFrame:
        """The answer of an ASK as one row, computed with the plan."""
        one = self.relation(bindings).df.limit(1)
        return one.agg((F.count(F.lit(1)) > 0).alias("answer"))

    def ask(self, bindings: dict | None = None) -> bool:
        return not self.relation(bindings).df.isEmpty()

    def graph(self, bindings: dict | None = None) -> DataFrame:
        """The triples (s term, p string, o term) of a CONSTRUCT or DESCRIBE. Ill-formed triples are left out."""
        if self.query.form == "describe":
            return self._describe(bindings)
        r = self.relation(bindings)
        df = r.df.withColumn("_row", F.monotonically_increasing_id()) if any(isinstance(x, BNode) for t in self.query.template for x in (t.s, t.p, t.o)) else r.df
        none = F.lit(None).cast(TERM)

        def cell(x):
            if isinstance(x, Var):
                return as_term(r.cells[x.name]) if x.name in r.cells else none
            if isinstance(x, BNode):
                return F.struct(F.lit(BLANK).cast("tinyint").alias("kind"), self.engine.blank_label(x.label, F.col("_row")).alias("lex"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("dt"))
            kind, lex, lang, dt = formats.cell(x)
            return F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.lit(lex).alias("lex"), F.lit(lang).cast("string").alias("lang"), F.lit(dt).cast("string").alias("dt"))

        made = [F.struct(*[cell(x).cast(TERM).alias(n) for n, x in (("s", t.s), ("p", t.p), ("o", t.o))]) for t in self.query.template]
        if not made:
            return r.df.sparkSession.createDataFrame([], SCHEMA).drop("g")
        rows = df.select(F.explode(F.array(*made)).alias("t")).select("t.*")
        valid = F.col("s").isNotNull() & F.col("o").isNotNull() & (F.col("p.kind") == IRI) & (F.col("s.kind") != LITERAL)
        return rows.where(valid).select("s", F.col("p.lex").alias("p"), "o")

    def _describe(self, bindings) -> DataFrame:
        """Concise bounded descriptions: triples of each target, and of blank nodes they lead to."""
        source = self.engine.source_of(self.query)
        if isinstance(source, TableMapping) and all(isinstance(t, Iri) for t in self.query.targets):
            return source.about(tuple(t.value for t in self.query.targets))
        every = source.everything()
        r = self.relation(bindings)
        nodes = None
        for t in self.query.targets:
            one = r.df.select(as_term(r.cells[t.name]).alias("n")) if isinstance(t, Var) else r.df.sparkSession.range(1).select(F.struct(F.lit(IRI).cast("tinyint").alias("kind"), F.lit(t.value).alias("lex"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("dt")).alias("n"))
            nodes = one if nodes is None else nodes.unionAll(one)
        keyed = every.withColumns({"k": F.col("s.kind"), "l": F.col("s.lex")})
        found = keyed.join(nodes.where("n is not null").select(F.col("n.kind").alias("k"), F.col("n.lex").alias("l")).distinct(), ["k", "l"], "left_semi")
        while not isinstance(source, TableMapping):  # tables have no blank nodes
            blanks = found.where(F.col("o.kind") == BLANK).select(F.col("o.kind").alias("k"), F.col("o.lex").alias("l")).distinct()
            more = blanks.join(found.select("k", "l").distinct(), ["k", "l"], "left_anti")
            if more.isEmpty():
                return found.select("s", "p", "o")
            grown = found.unionAll(keyed.join(more, ["k", "l"], "left_semi"))
            if keyed.join(more, ["k", "l"], "left_semi").isEmpty():
                return found.select("s", "p", "o")
            found = grown
        return found.select("s", "p", "o")

    def execute(self, bindings: dict | None = None):
        """A DataFrame of bindings or triples, or the truth of an ASK; EXPLAIN prints the plan first."""
        if self.query.explain:
            self.relation(bindings).df.explain("formatted")
        match self.query.form:
            case "select":
                return self.dataframe(bindings)
            case "ask":
                return self.ask(bindings)
            case _:
                return self.graph(bindings)

    def write(self, format: str, bindings: dict | None = None) -> str:
        """The results as text of a format from ``list_formats``."""
        if self.query.form == "ask":
            return formats.write_boolean(self.ask(bindings), format)
        if self.query.form == "select":
            rows = self.dataframe(bindings, terms=True).toLocalIterator()
            return formats.write_bindings(self.query.names, ([formats.term_of(c) for c in row] for row in rows), format)
        return formats.write_graph(((formats.term_of(r["s"]), Iri(r["p"]), formats.term_of(r["o"])) for r in self.graph(bindings).toLocalIterator()), format)


class Engine:
    """Runs queries and updates over a graph source (see ``sources.protocol.Source``).

    ``warn`` is the highest level of warnings that is told: 0 none, 10 variables that are selected but never bound, 50 (the
    default; also True) those that are bound but stand only once and are not selected. ``blank_label`` makes the labels of
    CONSTRUCT's blank nodes from the label in the template and the number of the row, as a column.
    """

    def __init__(self, spark: SparkSession, source: Source | None = None, *, service=None, network: bool = True, seed: int | None = None, unknown_functions_false: bool = False, warn: bool | int = 10, blank_label=None):
        self.spark, self.source, self.service = spark, source, service if network else None
        self.seed, self.unknown_false, self.warn = seed, unknown_functions_false, 50 if warn is True else int(warn)
        self.blank_label = blank_label or (lambda label, row: F.concat(F.lit(f"{label}r"), row.cast("string")))

    def load(self, path: str, graph: str | None = None, format: str = "guess") -> None:
        """Adds triples of a file to the default graph or the graph named. ``format``: turtle, trig, rdfxml, ntriples (quads
        too) or guess, by the ending and else by the first line."""
        kind = format
        if kind == "guess":
            first = "" if "." in path.rsplit("/", 1)[-1] else "\n".join(r["value"] for r in self.spark.read.text(path).limit(3).collect())
            kind = format_of(path, first)
        self.add(read_ntriples(self.spark, path, graph) if kind == "ntriples" else read_document(self.spark, path, kind, graph))

    def add(self, quads: DataFrame) -> None:
        """Adds quads; a graph is a set, so what is there already, or comes twice, is added once."""
        self.source = self._changed().plus(quads.select("g", "s", "p", "o"))

    def prepare(self, text: str, base: str | None = None, prefixes: dict | None = None, language: str = "sparql") -> Prepared:
        q = parse(text, base, prefixes, language)
        if self.warn >= 50 and q.form == "select" and not q.wildcard:
            met = Counter(x.name for x in _nodes(q.root) if isinstance(x, Var))
            once = [n for n, k in met.items() if k == 1 and n not in q.names and not n.startswith(("_:", "."))]
            if once:
                warnings.warn(f"bound but not used: {', '.join('?' + n for n in once)}", stacklevel=2)
        if self.warn >= 10 and q.form == "select" and not q.wildcard:
            unknown = [n for n in q.names if n not in q.variables and not any(n == getattr(x, "var", None) for x in _nodes(q.root))]
            if unknown:
                warnings.warn(f"selected but never bound: {', '.join('?' + n for n in unknown)}", stacklevel=2)
        return Prepared(self, q)

    def query(self, text: str, **options):
        return self.prepare(text, **options).execute()

    def source_of(self, q: Query):
        source = self.source or QuadsFrame(self.spark.createDataFrame([], SCHEMA))
        return source.dataset(q.default_graphs, q.named_graphs) if q.default_graphs or q.named_graphs else source

    def compiler(self, q: Query, bindings: dict | None = None) -> Compiler:
        return Compiler(self.spark, self.source_of(q), bindings, self.service, q.base, self.seed, self.unknown_false)

    def update(self, text: str, **options) -> None:
        """Runs update operations one after the other on the quads of this engine."""
        for u in parse_update(text, **options):
            self._update(u)

    def _changed(self) -> Changed:
        """The quads as a base and its changes."""
        return self.source if isinstance(self.source, Changed) else Changed(self.source.quads if isinstance(self.source, QuadsFrame) else None)

    def _update(self, u) -> None:
        old = new = self._changed()
        graph_of = lambda x: "DEFAULT" if x is None else x.value if isinstance(x, Iri) else None
        predicates = lambda triples: frozenset(t.p.value for _, t in triples) if all(isinstance(t.p, Iri) for _, t in triples) else None
        match u.kind:
            case "insert":
                new = new.plus(from_triples(self.spark, [(getattr(x, "value", None), t) for x, t in u.insert]), predicates(u.insert), few=True)
            case "delete":
                new = new.without(from_triples(self.spark, [(getattr(x, "value", None), t) for x, t in u.delete]), predicates(u.delete), few=True)
            case "clear" | "drop":
                new = new.without_graph(u.target)
            case "load":
                try:
                    self.load(u.source, u.target)
                except Exception:
                    if not u.silent:
                        raise
                return
            case "add" | "copy" | "move":
                if u.source == u.target:
                    return
                own = old.quads.where(inside(u.source)).withColumn("g", F.lit(None if u.target == "DEFAULT" else u.target).cast("string"))
                new = new if u.kind == "add" else new.without_graph(u.target)
                new = new.without_graph(u.source) if u.kind == "move" else new
                new = new.plus(own, graph=u.target)
            case "modify":
                named = u.using_named or ()
                q = Query("construct", u.where, default_graphs=u.using, named_graphs=named)
                for x, t in u.delete:
                    new = new.without(self._instances(q, x, t), predicates([(x, t)]), few=False)
                for x, t in u.insert:
                    new = new.plus(self._instances(q, x, t), predicates([(x, t)]), graph_of(x))
        # Where the context has a folder, what changed is written, and plans do not grow with every update.
        self.source = new.cut(old) if self.spark.sparkContext.getCheckpointDir() else new

    def _instances(self, q: Query, graph, t: Triple) -> DataFrame:
        p = Prepared(self, replace(q, template=(t,)))
        if isinstance(graph, Var):
            # The graph is a variable: it is carried as one more object of the same rows.
            r = p.relation()
            name = text(r.cells[graph.name])
            cells = [as_term(r.cells[x.name]) if isinstance(x, Var) else None for x in (t.s, t.p, t.o)]
            consts = [formats.literal_struct(x) if c is None else c for c, x in zip(cells, (t.s, t.p, t.o), strict=True)]
            return r.df.select(name.alias("g"), consts[0].cast(TERM).alias("s"), consts[1]["lex"].alias("p"), consts[2].cast(TERM).alias("o")).where(f"g is not null and s.kind != {LITERAL} and p is not null and o is not null")
        return p.graph().withColumn("g", F.lit(getattr(graph, "value", None)).cast("string")).select("g", "s", "p", "o")


def _nodes(root):
    from .plans.algebra import walk

    return walk(root)


def list_formats() -> dict[str, list[str]]:
    return {"read": formats.READERS, "write": formats.WRITERS}


def list_languages() -> tuple[str, ...]:
    return LANGUAGES


def validate(text: str, update: bool = False) -> str | None:
    """None for valid text, else the message of the first error."""
    try:
        (parse_update if update else parse)(text)
    except SparqlSyntaxError as e:
        return str(e)
    return None


__all__ = ["Engine", "Prepared", "list_formats", "list_languages", "validate"]
