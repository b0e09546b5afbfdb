"""Algebra to DataFrames. Every node becomes a relation: a DataFrame, and per variable a cell and whether it is
certainly bound. Certainly bound variables join by plain equality; others split into bound and unbound parts, so a
join needs an ``OR IS NULL`` only for more than SPLIT of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.library import AGGREGATES, BUILTINS, EXTENSIONS, cast, iri
from ..functions.values import NATIVE, RANKS, TERM, Value, arithmetic, as_term, compare, constant, decimal_of, double_of, number_term, rank_of, same_key, same_term, sort_columns, text, truth, unify
from ..plans.algebra import XSD, Aggregate, Bgp, BNode, Call, Distinct, Exists, Extend, Filter, Graph, Group, Iri, Join, LeftJoin, Lit, Minus, OrderBy, Project, Service, Slice, Union, Values, Var, in_scope, walk


@dataclass
class Rel:
    df: DataFrame
    cells: dict[str, Value]
    certain: frozenset[str]
    maybe: frozenset[str] = frozenset()  # of a part: variables that it was not split by


#: Variables that may be unbound by which a side of a join is split at most; the others are conditions of its joins.
SPLIT = 3


class CompileError(ValueError):
    pass


def _conjuncts(e) -> list:
    return [x for arg in e.args for x in _conjuncts(arg)] if isinstance(e, Call) and e.name == "&&" else [e]


@dataclass(frozen=True)
class _Outer:
    """The distinct values that outer rows have for some variables, as a pattern."""

    names: tuple[str, ...]
    rel: Rel


class Compiler:
    def __init__(self, spark: SparkSession, source, bindings: dict | None = None, service=None, base: str | None = None, seed: int | None = None, unknown_false: bool = False):
        self.spark, self.source, self.bindings, self.service = spark, source, bindings or {}, service
        self.base, self.seed, self.unknown_false = base, seed, unknown_false
        self.numbers: dict[str, int] = {}

    # relations
    def name(self, var: str) -> str:
        n = self.numbers.setdefault(var, len(self.numbers))
        return f"c{n}_" + "".join(ch if ch.isalnum() else "_" for ch in var)

    def rel(self, df: DataFrame, cells: dict[str, Value], certain=None) -> Rel:
        """A relation of ``cells`` over the columns of ``df``."""
        named = df.select(*[v.col.alias(self.name(n)) for n, v in cells.items()]) if cells else df.select(F.lit(1).alias("unit"))
        own = {n: Value(v.kind, F.col(self.name(n)), v.template, v.number) for n, v in cells.items()}
        return Rel(named, own, frozenset(cells if certain is None else certain))

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("unit")), {}, frozenset())

    def same(self, a: Value, b: Value) -> Column:
        return same_term(a, b)

    # patterns
    def compile(self, node, graph=None) -> Rel:
        match node:
            case Bgp(triples):
                return self.source.bgp(triples, graph, self) if triples else self._empty_bgp(graph)
            case Graph(name, child):
                return self.compile(child, name)
            case Join(a, b):
                return self.join(self.compile(a, graph), self.compile(b, graph))
            case LeftJoin(a, b, e):
                return self.left_join(self.compile(a, graph), self.compile(b, graph), e, graph)
            case Minus(a, b):
                return self.minus(self.compile(a, graph), self.compile(b, graph))
            case Union(a, b):
                return self.union(self.compile(a, graph), self.compile(b, graph))
            case Filter(e, a):
                return self.filter(self.compile(a, graph), e, graph)
            case Extend(a, n, e):
                return self.extend(self.compile(a, graph), n, e, graph)
            case Values(names, rows):
                return self.values(names, rows)
            case Group(a, keys, aggregates):
                return self.group(self.compile(a, graph), keys, aggregates, graph)
            case Project(a, names):
                return self.project(self.compile(a, graph), names)
            case Distinct(a):
                return self.distinct(self.compile(a, graph))
            case OrderBy(a, keys):
                return self.order(self.compile(a, graph), keys, graph)
            case Slice(a, offset, limit):
                r = self.compile(a, graph)
                df = r.df.offset(offset) if offset else r.df
                return Rel(df.limit(limit) if limit is not None else df, r.cells, r.certain)
            case Service():
                return self.call_service(node)
            case _Outer(names, outer):
                return self.distinct(self.project(outer, names))
        raise CompileError(f"{type(node).__name__} can't be compiled")

    def _empty_bgp(self, graph) -> Rel:
        if isinstance(graph, Var):
            return self.rel(self.source.graph_names(), {graph.name: Value("iri", F.col("g"))})
        if isinstance(graph, Iri):
            return self.rel(self.source.graph_names().where(F.col("g") == graph.value), {})
        return self.unit()

    def _right(self, r: Rel) -> Rel:
        """The relation with columns named apart from any left side's."""
        df = r.df.toDF(*[f"r_{c}" for c in r.df.columns])
        return Rel(df, {n: Value(v.kind, F.col(f"r_{self.name(n)}"), v.template, v.number) for n, v in r.cells.items()}, r.certain)

    def _aligned(self, a: Rel, b: Rel, shared) -> dict[str, tuple[Value, Value]]:
        return {n: unify(a.cells[n], b.cells[n]) for n in shared}

    def _merged(self, a: Rel, b: Rel) -> dict[str, Value]:
        """Cells of a joined row: shared variables from either side."""
        out = dict(a.cells)
        for n, v in b.cells.items():
            if n not in a.cells:
                out[n] = v
            else:
                x, y = unify(a.cells[n], v)
                out[n] = x if n in a.certain else Value(x.kind, F.coalesce(x.col, y.col), x.template, x.number and y.number)
        return out

    def _parts(self, r: Rel, names) -> list[tuple[Rel, frozenset]]:
        """The relation split by which of ``names`` are bound, with the bound ones; certain names do not split, and neither do
        those beyond SPLIT, which count as bound and are ``maybe``."""
        open_names = sorted(n for n in names if n not in r.certain)
        maybe, open_names = frozenset(open_names[SPLIT:]), open_names[:SPLIT]
        out = []
        for bound in product((True, False), repeat=len(open_names)):
            df = r.df
            for n, yes in zip(open_names, bound, strict=True):
                df = df.where(r.cells[n].col.isNotNull() if yes else r.cells[n].col.isNull())
            have = frozenset(n for n in names if n in r.certain) | maybe | {n for n, yes in zip(open_names, bound, strict=True) if yes}
            out.append((Rel(df, r.cells, r.certain, maybe), have))
        return out

    def _on(self, a: Rel, b: Rel, names) -> Column | None:
        on = None
        for n, (x, y) in self._aligned(a, b, sorted(names)).items():
            test = same_key(x) == same_key(y)
            if n in a.maybe | b.maybe:
                test = x.col.isNull() | y.col.isNull() | test
            on = test if on is None else on & test
        return on

    def _joined(self, a: Rel, b: Rel, on: Column | None, how: str) -> DataFrame:
        if on is None and how == "inner":
            return a.df.crossJoin(b.df)
        return a.df.join(b.df, on if on is not None else F.lit(True), how)

    def join(self, a: Rel, b: Rel) -> Rel:
        """Rows that agree on the variables bound on both sides."""
        if not a.cells and not b.cells:
            return Rel(a.df.crossJoin(b.df.toDF("r_unit")).select("unit"), {}, frozenset())
        b = self._right(b)
        shared = [n for n in a.cells if n in b.cells]
        merged, certain = self._merged(a, b), a.certain | b.certain
        out = None
        for (x, p), (y, q) in product(self._parts(a, shared), self._parts(b, shared)):
            one = self.rel(self._joined(x, y, self._on(x, y, p & q), "inner"), merged, certain)
            out = one if out is None else Rel(out.df.unionAll(one.df), one.cells, certain)
        return out

    def _condition(self, cells: dict[str, Value], e, graph) -> Column:
        return F.coalesce(truth(self.expression(e, cells, graph)), F.lit(False))

    def left_join(self, a: Rel, b: Rel, e, graph) -> Rel:
        b = self._right(b)
        shared = [n for n in a.cells if n in b.cells]
        merged = self._merged(a, b)
        extra = self._condition(merged, e, graph) if e is not None else None
        both = lambda on: extra if on is None else on if extra is None else on & extra
        left, right = self._parts(a, shared), self._parts(b, shared)
        if len(left) == len(right) == 1:
            df = self._joined(a, b, both(self._on(left[0][0], right[0][0], shared)), "left")
            return self.rel(df, merged, a.certain)
        out = None
        for x, p in left:
            alone = x.df
            for y, q in right:
                on = both(self._on(x, y, p & q))
                one = self.rel(self._joined(x, y, on, "inner"), merged, a.certain)
                out = one.df if out is None else out.unionAll(one.df)
                alone = alone.join(y.df, on if on is not None else F.lit(True), "left_anti")
            out = out.unionAll(self.rel(alone, {n: self._only_left(a, n, v) for n, v in merged.items()}, a.certain).df)
        return Rel(out, one.cells, a.certain)

    def _only_left(self, a: Rel, n: str, v: Value) -> Value:
        """The merged cell's form with the left side's value, or unbound."""
        if n in a.cells:
            own = a.cells[n]
            if own.kind == v.kind and own.template == v.template:
                return own
            return Value(v.kind, as_term(own) if v.kind == "term" else text(own), v.template, v.number)
        return Value(v.kind, F.lit(None).cast(TERM if v.kind == "term" else NATIVE.get(v.kind, "string")), v.template, v.number)

    def minus(self, a: Rel, b: Rel) -> Rel:
        """Rows of ``a`` that no row of ``b`` agrees with on at least one variable bound in both."""
        b = self._right(b)
        shared = [n for n in a.cells if n in b.cells]
        out = None
        for x, p in self._parts(a, shared):
            df = x.df
            for y, q in self._parts(b, shared):
                if p & q:
                    on = self._on(x, y, p & q)
                    if p & q <= x.maybe | y.maybe:
                        met = [x.cells[n].col.isNotNull() & y.cells[n].col.isNotNull() for n in sorted(p & q)]
                        on = on & reduce(Column.__or__, met)
                    df = df.join(y.df, on, "left_anti")
            out = df if out is None else out.unionAll(df)
        return Rel(out, a.cells, a.certain)

    def _correlated(self, node, outer: Rel) -> tuple[object, frozenset]:
        """A pattern of EXISTS whose expressions see the variables of the outer row, and which of them it takes.

        Where an expression needs one that its own pattern does not bind, that pattern joins the distinct outer values.
        Every row of the result then has all that are taken, also in branches that need none of them.
        """
        if isinstance(node, Filter | Extend):
            child, have = self._correlated(node.child, outer)
            child, have = self._given(child, node.child, self._outer_names(node.expr, outer, node.child), have, outer)
            return (Filter(node.expr, child) if isinstance(node, Filter) else Extend(child, node.var, node.expr)), have
        if isinstance(node, Graph):
            child, have = self._correlated(node.child, outer)
            return Graph(node.name, child), have
        if not isinstance(node, Join | Union | LeftJoin | Minus):
            return node, frozenset()
        (a, p), (b, q) = self._correlated(node.left, outer), self._correlated(node.right, outer)
        if isinstance(node, Join):
            return Join(a, b), p | q
        if isinstance(node, Union):
            a, b = self._given(a, node.left, q, p, outer)[0], self._given(b, node.right, p, q, outer)[0]
            return Union(a, b), p | q
        if isinstance(node, LeftJoin):
            names = self._outer_names(node.expr, outer, Join(node.left, node.right)) if node.expr is not None else frozenset()
            a, p = self._given(a, node.left, q | names, p, outer)
            return LeftJoin(a, b, node.expr), p
        if not set(in_scope(node.left)) & set(in_scope(node.right)):
            return a, p  # what shares no variable removes nothing
        a, p = self._given(a, node.left, q, p, outer)
        return Minus(a, b), p

    def _outer_names(self, e, outer: Rel, child) -> frozenset:
        return frozenset({x.name for x in walk(e) if isinstance(x, Var)} & set(outer.cells)) - set(in_scope(child))

    def _given(self, node, plain, names: frozenset, have: frozenset, outer: Rel) -> tuple[object, frozenset]:
        """``node`` joined with the outer values of ``names`` that it does not have; ``plain`` is the node before any such join."""
        more = names - have - set(in_scope(plain))
        if not more:
            return node, have
        shared = have | (set(in_scope(plain)) & set(outer.cells))
        return Join(node, _Outer(tuple(sorted(more | shared)), outer)), have | more

    def exists(self, a: Rel, pattern, graph, negated: bool) -> Rel:
        """A semi or anti join on the shared variables; outer filters of the pattern are its condition."""
        tests = []
        pattern = self._filters_out(pattern)
        while isinstance(pattern, Filter):
            tests += _conjuncts(pattern.expr)
            pattern = pattern.child
        for e in tests:
            if any(isinstance(x, Exists) for x in walk(e)):
                pattern = Filter(e, pattern)
        tests = [e for e in tests if not any(isinstance(x, Exists) for x in walk(e))]
        pattern, given = self._correlated(pattern, a)
        inner = self.compile(pattern, graph)
        simple = [e for e in tests if not {x.name for x in walk(e) if isinstance(x, Var)} - set(inner.cells)]
        for e in simple:
            inner = self.filter(inner, e, graph)
        inner, rest = self._extreme(a, inner, [e for e in tests if e not in simple], given, graph)
        b = self._right(inner)
        shared = [n for n in a.cells if n in b.cells and n not in given]
        of_outer = [same_key(x).eqNullSafe(same_key(y)) for x, y in self._aligned(a, b, sorted(given)).values()]
        merged, how = self._merged(a, b), "left_anti" if negated else "left_semi"
        out = None
        for x, p in self._parts(a, shared):
            right = self._parts(b, shared)
            df, found = x.df, None
            for i, (y, q) in enumerate(right):
                on = self._on(x, y, p & q)
                for c in [*of_outer, *(self._condition(merged, e, graph) for e in rest)]:
                    on = c if on is None else on & c
                on = F.lit(True) if on is None else on
                if negated:
                    df = df.join(y.df, on, how)
                else:
                    one = x.df.join(y.df, on, how)
                    for z, r in right[:i]:
                        before = self._on(x, z, p & r)
                        for c in [*of_outer, *(self._condition(merged, e, graph) for e in rest)]:
                            before = c if before is None else before & c
                        one = one.join(z.df, before if before is not None else F.lit(True), "left_anti")
                    found = one if found is None else found.unionAll(one)
            df = df if negated else found
            out = df if out is None else out.unionAll(df)
        return Rel(out, a.cells, a.certain)

    def _filters_out(self, node):
        """The pattern with the filters at the top of a GRAPH, or of a filter's child, moved out of it."""
        if isinstance(node, Filter):
            return Filter(node.expr, self._filters_out(node.child))
        if isinstance(node, Graph):
            child, tests = self._filters_out(node.child), []
            while isinstance(child, Filter) and not any(isinstance(x, Exists) for x in walk(child.expr)):
                tests.append(child.expr)
                child = child.child
            node = Graph(node.name, child)
            for e in reversed(tests):
                node = Filter(e, node)
        return node

    def _extreme(self, a: Rel, inner: Rel, tests, given, graph) -> tuple[Rel, list]:
        """The pattern of EXISTS and the tests left to do with each outer row. If that is one test that an inner value is
        less or greater than an outer one, the greatest or least value of each key tells, so one row a key is left."""
        match tests:
            case [Call("<" | ">" | "<=" | ">=" as op, (x, y))]:
                pass
            case _:
                return inner, tests
        if any(not isinstance(n, Var | Lit) and not (isinstance(n, Call) and n.name in ("+", "-", "*", "/", "NEG")) for e in (x, y) for n in walk(e)):
            return inner, tests
        names = [{n.name for n in walk(e) if isinstance(n, Var)} for e in (x, y)]
        own = [i for i in (0, 1) if names[i] and names[i] <= set(inner.cells) and not names[1 - i] & set(inner.cells)]
        if not own:
            return inner, tests
        v, w = (self.expression((x, y)[i], (inner if i == own[0] else a).cells, graph) for i in (own[0], 1 - own[0]))
        w = w.native or w
        if not (v.kind in RANKS and w.kind in RANKS or v.kind == w.kind and v.kind in ("string", "boolean", "dateTime", "date")):
            return inner, tests
        keys = {n: k for n, k in inner.cells.items() if n in a.cells}
        columns = {n: f"k{i}" for i, n in enumerate(keys)}
        pick = F.max if (op in (">", ">=")) == (own[0] == 0) else F.min
        rows = inner.df.select(*[k.col.alias(columns[n]) for n, k in keys.items()], v.col.alias("x")).groupBy(*columns.values()).agg(pick("x").alias("x"))
        cells = {n: Value(k.kind, F.col(columns[n]), k.template, k.number) for n, k in keys.items()}
        made = self.rel(rows, {**cells, ".x": Value(v.kind, F.col("x"))}, inner.certain & set(keys))
        return made, [Call(op, (Var(".x"), y) if own[0] == 0 else (x, Var(".x")))]

    def union(self, a: Rel, b: Rel) -> Rel:
        names = [*a.cells, *[n for n in b.cells if n not in a.cells]]
        forms = {n: unify(a.cells[n], b.cells[n]) if n in a.cells and n in b.cells else None for n in names}
        sides = []
        for i, r in enumerate((a, b)):
            cells = {}
            for n in names:
                other = (b, a)[i]
                cells[n] = forms[n][i] if forms[n] else r.cells[n] if n in r.cells else self._only_left(r, n, other.cells[n])
            sides.append(self.rel(r.df, cells, a.certain & b.certain))
        return Rel(sides[0].df.unionAll(sides[1].df), sides[1].cells, a.certain & b.certain)

    def filter(self, r: Rel, e, graph) -> Rel:
        if isinstance(e, Call) and e.name == "&&":
            for x in e.args:
                r = self.filter(r, x, graph)
            return r
        negated = isinstance(e, Call) and e.name == "!" and isinstance(e.args[0], Exists)
        if negated:
            e = Exists(e.args[0].pattern, not e.args[0].negated)
        if isinstance(e, Exists):
            return self.exists(r, e.pattern, graph, e.negated)
        r, e = self._marked(r, e, graph)
        certain = r.certain | {x.args[0].name for x in [e] if isinstance(x, Call) and x.name == "BOUND"}
        kept = Rel(r.df.where(self._condition(r.cells, e, graph)), r.cells, certain)
        return Rel(kept.df, {n: v for n, v in kept.cells.items() if not n.startswith(".m")}, certain)

    def _marked(self, r: Rel, e, graph):
        """EXISTS below other operators: a column that tells it for every row."""
        if isinstance(e, Exists):
            name = f".m{len(self.numbers)}"
            if (told := self._told(r, e, graph, name)) is not None:
                return told, Var(name)
            yes, no = (self.exists(r, e.pattern, graph, n) for n in (False, True))
            cells = lambda flag: {**r.cells, name: Value("boolean", F.lit(flag))}
            x, y = self.rel(yes.df, cells(not e.negated), r.certain), self.rel(no.df, cells(e.negated), r.certain)
            return Rel(x.df.unionAll(y.df), x.cells, r.certain), Var(name)
        if isinstance(e, Call):
            args = []
            for x in e.args:
                r, x = self._marked(r, x, graph)
                args.append(x)
            return r, Call(e.name, tuple(args))
        return r, e

    def _told(self, r: Rel, e: Exists, graph, name: str) -> Rel | None:
        """``r`` with a column that tells of every row whether the pattern exists, by one left join with the distinct keys
        of the pattern; None where a shared variable may be unbound."""
        pattern, given = self._correlated(e.pattern, r)
        b = self._right(self.compile(pattern, graph))
        shared = [n for n in r.cells if n in b.cells and n not in given]
        if not set(shared) <= r.certain & b.certain:
            return None
        pairs = [(same_key(x), same_key(y), n in given) for n, (x, y) in self._aligned(r, b, [*shared, *sorted(given)]).items()]
        keys = b.df.select(*[y.alias(f"k{i}") for i, (_, y, _) in enumerate(pairs)], F.lit(True).alias("found"))
        keys = keys.distinct() if pairs else keys.limit(1)
        on = F.lit(True)
        for i, (x, _, outer) in enumerate(pairs):
            test = x.eqNullSafe(F.col(f"k{i}")) if outer else x == F.col(f"k{i}")
            on = on & test if i else test
        flag = F.coalesce(F.col("found"), F.lit(False))
        return self.rel(r.df.join(keys, on, "left"), {**r.cells, name: Value("boolean", ~flag if e.negated else flag)}, r.certain)

    def extend(self, r: Rel, n: str, e, graph) -> Rel:
        r, e = self._marked(r, e, graph)
        cells = {k: v for k, v in r.cells.items() if not k.startswith(".m")}
        v = self.expression(e, r.cells, graph)
        sure = isinstance(e, Iri | Lit) or isinstance(e, Var) and e.name in r.certain
        return self.rel(r.df, {**cells, n: v}, r.certain | {n} if sure else r.certain)

    def values(self, names, rows) -> Rel:
        """An inline table; a column of one native kind stays native."""
        cells = {}
        columns = []
        for i, n in enumerate(names):
            own = [constant(row[i]) if row[i] is not None else None for row in rows]
            kinds = {v.kind for v in own if v is not None}
            kind = kinds.pop() if len(kinds) == 1 else "term"
            columns.append([(F.lit(None) if v is None else v.col if kind == v.kind else as_term(v)) for v in own])
            cells[n] = Value(kind, F.col(f"v{i}"))
        if not rows:
            return self.rel(self.spark.range(0).select(*[F.lit(None).cast(TERM).alias(f"v{i}") for i in range(len(names))]), {n: Value("term", F.col(f"v{i}")) for i, n in enumerate(names)}, frozenset())
        if not names:
            return self.rel(self.spark.range(len(rows)), {})
        kinds = [cells[n].kind for n in names]
        structs = [F.struct(*[columns[i][k].cast(TERM if kinds[i] == "term" else NATIVE[kinds[i]]).alias(f"v{i}") for i in range(len(names))]) for k in range(len(rows))]
        df = self.spark.range(1).select(F.explode(F.array(*structs)).alias("x")).select("x.*")
        return self.rel(df, cells, {n for i, n in enumerate(names) if all(row[i] is not None for row in rows)})

    def project(self, r: Rel, names) -> Rel:
        cells = {n: r.cells.get(n) or Value("term", F.lit(None).cast(TERM)) for n in names}
        return self.rel(r.df, cells, r.certain & set(names))

    def distinct(self, r: Rel) -> Rel:
        if not r.cells:
            return Rel(r.df.limit(1), r.cells, r.certain)
        if all(v.kind != "term" for v in r.cells.values()):
            return Rel(r.df.distinct(), r.cells, r.certain)
        keys = {f"k{i}": same_key(v) for i, v in enumerate(r.cells.values())}
        return Rel(r.df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys), r.cells, r.certain)

    def order(self, r: Rel, keys, graph) -> Rel:
        by = []
        for e, down in keys:
            for c in sort_columns(self.expression(e, r.cells, graph)):
                by.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return Rel(r.df.orderBy(*by), r.cells, r.certain)

    # groups
    def group(self, r: Rel, keys, aggregates, graph) -> Rel:
        cells = {n: self.expression(e, r.cells, graph) for n, e in keys}
        names = [f"g{i}" for i in range(len(keys))]
        plain = {g: v.col for g, v in zip(names, cells.values(), strict=True)}
        steps = [self._aggregate(i, a, r, graph, plain) for i, (_, a) in enumerate(aggregates)]
        columns = [c for s in steps for c in s[0]] or [F.count(F.lit(1)).alias("n0")]
        df = (r.df.withColumns(plain) if plain else r.df).groupBy(*names).agg(*columns)
        out = {n: Value(v.kind, F.col(g), v.template, v.number) for g, (n, v) in zip(names, cells.items(), strict=True)}
        certain = {n for n, e in keys if isinstance(e, Var) and e.name in r.certain}
        for (n, a), (_, v) in zip(aggregates, steps, strict=True):
            out[n] = v
            if a.name == "COUNT":
                certain.add(n)
        return self.rel(df, out, certain)

    def _aggregate(self, i: int, a: Aggregate, r: Rel, graph, plain: dict[str, Column]) -> tuple[list[Column], Value]:
        """Columns to aggregate, and the cell made of them. SUM, AVG, MIN and MAX of a group with an error are unbound.

        What is aggregated becomes a column of its own in ``plain`` first.
        """
        name = lambda k: f"a{i}_{k}"

        def put(k, c: Column) -> Column:
            plain[f"p{i}_{k}"] = c
            return F.col(f"p{i}_{k}")

        if a.name == "COUNT" and not a.args:
            if a.distinct:
                every = [F.coalesce(same_key(v).cast("string"), F.lit("\0")) for n, v in r.cells.items() if not n.startswith(("_:", "."))]
                return [F.count_distinct(put(0, F.struct(*every) if every else F.lit(1))).alias(name(0))], Value("integer", F.col(name(0)))
            return [F.count(F.lit(1)).alias(name(0))], Value("integer", F.col(name(0)))
        args = [self.expression(e, r.cells, graph) for e in a.args]
        if a.name in AGGREGATES:
            function, kind = AGGREGATES[a.name]
            return [function(*[put(k, text(x)) for k, x in enumerate(args)]).alias(name(0))], Value(kind, F.col(name(0)))
        v = args[0]
        if a.name == "COUNT":
            return [(F.count_distinct if a.distinct else F.count)(put(0, same_key(v))).alias(name(0))], Value("integer", F.col(name(0)))
        if a.name in ("SAMPLE", "MIN", "MAX"):
            pick = F.max if a.name == "MAX" else F.min
            if v.kind != "term":
                return [pick(put(0, v.col)).alias(name(0))], Value(v.kind, F.col(name(0)), v.template, v.number)
            ordered = put(0, F.when(v.col.isNotNull(), F.struct(*[c.alias(f"s{k}") for k, c in enumerate(sort_columns(v))], v.col.alias("v"))))
            return [pick(ordered).alias(name(0))], Value("term", F.col(name(0))["v"], number=v.number)
        if a.name == "GROUP_CONCAT":
            lex = put(0, F.concat_ws(a.separator, *[text(x) for x in args]) if len(args) > 1 else text(v))
            made = F.array_join(F.sort_array((F.collect_set if a.distinct else F.collect_list)(lex)), a.separator)
            return [made.alias(name(0))], Value("string", F.col(name(0)))
        v = v.native or v
        if v.kind in RANKS:
            # Whole numbers are added up as decimals: 20 digits and a group of up to 10 ** 18 rows fit.
            c = put(0, v.col.cast("decimal(20,0)") if v.kind == "integer" else v.col)
            total = F.expr(f"try_sum({'DISTINCT ' if a.distinct else ''}p{i}_0)") if v.kind != "double" else (F.sum_distinct if a.distinct else F.sum)(c)
            n = (F.count_distinct if a.distinct else F.count)(c)
            if a.name == "SUM":
                return [F.when(n == 0, F.lit(0).cast(NATIVE[v.kind])).otherwise(total.try_cast(NATIVE[v.kind])).alias(name(0))], Value(v.kind, F.col(name(0)))
            if v.kind == "double":
                return [F.when(n == 0, 0.0).otherwise(F.try_divide(total, n)).alias(name(0))], Value("double", F.col(name(0)))
            mean = F.try_divide(total, n.cast("decimal(12,0)")).try_cast("decimal(28,10)")
            return [F.when(n == 0, F.lit(0).cast("decimal(28,10)")).otherwise(mean).alias(name(0))], Value("decimal", F.col(name(0)))
        if v.kind != "term":
            return [F.max(F.when(put(0, v.col).isNotNull(), 1)).alias(name(0))], Value("integer", F.when(F.col(name(0)).isNull(), 0).cast("bigint"))
        rank, decimal, double = put(0, rank_of(v)), put(1, decimal_of(v)), put(2, double_of(v))
        bad = F.max(put(3, F.when(v.col.isNotNull() & double_of(v).isNull(), 1))).alias(name(0))
        distinct = "DISTINCT " if a.distinct else ""
        total = F.expr(f"try_sum({distinct}p{i}_1)")
        count = (F.count_distinct if a.distinct else F.count)(double).alias(name(4))
        columns = [bad, F.max(rank).alias(name(1)), total.alias(name(2)), (F.sum_distinct if a.distinct else F.sum)(double).alias(name(3)), count, F.count(decimal).alias(name(5))]
        n = F.col(name(4))
        # A sum of decimals that does not fit stays NULL, and so does that of a group in which not all are decimals.
        rank, decimal, double = F.coalesce(F.col(name(1)), F.lit(1)), F.when(F.col(name(5)) == 0, F.lit(0).cast("decimal(38,10)")).otherwise(F.col(name(2))), F.coalesce(F.col(name(3)), F.lit(0.0))
        if a.name == "AVG":
            rank = F.when(n == 0, 1).otherwise(F.greatest(rank, F.lit(2)))
            decimal = F.when(n == 0, F.lit(0).cast("decimal(38,10)")).otherwise(F.try_divide(decimal, n.cast("decimal(12,0)")))
            double = F.coalesce(F.try_divide(double, n), F.lit(0.0))
        made = number_term(rank, decimal.try_cast("decimal(28,10)"), double)
        return columns, Value("term", F.when(F.col(name(0)).isNull(), made.col), number=True)

    # expressions
    def expression(self, e, cells: dict[str, Value], graph=None) -> Value:
        match e:
            case Var(name):
                if name in cells:
                    return cells[name]
                if name in self.bindings:
                    return constant(self.bindings[name])
                return Value("term", F.lit(None).cast(TERM))
            case Iri() | Lit() | BNode():
                return constant(e)
            case Call("&&" | "||" as op, (a, b)):
                x, y = (truth(self.expression(i, cells, graph)) for i in (a, b))
                return Value("boolean", x & y if op == "&&" else x | y)
            case Call("!", (a,)):
                return Value("boolean", ~truth(self.expression(a, cells, graph)))
            case Call("=" | "!=" | "<" | ">" | "<=" | ">=" as op, (a, b)):
                return Value("boolean", compare(op, self.expression(a, cells, graph), self.expression(b, cells, graph)))
            case Call("+" | "-" | "*" | "/" as op, (a, b)):
                return arithmetic(op, self.expression(a, cells, graph), self.expression(b, cells, graph))
            case Call("NEG", (a,)):
                return arithmetic("*", self.expression(a, cells, graph), constant(Lit("-1", None, XSD + "integer")))
            case Call("IN" | "NOT IN" as op, (a, *items)):
                x = self.expression(a, cells, graph)
                found = F.lit(False)
                for i in items:
                    found = found | compare("=", x, self.expression(i, cells, graph))
                return Value("boolean", found if op == "IN" else ~found)
            case Call("BOUND", (Var(name),)):
                return Value("boolean", cells[name].col.isNotNull() if name in cells else F.lit(name in self.bindings))
            case Call("RAND", ()):
                return Value("double", F.rand(self.seed))
            case Call("IRI", (a,)):
                return iri(self.expression(a, cells, graph), self.base)
            case Call(name, args) if name in BUILTINS:
                return BUILTINS[name](*[self.expression(a, cells, graph) for a in args])
            case Call(name, args) if name in EXTENSIONS:
                return EXTENSIONS[name](*[self.expression(a, cells, graph) for a in args])
            case Call(name, (a,)) if (made := cast(name, self.expression(a, cells, graph))) is not None:
                return made
            case Call(name, _):
                if self.unknown_false:
                    return Value("boolean", F.lit(False))
                raise CompileError(f"unknown function {name}")
            case Exists():
                raise CompileError("EXISTS is not possible here")
        raise CompileError(f"not an expression: {e!r}")

    # services
    def call_service(self, node: Service) -> Rel:
        if self.service is None or not isinstance(node.name, Iri):
            if node.silent:
                return self.unit()
            raise CompileError("SERVICE needs a service client and a constant IRI")
        names = in_scope(node.child)
        try:
            rows = self.service.select(node.name.value, f"SELECT {' '.join('?' + n for n in names) or '*'} WHERE {node.text}")
        except Exception:
            if node.silent:
                return self.unit()
            raise
        return self.values(names, tuple(tuple(row.get(n) for n in names) for row in rows))
