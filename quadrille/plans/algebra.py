"""Terms, expressions and algebra nodes. All are plain immutable values; compilers and printers walk them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Lit:
    lex: str
    lang: str | None = None
    dt: str | None = None


Term = Var | Iri | BNode | Lit


@dataclass(frozen=True)
class Call:
    """An operator or built-in function by upper-case name, or a cast or extension function by IRI."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    args: tuple  # empty: *
    distinct: bool = False
    separator: str = " "


#: IRIs of aggregates that users registered: a call of one is an aggregate.
USER_AGGREGATES: set[str] = set()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term


@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Filter:
    expr: object
    child: object


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    expr: object = None


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Graph:
    name: Term
    child: object


@dataclass(frozen=True)
class Extend:
    child: object
    var: str
    expr: object


@dataclass(frozen=True)
class Group:
    """``keys``: (name, expression); ``aggregates``: (name, Aggregate). Without keys one group always exists."""

    child: object
    keys: tuple
    aggregates: tuple


@dataclass(frozen=True)
class OrderBy:
    child: object
    keys: tuple  # (expression, descending)


@dataclass(frozen=True)
class Project:
    child: object
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    child: object


@dataclass(frozen=True)
class Slice:
    child: object
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple  # of tuples of terms, None for UNDEF


@dataclass(frozen=True)
class Service:
    name: Term
    child: object
    silent: bool
    text: str


@dataclass(frozen=True)
class Query:
    """A parsed query. ``form``: select, construct, ask or describe."""

    form: str
    root: object
    names: tuple[str, ...] = ()
    wildcard: bool = False
    distinct: bool = False
    reduced: bool = False
    template: tuple[Triple, ...] = ()
    targets: tuple[Term, ...] = ()
    default_graphs: tuple[str, ...] = ()
    named_graphs: tuple[str, ...] = ()
    prefixes: dict = field(default_factory=dict, hash=False)
    base: str | None = None
    limit: int | None = None
    offset: int = 0
    explain: bool = False
    text: str = ""

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x.name for x in walk(self.root) if isinstance(x, Var)))

    @property
    def order_conditions(self) -> tuple:
        """(expression, descending) of ORDER BY."""
        return next((x.keys for x in self._outer() if isinstance(x, OrderBy)), ())

    @property
    def group_conditions(self) -> tuple:
        """(name, expression) of GROUP BY."""
        return next((x.keys for x in self._outer() if isinstance(x, Group)), ())

    @property
    def having_conditions(self) -> tuple:
        """The conditions of HAVING: the filters above a group."""
        above = []
        for x in self._outer():
            if isinstance(x, Group):
                return tuple(above)
            if isinstance(x, Filter):
                above.append(x.expr)
        return ()

    def _outer(self):
        """The nodes from the root on to the first that has no single child."""
        node = self.root
        while node is not None:
            yield node
            node = getattr(node, "child", None) if not isinstance(node, Graph | Service) else None

    @property
    def triples(self) -> tuple[Triple, ...]:
        return tuple(x for x in walk(self.root) if isinstance(x, Triple))


@dataclass(frozen=True)
class Update:
    """``kind``: insert, delete, modify, clear, create, drop, load, add, move or copy."""

    kind: str
    delete: tuple = ()  # (graph term or None, Triple)
    insert: tuple = ()
    where: object = None
    source: str | None = None
    target: str | None = None
    silent: bool = False
    using: tuple = ()
    using_named: tuple = ()


def children(node) -> tuple:
    if isinstance(node, tuple | list):
        return tuple(node)
    if is_dataclass(node):
        return tuple(getattr(node, f.name) for f in fields(node))
    return ()


def walk(node):
    """The node and all nodes, expressions and terms below it, depth first."""
    yield node
    for x in children(node):
        if x is not None and not isinstance(x, str | int | bool | dict):
            yield from walk(x)


def in_scope(node) -> tuple[str, ...]:
    """Visible variables of a pattern, in order of first mention."""
    match node:
        case Bgp(triples):
            found = [x.name for t in triples for x in (t.s, t.p, t.o) if isinstance(x, Var)]
        case Join(a, b) | LeftJoin(a, b, _) | Union(a, b):
            found = [*in_scope(a), *in_scope(b)]
        case Minus(a, _) | Filter(_, a) | OrderBy(a, _) | Distinct(a) | Slice(a, _, _):
            found = list(in_scope(a))
        case Graph(name, a):
            found = [*([name.name] if isinstance(name, Var) else []), *in_scope(a)]
        case Service(_, a, _, _):
            found = list(in_scope(a))
        case Extend(a, name, _):
            found = [*in_scope(a), name]
        case Group(_, keys, aggregates):
            found = [k for k, _ in keys] + [a for a, _ in aggregates]
        case Project(_, names) | Values(names, _):
            found = list(names)
        case _:
            raise TypeError(node)
    return tuple(dict.fromkeys(x for x in found if not x.startswith(("_:", "."))))


def tree(node, depth: int = 0) -> str:
    """The algebra as indented text."""
    pad = "  " * depth
    match node:
        case Bgp(triples):
            return pad + "BGP\n" + "".join(f"{pad}  {show(t.s)} {show(t.p)} {show(t.o)}\n" for t in triples)
        case Join() | LeftJoin() | Minus() | Union():
            extra = f" {show(node.expr)}" if isinstance(node, LeftJoin) and node.expr is not None else ""
            return f"{pad}{type(node).__name__}{extra}\n" + tree(node.left, depth + 1) + tree(node.right, depth + 1)
        case Values(names, rows):
            return f"{pad}Values {' '.join('?' + n for n in names)} ({len(rows)} rows)\n"
        case _:
            facts = [f"{f.name}={show(getattr(node, f.name))}" for f in fields(node) if f.name not in ("child", "text")]
            return f"{pad}{type(node).__name__} {' '.join(facts)}".rstrip() + "\n" + tree(node.child, depth + 1)


def show(x) -> str:
    """A term or expression as SPARQL text."""
    match x:
        case None:
            return "UNDEF"
        case Var(name):
            return "?" + name
        case Iri(value):
            return f"<{value}>"
        case BNode(label):
            return "_:" + label
        case Lit(lex, lang, dt):
            plain = '"' + lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
            return plain + (f"@{lang}" if lang else f"^^<{dt}>" if dt and dt != XSD + "string" else "")
        case Call(name, args) if name in ("||", "&&", "=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/") and len(args) == 2:
            return f"({show(args[0])} {name} {show(args[1])})"
        case Call("IN" | "NOT IN" as name, args):
            return f"({show(args[0])} {name} ({', '.join(map(show, args[1:]))}))"
        case Call("!", (a,)):
            return f"(! {show(a)})"
        case Call("NEG", (a,)):
            return f"(- {show(a)})"
        case Call(name, args):
            head = f"<{name}>" if ":" in name else name
            return f"{head}({', '.join(map(show, args))})"
        case Aggregate(name, args, distinct, separator):
            tail = f"; SEPARATOR={show(Lit(separator))}" if name == "GROUP_CONCAT" and separator != " " else ""
            head = f"<{name}>" if ":" in name else name
            return f"{head}({'DISTINCT ' if distinct else ''}{', '.join(map(show, args)) or '*'}{tail})"
        case Exists(_, negated):
            return f"{'NOT ' if negated else ''}EXISTS {{...}}"
        case tuple():
            return "(" + " ".join(map(show, x)) + ")"
        case _:
            return str(x)
