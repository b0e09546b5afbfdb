"""Typed cells: a static kind and a Spark column.

Kinds: ``iri`` (its text), ``key`` (an IRI as template and native key), ``string``, ``integer``, ``decimal``,
``double``, ``boolean``, ``dateTime``, ``date``, and ``term``, the struct (kind, lex, lang, dt) of any RDF term. An
error and an unbound value are NULL, so SQL's three-valued logic is SPARQL's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import XSD, BNode, Iri, Lit

BLANK, IRI, LITERAL = 1, 2, 3
TERM = "struct<kind:tinyint,lex:string,lang:string,dt:string>"
DECIMAL = "decimal(28,10)"
#: The numeric types and what is derived from integer.
INTEGERS = tuple(XSD + n for n in ("integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "positiveInteger", "unsignedInt", "unsignedShort", "unsignedByte"))
DOUBLES = (XSD + "double", XSD + "float")
NUMERIC = (*INTEGERS, XSD + "decimal", *DOUBLES)
RANKS = {"integer": 1, "decimal": 2, "double": 3}
NATIVE = {"integer": "bigint", "decimal": DECIMAL, "double": "double", "boolean": "boolean", "string": "string", "iri": "string", "dateTime": "timestamp", "date": "date"}


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    template: str | None = None
    number: bool = False  # of a term: certainly numeric or NULL
    native: Value | None = None  # of a constant term: the number that it means
    const: str | None = None  # of a constant string: its text


def lit_null() -> Column:
    return F.lit(None).cast("string")


def term(kind, lex: Column, lang: Column | None = None, dt: Column | None = None) -> Column:
    made = F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), (lit_null() if lang is None else lang).alias("lang"), (lit_null() if dt is None else dt).alias("dt"))
    return F.when(lex.isNotNull(), made)


#: Forms of numbers that a native cell prints again as they were.
_CANONICAL = {XSD + "integer": re.compile(r"0|-?[1-9]\d{0,17}"), XSD + "decimal": re.compile(r"-?(0|[1-9]\d{0,16})\.(0|\d{0,9}[1-9])")}


def _number(lex: str, dt: str) -> Value | None:
    """The native number that a well-formed literal means."""
    try:
        if dt in INTEGERS and abs(int(lex)) < 1 << 63:
            return Value("integer", F.lit(int(lex)).cast("bigint"))
        if dt == XSD + "decimal" and re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", lex):
            return Value("decimal", F.lit(lex).try_cast(DECIMAL))
        if dt in DOUBLES:
            return Value("double", F.lit(float(lex.replace("INF", "inf"))))
    except ValueError:
        pass
    return None


def constant(t) -> Value:
    """The cell of a constant term: native where its datatype has a native kind that prints it in the same form, else the
    term itself, with the number that it means."""
    match t:
        case Iri(value):
            return Value("iri", F.lit(value))
        case BNode(label):
            return Value("term", term(BLANK, F.lit(label)))
        case Lit(lex, None, None) | Lit(lex, None, "http://www.w3.org/2001/XMLSchema#string"):
            return Value("string", F.lit(lex), const=lex)
        case Lit(lex, None, dt):
            number = _number(lex, dt)
            if number is not None and dt in _CANONICAL and _CANONICAL[dt].fullmatch(lex) and lex != "-0.0":
                return number
            if number is not None:
                return Value("term", term(LITERAL, F.lit(lex), None, F.lit(dt)), number=True, native=number)
            if dt == XSD + "boolean" and lex in ("true", "false"):
                return Value("boolean", F.lit(lex == "true"))
            return Value("term", term(LITERAL, F.lit(lex), None, F.lit(dt)))
        case Lit(lex, lang, _):
            return Value("term", term(LITERAL, F.lit(lex), F.lit(lang)))
    raise TypeError(t)


def _in_utc() -> bool:
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "+00:00")


def utc(c: Column) -> Column:
    """A timestamp whose fields in the session's zone are those of ``c`` in UTC."""
    return c if _in_utc() else F.to_utc_timestamp(c, F.current_timezone())


def from_fields(c: Column) -> Column:
    """The instant whose fields in UTC are those of a timestamp without zone."""
    return c.cast("timestamp") if _in_utc() else F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())


def decimal_text(c: Column) -> Column:
    """Canonical decimal: no trailing zeros, at least one digit after the point."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def double_text(c: Column) -> Column:
    """A float or double as XSD writes it."""
    return F.regexp_replace(c.cast("string"), "Infinity", "INF")


def text(v: Value) -> Column:
    """STR(): the lexical form."""
    match v.kind:
        case "term":
            return v.col["lex"]
        case "key":
            return F.when(v.col.isNotNull(), F.concat(F.lit(v.template), v.col.cast("string")))
        case "dateTime":
            return F.regexp_replace(F.date_format(utc(v.col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"^\+|\.?0*(?=Z$)", "")
        case "date":
            return F.regexp_replace(v.col.cast("string"), r"^\+", "")
        case "decimal":
            return decimal_text(v.col)
        case "double":
            return double_text(v.col)
        case _:
            return v.col.cast("string")


def as_term(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind in ("iri", "key"):
        return term(IRI, text(v))
    return term(LITERAL, text(v), None, None if v.kind == "string" else F.lit(XSD + v.kind))


def same_key(v: Value) -> Column:
    """What two equal terms have in common: for joins, groups and DISTINCT."""
    if v.kind != "term":
        return v.col
    return F.when(v.col.isNotNull(), F.struct(v.col["kind"].alias("kind"), v.col["lex"].alias("lex"), F.lower(v.col["lang"]).alias("lang"), v.col["dt"].alias("dt")))


def is_plain(t: Column) -> Column:
    return (t["kind"] == LITERAL) & t["lang"].isNull() & t["dt"].isNull()


def is_number(t: Column) -> Column:
    return (t["kind"] == LITERAL) & F.coalesce(t["dt"].isin(*NUMERIC), F.lit(False))


def double_of(v: Value) -> Column:
    """The number as a double; NULL for anything else, ill-formed numbers too."""
    if v.kind in RANKS:
        return v.col.cast("double")
    if v.kind == "term":
        lex = F.regexp_replace(v.col["lex"], "^([+-]?)INF$", "$1Infinity")
        return F.when(is_number(v.col), lex.try_cast("double"))
    return F.lit(None).cast("double")


def decimal_of(v: Value) -> Column:
    if v.kind in RANKS:
        return v.col.try_cast(DECIMAL)
    if v.kind == "term":
        return F.when(is_number(v.col), v.col["lex"].try_cast(DECIMAL))
    return F.lit(None).cast(DECIMAL)


def rank_of(v: Value) -> Column:
    """1 integer, 2 decimal, 3 float or double; NULL for no number."""
    if v.kind in RANKS:
        return F.lit(RANKS[v.kind])
    if v.kind == "term":
        dt = v.col["dt"]
        return F.when(dt.isin(*INTEGERS), 1).when(dt == XSD + "decimal", 2).when(dt.isin(*DOUBLES), 3)
    return F.lit(None).cast("int")


def number_term(rank: Column, decimal: Column, double: Column) -> Value:
    """A term of the dynamic numeric type ``rank``."""
    lex = F.when(rank == 3, double_text(double)).when(rank == 2, decimal_text(decimal)).when(rank == 1, decimal.cast("decimal(38,0)").cast("string"))
    dt = F.when(rank == 3, XSD + "double").when(rank == 2, XSD + "decimal").otherwise(XSD + "integer")
    return Value("term", term(LITERAL, lex, None, dt), number=True)


def instant(v: Value) -> Column:
    """A dateTime (or date) as a timestamp, read as UTC where it has no zone."""
    if v.kind == "dateTime":
        return v.col
    if v.kind == "date":
        return from_fields(v.col)
    if v.kind == "term":
        whole = F.regexp_replace(v.col["lex"], r"^(-?\d{4,}-\d\d-\d\d)(Z|[+-]\d\d:\d\d)?$", "$1T00:00:00$2")
        return F.when(v.col["dt"].isin(XSD + "dateTime", XSD + "date"), F.regexp_replace(whole, r"(T[\d:.]+)$", "$1Z").try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def truth(v: Value) -> Column:
    """The effective boolean value; NULL is an error."""
    v = v.native or v
    match v.kind:
        case "boolean":
            return v.col
        case "string":
            return F.length(v.col) > 0
        case "integer" | "decimal":
            return v.col != 0
        case "double":
            return (v.col != 0) & ~F.isnan(v.col)
        case "term":
            t, d = v.col, double_of(v)
            return (
                F.when(t["dt"] == XSD + "boolean", F.coalesce(t["lex"].isin("true", "1"), F.lit(False)))
                .when(is_number(t), F.coalesce((d != 0) & ~F.isnan(d), F.lit(False)))
                .when((t["kind"] == LITERAL) & t["dt"].isNull(), F.length(t["lex"]) > 0)
            )
    return F.lit(None).cast("boolean")


def truth_value(v: Value) -> Column:
    """A boolean as a column, for comparisons."""
    if v.kind == "boolean":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"] == XSD + "boolean", F.when(v.col["lex"].isin("true", "1"), True).when(v.col["lex"].isin("false", "0"), False))
    return F.lit(None).cast("boolean")


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def compare(op: str, a: Value, b: Value) -> Column:
    """``=``, ``!=``, ``<``, ``>``, ``<=`` and ``>=`` by value with numeric promotion; NULL is an error."""
    a, b = a.native or a, b.native or b
    if a.kind in RANKS and b.kind in RANKS:
        return _ordered(op, a.col, b.col)
    if a.kind == b.kind and a.kind in ("string", "boolean", "dateTime", "date"):
        return _ordered(op, a.col, b.col)
    if {a.kind, b.kind} == {"date", "dateTime"}:
        return _ordered(op, instant(a), instant(b))
    if a.kind in ("iri", "key") and b.kind in ("iri", "key"):
        if op not in ("=", "!="):
            return F.lit(None).cast("boolean")
        return _ordered(op, a.col, b.col) if a.kind == b.kind == "key" and a.template == b.template else _ordered(op, text(a), text(b))
    if a.number and b.kind in RANKS or b.number and a.kind in RANKS or a.number and b.number:
        return _ordered(op, double_of(a), double_of(b))
    x, y = as_term(a), as_term(b)
    p, q, times = double_of(a), double_of(b), (instant(a), instant(b))
    yes, no = truth_value(a), truth_value(b)
    out = F.when(p.isNotNull() & q.isNotNull(), _ordered(op, p, q)).when(is_plain(x) & is_plain(y), _ordered(op, x["lex"], y["lex"]))
    out = out.when(yes.isNotNull() & no.isNotNull(), _ordered(op, yes, no)).when(times[0].isNotNull() & times[1].isNotNull(), _ordered(op, *times))
    if op in ("=", "!="):
        same = (x["kind"] == y["kind"]) & (x["lex"] == y["lex"]) & F.lower(x["lang"]).eqNullSafe(F.lower(y["lang"])) & x["dt"].eqNullSafe(y["dt"])
        told = (x["kind"] != LITERAL) | (y["kind"] != LITERAL) | (x["lang"].isNotNull() & y["lang"].isNotNull())
        out = out.when(x.isNull() | y.isNull(), None).when(same, op == "=").when(told, op != "=")
    return out


def same_term(a: Value, b: Value) -> Column:
    if a.kind == b.kind and a.kind != "term" and a.template == b.template:
        return a.col == b.col
    x, y = as_term(a), as_term(b)
    return F.when(x.isNotNull() & y.isNotNull(), (x["kind"] == y["kind"]) & (x["lex"] == y["lex"]) & F.lower(x["lang"]).eqNullSafe(F.lower(y["lang"])) & x["dt"].eqNullSafe(y["dt"]))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """``+ - * /`` with promotion; a whole division gives a decimal; overflow and division by zero are errors."""
    a, b = a.native or a, b.native or b
    run = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    if a.kind in RANKS and b.kind in RANKS:
        rank = max(RANKS[a.kind], RANKS[b.kind])
        if rank == 3:
            return Value("double", run(a.col.cast("double"), b.col.cast("double")))
        if rank == 1 and op != "/":
            return Value("integer", run(a.col.cast("bigint"), b.col.cast("bigint")))
        narrow = "decimal(20,10)" if op == "/" else DECIMAL
        return Value("decimal", run(a.col.try_cast(narrow), b.col.try_cast(narrow)).try_cast(DECIMAL))
    narrow = "decimal(20,10)" if op == "/" else DECIMAL
    rank = F.when(rank_of(a).isNotNull() & rank_of(b).isNotNull(), F.greatest(rank_of(a), rank_of(b), F.lit(2 if op == "/" else 1)))
    return number_term(rank, run(decimal_of(a).try_cast(narrow), decimal_of(b).try_cast(narrow)).try_cast(DECIMAL), run(double_of(a), double_of(b)))


def sort_columns(v: Value) -> list[Column]:
    """Columns that order cells: unbound, blank nodes, IRIs, then literals by value."""
    if v.kind != "term":
        return [v.col]
    return [v.col["kind"], double_of(v), instant(v), v.col["lex"], v.col["lang"], v.col["dt"]]


def unify(a: Value, b: Value) -> tuple[Value, Value]:
    """Both cells in one representation."""
    if a.kind == b.kind and a.template == b.template:
        return a, b
    if {a.kind, b.kind} <= {"iri", "key"}:
        return Value("iri", text(a)), Value("iri", text(b))
    return Value("term", as_term(a)), Value("term", as_term(b))
