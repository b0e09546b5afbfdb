"""Built-in functions and casts over typed cells. An argument of a wrong type gives NULL, an error."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from urllib.parse import urljoin

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import RDF, USER_AGGREGATES, XSD
from .values import BLANK, DECIMAL, DOUBLES, INTEGERS, IRI, LITERAL, NUMERIC, RANKS, Value, as_term, compare, decimal_of, double_of, double_text, instant, is_number, is_plain, lit_null, number_term, rank_of, same_term, term, text, truth, truth_value, utc

BUILTINS: dict[str, Callable[..., Value]] = {}
EXTENSIONS: dict[str, Callable[..., Value]] = {}
AGGREGATES: dict[str, tuple[Callable[..., Column], str]] = {}
#: Seconds from 1970 that a timestamp holds, about.
MAX_SECONDS = 9_000_000_000_000


def builtin(*names: str):
    def put(f):
        for n in names:
            BUILTINS[n] = f
        return f

    return put


def register(iri: str, function: Callable[..., Column], kind: str = "string") -> None:
    """An extension function: called with the lexical forms of its arguments, gives a column of ``kind``."""
    EXTENSIONS[iri] = lambda *args: Value(kind, function(*map(text, args)))


def register_aggregate(iri: str, function: Callable[..., Column], kind: str = "string") -> None:
    """A user's aggregate: called with columns of the lexical forms of its arguments, gives an aggregate column of ``kind``."""
    USER_AGGREGATES.add(iri)
    AGGREGATES[iri] = (function, kind)


def string(v: Value) -> Column:
    """The text of a string literal, with or without a language; NULL for any other cell."""
    if v.kind == "string":
        return v.col
    if v.kind == "term":
        return F.when((v.col["kind"] == LITERAL) & v.col["dt"].isNull(), v.col["lex"])
    return lit_null()


def like(v: Value, lex: Column) -> Value:
    """A string with the language of ``v``."""
    if v.kind == "term":
        return Value("term", term(LITERAL, lex, v.col["lang"]))
    return Value("string", lex)


def language(v: Value) -> Column:
    return v.col["lang"] if v.kind == "term" else lit_null()


def agreeing(a: Value, b: Value) -> Column:
    """Whether ``b`` may be searched for in ``a``: it has no language, or the same."""
    if a.kind != "term" and b.kind != "term":
        return F.lit(True)
    return language(b).isNull() | F.lower(language(a)).eqNullSafe(F.lower(language(b)))


for _name, _method in (("CONTAINS", "contains"), ("STRSTARTS", "startswith"), ("STRENDS", "endswith")):
    BUILTINS[_name] = lambda a, b, m=_method: Value("boolean", F.when(agreeing(a, b), getattr(string(a), m)(string(b))))
for _name, _function in (("UCASE", F.upper), ("LCASE", F.lower)):
    BUILTINS[_name] = lambda a, f=_function: like(a, f(string(a)))
for _name, _function in (("MD5", F.md5), ("SHA1", F.sha1), ("SHA224", lambda c: F.sha2(c, 224)), ("SHA256", lambda c: F.sha2(c, 256)), ("SHA384", lambda c: F.sha2(c, 384)), ("SHA512", lambda c: F.sha2(c, 512))):
    BUILTINS[_name] = lambda a, f=_function: Value("string", f(string(a).cast("binary")))
for _name, _part in (("YEAR", 1), ("MONTH", 2), ("DAY", 3), ("HOURS", 4), ("MINUTES", 5)):
    BUILTINS[_name] = lambda a, n=_part: Value("integer", _date_part(a, n))
_DATE = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _date_part(v: Value, n: int) -> Column:
    """A part of a dateTime or date as it is written."""
    if v.kind in ("dateTime", "date"):
        return (F.year, F.month, F.dayofmonth, F.hour, F.minute)[n - 1](utc(v.col) if v.kind == "dateTime" else v.col).cast("bigint")
    if v.kind != "term":
        return F.lit(None).cast("bigint")
    return F.when(v.col["dt"].isin(XSD + "dateTime", XSD + "date"), F.regexp_extract(v.col["lex"], _DATE, n).try_cast("bigint"))


@builtin("SECONDS")
def seconds(a):
    if a.kind == "dateTime":
        return Value("decimal", F.date_part(F.lit("SECOND"), a.col).cast(DECIMAL))
    if a.kind != "term":
        return Value("decimal", F.lit(None).cast(DECIMAL))
    return Value("decimal", F.when(a.col["dt"] == XSD + "dateTime", F.regexp_extract(a.col["lex"], _DATE, 6).try_cast(DECIMAL)))


def _zone(a: Value) -> Column:
    if a.kind == "dateTime":
        return F.when(a.col.isNotNull(), "Z")
    return F.when(a.col["dt"] == XSD + "dateTime", F.regexp_extract(a.col["lex"], _DATE, 7)) if a.kind == "term" else lit_null()


@builtin("TZ")
def tz(a):
    return Value("string", _zone(a))


@builtin("TIMEZONE")
def timezone(a):
    z = _zone(a)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    parts = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    lex = F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").when(z != "", parts)
    return Value("term", term(LITERAL, lex, None, F.lit(XSD + "dayTimeDuration")))


@builtin("NOW")
def now():
    return Value("dateTime", F.current_timestamp())


@builtin("TO_UNIXTIME")
def to_unixtime(a):
    return Value("integer", F.unix_seconds(instant(a)))


@builtin("FROM_UNIXTIME")
def from_unixtime(a):
    seconds = double_of(a).try_cast("bigint")
    return Value("dateTime", F.timestamp_seconds(F.when(F.abs(seconds) < MAX_SECONDS, seconds)))


@builtin("STR")
def str_(a):
    return Value("string", F.when(as_term(a)["kind"] != BLANK, text(a)) if a.kind == "term" else text(a))


@builtin("LANG")
def lang(a):
    if a.kind == "term":
        return Value("string", F.when(a.col["kind"] == LITERAL, F.coalesce(a.col["lang"], F.lit(""))))
    return Value("string", lit_null() if a.kind in ("iri", "key") else F.when(a.col.isNotNull(), ""))


@builtin("LANGMATCHES")
def langmatches(a, b):
    tag, wanted = F.lower(string(a)), F.lower(string(b))
    return Value("boolean", F.when(wanted == "*", F.length(tag) > 0).otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))


@builtin("DATATYPE")
def datatype(a):
    if a.kind == "term":
        return Value("iri", F.when(a.col["kind"] == LITERAL, F.coalesce(a.col["dt"], F.when(a.col["lang"].isNotNull(), RDF + "langString").otherwise(XSD + "string"))))
    return Value("iri", lit_null() if a.kind in ("iri", "key") else F.when(a.col.isNotNull(), XSD + a.kind))


def _is(kind: int):
    def test(a):
        if a.kind == "term":
            return Value("boolean", a.col["kind"] == kind)
        own = IRI if a.kind in ("iri", "key") else LITERAL
        return Value("boolean", F.when(a.col.isNotNull(), own == kind))

    return test


BUILTINS |= {"ISIRI": _is(IRI), "ISBLANK": _is(BLANK), "ISLITERAL": _is(LITERAL)}


@builtin("ISNUMERIC")
def isnumeric(a):
    if a.kind == "term":
        return Value("boolean", F.when(a.col.isNotNull(), is_number(a.col) & double_of(a).isNotNull()))
    return Value("boolean", F.when(a.col.isNotNull(), a.kind in RANKS))


@builtin("SAMETERM")
def sameterm(a, b):
    return Value("boolean", same_term(a, b))


@builtin("IRI")
def iri(a, base: str | None = None):
    lex = text(a) if a.kind in ("iri", "key", "string") else F.when((a.col["kind"] == IRI) | is_plain(a.col), a.col["lex"]) if a.kind == "term" else lit_null()
    if base is None:
        return Value("iri", lex)
    folder, host, bare = urljoin(base, "."), urljoin(base, "/"), base.split("#")[0]
    out = F.when(lex.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), lex).when(lex == "", F.lit(bare)).when(lex.startswith("#"), F.concat(F.lit(bare), lex)).when(lex.startswith("?"), F.concat(F.lit(bare.split("?")[0]), lex))
    out = out.when(lex.startswith("//"), F.concat(F.lit(host.split(":")[0] + ":"), lex)).when(lex.startswith("/"), F.concat(F.lit(host.rstrip("/")), _without_dots(lex)))
    return Value("iri", out.otherwise(F.concat(F.lit(host.rstrip("/")), _without_dots(F.concat(F.lit("/" + folder.removeprefix(host)), lex)))))


def _without_dots(path: Column) -> Column:
    """A path from the root, with its query and fragment, without the segments ``.`` and ``..``."""
    own = F.regexp_extract(path, r"^([^?#]*)", 1)
    steps = F.split(F.regexp_replace(own, r"/(\.\.?)$", "/$1/"), "/")
    add = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.array(F.lit("")), add)
    return F.concat(F.array_join(kept, "/"), F.regexp_extract(path, r"^[^?#]*(.*)$", 1))


@builtin("BNODE")
def bnode(a=None):
    lex = F.concat(F.lit("b"), F.regexp_replace(F.uuid(), "-", "")) if a is None else F.concat(F.lit("b"), F.md5(string(a).cast("binary")))
    return Value("term", term(BLANK, lex))


@builtin("STRDT")
def strdt(a, dt):
    d = text(dt)
    return Value("term", term(LITERAL, F.when(d.isNotNull(), _plain(a)), None, F.nullif(d, F.lit(XSD + "string"))))


@builtin("STRLANG")
def strlang(a, tag):
    t = string(tag)
    return Value("term", term(LITERAL, F.when(F.length(t) > 0, _plain(a)), t))


def _plain(a: Value) -> Column:
    if a.kind == "term":
        return F.when(is_plain(a.col), a.col["lex"])
    return a.col if a.kind == "string" else lit_null()


@builtin("STRLEN")
def strlen(a):
    return Value("integer", F.length(string(a)).cast("bigint"))


@builtin("SUBSTR")
def substr(a, start, size=None):
    first = _place(start)
    end = first + _place(size) if size is not None else None
    at = F.greatest(first, F.lit(1).cast("bigint"))
    count = F.length(string(a)) if end is None else F.least(F.greatest(end - at, F.lit(0)), F.length(string(a)))
    return like(a, F.when(first.isNotNull(), F.substring(string(a), at.cast("int"), count.cast("int"))))


def _place(v: Value) -> Column:
    """A number rounded to a place in a text; no number at all and what is too large are the place after any text."""
    last = float((1 << 31) - 1)
    return F.when(double_of(v).isNotNull(), F.greatest(F.least(F.floor(F.least(F.greatest(double_of(v), F.lit(-last)), F.lit(last)) + 0.5), F.lit(int(last))), F.lit(-int(last)))).cast("bigint")


@builtin("STRBEFORE")
def strbefore(a, b):
    s, part = string(a), string(b)
    at = F.instr(s, part)
    return _cut(a, b, at, F.substring(s, F.lit(1), at - 1))


@builtin("STRAFTER")
def strafter(a, b):
    s, part = string(a), string(b)
    at = F.instr(s, part)
    return _cut(a, b, at, F.substring(s, at + F.length(part), F.length(s)))


def _cut(a, b, at, piece):
    if a.kind != "term":
        return Value("string", F.when(agreeing(a, b), F.when(at > 0, piece).when(at == 0, "")))
    lex = F.when(agreeing(a, b), F.when(at > 0, piece).when(at == 0, ""))
    return Value("term", term(LITERAL, lex, F.when(at > 0, a.col["lang"])))


@builtin("CONCAT")
def concat(*args):
    if not args:
        return Value("string", F.lit(""))
    lex = F.concat(*map(string, args))
    if all(a.kind != "term" for a in args):
        return Value("string", lex)
    tags = [F.lower(language(a)) for a in args]
    same = tags[0].isNotNull()
    for t in tags[1:]:
        same = same & F.coalesce(t == tags[0], F.lit(False))
    return Value("term", term(LITERAL, lex, F.when(same, language(args[0]))))


@builtin("ENCODE_FOR_URI")
def encode_for_uri(a):
    coded = F.url_encode(string(a))
    return Value("string", F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def _pattern(p: Value, flags: Value | None) -> Column:
    """A Java pattern with its flags; ``q`` quotes the pattern, other letters than i, s, m, x and q are an error."""
    pattern = string(p)
    if flags is None:
        return pattern
    f = string(flags)
    quoted = F.when(f.contains("q"), F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))).otherwise(pattern)
    kept = F.translate(f, "q", "")
    return F.when(f == "", pattern).when(f.rlike("^[ismxq]+$"), F.when(kept == "", quoted).otherwise(F.concat(F.lit("(?"), kept, F.lit(")"), quoted)))


def _compiles(pattern: Column) -> Column:
    """The pattern where it is one, else NULL."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


@lru_cache(maxsize=1000)
def _is_pattern(pattern: str, flags: str | None) -> bool:
    """Whether Spark's expressions take a constant pattern; asked once, so that plans of such patterns stay deterministic."""
    spark = SparkSession.active()
    made = _pattern(Value("string", F.lit(pattern)), None if flags is None else Value("string", F.lit(flags)))
    return bool(spark.range(1).select(_compiles(made).alias("ok")).first()["ok"])


def _when_pattern(p: Value, flags: Value | None, made) -> Column:
    """``made(pattern)``, NULL where the pattern or its flags are wrong."""
    pattern = _pattern(p, flags)
    if p.const is not None and (flags is None or flags.const is not None):
        return made(pattern) if _is_pattern(p.const, flags and flags.const) else F.when(F.lit(False), made(F.lit("")))
    return F.when(_compiles(pattern), made(pattern))


@builtin("REGEX")
def regex(a, p, flags=None):
    return Value("boolean", _when_pattern(p, flags, lambda pattern: F.rlike(string(a), pattern)))


@builtin("REPLACE")
def replace(a, p, r, flags=None):
    """A replacement that names a group which the pattern lacks, or is of another form than XPath's, is an error."""
    new = string(r)
    bare = F.regexp_replace(string(p), r"\\.|\[(?:\\.|[^\]\\])*\]", "")
    groups = F.regexp_count(bare, F.lit(r"\((?!\?)|\(\?<(?![=!])"))
    named = F.transform(F.regexp_extract_all(F.regexp_replace(new, r"\\.", ""), F.lit(r"\$(\d)"), F.lit(1)), lambda x: x.cast("int"))
    fits = F.rlike(new, F.lit(r"(?s)^(?:[^\\$]|\\[\\$]|\$\d)*$")) & (F.coalesce(F.array_max(named), F.lit(0)) <= groups)
    return like(a, F.when(fits, _when_pattern(p, flags, lambda pattern: F.regexp_replace(string(a), pattern, F.when(fits, new).otherwise("")))))


def _numeric(decimal: Callable, double: Callable):
    def run(a):
        a = a.native or a
        if a.kind == "integer":
            return a if decimal is not F.abs else Value("integer", F.abs(a.col))
        if a.kind == "decimal":
            return Value("decimal", decimal(a.col).cast(DECIMAL))
        if a.kind == "double":
            return Value("double", double(a.col).cast("double"))
        return number_term(rank_of(a), decimal(decimal_of(a)).cast(DECIMAL), double(double_of(a)).cast("double"))

    return run


def _half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5).cast("decimal(2,1)"))


def _whole(f: Callable) -> Callable:
    """``f`` of a double. From 2 ** 53 on every double is whole; those, INF and NaN stay as they are."""
    return lambda c: F.when(F.isnan(c) | (F.abs(c) >= float(1 << 53)), c).otherwise(f(c).cast("double"))


BUILTINS |= {"ABS": _numeric(F.abs, F.abs), "CEIL": _numeric(F.ceil, _whole(F.ceil)), "FLOOR": _numeric(F.floor, _whole(F.floor)), "ROUND": _numeric(_half_up, _whole(lambda c: F.floor(c + 0.5)))}
BUILTINS |= {"UUID": lambda: Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid())), "STRUUID": lambda: Value("string", F.uuid())}


def choose(condition: Column, yes: Value, no: Value) -> Value:
    """``yes`` where the condition holds, ``no`` where it does not, NULL where it is an error."""
    if yes.kind == no.kind and yes.template == no.template:
        return Value(yes.kind, F.when(condition, yes.col).when(~condition, no.col), yes.template)
    if yes.kind in RANKS and no.kind in RANKS:
        return Value("term", F.when(condition, as_term(yes)).when(~condition, as_term(no)), number=True)
    return Value("term", F.when(condition, as_term(yes)).when(~condition, as_term(no)))


@builtin("IF")
def if_(c, yes, no):
    return choose(truth(c), yes, no)


@builtin("COALESCE")
def coalesce(*args):
    if not args:
        return Value("term", term(LITERAL, lit_null()))
    if len({(a.kind, a.template) for a in args}) == 1:
        return Value(args[0].kind, F.coalesce(*[a.col for a in args]), args[0].template)
    return Value("term", F.coalesce(*map(as_term, args)), number=all(a.kind in RANKS or a.number for a in args))


#: The lexical form that a cast to each type accepts.
_FORMS = {
    "integer": r"^\s*[+-]?\d+\s*$",
    "decimal": r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$",
    "double": r"^\s*([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)\s*$",
    "boolean": r"^\s*(true|false|0|1)\s*$",
    "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
    "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$",
}


def cast(iri: str, a: Value) -> Value | None:
    """``xsd:T(x)``; None if the IRI names no type that can be cast to."""
    name = iri.removeprefix(XSD)
    if iri == XSD + "string":
        return Value("string", F.when(as_term(a)["kind"] != BLANK, text(a)) if a.kind == "term" else text(a))
    family = "integer" if iri in INTEGERS else "double" if iri in DOUBLES else name
    if family not in _FORMS:
        return None
    if a.kind in ("iri", "key"):
        return Value("term", term(LITERAL, lit_null()))
    lex, dt = text(a), as_term(a)["dt"]
    literal = as_term(a)["kind"] == LITERAL
    fits = F.when(literal & lex.rlike(_FORMS[family]), F.trim(lex))
    number, flag = double_of(a), truth_value(a)
    if family == "boolean":
        return Value("boolean", F.when(number.isNotNull() & ~F.isnan(number), number != 0).when(number.isNotNull(), False).otherwise(F.when(fits.isin("true", "1"), True).when(fits.isin("false", "0"), False)))
    as_number = F.when(flag.isNotNull(), F.when(flag, 1.0).otherwise(0.0)).otherwise(number)
    if family == "integer":
        exact = F.when(as_number.isNotNull(), F.coalesce(lex.try_cast("bigint") if a.kind == "term" else F.lit(None).cast("bigint"), F.when(~F.isnan(as_number) & (F.abs(as_number) < 9e18), as_number.cast("bigint"))))
        value = F.when(as_number.isNotNull(), exact).otherwise(F.when(dt.isNull(), fits.try_cast("bigint")))
        return Value("integer", value) if iri == XSD + "integer" else Value("term", term(LITERAL, value.cast("string"), None, F.lit(iri)), number=True)
    if family == "decimal":
        return Value("decimal", F.coalesce(decimal_of(a), as_number.try_cast(DECIMAL), F.when(dt.isNull(), fits.try_cast(DECIMAL))))
    if family == "double":
        plain = F.regexp_replace(fits, "^([+-]?)INF$", "$1Infinity").try_cast("double")
        made = F.coalesce(as_number, F.when(dt.isNull(), plain))
        if iri == XSD + "float":
            return Value("term", term(LITERAL, double_text(made.cast("float")), None, F.lit(iri)), number=True)
        return Value("double", made)
    if a.kind == family:
        return a
    if a.kind == "dateTime":
        return Value("date", utc(a.col).cast("date"))
    if a.kind == "date":
        return Value("dateTime", instant(a))
    same = dt.isNull() | (dt == iri)
    lexical = F.when(same, fits)
    if family == "date":
        lexical = F.coalesce(lexical, F.when(dt == XSD + "dateTime", F.regexp_replace(lex, r"T\d\d:\d\d:\d\d(\.\d+)?", "")))
    else:
        lexical = F.coalesce(lexical, F.when(dt == XSD + "date", F.regexp_replace(lex, r"^(-?\d{4,}-\d\d-\d\d)", "$1T00:00:00")))
    return Value("term", term(LITERAL, lexical, None, F.lit(iri)))


__all__ = ["AGGREGATES", "BUILTINS", "EXTENSIONS", "NUMERIC", "cast", "choose", "compare", "register", "register_aggregate"]
