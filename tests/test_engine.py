"""Term mode: RDF data, SPARQL semantics of errors and unbound values, formats, updates, services and streams."""

import json

import pytest

from quadrille.__main__ import main
from quadrille.compare import compare, isomorphic
from quadrille.engine import Engine, list_formats, list_languages
from quadrille.functions.library import register
from quadrille.operators.compiler import CompileError
from quadrille.plans.algebra import XSD, BNode, Iri, Lit
from quadrille.service import ServiceClient
from quadrille.sources import formats
from quadrille.sources.quads import QuadsFrame, from_triples, parse_turtle
from quadrille.streaming import stream

DATA = """@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p 1 ; :q "x"@en ; :d "2019-08-21T07:31:44.625+03:30"^^xsd:dateTime .
:b :p 2.5 ; :q "y" ; :d "2020-03-05T10:11:12Z"^^xsd:dateTime .
:c :p 1e1 ; :q "01"^^xsd:integer .
:d :p "z"^^:mine ; :q "z"^^:mine .
:e :p "1"^^xsd:byte ; :r [ :s (1 2) ] .
:f :p -3 ; :q "abc" , "ABC"@fr .
"""
P = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, QuadsFrame(from_triples(spark, [(None, t) for t in parse_turtle(DATA)])), warn=False)


def ask(engine, text):
    return sorted(str(tuple(r)) for r in engine.prepare(P + text).dataframe().collect())


CASES = [
    ("SELECT ?x { ?x :p ?v FILTER(?v = 1) }", ["('http://e/a',)", "('http://e/e',)"]),
    ("SELECT ?x { ?x :p 1 }", ["('http://e/a',)"]),
    ("SELECT ?x { ?x :p ?v FILTER(?v > 2) }", ["('http://e/b',)", "('http://e/c',)"]),
    ("SELECT ?x { ?x :p ?v FILTER(?v != 1) }", ["('http://e/b',)", "('http://e/c',)", "('http://e/f',)"]),
    ("SELECT ?x { ?x :p ?v FILTER(!BOUND(?nothing) && isNUMERIC(?v)) }", ["('http://e/a',)", "('http://e/b',)", "('http://e/c',)", "('http://e/e',)", "('http://e/f',)"]),
    ("SELECT ?x { ?x :p ?v ; :q ?v }", ["('http://e/d',)"]),
    ("SELECT (?v + 1 AS ?w) (DATATYPE(?v / 2) AS ?t) { :a :p ?v }", [f"('2', '{XSD}decimal')"]),
    ("SELECT (?v + 1 AS ?w) { :b :p ?v }", ["('3.5',)"]),
    ("SELECT (DATATYPE(?v * 2) AS ?t) { :c :p ?v }", [f"('{XSD}double',)"]),
    ("SELECT (?v + 1 AS ?w) { :d :p ?v }", ["(None,)"]),
    ("SELECT (COALESCE(?v + 1, 'bad') AS ?w) { :d :p ?v }", ["('bad',)"]),
    ("SELECT (SUM(?v) AS ?s) (COUNT(?v) AS ?n) { ?x :p ?v FILTER(isNUMERIC(?v)) }", ["('11.5', 5)"]),
    ("SELECT (SUM(?v) AS ?s) { ?x :p ?v }", ["(None,)"]),
    ("SELECT (AVG(?v) AS ?s) { VALUES ?v { 1 2 } }", ["(Decimal('1.5000000000'),)"]),
    ("SELECT (MIN(?v) AS ?a) (MAX(?v) AS ?b) { ?x :p ?v FILTER(isNUMERIC(?v)) }", ["('-3', '1e1')"]),
    ("SELECT (LANG(?q) AS ?l) (UCASE(?q) AS ?u) { :a :q ?q }", ["('en', 'X')"]),
    ("SELECT (YEAR(?d) AS ?y) (HOURS(?d) AS ?h) (TZ(?d) AS ?z) (STR(TIMEZONE(?d)) AS ?t) (STR(SECONDS(?d)) AS ?s) { :a :d ?d }", ["(2019, 7, '+03:30', 'PT3H30M', '44.625')"]),
    ("SELECT ?x { ?x :d ?d FILTER(?d < '2019-08-21T04:30:00Z'^^xsd:dateTime) }", ["('http://e/a',)"]),
    ("SELECT ?q { :f :q ?q FILTER(LANGMATCHES(LANG(?q), '*')) }", ["('ABC',)"]),
    ("SELECT (STRBEFORE(?q, 'C'@fr) AS ?b) { :f :q ?q }", ["('AB',)", "(None,)"]),
    ("SELECT (CONCAT(?q, ?q) AS ?c) (LANG(CONCAT(?q, ?q)) AS ?l) { :a :q ?q }", ["('xx', 'en')"]),
    ("SELECT ?i { ?x :r ?b . ?b :s ?l . ?l <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> ?m . ?m <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> ?i }", ["('2',)"]),
    ("SELECT ?i { ?x :r [ :s ( ?i 2 ) ] }", ["('1',)"]),
    ("SELECT (xsd:integer(?v) AS ?i) (xsd:double('x') AS ?j) (xsd:boolean('1') AS ?k) { :b :p ?v }", ["(2, None, True)"]),
    ("SELECT (IF(?v > 0, 'pos', 'neg') AS ?s) { ?x :p ?v FILTER(?v < 1 || ?v > 9) }", ["('neg',)", "('pos',)"]),
    ("SELECT ?x ?q { ?x :p ?v OPTIONAL { ?x :q ?q FILTER(?v < 0) } FILTER(isNUMERIC(?v) && ?v < 1.5) }", ["('http://e/a', None)", "('http://e/e', None)", "('http://e/f', 'ABC')", "('http://e/f', 'abc')"]),
    ("SELECT ?x { ?x :p ?v MINUS { ?x :q ?w } }", ["('http://e/e',)"]),
    ("SELECT ?x { ?x :p ?v OPTIONAL { ?x :d ?d } MINUS { ?y :d ?d } }", ["('http://e/c',)", "('http://e/d',)", "('http://e/e',)", "('http://e/f',)"]),
    ("SELECT ?x { ?x :p ?v FILTER NOT EXISTS { ?x :q ?w FILTER(?w = ?v) } FILTER(?v > 2) }", ["('http://e/b',)", "('http://e/c',)"]),
    ("SELECT ?v ?w { VALUES (?v ?w) { (1 UNDEF) (UNDEF 2) } VALUES (?v ?w) { (1 5) (7 2) } }", ["(1, 5)", "(7, 2)"]),
    ("SELECT ?v { ?x :p ?v FILTER(isNUMERIC(?v)) } ORDER BY DESC(?v) LIMIT 2", ["('1e1',)", "('2.5',)"]),
    ("SELECT (GROUP_CONCAT(?q; SEPARATOR='+') AS ?g) { :f :q ?q }", ["('ABC+abc',)"]),
    ("SELECT ?x { ?x :p ?v FILTER(sameTerm(?v, 1)) }", ["('http://e/a',)"]),
    ("SELECT (REPLACE('abcb', 'B', 'z', 'i') AS ?r) (SUBSTR('hello', 0, 3) AS ?s) (ENCODE_FOR_URI('a b*~') AS ?e) {}", ["('azcz', 'he', 'a%20b%2A~')"]),
    ("SELECT (STR(IRI('x')) AS ?i) {}", ["('http://base/d/x',)"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_semantics(engine, text, want):
    base = "BASE <http://base/d/e> " if "IRI('x')" in text else ""
    assert ask(engine, base + text if not base else text) == want if not base else sorted(str(tuple(r)) for r in engine.prepare(base + P + text).dataframe().collect()) == want


def test_construct_describe_ask(engine):
    got = engine.prepare(P + "CONSTRUCT { ?x :twice _:b . _:b :v ?v . ?v :bad ?x } WHERE { ?x :p ?v FILTER(?v > 2) }").graph().collect()
    assert len(got) == 4 and len({r.s.lex for r in got if r.s.kind == 1}) == 2
    assert engine.query(P + "ASK { :a :p 1 }") is True and engine.query(P + "ASK { :a :p 9 }") is False
    assert engine.prepare(P + "DESCRIBE :e").graph().count() == 7


def test_bindings_limits_unknown_functions(engine, spark):
    assert engine.prepare(P + "SELECT ?x { ?x :p ?v FILTER(?v = ?wanted) }").dataframe({"wanted": Lit("1", None, XSD + "integer")}).count() == 2
    assert engine.prepare(P + "SELECT ?x { ?x :p ?v }").sliced(2, 1).dataframe().count() == 2
    with pytest.raises(CompileError):
        engine.prepare(P + "SELECT (:f(1) AS ?x) {}").dataframe()
    assert Engine(spark, engine.source, unknown_functions_false=True, warn=False).prepare(P + "SELECT (:f(1) AS ?x) {}").dataframe().first().x is False
    from pyspark.sql import functions as F

    register("http://e/rev", F.reverse)
    assert engine.prepare(P + "SELECT (:rev('abc') AS ?x) {}").dataframe().first().x == "cba"
    with pytest.warns(UserWarning):
        Engine(spark).prepare("SELECT ?z { ?x ?p ?v }")
    assert "srj" in list_formats()["read"] and "sparql10" in list_languages()


def test_formats_round_trip():
    names = ("a", "b")
    rows = [[Iri("http://e/x"), Lit("q\"\t\n'é", "en")], [BNode("n"), None], [Lit("5", None, XSD + "integer"), Lit("1.5", None, XSD + "decimal")]]
    for f in ("xml", "srj", "json", "tsv", "turtle"):
        got = formats.read(formats.write_bindings(names, rows, f), f)
        assert compare((names, rows), got) == [], f
    assert formats.read(formats.write_bindings(names, rows, "csv"), "csv")[1][0][0] == Iri("http://e/x")
    for f in ("html", "table", "rdfxml", "ntriples"):
        assert "http://e/x" in formats.write_bindings(names, rows, f)
    for f in ("xml", "srj", "csv", "tsv", "turtle"):
        assert formats.read(formats.write_boolean(True, f), f) is True
    assert [formats.guess("x.srx"), formats.guess(mime="text/csv; charset=x"), formats.guess(content="{}"), formats.guess("none")] == ["xml", "csv", "srj", None]


def test_compare():
    a = (("x",), [[BNode("1")], [BNode("2")]])
    assert compare(a, (("x",), [[BNode("9")], [BNode("8")]])) == [] and compare(a, (("x",), [[BNode("9")], [BNode("9")]]))
    assert compare((("x",), [[Lit("1")], [Lit("2")]]), (("x",), [[Lit("2")], [Lit("1")]])) == [] and compare((("x",), [[Lit("1")], [Lit("2")]]), (("x",), [[Lit("2")], [Lit("1")]]), ordered=True)
    p = Iri("p")
    assert isomorphic([(BNode("a"), p, BNode("b"))], [(BNode("x"), p, BNode("y"))]) and not isomorphic([(BNode("a"), p, BNode("a"))], [(BNode("x"), p, BNode("y"))])


def test_updates(spark):
    e = Engine(spark, warn=False)
    e.update("INSERT DATA { <a> <p> 1 . <b> <p> 2 . GRAPH <g> { <a> <p> 3 } }")
    e.update("DELETE { ?s <p> ?o } INSERT { ?s <q> ?o . GRAPH <h> { ?s <p> ?o } } WHERE { ?s <p> ?o FILTER(?o > 1) }")
    count = lambda text: e.prepare(text).dataframe().count()
    assert count("SELECT * { ?s <p> ?o }") == 1 and count("SELECT * { ?s <q> ?o }") == 1 and count("SELECT * { GRAPH <h> { ?s ?p ?o } }") == 1
    e.update("COPY <g> TO <k>; MOVE <h> TO DEFAULT; DELETE DATA { <a> <p> 1 }; DROP GRAPH <g>")
    assert count("SELECT * { GRAPH ?g { ?s ?p ?o } }") == 1 and count("SELECT * { ?s <p> 2 }") == 1 and count("SELECT * { ?s ?p ?o }") == 1
    e.update("DELETE WHERE { GRAPH ?g { ?s ?p ?o } }; CLEAR DEFAULT")
    assert e.source.quads.count() == 0


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.nt").write_text('<http://e/a> <http://e/p> "x\\ty"@en . # end\n\n_:b <http://e/p> <http://e/a> <http://e/g> .\n<http://e/a> <http://e/n> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .\n')
    (tmp_path / "d.ttl").write_text("@prefix : <http://e/> . :z :n 7 ; :l ( :a ) .")
    (tmp_path / "esc.nt").write_text(r'<http://e/w> <http://e/t> "caf\u00e9 \\t \"q\" it\'s\n" .' + "\n")
    esc = Engine(spark, warn=False)
    esc.load(str(tmp_path / "esc.nt"))
    assert esc.prepare(P + "SELECT ?t { :w :t ?t }").dataframe().first().t == "café \\t \"q\" it's\n"
    e = Engine(spark, warn=False)
    e.load(str(tmp_path / "d.nt"))
    e.load(str(tmp_path / "d.ttl"))
    assert ask(e, "SELECT ?x ?n { ?x :n ?n FILTER(?n > 4) }") == ["('http://e/a', '5')", "('http://e/z', '7')"]
    assert ask(e, "SELECT ?t { :a :p ?t }") == ["('x\\ty',)"] and ask(e, "SELECT ?o { GRAPH :g { ?s :p ?o } }") == ["('http://e/a',)"]
    assert json.loads(e.prepare(P + "SELECT ?n { :z :n ?n }").write("srj"))["results"]["bindings"][0]["n"]["value"] == "7"
    assert main(["-e", "SELECT ?x {", "-n"]) == 1 and main(["-e", "SELECT ?x { ?x ?p 1 }", "-n", "-d", "algebra"]) == 0
    (tmp_path / "r.srj").write_text('{"head": {"vars": ["x"]}, "results": {"bindings": [{"x": {"type": "uri", "value": "http://u"}}]}}')
    assert main(["-R", str(tmp_path / "r.srj"), "-r", "csv"]) == 0
    assert "http://u" in capsys.readouterr().out


def test_service(spark):
    seen = []

    def transport(url):
        seen.append(url)
        return "application/sparql-results+json", '{"head": {"vars": ["s", "n"]}, "results": {"bindings": [{"s": {"type": "uri", "value": "http://e/a"}, "n": {"type": "literal", "value": "one"}}]}}'

    e = Engine(spark, QuadsFrame(from_triples(spark, [(None, t) for t in parse_turtle(DATA)])), service=ServiceClient(transport), warn=False)
    assert ask(e, "SELECT ?s ?v ?n { ?s :p ?v SERVICE <http://x/> { ?s <http://n> ?n } }") == ["('http://e/a', '1', 'one')"]
    assert "query=SELECT" in seen[0]
    off = Engine(spark, e.source, service=ServiceClient(transport), network=False, warn=False)
    assert off.prepare(P + "SELECT ?s { ?s :p 1 SERVICE SILENT <http://x/> { ?s <http://n> ?n } }").dataframe().count() == 1


def test_stream(spark, tmp_path):
    quads = from_triples(spark, [(None, t) for t in parse_turtle(DATA)])
    quads.write.parquet(str(tmp_path / "in"))
    bindings = stream.continuous(spark, stream.read_quads(spark, str(tmp_path / "in")), P + "SELECT ?x ?d { ?x :d ?d FILTER(YEAR(?d) >= 2019) }")
    stream.start(bindings, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counts = stream.windowed_counts(bindings, "d", [], "1 day", "1 hour")
    assert counts.isStreaming and "window" in counts.columns


def test_times_do_not_depend_on_the_session_zone(spark, small):
    from quadrille.queries import QUERIES

    plain = [str(r) for r in ask(Engine(spark, QuadsFrame(from_triples(spark, []))), "SELECT (STR(FROM_UNIXTIME(0)) AS ?a) (HOURS(FROM_UNIXTIME(3600)) AS ?h) ('1970-01-01T00:00:00'^^xsd:dateTime = FROM_UNIXTIME(0) AS ?b) {}")]
    assert plain == ["('1970-01-01T00:00:00Z', 1, True)"]
    expected = sorted(QUERIES["date_parts"](spark, small).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert ask(Engine(spark, QuadsFrame(from_triples(spark, []))), "SELECT (STR(FROM_UNIXTIME(0)) AS ?a) (HOURS(FROM_UNIXTIME(3600)) AS ?h) ('1970-01-01T00:00:00'^^xsd:dateTime = FROM_UNIXTIME(0) AS ?b) {}") == plain
        assert sorted(QUERIES["date_parts"](spark, small).collect()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_graph_is_a_set(spark):
    e = Engine(spark, QuadsFrame(from_triples(spark, [])))
    for _ in range(2):
        e.update(P + "INSERT DATA { :a :p 1, 1 . GRAPH :g { :a :p 1 } }")
        e.add(from_triples(spark, [(None, t) for t in parse_turtle("@prefix : <http://e/> . :a :p 1 .")]))
    e.update(P + "ADD :g TO DEFAULT; COPY :g TO :h; INSERT { ?x :p ?y } WHERE { GRAPH :h { ?x :p ?y } }")
    assert ask(e, "SELECT ?x ?y { ?x :p ?y }") == ["('http://e/a', '1')"]


def test_exists_takes_outer_values_below_union(engine):
    text = "SELECT ?x { VALUES ?x { 1 2 } FILTER %s { { VALUES ?z { 1 } FILTER(?z = ?x) } UNION { VALUES ?z { 9 } FILTER(?z = ?x) } } }"
    assert ask(engine, text % "EXISTS") == ["(1,)"] and ask(engine, text % "NOT EXISTS") == ["(2,)"]


def test_reads_every_rdf_format(spark, tmp_path):
    """The same triples from each format, by ending and by content; 8-digit escapes too."""
    files = {
        "a.nt": '<http://e/a> <http://e/p> "\\U0001F600 \\u00e9 \\\'q\\\'" .\n<http://e/a> <http://e/q> <http://e/b> .\n',
        "a.ttl": "@prefix : <http://e/> . :a :p '😀 é \\'q\\'' ; :q :b .",
        "a.trig": "@prefix : <http://e/> . { :a :p '😀 é \\'q\\'' } :a :q :b .",
        "a.rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://e/"><rdf:Description rdf:about="http://e/a"><p>😀 é \'q\'</p><q rdf:resource="http://e/b"/></rdf:Description></rdf:RDF>',
        "xml": '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://e/"><rdf:Description rdf:about="http://e/a"><p>😀 é \'q\'</p><q rdf:resource="http://e/b"/></rdf:Description></rdf:RDF>',
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
        e = Engine(spark)
        e.load(str(tmp_path / name))
        assert ask(e, "SELECT ?p ?o { :a ?p ?o }") == ["('http://e/p', \"😀 é 'q'\")", "('http://e/q', 'http://e/b')"], name


def test_rdfxml_result_sets():
    rows = [[Iri("http://e/a"), Lit("x", "en")], [BNode("b"), None]]
    names, found = formats.read(formats.write_bindings(("s", "t"), rows, "rdfxml"), "rdfxml")
    assert sorted(names) == ["s", "t"] and [r[names.index("t")] for r in found if isinstance(r[names.index("s")], Iri)] == [Lit("x", "en")]
    assert formats.read(formats.write_boolean(True, "rdfxml"), "rdfxml") is True and formats.guess(content="a,b\n1,2\n") == "csv"


def test_command_line_updates(capsys):
    assert main(["-e", "PREFIX : <http://e/> INSERT DATA { :a :b 1, 1 }", "-r", "ntriples"]) == 0
    assert capsys.readouterr().out == f'<http://e/a> <http://e/b> "1"^^<{XSD}integer> .\n'


def test_user_aggregates(engine):
    from pyspark.sql import functions as F

    from quadrille.functions.library import register_aggregate

    register_aggregate("http://e/longest", lambda c: F.max_by(c, F.length(c)))
    assert ask(engine, "SELECT (:longest(?q) AS ?l) (COUNT(*) AS ?n) { ?x :q ?q FILTER(LANG(?q) != 'en' && STRLEN(STR(?q)) != 3) }") == ["('01', 3)"]


def test_iris_resolve_against_the_base(engine):
    from urllib.parse import urljoin

    base = "http://h.org/a/b/c?q#f"
    for rel in ("x", "./x", "../x", "../../x", "../../../x", "/x/../y", "x/./y/..", "?z", "#z", "", "//i.org/x", "mailto:a", "..", "x?y=../z"):
        got = ask(engine, f"BASE <{base}> SELECT (STR(IRI('{rel}')) AS ?i) {{}}")
        assert got == [str((urljoin(base, rel).split("#f")[0] if rel == "" else urljoin(base, rel),))], rel


def test_differences_and_limits(tmp_path, capsys):
    from quadrille.compare import CompareLimit, difference

    a, b = (("x", "y"), [[Lit("1"), None], [Iri("http://e/a"), BNode("b")]]), (("y", "x"), [[BNode("c"), Iri("http://e/a")], [None, Lit("1")]])
    assert difference(a, b) == "" and difference(True, True) == ""
    other = (("x", "y"), [[Lit("2"), None], [Iri("http://e/a"), Lit("q")]])
    assert '+"2"' in difference(a, other) and json.loads(difference(a, other, "json"))["equal"] is False and difference(a, other, "xml").startswith("<comparison")
    nodes = [(BNode(str(i)), Iri("p"), BNode(str((i + 1) % 40))) for i in range(40)]
    two = [(BNode(str(i)), Iri("p"), BNode(str(i // 20 * 20 + (i + 1) % 20))) for i in range(40)]
    with pytest.raises(CompareLimit):
        isomorphic(nodes, two, nodes_at_most=10)
    for name, rows in (("a.tsv", a), ("b.srj", b), ("c.csv", other)):
        (tmp_path / name).write_text(formats.write_bindings(*rows, name.rsplit(".")[-1]))
    assert main(["-R", str(tmp_path / "a.tsv"), "--compare", str(tmp_path / "b.srj")]) == 0
    assert main(["-R", str(tmp_path / "a.tsv"), "--compare", str(tmp_path / "c.csv"), "--diff", "json"]) == 1
    assert "differences" in capsys.readouterr().out


def test_sources_introspection_and_hooks(spark, engine):
    from pyspark.sql import functions as F

    from quadrille.sources.protocol import Source
    from quadrille.sources.tables import TableMapping

    assert isinstance(engine.source, Source) and isinstance(TableMapping({}), Source)
    q = engine.prepare(P + "SELECT ?x (COUNT(*) AS ?n) { ?x :p ?v } GROUP BY ?x HAVING(COUNT(*) > 1) ORDER BY DESC(?n)").query
    assert len(q.order_conditions) == len(q.group_conditions) == len(q.having_conditions) == 1 and q.order_conditions[0][1]
    named = Engine(spark, engine.source, blank_label=lambda label, row: F.concat(F.lit("own"), row.cast("string")))
    made = named.query(P + "CONSTRUCT { [] :is ?v } WHERE { :a :p ?v }").collect()
    assert made[0].s.lex.startswith("own")
    with pytest.warns(UserWarning, match="bound but not used: [?]v"):
        Engine(spark, engine.source, warn=50).prepare(P + "SELECT ?x { ?x :p ?v }")


def test_many_variables_that_may_be_unbound(engine, monkeypatch):
    """Joins split by such variables and joins on conditions give the same rows."""
    from quadrille.operators import compiler

    data = "VALUES (?a ?b ?c ?d) { (1 UNDEF 3 4) (UNDEF 2 UNDEF 4) (1 2 UNDEF UNDEF) (UNDEF UNDEF UNDEF UNDEF) (5 2 3 4) }"
    other = "VALUES (?a ?b ?c ?d ?e) { (1 2 3 4 'x') (UNDEF 2 UNDEF 4 'y') (UNDEF UNDEF UNDEF UNDEF 'z') (5 UNDEF 9 UNDEF 'w') }"
    texts = [f"SELECT * {{ {{ {data} }} {how} {{ {other} }} }}" for how in ("", "OPTIONAL", "MINUS")]
    texts += [f"SELECT * {{ {{ {data} }} FILTER {how} {{ {other} FILTER(?e != 'z') }} }}" for how in ("EXISTS", "NOT EXISTS")]
    found = []
    for split in (2, 0):
        monkeypatch.setattr(compiler, "SPLIT", split)
        found.append([ask(engine, t) for t in texts])
    assert found[0] == found[1] and len(found[0][0]) > 8 and 0 < len(found[0][2]) < 5


def test_years_of_more_than_four_digits(engine):
    """They have no sign before them, as XSD writes them, and are read again; those before the year 0 keep theirs."""
    text = "SELECT (STR(?t) AS ?a) (STR(xsd:date(?t)) AS ?b) (xsd:dateTime(STR(?t)) = ?t AS ?c) (xsd:date(STR(xsd:date(?t))) = xsd:date(?t) AS ?d) { VALUES ?s { 777600000000 -62198755200 } BIND(FROM_UNIXTIME(?s) AS ?t) }"
    assert ask(engine, text) == ["('-0001-01-01T00:00:00Z', '-0001-01-01', True, True)", "('26611-03-02T00:00:00Z', '26611-03-02', True, True)"]


def test_exists_with_an_order_test_keeps_one_row_a_key(spark, small):
    """EXISTS in a GRAPH tests its filter at the join, against the greatest or least value of each key."""
    from quadrille.queries import QUERIES

    for name in ("exists_graph", "not_exists_graph"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "max(" in plan and plan.count("Join") == 1, name
    data = "VALUES (?k ?b) { (1 5) (2 5) (3 5) (4 5) } FILTER %s { VALUES (?k ?t) { (1 4) (1 6) (2 5) (3 4) (3 UNDEF) } FILTER(%s) }"
    for test, kept in (("?t > ?b", "1"), ("?b < ?t", "1"), ("?t >= ?b", "12"), ("?t < ?b", "13"), ("?t + 1 <= ?b", "13"), ("?b > ?t && ?t < 5", "13"), ("?t != ?b", "13"), ("?t > ?b * 0.5 && ?t < ?b", "13"), ("?t > ?none", "")):
        for how, ks in (("EXISTS", kept), ("NOT EXISTS", "".join(k for k in "1234" if k not in kept))):
            got = ask(Engine(spark, QuadsFrame(from_triples(spark, [])), warn=False), f"SELECT ?k {{ {data % (how, test)} }}")
            assert got == [f"({k},)" for k in ks], (how, test)


def test_a_column_of_several_tables_is_scanned_once_in_each(spark, small):
    """A subject that may be of several tables is a union of their scans, without a join."""
    from quadrille.queries import QUERIES
    from quadrille.sources.tables import Table, TableMapping

    plan = QUERIES["same_column_in_tables"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 3
    own = "http://e/"
    t = TableMapping({"a": Table(spark.sql("select 1 as id, 'x' as n, 2 as b_id"), ("id",), {"b_id": "b"}), "b": Table(spark.sql("select * from values (2, 'y', 1.5d), (3, null, 2.5d) as t(id, n, v)"), ("id",))}, own)
    e = Engine(spark, t, warn=False)
    assert ask(e, "SELECT ?x ?n ?t { ?x :n ?n ; a ?t }") == ["('http://e/a/1', 'x', 'http://e/a')", "('http://e/b/2', 'y', 'http://e/b')"]
    assert ask(e, "SELECT ?g ?i { GRAPH ?g { ?x :id ?i ; a ?g } }") == ["('http://e/a', 1)", "('http://e/b', 2)", "('http://e/b', 3)"]
    assert ask(e, "SELECT ?n ?m { ?x :b_id ?y ; :n ?n . ?y :n ?m ; a ?c }") == ["('x', 'y')"]
    assert ask(e, "SELECT ?n { :b\\/2 :n ?n ; a ?c }") == ["('y',)"] and ask(e, "SELECT ?n { ?x :n ?n ; a <b> }") == []
    assert ask(e, "SELECT ?x { ?x :id 2 ; a ?t }") == ["('http://e/b/2',)"] and ask(e, "SELECT ?x { ?x :id ?i ; a :c }") == []


def test_updates_keep_what_changed_only(spark, small, tmp_path):
    """Neither the quads of the start are copied nor those read that an update can't touch."""
    from quadrille.sources.catalog import BASE, mapping
    from quadrille.sources.quads import Changed

    base = mapping(spark, small, ("region", "nation", "orders")).quads()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    e = Engine(spark, QuadsFrame(base), warn=False)
    e.update(f"PREFIX : <{BASE}> INSERT DATA {{ GRAPH :nation {{ :new :n_name 'x', 'x'@en, 'x'@EN }} }}; INSERT {{ GRAPH :k {{ ?x :seen 1 }} }} WHERE {{ GRAPH ?g {{ ?x :r_name ?n }} }}")
    assert isinstance(e.source, Changed) and e.source.base is base and "o_orderkey" not in plan(e.source.made)
    assert sorted((r.o.lang or "").lower() for r in e.source.quads.where("s.lex like '%new'").collect()) == ["", "en"]
    names = f"SELECT ?x ?n {{ GRAPH ?g {{ ?x <{BASE}r_name> ?n }} }}"
    e.update(f"PREFIX : <{BASE}> DELETE {{ GRAPH ?g {{ ?x :r_name ?n }} }} INSERT {{ GRAPH ?g {{ ?x :r_name 'new' . ?n :r_name ?x }} }} WHERE {{ GRAPH ?g {{ ?x :r_name ?n }} }}")
    assert ask(e, names) == [f"('{BASE}region/{i}', 'new')" for i in range(5)]
    assert "Join" not in plan(e.source.base.where(f"p = '{BASE}o_custkey'")) and "Join LeftAnti" not in plan(e.source.quads.where(f"p = '{BASE}o_custkey'"))
    # What was taken out can be put in again, in a graph that was cleared too, and goes with it.
    e.update(f"PREFIX : <{BASE}> DELETE DATA {{ GRAPH :region {{ <{BASE}region/0> :r_name 'new' }} }}; INSERT DATA {{ GRAPH :region {{ <{BASE}region/0> :r_name 'AFRICA' }} }}; CLEAR GRAPH :orders; ADD :region TO :orders; INSERT DATA {{ GRAPH :orders {{ :a :b :c }} }}")
    assert ask(e, f"SELECT ?n {{ GRAPH <{BASE}orders> {{ <{BASE}region/0> <{BASE}r_name> ?n }} }}") == ["('AFRICA',)"]
    assert e.source.quads.where(f"g = '{BASE}orders'").count() == e.source.quads.where(f"g = '{BASE}region'").count() + 1 == 16
    e.update(f"PREFIX : <{BASE}> MOVE :orders TO :region; DROP DEFAULT")
    assert e.source.quads.where(f"g = '{BASE}region'").count() == 16 and e.source.quads.where(f"g = '{BASE}orders'").count() == 0
    e.update("CLEAR ALL; INSERT DATA { <a> <p> 1 }")
    assert e.source.base is None and e.source.quads.count() == 1
