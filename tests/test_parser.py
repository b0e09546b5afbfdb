import pytest

from quadrille.engine import validate
from quadrille.plans.algebra import BNode, Iri, LeftJoin, Lit, Triple, Var, tree, walk
from quadrille.plans.parser import SparqlSyntaxError, parse, parse_update
from quadrille.plans.writer import query_text
from quadrille.queries import PREFIX, QUAD_QUERIES, TABLE_QUERIES
from quadrille.sources.quads import parse_turtle

GOOD = [
    "SELECT * WHERE { ?s ?p ?o }",
    "SELECT $x { $x a <http://t> ; <p> 1, 2.5, 1e3, -4, true, 'a'@en-GB, \"b\"^^<http://d>, '''long 'text' ''' . }",
    "BASE <http://b/> PREFIX : <x#> ASK { :a :b [ :c (1 [] 'x') ] }",
    "CONSTRUCT WHERE { ?s ?p ?o } LIMIT 3",
    "DESCRIBE ?x <http://y> WHERE { ?x ?p 1 }",
    "SELECT (COUNT(DISTINCT *) AS ?n) (GROUP_CONCAT(?x ; SEPARATOR = ',') AS ?g) { ?s ?p ?x } GROUP BY (STR(?s) AS ?k) ?p HAVING (COUNT(*) > 1) (MAX(?x) < 4) ORDER BY DESC(COUNT(*)) ?k LIMIT 2 OFFSET 1",
    "SELECT ?x { { SELECT ?x { ?x ?p ?o } LIMIT 1 } OPTIONAL { ?x ?q ?r FILTER(?r IN (1, 2) || ?r NOT IN ()) } MINUS { ?x ?a 1 } } VALUES ?x { <a> UNDEF }",
    "SELECT * FROM <g> FROM NAMED <h> { GRAPH ?g { ?s ?p ?o } SERVICE SILENT <http://e> { ?s ?q ?z } }",
    "SELECT ?a { ?a ?b ?c FILTER NOT EXISTS { ?a ?x ?y } FILTER(?c < 3&&?c>-1) BIND(IF(BOUND(?c), 1, 2) AS ?d) }",
    "EXPLAIN SELECT ?a { ?a ?b ?c }",
]
BAD = [
    "SELECT WHERE { ?s ?p ?o }", "SELECT ?x { ?s ?p }", "SELECT ?x { ?s ?p ?o", "SELECT ?x { ?s nope:x ?o }", "SELECT ?x { ?s ?p ?o } LIMIT x", "SELECT * { ?s ?p ?o } GROUP BY ?s",
    "SELECT ?o { ?s ?p ?o } GROUP BY ?s", "SELECT ?x { ?x ?p ?o BIND(1 AS ?x) }", "SELECT (1 AS ?x) (2 AS ?x) {}", "SELECT ?x { VALUES (?x ?y) { (1) } }", "SELECT ?x { ?x ?p ?o FILTER(NOPE(?x)) }",
    "SELECT ?x { ?x ?p ?o FILTER(STRLEN(?x, 1)) }", "ASK { ?s ?p ?o } }", "SELECT ?x { ?x ?p 'a\\q' }", "SELECT ?x { ?x <p>/<q> ?o }",
]
UPDATES = [
    "INSERT DATA { <a> <b> 1 . GRAPH <g> { <a> <b> 2 } }", "DELETE DATA { <a> <b> 1 }", "DELETE WHERE { ?s ?p ?o . GRAPH ?g { ?s ?p 1 } }", "WITH <g> DELETE { ?s ?p ?o } INSERT { ?s ?p 1 } USING <h> WHERE { ?s ?p ?o }",
    "CLEAR SILENT ALL; CREATE GRAPH <g>; DROP NAMED; LOAD <x> INTO GRAPH <g>; ADD DEFAULT TO <g>; MOVE <a> TO DEFAULT; COPY GRAPH <a> TO <b>;",
]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    q = parse(text)
    assert tree(q.root)
    assert parse(query_text(q)).form == q.form


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert validate(text)
    with pytest.raises(SparqlSyntaxError):
        parse(text)


@pytest.mark.parametrize("text", UPDATES)
def test_updates(text):
    assert parse_update(text)


@pytest.mark.parametrize("text", ["INSERT DATA { ?s <b> 1 }", "DELETE DATA { _:a <b> 1 }", "DELETE { _:a <b> 1 } WHERE { ?s ?p ?o }", "CLEAR <g>", "INSERT { ?s ?p ?o }"])
def test_bad_updates(text):
    with pytest.raises(SparqlSyntaxError):
        parse_update(text)


@pytest.mark.parametrize("name", sorted(TABLE_QUERIES | QUAD_QUERIES))
def test_written_queries_parse_again(name):
    q = parse(PREFIX + (TABLE_QUERIES | QUAD_QUERIES)[name][0])
    again = parse(query_text(q))
    assert again.names == q.names and again.form == q.form


def test_error_line():
    assert validate("SELECT ?x {\n ?x ?p\n }").startswith("line 3")


def test_versions_and_parts():
    with pytest.raises(SparqlSyntaxError):
        parse("SELECT (1 AS ?x) { ?s ?p ?o MINUS { ?s ?p 1 } }", language="sparql10")
    q = parse("SELECT ?x { ?x <p> ?y OPTIONAL { ?x <q> ?z } }")
    assert q.variables == ("x", "y", "z") and len(q.triples) == 2 and any(isinstance(n, LeftJoin) for n in walk(q.root))


def test_turtle():
    got = parse_turtle('@prefix : <http://e/> . :a :b "x"@en , 2 ; a :C . [] :p ( 1 ) .')
    assert got[0] == Triple(Iri("http://e/a"), Iri("http://e/b"), Lit("x", "en")) and len(got) == 6
    assert sum(isinstance(t.s, BNode) for t in got) == 3 and not any(isinstance(x, Var) for t in got for x in (t.s, t.p, t.o))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * { _:a ?p 1 { _:a ?q 2 } }",
        "SELECT * { _:a ?p 1 OPTIONAL { ?x ?q 2 } _:a ?r 3 }",
        "SELECT * { _:a ?p 1 . { ?x ?q 2 } UNION { _:a ?r 3 } }",
        "SELECT * { ?x ?p ?v FILTER ?v }",
        "PREFIX ex:ex: <http://e/> SELECT * { ?x ex:ex:p ?v }",
    ],
)
def test_refused(text):
    with pytest.raises(SparqlSyntaxError):
        parse(text)


def test_accepted():
    assert len(parse("SELECT * { _:a ?p 1 FILTER(?p != 2) _:a ?q 3 . _:a ?r 123. . }").triples) == 3
    q = parse("SELECT ?\\u0061 { ?a <http://e/\\u00e9> \"\\u0022\" }")
    assert q.names == ("a",) and q.triples[0].p.value == "http://e/é" and q.triples[0].o.lex == '"'
    assert parse("PREFIX : <http://e/> SELECT * { ?x :re\u0301sume\u0301 ?y }").triples[0].p.value == "http://e/re\u0301sume\u0301"
    from quadrille.plans.parser import parse_any

    assert isinstance(parse_any("PREFIX : <http://e/> INSERT DATA { :a :b 1 }"), list) and parse_any("ASK {}").form == "ask"


def test_rdf_documents():
    from quadrille.plans.algebra import RDF, BNode, Iri, Lit
    from quadrille.sources.documents import parse_rdfxml, parse_trig

    text = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/d">
      <e:Thing rdf:about="a" e:size="big"><e:name xml:lang="en">A</e:name><e:n rdf:datatype="http://t">1</e:n><e:next rdf:resource="#z"/>
        <e:part><rdf:Description rdf:ID="p"><e:of rdf:nodeID="m"/></rdf:Description></e:part>
        <e:box rdf:parseType="Resource"><e:w>2</e:w></e:box><e:list rdf:parseType="Collection"><rdf:Description rdf:about="i"/></e:list></e:Thing>
      <rdf:Bag rdf:nodeID="m"><rdf:li>x</rdf:li><rdf:li>y</rdf:li></rdf:Bag></rdf:RDF>"""
    found = {(t.s, t.p.value, t.o) for t in parse_rdfxml(text)}
    a = Iri("http://b/a")
    assert {(a, RDF + "type", Iri("http://e/Thing")), (a, "http://e/size", Lit("big")), (a, "http://e/name", Lit("A", "en")), (a, "http://e/n", Lit("1", None, "http://t"))} <= found
    assert {(a, "http://e/next", Iri("http://b/d#z")), (a, "http://e/part", Iri("http://b/d#p")), (Iri("http://b/d#p"), "http://e/of", BNode("nm")), (BNode("nm"), RDF + "_2", Lit("y"))} <= found
    assert sum(p == RDF + "first" for _, p, _ in found) == 1 and len(found) == 15
    quads = parse_trig("@prefix : <http://e/> . :a :p 1 . { :b :p 2 } :g { :c :p 3, 4 . } GRAPH :h { :d :p [] }")
    assert [g for g, _ in quads] == [None, None, "http://e/g", "http://e/g", "http://e/h"]
