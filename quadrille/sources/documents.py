"""Readers of RDF documents that are parsed as a whole: Turtle, TriG and RDF/XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from ..plans.algebra import RDF, BNode, Iri, Lit, Triple, Var
from ..plans.parser import SparqlSyntaxError, _Parser

XML = "http://www.w3.org/XML/1998/namespace"
#: Attributes of RDF/XML that are no properties.
_SYNTAX = {f"{{{RDF}}}{n}" for n in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "li")} | {f"{{{XML}}}lang", f"{{{XML}}}base"}


def parse_turtle(text: str, base: str | None = None) -> list[Triple]:
    """Triples of a Turtle document: directives, property and object lists, collections and blank nodes."""
    return [t for _, t in _statements(_Parser(text, base), False)]


def parse_trig(text: str, base: str | None = None) -> list[tuple[str | None, Triple]]:
    """(graph or None, triple) of a TriG document."""
    return list(_statements(_Parser(text, base), True))


def _statements(p: _Parser, graphs: bool) -> Iterator[tuple[str | None, Triple]]:
    def block() -> list[Triple]:
        p.need("{")
        found = p.triples(blank=False)
        p.need("}")
        return _ground(found)

    while p.i < len(p.tokens):
        p.prologue()
        if p.i >= len(p.tokens):
            break
        if p.kind() == "lang" and p.value() in ("@prefix", "@base"):
            if p.take() == "@base":
                p.base = p.iri().value
            else:
                prefix = p.take()[:-1]
                p.prefixes[prefix] = p.iri().value
            p.need(".")
            continue
        if graphs and p.is_op("{"):
            yield from ((None, t) for t in block())
            continue
        if graphs and (p.got_word("GRAPH") or p.value(1) == "{"):
            name = p.term(False)
            if not isinstance(name, Iri | BNode):
                p.fail("the name of a graph")
            label = name.value if isinstance(name, Iri) else "_:" + name.label
            yield from ((label, t) for t in block())
            continue
        found = p.triples(blank=False)
        if not found:
            p.fail("triples")
        yield from ((None, t) for t in _ground(found))


def _ground(found: list[Triple]) -> list[Triple]:
    if any(isinstance(x, Var) for t in found for x in (t.s, t.p, t.o)):
        raise SparqlSyntaxError("a variable in data", 1)
    return found


class _RdfXml:
    """Node elements hold property elements, and these hold a node, a literal or a reference."""

    def __init__(self):
        self.out: list[Triple] = []
        self.made = 0

    def fresh(self) -> BNode:
        self.made += 1
        return BNode(f"x{self.made}")

    def add(self, s, p: str, o) -> None:
        self.out.append(Triple(s, Iri(p), o))

    @staticmethod
    def name(tag: str) -> str:
        if not tag.startswith("{"):
            raise ValueError(f"RDF/XML: {tag} has no namespace")
        return tag[1:].replace("}", "", 1)

    @staticmethod
    def scope(e: ET.Element, base: str, lang: str | None) -> tuple[str, str | None]:
        return urljoin(base, e.get(f"{{{XML}}}base", "")), e.get(f"{{{XML}}}lang", lang) or None

    def subject(self, e: ET.Element, base: str):
        if (iri := e.get(f"{{{RDF}}}about")) is not None:
            return Iri(urljoin(base, iri))
        if (mark := e.get(f"{{{RDF}}}ID")) is not None:
            return Iri(urljoin(base, "#" + mark))
        label = e.get(f"{{{RDF}}}nodeID")
        return BNode("n" + label) if label is not None else self.fresh()

    def node(self, e: ET.Element, base: str, lang: str | None):
        base, lang = self.scope(e, base, lang)
        own = self.subject(e, base)
        if e.tag != f"{{{RDF}}}Description":
            self.add(own, RDF + "type", Iri(self.name(e.tag)))
        self.attributes(own, e, base, lang)
        items = 0
        for child in e:
            items += child.tag == f"{{{RDF}}}li"
            self.property(own, child, f"{RDF}_{items}" if child.tag == f"{{{RDF}}}li" else self.name(child.tag), base, lang)
        return own

    def attributes(self, own, e: ET.Element, base: str, lang: str | None) -> None:
        for key, value in e.attrib.items():
            if key not in _SYNTAX:
                self.add(own, self.name(key), Iri(urljoin(base, value)) if key == f"{{{RDF}}}type" else Lit(value, lang))

    def property(self, own, e: ET.Element, name: str, base: str, lang: str | None) -> None:
        base, lang = self.scope(e, base, lang)
        kind, label = e.get(f"{{{RDF}}}parseType"), e.get(f"{{{RDF}}}nodeID")
        if kind == "Resource":
            value = self.fresh()
            for child in e:
                self.property(value, child, self.name(child.tag), base, lang)
        elif kind == "Collection":
            value = Iri(RDF + "nil")
            for child in reversed([self.node(c, base, lang) for c in e]):
                cell = self.fresh()
                self.add(cell, RDF + "first", child)
                self.add(cell, RDF + "rest", value)
                value = cell
        elif kind is not None:
            value = Lit((e.text or "") + "".join(ET.tostring(c, "unicode") for c in e), None, RDF + "XMLLiteral")
        elif len(e):
            value = self.node(e[0], base, lang)
        elif (iri := e.get(f"{{{RDF}}}resource")) is not None or label is not None or any(k not in _SYNTAX for k in e.attrib):
            value = Iri(urljoin(base, iri)) if iri is not None else BNode("n" + label) if label is not None else self.fresh()
            self.attributes(value, e, base, lang)
        else:
            dt = e.get(f"{{{RDF}}}datatype")
            value = Lit(e.text or "", None if dt else lang, urljoin(base, dt) if dt else None)
        self.add(own, name, value)
        if (mark := e.get(f"{{{RDF}}}ID")) is not None:
            told = Iri(urljoin(base, "#" + mark))
            for part, x in (("type", Iri(RDF + "Statement")), ("subject", own), ("predicate", Iri(name)), ("object", value)):
                self.add(told, RDF + part, x)


def parse_rdfxml(text: str, base: str | None = None) -> list[Triple]:
    """Triples of an RDF/XML document, with typed nodes, property attributes, containers, collections and reification."""
    root, reader = ET.fromstring(text), _RdfXml()
    if root.tag == f"{{{RDF}}}RDF":
        own, lang = reader.scope(root, base or "", None)
        for child in root:
            reader.node(child, own, lang)
    else:
        reader.node(root, base or "", None)
    return reader.out


#: Parsers by format: text and base to (graph or None, triple).
PARSERS = {
    "turtle": lambda text, base: [(None, t) for t in parse_turtle(text, base)],
    "trig": parse_trig,
    "rdfxml": lambda text, base: [(None, t) for t in parse_rdfxml(text, base)],
}
