"""Result formats: writers and readers of bindings, truth values and triples."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import functions as F

from ..functions.values import BLANK, IRI
from ..plans.algebra import RDF, XSD, BNode, Iri, Lit, Triple, show
from ..plans.parser import _Parser
from .documents import parse_rdfxml
from .quads import cell, parse_turtle

WRITERS = ["xml", "srj", "json", "csv", "tsv", "html", "table", "turtle", "rdfxml", "ntriples"]
READERS = ["xml", "srj", "json", "csv", "tsv", "turtle", "rdfxml"]
NS = "http://www.w3.org/2005/sparql-results#"
RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"
_MIME = {"application/sparql-results+xml": "xml", "application/sparql-results+json": "srj", "text/csv": "csv", "text/tab-separated-values": "tsv", "text/html": "html", "text/turtle": "turtle", "application/rdf+xml": "rdfxml"}
_NAMES = {"srx": "xml", "xml": "xml", "srj": "srj", "json": "json", "csv": "csv", "tsv": "tsv", "html": "html", "txt": "table", "ttl": "turtle", "n3": "turtle", "rdf": "rdfxml", "nt": "ntriples"}


def guess(name: str | None = None, mime: str | None = None, content: str | None = None) -> str | None:
    """The format by MIME type, file name or beginning of the content; None if none of them tells."""
    if mime and mime.split(";")[0].strip() in _MIME:
        return _MIME[mime.split(";")[0].strip()]
    if name and (ending := name.rsplit(".", 1)[-1].lower()) in _NAMES:
        return _NAMES[ending]
    if content:
        start = content.lstrip()
        if start.startswith("{"):
            return "srj"
        if start.startswith("<"):
            return "xml" if "sparql" in start[:300] else "rdfxml" if "RDF" in start[:300] else None
        if start.startswith("?"):
            return "tsv"
        if start.startswith("@prefix"):
            return "turtle"
        if re.match(r"[A-Za-z_]\w*(,[A-Za-z_]\w*)*\r?\n", start):
            return "csv"
    return None


def term_of(c):
    """The term of a struct cell."""
    if c is None:
        return None
    if c["kind"] == IRI:
        return Iri(c["lex"])
    if c["kind"] == BLANK:
        return BNode(c["lex"])
    return Lit(c["lex"], c["lang"], c["dt"])


def literal_struct(t):
    kind, lex, lang, dt = cell(t)
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.lit(lex).alias("lex"), F.lit(lang).cast("string").alias("lang"), F.lit(dt).cast("string").alias("dt"))


def turtle(t) -> str:
    if isinstance(t, Lit) and t.dt in (XSD + "integer", XSD + "boolean") or isinstance(t, Lit) and t.dt == XSD + "decimal" and re.fullmatch(r"[+-]?\d*\.\d+", t.lex) or isinstance(t, Lit) and t.dt == XSD + "double" and re.search("[eE]", t.lex):
        return t.lex
    return "" if t is None else show(t)


def _plain(t) -> str:
    return "" if t is None else "_:" + t.label if isinstance(t, BNode) else t.value if isinstance(t, Iri) else t.lex


def _json(t) -> dict:
    if isinstance(t, Iri):
        return {"type": "uri", "value": t.value}
    if isinstance(t, BNode):
        return {"type": "bnode", "value": t.label}
    return {"type": "literal", "value": t.lex} | ({"xml:lang": t.lang} if t.lang else {}) | ({"datatype": t.dt} if t.dt else {})


def _xml(t) -> str:
    if isinstance(t, Iri):
        return f"<uri>{escape(t.value)}</uri>"
    if isinstance(t, BNode):
        return f"<bnode>{escape(t.label)}</bnode>"
    return f"<literal{f' xml:lang={quoteattr(t.lang)}' if t.lang else ''}{f' datatype={quoteattr(t.dt)}' if t.dt else ''}>{escape(t.lex)}</literal>"


def write_bindings(names, rows: Iterable[list], format: str) -> str:
    """Bindings as text; rows are lists of terms or None."""
    match format:
        case "srj" | "json":
            found = [{n: _json(t) for n, t in zip(names, row, strict=True) if t is not None} for row in rows]
            return json.dumps({"head": {"vars": list(names)}, "results": {"bindings": found}}, ensure_ascii=False)
        case "xml":
            head = "".join(f"<variable name={quoteattr(n)}/>" for n in names)
            body = "".join("<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml(t)}</binding>" for n, t in zip(names, row, strict=True) if t is not None) + "</result>" for row in rows)
            return f'<?xml version="1.0" encoding="utf-8"?>\n<sparql xmlns="{NS}"><head>{head}</head><results>{body}</results></sparql>\n'
        case "csv":
            out = io.StringIO()
            w = csv.writer(out, lineterminator="\r\n")
            w.writerow(names)
            for row in rows:
                w.writerow([_plain(t) for t in row])
            return out.getvalue()
        case "tsv":
            return "\t".join("?" + n for n in names) + "\n" + "".join("\t".join(map(turtle, row)) + "\n" for row in rows)
        case "html":
            head = "".join(f"<th>?{html.escape(n)}</th>" for n in names)
            body = "".join("<tr>" + "".join(f"<td>{html.escape(turtle(t))}</td>" for t in row) + "</tr>\n" for row in rows)
            return f"<!DOCTYPE html>\n<html><head><title>SPARQL results</title></head><body><table>\n<tr>{head}</tr>\n{body}</table></body></html>\n"
        case "table":
            cells = [[*names], *([turtle(t) for t in row] for row in rows)]
            width = [max(len(r[i]) for r in cells) for i in range(len(names))]
            rule = "-" * (sum(width) + 3 * len(width) + 1)
            lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |" for r in cells]
            return "\n".join([rule, lines[0], rule.replace("-", "="), *lines[1:], rule]) + "\n"
        case "turtle" | "rdfxml" | "ntriples":
            return write_graph(_result_set(names, rows), format)
    raise ValueError(f"no writer for bindings as {format}")


def _result_set(names, rows):
    root = BNode("set")
    yield root, Iri(RDF + "type"), Iri(RS + "ResultSet")
    for n in names:
        yield root, Iri(RS + "resultVariable"), Lit(n)
    for i, row in enumerate(rows):
        own = BNode(f"row{i}")
        yield root, Iri(RS + "solution"), own
        for n, t in zip(names, row, strict=True):
            if t is not None:
                pair = BNode(f"row{i}{n}")
                yield own, Iri(RS + "binding"), pair
                yield pair, Iri(RS + "variable"), Lit(n)
                yield pair, Iri(RS + "value"), t


def write_boolean(answer: bool, format: str) -> str:
    word = "true" if answer else "false"
    match format:
        case "srj" | "json":
            return json.dumps({"head": {}, "boolean": answer})
        case "xml":
            return f'<?xml version="1.0" encoding="utf-8"?>\n<sparql xmlns="{NS}"><head/><boolean>{word}</boolean></sparql>\n'
        case "csv" | "tsv" | "table":
            return word + "\n"
        case "html":
            return f"<!DOCTYPE html>\n<html><body><p>{word}</p></body></html>\n"
        case "turtle" | "ntriples" | "rdfxml":
            return write_graph([(BNode("set"), Iri(RDF + "type"), Iri(RS + "ResultSet")), (BNode("set"), Iri(RS + "boolean"), Lit(word, None, XSD + "boolean"))], format)
    raise ValueError(f"no writer for a truth value as {format}")


def write_graph(triples, format: str) -> str:
    match format:
        case "turtle" | "ntriples":
            return "".join(f"{show(s)} {show(p)} {show(o)} .\n" for s, p, o in triples)
        case "rdfxml":
            out = []
            for s, p, o in triples:
                space, local = re.match(r"(.*?)([^/#:]*)$", p.value).groups()
                about = f"rdf:nodeID={quoteattr(s.label)}" if isinstance(s, BNode) else f"rdf:about={quoteattr(s.value)}"
                if isinstance(o, Lit):
                    extra = f" xml:lang={quoteattr(o.lang)}" if o.lang else f" rdf:datatype={quoteattr(o.dt)}" if o.dt else ""
                    inner = f"<p:{local} xmlns:p={quoteattr(space)}{extra}>{escape(o.lex)}</p:{local}>"
                else:
                    link = f"rdf:nodeID={quoteattr(o.label)}" if isinstance(o, BNode) else f"rdf:resource={quoteattr(o.value)}"
                    inner = f"<p:{local} xmlns:p={quoteattr(space)} {link}/>"
                out.append(f"<rdf:Description {about}>{inner}</rdf:Description>\n")
            return f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n{"".join(out)}</rdf:RDF>\n'
        case "srj" | "json" | "xml" | "csv" | "tsv" | "table" | "html":
            return write_bindings(("s", "p", "o"), (list(t) for t in triples), format)
    raise ValueError(f"no writer for triples as {format}")


def read(content: str, format: str):
    """(names, rows) of bindings, or a truth value."""
    match format:
        case "srj" | "json":
            data = json.loads(content)
            if "boolean" in data:
                return data["boolean"]
            names = data["head"].get("vars", [])
            return tuple(names), [[_from_json(b.get(n)) for n in names] for b in data["results"]["bindings"]]
        case "xml":
            root = ET.fromstring(content)
            flag = root.find(f"{{{NS}}}boolean")
            if flag is not None:
                return flag.text.strip() == "true"
            names = [v.get("name") for v in root.iter(f"{{{NS}}}variable")]
            rows = []
            for result in root.iter(f"{{{NS}}}result"):
                own = {b.get("name"): _from_xml(b[0]) for b in result}
                rows.append([own.get(n) for n in names])
            return tuple(names), rows
        case "csv":
            lines = list(csv.reader(io.StringIO(content)))
            if lines in ([["true"]], [["false"]]):
                return lines == [["true"]]
            guess_term = lambda c: None if c == "" else BNode(c[2:]) if c.startswith("_:") else Iri(c) if re.match(r"[a-z][a-z0-9+.\-]*:\S+$", c) else Lit(c)
            return tuple(lines[0]), [[guess_term(c) for c in line] for line in lines[1:]]
        case "tsv":
            lines = content.rstrip("\n").split("\n")
            if lines in (["true"], ["false"]):
                return lines == ["true"]
            names = tuple(n.lstrip("?") for n in lines[0].split("\t"))
            return names, [[_from_turtle(c) for c in line.split("\t")] for line in lines[1:]]
        case "turtle":
            return _from_result_set(parse_turtle(content))
        case "rdfxml":
            return _from_result_set(parse_rdfxml(content))
    raise ValueError(f"no reader for {format}")


def _from_json(b):
    if b is None:
        return None
    if b["type"] == "uri":
        return Iri(b["value"])
    if b["type"] == "bnode":
        return BNode(b["value"])
    return Lit(b["value"], b.get("xml:lang"), b.get("datatype"))


def _from_xml(e):
    tag, value = e.tag.rsplit("}", 1)[-1], e.text or ""
    if tag == "uri":
        return Iri(value)
    if tag == "bnode":
        return BNode(value)
    return Lit(value, e.get("{http://www.w3.org/XML/1998/namespace}lang"), e.get("datatype"))


def _from_turtle(c: str):
    return _Parser(c).term(False) if c else None


def _from_result_set(triples: list[Triple]):
    by: dict = {}
    for t in triples:
        by.setdefault((t.s, t.p.value), []).append(t.o)
    root = next(t.s for t in triples if t.o == Iri(RS + "ResultSet"))
    if flag := by.get((root, RS + "boolean")):
        return flag[0].lex == "true"
    names = tuple(x.lex for x in by.get((root, RS + "resultVariable"), []))
    rows = []
    for s in by.get((root, RS + "solution"), []):
        own = {by[b, RS + "variable"][0].lex: by[b, RS + "value"][0] for b in by.get((s, RS + "binding"), [])}
        rows.append([own.get(n) for n in names])
    return names, rows
