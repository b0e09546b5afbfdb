"""Command line: run, check or print a SPARQL query over RDF files, or read a stored result."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    p.add_argument("query", nargs="?", help="file of the query or update; - is standard input")
    p.add_argument("-e", "--exec", help="the query itself")
    p.add_argument("-D", "--data", action="append", default=[], help="RDF file of the default graph")
    p.add_argument("-G", "--named", action="append", default=[], help="RDF file of a named graph, as IRI=FILE")
    p.add_argument("-F", "--data-format", default="guess", choices=["guess", "ntriples", "turtle", "trig", "rdfxml"])
    p.add_argument("-r", "--results", default="table", help="format of the results")
    p.add_argument("-R", "--read", help="read this stored result instead of running a query")
    p.add_argument("--compare", help="compare the result that -R names with this one; exit code 1 if they differ")
    p.add_argument("--diff", default="unified", choices=["unified", "json", "xml"], help="how to print differences")
    p.add_argument("-i", "--language", default="sparql")
    p.add_argument("-n", "--dry-run", action="store_true", help="check the query only")
    p.add_argument("-d", "--dump", choices=["algebra", "sparql"], help="print the query")
    p.add_argument("--protocol", help="send the query to this endpoint")
    p.add_argument("--no-network", action="store_true")
    a = p.parse_args(argv)
    from .sources import formats

    if a.read:
        content = Path(a.read).read_text()
        found = formats.read(content, formats.guess(a.read, content=content))
        if a.compare:
            from .compare import difference

            other = Path(a.compare).read_text()
            told = difference(found, formats.read(other, formats.guess(a.compare, content=other)), a.diff)
            print(told, end="")
            return int(bool(told))
        print(formats.write_boolean(found, a.results) if isinstance(found, bool) else formats.write_bindings(*found, a.results), end="")
        return 0
    text = a.exec or (sys.stdin.read() if a.query in (None, "-") else Path(a.query).read_text())
    from .plans import writer
    from .plans.algebra import tree
    from .plans.parser import SparqlSyntaxError, parse_any

    try:
        q = parse_any(text, language=a.language)
    except SparqlSyntaxError as e:
        print(e, file=sys.stderr)
        return 1
    update = isinstance(q, list)
    if a.dump and update:
        print("\n".join(map(str, q)))
    elif a.dump:
        print(tree(q.root) if a.dump == "algebra" else writer.query_text(q))
    if a.dry_run:
        return 0
    from .service import ServiceClient

    if a.protocol:
        rows = ServiceClient().select(a.protocol, text)
        names = q.names or tuple(dict.fromkeys(n for r in rows for n in r))
        print(formats.write_bindings(names, ([r.get(n) for n in names] for r in rows), a.results), end="")
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine

    spark = SparkSession.builder.appName("quadrille").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, service=ServiceClient(), network=not a.no_network)
    for path in a.data:
        engine.load(path, None, a.data_format)
    for pair in a.named:
        iri, _, path = pair.rpartition("=")
        engine.load(path, iri, a.data_format)
    if update:
        # What the default graph holds afterwards.
        engine.update(text)
        text = "CONSTRUCT WHERE { ?s ?p ?o }"
    print(engine.prepare(text, language=a.language).write(a.results), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
