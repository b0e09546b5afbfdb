"""The SPARQL protocol client behind SERVICE; the transport is a function, so tests and offline runs supply their own."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from .sources import formats


def http_get(url: str) -> tuple[str, str]:
    """(content type, body) of a GET."""
    with urlopen(Request(url, headers={"Accept": "application/sparql-results+json, application/sparql-results+xml"}), timeout=60) as r:
        return r.headers.get("Content-Type", ""), r.read().decode()


class ServiceClient:
    def __init__(self, transport: Callable[[str], tuple[str, str]] = http_get, default_graphs: tuple[str, ...] = (), named_graphs: tuple[str, ...] = ()):
        self.transport, self.default_graphs, self.named_graphs = transport, default_graphs, named_graphs

    def select(self, endpoint: str, query: str) -> list[dict]:
        """Solutions as dictionaries from variable to term."""
        fields = [("query", query), *(("default-graph-uri", g) for g in self.default_graphs), *(("named-graph-uri", g) for g in self.named_graphs)]
        kind, body = self.transport(endpoint + ("&" if "?" in endpoint else "?") + urlencode(fields))
        names, rows = formats.read(body, formats.guess(mime=kind, content=body) or "srj")
        return [{n: t for n, t in zip(names, row, strict=True) if t is not None} for row in rows]
