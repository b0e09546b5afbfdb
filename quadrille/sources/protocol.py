"""What the engine asks of a graph source; any object with these methods is one."""

from __future__ import annotations

from typing import TYPE_CHECKING, Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..plans.algebra import Iri, Triple, Var

if TYPE_CHECKING:
    from ..operators.compiler import Compiler, Rel


@runtime_checkable
class Source(Protocol):
    """A source of triples, default graph and named graphs."""

    def bgp(self, triples: tuple[Triple, ...], graph: Iri | Var | None, compiler: Compiler) -> Rel:
        """The solutions of a basic pattern (never empty) in the default graph, in one named graph, or in all of them with
        the graph's name as a variable. ``compiler.rel(df, cells)`` makes the relation, ``compiler.join`` joins two."""
        ...

    def dataset(self, default: tuple[str, ...], named: tuple[str, ...]) -> Source:
        """The source with the graphs of FROM and FROM NAMED."""
        ...

    def graph_names(self) -> DataFrame:
        """The names of the named graphs, in a column ``g``."""
        ...

    def everything(self) -> DataFrame:
        """The triples (s term, p string, o term) of the default graph, for DESCRIBE."""
        ...
