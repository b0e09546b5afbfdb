"""The driver's tables as a virtual graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .tables import Table, TableMapping

BASE = "http://example.org/"
#: Keys, foreign keys and columns of the tables.
TABLES = {
    "region": (("r_regionkey",), {}, ("r_regionkey", "r_name")),
    "nation": (("n_nationkey",), {"n_regionkey": "region"}, ("n_nationkey", "n_name", "n_regionkey")),
    "customer": (("c_custkey",), {"c_nationkey": "nation"}, ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "supplier": (("s_suppkey",), {"s_nationkey": "nation"}, ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
    "part": (("p_partkey",), {}, ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "orders": (("o_orderkey",), {"o_custkey": "customer"}, ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "lineitem": (
        ("l_orderkey", "l_linenumber"),
        {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
        ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    ),
    "events": (("event_id",), {}, ("event_id", "ts", "user_id", "event_type", "value", "props")),
    "documents": (("doc_id",), {}, ("doc_id", "text", "lang", "source", "n_chars")),
    "embeddings": (("vec_id",), {}, ("vec_id", "label")),
    "pages": (("page_id",), {}, ("page_id", "url", "html")),
    "benchmark": (("item_id",), {}, ("item_id", "text")),
    "labels": (("doc_id",), {}, ("doc_id", "quality", "toxic")),
    "conversations": (("conv_id", "turn"), {}, ("conv_id", "turn", "role", "text")),
}


def mapping(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(TABLES)) -> TableMapping:
    """The tables of a folder as a graph; each is opened when a query first reads it."""

    def table(name: str) -> Table:
        key, links, columns = TABLES[name]
        return Table(lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, links, columns)

    return TableMapping({n: table(n) for n in names}, BASE)
