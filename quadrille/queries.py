"""Registered queries of the graph engine: SPARQL over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.library import register, register_aggregate
from .plans.algebra import Lit
from .sources.catalog import BASE, mapping
from .sources.quads import QuadsFrame

register(BASE + "reversed", F.reverse)
register_aggregate(BASE + "longest", lambda c: F.max(F.length(c).cast("bigint")), "integer")
PREFIX = f"PREFIX : <{BASE}>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
TABLE_QUERIES: dict[str, tuple[str, str | None]] = {
    # patterns
    "bgp_revenue_by_nation": (
        """SELECT ?nation (ROUND(SUM(?price * (1 - ?disc)) * 100) / 100 AS ?revenue) (COUNT(*) AS ?items) WHERE {
             ?l a :lineitem ; :l_orderkey ?o ; :l_extendedprice ?price ; :l_discount ?disc ; :l_shipdate ?d .
             ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_name ?nation
             FILTER(?d >= "1996-01-01T00:00:00Z"^^xsd:dateTime) } GROUP BY ?nation ORDER BY DESC(?revenue) ?nation LIMIT 10""",
        """select n_name as nation, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 as revenue, count(*) as items
           from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
           where l_shipdate >= timestamp '1996-01-01' group by n_name order by revenue desc, n_name limit 10""",
    ),
    "bgp_star": ("SELECT ?k ?name ?bal WHERE { ?c :c_custkey ?k ; :c_name ?name ; :c_acctbal ?bal ; :c_mktsegment \"BUILDING\" }", "select c_custkey as k, c_name as name, c_acctbal as bal from customer where c_mktsegment = 'BUILDING'"),
    "bgp_path": ("SELECT ?cust ?region WHERE { ?c :c_custkey ?cust ; :c_nationkey ?n . ?n :n_regionkey ?r . ?r :r_name ?region }", "select c_custkey as cust, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "bgp_constant_subject": (f"SELECT ?name WHERE {{ <{BASE}nation/3> :n_name ?name }}", "select n_name as name from nation where n_nationkey = 3"),
    "bgp_constant_object": (f"SELECT ?name WHERE {{ ?n :n_regionkey <{BASE}region/1> ; :n_name ?name }}", "select n_name as name from nation where n_regionkey = 1"),
    "bgp_empty": ("SELECT (1 + 1 AS ?two) WHERE {}", "select cast(2 as bigint) as two"),
    "iri_output": ("SELECT ?n ?r WHERE { ?n :n_regionkey ?r }", f"select '{BASE}nation/' || n_nationkey as n, '{BASE}region/' || n_regionkey as r from nation"),
    "join_nested_groups": ("SELECT ?a ?b WHERE { { ?n :n_nationkey ?a ; :n_regionkey ?r } { ?r :r_name ?b } }", "select cast(n_nationkey as bigint) as a, r_name as b from nation join region on n_regionkey = r_regionkey"),
    "cross_join": ("SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b FILTER(?a < ?b) }", "select x.r_name as a, y.r_name as b from region x, region y where x.r_name < y.r_name"),
    "self_join": ("SELECT ?a ?b WHERE { ?x :n_regionkey ?r ; :n_name ?a . ?y :n_regionkey ?r ; :n_name ?b FILTER(?a < ?b) }", "select x.n_name as a, y.n_name as b from nation x join nation y on x.n_regionkey = y.n_regionkey where x.n_name < y.n_name"),
    "optional": ("SELECT ?k ?o WHERE { ?c :c_custkey ?k OPTIONAL { ?x :o_custkey ?c ; :o_orderkey ?o } }", "select c_custkey as k, o_orderkey as o from customer left join orders on o_custkey = c_custkey"),
    "optional_filter": ("SELECT ?k ?o WHERE { ?c :c_custkey ?k ; :c_acctbal ?b OPTIONAL { ?x :o_custkey ?c ; :o_orderkey ?o ; :o_totalprice ?t FILTER(?t > ?b * 20) } }", "select c_custkey as k, o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_totalprice > c_acctbal * 20"),
    "optional_then_join": ("SELECT ?n ?x WHERE { ?a :n_name ?n ; :n_nationkey ?k OPTIONAL { ?r :r_regionkey ?k ; :r_name ?x } { ?b :n_nationkey ?k } UNION { ?s :r_name ?x } }",
        """with l as (select n_name as n, n_nationkey as k, r_name as x from nation left join region on r_regionkey = n_nationkey)
           select n, x from l union all select l.n, r_name as x from l join region on l.x is null or l.x = r_name"""),
    "union": ("SELECT ?name ?kind WHERE { { ?c :c_name ?name BIND(\"c\" AS ?kind) } UNION { ?s :s_name ?name BIND(\"s\" AS ?kind) } }", "select c_name as name, 'c' as kind from customer union all select s_name, 's' from supplier"),
    "union_missing": ("SELECT ?a ?b WHERE { { ?c :r_name ?a } UNION { ?s :n_name ?b } }", "select r_name as a, null as b from region union all select null, n_name from nation"),
    "minus": ("SELECT ?k WHERE { ?c :c_custkey ?k MINUS { ?o :o_custkey ?c ; :o_orderstatus \"P\" ; :o_orderpriority \"5-LOW\" } }", "select c_custkey as k from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_orderpriority = '5-LOW')"),
    "minus_disjoint": ("SELECT ?n WHERE { ?r :r_name ?n MINUS { ?o :n_name ?m } }", "select r_name as n from region"),
    "exists": ("SELECT ?k WHERE { ?s :s_suppkey ?k FILTER EXISTS { ?l :l_suppkey ?s ; :l_returnflag \"R\" ; :l_quantity ?q FILTER(?q > 49) } }", "select s_suppkey as k from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity > 49)"),
    "exists_outer_filter": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 60) } }", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)"),
    "not_exists": ("SELECT ?k WHERE { ?c :c_custkey ?k FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_orderstatus \"F\" } }", "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')"),
    "exists_in_or": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(?b > 9000 || NOT EXISTS { ?o :o_custkey ?c }) }", "select c_custkey as k from customer where c_acctbal > 9000 or not exists (select 1 from orders where o_custkey = c_custkey)"),
    "bind": ("SELECT ?k ?net WHERE { ?l :l_linenumber ?k ; :l_extendedprice ?p ; :l_discount ?d BIND(?p * (1 - ?d) AS ?net) FILTER(?net < 1000) }", "select cast(l_linenumber as bigint) as k, l_extendedprice * (1 - l_discount) as net from lineitem where l_extendedprice * (1 - l_discount) < 1000"),
    "values": ("SELECT ?n ?r WHERE { VALUES ?r { \"ASIA\" \"EUROPE\" } ?x :r_name ?r . ?y :n_regionkey ?x ; :n_name ?n }", "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')"),
    "values_undef": ("SELECT ?k ?r WHERE { ?n :n_nationkey ?k ; :n_regionkey ?x . ?x :r_name ?r } VALUES (?k ?r) { (1 UNDEF) (UNDEF \"ASIA\") (2 \"AFRICA\") }", "select cast(n_nationkey as bigint) as k, r_name as r from nation join region on n_regionkey = r_regionkey join (values (1, null), (null, 'ASIA'), (2, 'AFRICA')) v(a, b) on (a is null or a = n_nationkey) and (b is null or b = r_name)"),
    "subselect": ("SELECT ?name ?total WHERE { ?c :c_name ?name { SELECT ?c (ROUND(SUM(?t) * 100) / 100 AS ?total) WHERE { ?o :o_custkey ?c ; :o_totalprice ?t } GROUP BY ?c HAVING(COUNT(*) > 15) } }", "select c_name as name, total from customer join (select o_custkey, floor(sum(o_totalprice) * 100 + 0.5) / 100 as total from orders group by o_custkey having count(*) > 15) on c_custkey = o_custkey"),
    "subselect_limit": ("SELECT ?n ?r WHERE { ?x :n_regionkey ?y ; :n_name ?n { SELECT ?y ?r WHERE { ?y :r_name ?r } ORDER BY ?r LIMIT 2 } }", "select n_name as n, r_name as r from nation join (select * from region order by r_name limit 2) on n_regionkey = r_regionkey"),
    "graph_named": (f"SELECT ?n WHERE {{ GRAPH <{BASE}nation> {{ ?x :n_name ?n }} }}", "select n_name as n from nation"),
    "graph_variable": ("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x :r_name ?n1 } } GROUP BY ?g", f"select '{BASE}region' as g, count(*) as n from region"),
    "same_column_in_tables": ("SELECT ?t (COUNT(*) AS ?n) WHERE { ?x :text ?text ; a ?t } GROUP BY ?t", f"select '{BASE}documents' as t, count(text) as n from documents union all select '{BASE}benchmark', count(text) from benchmark union all select '{BASE}conversations', count(text) from conversations"),
    "labels_of_documents": ("SELECT ?d ?q ?l WHERE { ?x :doc_id ?d ; :lang ?l . ?y :doc_id ?d ; :quality ?q }", "select d.doc_id as d, cast(quality as bigint) as q, lang as l from documents d join labels l on d.doc_id = l.doc_id where lang is not null and quality is not null"),
    "page_urls": ("SELECT ?k (STRBEFORE(STRAFTER(?u, \"://\"), \"/\") AS ?host) WHERE { ?p :page_id ?k ; :url ?u }", "select page_id as k, case when instr(substr(url, instr(url, '://') + 3), '/') > 0 and instr(url, '://') > 0 then split_part(substr(url, instr(url, '://') + 3), '/', 1) else '' end as host from pages where url is not null"),
    # filters and expressions
    "filter_and_or_not": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s ; :p_retailprice ?r FILTER((?s < 5 || ?s >= 45) && !(?r > 1500) && ?s != 47) }", "select p_partkey as k from part where (p_size < 5 or p_size >= 45) and not (p_retailprice > 1500) and p_size <> 47"),
    "compare_all": ("SELECT ?k (?s = 10 AS ?eq) (?s != 10 AS ?ne) (?s < 10 AS ?lt) (?s > 10 AS ?gt) (?s <= 10 AS ?le) (?s >= 10 AS ?ge) WHERE { ?p :p_partkey ?k ; :p_size ?s }", "select p_partkey as k, p_size = 10 as eq, p_size <> 10 as ne, p_size < 10 as lt, p_size > 10 as gt, p_size <= 10 as le, p_size >= 10 as ge from part"),
    "arithmetic": ("SELECT ?k (?s + 1 AS ?a) (?s - 2 AS ?b) (?s * 3 AS ?c) (xsd:double(?s) / 4 AS ?d) (-?s AS ?e) (+?s AS ?f) WHERE { ?p :p_partkey ?k ; :p_size ?s }", "select p_partkey as k, cast(p_size + 1 as bigint) as a, cast(p_size - 2 as bigint) as b, cast(p_size * 3 as bigint) as c, p_size / 4.0::double as d, cast(-p_size as bigint) as e, cast(p_size as bigint) as f from part"),
    "division_by_zero": ("SELECT ?k ?x WHERE { ?p :p_partkey ?k ; :p_size ?s BIND(10 / (?s - ?s) AS ?q) BIND(BOUND(?q) AS ?x) }", "select p_partkey as k, false as x from part"),
    "in_list": ("SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderpriority ?p FILTER(?p IN (\"1-URGENT\", \"2-HIGH\")) }", "select o_orderkey as k from orders where o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "not_in_list": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s NOT IN (1, 2, 3, 4, 5)) }", "select p_partkey as k from part where p_size not in (1, 2, 3, 4, 5)"),
    "if_coalesce_bound": ("SELECT ?k (IF(BOUND(?o), \"yes\", \"no\") AS ?has) (COALESCE(?o, -1) AS ?first) WHERE { ?c :c_custkey ?k OPTIONAL { ?x :o_custkey ?c ; :o_orderkey ?o } }", "select c_custkey as k, case when o_orderkey is null then 'no' else 'yes' end as has, coalesce(o_orderkey, -1) as first from customer left join orders on o_custkey = c_custkey"),
    "same_term": ("SELECT ?a ?b WHERE { ?x :n_name ?a . ?y :n_name ?b FILTER(sameTerm(?x, ?y)) }", "select n_name as a, n_name as b from nation"),
    "type_tests": ("SELECT ?k (isIRI(?x) AS ?i) (isBLANK(?x) AS ?b) (isLITERAL(?k) AS ?l) (isNUMERIC(?k) AS ?n) (isURI(?k) AS ?u) WHERE { ?x :n_nationkey ?k }", "select cast(n_nationkey as bigint) as k, true as i, false as b, true as l, true as n, false as u from nation"),
    "str_lang_datatype": ("SELECT ?k (STR(?x) AS ?s) (LANG(?k) AS ?l) (DATATYPE(?k) AS ?d) WHERE { ?x :n_nationkey ?k }", f"select cast(n_nationkey as bigint) as k, '{BASE}nation/' || n_nationkey as s, '' as l, 'http://www.w3.org/2001/XMLSchema#integer' as d from nation"),
    "strlang_langmatches": ("SELECT ?d (LANG(?t) AS ?l) (LANGMATCHES(LANG(?t), \"en\") AS ?m) WHERE { ?x :doc_id ?d ; :lang ?g BIND(STRLANG(\"x\", ?g) AS ?t) }", "select doc_id as d, lang as l, lower(lang) = 'en' or starts_with(lower(lang), 'en-') as m from documents"),
    "strdt": ("SELECT ?k (DATATYPE(STRDT(STR(?k), xsd:short)) AS ?d) WHERE { ?x :r_regionkey ?k }", "select cast(r_regionkey as bigint) as k, 'http://www.w3.org/2001/XMLSchema#short' as d from region"),
    "iri_function": ("SELECT (STR(IRI(CONCAT(\"http://e/\", ?n))) AS ?i) WHERE { ?x :r_name ?n }", "select 'http://e/' || r_name as i from region"),
    "string_functions": ("SELECT ?k (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 5) AS ?sub) (SUBSTR(?n, 3) AS ?tail) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (CONCAT(?n, \"-\", ?t) AS ?cat) WHERE { ?p :p_partkey ?k ; :p_name ?n ; :p_type ?t }", "select p_partkey as k, cast(length(p_name) as bigint) as len, substr(p_name, 2, 5) as sub, substr(p_name, 3) as tail, upper(p_name) as up, lower(p_name) as low, p_name || '-' || p_type as cat from part"),
    "string_tests": ("SELECT ?k (STRSTARTS(?n, \"P\") AS ?s) (STRENDS(?n, \"1\") AS ?e) (CONTAINS(?n, \"2\") AS ?c) WHERE { ?p :p_partkey ?k ; :p_name ?n }", "select p_partkey as k, starts_with(p_name, 'P') as s, ends_with(p_name, '1') as e, contains(p_name, '2') as c from part"),
    "str_before_after": ("SELECT ?k (STRBEFORE(?p, \"-\") AS ?b) (STRAFTER(?p, \"-\") AS ?a) (STRAFTER(?p, \"~\") AS ?none) WHERE { ?o :o_orderkey ?k ; :o_orderpriority ?p }", "select o_orderkey as k, split_part(o_orderpriority, '-', 1) as b, substr(o_orderpriority, instr(o_orderpriority, '-') + 1) as a, '' as none from orders"),
    "encode_for_uri": ("SELECT ?k (ENCODE_FOR_URI(CONCAT(?n, \" a*~/b\")) AS ?u) WHERE { ?x :r_regionkey ?k ; :r_name ?n }", "select cast(r_regionkey as bigint) as k, replace(r_name, ' ', '%20') || '%20a%2A~%2Fb' as u from region"),
    "regex": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_type ?t FILTER(REGEX(?t, \"^[a-m].*M\", \"i\")) }", "select p_partkey as k from part where regexp_matches(p_type, '(?i)^[a-m].*m')"),
    "replace": ("SELECT ?k (REPLACE(?n, \"([A-Z])([a-z]+)\", \"$2$1\") AS ?r) WHERE { ?p :p_partkey ?k ; :p_name ?n }", "select p_partkey as k, regexp_replace(p_name, '([A-Z])([a-z]+)', '\\2\\1', 'g') as r from part"),
    "hashes": ("SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) WHERE { ?x :n_nationkey ?k ; :n_name ?n }", "select cast(n_nationkey as bigint) as k, md5(n_name) as m, sha1(n_name) as s, sha256(n_name) as t from nation"),
    "hash_lengths": ("SELECT ?k (STRLEN(SHA224(?n)) AS ?a) (STRLEN(SHA384(?n)) AS ?b) (STRLEN(SHA512(?n)) AS ?c) WHERE { ?x :n_nationkey ?k ; :n_name ?n }", "select cast(n_nationkey as bigint) as k, cast(56 as bigint) as a, cast(96 as bigint) as b, cast(128 as bigint) as c from nation"),
    "numeric_functions": ("SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }", "select c_custkey as k, abs(c_acctbal) as a, ceil(c_acctbal) as c, floor(c_acctbal) as f, floor(c_acctbal + 0.5) as r from customer"),
    "date_parts": ("SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (xsd:double(SECONDS(?d)) AS ?s) WHERE { ?e :event_id ?k ; :ts ?d }", "select event_id as k, year(ts) as y, month(ts) as m, day(ts) as dd, hour(ts) as h, minute(ts) as mi, cast(strftime(ts, '%S.%f') as double) as s from events"),
    "tz_timezone": ("SELECT ?k (TZ(?d) AS ?z) (STR(TIMEZONE(?d)) AS ?t) WHERE { ?e :event_id ?k ; :ts ?d }", "select event_id as k, 'Z' as z, 'PT0S' as t from events"),
    "unixtime": ("SELECT ?k (TO_UNIXTIME(?d) AS ?t) WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d }", "select o_orderkey as k, cast(floor(epoch(o_orderdate)) as bigint) as t from orders"),
    "date_filter": ("SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d FILTER(?d >= \"1995-01-01T00:00:00Z\"^^xsd:dateTime && ?d < \"1995-07-01T00:00:00Z\"^^xsd:dateTime) }", "select o_orderkey as k from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-07-01'"),
    "casts": ("SELECT ?k (xsd:string(?s) AS ?a) (xsd:double(?s) AS ?b) (xsd:integer(?r) AS ?c) (xsd:boolean(?s) AS ?d) (xsd:integer(\"x\") AS ?e) WHERE { ?p :p_partkey ?k ; :p_size ?s ; :p_retailprice ?r }", "select p_partkey as k, cast(p_size as varchar) as a, cast(p_size as double) as b, cast(trunc(p_retailprice) as bigint) as c, p_size <> 0 as d, cast(null as bigint) as e from part"),
    "cast_more": ("SELECT ?k (xsd:double(xsd:decimal(?r)) AS ?a) (STR(xsd:date(?d)) AS ?b) (DATATYPE(xsd:float(?r)) AS ?c) (xsd:dateTime(CONCAT(SUBSTR(STR(?d), 1, 10), \"T00:00:00Z\")) = ?d AS ?e) WHERE { ?o :o_orderkey ?k ; :o_totalprice ?r ; :o_orderdate ?d }", "select o_orderkey as k, o_totalprice as a, strftime(o_orderdate, '%Y-%m-%d') as b, 'http://www.w3.org/2001/XMLSchema#float' as c, o_orderdate = date_trunc('day', o_orderdate) as e from orders"),
    "constant_forms": ("SELECT ?k (STR(1.50) AS ?a) (STR(\"01\"^^xsd:integer) AS ?b) (DATATYPE(\"1.5\"^^xsd:float) AS ?c) (sameTerm(1.5, 1.50) AS ?d) (1.50 = 1.5 AS ?e) (STR(1e1) AS ?f) (?s * 1.50 > 30 AS ?g) WHERE { ?p :p_partkey ?k ; :p_size ?s }", "select p_partkey as k, '1.50' as a, '01' as b, 'http://www.w3.org/2001/XMLSchema#float' as c, false as d, true as e, '1e1' as f, p_size * 1.5 > 30 as g from part"),
    "values_forms": ("SELECT (STR(?v) AS ?t) WHERE { { VALUES ?v { 1.50 1e1 \"01\"^^xsd:integer 7 } } { VALUES ?v { 1.50 1.5 1e1 10 1 7 } } }", "select unnest(['1.50', '1e1', '7']) as t"),
    "numeric_extremes": ("SELECT ?k (STR(CEIL(xsd:double(\"INF\"))) AS ?a) (STR(FLOOR(xsd:double(\"NaN\"))) AS ?b) (ROUND(?x * 1e300) = ?x * 1e300 AS ?c) WHERE { ?p :p_partkey ?k ; :p_retailprice ?x }", "select p_partkey as k, 'INF' as a, 'NaN' as b, true as c from part"),
    "substr_extremes": ("SELECT ?k (SUBSTR(?n, 1e300) AS ?a) (SUBSTR(?n, xsd:double(\"NaN\")) AS ?b) (SUBSTR(?n, -5, 8) AS ?c) (SUBSTR(?n, 2, 1e300) AS ?d) WHERE { ?p :p_partkey ?k ; :p_name ?n }", "select p_partkey as k, '' as a, '' as b, substr(p_name, 1, 2) as c, substr(p_name, 2) as d from part"),
    "regex_bad_pattern": ("SELECT ?k (BOUND(?x) AS ?a) (BOUND(?y) AS ?b) (BOUND(?z) AS ?c) (REGEX(?n, CONCAT(\"^\", ?t), \"i\") AS ?d) WHERE { ?p :p_partkey ?k ; :p_name ?n ; :p_type ?t BIND(REGEX(?n, CONCAT(\"(\", ?t)) AS ?x) BIND(REPLACE(?n, \"(a)\", \"$2\") AS ?y) BIND(REPLACE(?n, \"[\", \"\") AS ?z) }", "select p_partkey as k, false as a, false as b, false as c, starts_with(lower(p_name), lower(p_type)) as d from part"),
    "from_unixtime": ("SELECT ?k (STR(FROM_UNIXTIME(?k * 86400)) AS ?t) (BOUND(?x) AS ?bad) WHERE { ?o :o_orderkey ?k BIND(FROM_UNIXTIME(1e300) AS ?x) }", "select o_orderkey as k, strftime(timestamp '1970-01-01' + to_days(cast(o_orderkey as integer)), '%Y-%m-%dT%H:%M:%SZ') as t, false as bad from orders"),
    "current_datetime": ("SELECT ?k (CURRENT_DATETIME() = NOW() AS ?same) WHERE { ?x :r_regionkey ?k }", "select cast(r_regionkey as bigint) as k, true as same from region"),
    "concat_languages": ("SELECT ?k (LANG(CONCAT(?a, ?b)) AS ?l) (STR(CONCAT(?a, ?b)) AS ?t) WHERE { ?x :doc_id ?k ; :lang ?g ; :source ?s BIND(STRLANG(?s, ?g) AS ?a) BIND(STRLANG(\"-\", \"en\") AS ?b) }", "select doc_id as k, case when lower(lang) = 'en' then lang else '' end as l, source || '-' as t from documents where lang is not null and source is not null"),
    "blank_node_list": ("SELECT ?n ?r WHERE { [ :n_regionkey [ :r_name ?r ] ; :n_name ?n ] }", "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey"),
    "base_iri": ("BASE <http://example.org/> SELECT ?n WHERE { ?x <n_name> ?n ; <n_regionkey> <region/2> }", "select n_name as n from nation where n_regionkey = 2"),
    "extension_function": ("SELECT ?k (:reversed(?n) AS ?r) WHERE { ?p :p_partkey ?k ; :p_name ?n }", "select p_partkey as k, reverse(p_name) as r from part"),
    "user_aggregate": ("SELECT ?b (:longest(?n) AS ?l) (COUNT(*) AS ?c) WHERE { ?p :p_brand ?b ; :p_name ?n } GROUP BY ?b", "select p_brand as b, cast(max(length(p_name)) as bigint) as l, count(*) as c from part group by p_brand"),
    # EXISTS with variables of the outer row at any depth
    "exists_union": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER EXISTS { { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 60) } UNION { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < ?b / 2) } } }", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and (o_totalprice > c_acctbal * 60 or o_totalprice < c_acctbal / 2))"),
    "not_exists_union": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER NOT EXISTS { { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 60) } UNION { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < ?b / 2) } } }", "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and (o_totalprice > c_acctbal * 60 or o_totalprice < c_acctbal / 2))"),
    "exists_optional": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER EXISTS { ?c :c_nationkey ?n OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 60) } FILTER(!BOUND(?t)) } }", "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)"),
    "not_exists_optional": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER NOT EXISTS { ?c :c_nationkey ?n OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 60) } FILTER(!BOUND(?t)) } }", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)"),
    "exists_nested": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER EXISTS { ?o :o_custkey ?c FILTER NOT EXISTS { ?o :o_totalprice ?t FILTER(?t > ?b * 20) } } }", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and not (o_totalprice > c_acctbal * 20))"),
    "not_exists_nested": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER NOT EXISTS { ?o :o_custkey ?c FILTER NOT EXISTS { ?o :o_totalprice ?t FILTER(?t > ?b * 20) } } }", "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and not (o_totalprice > c_acctbal * 20))"),
    "exists_graph": (f"SELECT ?k WHERE {{ ?c :c_custkey ?k ; :c_acctbal ?b ; :c_nationkey ?n FILTER EXISTS {{ GRAPH <{BASE}supplier> {{ ?s :s_nationkey ?n ; :s_acctbal ?t FILTER(?t > ?b) }} }} }}", "select c_custkey as k from customer where exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal > c_acctbal)"),
    "not_exists_graph": (f"SELECT ?k WHERE {{ ?c :c_custkey ?k ; :c_acctbal ?b ; :c_nationkey ?n FILTER NOT EXISTS {{ GRAPH <{BASE}supplier> {{ ?s :s_nationkey ?n ; :s_acctbal ?t FILTER(?t > ?b) }} }} }}", "select c_custkey as k from customer where not exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal > c_acctbal)"),
    "exists_in_or_outer": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_acctbal ?b FILTER(?b > 9500 || EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 60) }) }", "select c_custkey as k from customer where c_acctbal > 9500 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)"),
    "exists_selected": ("SELECT ?k (EXISTS { ?o :o_custkey ?c ; :o_orderstatus \"P\" } AS ?e) WHERE { ?c :c_custkey ?k }", "select c_custkey as k, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as e from customer"),
    # groups
    "avg_overflow": ("SELECT ?m (AVG(?b) > 900000000000000000 AS ?ok) (BOUND(?s) AS ?fits) WHERE { { SELECT ?m ?b WHERE { ?c :c_custkey ?k ; :c_mktsegment ?m BIND(?k + 900000000000000000 AS ?b) } } { SELECT (SUM(?b2) AS ?s) WHERE { ?c2 :c_custkey ?k2 BIND(?k2 + 900000000000000000 AS ?b2) } } } GROUP BY ?m ?s", "select c_mktsegment as m, true as ok, false as fits from customer group by c_mktsegment"),
    "sum_distinct_overflow": ("SELECT ?m (AVG(DISTINCT ?b) > 900000000000000000 AS ?ok) (COALESCE(SUM(DISTINCT ?b), -1) AS ?s) WHERE { ?c :c_custkey ?k ; :c_mktsegment ?m BIND(?k + 900000000000000000 AS ?b) } GROUP BY ?m", "select c_mktsegment as m, true as ok, cast(-1 as bigint) as s from customer group by c_mktsegment"),
    "count_forms": ("SELECT (COUNT(*) AS ?n) (COUNT(?s) AS ?a) (COUNT(DISTINCT ?s) AS ?d) WHERE { ?c :c_mktsegment ?s }", "select count(*) as n, count(c_mktsegment) as a, count(distinct c_mktsegment) as d from customer"),
    "count_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?o :o_orderstatus ?s ; :o_custkey ?c }", "select count(*) as n from (select distinct o_orderkey, o_orderstatus, o_custkey from orders)"),
    "sum_avg_min_max": ("SELECT ?f (SUM(?z) AS ?sum) (ROUND(xsd:double(AVG(?z)) * 1000) / 1000 AS ?avg) (MIN(?z) AS ?min) (MAX(?z) AS ?max) WHERE { ?p :p_brand ?f ; :p_size ?z } GROUP BY ?f", "select p_brand as f, cast(sum(p_size) as bigint) as sum, floor(avg(p_size) * 1000 + 0.5) / 1000 as avg, cast(min(p_size) as bigint) as min, cast(max(p_size) as bigint) as max from part group by p_brand"),
    "aggregate_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?t) WHERE { ?p :p_size ?s FILTER(?s > 1000) }", "select cast(0 as bigint) as n, cast(0 as bigint) as t"),
    "group_concat": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?names) WHERE { ?x :n_regionkey ?y ; :n_name ?n . ?y :r_name ?r } GROUP BY ?r", "select r_name as r, string_agg(n_name, '|' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by r_name"),
    "group_concat_distinct": ("SELECT (GROUP_CONCAT(DISTINCT ?s; SEPARATOR=\",\") AS ?all) WHERE { ?c :c_mktsegment ?s }", "select string_agg(s, ',' order by s) as \"all\" from (select distinct c_mktsegment as s from customer)"),
    "sample": ("SELECT ?r (COUNT(*) AS ?n) (SAMPLE(?r) AS ?s) WHERE { ?x :n_regionkey ?y . ?y :r_name ?r } GROUP BY ?r", "select r_name as r, count(*) as n, r_name as s from nation join region on n_regionkey = r_regionkey group by r_name"),
    "sum_distinct": ("SELECT ?b (SUM(DISTINCT ?z) AS ?t) WHERE { ?p :p_brand ?b ; :p_size ?z } GROUP BY ?b", "select p_brand as b, cast(sum(distinct p_size) as bigint) as t from part group by p_brand"),
    "group_by_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "select year(o_orderdate) as y, count(*) as n from orders group by 1"),
    "having": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :o_custkey ?x . ?x :c_custkey ?c } GROUP BY ?c HAVING(COUNT(*) > 12 && MAX(?c) > 10)", "select o_custkey as c, count(*) as n from orders group by 1 having count(*) > 12 and o_custkey > 10"),
    "aggregate_expression": ("SELECT ?b (MAX(?z) - MIN(?z) AS ?spread) WHERE { ?p :p_brand ?b ; :p_size ?z } GROUP BY ?b", "select p_brand as b, cast(max(p_size) - min(p_size) as bigint) as spread from part group by p_brand"),
    # modifiers
    "distinct": ("SELECT DISTINCT ?s ?f WHERE { ?l :l_linestatus ?s ; :l_returnflag ?f }", "select distinct l_linestatus as s, l_returnflag as f from lineitem"),
    "reduced": ("SELECT REDUCED ?s WHERE { ?c :c_mktsegment ?s }", "select distinct c_mktsegment as s from customer"),
    "order_limit_offset": ("SELECT ?k ?t WHERE { ?o :o_orderkey ?k ; :o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20 OFFSET 5", "select o_orderkey as k, o_totalprice as t from orders order by t desc, k limit 20 offset 5"),
    "order_hidden": ("SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b } ORDER BY ?b ?n LIMIT 7", "select c_name as n from customer order by c_acctbal, c_name limit 7"),
    "order_unbound_first": ("SELECT ?k ?r WHERE { ?n :n_nationkey ?k OPTIONAL { ?x :r_regionkey ?k ; :r_name ?r } } ORDER BY ?r DESC(?k) LIMIT 6", "select cast(n_nationkey as bigint) as k, r_name as r from nation left join region on r_regionkey = n_nationkey order by r nulls first, k desc limit 6"),
    "limit_zero": ("SELECT ?n WHERE { ?c :c_name ?n } LIMIT 0", "select c_name as n from customer limit 0"),
    "select_star": ("SELECT * WHERE { ?x :r_regionkey ?k ; :r_name ?n }", f"select '{BASE}region/' || r_regionkey as x, cast(r_regionkey as bigint) as k, r_name as n from region"),
    # other forms
    "ask_yes": ("ASK { ?c :c_acctbal ?b FILTER(?b > 9000) }", "select count(*) > 0 as answer from customer where c_acctbal > 9000"),
    "ask_no": ("ASK { ?c :c_acctbal ?b FILTER(?b > 900000) }", "select count(*) > 0 as answer from customer where c_acctbal > 900000"),
    "construct": ("CONSTRUCT { ?x :in ?r . ?r :label ?n } WHERE { ?x :n_name ?n ; :n_regionkey ?r }", f"select '{BASE}nation/' || n_nationkey as s, '{BASE}in' as p, '{BASE}region/' || n_regionkey as o from nation union all select '{BASE}region/' || n_regionkey, '{BASE}label', n_name from nation"),
    "construct_where": ("CONSTRUCT WHERE { ?x :r_name ?n }", f"select '{BASE}region/' || r_regionkey as s, '{BASE}r_name' as p, r_name as o from region"),
    "describe": (f"DESCRIBE <{BASE}region/2>", f"select '{BASE}region/2' as s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, '{BASE}region' as o union all select '{BASE}region/2', '{BASE}r_regionkey', '2' union all select '{BASE}region/2', '{BASE}r_name', r_name from region where r_regionkey = 2"),
    "random_functions": ("SELECT ?k (RAND() < 1 AS ?r) (STRLEN(STRUUID()) AS ?u) (STRSTARTS(STR(UUID()), \"urn:uuid:\") AS ?v) (isBLANK(BNODE()) AS ?b) (YEAR(NOW()) > 2000 AS ?n) WHERE { ?x :r_regionkey ?k }", "select cast(r_regionkey as bigint) as k, true as r, cast(36 as bigint) as u, true as v, true as b, true as n from region"),
}
#: Tables whose triples make the plain quads, and their columns.
QUAD_TABLES = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
}
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_PER_PREDICATE = " union all ".join(f"select '{p}' as p, count(*) as n from {t}" for t, columns in QUAD_TABLES.items() for p in (RDF_TYPE, *(BASE + c for c in columns)))
#: The same engine over plain quads of those tables: cells are terms, patterns are joins of quad scans.
QUAD_QUERIES: dict[str, tuple[str, str | None]] = {
    "quads_bgp": ("SELECT ?n ?r WHERE { ?x :n_regionkey ?y ; :n_name ?n . ?y :r_name ?r }", "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey"),
    "quads_path": ("SELECT ?o ?n WHERE { ?x :o_custkey ?c ; :o_orderkey ?o . ?c :c_nationkey ?y . ?y :n_name ?n }", "select cast(o_orderkey as varchar) as o, n_name as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"),
    "quads_any_predicate": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", f"select p, cast(sum(n) as bigint) as n from ({_PER_PREDICATE}) group by p"),
    "quads_numeric_filter": ("SELECT ?n WHERE { ?x :c_custkey ?k ; :c_name ?n FILTER(?k * 2 >= 20 && ?k < 155.5) }", "select c_name as n from customer where c_custkey * 2 >= 20 and c_custkey < 155.5"),
    "quads_aggregate": ("SELECT ?y (SUM(?k) AS ?t) (MIN(?n) AS ?a) (COUNT(?k) AS ?c) WHERE { ?x :c_custkey ?k ; :c_name ?n ; :c_nationkey ?y } GROUP BY ?y", f"select '{BASE}nation/' || c_nationkey as y, cast(cast(sum(c_custkey) as bigint) as varchar) as t, min(c_name) as a, count(*) as c from customer group by c_nationkey"),
    "quads_all_aggregates": ("SELECT ?y (COUNT(DISTINCT ?m) AS ?c) (SUM(?k) AS ?s) (ROUND(xsd:double(AVG(?k)) * 1000) / 1000 AS ?a) (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?names) (SAMPLE(?n) AS ?one) (GROUP_CONCAT(DISTINCT ?m; SEPARATOR=\",\") AS ?segments) WHERE { ?x :c_custkey ?k ; :c_name ?n ; :c_nationkey ?y ; :c_mktsegment ?m } GROUP BY ?y", f"select '{BASE}nation/' || c_nationkey as y, count(distinct c_mktsegment) as c, cast(cast(sum(c_custkey) as bigint) as varchar) as s, floor(avg(c_custkey) * 1000 + 0.5) / 1000 as a, min(c_name) as lo, max(c_name) as hi, string_agg(c_name, '|' order by c_name) as names, min(c_name) as one, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments from customer group by c_nationkey"),
    "quads_optional": ("SELECT ?n ?o WHERE { ?x :c_name ?n OPTIONAL { ?y :o_custkey ?x ; :o_orderstatus \"P\" ; :o_orderkey ?o } }", "select c_name as n, cast(o_orderkey as varchar) as o from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P'"),
    "quads_minus": ("SELECT ?k WHERE { ?x :c_custkey ?k MINUS { ?y :s_suppkey ?k } }", "select cast(c_custkey as varchar) as k from customer where c_custkey not in (select s_suppkey from supplier)"),
    "quads_exists": ("SELECT ?k WHERE { ?x :s_suppkey ?k ; :s_acctbal ?b FILTER NOT EXISTS { ?y :c_custkey ?k ; :c_acctbal ?t FILTER(?t > ?b) } }", "select cast(s_suppkey as varchar) as k from supplier where not exists (select 1 from customer where c_custkey = s_suppkey and c_acctbal > s_acctbal)"),
    "quads_order": ("SELECT ?k WHERE { ?x :o_orderkey ?k } ORDER BY DESC(?k) LIMIT 4", "select cast(o_orderkey as varchar) as k from orders order by o_orderkey desc limit 4"),
    "quads_graph": ("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?c } } GROUP BY ?g", " union all ".join(f"select '{BASE}{t}' as g, count(*) as n from {t}" for t in QUAD_TABLES)),
    "quads_from": (f"SELECT ?n FROM <{BASE}customer> WHERE {{ ?s :c_name ?n }}", "select c_name as n from customer"),
    "quads_from_named": (f"SELECT ?g ?n FROM NAMED <{BASE}region> FROM NAMED <{BASE}nation> WHERE {{ GRAPH ?g {{ ?s :n_name ?n }} }}", f"select '{BASE}nation' as g, n_name as n from nation"),
    "quads_distinct": ("SELECT DISTINCT ?y ?m WHERE { ?x :c_nationkey ?y ; :c_mktsegment ?m }", f"select distinct '{BASE}nation/' || c_nationkey as y, c_mktsegment as m from customer"),
    "quads_values": ("SELECT ?n ?b WHERE { ?x :c_name ?n ; :c_mktsegment ?m ; :c_acctbal ?b VALUES (?m) { (\"BUILDING\") (\"MACHINERY\") } FILTER(?b > 9000.0) }", "select c_name as n, cast(c_acctbal as varchar) as b from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal > 9000"),
}


def _result(engine: Engine, text: str) -> DataFrame:
    p = engine.prepare(PREFIX + text)
    if p.query.form == "select":
        return p.dataframe()
    if p.query.form == "ask":
        return p.ask_dataframe()
    return p.graph().select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


def _over_tables(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _result(Engine(spark, mapping(spark, sf_dir), warn=False), text)


def _quads(spark: SparkSession, sf_dir: str, graphs: bool = False) -> DataFrame:
    quads = mapping(spark, sf_dir, tuple(QUAD_TABLES)).quads()
    return quads if graphs else quads.withColumn("g", F.lit(None).cast("string"))


def _over_quads(text: str) -> Callable[[SparkSession, str], DataFrame]:
    graphs = "GRAPH" in text or "FROM" in text
    return lambda spark, sf_dir: _result(Engine(spark, QuadsFrame(_quads(spark, sf_dir, graphs)), warn=False), text)


def _after(update: str, query: str, graphs: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """The answer to ``query`` after a sequence of updates of the quads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, QuadsFrame(_quads(spark, sf_dir, graphs)), warn=False)
        engine.update(PREFIX + update)
        return _result(engine, query)

    return run


class _Suppliers:
    """A service client that answers from here, as an endpoint would: names of two regions and a note on each."""

    def select(self, endpoint: str, query: str) -> list[dict]:
        return [{"n": Lit("ASIA"), "note": Lit("east")}, {"n": Lit("EUROPE"), "note": Lit("west")}]


def serviced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a service joined with a table."""
    engine = Engine(spark, mapping(spark, sf_dir), service=_Suppliers(), warn=False)
    return _result(engine, "SELECT ?k ?note WHERE { ?r :r_name ?n . ?x :n_regionkey ?r ; :n_nationkey ?k SERVICE <http://e/s> { ?n :note ?note } }")


def bound_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared query that runs with a variable bound from outside."""
    q = Engine(spark, mapping(spark, sf_dir), warn=False).prepare(PREFIX + "SELECT ?k WHERE { ?c :c_custkey ?k ; :c_mktsegment ?m FILTER(?m = ?wanted) }")
    return q.dataframe({"wanted": Lit("BUILDING")})


#: Updates, the query that looks at what they made, whether tables are named graphs, and SQL.
UPDATES: dict[str, tuple[str, str, bool, str]] = {
    "update_sequence": (
        "DELETE { ?x :c_name ?n } INSERT { ?x :label ?n } WHERE { ?x :c_name ?n }; INSERT DATA { :new :label \"new\" }; DELETE DATA { :new :label \"none\" }",
        "SELECT ?x ?n WHERE { { ?x :label ?n } UNION { ?x :c_name ?n } }",
        False,
        f"select '{BASE}customer/' || c_custkey as x, c_name as n from customer union all select '{BASE}new', 'new'",
    ),
    "update_insert_twice": (
        "INSERT DATA { :new :label \"new\" . :new :label \"new\" }; INSERT DATA { :new :label \"new\" }; INSERT { ?x a ?t . ?x :seen true } WHERE { ?x a ?t }",
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(?p IN (:label, :seen, <http://www.w3.org/1999/02/22-rdf-syntax-ns#type>)) } GROUP BY ?p",
        False,
        f"with n as (select sum(n) as n from ({' union all '.join(f'select count(*) as n from {t}' for t in QUAD_TABLES)})) select '{BASE}label' as p, cast(1 as bigint) as n union all select '{BASE}seen', cast(n as bigint) from n union all select '{RDF_TYPE}', cast(n as bigint) from n",
    ),
    "update_delete_data": ("DELETE DATA { <http://example.org/region/1> a :region . <http://example.org/region/2> a :region }; DELETE WHERE { ?x a :nation ; :n_name ?n }", "SELECT ?x ?t WHERE { ?x a ?t FILTER(?t IN (:region, :nation)) }", False, f"select '{BASE}region/' || r_regionkey as x, '{BASE}region' as t from region where r_regionkey not in (1, 2)"),
    "update_with_modify": (f"WITH <{BASE}customer> DELETE {{ ?x :c_mktsegment ?m }} INSERT {{ ?x :segment ?m }} WHERE {{ ?x :c_mktsegment ?m FILTER(?m != \"BUILDING\") }}", "SELECT ?g ?p (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x ?p ?m FILTER(?p IN (:segment, :c_mktsegment)) } } GROUP BY ?g ?p", True, f"select '{BASE}customer' as g, case when c_mktsegment = 'BUILDING' then '{BASE}c_mktsegment' else '{BASE}segment' end as p, count(*) as n from customer group by 1, 2"),
    "update_graphs": (
        f"COPY <{BASE}region> TO :copy; ADD <{BASE}nation> TO :copy; ADD <{BASE}nation> TO :copy; MOVE <{BASE}supplier> TO :moved; CLEAR GRAPH <{BASE}orders>; DROP GRAPH <{BASE}customer>; CREATE GRAPH :empty",
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?c } } GROUP BY ?g",
        True,
        f"select '{BASE}region' as g, count(*) as n from region union all select '{BASE}nation', count(*) from nation union all select '{BASE}moved', count(*) from supplier union all select '{BASE}copy', (select count(*) from region) + (select count(*) from nation)",
    ),
    "update_collection": ("INSERT DATA { :list :items (1 2 3) }", "SELECT ?a ?b ?c WHERE { ?x :items (?a ?b ?c) }", False, "select '1' as a, '2' as b, '3' as c"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {n: _over_tables(t) for n, (t, _) in TABLE_QUERIES.items()} | {n: _over_quads(t) for n, (t, _) in QUAD_QUERIES.items()} | {n: _after(u, q, graphs) for n, (u, q, graphs, _) in UPDATES.items()}
    | {"service": serviced, "initial_bindings": bound_before}
)
ORACLES = {n: sql for n, (_, sql) in (TABLE_QUERIES | QUAD_QUERIES).items() if sql} | {n: sql for n, (*_, sql) in UPDATES.items()}
ORACLES |= {
    "service": "select cast(n_nationkey as bigint) as k, case r_name when 'ASIA' then 'east' else 'west' end as note from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')",
    "initial_bindings": "select c_custkey as k from customer where c_mktsegment = 'BUILDING'",
}
