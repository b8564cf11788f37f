"""Queries of the path engine over document views of the tables, and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.model import V
from .plans.parser import flags_of, parse
from .sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_VIEWS = {"T": T.customers, "O": T.orders, "C": T.conversations, "E": T.events, "D": T.texts}


def path_query(name: str, view: str, expression: str, sql: str, kind: str = "eval", cast: str | None = None, drop_pos: bool = False) -> None:
    """An expression over a view: every item (eval), one item (single) or an effective boolean value (boolean) per document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # where no position of a line comes out, only the flags that the expression names are read
        free = view in ("T", "O") and (drop_pos or kind != "eval")
        docs = _VIEWS[view](Engine(spark), sf_dir, *([flags_of(parse(expression))] if free else []))
        out = getattr(docs, {"eval": "eval", "single": "eval_single", "boolean": "eval_boolean"}[kind])(expression)
        out = out.withColumn("value", F.col("value").cast(cast)) if cast else out
        return out.drop("pos") if drop_pos else out

    QUERIES[name], ORACLES[name] = run, sql


def row_query(name: str, table: str, keys: list[str], columns: dict[str, tuple], sql: str) -> None:
    """Expressions over the scalar columns of a table: output column = (expression, {variable: (item type, SQL of the column)}, cast)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        eng = Engine(spark)
        out = []
        for c, (expression, variables, cast) in columns.items():
            v = eng.value(expression, **{n: (t, F.expr(x)) for n, (t, x) in variables.items()})
            col = v.col if v.t != "empty" else F.lit(None).cast("string")
            out.append((col.cast(cast) if cast else col).alias(c))
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, *out)

    QUERIES[name], ORACLES[name] = run, sql


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_ROW = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

# navigation
path_query("child_step", "T", "order/line/@extendedprice", f"SELECT o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, {_ROW}) AS pos, l_extendedprice AS value FROM {_LINES}")
path_query("descendant_step", "T", "//line/@partkey", f"SELECT o_custkey AS c_custkey, l_partkey AS value FROM {_LINES}", drop_pos=True)
path_query("parent_step", "O", "line/../@orderkey", "SELECT o_orderkey, o_orderkey AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", drop_pos=True)
path_query("ancestor_step", "T", "//line/ancestor::order/@orderkey", "SELECT o_custkey AS c_custkey, o_orderkey AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", drop_pos=True)
path_query("self_step", "C", "turn/self::turn/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM conversations")
path_query("wildcard_flags", "D", "count(@*)", "SELECT doc_id, CAST(4 AS BIGINT) - (lang IS NULL)::BIGINT - (source IS NULL)::BIGINT AS value FROM documents", "single", "bigint")
path_query("absolute_path", "C", "/conversation/turn/@role", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role AS value FROM conversations")
path_query("following_sibling", "C", "turn/following-sibling::turn[1]/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY value) AS pos, value FROM (SELECT conv_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS value FROM conversations) WHERE value IS NOT NULL")
path_query("preceding_sibling", "C", "turn/preceding-sibling::turn[1]/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY value) AS pos, value FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS value FROM conversations) WHERE value IS NOT NULL")
path_query("following_axis", "C", "turn[2]/following::turn/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 2")
path_query("preceding_axis", "C", "turn[3]/preceding::turn/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE n < 3 AND m >= 3")
path_query("simple_map", "C", "turn ! string-length(.)", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CAST(length(text) AS BIGINT) AS value FROM conversations")
path_query("range_sequence", "C", "for $i in 1 to count(turn) return $i * 2", "SELECT conv_id, pos, pos * 2 AS value FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)")
path_query("single_child_step", "E", "props/@k", "SELECT event_id, CAST(1 AS BIGINT) AS pos, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")

# nodes of several places of the model, in one order
_MIXED = f"SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, name = 'line', {_ROW}) AS pos, count(*) OVER (PARTITION BY o_custkey) AS m, * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, 'order' AS name, NULL AS l_orderkey, NULL AS l_linenumber, NULL AS l_partkey, NULL AS l_suppkey, NULL AS l_quantity, NULL AS l_extendedprice, NULL AS l_discount, NULL AS l_tax, NULL AS l_returnflag, NULL AS l_linestatus, NULL AS l_shipdate FROM orders UNION ALL SELECT o_custkey, o_orderkey, NULL, 'line', l_orderkey, {_ROW} FROM {_LINES})"
path_query("mixed_map", "T", "(order | order/line) ! name(.)", f"SELECT c AS c_custkey, pos, name AS value FROM ({_MIXED})")
path_query("mixed_for", "T", "for $n in (order | order/line) return concat(name($n), $n/@partkey)", f"SELECT c AS c_custkey, pos, name || coalesce(CAST(l_partkey AS VARCHAR), '') AS value FROM ({_MIXED})")
path_query("mixed_position", "T", "(order | order/line) ! (position() * 1000 + last())", f"SELECT c AS c_custkey, pos, pos * 1000 + m AS value FROM ({_MIXED})")
path_query("mixed_second", "T", "(order | order/line)[2]/name(.)", f"SELECT c AS c_custkey, CAST(1 AS BIGINT) AS pos, name AS value FROM ({_MIXED}) WHERE pos = 2")
path_query("mixed_last", "T", "(order | order/line)[position() > last() - 2] ! name(.)", f"SELECT c AS c_custkey, row_number() OVER (PARTITION BY c ORDER BY pos) AS pos, name AS value FROM ({_MIXED}) WHERE pos > m - 2")
path_query("mixed_filter", "T", "(order | order/line)[@returnflag = 'R' or @orderstatus = 'F'] ! name(.)", f"SELECT c AS c_custkey, row_number() OVER (PARTITION BY c ORDER BY pos) AS pos, name AS value FROM ({_MIXED}) WHERE l_returnflag = 'R' OR o_orderstatus = 'F'")
path_query("mixed_none", "T", "count((order | order/line)[@lastname])", "SELECT c_custkey, CAST(0 AS BIGINT) AS value FROM customer", "single")
path_query("mixed_reverse", "T", "reverse((order | order/line)) ! name(.)", f"SELECT c AS c_custkey, m - pos + 1 AS pos, name AS value FROM ({_MIXED})")
path_query("mixed_tail", "T", "string-join(tail((order | order/line)) ! name(.), '')", f"SELECT c_custkey, coalesce(string_agg(name, '' ORDER BY pos) FILTER (WHERE pos > 1), '') AS value FROM customer LEFT JOIN ({_MIXED}) ON c = c_custkey GROUP BY c_custkey", "single")
path_query("comma_order", "T", "(order/line, order) ! name(.)", f"SELECT c AS c_custkey, row_number() OVER (PARTITION BY c ORDER BY name, pos) AS pos, name AS value FROM ({_MIXED})")
path_query("nested_union", "T", "for $o in order return ($o/line | $o) ! name(.)", f"SELECT c AS c_custkey, pos, name AS value FROM ({_MIXED})")
path_query("wildcard_second", "T", "//*[2]/name(.)", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey, k) AS pos, name AS value FROM (SELECT o_custkey AS c_custkey, o_orderkey, 1 AS k, 'order' AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 2 UNION ALL SELECT o_custkey, o_orderkey, 2, 'line' FROM {_LINES} GROUP BY o_custkey, o_orderkey HAVING count(*) > 1)")

# filters
path_query("pred_filter", "T", "order[@orderstatus = 'F']/@orderkey", "SELECT o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey AS value FROM orders WHERE o_orderstatus = 'F'")
path_query("pred_chain", "T", "order[@orderstatus = 'F'][2]/@orderkey", "SELECT o_custkey AS c_custkey, CAST(1 AS BIGINT) AS pos, o_orderkey AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 2")
path_query("pred_position", "C", "turn[1]/@role", "SELECT conv_id, CAST(1 AS BIGINT) AS pos, role AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1")
path_query("pred_last", "C", "turn[last()]/@turn", "SELECT conv_id, CAST(1 AS BIGINT) AS pos, max(turn) AS value FROM conversations GROUP BY conv_id")
path_query("pred_position_range", "C", "turn[position() > 1 and position() < last()]/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE n > 1 AND n < m")
path_query("general_cmp", "O", "@totalprice < line/@extendedprice", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND o_totalprice < l_extendedprice) AS value FROM orders", "boolean")
path_query("value_cmp", "O", "@orderstatus eq 'P'", "SELECT o_orderkey, o_orderstatus = 'P' AS value FROM orders", "boolean")
path_query("logic_ops", "O", "@orderstatus = 'F' and @totalprice > 1000 or not(line)", "SELECT o_orderkey, (o_orderstatus = 'F' AND o_totalprice > 1000) OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS value FROM orders", "boolean")
path_query("semi_some", "O", "some $l in line satisfies $l/@quantity > 45", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS value FROM orders", "boolean")
path_query("anti_every", "O", "every $l in line satisfies $l/@quantity > 5", "SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity > 5) AS value FROM orders", "boolean")
path_query("exists_empty", "O", "empty(line)", "SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS value FROM orders", "boolean")

# joins, control flow, sets
path_query("theta_for", "C", "for $a in turn, $b in turn return if ($a/@turn < $b/@turn) then $a/@turn * 100 + $b/@turn else ()", "SELECT a.conv_id, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn, b.turn) AS pos, a.turn * 100 + b.turn AS value FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
path_query("equi_for", "O", "for $a in line return count(../conversation | line[@partkey = $a/@partkey])", "SELECT o_orderkey, value FROM (SELECT a.l_orderkey AS o_orderkey, count(*) AS value FROM (SELECT *, row_number() OVER () AS n FROM lineitem) a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY a.l_orderkey, a.n)", drop_pos=True)
path_query("let_if", "O", "let $p := @totalprice return if ($p > 200000) then 'high' else if ($p > 100000) then 'middle' else 'low'", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS value FROM orders", "single")
path_query("group_idiom", "T", "for $k in distinct-values(order/@priority) return concat($k, '=', count(order[@priority = $k]))", "SELECT o_custkey AS c_custkey, o_orderpriority || '=' || count(*) AS value FROM orders GROUP BY o_custkey, o_orderpriority", drop_pos=True)
path_query("set_union", "C", "(turn[1] | turn[last()] | turn[1])/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS a, max(turn) OVER (PARTITION BY conv_id) AS b FROM conversations) WHERE turn IN (a, b)")
path_query("set_intersect", "C", "(turn[@role = 'user'] intersect turn[position() > 1])/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE role = 'user' AND n > 1")
path_query("set_except", "C", "(turn except turn[1])/@turn", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1")
path_query("arrow_chain", "C", "turn[1]/@role => upper-case() => concat('!')", "SELECT conv_id, upper(role) || '!' AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1", "single")
path_query("inline_function", "O", "let $f := function($x) { $x * 2 } return $f(@totalprice)", "SELECT o_orderkey, o_totalprice * 2 AS value FROM orders", "single")

# aggregation
for _n, _e, _s in (("count", "count(line)", "count(l_orderkey)"), ("sum", "sum(line/@quantity)", "coalesce(sum(l_quantity), 0)"), ("avg", "avg(line/@quantity)", "avg(l_quantity)"), ("min", "min(line/@extendedprice)", "min(l_extendedprice)"), ("max", "max(line/@extendedprice)", "max(l_extendedprice)")):
    path_query(f"order_{_n}", "O", _e, f"SELECT o_orderkey, {_s} AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "single")
path_query("agg_sum", "T", "round(sum(order/line/@extendedprice))", f"SELECT c_custkey, round_even(CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18, 4))), 0) AS DOUBLE), 0) AS value FROM customer LEFT JOIN ({_LINES}) ON o_custkey = c_custkey GROUP BY c_custkey", "single", "double")

# sequences
_TURNS = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations"
_SEQ = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS pos, turn AS value FROM (" + _TURNS + ") WHERE {where}"
path_query("distinct_values", "C", "distinct-values(turn/@role)", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS pos, role AS value FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role)")
path_query("index_of", "C", "index-of(turn/@role, 'user')", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS pos, n AS value FROM (" + _TURNS + ") WHERE role = 'user'")
path_query("reverse_seq", "C", "reverse(turn/@turn)", _SEQ.format(order="turn DESC", where="true"))
path_query("subsequence_seq", "C", "subsequence(turn/@turn, 2, 2)", _SEQ.format(order="turn", where="n BETWEEN 2 AND 3"))
path_query("head_seq", "C", "head(turn)/@turn", _SEQ.format(order="turn", where="n = 1"))
path_query("tail_seq", "C", "tail(turn)/@turn", _SEQ.format(order="turn", where="n > 1"))
path_query("remove_seq", "C", "remove(turn/@turn, 2)", _SEQ.format(order="turn", where="n <> 2"))
path_query("insert_seq", "C", "insert-before(turn/@turn, 1, 99)", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS pos, value FROM (SELECT conv_id, n AS k, turn AS value FROM (" + _TURNS + ") UNION ALL SELECT DISTINCT conv_id, 0, 99 FROM conversations)")
path_query("cardinality_seq", "C", "count((zero-or-one(turn[1]), one-or-more(turn), exactly-one(turn[last()])))", "SELECT conv_id, count(*) + 2 AS value FROM conversations GROUP BY conv_id", "single")
path_query("deep_equal", "C", "deep-equal(turn/@role, reverse(turn/@role))", "SELECT conv_id, list(role ORDER BY turn) = list(role ORDER BY turn DESC) AS value FROM conversations GROUP BY conv_id", "boolean")
path_query("innermost", "C", "innermost((. | turn))/@turn", _SEQ.format(order="turn", where="true"))
path_query("outermost", "C", "count(outermost((. | turn)))", "SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS value FROM conversations", "single")
path_query("node_path", "C", "turn[1]/path(.)", "SELECT DISTINCT conv_id, '/conversation/conversation/turn' AS value FROM conversations", "single")
path_query("node_depth", "C", "max(turn/mp:recurse-depth(.))", "SELECT DISTINCT conv_id, CAST(2 AS BIGINT) AS value FROM conversations", "single")
path_query("node_names", "C", "concat(name(turn[1]), local-name(.), namespace-uri(.), has-children(.), count(root(turn[1])))", "SELECT DISTINCT conv_id, 'turnconversationtrue1' AS value FROM conversations", "single")

# scalars: strings
_TEXT, _TX = {"t": ("string", "text")}, "FROM documents"
row_query("str_basic", "documents", ["doc_id"], {"n": ("string-length($t)", _TEXT, "bigint"), "up": ("upper-case($t)", _TEXT, None), "low": ("lower-case(substring($t, 5))", _TEXT, None)}, f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n, replace(upper(text), chr(7838), 'SS') AS up, lower(substr(text, 5)) AS low {_TX}")
row_query("str_tests", "documents", ["doc_id"], {"a": ("contains($t, 'the')", _TEXT, None), "b": ("starts-with($t, 'The')", _TEXT, None), "c": ("ends-with($t, '.')", _TEXT, None), "d": ("compare($t, 'M')", _TEXT, "bigint")}, f"SELECT doc_id, contains(text, 'the') AS a, starts_with(text, 'The') AS b, ends_with(text, '.') AS c, CAST(CASE WHEN text < 'M' THEN -1 WHEN text > 'M' THEN 1 ELSE 0 END AS BIGINT) AS d {_TX}")
row_query("str_around", "part", ["p_partkey"], {"a": ("substring-before($b, '#')", {"b": ("string", "p_brand")}, None), "b": ("substring-after($b, '#')", {"b": ("string", "p_brand")}, None), "c": ("translate($b, 'Brand', 'bRA')", {"b": ("string", "p_brand")}, None), "d": ("normalize-space(concat('  ', $b, '   x '))", {"b": ("string", "p_brand")}, None)}, "SELECT p_partkey, split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', 2) AS b, translate(p_brand, 'Brand', 'bRA') AS c, p_brand || ' x' AS d FROM part")
row_query("str_join", "part", ["p_partkey"], {"a": ("string-join(($a, $b, 'x'), '-')", {"a": ("string", "p_brand"), "b": ("integer", "cast(p_size as bigint)")}, None), "b": ("$a || '/' || $b", {"a": ("string", "p_brand"), "b": ("integer", "cast(p_size as bigint)")}, None)}, "SELECT p_partkey, p_brand || '-' || p_size || '-x' AS a, p_brand || '/' || p_size AS b FROM part")
row_query("str_codepoints", "nation", ["n_nationkey"], {"a": ("codepoints-to-string(reverse(string-to-codepoints($n)))", {"n": ("string", "n_name")}, None), "b": ("sum(string-to-codepoints($n))", {"n": ("string", "n_name")}, "bigint")}, "SELECT n_nationkey, reverse(n_name) AS a, CAST(list_sum(list_transform(string_split(n_name, ''), lambda x: unicode(x))) AS BIGINT) AS b FROM nation")
row_query("regex_matches", "documents", ["doc_id"], {"a": ("matches($t, '[0-9]{3}')", _TEXT, None), "b": ("matches($t, 'LICENSE', 'i')", _TEXT, None)}, f"SELECT doc_id, regexp_matches(text, '[0-9]{{3}}') AS a, regexp_matches(text, 'LICENSE', 'i') AS b {_TX}")
row_query("regex_replace", "pages", ["page_id"], {"a": ("replace($u, '[0-9]+', '#')", {"u": ("string", "url")}, None), "b": ("replace($u, '(http)(s?)', '$2$1')", {"u": ("string", "url")}, None)}, r"SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS a, regexp_replace(url, '(http)(s?)', '\2\1', 'g') AS b FROM pages")
row_query("regex_tokenize", "pages", ["page_id"], {"a": ("count(tokenize($u, '[/.?]'))", {"u": ("string", "url")}, "bigint")}, "SELECT page_id, CAST(len(list_filter(regexp_split_to_array(url, '[/.?]'), lambda x: x <> '')) AS BIGINT) AS a FROM pages")
row_query("b64_roundtrip", "nation", ["n_nationkey"], {"a": ("mp:base64-encode($n)", {"n": ("string", "n_name")}, None), "b": ("mp:base64-decode(mp:base64-encode($n))", {"n": ("string", "n_name")}, None)}, "SELECT n_nationkey, to_base64(encode(n_name)) AS a, n_name AS b FROM nation")
row_query("uri_encode", "pages", ["page_id"], {"a": ("encode-for-uri($u)", {"u": ("string", "url")}, None)}, "SELECT page_id, url_encode(url) AS a FROM pages")

# numbers
_P = {"p": ("double", "p_retailprice"), "n": ("integer", "cast(p_size as bigint)")}
row_query("num_rounding", "part", ["p_partkey"], {"a": ("round($p)", _P, None), "b": ("floor($p)", _P, None), "c": ("ceiling($p)", _P, None), "d": ("abs($n - 25)", _P, None)}, "SELECT p_partkey, round_even(p_retailprice, 0) AS a, floor(p_retailprice) AS b, ceil(p_retailprice) AS c, CAST(abs(p_size - 25) AS BIGINT) AS d FROM part")
row_query("num_number", "part", ["p_partkey"], {"a": ("number(substring-after($b, '#'))", {"b": ("string", "p_brand")}, None)}, "SELECT p_partkey, CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS a FROM part")
row_query("arith_integer", "part", ["p_partkey"], {"a": ("$n + 7", _P, None), "b": ("$n - 30", _P, None), "c": ("$n * 3", _P, None), "d": ("$n idiv 7", _P, None), "e": ("($n - 30) mod 7", _P, None), "f": ("-$n", _P, None)}, "SELECT p_partkey, CAST(p_size + 7 AS BIGINT) AS a, CAST(p_size - 30 AS BIGINT) AS b, CAST(p_size * 3 AS BIGINT) AS c, CAST(p_size // 7 AS BIGINT) AS d, CAST((p_size - 30) % 7 AS BIGINT) AS e, CAST(-p_size AS BIGINT) AS f FROM part")
row_query("arith_double", "part", ["p_partkey"], {"a": ("$p * 2 + 1.5", _P, "double"), "b": ("$p div 4", _P, "double"), "c": ("$n div 4", _P, "double")}, "SELECT p_partkey, p_retailprice * 2 + 1.5::DOUBLE AS a, p_retailprice / 4 AS b, p_size / 4.0::DOUBLE AS c FROM part")
row_query("type_tests", "part", ["p_partkey"], {"a": ("$b castable as xs:integer", {"b": ("string", "substring(p_brand, 7, 2)")}, None), "b": ("$b cast as xs:integer", {"b": ("string", "substring(p_brand, 7, 2)")}, None), "c": ("$n instance of xs:integer", _P, None), "d": ("string($p treat as xs:double) = ''", _P, None)}, "SELECT p_partkey, true AS a, CAST(substr(p_brand, 7, 2) AS BIGINT) AS b, true AS c, false AS d FROM part")

# dates, times and durations
_D = {"t": ("dateTime", "struct(cast(o_orderdate as timestamp_ntz) as ts, cast(null as int) as tz)"), "d": ("date", "struct(cast(o_orderdate as date) as d, 120 as tz)")}
row_query("date_parts", "orders", ["o_orderkey"], {"y": ("year-from-dateTime($t)", _D, None), "m": ("month-from-date($d)", _D, None), "dd": ("day-from-date($d)", _D, None), "h": ("hours-from-dateTime($t)", _D, None), "mi": ("minutes-from-dateTime($t)", _D, None), "s": ("seconds-from-dateTime($t)", _D, "double")}, "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, CAST(second(o_orderdate) AS DOUBLE) AS s FROM orders")
row_query("date_tz", "orders", ["o_orderkey"], {"a": ("hours-from-duration(timezone-from-date($d))", _D, None), "b": ("string(adjust-date-to-timezone($d, xs:dayTimeDuration('PT0S')))", _D, None), "c": ("string(dateTime($d, xs:time('10:20:30')))", _D, None)}, "SELECT o_orderkey, CAST(2 AS BIGINT) AS a, strftime(o_orderdate, '%Y-%m-%d') || 'Z' AS b, strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30+02:00' AS c FROM orders")
_U = {"u": ("dayTimeDuration", "cast(l_partkey * 1000000 + 500000 as bigint)"), "v": ("duration", "struct(cast(l_linenumber * 5 as int) as months, cast(0 as bigint) as us)")}
row_query("duration_parts", "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"], {"d": ("days-from-duration($u)", _U, None), "h": ("hours-from-duration($u)", _U, None), "m": ("minutes-from-duration($u)", _U, None), "s": ("seconds-from-duration($u)", _U, "double"), "y": ("years-from-duration($v)", _U, None), "mo": ("months-from-duration($v)", _U, None)}, "SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_partkey // 86400 AS BIGINT) AS d, CAST(l_partkey // 3600 % 24 AS BIGINT) AS h, CAST(l_partkey // 60 % 60 AS BIGINT) AS m, CAST(l_partkey % 60 + 0.5 AS DOUBLE) AS s, CAST(l_linenumber * 5 // 12 AS BIGINT) AS y, CAST(l_linenumber * 5 % 12 AS BIGINT) AS mo FROM lineitem")

_Z = {"t": ("dateTime", "struct(cast(o_orderdate as timestamp_ntz) as ts, cast(o_custkey % 5 * 60 - 120 as int) as tz)"), "w": ("time", "struct(cast(o_orderkey % 86400 * 1000000 + 250000 as bigint) as us, cast(90 as int) as tz)"), "d": ("date", "struct(cast(o_orderdate as date) as d, 60 as tz)")}
row_query("time_parts", "orders", ["o_orderkey"], {"dd": ("day-from-dateTime($t)", _Z, None), "mo": ("month-from-dateTime($t)", _Z, None), "yd": ("year-from-date($d)", _Z, None), "h": ("hours-from-time($w)", _Z, None), "mi": ("minutes-from-time($w)", _Z, None), "s": ("seconds-from-time($w)", _Z, "double"), "zt": ("hours-from-duration(timezone-from-dateTime($t))", _Z, None), "zw": ("minutes-from-duration(timezone-from-time($w))", _Z, None)}, "SELECT o_orderkey, day(o_orderdate) AS dd, month(o_orderdate) AS mo, year(o_orderdate) AS yd, CAST(o_orderkey % 86400 // 3600 AS BIGINT) AS h, CAST(o_orderkey % 3600 // 60 AS BIGINT) AS mi, o_orderkey % 60 + 0.25::DOUBLE AS s, CAST(o_custkey % 5 - 2 AS BIGINT) AS zt, CAST(30 AS BIGINT) AS zw FROM orders")
row_query("adjust_zones", "orders", ["o_orderkey"], {"a": ("string(adjust-dateTime-to-timezone($t, xs:dayTimeDuration('PT1H')))", _Z, None), "b": ("string(adjust-time-to-timezone($w, xs:dayTimeDuration('PT0S')))", _Z, None), "c": ("string(timezone-from-time($w))", _Z, None)}, "SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + (60 - (o_custkey % 5 * 60 - 120)) * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS a, strftime(TIMESTAMP '2000-01-01' + (o_orderkey % 86400) * INTERVAL 1 SECOND, '%H:%M:%S') || '.25Z' AS b, 'PT1H30M' AS c FROM orders")
row_query("clock", "nation", ["n_nationkey"], {"a": ("current-dateTime() ge dateTime(current-date(), xs:time('00:00:00'))", {}, None), "b": ("year-from-date(current-date()) = year-from-dateTime(current-dateTime())", {}, None), "c": ("hours-from-time(current-time()) < 24", {}, None), "d": ("implicit-timezone() = timezone-from-dateTime(current-dateTime())", {}, None)}, "SELECT n_nationkey, true AS a, true AS b, true AS c, true AS d FROM nation")
_NAME = {"n": ("string", "n_name"), "k": ("integer", "cast(n_nationkey as bigint)")}
row_query("booleans", "nation", ["n_nationkey"], {"a": ("($k > 12) = true()", _NAME, None), "b": ("($k > 12) = false()", _NAME, None), "c": ("boolean($k)", _NAME, None), "d": ("exists($n[. = 'CHINA'])", _NAME, None), "e": ("not(data($k) = $k)", _NAME, None), "f": ("count(unordered(($k, $n)))", _NAME, "bigint")}, "SELECT n_nationkey, n_nationkey > 12 AS a, NOT n_nationkey > 12 AS b, n_nationkey <> 0 AS c, n_name = 'CHINA' AS d, false AS e, CAST(2 AS BIGINT) AS f FROM nation")
row_query("qnames", "nation", ["n_nationkey"], {"a": ("local-name-from-QName(QName('urn:x', concat('p:', $n)))", _NAME, None), "b": ("prefix-from-QName(QName('urn:x', concat('q', $k, ':', $n)))", _NAME, None), "c": ("namespace-uri-from-QName(QName(concat('urn:', $k), $n))", _NAME, None)}, "SELECT n_nationkey, n_name AS a, 'q' || n_nationkey AS b, 'urn:' || n_nationkey AS c FROM nation")
row_query("uri_resolve", "part", ["p_partkey"], {"a": ("resolve-uri(concat('x', $n, '/y'), concat('http://h/', $n, '/z'))", _P, None)}, "SELECT p_partkey, 'http://h/' || p_size || '/x' || p_size || '/y' AS a FROM part")


def document_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their URI: the catalogue holds orders, and doc() finds the one that a row names."""
    eng = Engine(spark)
    eng.base_uri = "http://shop/"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    eng.documents = ["http://shop/1", "http://shop/2", "http://shop/3"]
    key = F.concat(F.lit("http://shop/"), F.col("o_orderkey").cast("string"))
    get = lambda e: eng.value(e, u=("string", key)).col
    return o.select("o_orderkey", get("doc-available($u)").alias("there"), get("string(static-base-uri())").alias("base"))


QUERIES["uri_documents"] = document_query
ORACLES["uri_documents"] = "SELECT o_orderkey, o_orderkey IN (1, 2, 3) AS there, 'http://shop/' AS base FROM orders"

# arrays and maps


def array_query(name: str, expression: str, sql: str) -> None:
    """An expression over $a, the array of a vector; lists come back as text so that both sides hash alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        eng = Engine(spark)
        c = eng.compiler()
        from .plans.compiler import Env

        a = F.expr("transform(embedding, x -> cast(round(x * 1000) as bigint))")
        v = c.compile(expression, Env(vars={"a": V("array", a, elem="integer")}))
        col = v.col if v.t == "array" or v.many else F.array(v.col)
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.concat_ws(",", F.transform(col, lambda x: x.cast("string"))).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT vec_id, coalesce(array_to_string({sql}, ','), '') AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS a FROM embeddings)"


for _n, _e, _s in (
    ("size", "array:size($a)", "[len(a)]"), ("get", "array:get($a, 2)", "a[2:2]"), ("put", "array:put($a, 2, 7)", "a[1:1] || [7] || a[3:]"), ("append", "array:append($a, 7)", "a || [7]"), ("subarray", "array:subarray($a, 2, 3)", "a[2:4]"),
    ("remove", "array:remove($a, 2)", "a[1:1] || a[3:]"), ("insert", "array:insert-before($a, 2, 7)", "a[1:1] || [7] || a[2:]"), ("head", "array:head($a)", "a[1:1]"), ("tail", "array:tail($a)", "a[2:]"), ("reverse", "array:reverse($a)", "list_reverse(a)"),
    ("join", "array:join(($a, $a))", "a || a"), ("flatten", "array:flatten($a)", "a"), ("lookup", "$a?3", "a[3:3]"),
):
    array_query(f"array_{_n}", _e, _s)


def map_query(name: str, expression: str, sql: str, cast: str = "string") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        eng = Engine(spark)
        from .plans.compiler import Env

        m = V("map", F.expr("map('type', event_type, 'user', cast(user_id as string))"), elem="string")
        c = eng.compiler()
        v = c.compile(expression, Env(vars={"m": m}))
        col = F.array_join(F.array_sort(c.strings(v).col), ",") if v.many else v.col
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", col.cast(cast).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT event_id, {sql} AS value FROM events"


map_query("map_size", "map:size(map:put($m, $m?type, 'x'))", "CAST(3 AS BIGINT) - (event_type IN ('type', 'user'))::BIGINT", "bigint")
map_query("map_keys", "map:keys($m)", "'type,user'")
map_query("map_contains", "map:contains(map:entry($m?type, 1), 'click')", "event_type = 'click'", "boolean")
map_query("map_get", "map:get($m, 'type')", "event_type")
map_query("map_put", "map:get(map:put($m, 'type', concat($m?user, 'x')), 'type')", "user_id || 'x'")
map_query("map_entry", "map:get(map:entry('k', $m?user), 'k')", "CAST(user_id AS VARCHAR)")
map_query("map_remove", "map:keys(map:remove(map:put($m, $m?type, 1), 'user'))", "CASE WHEN event_type < 'type' THEN event_type || ',type' ELSE 'type,' || event_type END")
map_query("map_merge", "concat(map:get(map:merge(($m, map{'type': concat('last', $m?user)})), 'type'), map:merge(($m, map{'a': 'b'}))?user)", "'last' || user_id || user_id")
map_query("map_lookup", "$m?user", "CAST(user_id AS VARCHAR)")

# constraints


def _summary(findings: DataFrame) -> DataFrame:
    from .operators.constraints import summary

    return summary(findings).withColumnRenamed("count", "n")


def _above(findings: DataFrame) -> DataFrame:
    from .operators.constraints import at_or_above

    return at_or_above(findings, "WARNING").select(F.col("doc").cast("long").alias("doc"), "kind", "severity")


def constraint_query(name: str, view: str, constraints, sql: str, extra=None, across: bool = False) -> None:
    """Number of findings of each document that has one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.constraints import validate

        found = validate(_VIEWS[view](Engine(spark), sf_dir), constraints, across)
        return (extra or (lambda f: f.groupBy("doc").agg(F.count("*").alias("n"))))(found)

    QUERIES[name], ORACLES[name] = run, sql


def _constraint(kind: str, **more):
    from .catalog.module import Constraint

    return Constraint(kind, **more)


_BY_ORDER = "SELECT CAST(o_orderkey AS VARCHAR) AS doc, count(*) AS n FROM {of} GROUP BY o_orderkey"
constraint_query("c_allowed_values", "O", [(".", _constraint("allowed-values", target="@orderstatus", values={"F": None, "O": None}))], _BY_ORDER.format(of="orders WHERE o_orderstatus NOT IN ('F', 'O')"))
constraint_query("c_matches", "D", [(".", _constraint("matches", regex="^[^#*$%|]*$"))], "SELECT CAST(doc_id AS VARCHAR) AS doc, count(*) AS n FROM documents WHERE NOT regexp_matches(text, '^[^#*$%|]*$') GROUP BY doc_id")
constraint_query("c_expect", "O", [("line", _constraint("expect", test="@quantity <= 45 and @discount < 0.1"))], _BY_ORDER.format(of="orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT (l_quantity <= 45 AND l_discount < 0.1)"))
constraint_query("c_card_min", "O", [(".", _constraint("has-cardinality", target="line", least=1))], _BY_ORDER.format(of="orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"))
constraint_query("c_card_max", "O", [(".", _constraint("has-cardinality", target="line", most=5))], "SELECT CAST(l_orderkey AS VARCHAR) AS doc, CAST(1 AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5")
constraint_query("c_unique", "O", [(".", _constraint("is-unique", target="line", keys=[("@linenumber", None)]))], "SELECT CAST(l_orderkey AS VARCHAR) AS doc, CAST(count(*) - count(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_linenumber)")
_BIG = [(".", _constraint("index", name="big", target="line[@quantity > 25]", keys=[("@partkey", None)])), (".", _constraint("index-has-key", name="big", target="line", keys=[("@partkey", None)]))]
constraint_query("c_index_fk", "O", _BIG, _BY_ORDER.format(of="orders JOIN lineitem a ON l_orderkey = o_orderkey WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_quantity > 25)"))
_FEW = [(".", _constraint("index", name="few", target="line[@quantity > 49]", keys=[("@partkey", None)])), (".", _constraint("index-has-key", name="few", target="line", keys=[("@partkey", None)]))]
constraint_query("c_index_across", "O", _FEW, _BY_ORDER.format(of="orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"), across=True)
constraint_query("c_matches_datatype", "O", [("line", _constraint("matches", target="@discount", datatype="non-negative-integer"))], _BY_ORDER.format(of="orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount <> 0"))
# a key that a pattern cuts out: the first letter of the priority and the status
constraint_query("c_unique_pattern", "T", [(".", _constraint("is-unique", target="order", keys=[("@priority", "^([0-9]).*"), ("@orderstatus", None)]))], "SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(count(*) - count(DISTINCT substr(o_orderpriority, 1, 1) || o_orderstatus) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > count(DISTINCT substr(o_orderpriority, 1, 1) || o_orderstatus)")
constraint_query("findings_at_or_above", "O", [(".", _constraint("allowed-values", target="@orderstatus", values={"F": None, "O": "1.0"})), ("line", _constraint("expect", test="@quantity <= 45", level="INFORMATIONAL")), (".", _constraint("has-cardinality", target="line", least=1, level="CRITICAL"))], "SELECT doc, kind, severity FROM (SELECT o_orderkey AS doc, 'allowed-values' AS kind, CASE WHEN o_orderstatus = 'O' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'has-cardinality', 'CRITICAL' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))", lambda f: _above(f))
constraint_query(
    "findings_summary",
    "O",
    [(".", _constraint("allowed-values", target="@orderstatus", values={"F": None, "O": "1.0"})), (".", _constraint("has-cardinality", target="line", least=1, level="CRITICAL"))],
    "SELECT severity, count(*) AS n FROM (SELECT 'ERROR' AS severity FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'WARNING' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'CRITICAL' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) GROUP BY severity",
    lambda f: _summary(f),
)

# scalar types: validity of a text made of each row
_TYPED = {
    "string": ("text", "documents", "doc_id", r"regexp_full_match(text, '\S((?s:.*)\S)?')"),
    "token": ("p_brand", "part", "p_partkey", r"regexp_full_match(p_brand, '(\p{L}|_)(\p{L}|\p{N}|[.\-_])*')"),
    "uri": ("url", "pages", "page_id", r"regexp_full_match(url, '[a-zA-Z][a-zA-Z0-9+\-.]+:.+')"),
    "uri-reference": ("url", "pages", "page_id", r"NOT regexp_matches(url, '[\s<>\\^`{|}]') AND url <> ''"),
    "uuid": ("p_brand", "part", "p_partkey", "false"),
    "email-address": ("concat(p_brand, '@', p_size)", "part", "p_partkey", "true"),
    "hostname": ("p_brand", "part", "p_partkey", "true"),
    "integer": ("cast(p_size - 25 as string)", "part", "p_partkey", "true"),
    "non-negative-integer": ("cast(p_size - 25 as string)", "part", "p_partkey", "p_size >= 25"),
    "positive-integer": ("cast(p_size - 25 as string)", "part", "p_partkey", "p_size > 25"),
    "decimal": ("concat(p_size, '.', p_size)", "part", "p_partkey", "true"),
    "boolean": ("cast(p_size % 4 as string)", "part", "p_partkey", "p_size % 4 < 2"),
    "base64": ("base64(cast(p_brand as binary))", "part", "p_partkey", "true"),
    "date": ("concat('2020-', lpad(cast(p_size % 14 as string), 2, '0'), '-30')", "part", "p_partkey", "p_size % 14 BETWEEN 1 AND 12 AND p_size % 14 <> 2"),
    "date-with-timezone": ("concat('2020-01-30', if(p_size % 2 = 0, 'Z', ''))", "part", "p_partkey", "p_size % 2 = 0"),
    "date-time": ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")", "orders", "o_orderkey", "true"),
    "date-time-with-timezone": ("concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), if(o_orderkey % 3 = 0, '+02:00', ''))", "orders", "o_orderkey", "o_orderkey % 3 = 0"),
    "day-time-duration": ("concat('P', p_size, if(p_size % 2 = 0, 'D', 'Y'))", "part", "p_partkey", "p_size % 2 = 0"),
    "year-month-duration": ("concat('P', p_size, if(p_size % 2 = 0, 'M', 'D'))", "part", "p_partkey", "p_size % 2 = 0"),
    "ip-v4-address": ("concat('10.0.', p_size * 10, '.1')", "part", "p_partkey", "p_size * 10 <= 255"),
    "ip-v6-address": ("concat('2001:db8::', p_size, if(p_size % 3 = 0, ':', ''))", "part", "p_partkey", "p_size % 3 <> 0"),
    "markup-line": ("p_brand", "part", "p_partkey", "true"),
    "markup-multiline": ("p_brand", "part", "p_partkey", "true"),
}


def typed_query(name: str, column: str, table: str, key: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .functions.datatypes import is_valid

        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, is_valid(name, F.expr(column)).alias("valid"))

    QUERIES[f"typed_{name.replace('-', '_')}"] = run
    ORACLES[f"typed_{name.replace('-', '_')}"] = f"SELECT {key}, {sql} AS valid FROM {table}"


for _n, _spec in _TYPED.items():
    typed_query(_n, *_spec)


# the node table and sinks


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-order, size, level and parent of every node of the conversations."""
    from .operators.nodes import node_rows

    return node_rows(T.conversations(Engine(spark), sf_dir)).select("conv_id", "pre", "size", "level", "parent_pre", "kind", "name")


QUERIES["node_table"] = node_table
ORACLES["node_table"] = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations)
SELECT conv_id, n + 1 AS pre, CAST(0 AS BIGINT) AS size, CAST(2 AS BIGINT) AS level, CAST(1 AS BIGINT) AS parent_pre, 'field' AS kind, 'turn' AS name FROM t
UNION ALL SELECT DISTINCT conv_id, CAST(0 AS BIGINT), m + 1, CAST(0 AS BIGINT), NULL, 'document', 'conversation' FROM t
UNION ALL SELECT DISTINCT conv_id, CAST(1 AS BIGINT), m, CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'assembly', 'conversation' FROM t"""


def fold_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one JSON text; rows only, since engines format JSON differently."""
    return T.conversations(Engine(spark), sf_dir).df.select("conv_id", F.to_json(F.struct(F.col("doc").alias("conversation"))).alias("json"))


QUERIES["fold_json"] = fold_json


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.documents import windows_of

    return windows_of(spark, sf_dir).select(F.col("start").cast("string").alias("start"), "event_type", "n")


QUERIES["event_windows"] = event_windows
ORACLES["event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type"
