"""Queries over the driver's tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .session import Database

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"),
    "embeddings": ("vec_id",),
}
_SQL_TYPES = {"i": "BIGINT", "f": "DOUBLE", "t": "VARCHAR", "b": "BOOLEAN"}


def database(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> Database:
    """A database with some of the driver's tables attached."""
    db = Database(spark)
    for name in tables:
        db.attach(name, f"{sf_dir}/{name}.parquet", KEYS[name], ("props",) if name == "events" else ())
    return db


@dataclass(frozen=True)
class Query:
    """A statement, its parameters, its outputs' types (i, f, t, b) and, if it differs, the statement for DuckDB."""

    sql: str
    types: str
    params: tuple = ()
    oracle: str | None = None
    tables: tuple[str, ...] = field(default=())

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        names = self.tables or tuple(t for t in KEYS if t in self.sql)
        return database(spark, sf_dir, names).query(self.sql, self.params).df

    def oracle_sql(self) -> str:
        text = self.oracle or self.sql
        for k in range(len(self.params), 0, -1):
            value = self.params[k - 1]
            text = text.replace(f"${k}", "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value))
        return text


# fmt: off
READS: dict[str, Query] = {
    # scans and projections
    "select_star": Query("SELECT * FROM nation", "iti"),
    "project_alias": Query("SELECT s_suppkey AS id, s_name AS name, s_name AS also FROM supplier", "itt"),
    "project_expr": Query("SELECT p_partkey, p_size * 2 + 1 AS size, p_retailprice * 1.5 AS price FROM part", "iif"),
    "qualified_alias": Query("SELECT n.n_name, n.n_regionkey FROM nation AS n WHERE n.n_nationkey >= 10", "ti"),
    "star_beside": Query("SELECT r.*, r_regionkey + 1 AS next FROM region r", "iti"),
    "point_lookup": Query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = $1", "if", (77,)),
    "key_range": Query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN $1 AND $2", "ii", (100, 250)),
    "top_orders": Query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > $1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "if", (1000,)),
    # predicates
    "cmp_ops": Query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 40 AND p_size <> 25 AND p_retailprice >= 900 AND p_name < 'm'", "i"),
    "cmp_literal_left": Query("SELECT p_partkey FROM part WHERE 45 < p_size AND 'b' <= p_name", "i"),
    "cmp_expr": Query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_extendedprice * (1 - l_discount) > l_quantity * 1500.0 AND l_tax + l_discount < 0.1", "iif"),
    "bool_logic": Query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')", "i"),
    "in_list": Query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, $1) AND p_brand NOT IN ('Brand#11', $2)", "ii", (9, "Brand#12")),
    "not_in_null": Query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)", "i"),
    "in_null_hit": Query("SELECT p_partkey FROM part WHERE p_size IN (1, NULL)", "i"),
    "between": Query("SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 950.5 AND 1000", "i"),
    "not_between": Query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", "i"),
    "like_any": Query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%9_' AND c_name NOT LIKE '%99%'", "it"),
    "like_prefix": Query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'l%'", "it"),
    "like_underscore": Query("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_2'", "i"),
    "like_escape": Query("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand!#1%' ESCAPE '!'", "i"),
    "ilike_ascii": Query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'mach%' AND c_name NOT ILIKE 'CUSTOMER%1'", "i"),
    # subqueries
    "in_subquery": Query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "it"),
    "not_in_subquery": Query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "i"),
    "in_subquery_agg": Query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IN (SELECT max(p_retailprice) FROM part)", "if"),
    "in_subquery_join": Query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n.n_nationkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE 'A%')", "i"),
    "in_subquery_or": Query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_acctbal > 9000", "i"),
    "agg_in_subquery": Query("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "if"),
    # joins
    "join_inner": Query("SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0", "itf"),
    "join_left": Query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "ii"),
    "join_left_where": Query("SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", "it"),
    "join_left_inner": Query("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 3", "it"),
    "join_chain3": Query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", "itt"),
    "join_chain8": Query("""SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name, c.c_name, n.n_name AS customer_nation, m.n_name AS supplier_nation, r.r_name
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN nation m ON s.s_nationkey = m.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey AND m.n_regionkey = r.r_regionkey WHERE l.l_quantity > 45""", "iitttttt"),
    "join_composite_on": Query("SELECT a.conv_id, a.turn, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.turn = 0", "iit"),
    "join_int_float": Query("SELECT n.n_nationkey, l.l_orderkey FROM nation n JOIN lineitem l ON l.l_quantity = n.n_nationkey WHERE n.n_nationkey < 4", "ii"),
    "join_self": Query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "tt"),
    "join_distinct": Query("SELECT DISTINCT n.n_name, o.o_orderstatus FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey", "tt"),
    "join_expr": Query("SELECT o.o_orderkey, o.o_totalprice - c.c_acctbal AS rest FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > c.c_acctbal * 40", "if"),
    "join_star": Query("SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "itt"),
    # aggregates
    "agg_global": Query("SELECT count(*) AS n, count(l_tax) AS taxed, min(l_quantity) AS low, max(l_extendedprice) AS high, sum(l_linenumber) AS lines, avg(l_quantity) AS mean FROM lineitem", "iiffif"),
    "agg_empty": Query("SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderstatus) AS lowest FROM orders WHERE o_totalprice < 0", "ift"),
    "agg_group": Query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_linenumber) AS low, max(l_quantity) AS high, sum(l_suppkey) AS keys FROM lineitem GROUP BY l_returnflag, l_linestatus", "ttiifi"),
    "agg_multi_key": Query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS low, max(o_custkey) AS highest FROM orders GROUP BY o_orderstatus, o_orderpriority", "ttifi"),
    "agg_filtered": Query("SELECT event_type, count(*) AS n, max(value) AS top, avg(user_id) AS mean FROM events WHERE value > 10 GROUP BY event_type", "tiff"),
    "agg_empty_groups": Query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus", "ti"),
    "agg_min_max_text": Query("SELECT min(p_name) AS lowest, max(p_type) AS highest, count(p_brand) AS n FROM part", "tti"),
    "agg_order_limit": Query("SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10", "iii"),
    "agg_sum_float": Query("SELECT l_returnflag, sum(l_quantity) AS quantity, avg(l_linenumber) AS line FROM lineitem GROUP BY l_returnflag", "tff"),
    "agg_sum_float_global": Query("SELECT sum(l_quantity) AS quantity FROM lineitem WHERE l_linestatus = 'O'", "f"),
    "agg_default_names": Query("SELECT count(*), sum(o_custkey), min(o_orderstatus), max(o_totalprice) FROM orders", "iitf", oracle="SELECT count(*) AS count, sum(o_custkey) AS sum, min(o_orderstatus) AS min, max(o_totalprice) AS max FROM orders"),
    "distinct_cols": Query("SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem", "ti"),
    # order and limits
    "order_output_alias": Query("SELECT p_partkey AS k, p_size AS s FROM part ORDER BY s DESC, k LIMIT 15", "ii"),
    "order_shadowed": Query("SELECT p_size AS p_partkey, p_partkey AS k FROM part ORDER BY part.p_partkey DESC LIMIT 7", "ii", oracle="SELECT p_size AS p_partkey, p_partkey AS k FROM part ORDER BY k DESC LIMIT 7"),
    "top_k": Query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT $1", "iif", (25,)),
    "read_in_order": Query("SELECT * FROM customer ORDER BY c_custkey", "itift", oracle="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "offset_only": Query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100", "i"),
    "limit_offset": Query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5", "if"),
    "limit_zero": Query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 0", "i"),
    # expressions
    "expr_int_div": Query("SELECT p_partkey, (p_size - 25) / 7 AS q, p_retailprice / 4 AS f FROM part", "iif", oracle="SELECT p_partkey, (p_size - 25) // 7 AS q, p_retailprice / 4 AS f FROM part"),
    "expr_mod": Query("SELECT p_partkey, (p_size - 25) % 7 AS r FROM part WHERE p_size % 3 = 1", "ii"),
    "expr_concat": Query("SELECT n_nationkey, n_name || ':' || n_name AS twice FROM nation", "it"),
    "expr_precedence": Query("SELECT p_partkey, -p_size + 2 * 3 - (p_size - 1) * 2 AS v FROM part WHERE 1 + p_size * 2 > 30 - p_size", "ii"),
    "expr_null": Query("SELECT p_partkey, p_size + NULL AS nothing FROM part", "ii"),
    # nested queries
    "scalar_subquery_count": Query("SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AS n FROM customer c", "ii"),
    "scalar_subquery_value": Query("SELECT n.n_name, (SELECT r.r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) AS region FROM nation n", "tt"),
    "scalar_uncorrelated": Query("SELECT r_name, (SELECT max(n_nationkey) FROM nation) AS highest FROM region", "ti"),
    "json_agg_ordered": Query("SELECT r.r_name, (SELECT json_agg(n.n_name ORDER BY n.n_name DESC) FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 3) AS names FROM region r", "tt",
        oracle="""SELECT r_name, (SELECT '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name DESC) || ']' FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 3) AS names FROM region"""),
    "json_agg_coalesce": Query("SELECT c.c_custkey, (SELECT coalesce(json_agg(o.o_orderkey ORDER BY o.o_orderkey), '[]') FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders FROM customer c", "it",
        oracle="SELECT c_custkey, (SELECT coalesce('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']', '[]') FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer"),
    "json_build_array": Query("SELECT json_build_array(n.n_nationkey, n.n_name, n.n_regionkey) AS row FROM nation n", "t",
        oracle="""SELECT '[' || n_nationkey || ',"' || n_name || '",' || n_regionkey || ']' AS row FROM nation"""),
    "to_json_row": Query("SELECT to_json(r) AS row FROM region r", "t", oracle="""SELECT '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS row FROM region"""),
    "lateral_first": Query("""SELECT c.c_custkey, top.o_orderkey, top.o_totalprice FROM customer c LEFT JOIN LATERAL
        (SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) top ON true""", "iif"),
    "nested_depth3": Query("""SELECT r.r_name, x.data AS nations FROM region r LEFT JOIN LATERAL (SELECT coalesce(json_agg(json_build_array(n.n_name, y.data) ORDER BY n.n_name), '[]') AS data
        FROM nation n LEFT JOIN LATERAL (SELECT coalesce(json_agg(z), '[]') AS data FROM (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey > r.r_regionkey * 100
        ORDER BY c.c_custkey LIMIT 2) z) y ON true WHERE n.n_regionkey = r.r_regionkey) x ON true""", "tt",
        oracle="""SELECT r_name, coalesce((SELECT '[' || string_agg('["' || n_name || '",' || coalesce((SELECT '[' || string_agg('{"c_custkey":' || c_custkey || '}', ',' ORDER BY c_custkey) || ']' FROM
        (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, rk ORDER BY c_custkey) AS k, c_nationkey, rk FROM customer JOIN (SELECT r_regionkey AS rk FROM region) ON c_custkey > rk * 100)
        WHERE k <= 2 AND c_nationkey = n_nationkey AND rk = r_regionkey), '[]') || ']', ',' ORDER BY n_name) || ']' FROM nation WHERE n_regionkey = r_regionkey), '[]') AS nations FROM region"""),
}
# fmt: on


def _holes(sf_dir: str, spark: SparkSession) -> DataFrame:
    """`part` with nulls in size, price and brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.withColumns({
        "p_size": F.when(F.col("p_size") % 7 != 0, F.col("p_size")),
        "p_retailprice": F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")),
        "p_brand": F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")),
    })


HOLES_SQL = (
    "(SELECT p_partkey, p_name, p_type, CASE WHEN p_size % 7 <> 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS p_retailprice, "
    "CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS p_brand FROM part) holes"
)
# fmt: off
NULLS: dict[str, str] = {
    "is_null": "SELECT p_partkey FROM holes WHERE p_size IS NULL AND p_brand IS NOT NULL",
    "null_logic": "SELECT p_partkey FROM holes WHERE NOT (p_size > 20 AND p_retailprice > 1000)",
    "null_not_in": "SELECT p_partkey FROM holes WHERE p_size NOT IN (1, 2, 3)",
    "null_not_in_query": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT p_size FROM holes)",
    "null_in_query_or": "SELECT p_partkey FROM holes WHERE p_size IN (SELECT n_nationkey FROM nation) OR p_brand IS NULL",
    "order_nulls": "SELECT p_partkey, p_size FROM holes ORDER BY p_size DESC, p_partkey",
    "order_nulls_placed": "SELECT p_partkey, p_size, p_brand FROM holes ORDER BY p_brand ASC NULLS FIRST, p_size DESC NULLS LAST, p_partkey LIMIT 50",
    "agg_nulls": "SELECT p_brand, count(*) AS n, count(p_size) AS sized, sum(p_size) AS total, min(p_retailprice) AS low FROM holes GROUP BY p_brand",
    "distinct_nulls": "SELECT DISTINCT p_size FROM holes",
    "join_nulls": "SELECT a.p_partkey AS one, n.n_name FROM holes a LEFT JOIN nation n ON a.p_size = n.n_nationkey",
    "expr_nulls": "SELECT p_partkey, p_size * 2 AS twice, p_brand || '!' AS b FROM holes",
}
# fmt: on


def _null_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, ("nation",))
        db.attach("holes", _holes(sf_dir, spark), ("p_partkey",))
        return db.query(sql).df

    return run


def _null_oracle(sql: str) -> str:
    text = sql.replace("FROM holes a", f"FROM {HOLES_SQL.removesuffix('holes')} a").replace("FROM holes", f"FROM {HOLES_SQL}")
    return text.replace("p_size DESC, p_partkey", "p_size DESC NULLS FIRST, p_partkey")


def _writable(spark: SparkSession, sf_dir: str) -> Database:
    """region, nation and customer as writable tables, nation referencing region and customer nation."""
    db = Database(spark)
    for name in ("region", "nation", "customer"):
        db.load(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])
    db.exec("ALTER TABLE nation ADD FOREIGN KEY (n_regionkey) REFERENCES region ON DELETE CASCADE ON UPDATE CASCADE; ALTER TABLE customer ADD FOREIGN KEY (c_nationkey) REFERENCES nation ON DELETE SET NULL ON UPDATE CASCADE")
    return db


# fmt: off
#: Scripts over writable copies; the last statement's rows are the result.
WRITES: dict[str, tuple[str, str]] = {
    "dml_insert": ("INSERT INTO region VALUES (7, 'NORTH'), (8, 'SOUTH'); INSERT INTO nation (n_name, n_nationkey) VALUES ('NEW', 100); SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT 100, 'NEW', NULL"),
    "dml_upsert_nothing": ("INSERT INTO region VALUES (1, 'X'), (9, 'NINE') ON CONFLICT DO NOTHING; SELECT * FROM region",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 9, 'NINE'"),
    "dml_upsert_update": ("INSERT INTO region VALUES (1, 'X'), (9, 'NINE') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = region.r_name || '+' || EXCLUDED.r_name; SELECT * FROM region",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || '+X' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NINE'"),
    "dml_update_expr": ("UPDATE customer SET c_acctbal = c_acctbal * 2 + 1, c_mktsegment = c_mktsegment || '!' WHERE c_custkey % 3 = 0; SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_update_key": ("UPDATE nation SET n_nationkey = 24 - n_nationkey; SELECT n_nationkey, n_name FROM nation", "SELECT CAST(24 - n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "dml_delete": ("DELETE FROM customer WHERE c_acctbal < 1000 OR c_mktsegment IN ('BUILDING', 'MACHINERY'); SELECT c_custkey FROM customer",
        "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 1000 OR c_mktsegment IN ('BUILDING', 'MACHINERY'))"),
    "dml_returning": ("UPDATE region SET r_name = 'R' || r_name WHERE r_regionkey > 1 RETURNING r_regionkey, r_name",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, 'R' || r_name AS r_name FROM region WHERE r_regionkey > 1"),
    "fk_cascade": ("DELETE FROM region WHERE r_regionkey = 2; SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey",
        "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey"),
    "fk_update_cascade": ("UPDATE region SET r_regionkey = r_regionkey + 50; SELECT n.n_nationkey, n.n_regionkey FROM nation n",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey + 50 AS BIGINT) AS n_regionkey FROM nation"),
    "ddl_columns": ("ALTER TABLE region ADD COLUMN size INTEGER DEFAULT 3; ALTER TABLE region RENAME COLUMN r_name TO title; UPDATE region SET size = 4 WHERE r_regionkey = 0; SELECT * FROM region",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name AS title, CAST(CASE WHEN r_regionkey = 0 THEN 4 ELSE 3 END AS BIGINT) AS size FROM region"),
    "dml_default_values": ("CREATE TABLE stock (id INTEGER PRIMARY KEY DEFAULT 4, place TEXT NOT NULL DEFAULT 'shelf', n INTEGER DEFAULT 2, share FLOAT, open BOOLEAN DEFAULT true); INSERT INTO stock DEFAULT VALUES; INSERT INTO stock (id, n) VALUES (5, DEFAULT); SELECT * FROM stock",
        "SELECT CAST(i AS BIGINT) AS id, 'shelf' AS place, CAST(2 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS share, true AS open FROM (VALUES (4), (5)) v(i)"),
    "ddl_create_constraints": ("CREATE TABLE office (code INTEGER, floor TEXT, n_key INTEGER REFERENCES nation ON DELETE CASCADE, badge TEXT UNIQUE, PRIMARY KEY (code, floor)); INSERT INTO office VALUES (1, 'a', 3, 'x'), (1, 'b', 4, 'y'), (2, 'a', NULL, NULL), (3, 'c', NULL, NULL); "
        "INSERT INTO office VALUES (9, 'z', 5, 'y') ON CONFLICT (badge) DO UPDATE SET n_key = EXCLUDED.n_key; DELETE FROM nation WHERE n_nationkey = 3; SELECT code, floor, n_key FROM office",
        "SELECT CAST(a AS BIGINT) AS code, b AS floor, CAST(c AS BIGINT) AS n_key FROM (VALUES (1, 'b', 5), (2, 'a', NULL), (3, 'c', NULL)) v(a, b, c)"),
    "ddl_index_reads": ("CREATE INDEX by_segment ON customer (c_mktsegment, c_nationkey); CREATE UNIQUE INDEX by_name ON customer (c_name); SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 5 AND c_nationkey < 17",
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 5 AND c_nationkey < 17"),
    "ddl_index_upsert": ("CREATE UNIQUE INDEX by_label ON region (r_name); INSERT INTO region VALUES (40, 'ASIA'), (41, 'MOON') ON CONFLICT (r_name) DO UPDATE SET r_name = EXCLUDED.r_name || '!'; DROP INDEX by_label; INSERT INTO region VALUES (42, 'MOON'); SELECT * FROM region",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE r_name WHEN 'ASIA' THEN 'ASIA!' ELSE r_name END AS r_name FROM region UNION ALL SELECT 41, 'MOON' UNION ALL SELECT 42, 'MOON'"),
    "ddl_drop_table": ("DROP TABLE region CASCADE; INSERT INTO nation VALUES (77, 'FREE', 12345); SELECT n_nationkey, n_regionkey FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT 77, 12345"),
    "ddl_defaults": ("ALTER TABLE region ALTER COLUMN r_name SET DEFAULT 'none'; INSERT INTO region (r_regionkey) VALUES (60); ALTER TABLE region ALTER COLUMN r_name DROP DEFAULT; INSERT INTO region (r_regionkey) VALUES (61); DELETE FROM region WHERE r_name IS NULL; ALTER TABLE region ALTER r_name SET NOT NULL; SELECT * FROM region",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 60, 'none'"),
    "ddl_types": ("ALTER TABLE region ALTER r_name TYPE VARCHAR(40); ALTER TABLE region ALTER COLUMN r_regionkey SET DATA TYPE BIGINT; ALTER TABLE region DISABLE ROW LEVEL SECURITY; INSERT INTO region VALUES (9007199254740991, 'far'); SELECT * FROM region",
        "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 9007199254740991, 'far'"),
    "ddl_constraints_dropped": ("ALTER TABLE region ADD CONSTRAINT one_name UNIQUE (r_name); ALTER TABLE region DROP CONSTRAINT one_name; INSERT INTO region VALUES (70, 'ASIA'); SELECT r_name, count(*) AS n FROM region GROUP BY r_name",
        "SELECT r_name, CAST(count(*) + (r_name = 'ASIA')::INT AS BIGINT) AS n FROM region GROUP BY r_name"),
    "ddl_drop_column": ("ALTER TABLE nation DROP COLUMN n_regionkey; ALTER TABLE nation RENAME TO land; SELECT * FROM land", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
}
# fmt: on


def _write_query(script: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _writable(spark, sf_dir).exec(script)[-1].df


def set_schema_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _writable(spark, sf_dir)
    schema = db.get_schema()
    region = next(t for t in schema["tables"] if t["name"] == "region")
    region["columns"][1] |= {"name": "label", "renamedFrom": "r_name"}
    region["columns"].append({"name": "rank", "type": "integer", "nullable": False, "default": 5})
    db.set_schema(schema | {"version": 2})
    return db.query("SELECT * FROM region").df


def transaction_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _writable(spark, sf_dir)
    put = db.prepare("INSERT INTO region VALUES ($1, $2)")
    with db.transaction() as tx:
        tx.execute(put, [20, "TWENTY"])
        tx.query("UPDATE region SET r_name = r_name || '*' WHERE r_regionkey >= $1", [20])
        tx.exec("DELETE FROM region WHERE r_regionkey = 0; INSERT INTO region VALUES (21, 'MORE')")
    return db.query("SELECT * FROM region").df


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def savepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a transaction in which one statement and one script are refused, and of one that is rolled back."""
    db = _writable(spark, sf_dir)
    with db.transaction() as tx:
        tx.query("INSERT INTO region VALUES (30, 'kept')")
        for refused_ in ("INSERT INTO region VALUES (31, 'lost'), (30, 'again')", "UPDATE region SET r_regionkey = 1"):
            with suppress(EngineError):
                tx.query(refused_)
        with suppress(EngineError):
            tx.exec("INSERT INTO region VALUES (32, 'lost'); INSERT INTO region VALUES (32, 'again')")
        tx.query("UPDATE region SET r_name = r_name || '+' WHERE r_regionkey = 30")
    with db.transaction() as tx:
        tx.query("DELETE FROM region")
        tx.rollback()
    return db.query("SELECT * FROM region").df


#: Statements that are refused, with the error's code.
REFUSED = {
    "SELECT r_name FROM region WHERE r_regionkey = 'x'": "TYPE_MISMATCH", "SELECT r_name FROM region WHERE r_name < 3": "TYPE_MISMATCH", "SELECT sum(r_name) FROM region": "TYPE_MISMATCH",
    "SELECT r_name FROM region WHERE r_regionkey": "UNSUPPORTED_SQL", "SELECT r_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey": "UNSUPPORTED_SQL",
    "SELECT count(DISTINCT n_regionkey) FROM nation": "UNSUPPORTED_SQL", "SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey HAVING count(*) > 1": "UNSUPPORTED_SQL",
    "SELECT row_number() OVER (ORDER BY n_name) FROM nation": "UNSUPPORTED_SQL", "SELECT r_name FROM region UNION SELECT n_name FROM nation": "UNSUPPORTED_SQL",
    "SELECT lower(r_name) FROM region": "UNSUPPORTED_SQL", "SELECT CASE WHEN true THEN 1 END FROM region": "UNSUPPORTED_SQL", "SELECT n_name, count(*) FROM nation": "INVALID_QUERY",
    "SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey ORDER BY n_name": "INVALID_QUERY", "SELECT r_name FROM nowhere": "TABLE_NOT_FOUND", "SELECT size FROM region": "COLUMN_NOT_FOUND",
    "INSERT INTO region VALUES (1, 'twice')": "CONSTRAINT_VIOLATION", "INSERT INTO nation VALUES (90, 'x', 90)": "CONSTRAINT_VIOLATION", "UPDATE region SET r_regionkey = 1": "CONSTRAINT_VIOLATION",
    "SELECT r_regionkey / 0 AS x FROM region": "DIVISION_BY_ZERO", "INSERT INTO region VALUES (NULL, 'x')": "CONSTRAINT_VIOLATION",
}


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement of REFUSED with the code it is refused by, and how many regions there are afterwards."""
    db, out = _writable(spark, sf_dir), []
    for sql in REFUSED:
        try:
            db.query(sql).rows  # noqa: B018
            out.append((sql, None))
        except EngineError as error:
            out.append((sql, error.code))
    left = db.query("SELECT count(*) AS n FROM region").rows[0]["n"]
    return _table(spark, [(sql, code, left) for sql, code in out], "statement string, code string, regions long")


def change_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener on region hears of a script, a transaction and a change of another table, with the rows changed."""
    db, heard = _writable(spark, sf_dir), []
    stop = db.subscribe(["region"], heard.append)
    start = db.get_revision()
    one = db.exec("INSERT INTO region VALUES (50, 'a'); UPDATE region SET r_name = 'b' WHERE r_regionkey IN (0, 50); DELETE FROM nation WHERE n_nationkey = 1")
    with db.transaction() as tx:
        tx.query("DELETE FROM region WHERE r_regionkey = $1", [50])
        tx.query("INSERT INTO region VALUES (51, 'c')")
    db.query("UPDATE nation SET n_name = 'x' WHERE n_nationkey = 2")
    stop()
    db.query("DELETE FROM region WHERE r_regionkey = 51")
    rows = [(n.revision - start, k[0]) for n in heard for k in n.keys["region"]]
    return _table(spark, rows + [(-1, sum(r.affected_rows for r in one)), (-2, len(db.check())), (-3, db.get_revision() - start)], "revision long, r_regionkey long")


def row_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as objects, as arrays and by a template's values, in one table."""
    db = database(spark, sf_dir, ("nation",))
    objects = db.query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = $1", [1]).rows
    arrays = db.query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = $1", [1], row_mode="array").rows
    return _table(spark, [("object", r["n_nationkey"], r["n_name"]) for r in objects] + [("array", *r) for r in arrays], "shape string, n_nationkey long, n_name string")


def _cast(sql: str, types: str, names: list[str]) -> str:
    return "SELECT " + ", ".join(f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}" for n, t in zip(names, types, strict=True)) + f" FROM ({sql}) q"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {n: q.run for n, q in READS.items()}
    | {n: _null_query(q) for n, q in NULLS.items()}
    | {n: _write_query(w) for n, (w, _) in WRITES.items()}
    | {"set_schema_rename": set_schema_rename, "transaction_script": transaction_script, "savepoints": savepoints, "refusals": refusals, "change_notices": change_notices, "row_shapes": row_shapes}
)


def oracles() -> dict[str, str]:
    """SQL for DuckDB with the engine's types: whole numbers are BIGINT."""
    from .plans import syntax as s
    from .plans.parser import parse

    out = {}
    stars = {"select_star": ["n_nationkey", "n_name", "n_regionkey"], "read_in_order": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "star_beside": ["r_regionkey", "r_name", "next"], "join_star": ["r_regionkey", "r_name", "n_name"]}
    for name, q in READS.items():
        tree = parse(q.sql)
        names = stars.get(name) or [i.alias or (i.value.name if isinstance(i.value, s.Column) else i.value.function) for i in tree.items]
        out[name] = _cast(q.oracle_sql(), q.types, names)
    types = {"p_partkey": "i", "p_size": "i", "n_nationkey": "i", "total": "i", "n": "i", "sized": "i", "twice": "i", "one": "i"}
    for name, sql in NULLS.items():
        names = [i.alias or i.value.name for i in parse(sql).items]
        own = "".join(types.get(n, "f" if n in ("low",) else "t") for n in names)
        out[name] = _cast(_null_oracle(sql), own, names)
    out |= {n: sql for n, (_, sql) in WRITES.items()}
    out["set_schema_rename"] = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name AS label, CAST(5 AS BIGINT) AS rank FROM region"
    out["transaction_script"] = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 20, 'TWENTY*' UNION ALL SELECT 21, 'MORE'"
    out["savepoints"] = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 30, 'kept+'"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(sql)}, {quote(code)})" for sql, code in REFUSED.items())
    out["refusals"] = f"SELECT a AS statement, b AS code, (SELECT count(*) FROM region) AS regions FROM (VALUES {listed}) v(a, b)"
    out["change_notices"] = "SELECT CAST(a AS BIGINT) AS revision, CAST(b AS BIGINT) AS r_regionkey FROM (VALUES (1, 0), (1, 50), (2, 50), (2, 51), (-1, 4), (-2, 0), (-3, 4)) v(a, b)"
    own = "CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1"
    out["row_shapes"] = f"SELECT 'object' AS shape, {own} UNION ALL SELECT 'array', {own}"
    return out
