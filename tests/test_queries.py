"""Reads over small tables, against literal rows and models."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from relforge.errors import EngineError
from relforge.session import Database

# (no, river, depth, flow, note, live) of gauges at rivers, setup is JSON
GAUGES = [(3, "Elbe", 120, 4.25, "low_1", True), (5, "Oder", -8, None, "Ödland", False), (8, None, 120, 6.5, "h%i", True), (13, "Elbe", None, -2.0, "", None), (21, "Main", 64, 0.125, None, False)]
# (badge, sign) of divers, (run, badge, wreck, metres) of their dives, (tag, run, kind) of what they found
DIVERS = [(1, "Kestrel"), (4, "Heron"), (9, "Wren")]
DIVES = [(70, 4, "Orion", 31), (71, 4, "Lyra", 18), (72, 1, "Vega", 44), (73, None, "Orion", 12)]
FINDS = [(500, 71, "coin"), (501, 71, "bell"), (502, 72, "anchor")]
SETUPS = [(1, {"rate": [0.5, 2], "unit": "cm"}), (2, 12), (3, "manual"), (4, None)]


def fill(db, table, data):
    places = itertools.count(1)
    db.query(f"INSERT INTO {table} VALUES " + ", ".join("(" + ", ".join(f"${next(places)}" for _ in row) + ")" for row in data), [v for row in data for v in row])


@pytest.fixture(scope="module")
def site(spark):
    db = Database(spark)
    db.exec("""
        CREATE TABLE gauge (no INTEGER PRIMARY KEY, river TEXT, depth INTEGER, flow FLOAT, note TEXT, live BOOLEAN);
        CREATE TABLE setup (no INTEGER PRIMARY KEY, how JSON);
        CREATE TABLE diver (badge INTEGER PRIMARY KEY, sign TEXT NOT NULL);
        CREATE TABLE dive (run INTEGER PRIMARY KEY, badge INTEGER, wreck TEXT, metres INTEGER);
        CREATE TABLE find (tag INTEGER PRIMARY KEY, run INTEGER, kind TEXT);
        CREATE TABLE odd (no INTEGER PRIMARY KEY, "two words" TEXT, "Upper" INTEGER)
    """)
    for table, data in (("gauge", GAUGES), ("diver", DIVERS), ("dive", DIVES), ("find", FINDS), ("setup", SETUPS)):
        fill(db, table, data)
    yield db
    db.close()


def rows(db, sql, *params):
    return [tuple(r.values()) for r in db.query(sql, params).rows]


def code(db, sql, *params, **options):
    with pytest.raises(EngineError) as error:
        db.query(sql, params, **options).rows  # noqa: B018
    return error.value.code


def test_outputs_have_names_and_types(site):
    got = site.query("SELECT depth - 100 AS above, flow * 2, river AS r, live, no FROM gauge WHERE no = $1", [3])
    assert [(f["name"], f["dataTypeID"]) for f in got.fields] == [("above", 20), ("?column?", 701), ("r", 25), ("live", 16), ("no", 20)]
    assert got.rows == [{"above": 20, "?column?": 8.5, "r": "Elbe", "live": True, "no": 3}] and got.row_count == 1 and got.affected_rows is None
    nothing = site.query("SELECT how FROM setup WHERE no > 100")
    assert nothing.rows == [] and nothing.fields == [{"name": "how", "dataTypeID": 114}]
    assert site.query("SELECT d.*, d.badge * 10 AS tenfold FROM diver d WHERE d.sign = 'Wren'").rows == [{"badge": 9, "sign": "Wren", "tenfold": 90}]
    assert site.query("SELECT no, depth AS no FROM gauge WHERE no = 21", row_mode="array").rows == [[21, 64]]


def test_arithmetic_against_plain_python(site):
    truncated = lambda a, b: int(a / b)
    got = rows(site, "SELECT no, depth / 7 AS q, depth % 7 AS r, -depth AS minus, flow / 4 AS part, note || '/' || river AS path FROM gauge ORDER BY gauge.no")
    assert got == [
        (no, None if d is None else truncated(d, 7), None if d is None else d - 7 * truncated(d, 7), None if d is None else -d, None if f is None else f / 4, None if n is None or r is None else f"{n}/{r}")
        for no, r, d, f, n, _ in GAUGES
    ]
    assert rows(site, "SELECT depth + 9007199254740871 AS most FROM gauge WHERE no = 8") == [(9007199254740991,)]
    for sql, want in (
        ("SELECT 5 / (depth + 8) AS x FROM gauge", "DIVISION_BY_ZERO"), ("SELECT no % (no - 13) AS x FROM gauge", "DIVISION_BY_ZERO"), ("SELECT flow / (flow - flow) AS x FROM gauge WHERE no = 3", "DIVISION_BY_ZERO"),
        ("SELECT depth * 90071992547409 AS x FROM gauge", "NUMERIC_OVERFLOW"), ("SELECT flow * 1e308 * 1e9 AS x FROM gauge", "NUMERIC_OVERFLOW"),
        ("SELECT river - 1 AS x FROM gauge", "TYPE_MISMATCH"), ("SELECT no || river AS x FROM gauge", "TYPE_MISMATCH"), ("SELECT flow % 3 AS x FROM gauge", "TYPE_MISMATCH"), ("SELECT -live AS x FROM gauge", "TYPE_MISMATCH"),
        ("SELECT no FROM gauge WHERE river = 7", "TYPE_MISMATCH"), ("SELECT no FROM gauge WHERE live >= 'no'", "TYPE_MISMATCH"), ("SELECT depth * 2 AS d FROM gauge ORDER BY d, flow", "UNSUPPORTED_SQL"),
    ):
        assert code(site, sql) == want, sql


def test_rows_that_fail_plain_terms_never_reach_terms_that_can_fail(site):
    assert rows(site, "SELECT no FROM gauge WHERE 240 / (no - 8) > 1 AND no > 8 ORDER BY no") == [(13,), (21,)]
    assert rows(site, "SELECT run FROM dive WHERE metres % (run - 70) = 0 AND run <> 70 AND badge IS NOT NULL ORDER BY run") == [(71,), (72,)]


def test_order_and_cuts_against_sorted_lists(site):
    high = float("inf")
    by = lambda key, **options: [(r[0],) for r in sorted(GAUGES, key=key, **options)]
    assert rows(site, "SELECT no FROM gauge ORDER BY depth, no") == by(lambda r: (high if r[2] is None else r[2], r[0]))
    assert rows(site, "SELECT no FROM gauge ORDER BY flow DESC NULLS LAST") == by(lambda r: high if r[3] is None else -r[3])
    assert rows(site, "SELECT no FROM gauge ORDER BY river DESC, depth ASC NULLS FIRST") == [(8,), (5,), (21,), (13,), (3,)]
    assert rows(site, "SELECT no FROM gauge ORDER BY no DESC LIMIT $1 OFFSET $2", 2, 2) == [(8,), (5,)]
    assert rows(site, "SELECT no FROM gauge ORDER BY no OFFSET 4") == [(21,)] and rows(site, "SELECT note FROM gauge LIMIT 0") == []
    assert rows(site, "SELECT note AS no FROM gauge ORDER BY gauge.no LIMIT 2") == [("low_1",), ("Ödland",)]
    assert {code(site, "SELECT no FROM gauge OFFSET $1", x) for x in (-3, 2.5, "1", False, None)} == {"INVALID_QUERY"}
    assert code(site, "SELECT no FROM setup ORDER BY how") == "TYPE_MISMATCH" and code(site, "SELECT no, depth AS no FROM gauge") == "INVALID_QUERY"
    assert code(site, "SELECT river AS x, note AS x FROM gauge ORDER BY x", row_mode="array") == "INVALID_QUERY"


def test_groups_against_plain_python(site):
    groups = {}
    for _, river, depth, flow, *_ in GAUGES:
        groups.setdefault(river, []).append((depth, flow))
    total = lambda values: sum(values) if values else None
    want = {r: (len(g), total([d for d, _ in g if d is not None]), total([f for _, f in g if f is not None])) for r, g in groups.items()}
    assert {r: tuple(x) for r, *x in rows(site, "SELECT river, count(*) AS n, sum(depth) AS d, sum(flow) AS f FROM gauge GROUP BY river")} == want
    assert rows(site, "SELECT count(depth) AS n, avg(depth) AS mean, min(note) AS lowest, max(note) AS highest, min(flow) AS least FROM gauge") == [(4, 74.0, "", "Ödland", -2.0)]
    assert rows(site, "SELECT count(*), min(depth), avg(flow), sum(no) FROM gauge WHERE no < 0") == [(0, None, None, None)] and rows(site, "SELECT live FROM gauge WHERE no < 0 GROUP BY live") == []
    assert rows(site, "SELECT DISTINCT live FROM gauge ORDER BY live DESC") == [(None,), (True,), (False,)] and rows(site, "SELECT DISTINCT wreck, badge FROM dive WHERE wreck = 'Orion' ORDER BY badge") == [("Orion", 4), ("Orion", None)]
    assert [f["name"] for f in site.query("SELECT max(flow), sum(depth) FROM gauge").fields] == ["max", "sum"]
    for sql, want in (
        ("SELECT max(live) FROM gauge", "TYPE_MISMATCH"), ("SELECT avg(note) FROM gauge", "TYPE_MISMATCH"), ("SELECT DISTINCT how FROM setup", "TYPE_MISMATCH"), ("SELECT how, count(*) FROM setup GROUP BY how", "TYPE_MISMATCH"),
        ("SELECT note, max(no) FROM gauge", "INVALID_QUERY"), ("SELECT note FROM gauge GROUP BY river", "INVALID_QUERY"), ("SELECT DISTINCT note FROM gauge ORDER BY depth", "INVALID_QUERY"), ("SELECT min(no), min(depth) FROM gauge", "INVALID_QUERY"),
        ("SELECT DISTINCT * FROM diver", "UNSUPPORTED_SQL"), ("SELECT max(d.metres) FROM dive d JOIN diver v ON v.badge = d.badge", "UNSUPPORTED_SQL"),
    ):
        assert code(site, sql) == want, sql


def test_joins_against_loops(site):
    pairs = [(v, d) for v in DIVERS for d in DIVES if d[1] == v[0]]
    assert rows(site, "SELECT v.sign, d.wreck FROM dive d JOIN diver v ON v.badge = d.badge ORDER BY wreck") == sorted(((v[1], d[2]) for v, d in pairs), key=lambda x: x[1])
    assert rows(site, "SELECT v.badge AS b, d.run AS r FROM diver v LEFT JOIN dive d ON d.badge = v.badge ORDER BY b, r") == [(1, 72), (4, 70), (4, 71), (9, None)]
    assert rows(site, "SELECT v.sign FROM diver v LEFT JOIN dive d ON v.badge = d.badge WHERE d.run IS NULL") == [("Wren",)]
    three = [(f[2], d[2], v[1]) for f in FINDS for v, d in pairs if f[1] == d[0]]
    assert sorted(rows(site, "SELECT f.kind, d.wreck, v.sign FROM find f JOIN dive d ON d.run = f.run JOIN diver v ON v.badge = d.badge")) == sorted(three)
    assert rows(site, "SELECT a.run AS a, b.run AS b FROM dive a JOIN dive b ON a.wreck = b.wreck WHERE a.run < b.run") == [(70, 73)]
    assert rows(site, "SELECT g.no FROM gauge g JOIN diver v ON g.flow = v.badge") == [] and rows(site, "SELECT DISTINCT v.sign FROM diver v JOIN dive d ON d.badge = v.badge ORDER BY v.sign DESC") == [("Kestrel",), ("Heron",)]
    assert rows(site, "SELECT dive.* FROM diver JOIN dive ON dive.badge = diver.badge WHERE diver.sign = 'Kestrel'") == [(72, 1, "Vega", 44)]
    both = site.query("SELECT * FROM diver JOIN dive ON diver.badge = dive.badge WHERE run = 72", row_mode="array")
    assert both.rows == [[1, "Kestrel", 72, 1, "Vega", 44]] and [f["name"] for f in both.fields].count("badge") == 2
    for sql, want in (
        ("SELECT badge FROM diver JOIN dive ON dive.badge = diver.badge", "INVALID_QUERY"), ("SELECT * FROM diver JOIN dive ON dive.badge = diver.badge", "INVALID_QUERY"), ("SELECT a.run FROM dive a JOIN find a ON a.run = a.run", "INVALID_QUERY"),
        ("SELECT q.sign FROM diver v JOIN dive d ON d.badge = v.badge", "INVALID_QUERY"), ("SELECT v.sign FROM diver v JOIN dive d ON v.badge = v.badge", "UNSUPPORTED_SQL"),
        ("SELECT v.sign FROM diver v JOIN dive d ON d.wreck = v.badge", "TYPE_MISMATCH"), ("SELECT a.no FROM setup a JOIN setup b ON a.how = b.how", "TYPE_MISMATCH"),
    ):
        assert code(site, sql) == want, sql
    assert rows(site, 'SELECT "Upper", "two words" FROM odd') == []


def test_unknown_names_and_bad_parameters(site):
    for sql, params, want in (
        ("SELECT no FROM lake", (), "TABLE_NOT_FOUND"), ("SELECT width FROM gauge", (), "COLUMN_NOT_FOUND"), ("SELECT gauge.width FROM gauge", (), "COLUMN_NOT_FOUND"), ("SELECT g.no FROM gauge", (), "INVALID_QUERY"),
        ("SELECT gauge.no FROM gauge g", (), "INVALID_QUERY"), ("SELECT no FROM gauge WHERE depth > $3", (1,), "BIND_ERROR"), ("SELECT no FROM gauge WHERE depth > $1", (2**53 + 1,), "BIND_ERROR"),
        ("SELECT no FROM gauge WHERE flow < $1", (float("inf"),), "BIND_ERROR"),
    ):
        assert code(site, sql, *params) == want, sql


def test_membership(site):
    dived = {d[1] for d in DIVES if d[1] is not None}
    assert rows(site, "SELECT sign FROM diver WHERE badge IN (SELECT badge FROM dive WHERE metres > 15) ORDER BY sign") == sorted((s,) for b, s in DIVERS if b in dived)
    assert rows(site, "SELECT sign FROM diver WHERE badge NOT IN (SELECT badge FROM dive)") == []  # one of the values is null, so nothing is known to be out
    assert rows(site, "SELECT sign FROM diver WHERE badge NOT IN (SELECT badge FROM dive WHERE metres > 15)") == [("Wren",)]
    assert rows(site, "SELECT run FROM dive WHERE badge NOT IN (SELECT tag FROM find WHERE tag < 0) ORDER BY run") == [(70,), (71,), (72,), (73,)]
    assert rows(site, "SELECT run FROM dive WHERE NOT (badge IN (SELECT badge FROM diver WHERE sign = 'Heron'))") == [(72,)]
    assert rows(site, "SELECT sign FROM diver WHERE sign = 'Wren' OR badge IN (SELECT min(badge) FROM dive) ORDER BY sign") == [("Kestrel",), ("Wren",)]
    for sql, want in (
        ("SELECT sign FROM diver WHERE badge IN (SELECT run, badge FROM dive)", "INVALID_QUERY"), ("SELECT sign FROM diver WHERE badge IN (SELECT wreck FROM dive)", "TYPE_MISMATCH"),
        ("SELECT sign FROM diver WHERE badge IN (SELECT badge FROM dive WHERE dive.metres > diver.badge)", "INVALID_QUERY"),
    ):
        assert code(site, sql) == want, sql


def test_json_values_are_compared_by_structure(site):
    assert rows(site, "SELECT no, how FROM setup ORDER BY no") == SETUPS
    for value, found in (({"unit": "cm", "rate": [0.5, 2]}, [1]), ({"unit": "cm"}, []), (12.0, [2]), ("manual", [3]), ([12], [])):
        assert rows(site, "SELECT no FROM setup WHERE how = $1", value) == [(k,) for k in found]
    assert rows(site, "SELECT no FROM setup WHERE how <> $1 ORDER BY no", "manual") == [(1,), (2,)] and rows(site, "SELECT no FROM setup WHERE how IN ($1, $2)", True, 12) == [(2,)]
    assert code(site, "SELECT no FROM setup WHERE how >= $1", 12) == "TYPE_MISMATCH"


def test_nested_queries(site):
    dives = {b: [d for d in DIVES if d[1] == b] for b, _ in DIVERS}
    got = site.query("""SELECT v.sign, l.list AS dives FROM diver v LEFT JOIN LATERAL (SELECT coalesce(json_agg(json_build_array(d.run, d.wreck) ORDER BY d.metres DESC), '[]') AS list
        FROM dive d WHERE d.badge = v.badge) l ON true ORDER BY sign""").rows
    assert got == sorted(({"sign": s, "dives": [[d[0], d[2]] for d in sorted(dives[b], key=lambda d: -d[3])]} for b, s in DIVERS), key=lambda r: r["sign"])
    deep = site.query("""SELECT v.badge, l.list AS dives FROM diver v LEFT JOIN LATERAL (SELECT coalesce(json_agg(json_build_array(d.wreck, k.kinds) ORDER BY d.run), '[]') AS list
        FROM (SELECT * FROM dive e WHERE e.badge = v.badge AND e.metres < $1 ORDER BY e.metres LIMIT $2) d LEFT JOIN LATERAL (SELECT coalesce(json_agg(f.kind ORDER BY f.tag DESC), '[]') AS kinds
        FROM find f WHERE f.run = d.run) k ON true) l ON true ORDER BY badge""", [40, 1]).rows
    assert deep == [{"badge": 1, "dives": []}, {"badge": 4, "dives": [["Lyra", ["bell", "coin"]]]}, {"badge": 9, "dives": []}]
    assert rows(site, "SELECT d.run, x.who FROM dive d LEFT JOIN LATERAL (SELECT json_build_array(y.sign) AS who FROM (SELECT * FROM diver v WHERE v.badge = d.badge LIMIT 1) y) x ON true ORDER BY run") == [
        (70, ["Heron"]), (71, ["Heron"]), (72, ["Kestrel"]), (73, None)]
    assert rows(site, "SELECT run, (SELECT to_json(w) FROM (SELECT diver.sign, diver.badge FROM diver WHERE diver.badge = dive.badge) AS w) AS who, (SELECT count(*) FROM find WHERE find.run = dive.run) AS n FROM dive ORDER BY run DESC LIMIT 2") == [
        (73, None, 0), (72, {"badge": 1, "sign": "Kestrel"}, 1)]
    assert rows(site, "SELECT sign, (SELECT coalesce(json_agg(r), '[]') FROM (SELECT dive.run, dive.metres FROM dive WHERE dive.badge = diver.badge ORDER BY dive.run DESC) AS r) AS runs FROM diver WHERE badge <> 1 ORDER BY diver.badge") == [
        ("Heron", [{"run": 71, "metres": 18}, {"run": 70, "metres": 31}]), ("Wren", [])]
    assert rows(site, "SELECT badge, (SELECT max(metres) FROM dive) AS deepest, (SELECT json_agg(f.kind ORDER BY f.kind) FROM find f JOIN dive d ON d.run = f.run WHERE d.badge = diver.badge) AS kinds FROM diver ORDER BY badge") == [
        (1, 44, ["anchor"]), (4, 44, ["bell", "coin"]), (9, 44, None)]
    for sql, want in (
        ("SELECT badge, (SELECT run FROM dive WHERE dive.badge = diver.badge) AS r FROM diver", "INVALID_QUERY"), ("SELECT badge, (SELECT run, wreck FROM dive WHERE dive.run = diver.badge) AS r FROM diver", "INVALID_QUERY"),
        ("SELECT badge, (SELECT json_agg(dive.metres + 1) FROM dive) AS r FROM diver", "UNSUPPORTED_SQL"), ("SELECT badge, (SELECT json_agg(d.weight) FROM dive d) AS r FROM diver", "COLUMN_NOT_FOUND"),
        ("SELECT badge, (SELECT count(*) FROM dive d WHERE d.run = diver.weight) AS r FROM diver", "COLUMN_NOT_FOUND"), ("SELECT v.badge FROM diver v CROSS JOIN LATERAL (SELECT run FROM dive) d", "UNSUPPORTED_SQL"),
        ("SELECT run FROM (SELECT run FROM dive) d", "UNSUPPORTED_SQL"), ("SELECT json_agg(v.sign), badge FROM diver v", "UNSUPPORTED_SQL"),
    ):
        assert code(site, sql) == want, sql


def test_gathered_order_of_every_kind(site):
    gathered = lambda order: rows(site, f"SELECT (SELECT json_agg(g.no ORDER BY {order}) FROM gauge g) AS x FROM diver WHERE badge = 1")[0][0]
    high = float("inf")
    assert gathered("g.depth, g.no") == [r[0] for r in sorted(GAUGES, key=lambda r: (high if r[2] is None else r[2], r[0]))]
    assert gathered("g.depth DESC, g.no DESC") == [13, 8, 3, 21, 5] and gathered("g.depth NULLS FIRST, g.no") == [13, 5, 21, 3, 8]
    assert gathered("g.live DESC NULLS LAST, g.flow") == [3, 8, 21, 5, 13] and gathered("g.river, g.no DESC") == [13, 3, 21, 5, 8]


# Models


def like(text, pattern, escape="\\"):
    """Plain backtracking."""
    if not pattern:
        return not text
    c = pattern[0]
    if escape and c == escape:
        return bool(text) and text[0] == pattern[1] and like(text[1:], pattern[2:], escape)
    if c == "%":
        return any(like(text[k:], pattern[1:], escape) for k in range(len(text) + 1))
    return bool(text) and (c == "_" or c == text[0]) and like(text[1:], pattern[1:], escape)


TEXTS = ["", "a", "A", "ab", "a%b", "a_b", "a\\b", "aXb", "é", "É", "🦀", "a🦀b", "ab\nab", "%", "_", "aa"]


@pytest.fixture(scope="module")
def texts(spark):
    db = Database(spark)
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    db.query("INSERT INTO t VALUES " + ", ".join(f"({k}, ${k + 1})" for k in range(len(TEXTS))), TEXTS)
    yield db
    db.close()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aAbé%_\\X🦀", max_size=5), st.sampled_from([None, "X", "", "%"]), st.booleans())
def test_like_is_that_of_the_model(texts, pattern, escape, folded):
    mark = "\\" if escape is None else escape
    ends = False
    k = 0
    while mark and k < len(pattern):
        if pattern[k] == mark:
            ends = k + 1 == len(pattern)
            k += 1
        k += 1
    sql = f"SELECT id FROM t WHERE v {'ILIKE' if folded else 'LIKE'} $1" + ("" if escape is None else f" ESCAPE '{escape}'") + " ORDER BY id"
    if ends:
        assert code(texts, sql, pattern) == "INVALID_QUERY"
        return
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x) if folded else x
    if folded and mark.isalpha():
        return
    assert rows(texts, sql, pattern) == [(k,) for k, v in enumerate(TEXTS) if like(low(v), low(pattern), mark)]


VALUES = [None, -2, 0, 3, 3.0, 2.5, "a", "b", True, False]


@pytest.mark.parametrize("kind,stored", [("INTEGER", [None, -2, 0, 3]), ("DOUBLE PRECISION", [None, -0.0, 2.5, 3.0]), ("TEXT", [None, "", "a", "b"]), ("BOOLEAN", [None, True, False])])
def test_predicates_are_those_of_three_valued_logic(db, kind, stored):
    db.exec(f"CREATE TABLE m (id INTEGER PRIMARY KEY, v {kind})")
    db.query("INSERT INTO m VALUES " + ", ".join(f"({k}, ${k + 1})" for k in range(len(stored))), stored)
    group = lambda v: "n" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__
    sample = next(v for v in stored if v is not None)
    for (operator, test), value in itertools.product(
        {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b}.items(), VALUES
    ):
        if value is not None and group(value) != group(sample):
            if operator == "=":
                assert code(db, f"SELECT id FROM m WHERE v {operator} $1", value) == "TYPE_MISMATCH"
            continue
        if operator in ("<>", ">=") and value not in (None, 3, "a", True):
            continue  # enough of the matrix
        known = [None if v is None or value is None else test(v, value) for v in stored]
        got = db.query(f"SELECT id FROM m WHERE v {operator} $1 OR NOT v {operator} $1 ORDER BY id", [value]).rows
        assert [r["id"] for r in got] == [k for k, x in enumerate(known) if x is not None]
        assert rows(db, f"SELECT id FROM m WHERE NOT (v {operator} $1) ORDER BY id", value) == [(k,) for k, x in enumerate(known) if x is False]


def test_limits_of_volume_hold_in_strict_databases_only(spark):
    many = spark.range(100_001).selectExpr("id", "id % 2000 AS k")
    for strict in (False, True):
        db = Database(spark, strict_limits=strict)
        db.attach("many", many, ["id"])
        if strict:
            assert code(db, "SELECT id FROM many") == "RESULT_LIMIT_EXCEEDED"
            assert code(db, "SELECT id FROM many WHERE id IN (SELECT k FROM many)") == "QUERY_WORK_LIMIT_EXCEEDED"
        else:
            assert len(db.query("SELECT id FROM many").rows) == 100_001
            assert len(db.query("SELECT id FROM many WHERE id IN (SELECT k FROM many)").rows) == 2_000
        db.close()
