"""Operator 6: secret scans with multipart credential linking.

Strong spans are found alone: assigned passwords and tokens, access key ids and
long hexadecimal runs.  Weak candidates (short secrets, short or named ids,
key-like runs, endpoints) are reported only where their complements are within
the same scope: the parts' intervals are joined by distance, an id with a
secret, a secret with an id or an endpoint, an endpoint with a secret.

Only DataFrame functions are used, row by row and without a shuffle.  Spans are
code points, the end exclusive.  A pattern's places come from splitting the text
at its matches.  Places, links and redactions are single sweeps over sorted
arrays, so that a text costs little more than in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts are in one scope if at most so many code points lie between them.
SCOPE = 200

# Patterns that Spark and DuckDB read alike.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of 16 and more among all runs
NAMED_ID = r"""((?i:user|username|login|client_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
KEY_RUN = r"[A-Za-z0-9+/]{40,}"
USERINFO = r"""(?:https?|ftp|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>/@:]*:[^\x20\x09-\x0D"'<>/@]+@"""
ENDPOINT = r"""(?:https?|ftp|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{2,5})?"""

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "named_id", "short_id", "short_secret", "key_run", "userinfo", "endpoint")
STRONG = KINDS[:3]
IDS, SECRETS, ENDPOINTS = ("access", "named_id", "short_id"), ("assign", "hex", "short_secret", "key_run", "userinfo"), ("endpoint",)
_PART = "struct<s:int,k:int,e:int>"
#: Steps of a sweep whose results are gathered at a time, at least, and code points of a piece of text.
_STEPS, _PIECE = 32, 256

# What follows makes SQL text: a lambda's variables are named apart, and a value that is used often is a lambda's variable.


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _swept(items: str, state: str, step: Callable[[str, str], tuple[str, str]], kind: str) -> str:
    """The results (an array of the type `kind`) of step(state, item) -> (state, result) over the items in order.

    An array that grows by an item a step is copied each time, so results are
    gathered in arrays of about the root of their number, and these in one.
    """
    none = f"CAST(array() AS array<{kind}>)"
    after, result = step("a.state", "x")
    one = f"(a, x) -> named_struct('state', {after}, 'out', concat(a.out, array({result})))"
    steps = f"greatest({_STEPS}, CAST(sqrt(size(own)) AS INT))"
    parts = f"transform(sequence(0, CAST(floor((size(own) - 1) / {steps}) AS INT)), k -> transform(sequence(k * {steps}, least(k * {steps} + {steps}, size(own)) - 1), i -> get(own, i)))"
    several = f"(acc, part) -> concat(acc, array(aggregate(part, named_struct('state', element_at(acc, -1).state, 'out', {none}), {one})))"
    whole = f"flatten(transform(aggregate({parts}, array(named_struct('state', {state}, 'out', {none})), {several}), y -> y.out))"
    return f"get(transform(array({items}), own -> CASE WHEN size(own) > 0 THEN {whole} ELSE {none} END), 0)"


def _found(text: str, pattern: str, group: int = 0) -> str:
    """Spans of all matches as (start, end, length of `group`)."""
    kind, p = "struct<s:int,e:int,n:int>", _quoted(pattern)
    part = f"regexp_extract(z.whole, {p}, {group})" if group else "z.whole"
    pairs = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, whole) -> named_struct('gap', gap, 'whole', whole))"
    sizes = f"transform(filter({pairs}, z -> z.whole IS NOT NULL), z -> named_struct('g', char_length(z.gap), 'w', char_length(z.whole), 'n', char_length({part})))"

    def step(at, x):
        return f"{at} + {x}.g + {x}.w", f"named_struct('s', {at} + {x}.g, 'e', {at} + {x}.g + {x}.w, 'n', {x}.n)"

    return f"CASE WHEN {text} RLIKE {p} THEN {_swept(sizes, '0', step, kind)} ELSE CAST(array() AS array<{kind}>) END"


def _of_kind(spans: str, kind: str, least: int, most: int | None = None) -> str:
    upper = f" AND x.n <= {most}" if most is not None else ""
    return f"transform(filter({spans}, x -> x.n >= {least}{upper}), x -> named_struct('s', x.s, 'k', {KINDS.index(kind)}, 'e', x.e))"


def _linked(parts: str) -> str:
    """The weak ones of the parts (sorted) whose complement lies within the scope, by a sweep each way.

    A complement that begins no later must reach to the scope before the part;
    one that begins no earlier must begin in the scope behind it.
    """
    listed_ = lambda kinds: ", ".join(str(KINDS.index(k)) for k in kinds)
    groups = {"secret": listed_(SECRETS), "id": listed_(IDS), "stop": listed_(ENDPOINTS)}

    def seen(state, x, better, value):
        return "named_struct(" + ", ".join(f"'{f}', CASE WHEN {x}.k IN ({g}) THEN {better}({state}.{f}, {value}) ELSE {state}.{f} END" for f, g in groups.items()) + ")"

    def near(state, x, fits):
        has = lambda f: f"coalesce({state}.{f} {fits}, false)"
        return f"CASE WHEN {x}.k IN ({groups['secret']}) THEN {has('id')} OR {has('stop')} ELSE {has('secret')} END"

    def ahead(state, x):
        return seen(state, x, "greatest", f"{x}.e"), f"named_struct('s', {x}.s, 'k', {x}.k, 'e', {x}.e, 'near', {near(state, x, f'>= {x}.s - {SCOPE}')})"

    def back(state, x):
        return seen(state, x, "least", f"{x}.s"), f"named_struct('s', {x}.s, 'k', {x}.k, 'e', {x}.e, 'near', {x}.near OR {near(state, x, f'<= {x}.e + {SCOPE}')})"

    none = "named_struct('secret', CAST(NULL AS INT), 'id', CAST(NULL AS INT), 'stop', CAST(NULL AS INT))"
    kind = "struct<s:int,k:int,e:int,near:boolean>"
    both = _swept(f"reverse({_swept(parts, none, ahead, kind)})", none, back, kind)
    return f"transform(filter({both}, x -> x.near AND x.k >= {len(STRONG)}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"


def scan(documents: DataFrame) -> DataFrame:
    """`documents` (text and any others) with secret_base and secret_all: arrays of (s, k, e), the start, the kind's place in KINDS and the end.

    Both are sorted by start, then kind.  A null or empty text has no spans; a
    very long text, however many spans it has, is scanned whole.  Equal texts
    have equal spans; rows and other columns stay as they are; those that begin
    with secret_ are the operator's own.  No row gives no row.
    """
    own = {"assigns": (ASSIGN, 2), "accesses": (ACCESS, 0), "hexes": (HEX, 0), "names": (NAMED_ID, 2), "runs": (KEY_RUN, 0), "users": (USERINFO, 0), "ends": (ENDPOINT, 0)}
    text = "coalesce(CAST(text AS STRING), '')"
    first = documents.withColumns({f"secret_{name}": F.expr(_found(text, *pattern)) for name, pattern in own.items()})
    base = ", ".join([_of_kind("secret_assigns", "assign", 12), _of_kind("secret_accesses", "access", 18), _of_kind("secret_hexes", "hex", 16)])
    weak = ", ".join([
        _of_kind("secret_names", "named_id", 3), _of_kind("secret_accesses", "short_id", 12, 17), _of_kind("secret_assigns", "short_secret", 6, 11),
        _of_kind("secret_runs", "key_run", 40), _of_kind("secret_users", "userinfo", 1), _of_kind("secret_ends", "endpoint", 1),
    ])
    second = first.withColumns({"secret_base": F.expr(f"array_sort(concat({base}))"), "secret_parts": F.expr(f"array_sort(concat({base}, {weak}))")})
    linked = f"CASE WHEN size(secret_parts) > size(secret_base) THEN {_linked('secret_parts')} ELSE CAST(array() AS array<{_PART}>) END"
    out = second.withColumn("secret_all", F.expr(f"array_sort(concat(secret_base, {linked}))"))
    return out.drop(*(f"secret_{name}" for name in own), "secret_parts")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: str = "text", spans: str = "secret_all", mark: str = "[SECRET]") -> Column:
    """The text (a column's name) with each run of overlapping spans (another's), endpoints left out, replaced by `mark`."""
    kept = f"filter({spans}, x -> x.k <> {KINDS.index('endpoint')})"

    def between(start, end):
        first, last, skip = f"CAST(floor({start} / {_PIECE}) AS INT)", f"CAST(floor({end} / {_PIECE}) AS INT)", f"{start} % {_PIECE} + 1"
        inside = f"substring(get(pieces, {first}), {skip}, {end} - {start})"
        rest = f"array_join(slice(pieces, {first} + 2, greatest({last} - {first} - 1, 0)), ''), coalesce(substring(get(pieces, {last}), 1, {end} % {_PIECE}), '')"
        return f"CASE WHEN {end} <= {start} THEN '' WHEN {first} = {last} THEN {inside} ELSE concat(substring(get(pieces, {first}), {skip}, {_PIECE}), {rest}) END"

    def step(at, x):
        return f"greatest({at}, {x}.e)", f"CASE WHEN {x}.s >= {at} THEN named_struct('a', {at}, 'e', {x}.s) END"

    # the gaps before the runs that are replaced, then the one behind the last
    gaps = f"concat(filter({_swept(kept, '0', step, 'struct<a:int,e:int>')}, g -> g IS NOT NULL), array(named_struct('a', array_max(transform({kept}, x -> x.e)), 'e', char_length({text}))))"
    whole = f"array_join(transform({gaps}, g -> {between('g.a', 'g.e')}), '{mark}')"
    return F.expr(f"CASE WHEN size({kept}) > 0 THEN get(transform(array(regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)), pieces -> {whole}), 0) ELSE {text} END")


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, the digest of the base spans, and all spans, for every row; see `scan`."""
    found = scan(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    number = lambda kind: F.size(F.filter("secret_base", lambda x: x["k"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in STRONG), F.sha2(listed(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_all")).alias("spans")
    )


def oracle_sql() -> str:
    """DuckDB SQL for `secret_report`."""
    quoted = lambda p: p.replace("'", "''")

    def spans(pattern: str, group: int, name: str) -> str:
        p = quoted(pattern)
        return f"""
{name}_m AS (SELECT r, unnest(regexp_extract_all(t, '{p}', 0)) AS whole, unnest(regexp_extract_all(t, '{p}', {group})) AS part,
  generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS i, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')),
{name} AS (SELECT r, CAST(sum(length(gaps[i]) + length(whole)) OVER (PARTITION BY r ORDER BY i) - length(whole) AS BIGINT) AS s,
  CAST(sum(length(gaps[i]) + length(whole)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e, length(part) AS n FROM {name}_m)"""

    own = [("f_assign", ASSIGN, 2), ("f_access", ACCESS, 0), ("f_hex", HEX, 0), ("f_name", NAMED_ID, 2), ("f_run", KEY_RUN, 0), ("f_user", USERINFO, 0), ("f_end", ENDPOINT, 0)]
    number = KINDS.index
    near = lambda kinds: f"EXISTS (SELECT 1 FROM parts y WHERE y.r = x.r AND y.k IN ({', '.join(str(number(k)) for k in kinds)}) AND greatest(x.s, y.s) - least(x.e, y.e) <= {SCOPE})"
    secrets = ", ".join(str(number(k)) for k in SECRETS)
    name = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    one = f"{name} || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{",".join(spans(p, g, n) for n, p, g in own)},
base AS (SELECT r, s, {number('assign')} AS k, e FROM f_assign WHERE n >= 12 UNION ALL SELECT r, s, {number('access')}, e FROM f_access WHERE n >= 18
  UNION ALL SELECT r, s, {number('hex')}, e FROM f_hex WHERE n >= 16),
weak AS (SELECT r, s, {number('named_id')} AS k, e FROM f_name UNION ALL SELECT r, s, {number('short_id')}, e FROM f_access WHERE n BETWEEN 12 AND 17
  UNION ALL SELECT r, s, {number('short_secret')}, e FROM f_assign WHERE n BETWEEN 6 AND 11
  UNION ALL SELECT r, s, {number('key_run')}, e FROM f_run UNION ALL SELECT r, s, {number('userinfo')}, e FROM f_user UNION ALL SELECT r, s, {number('endpoint')}, e FROM f_end),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
every AS (SELECT * FROM base UNION ALL SELECT * FROM weak x WHERE CASE WHEN k IN ({secrets}) THEN {near(IDS + ENDPOINTS)} ELSE {near(SECRETS)} END),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({one}, ',' ORDER BY s, k) AS l FROM base GROUP BY r),
a AS (SELECT r, string_agg({one}, ',' ORDER BY s, k) AS l FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.l, '')) AS base_sha256, coalesce(a.l, '') AS spans
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN a ON a.r = d.r
"""
