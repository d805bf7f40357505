"""SQL twins of the registered queries, for an independent engine (DuckDB).

Each string is one statement over the test tables.  The extraction is written again in
plain relational SQL: no pre-aggregation, no bundle deduplication, row numbers in place of
min_by/max_by, level-by-level ancestors in place of the walk.  Patterns are the fixed ones
in their RE2 form.
"""

from __future__ import annotations

from opatlas import fixed_values as V
from opatlas.functions.patterns import balanced, re2
from opatlas.operators import schema
from opatlas.plans.queries import STORED_UNTIL
from opatlas.sources import derived

_LEVELS = 8  # nesting the twin follows; the derived captures stay below


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def p(pattern: str) -> str:
    """Pattern literal in RE2 form."""
    return q(re2(pattern))


def _any(column: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(m)})" for m in marks) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {p(pattern)}, {group}), '')"


def every(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {p(pattern)}, {group})"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _replace(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {q(old)}, {new})"
    return text


_N, _T, _R = "chr(10)", "chr(9)", "chr(13)"
_UNESCAPE_JSON = [("\\n", _N), ("\\t", _T), ('\\"', q('"')), ("\\\\", q("\\"))]
_UNESCAPE_SCRIPT = [
    ("\\n", _N), ("\\r", _R), ("\\t", _T), ('\\"', q('"')), ("\\'", q("'")), ("\\\\", q("\\")),
]
_UNESCAPE_CONSTANT = [
    ("\\n", _N), ("\\t", _T), ('\\"', q('"')), ("\\'", q("'")), ("\\\\", q("\\")),
]


def capital(text: str) -> str:
    return f"(upper(left({text}, 1)) || substr({text}, 2))"


# --- captures -----------------------------------------------------------------

_SHA256 = "sha256({})"
_API = derived.api_columns(q, _SHA256)
_SCRIPT = derived.script_columns(q, _SHA256)
_MESSAGE = derived.message_columns(q, _SHA256)
_HOST = "'h' || cast(user_id % 3 as varchar) || '.example.com'"
_START = f"TIMESTAMP '{derived.DERIVED_START}'"

API = f"""api AS (
  SELECT event_id AS capture_id, ts, {_HOST} AS host, {_API['path']} AS path,
         'https://' || {_HOST} || {_API['path']} AS url, {_API['method']} AS method,
         {_API['req_body']} AS req_body
  FROM events)"""
SCR = f"""scr AS (
  SELECT page_id + {derived.PAGE_ID_BASE} AS capture_id, {_START} + page_id * INTERVAL 1 SECOND AS ts,
         '/static/' || cast({derived.SCRIPT_ID} as varchar) || '.js' AS path,
         'https://cdn.example.com/static/' || cast({derived.SCRIPT_ID} as varchar) || '.js' AS url,
         {_SCRIPT['resp_content_type']} AS content_type, {_SCRIPT['resp_body']} AS body
  FROM pages),
admitted AS (
  SELECT *, sha256(body) AS bundle_id FROM scr
  WHERE regexp_matches(content_type, {p(V.SCRIPT_CONTENT_TYPE)})
    AND {_any('body', V.SCRIPT_MARKS)}),
bundles AS (SELECT DISTINCT bundle_id, body FROM admitted)"""
WS = f"""ws AS (
  SELECT {derived.MESSAGE_ID_BASE} + conv_id * 1000 + turn AS capture_id,
         {_START} + (conv_id * 60 + turn) * INTERVAL 1 SECOND AS ts,
         'https://h0.example.com/ws' AS url, '/ws' AS path,
         CASE WHEN role = 'user' THEN 'CLIENT_TO_SERVER' ELSE 'SERVER_TO_CLIENT' END AS direction,
         {_MESSAGE['payload']} AS payload
  FROM conversations)"""

# --- request items --------------------------------------------------------------


_ITEM_NULLS = "NULL::VARCHAR"


def _id_items(form: str, label: str, ids: str, suffix: str = "''") -> str:
    return f"list_transform({ids}, lambda h: {{'form': '{form}', 'text': '{label}' || h || {suffix}, 'hash': h}})"


def _text_items(form: str, texts: str, text: str) -> str:
    return f"list_transform({texts}, lambda t: {{'form': '{form}', 'text': {text}, 'hash': {_ITEM_NULLS}}})"


def _concat(*lists: str) -> str:
    joined = lists[0]
    for other in lists[1:]:
        joined = f"list_concat({joined}, {other})"
    return joined


_SUFFIX = "CASE WHEN name IS NULL THEN '' ELSE ' (' || name || ')' END"
_BODY_ITEMS = _concat(
    _id_items(
        "persisted",
        "Persisted: ",
        f"CASE WHEN len({every('part', V.JSON_SHA256_HASH, 1)}) > 0 THEN {every('part', V.JSON_SHA256_HASH, 1)}"
        f" ELSE {every('part', V.JSON_HASH, 1)} END",
    ),
    _id_items("doc_id", "doc_id: ", every("part", V.JSON_DOC_ID, 1), _SUFFIX),
    _id_items("doc_id", "queryId: ", every("part", V.JSON_QUERY_ID, 1), _SUFFIX),
    _id_items("doc_id", "document_id: ", every("part", V.JSON_DOCUMENT_ID, 1), _SUFFIX),
    _text_items("json", every("part", V.JSON_QUERY, 1), _replace("t", _UNESCAPE_JSON)),
)
_URL_ITEMS = _concat(
    _id_items(
        "persisted",
        "Persisted GET: ",
        f"flatten(list_transform({every('url', V.URL_EXTENSIONS, 1)}, lambda e: "
        + every("url_decode(replace(e, '+', ' '))", V.DECODED_HASH, 1)
        + "))",
    ),
    _text_items("plain", every("url", V.URL_QUERY, 1), "url_decode(replace(t, '+', ' '))"),
)
# Batches of the derived captures are JSON.
HTTP_ITEMS = f"""post_parts AS (
  SELECT capture_id, ts, url, path AS endpoint, method, u.part, u.no - 1 AS part_no
  FROM api, unnest(CASE WHEN regexp_matches(req_body, {p(V.BATCH_START)})
                        THEN CAST(json_extract(req_body, '$[*]') AS VARCHAR[])
                        ELSE [req_body] END) WITH ORDINALITY AS u(part, no)
  WHERE upper(method) = 'POST' AND {_any('req_body', V.BODY_MARKS)}),
parts AS (SELECT *, {first('part', V.JSON_OPERATION_NAME)} AS name FROM post_parts),
http_items AS (
  SELECT capture_id, ts, url, endpoint, method, part_no, u.no - 1 AS item_no, name, u.item
  FROM parts, unnest({_BODY_ITEMS}) WITH ORDINALITY AS u(item, no)
  UNION ALL
  SELECT capture_id, ts, url, path, method, 0, u.no - 1, NULL, u.item
  FROM api, unnest({_URL_ITEMS}) WITH ORDINALITY AS u(item, no)
  WHERE upper(method) = 'GET' AND {_any('url', V.URL_MARKS)}),
http_in AS (
  SELECT capture_id, ts, url, endpoint, method,
         CASE WHEN item.hash IS NOT NULL THEN 'PERSISTED_QUERY' ELSE 'HTTP_POST' END AS source,
         part_no * 1000000000000 + item_no * 1000000 AS ord, item.form AS form, item.text AS text, name,
         item.hash AS hash
  FROM http_items)"""

_SOCKET_ITEMS = _concat(
    _text_items("json", every("payload", V.JSON_QUERY, 1), _replace("t", _UNESCAPE_JSON)),
    _id_items("persisted", "WS Persisted: ", every("payload", V.JSON_SHA256_HASH, 1)),
)
WS_ITEMS = f"""ws_admitted AS (
  SELECT *, {first('payload', V.JSON_OPERATION_NAME)} AS name
  FROM ws WHERE direction = '{V.SOCKET_DIRECTION}' AND {_any('payload', V.SOCKET_MARKS)}),
ws_in AS (
  SELECT capture_id, ts, url, path AS endpoint, 'WS' AS method, 'WEBSOCKET' AS source,
         (u.no - 1) * 1000000 AS ord, u.item.form AS form, u.item.text AS text, name, u.item.hash AS hash
  FROM ws_admitted, unnest({_SOCKET_ITEMS}) WITH ORDINALITY AS u(item, no))"""


# Strings are kept, comments outside of them go.
_COMMENT, _KEPT = r'("(?:[^"\\\n]|\\[^\n])*")|#[^\n\r]*', "\\1"


def classified(source: str, target: str, keys: str) -> str:
    """CTEs that turn the items of ``source`` into the operations of ``target``."""
    named = (
        f"list_transform(list_zip({every('body', V.NAMED_OPERATION, 1)}, {every('body', V.NAMED_OPERATION, 2)}),"
        " lambda z: {'t': z[1], 'n': z[2]})"
    )
    fragments = f"list_transform({every('body', V.FRAGMENT_DEFINITION, 1)}, lambda f: {{'t': 'fragment', 'n': f}})"
    return f"""{target}_body AS (
  SELECT *, CASE WHEN form IN ('persisted', 'doc_id', 'compact') THEN text
                 ELSE {collapse(f"regexp_replace(text, {q(_COMMENT)}, {q(_KEPT)}, 'g')")} END AS body,
         coalesce(nullif(name, ''), 'anonymous') AS fallback
  FROM {source}),
{target}_declared AS (
  SELECT *, CASE WHEN form IN ('persisted', 'doc_id', 'compact') THEN []
                 ELSE list_concat({named}, {fragments}) END AS declared
  FROM {target}_body),
{target}_hits AS (
  SELECT *, CASE
      WHEN form IN ('persisted', 'doc_id') THEN [{{'t': form, 'n': fallback}}]
      WHEN form = 'compact' THEN [{{'t': regexp_extract(body, '^(\\w+)\\s+(\\w+)', 1), 'n': regexp_extract(body, '^(\\w+)\\s+(\\w+)', 2)}}]
      WHEN len(declared) > 0 THEN declared
      WHEN regexp_matches(body, {p(V.ANONYMOUS_OPERATION)})
        THEN [{{'t': regexp_extract(body, {p(V.ANONYMOUS_OPERATION)}, 1), 'n': fallback}}]
      WHEN starts_with(body, '...') AND regexp_matches(body, {p(V.INLINE_FRAGMENT)})
        THEN [{{'t': 'fragment', 'n': regexp_extract(body, {p(V.INLINE_FRAGMENT)}, 1)}}]
      WHEN contains(body, '{{') AND contains(body, '}}')
           AND (contains(body, '{V.TYPENAME_MARK}') OR regexp_matches(body, {p(V.SELECTION_LIKE)}))
        THEN [{{'t': 'query', 'n': fallback}}]
      ELSE [] END AS hits
  FROM {target}_declared),
{target} AS (
  SELECT {keys}, ord + u.no - 1 AS ord, u.hit.t AS operation_type, u.hit.n AS operation_name,
         hash AS persisted_hash, body AS operation_body
  FROM {target}_hits, unnest(hits) WITH ORDINALITY AS u(hit, no))"""


_CAPTURE_KEYS = "capture_id, ts, url, endpoint, method, source"
HTTP_OPS = ",\n".join([API, HTTP_ITEMS, classified("http_in", "http_ops", _CAPTURE_KEYS)])
WS_OPS = ",\n".join([WS, WS_ITEMS, classified("ws_in", "ws_ops", _CAPTURE_KEYS)])

# --- cleaning -------------------------------------------------------------------

_LITERAL = '"(' + V.STRING_RUN + ')"'
_BLOCK = balanced("{", "}", _LEVELS)
_TOKEN = (
    r'\s+|"(?:[^"\\]|\\[\s\S])*"|#[^\n]*|[A-Za-z0-9_]+|\.\.\.|[{}()\[\]:,!$@=|]'
    r"|[-.][0-9][A-Za-z0-9_]*"
)


def _literals(text: str) -> str:
    return f"array_to_string({every(text, _LITERAL, 1)}, '')"


def fold(items: str, start: str, cell: str, step: str) -> str:
    """Walk over a list: ``a`` is the state so far, ``x`` the next item ``t`` as a cell of the state's type."""
    return f"list_reduce(list_concat([{start}], list_transform({items}, lambda t: {cell})), lambda a, x: {step})"


_PARENTHESES = "regexp_extract_all({}, '[^()]*[()]|[^()]+')"
_STEP = "CASE WHEN ends_with(x.piece, '(') THEN 1 WHEN ends_with(x.piece, ')') THEN -1 ELSE 0 END"
_LESS_ONE = "left({0}, length({0}) - 1)"


def flattened(text: str) -> str:
    """A walk over the parentheses; a call that stays open takes the rest of the text."""
    walked = fold(
        _PARENTHESES.format(text),
        "{'depth': 0, 'done': '', 'args': '', 'piece': ''}",
        "{'depth': 0, 'done': '', 'args': '', 'piece': t}",
        f"""CASE
      WHEN a.depth = 0 AND ends_with(x.piece, '.concat(')
        THEN {{'depth': 1, 'done': a.done || left(x.piece, length(x.piece) - 8), 'args': '', 'piece': ''}}
      WHEN a.depth = 0 THEN {{'depth': 0, 'done': a.done || x.piece, 'args': '', 'piece': ''}}
      WHEN a.depth + {_STEP} = 0
        THEN {{'depth': 0, 'done': a.done || {_literals("(a.args || left(x.piece, length(x.piece) - 1))")}, 'args': '', 'piece': ''}}
      ELSE {{'depth': a.depth + {_STEP}, 'done': a.done, 'args': a.args || x.piece, 'piece': ''}} END""",
    )
    return (
        f"list_transform([{walked}], lambda r: r.done || CASE WHEN r.depth = 0 THEN '' WHEN r.args = '' THEN '.concat('"
        f" ELSE {_literals(_LESS_ONE.format('r.args'))} END)[1]"
    )


def without_syntax(text: str) -> str:
    for pattern, new in [
        (V.JOINED_BOTH_SIDES, " "), (V.JOINED_RIGHT, " "), (V.JOINED_LEFT, " "),
        (V.TEMPLATE_HOLE, ""), (V.CONDITIONAL, ""),
    ]:
        text = f"regexp_replace({text}, {p(pattern)}, {q(new)}, 'g')"
    return _replace(text, _UNESCAPE_SCRIPT)


def sanitized(text: str) -> str:
    return (
        f"array_to_string(list_filter(regexp_extract_all({text}, {q(_TOKEN)}),"
        f" lambda t: t NOT IN {_in(V.SCRIPT_ONLY_WORDS)} AND NOT starts_with(t, '#')), '')"
    )


def trimmed(text: str) -> str:
    whole = "^[^{}]*(?:" + _BLOCK + "[^{}]*)+$"
    return (
        f"CASE WHEN regexp_matches({text}, {p(whole)}) THEN regexp_replace({text}, '[^}}]*$', '')"
        f" ELSE {text} END"
    )


def cleaned(source: str, target: str, where: str) -> str:
    """CTEs that clean ``text`` of the rows of ``where``, one step each."""
    steps = [flattened("text"), without_syntax("text"), sanitized("text"), trimmed("text"), collapse("text")]
    ctes, current = [], source
    for number, step in enumerate(steps, start=1):
        name = target if number == len(steps) else f"{target}_{number}"
        ctes.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {where} THEN {step} ELSE text END AS text) FROM {current})")
        current = name
    return ",\n".join(ctes)


# --- script items ---------------------------------------------------------------

_RAW = V.OPERATION_HEAD + _BLOCK
_COMPACT = V.COMPACT_HEAD + _BLOCK
_FORMS = {
    "tagged": (0, "JS_FILE", "template", V.TAGGED_TEMPLATE, 1),
    "raw": (1, "JS_FILE", "region", _RAW, 0),
    "hash": (2, "JS_FILE", "persisted", V.JSON_SHA256_HASH, 1),
    "property": (3, "MINIFIED_JS", "string", V.PROPERTY_STRING, 1),
    "quoted": (4, "MINIFIED_JS", "quoted", V.QUOTED_OPERATION, 1),
    "compact": (5, "MINIFIED_JS", "compact", _COMPACT, 0),
    "query_field": (6, "MINIFIED_JS", "string", V.QUERY_FIELD, 1),
    "body_field": (7, "MINIFIED_JS", "string", V.BODY_FIELD, 1),
    "text_field": (8, "MINIFIED_JS", "string", V.TEXT_FIELD, 1),
    "hex_id": (9, "MINIFIED_JS", "persisted", V.HEX_ID, 0),
    "node_name_first": (10, "MINIFIED_JS", "doc_id", V.REQUEST_NODE_NAME_FIRST, 0),
    "node_id_first": (11, "MINIFIED_JS", "doc_id", V.REQUEST_NODE_ID_FIRST, 0),
    "query_id": (12, "MINIFIED_JS", "doc_id", V.SCRIPT_QUERY_ID, 0),
    "doc_id": (13, "MINIFIED_JS", "doc_id", V.SCRIPT_DOC_ID, 0),
}


def _script_item(name: str) -> str:
    rank, source, form, pattern, group = _FORMS[name]
    body = f"bundles, unnest({every('body', pattern, group)}) WITH ORDINALITY AS u(m, no)"
    ord_ = f"{rank} * 1000000000000 + (u.no - 1) * 1000000"
    head = f"SELECT bundle_id, '{source}' AS source, {ord_} AS ord, '{form}' AS form, "
    if name == "hash":
        return head + f"'JS Persisted: ' || m AS text, NULL AS name, m AS hash FROM {body}"
    if name in ("node_name_first", "node_id_first"):
        name_group, id_group = (1, 2) if name == "node_name_first" else (2, 1)
        node, id_ = (f"regexp_extract(m, {p(pattern)}, {g})" for g in (name_group, id_group))
        return head + f"'Relay doc_id: ' || {id_} || ' (' || {node} || ')', {node}, {id_} FROM {body}"
    if name in ("hex_id", "query_id", "doc_id"):
        reach = V.HASH_CONTEXT_CHARS if name == "hex_id" else V.ID_CONTEXT_CHARS
        between = f"regexp_split_to_array(body, {p(re2(pattern).replace('(', '(?:').replace('(?:?:', '(?:'))})"
        context = f"right({between}[u.no], {reach}) || left(m || {between}[u.no + 1], {reach})"
        id_ = f"regexp_extract(m, {p(pattern)}, 1)"
        rows = f"(SELECT bundle_id, {ord_} AS ord, {id_} AS id, {context} AS context FROM {body})"
        start = f"SELECT bundle_id, '{source}', ord, '{form}', "
        if name == "hex_id":
            found = first("context", V.JSON_OPERATION_NAME)
            return (
                start + f"'Minified Persisted: ' || id, {found}, id FROM {rows}"
                f" WHERE {_any('context', V.HASH_CONTEXT_MARKS)}"
            )
        label = "Meta queryID: " if name == "query_id" else "Meta doc_id: "
        found = f"coalesce({first('context', V.NEARBY_NAME)}, 'anonymous')"
        return start + f"'{label}' || id || ' (' || {found} || ')', {found}, id FROM {rows}"
    text = _replace("m", _UNESCAPE_SCRIPT) if form in ("string", "quoted") else "m"
    kept = f" WHERE regexp_matches(m, {p('^' + V.COMPACT_HEAD + V.COMPACT_BLOCK)})"
    return head + f"{text} AS text, NULL AS name, NULL AS hash FROM {body}" + (kept if name == "compact" else "")


def script_ops(names: list[str], target: str = "js_ops") -> str:
    items = "\nUNION ALL\n".join(_script_item(n) for n in names)
    return ",\n".join(
        [
            SCR,
            f"js_in (bundle_id, source, ord, form, text, name, hash) AS ({items})",
            cleaned("js_in", "js_clean", "form NOT IN ('persisted', 'doc_id')"),
            classified("js_clean", target, "bundle_id, source"),
        ]
    )


# --- constants and chains -------------------------------------------------------


def _is_operation(text: str) -> str:
    return f"regexp_matches(trim({text}), {p(V.IS_OPERATION)})"


def _is_fragment(text: str) -> str:
    return f"regexp_matches(trim({text}), {p(V.IS_INLINE_FRAGMENT)})"


def _assignments(pattern: str, pass_no: int) -> str:
    pairs = f"list_zip({every('body', pattern, 1)}, {every('body', pattern, 2)})"
    return f"SELECT bundle_id, body, u.z[1] AS name, {_replace('u.z[2]', _UNESCAPE_CONSTANT)} AS value, {pass_no} AS pass, u.no AS pos FROM bundles, unnest({pairs}) WITH ORDINALITY AS u(z, no)"


CONSTANTS = f"""assigned AS (
  {_assignments(V.DECLARED_CONSTANT, 0)} UNION ALL {_assignments(V.PROPERTY_CONSTANT, 1)}),
constants AS (
  SELECT bundle_id, body, name, value FROM assigned
  QUALIFY row_number() OVER (PARTITION BY bundle_id, name ORDER BY pass DESC, pos DESC) = 1)"""

_HEAD = '"' + V.STRING_RUN_OR_EMPTY + '"' + r"\s*\.concat\s*\("
_BASE = f"regexp_extract(u.head, {p('^' + chr(34) + '(' + V.STRING_RUN_OR_EMPTY + ')' + chr(34))}, 1)"
# From a head on: calls that follow each other, their arguments up to the closing parenthesis.
_LINKS = fold(
    _PARENTHESES.format("behind"),
    "{'depth': 1, 'args': '', 'links': []::VARCHAR[], 'over': false, 'piece': ''}",
    "{'depth': 0, 'args': '', 'links': []::VARCHAR[], 'over': false, 'piece': t}",
    f"""CASE
      WHEN a.over THEN a
      WHEN a.depth = 0 THEN {{'depth': 1, 'args': '', 'links': a.links, 'over': NOT regexp_matches(x.piece, {p(r'^\.concat\s*\($')}), 'piece': ''}}
      WHEN a.depth + {_STEP} = 0
        THEN {{'depth': 0, 'args': '', 'links': list_append(a.links, a.args || {_LESS_ONE.format('x.piece')}), 'over': false, 'piece': ''}}
      ELSE {{'depth': a.depth + {_STEP}, 'args': a.args || x.piece, 'links': a.links, 'over': false, 'piece': ''}} END""",
)
# Stage 1 begins behind the first ? outside of strings and brackets, stage 2 behind the next such colon.
_SPLIT = fold(
    "regexp_extract_all(argument, '\"(?:[^\"\\\\]|\\\\[\\s\\S])*\"|[()\\[\\]?:]|[^()\\[\\]?:\"]+')",
    "{'depth': 0, 'stage': 0, 'yes': '', 'no': '', 't': ''}",
    "{'depth': 0, 'stage': 0, 'yes': '', 'no': '', 't': t}",
    """CASE
      WHEN a.depth = 0 AND ((a.stage = 0 AND x.t = '?') OR (a.stage = 1 AND x.t = ':'))
        THEN {'depth': 0, 'stage': a.stage + 1, 'yes': a.yes, 'no': a.no, 't': ''}
      ELSE {'depth': a.depth + CASE WHEN x.t IN ('(', '[') THEN 1 WHEN x.t IN (')', ']') THEN -1 ELSE 0 END, 'stage': a.stage,
            'yes': CASE WHEN a.stage = 1 THEN a.yes || x.t ELSE a.yes END,
            'no': CASE WHEN a.stage = 2 THEN a.no || x.t ELSE a.no END, 't': ''} END""",
)
_IS_STRING = f"regexp_matches(argument, {p(V.WHOLE_STRING)})"


CHAINS = f"""chain_texts AS (
  SELECT bundle_id, body, {every('body', _HEAD)} AS heads, regexp_split_to_array(body, {p(_HEAD)}) AS between
  FROM bundles WHERE contains(body, '.concat')),
chain_heads AS (
  SELECT bundle_id, u.no AS chain_no, {_replace(_BASE, _UNESCAPE_JSON)} AS base,
         substr(body, 1 + CAST(list_sum(list_transform(list_concat(heads[:u.no], between[:u.no]), lambda h: length(h))) AS BIGINT)) AS behind
  FROM chain_texts, unnest(heads) WITH ORDINALITY AS u(head, no)),
op_chains AS (
  SELECT bundle_id, chain_no, base, {_LINKS}.links AS args FROM chain_heads WHERE {_is_operation('base')}),
split_links AS (
  SELECT *, {_SPLIT} AS sides
  FROM (SELECT bundle_id, chain_no, u.no AS link_no, trim(u.argument) AS argument
        FROM op_chains, unnest(args) WITH ORDINALITY AS u(argument, no))),
links AS (
  SELECT *, {_IS_STRING} AS is_string, NOT {_IS_STRING} AND sides.stage = 2 AS is_conditional FROM split_links),
candidates AS (
  SELECT bundle_id, chain_no, 0 AS link_no, 0 AS branch, '"' || base || '"' AS expr, false AS drop_blank, true AS is_base FROM op_chains
  UNION ALL
  SELECT bundle_id, chain_no, link_no, 0, argument, is_string, false FROM links WHERE NOT is_conditional
  UNION ALL
  SELECT bundle_id, chain_no, link_no, 1, trim(sides.yes), true, false FROM links WHERE is_conditional
  UNION ALL
  SELECT bundle_id, chain_no, link_no, 2, trim(sides.no), true, false FROM links WHERE is_conditional),
resolved AS (
  SELECT c.bundle_id, chain_no, link_no, branch, drop_blank,
         CASE WHEN is_base THEN substr(expr, 2, length(expr) - 2)
              WHEN regexp_matches(expr, {p(V.WHOLE_STRING)}) THEN {_replace("substr(expr, 2, length(expr) - 2)", _UNESCAPE_JSON)}
              ELSE k.value END AS text
  FROM candidates c LEFT JOIN constants k ON c.bundle_id = k.bundle_id AND c.expr = k.name),
glued AS (
  SELECT bundle_id, chain_no, {collapse("string_agg(text, '' ORDER BY link_no, branch)")} AS query
  FROM resolved WHERE text IS NOT NULL AND (NOT drop_blank OR trim(text) <> '')
  GROUP BY bundle_id, chain_no),
found AS (
  SELECT bundle_id, 0 AS stage, 0 AS pass, chain_no AS pos, query, {first('query', V.ASSEMBLED_NAME)} AS name
  FROM glued WHERE {_is_operation('query')}
  UNION ALL
  SELECT bundle_id, 1, pass, pos, query,
         CASE WHEN {_is_operation('query')} THEN {first('query', V.ASSEMBLED_NAME)} ELSE {first('query', V.INLINE_FRAGMENT)} END
  FROM (SELECT c.bundle_id, a.pass, a.pos, {collapse('c.value')} AS query
        FROM constants c JOIN (SELECT bundle_id, name, min(pass * 1000000 + pos) // 1000000 AS pass,
                                      min(pass * 1000000 + pos) % 1000000 AS pos
                               FROM assigned GROUP BY bundle_id, name) a
          ON c.bundle_id = a.bundle_id AND c.name = a.name)
  WHERE {_is_operation('query')} OR {_is_fragment('query')}),
concat_in AS (
  SELECT bundle_id, 'JS_EXECUTED' AS source, (100 + stage * 10 + pass) * 1000000000000 + pos * 1000000 AS ord,
         'plain' AS form, query AS text, coalesce(name, '') AS name, NULL AS hash
  FROM found
  QUALIFY row_number() OVER (PARTITION BY bundle_id, query, coalesce(name, '') ORDER BY stage, pass, pos) = 1)"""

# --- findings -------------------------------------------------------------------

_KEY = "endpoint, operation_name, operation_type, coalesce(persisted_hash, '')"


def merged(source: str, target: str, where: str = "true") -> str:
    """CTEs that deduplicate the operations of ``source``."""
    return f"""{target}_ranked AS (
  SELECT *, coalesce(persisted_hash, '') AS hash_key,
         row_number() OVER (PARTITION BY {_KEY} ORDER BY ts, capture_id, ord) AS arrival,
         row_number() OVER (PARTITION BY {_KEY} ORDER BY length(operation_body) DESC, ts, capture_id, ord) AS length_rank
  FROM {source} WHERE {where}),
{target} AS (
  SELECT endpoint, operation_name, operation_type, hash_key AS persisted_hash,
         max(url) FILTER (arrival = 1) AS url, max(method) FILTER (arrival = 1) AS method,
         max(source) FILTER (arrival = 1) AS source,
         max(operation_body) FILTER (length_rank = 1) AS operation_body,
         min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT capture_id) AS n_seen,
         max(capture_id) FILTER (arrival = 1) AS first_id, max(ord) FILTER (arrival = 1) AS first_ord
  FROM {target}_ranked GROUP BY endpoint, operation_name, operation_type, hash_key)"""




def _all_ops(script_source: str) -> str:
    return f"""ops AS (
  SELECT * FROM http_ops
  UNION ALL SELECT * FROM ws_ops
  UNION ALL
  SELECT a.capture_id, a.ts, a.url, a.path, 'GET', j.source, j.ord, j.operation_type, j.operation_name,
         j.persisted_hash, j.operation_body
  FROM {script_source} j JOIN admitted a ON j.bundle_id = a.bundle_id)"""


_EXTRACTED = [HTTP_OPS, WS_OPS, script_ops(list(_FORMS))]
ALL_OPS = ",\n".join([*_EXTRACTED, _all_ops("js_ops")])
WITH_ASSEMBLED = ",\n".join(
    [
        *_EXTRACTED,
        CONSTANTS,
        CHAINS,
        classified("concat_in", "concat_ops", "bundle_id, source"),
        "all_js_ops AS (SELECT * FROM js_ops UNION ALL SELECT * FROM concat_ops)",
        _all_ops("all_js_ops"),
        merged("ops", "findings"),
    ]
)
FINDINGS = ALL_OPS + ",\n" + merged("ops", "findings")
STORED = ",\n".join(
    [
        ALL_OPS,
        merged("ops", "stored", f"ts < TIMESTAMP '{STORED_UNTIL}'"),
        merged("ops", "arrived", f"ts >= TIMESTAMP '{STORED_UNTIL}'"),
    ]
)
_SAME_KEY = " AND ".join(
    f"s.{c} = a.{c}" for c in ("endpoint", "operation_name", "operation_type", "persisted_hash")
)
_FINDING = (
    "endpoint, operation_name, operation_type, persisted_hash, url, method, source, operation_body,"
    " first_seen, last_seen, n_seen"
)
_OP = (
    "capture_id, url, endpoint, method, source, ord, operation_type, operation_name,"
    " coalesce(persisted_hash, '') AS persisted_hash, operation_body"
)
_BUNDLE_OP = (
    "bundle_id, source, ord, operation_type, operation_name,"
    " coalesce(persisted_hash, '') AS persisted_hash, operation_body"
)
_LABEL = "CASE source " + " ".join(f"WHEN {q(s)} THEN {q(t)}" for s, t in V.SOURCE_LABELS.items()) + " END"
_ONE_LINE = "replace(replace({0}, chr(10), ' '), chr(13), '')"

# --- structure ------------------------------------------------------------------

_TEXT = "operation_body <> '' AND operation_type NOT IN ('doc_id', 'persisted')"
BODIES = f"""bodies AS (
  SELECT operation_body AS body, sha256(operation_body) AS op_id,
         row_number() OVER (ORDER BY min((first_seen, first_id, first_ord))) AS op_no
  FROM findings WHERE {_TEXT} GROUP BY operation_body)"""

TOKENS = f"""tok0 AS (
  SELECT op_id, op_no, u.no - 1 AS pos, u.t AS t
  FROM bodies, unnest({every('body', V.TOKEN)}) WITH ORDINALITY AS u(t, no)),
tok1 AS (
  SELECT *, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS paren,
         lag(t, 1) OVER o AS p1, lag(t, 2) OVER o AS p2, lead(t, 1) OVER o AS n1, lead(t, 2) OVER o AS n2
  FROM tok0 WINDOW o AS (PARTITION BY op_id ORDER BY pos),
                   w AS (PARTITION BY op_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
tok2 AS (
  SELECT *, paren > 0 OR t = ')' AS inside FROM tok1),
tok3 AS (
  SELECT *, sum(CASE WHEN inside THEN 0 WHEN t = '{{' THEN 1 WHEN t = '}}' THEN -1 ELSE 0 END) OVER w AS depth,
         sum(CASE WHEN NOT inside THEN 0 WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER w AS nest
  FROM tok2 WINDOW w AS (PARTITION BY op_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
tok4 AS (
  SELECT *,
         coalesce(sum(CASE WHEN t = '}}' AND NOT inside AND depth = 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY op_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS def_no,
         last_value(CASE WHEN t = '(' AND nest = 1 THEN CASE WHEN p2 = '@' THEN 'd' ELSE 'a' END END IGNORE NULLS) OVER w AS grp,
         regexp_matches(t, '^[A-Za-z_]') AS is_name
  FROM tok3 WINDOW w AS (PARTITION BY op_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
tok AS (
  SELECT *, CASE
      WHEN NOT inside AND t = '{{' THEN 'open' WHEN NOT inside AND t = '}}' THEN 'close'
      WHEN NOT inside AND depth < 1 AND (is_name OR t = '...') THEN 'header'
      WHEN NOT inside AND t = '...' THEN 'spread'
      WHEN NOT inside AND is_name AND coalesce(p1 NOT IN ('@', '...') AND NOT (p1 = 'on' AND coalesce(p2, '') = '...'), true)
           AND coalesce(n1 <> ':', true) THEN 'field'
      WHEN inside AND is_name AND n1 = ':' AND nest = 1 AND depth >= 1 AND grp = 'a' THEN 'argument' END AS role
  FROM tok4)"""

_DEPTHS = range(2, _LEVELS + 2)
_OWNERS = ", ".join(
    f"last_value(CASE WHEN role = 'open' AND depth = {k} THEN {{'n': mark_before, 'p': mark_pos}} END IGNORE NULLS) OVER w AS o{k}"
    for k in _DEPTHS
)
_PATH = "[" + ", ".join(f"CASE WHEN depth >= {k} THEN o{k}.n END" for k in _DEPTHS) + "]"
_OWNER_POS = "CASE depth " + " ".join(f"WHEN {k} THEN o{k}.p" for k in _DEPTHS) + " ELSE def_pos END"
SELECTIONS = f"""def_heads AS (
  SELECT op_id, def_no, min(pos) AS def_pos,
         list(t ORDER BY pos) FILTER (role = 'header') AS head
  FROM tok WHERE role IS NOT NULL GROUP BY op_id, def_no),
marked AS (
  SELECT *,
         last_value(CASE WHEN role = 'field' THEN t WHEN role = 'spread' THEN '' END IGNORE NULLS) OVER b AS mark_before,
         last_value(CASE WHEN role IN ('field', 'spread') THEN pos END IGNORE NULLS) OVER b AS mark_pos
  FROM tok WHERE role IS NOT NULL
  WINDOW b AS (PARTITION BY op_id, def_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
owned AS (
  SELECT *, {_OWNERS} FROM marked
  WINDOW w AS (PARTITION BY op_id, def_no ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sel0 AS (
  SELECT o.op_id, o.op_no, o.pos, o.role AS kind, list_filter({_PATH}, lambda x: x IS NOT NULL) AS path,
         {_OWNER_POS} AS owner_pos, CASE WHEN role = 'argument' THEN mark_before ELSE t END AS name,
         t, n2 AS value, coalesce(d.head[1], '') AS word, coalesce(d.head[2], '') AS second,
         CASE WHEN d.head[1] = 'fragment' THEN d.head[4] WHEN d.head[1] = '...' THEN d.head[3] END AS on_type
  FROM owned o JOIN def_heads d ON o.op_id = d.op_id AND o.def_no = d.def_no
  WHERE role IN ('field', 'argument')),
sel AS (
  SELECT *, starts_with(name, '__') AS is_meta,
         CASE WHEN word IN ('query', 'mutation', 'subscription') THEN word
              WHEN on_type IS NULL THEN 'query'
              WHEN on_type IN ('Query', 'Mutation', 'Subscription') THEN lower(on_type) ELSE 'fragment' END AS def_type,
         CASE WHEN word IN ('query', 'mutation', 'subscription', 'fragment') THEN second ELSE '' END AS def_name
  FROM sel0 WHERE name <> '' AND len(list_filter(path, lambda x: x = '' OR starts_with(x, '__'))) = 0)"""


def _type_of(path: str) -> str:
    steps = f"list_transform({path}, lambda x: {capital('x')})"
    return (
        f"CASE WHEN def_type = 'fragment' THEN array_to_string(list_concat([on_type], {steps}), '_')"
        f" WHEN len({path}) > 0 THEN {capital(path + '[1]')} || '_Response' ||"
        f" array_to_string(list_transform({path}[2:], lambda x: '_' || {capital('x')}), '') END"
    )


TYPED = f"""typed AS (
  SELECT *, {_type_of('path')} AS type_name,
         CASE WHEN len(path) > 0 THEN {_type_of('path[:len(path) - 1]')} END AS owner_type,
         path[len(path)] AS owner
  FROM sel),
types AS (
  SELECT type_name, min((op_no, owner_pos)) AS seen, count(*) FILTER (NOT is_meta) AS n_uses
  FROM typed WHERE kind = 'field' AND type_name IS NOT NULL GROUP BY type_name),
parents AS (SELECT DISTINCT owner_type AS type_name, owner AS field FROM typed
            WHERE kind = 'field' AND owner_type IS NOT NULL AND owner IS NOT NULL),
fields AS (
  SELECT f.type_name, f.field, f.seen,
         CASE WHEN p.field IS NOT NULL THEN f.type_name || '_' || {capital('f.field')} ELSE 'Unknown' END AS return_type
  FROM (SELECT type_name, name AS field, min((op_no, pos)) AS seen FROM typed
        WHERE kind = 'field' AND type_name IS NOT NULL AND NOT is_meta GROUP BY type_name, name) f
  LEFT JOIN parents p ON f.type_name = p.type_name AND f.field = p.field),
roots AS (
  SELECT r.root, r.field, r.seen, coalesce(t.type_name, 'Unknown') AS return_type
  FROM (SELECT def_type AS root, name AS field, min((op_no, pos)) AS seen FROM typed
        WHERE kind = 'field' AND type_name IS NULL AND NOT is_meta GROUP BY def_type, name) r
  LEFT JOIN types t ON t.type_name = {capital('r.field')} || '_Response' AND t.n_uses > 0)"""

_QUOTED = r'"(?:[^"\\]|\\[\s\S])*"'


def _arguments(levels: int) -> str:
    """What stands in parentheses, nested so deep; strings count as one."""
    inner = r'(?:[^()"]|' + _QUOTED + ")*"
    for _ in range(levels):
        inner = r'(?:[^()"]|' + _QUOTED + r"|\(" + inner + r"\))*"
    return inner


_HEADER = r"\b(query|mutation|subscription)\b\s*([A-Za-z_]\w*)?\s*\((" + _arguments(5) + r")\)"
_HEADERS = "list_zip(" + ", ".join(every("body", _HEADER, group) for group in (1, 2, 3)) + ")"


def _declared(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '\\s*=[\\s\\S]*$', ''), '[,\\s]+$', '')"


def _base(text: str) -> str:
    return f"trim(regexp_replace({text}, '[!\\[\\]]', '', 'g'))"


def _variables(block: str) -> str:
    emptied = f"regexp_replace({block}, {q(_QUOTED)}, '\"\"', 'g')"
    return f"list_zip({every(emptied, V.VARIABLE, 1)}, {every(emptied, V.VARIABLE, 2)})"


ARGS = f"""decls AS (
  SELECT op_id, def_name, v.z[1] AS variable, arg_max({_declared('v.z[2]')}, v.no) AS declared_type
  FROM (SELECT op_id, h.z[2] AS def_name, h.z[3] AS block FROM bodies, unnest({_HEADERS}) AS h(z)),
       unnest({_variables('block')}) WITH ORDINALITY AS v(z, no)
  GROUP BY op_id, def_name, v.z[1]),
arg_uses AS (
  SELECT coalesce(a.type_name, {capital('a.def_type')}) AS type_name, a.name AS field, a.t AS argument, a.op_no, a.pos,
         CASE WHEN starts_with(a.value, '$') THEN coalesce(d.declared_type, 'Unknown')
              WHEN regexp_matches(a.value, '^-?[0-9]+$') THEN 'Int'
              WHEN regexp_matches(a.value, '^-?[0-9]+\\.[0-9]+$') THEN 'Float'
              WHEN a.value IN ('true', 'false') THEN 'Boolean'
              WHEN starts_with(a.value, '"') OR regexp_matches(a.value, '^[A-Z_][A-Z0-9_]*$') THEN 'String'
              ELSE 'Unknown' END AS argument_type
  FROM typed a LEFT JOIN decls d ON a.op_id = d.op_id AND a.def_name = d.def_name AND substr(a.value, 2) = d.variable
  WHERE a.kind = 'argument' AND NOT a.is_meta),
args AS (
  SELECT type_name, field, argument, argument_type, (op_no, pos) AS seen FROM arg_uses
  QUALIFY row_number() OVER (PARTITION BY type_name, field, argument ORDER BY op_no, pos) = 1)"""

INPUTS = f"""input_uses AS (
  SELECT {_base(_declared('v.z[2]'))} AS input_type, op_no, header_no, v.no AS var_no
  FROM (SELECT op_no, h.no AS header_no, h.z[3] AS block FROM bodies, unnest({_HEADERS}) WITH ORDINALITY AS h(z, no)),
       unnest({_variables('block')}) WITH ORDINALITY AS v(z, no)),
inputs AS (
  SELECT input_type, min((op_no, header_no, var_no)) AS seen FROM input_uses
  WHERE input_type <> '' AND input_type NOT IN {_in(V.BUILT_IN_SCALARS)}
    AND input_type NOT IN (SELECT type_name FROM types)
  GROUP BY input_type)"""

SCHEMA = ",\n".join([FINDINGS, BODIES, TOKENS, SELECTIONS, TYPED])

_ROOT_NO = "CASE root WHEN 'query' THEN 2 WHEN 'mutation' THEN 3 ELSE 4 END"
_FIELD_LINE = "'  ' || f.field || coalesce('(' || l.args || ')', '') || ': ' || f.return_type"
_PREAMBLE = ", ".join(q(line) for line in schema.PREAMBLE)
SDL = f"""arg_lists AS (
  SELECT type_name, field, string_agg(argument || ': ' || argument_type, ', ' ORDER BY seen) AS args
  FROM args GROUP BY type_name, field),
present AS (SELECT DISTINCT root FROM roots),
shown AS (SELECT type_name, row_number() OVER (ORDER BY seen) AS no FROM types WHERE n_uses > 0),
all_lines AS (
  SELECT 0 AS section, 0 AS block, 0 AS item, u.no AS step, u.line FROM unnest([{_PREAMBLE}]) WITH ORDINALITY AS u(line, no)
  UNION ALL SELECT 1, 0, 0, 0, 'schema {{' FROM (SELECT count(*) AS n FROM present) WHERE n > 0
  UNION ALL SELECT 1, 0, 1, {_ROOT_NO}, '  ' || root || ': ' || {capital('root')} FROM present
  UNION ALL SELECT 1, 0, 2, u.no, u.line FROM (SELECT count(*) AS n FROM present), unnest(['}}', '']) WITH ORDINALITY AS u(line, no) WHERE n > 0
  UNION ALL SELECT {_ROOT_NO}, 0, 0, 0, 'type ' || {capital('root')} || ' {{' FROM present
  UNION ALL
  SELECT {_ROOT_NO}, 0, 1, row_number() OVER (PARTITION BY f.root ORDER BY f.seen), {_FIELD_LINE}
  FROM roots f LEFT JOIN arg_lists l ON l.type_name = {capital('f.root')} AND l.field = f.field
  UNION ALL SELECT {_ROOT_NO}, 0, 2, u.no, u.line FROM present, unnest(['}}', '']) WITH ORDINALITY AS u(line, no)
  UNION ALL SELECT 5, no, 0, 0, 'type ' || type_name || ' {{' FROM shown
  UNION ALL
  SELECT 5, s.no, 1, row_number() OVER (PARTITION BY f.type_name ORDER BY f.seen), {_FIELD_LINE}
  FROM fields f JOIN shown s ON f.type_name = s.type_name
  LEFT JOIN arg_lists l ON l.type_name = f.type_name AND l.field = f.field
  UNION ALL SELECT 5, s.no, 2, u.no, u.line FROM shown s, unnest(['}}', '']) WITH ORDINALITY AS u(line, no)
  UNION ALL
  SELECT 6, i.no, 0, u.no, u.line
  FROM (SELECT input_type, row_number() OVER (ORDER BY seen) AS no FROM inputs) i,
       unnest([{q(schema.INPUT_COMMENT)}, 'input ' || input_type || ' {{', '  _placeholder: Unknown', '}}', ''])
       WITH ORDINALITY AS u(line, no))"""

_OWN_BLOCK = f"list_filter({_HEADERS}, lambda h: h[1] = operation_type AND h[2] IN (operation_name, ''))[1][3]"
OWN_VARIABLES = f"""own AS (
  SELECT operation_type, operation_name, body, {_OWN_BLOCK} AS block
  FROM (SELECT DISTINCT operation_type, operation_name, operation_body AS body FROM findings WHERE {_TEXT}))"""
_PLACEHOLDER = (
    f"CASE {_base(_declared('z[2]'))} "
    + " ".join(f"WHEN {q(name)} THEN {q(text)}" for name, text in V.PLACEHOLDERS.items())
    + f" ELSE {q(V.OBJECT_PLACEHOLDER)} END"
)

# --- statements -----------------------------------------------------------------


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _json(path: str) -> str:
    return f"json_extract_string(o, '$.{path}')"


JSON_LINES = f"""objects AS (
  SELECT req_body AS o, false AS in_array
  FROM api WHERE method = 'POST' AND starts_with(req_body, '{{') AND json_valid(req_body)
  UNION ALL
  SELECT t.value, true FROM (SELECT req_body FROM api WHERE method = 'POST' AND starts_with(req_body, '[') AND json_valid(req_body)) a,
         json_tree(a.req_body) t
  WHERE t.type = 'OBJECT' AND regexp_matches(t.fullkey, '^\\$(\\[[0-9]+\\])+$')),
captured AS (
  SELECT in_array, {_json('query')} AS query, {_json('doc_id')} AS doc_id, {_json('operationName')} AS name FROM objects),
line_in AS (
  SELECT 0 AS ord, 'plain' AS form, query AS text, name, NULL AS hash FROM captured
  WHERE query <> '' AND (NOT in_array OR {_is_operation('query')})
  UNION ALL
  SELECT 0, 'doc_id', 'doc_id: ' || doc_id || ' (' || coalesce(nullif(name, ''), 'anonymous') || ')', name, doc_id
  FROM captured WHERE doc_id <> '' AND (in_array OR coalesce(query, '') = ''))"""

_http = f"SELECT {_OP} FROM http_ops"
_CLEAN_COLUMNS = ", ".join(
    [
        "sha256(raw) AS text_id",
        f"{_replace('raw', _UNESCAPE_JSON)} AS unescaped",
        f"{_replace('raw', _UNESCAPE_SCRIPT)} AS unescaped_script",
        f"{collapse('raw')} AS collapsed",
        f"{flattened('raw')} AS flattened",
        f"{without_syntax('raw')} AS without_syntax",
        f"{sanitized('raw')} AS sanitized",
        f"{trimmed('raw')} AS trimmed",
        "text AS cleaned",
        f"{capital('raw')} AS capitalized",
    ]
)


def _js(*names: str) -> str:
    return _with(script_ops(list(names)), f"SELECT {_BUNDLE_OP} FROM js_ops")


_IS_SCRIPT = f"regexp_matches(content_type, {p(V.SCRIPT_CONTENT_TYPE)})"
_HAS_MARKS = _any("body", V.SCRIPT_MARKS)

ORACLE_SQL: dict[str, str] = {
    "gql_traffic_profile": _with(
        API + ", " + SCR,
        f"""SELECT upper(method) AS method, upper(method) = 'POST' AND {_any('req_body', V.BODY_MARKS)} AS body_gate,
       upper(method) = 'GET' AND {_any('url', V.URL_MARKS)} AS url_gate, count(*) AS n_captures
FROM (SELECT method, req_body, url FROM api UNION ALL SELECT 'GET', '', url FROM scr) GROUP BY 1, 2, 3""",
    ),
    "gql_http_ops": _with(HTTP_OPS, _http),
    "gql_persisted_ops": _with(HTTP_OPS, f"{_http} WHERE operation_type = 'persisted'"),
    "gql_doc_ids": _with(HTTP_OPS, f"{_http} WHERE operation_type = 'doc_id'"),
    "gql_fragments": _with(HTTP_OPS, f"{_http} WHERE operation_type = 'fragment'"),
    "gql_batched_ops": _with(
        HTTP_OPS,
        f"""{_http} WHERE capture_id IN
        (SELECT capture_id FROM api WHERE method = 'POST' AND regexp_matches(req_body, {p(V.BATCH_START)}))""",
    ),
    "gql_get_ops": _with(HTTP_OPS, f"{_http} WHERE method = 'GET'"),
    "gql_ws_ops": _with(WS_OPS, f"SELECT {_OP} FROM ws_ops"),
    "gql_js_gate": _with(
        SCR,
        f"""SELECT content_type AS resp_content_type, count(*) AS n_responses,
       count(*) FILTER ({_IS_SCRIPT}) AS n_scripts, count(*) FILTER ({_IS_SCRIPT} AND {_HAS_MARKS}) AS n_admitted
FROM scr GROUP BY 1""",
    ),
    "gql_js_bundles": _with(
        SCR,
        f"""SELECT bundle_id, min(url) AS url, min(ts) AS first_seen, count(*) AS n_served, min(length(body)) AS n_chars
FROM admitted GROUP BY bundle_id""",
    ),
    "gql_js_tagged": _js("tagged"),
    "gql_js_raw": _js("raw"),
    "gql_js_minified": _js("property", "quoted", "compact", "query_field", "body_field", "text_field"),
    "gql_js_hashes": _js("hash", "hex_id"),
    "gql_js_doc_ids": _js("node_name_first", "node_id_first", "query_id", "doc_id"),
    "gql_text_clean": _with(
        SCR + ",\nraws AS (SELECT DISTINCT body AS raw, body AS text FROM scr),\n" + cleaned("raws", "clean", "true"),
        f"SELECT {_CLEAN_COLUMNS} FROM clean",
    ),
    "gql_js_constants": _with(
        SCR + ",\n" + CONSTANTS,
        f"""SELECT bundle_id, name, value, {_is_operation(collapse('value'))} AS is_operation,
       {_is_fragment(collapse('value'))} AS is_inline_fragment FROM constants""",
    ),
    "gql_js_concat": _with(
        ",\n".join([SCR, CONSTANTS, CHAINS, classified("concat_in", "concat_ops", "bundle_id, source")]),
        """SELECT bundle_id, source, operation_type, operation_name, coalesce(persisted_hash, '') AS persisted_hash,
       operation_body FROM concat_ops""",
    ),
    "gql_findings": _with(FINDINGS, f"SELECT {_FINDING} FROM findings"),
    "gql_findings_assembled": _with(WITH_ASSEMBLED, f"SELECT {_FINDING} FROM findings"),
    "gql_findings_table": _with(
        FINDINGS,
        f"""SELECT row_number() OVER (ORDER BY first_seen, first_id, first_ord, endpoint, operation_name, operation_type, persisted_hash) AS row_no,
       strftime(first_seen, '%H:%M:%S') AS seen_at, endpoint, method, {_LABEL} AS source_label, operation_type,
       operation_name, persisted_hash, operation_body FROM findings""",
    ),
    "gql_findings_new": _with(
        STORED, f"SELECT {_FINDING} FROM arrived a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE {_SAME_KEY})"
    ),
    "gql_filter_source_type": _with(
        FINDINGS,
        f"SELECT {_FINDING} FROM findings WHERE {_LABEL} = {q(V.SOURCE_LABELS['HTTP_POST'])} AND operation_type = 'query'",
    ),
    "gql_counts_cube": _with(
        FINDINGS,
        """SELECT CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source,
       CASE WHEN grouping(operation_type) = 1 THEN 'All' ELSE operation_type END AS operation_type,
       count(*) AS visible, (SELECT count(*) FROM findings) AS total
FROM findings GROUP BY CUBE (source, operation_type)""",
    ),
    "gql_endpoints": _with(
        HTTP_OPS,
        f"""SELECT a.host, a.path, min(a.ts) AS first_seen, count(DISTINCT a.capture_id) AS n_calls,
       count(DISTINCT o.operation_name) AS n_operations
FROM api a LEFT JOIN http_ops o ON a.capture_id = o.capture_id
WHERE a.method = 'POST' AND {_any('a.req_body', V.BODY_MARKS)} GROUP BY a.host, a.path""",
    ),
    "gql_csv_roundtrip": _with(
        FINDINGS,
        "SELECT "
        + ", ".join(
            f"{_ONE_LINE.format(c)} AS {c}"
            for c in (
                "endpoint", "operation_name", "operation_type", "persisted_hash", "url", "method",
                "source", "operation_body",
            )
        )
        + " FROM findings",
    ),
    "gql_csv_import": _with(
        STORED,
        f"""SELECT endpoint, operation_name, operation_type, persisted_hash, url, method, source, operation_body
FROM arrived a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE {_SAME_KEY})""",
    ),
    "gql_csv_import_merge": _with(
        STORED,
        f"""SELECT CAST(sum(n_valid + n_short) AS BIGINT) AS n_rows, CAST(sum(n_short) AS BIGINT) AS n_malformed,
       CAST(coalesce(sum(n_valid) FILTER (known), 0) AS BIGINT) AS n_already_stored,
       CAST(coalesce(sum(n_valid - 1) FILTER (NOT known), 0) AS BIGINT) AS n_repeated,
       count(*) FILTER (NOT known) AS n_imported
FROM (SELECT EXISTS (SELECT 1 FROM stored s WHERE {_SAME_KEY}) AS known,
             CASE WHEN operation_type = 'fragment' THEN 2 ELSE 1 END AS n_valid,
             CASE WHEN operation_type = 'doc_id' THEN 1 ELSE 0 END AS n_short FROM arrived a)""",
    ),
    "gql_csv_rejected": _with(
        STORED,
        f"""SELECT text, count(*) AS n_rows
FROM (SELECT '"' || concat_ws('","', endpoint, method, {_LABEL}, operation_type, operation_name, persisted_hash) || '"' AS text
      FROM arrived WHERE operation_type = 'doc_id') GROUP BY text""",
    ),
    "gql_jsonl_rejected": _with(
        API,
        """SELECT req_body AS text, count(*) AS n_rows FROM api
WHERE method = 'POST' AND req_body <> '' AND NOT json_valid(req_body) GROUP BY req_body""",
    ),
    "gql_jsonl_ingest": _with(
        ",\n".join([API, JSON_LINES, classified("line_in", "line_ops", "form")]),
        """SELECT operation_type, operation_name, coalesce(persisted_hash, '') AS persisted_hash, operation_body,
       count(*) AS n_captures FROM line_ops GROUP BY ALL""",
    ),
    "gql_op_depth": _with(
        ",\n".join([FINDINGS, BODIES, TOKENS]),
        """SELECT op_id, count(*) AS n_tokens, cast(max(depth) AS BIGINT) AS max_depth,
       cast(arg_max(depth, pos) AS BIGINT) AS closing_depth, count(*) FILTER (role = 'field') AS n_fields,
       count(*) FILTER (role = 'argument') AS n_arguments,
       count(*) FILTER (role = 'open' AND depth = 1) AS n_definitions
FROM tok GROUP BY op_id""",
    ),
    "gql_variables": _with(
        FINDINGS + ",\n" + OWN_VARIABLES,
        f"""SELECT DISTINCT operation_type, operation_name, v.no - 1 AS position, v.z[1] AS variable,
       {_declared('v.z[2]')} AS variable_type
FROM own, unnest({_variables('block')}) WITH ORDINALITY AS v(z, no)""",
    ),
    "gql_variables_template": _with(
        FINDINGS + ",\n" + OWN_VARIABLES,
        f"""SELECT operation_type, operation_name, body AS operation_body,
       '{{' || coalesce(array_to_string(list_transform({_variables('block')}, lambda z: '"' || z[1] || '":' || {_PLACEHOLDER}), ','), '') || '}}' AS variables_template
FROM own""",
    ),
    "gql_schema_fields": _with(SCHEMA, "SELECT type_name, field, return_type FROM fields"),
    "gql_schema_root": _with(SCHEMA, "SELECT root, field, return_type FROM roots"),
    "gql_schema_args": _with(
        SCHEMA + ",\n" + ARGS, "SELECT type_name, field, argument, argument_type FROM args"
    ),
    "gql_schema_inputs": _with(SCHEMA + ",\n" + INPUTS, "SELECT input_type FROM inputs"),
    "gql_schema_sdl": _with(
        ",\n".join([SCHEMA, ARGS, INPUTS, SDL]),
        "SELECT row_number() OVER (ORDER BY section, block, item, step) AS line_no, line FROM all_lines",
    ),
    "gql_stream_ops": _with(
        ALL_OPS, f"SELECT {_OP} FROM ops"
    ),
    "gql_stream_first_seen": _with(
        FINDINGS, "SELECT endpoint, operation_name, operation_type, persisted_hash FROM findings"
    ),
    "gql_stream_merge": _with(FINDINGS, f"SELECT {_FINDING} FROM findings"),
}
