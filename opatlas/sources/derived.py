"""Captures derived from the test tables.

The test tables hold no API traffic, so every ``events``, ``pages`` and ``conversations``
row is turned into one capture by a template picked with its id.  Marks in angle brackets
are filled from the row.  The templates are plain data and are filled by SQL text that both
Spark (here) and the checking SQL (``opatlas.plans.oracle``) run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

EVENT_TEMPLATES = [
    # (method, path, request body)
    ("POST", "/graphql",
     '{"operationName":"Get<Et>","query":"query Get<Et>($id: ID!, $n: Int) { <et>(id: $id, first: $n) '
     '{ id name owner { id } } }","variables":{"id":"<u>","props":"<o>"}}'),
    ("POST", "/graphql",
     '{"operationName":"Save<Et>","query":"mutation Save<Et>($input: Save<Et>Input!) '
     '{ save<Et>(input: $input, dry: false) { ok <et> { id } } }","variables":{}}'),
    ("POST", "/graphql", '{"query":"{ viewer { id <et>s(limit: 10) { id value } } }"}'),
    ("POST", "/graphql",
     '{"operationName":"Get<Et>","extensions":{"persistedQuery":{"version":1,"sha256Hash":"<h>"}}}'),
    ("POST", "/api/graphql", '{"doc_id":"1000<u>","operationName":"<Et>Page","variables":{}}'),
    ("POST", "/api/graphql", '{"queryId":"q<u>","variables":{}}'),
    ("POST", "/api/graphql", '{"document_id":"<et>.<u>","operationName":"<Et>Doc"}'),
    ("POST", "/graphql",
     '[{"operationName":"A<Et>","query":"query { <et> { id } }"}, '
     '{"operationName":"B<Et>","query":"subscription B<Et> { on<Et> { id } }"}]'),
    ("GET", "/graphql?query=query%20Url<Et>%20%7B%20<et>%20%7B%20id%20%7D%20%7D&v=1", ""),
    ("GET",
     "/graphql?extensions=%7B%22persistedQuery%22%3A%7B%22sha256Hash%22%3A%22<h>%22%7D%7D", ""),
    ("POST", "/api/track", '{"k":"<u>","event":"<et>"}'),
    ("POST", "/graphql",
     '{"query":"query List<Et> {\\n  <et>s { ...<Et>Bits ... on User { email } alias: title }\\n}\\n'
     'fragment <Et>Bits on <Et> { id tags(kind: \\"x,y\\") }"}'),
    ("POST", "/graphql",
     '[{"operationName":"Add<Et>","query":"mutation Add<Et> { add(items: [{a: 1}, {b: 2}]) { id } }",'
     '"variables":{"list":[{"x":1},{"y":2}]}},{"query":"query Note<Et> { # old { x\\n note(of: \\"#1\\") { id } }"}]'),
    ("POST", "/api/graphql",
     '{"operationName":"Two<Et>","first":{"sha256Hash":"<h>"},"doc_id":"7<u>","next":{"sha256Hash":'
     '"00000000000000000000000000000000000000000000000000000000000000ab","doc_id":"8<u>"}}'),
    ("GET", "/graphql?query=%7B%20a<et>%20%7B%20id%20%7D%20%7D&query=query%20More<Et>%20%7B%20b%20%7D", ""),
    ("POST", "/graphql",
     '{"operationName":"Deep<Et>","query":"query Deep<Et>($f: Filter = {a: [1, {b: 2}], s: \\"(x $q: Y\\"}, '
     '$n: Int @max(of: f(g(h(\\")\\")))), $l: [Item!]! = []) { deep<Et>(filter: $f, n: $n) { a { b } } }",'
     '"variables":{"n":"<v>"}}'),
    ("POST", "/graphql",
     '[[{"operationName":"Nest<Et>","query":"query Nest<Et> { nest<Et> { s(of: \\"}]\\") } }"},[[{"doc_id":"5<u>"}]]],'
     '{"query":"query Beside<Et> { b }","list":[{"query":"query No { n }"}]}]'),
    ("POST", "/graphql", '{"query":"query Cut<Et> { cut<Et> }","variables":{"n":"<v>"'),
]

PAGE_TEMPLATES = [
    # (content type, response body)
    ("application/javascript",
     "const Q=gql`query Page<p>($slug: String!) { page(slug: $slug) { id title } }`;"),
    ("text/javascript; charset=utf-8",
     'var e="query Min<p> {\\n  item { id }\\n}";n.text="mutation Up<p>($id:ID!){up(id:$id){ok}}";'),
    ("application/javascript", 't={query:"query Obj<p>{a{b{c}}}",body:"fragment F<p> on Item{id}"};'),
    ("application/x-javascript",
     'x={kind:"Request",name:"Rel<p>Query",id:"r<p>",text:null};y={doc_id:"9<p>",name:"Doc<p>"};'
     'z={queryID:"7<p>",operationName:"Meta<p>"};'),
    ("application/javascript",
     'm={operationName:"P<p>",query:null,id:"<h>"};w={"sha256Hash":"<h>"};'),
    ("application/javascript",
     'var a=" name email ",b="... on User { handle }";var q="query Cat<p> { me { id '
     '".concat(a).concat(n.is("B")?b:"").concat(" } }");'),
    ("application/javascript",
     "function plain<p>(){return 42*<p>;}/* nothing of interest here */"),
    ("text/html", "<script>const Q=gql`query Html<p> { page { id } }`;</script>"),
    ("text/javascript", 'var o="query ",k=" { z }";var s="query Late<p> { z }".concat(k);u="query S<p>{q}";'),
    # only assembly gives this operation its selection; the condition is nested 70 deep
    ("text/javascript",
     'var w=" { made<p> { id } }";r("query Made<p>".concat(n(' + "(" * 70 + "x" + ")" * 70 + ')?w:"").concat(" "));'),
    ("application/javascript",
     'f("query Flat<p> { a ".concat(' + "(" * 1000 + '" kept "' + ")" * 1000 + ').concat(" }"));'),
]

MESSAGE_TEMPLATES = [
    '{"id":"<c>","type":"subscribe","payload":{"operationName":"OnMsg<c>","query":"subscription '
    'OnMsg<c>($room: ID!) { message(room: $room) { id text } }","variables":{"text":"<m>"}}}',
    '{"type":"start","payload":{"query":"subscription { tick { at } }","operationName":"Tick","extensions":{"note":"<m>"}}}',
    '{"type":"start","payload":{"operationName":"Pq<c>","extensions":{"persistedQuery":'
    '{"sha256Hash":"<h>"}}}}',
    '{"type":"ping","note":"<m>"}',
]

PAGE_ID_BASE = 1_000_000_000
MESSAGE_ID_BASE = 2_000_000_000
DERIVED_START = "2024-01-01 00:00:00"

# The marks the templates use; anything else in angle brackets is text.
_MARK = re.compile(r"(<(?:et|Et|u|v|o|p|c|m|h)>)")


def _in_json(text: str) -> str:
    """SQL text of a column's text as the inside of a JSON string."""
    text = f"replace(coalesce({text}, ''), chr(92), concat(chr(92), chr(92)))"
    for character, letter in (("chr(34)", "chr(34)"), ("chr(10)", "'n'"), ("chr(13)", "'r'"), ("chr(9)", "'t'")):
        text = f"replace({text}, {character}, concat(chr(92), {letter}))"
    return text


def _fill(template: str, marks: dict[str, str], literal: Callable[[str], str]) -> str:
    """SQL text of a template with its marks filled."""
    parts = [piece for piece in _MARK.split(template) if piece] or [""]
    return " || ".join(marks[p[1:-1]] if _MARK.fullmatch(p) else literal(p) for p in parts)


def _pick(
    key: str, templates: list[str], marks: dict[str, str], literal: Callable[[str], str]
) -> str:
    """SQL text of the filled template whose position is ``key``."""
    branches = [
        f"WHEN {i} THEN {_fill(template, marks, literal)}" for i, template in enumerate(templates)
    ]
    return f"CASE {key} {' '.join(branches)} END"


API_KEY = f"event_id % {len(EVENT_TEMPLATES)}"
SCRIPT_ID = "page_id"
SCRIPT_KEY = f"{SCRIPT_ID} % {len(PAGE_TEMPLATES)}"
MESSAGE_KEY = f"conv_id % {len(MESSAGE_TEMPLATES)}"


def api_columns(literal: Callable[[str], str], sha256: str, key: str = API_KEY) -> dict[str, str]:
    """SQL text of method, path and request body, in terms of the ``events`` columns."""
    marks = {
        "et": "event_type",
        "Et": "concat(upper(left(event_type, 1)), substr(event_type, 2))",
        "u": "cast(user_id as varchar(20))",
        "v": "coalesce(cast(cast(value as decimal(18,2)) as varchar(20)), '')",
        "o": _in_json("props"),
        "h": sha256.format("event_type"),
    }
    names = ["method", "path", "req_body"]
    return {
        name: _pick(key, [t[i] for t in EVENT_TEMPLATES], marks, literal)
        for i, name in enumerate(names)
    }


def script_columns(literal: Callable[[str], str], sha256: str, key: str = SCRIPT_KEY) -> dict[str, str]:
    """SQL text of content type and response body, in terms of the ``pages`` columns."""
    page = f"cast({SCRIPT_ID} as varchar(20))"
    marks = {"p": page, "h": sha256.format(page)}
    names = ["resp_content_type", "resp_body"]
    columns = {
        name: _pick(key, [t[i] for t in PAGE_TEMPLATES], marks, literal)
        for i, name in enumerate(names)
    }
    # A script is its template and the page's own text, so it grows with the tables.
    columns["resp_body"] = f"concat({columns['resp_body']}, {literal('/* ')}, html, {literal(' */')})"
    return columns


def message_columns(literal: Callable[[str], str], sha256: str, key: str = MESSAGE_KEY) -> dict[str, str]:
    """SQL text of the payload, in terms of the ``conversations`` columns."""
    conversation = "cast(conv_id as varchar(20))"
    marks = {"c": conversation, "m": _in_json("text"), "h": sha256.format(conversation)}
    return {"payload": _pick(key, MESSAGE_TEMPLATES, marks, literal)}


def _raw_literal(text: str) -> str:
    return f"r'{text}'"


_SHA256 = "sha2({}, 256)"


# The position of a row's template, worked out once.
_KEY = "template_no"


def _derived(df: DataFrame, key: str, columns: dict[str, str], plain: dict[str, str]) -> DataFrame:
    """Derived columns behind a generator, and plain ones beside it.

    Stored captures are plain columns.  Derived ones are long expressions, and the optimizer
    would copy them into every filter that reads them; it does not look through a generator.
    Filters on plain ones reach the table, so a time range derives its own rows only, and a gate
    that a constant can never pass drops the whole branch.  Plain columns may read derived ones.
    """
    fields = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    rows = df.selectExpr("*", f"explode(transform(array({key}), {_KEY} -> struct({fields}))) AS derived")
    return rows.selectExpr(*[f"derived.{name}" for name in columns], *[f"{value} AS {name}" for name, value in plain.items()])


def read_table(
    spark: SparkSession, sf_dir: str, name: str, stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """A test table, one file or a folder of files; as a stream, the folder with its files is watched.

    ``files_per_batch`` limits a micro-batch of the stream, by default to half of the files that are
    there, so that a table in many files takes no more micro-batches than one in few.
    """
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    if not stream:
        return table
    files = table.inputFiles()
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch or -(-len(files) // 2) or 1)
    if any(f"/{name}.parquet/" in file for file in files):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def api_exchanges(events: DataFrame) -> DataFrame:
    """One API exchange per event."""
    host = "concat('h', cast(user_id % 3 as varchar(20)), '.example.com')"
    return _derived(
        events,
        API_KEY,
        api_columns(_raw_literal, _SHA256, _KEY),
        {
            "capture_id": "event_id",
            "ts": "cast(ts as timestamp)",
            "host": host,
            "url": f"concat('https://', {host}, derived.path)",
            "resp_content_type": "cast(null as string)",
            "resp_body": "cast(null as string)",
        },
    )


def _start_plus(seconds: str) -> str:
    interval = f"make_dt_interval(0, 0, 0, cast({seconds} as decimal(18,6)))"
    return f"cast(timestamp_ntz'{DERIVED_START}' + {interval} as timestamp)"


def script_exchanges(pages: DataFrame) -> DataFrame:
    """One script response per page."""
    path = f"concat('/static/', cast({SCRIPT_ID} as varchar(20)), '.js')"
    return _derived(
        pages,
        SCRIPT_KEY,
        script_columns(_raw_literal, _SHA256, _KEY),
        {
            "capture_id": f"page_id + {PAGE_ID_BASE}",
            "ts": _start_plus("page_id"),
            "path": path,
            "url": f"concat('https://cdn.example.com', {path})",
            "host": "'cdn.example.com'",
            "method": "'GET'",
            "req_body": "cast(null as string)",
        },
    )


def socket_messages(conversations: DataFrame) -> DataFrame:
    """One socket message per turn."""
    return _derived(
        conversations,
        MESSAGE_KEY,
        message_columns(_raw_literal, _SHA256, _KEY),
        {
            "capture_id": f"{MESSAGE_ID_BASE}L + conv_id * 1000 + turn",
            "ts": _start_plus("conv_id * 60 + turn"),
            "direction": "CASE role WHEN 'user' THEN 'CLIENT_TO_SERVER' ELSE 'SERVER_TO_CLIENT' END",
            "url": "'https://h0.example.com/ws'",
            "path": "'/ws'",
            "is_text": "true",
        },
    )


_DERIVATIONS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "api": ("events", api_exchanges),
    "scripts": ("pages", script_exchanges),
    "sockets": ("conversations", socket_messages),
}


def captures(spark: SparkSession, sf_dir: str, kind: str, stream: bool = False) -> DataFrame:
    """Captures of one kind: ``api``, ``scripts`` or ``sockets``."""
    table, derive = _DERIVATIONS[kind]
    return derive(read_table(spark, sf_dir, table, stream))


def http_exchanges(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """All HTTP exchanges: API calls and script responses."""
    return captures(spark, sf_dir, "api", stream).unionByName(
        captures(spark, sf_dir, "scripts", stream)
    )
