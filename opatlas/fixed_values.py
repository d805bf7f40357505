"""Fixed values.

Everything in this module has to have exactly this value for the results to be
right: word lists, labels, file layouts, text formats and the text
patterns that define what counts as an operation.  No logic lives here.

Patterns are written for Spark (``java.util.regex``).  Repeated groups over free
text are possessive, so that a megabyte-long string can neither backtrack nor
grow the call stack.
"""

# --- operation types and sources ---------------------------------------------

SOURCE_LABELS = {
    "HTTP_POST": "HTTP POST Body",
    "JS_FILE": "JS/Static File",
    "WEBSOCKET": "WebSocket Message",
    "PERSISTED_QUERY": "Persisted Query Hash",
    "MINIFIED_JS": "Minified/Obfuscated JS",
    "JS_EXECUTED": "JS Executed (Node.js)",
}
DEFAULT_SOURCE = "HTTP_POST"
ANONYMOUS = "anonymous"

# --- admission gates ----------------------------------------------------------

BODY_MARKS = [
    '"query"', '"mutation"', '"operationName"', '"sha256Hash"',
    '"persistedQuery"', '"doc_id"', '"queryId"', '"document_id"',
]
URL_MARKS = ["query=", "extensions="]
SOCKET_MARKS = ['"query"', '"sha256Hash"']
SOCKET_DIRECTION = "CLIENT_TO_SERVER"
SCRIPT_MARKS = [
    "query", "mutation", "subscription", "gql", "graphql", "sha256Hash",
    "doc_id", "queryID", "queryId", '"Request"',
]
SCRIPT_CONTENT_TYPE = (
    r"(?i)(application/javascript|text/javascript|application/x-javascript|text/ecmascript)"
)
HASH_CONTEXT_CHARS = 100
ID_CONTEXT_CHARS = 200
HASH_CONTEXT_MARKS = ["query", "mutation", "operationName", "persistedQuery"]

# --- request bodies, URLs and socket messages ---------------------------------

JSON_QUERY = r'"query"\s*:\s*"((?:[^"\\]++|\\[\s\S])++)"'
JSON_OPERATION_NAME = r'"operationName"\s*:\s*"([^"]+)"'
JSON_SHA256_HASH = r'"sha256Hash"\s*:\s*"([0-9a-fA-F]{64})"'
JSON_HASH = r'"hash"\s*:\s*"([0-9a-fA-F]{64})"'
JSON_DOC_ID = r'"doc_id"\s*:\s*"([^"]+)"'
JSON_QUERY_ID = r'"queryId"\s*:\s*"([^"]+)"'
JSON_DOCUMENT_ID = r'"document_id"\s*:\s*"([^"]+)"'
BATCH_START = r"^\s*\["
# A part of a broken batch: up to a closing brace that a comma and an opening brace follow;
# strings are taken whole.
BATCH_PART = r'(?:[^"}]++|"(?:[^"\\]++|\\[\s\S])*+"|"|\}(?!\s*,\s*\{))++\}?'
URL_QUERY = r"[?&]query=([^&]+)"
URL_EXTENSIONS = r"[?&]extensions=([^&]*)"
DECODED_HASH = r"""sha256Hash["':]+([0-9a-fA-F]{64})"""

# --- classification of operation text -----------------------------------------

NAMED_OPERATION = (
    r"\b(query|mutation|subscription)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:@[^({]*)?[({]"
)
OPERATION_WORD_END = r"[ ({@]"
ANONYMOUS_OPERATION = r"\b(query|mutation|subscription)\s*[({]"
FRAGMENT_DEFINITION = r"\bfragment\s+([A-Za-z_][A-Za-z0-9_]*)\s+on\s+"
INLINE_FRAGMENT = r"\.\.\.\s+on\s+([A-Za-z_]\w*)"
SELECTION_LIKE = r"\w\s*\{"
TYPENAME_MARK = "__typename"
# Block strings, strings and comments; only the comments are outside of the group.
STRING_OR_COMMENT = (
    r'("""(?:[^"]++|"(?!""))*+"""|"(?:[^"\\\n]++|\\[^\n])*+")|#[^\n\r]*+'
)

# --- script text --------------------------------------------------------------

STRING_RUN = r'(?:[^"\\]++|\\[\s\S])++'
STRING_RUN_OR_EMPTY = r'(?:[^"\\]++|\\[\s\S])*+'
TAGGED_TEMPLATE = r"(?:gql|graphql)\s*`([^`]++)`"
# Every head begins with one of these; as a look ahead it takes nothing.
OPERATION_INITIAL = "(?=[qms])"
OPERATION_HEAD = (
    r"\b(?:query|mutation|subscription)\s+[A-Za-z_]\w*+\s*+(?:\([^)]*+\))?+\s*+"
)
COMPACT_HEAD = r"\b(?:query|mutation|subscription)\s+[A-Za-z_]\w*+\s*+"
COMPACT_BLOCK = r"\{[^}]*+\}"
COMPACT_TYPE_AND_NAME = r"^(\w+)\s+(\w+)"
PROPERTY_STRING = (
    r'[a-zA-Z0-9_$.]\s*+=\s*+"((?:query|mutation|subscription|fragment|\.\.\.)' + STRING_RUN + ')"'
)
QUOTED_OPERATION = (
    r'"((?:query|mutation|subscription|fragment)\s+[A-Za-z_]\w*' + STRING_RUN + ')"'
)
QUERY_FIELD = (
    r'\bquery\s*:\s*"((?:query|mutation|subscription|fragment)' + STRING_RUN + ')"'
)
BODY_FIELD = (
    r'body\s*:\s*"((?:query|mutation|subscription|fragment)' + STRING_RUN + ')"'
)
TEXT_FIELD = (
    r'(?:text|queryText|operationText)\s*[=:]\s*"((?:query|mutation|subscription|fragment)'
    + STRING_RUN + ')"'
)
HEX_ID = r'id\s*:\s*"([0-9a-fA-F]{64})"'
_REQUEST_KIND = r'(?:kind\s*:\s*"Request"|"kind"\s*:\s*"Request")'
_NODE_NAME = r'(?:name|"name")\s*:\s*"([A-Za-z_]\w*)"'
_NODE_ID = r'(?:id|"id")\s*:\s*"([^"]+)"'
REQUEST_NODE_NAME_FIRST = _REQUEST_KIND + r"[^}]*?" + _NODE_NAME + r"[^}]*?" + _NODE_ID
REQUEST_NODE_ID_FIRST = _REQUEST_KIND + r"[^}]*?" + _NODE_ID + r"[^}]*?" + _NODE_NAME
SCRIPT_QUERY_ID = r'(?:queryID|queryId)\s*[=:]\s*"([^"]+)"'
SCRIPT_DOC_ID = r'doc_id\s*[=:]\s*"([^"]+)"'
NEARBY_NAME = r'(?:name|operationName)\s*[=:]\s*"([A-Za-z_]\w*)"'

# --- cleaning of text taken from scripts --------------------------------------

JOINED_BOTH_SIDES = r'"\s*\+\s*[a-zA-Z_$][a-zA-Z0-9_$.]*(?:\([^)]*\))?\s*\+\s*"'
JOINED_RIGHT = r'"\s*\+\s*[a-zA-Z_$][a-zA-Z0-9_$.]*(?:\([^)]*\))?\s*'
JOINED_LEFT = r'(?<!\s)\s*+\+\s*+"'
TEMPLATE_HOLE = r"\$\{[^}]*\}"
# The look-behind keeps the search from starting again inside of one long name.
CONDITIONAL = (
    r"(?<![a-zA-Z_$][0-9.]{0,8})[a-zA-Z_$][a-zA-Z0-9_$.]*+(?:\([^)]*\))?\s*\?\s*[a-zA-Z_$][a-zA-Z0-9_$]*"
    r'\s*:\s*(?:"[^"]*"|[a-zA-Z_$][a-zA-Z0-9_$]*)'
)
KEPT_TOKEN = (
    r'\s+|"(?:[^"\\]++|\\[\s\S])*+"|#[^\n]*|[A-Za-z0-9_]+|\.\.\.|[{}()\[\]:,!$@=|]|[-.](?=[0-9])'
)
SCRIPT_ONLY_WORDS = [
    "var", "let", "const", "function", "return",
    "for", "while", "do", "switch", "case", "break", "continue",
    "try", "catch", "finally", "throw", "typeof", "instanceof",
    "void", "yield", "await", "async", "super", "this",
    "import", "export", "from", "with",
    "require", "module", "exports", "define", "webpack", "webpackJsonp",
    "prototype", "constructor", "__esModule", "__webpack_require__",
    "createElement", "appendChild", "addEventListener", "removeEventListener",
    "setTimeout", "setInterval", "encodeURIComponent", "decodeURIComponent",
    "hasOwnProperty", "isPrototypeOf", "console", "window", "document",
    "localStorage", "sessionStorage", "XMLHttpRequest",
]

# --- string constants and concat chains in scripts ----------------------------

DECLARED_CONSTANT = (
    r'(?:var|let|const|,)\s*([a-zA-Z_$][a-zA-Z0-9_$]*+)\s*=\s*"(' + STRING_RUN_OR_EMPTY + ')"'
)
PROPERTY_CONSTANT = (
    r'[a-zA-Z0-9_$.]\.([a-zA-Z_$][a-zA-Z0-9_$]*+)\s*+=\s*+"(' + STRING_RUN_OR_EMPTY + ')"'
)
IS_OPERATION = (
    r"^(?:(?i:query|mutation|subscription|fragment)\s|\{\s*(?:query|mutation|subscription)\s)"
)
IS_INLINE_FRAGMENT = r"^\.\.\.\s+on\s+\w"
ASSEMBLED_NAME = r"^(?:query|mutation|subscription)\s+(\w+)"
WHOLE_STRING = '^"(' + STRING_RUN_OR_EMPTY + ')"$'
IDENTIFIER = r"^[a-zA-Z_$][a-zA-Z0-9_$]*$"

# --- operation structure ------------------------------------------------------

TOKEN = (
    r'"(?:[^"\\]++|\\[\s\S])*+"|\.\.\.|[$]?[A-Za-z_][A-Za-z0-9_]*'
    r"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[{}()\[\]:,!@=|]"
)
DEFINITION_WORDS = ["query", "mutation", "subscription", "fragment"]
# The text in front of the parenthesis that opens a list of variables.
VARIABLE_HEADER = r"\b(query|mutation|subscription)\b\s*([A-Za-z_]\w*)?\s*$"
VARIABLE = r"\$([A-Za-z_]\w*)\s*:\s*([^$,)]+)"
BUILT_IN_SCALARS = ["Int", "Float", "String", "Boolean", "ID"]
UNKNOWN = "Unknown"
PLACEHOLDERS = {"Int": "0", "Float": "0.0", "Boolean": "false", "String": '""', "ID": '""'}
OBJECT_PLACEHOLDER = "{}"
ROOT_TYPES = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}

# --- files --------------------------------------------------------------------

CSV_COLUMNS = [
    "Endpoint", "Method", "Source", "OperationType", "OperationName",
    "PersistedHash", "URL", "OperationSelectionBody",
]
CSV_REQUIRED_COLUMNS = ["OperationType", "OperationName"]
DISPLAY_TIME = "HH:mm:ss"
