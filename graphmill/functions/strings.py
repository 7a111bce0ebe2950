"""Column functions on names, urls, routes and query strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names that proxies add, as regular expressions.
PROXY_SUFFIXES = (
    r"\$\$EnhancerBySpringCGLIB\$\$.*",
    r"\$\$FastClassBySpringCGLIB\$\$.*",
    r"\$ByteBuddy\$.*",
    r"\$HibernateProxy\$.*",
    r"\$Proxy\d+",
)

# The keywords that mark a code snippet.
CODE_KEYWORDS = (
    "return", "if", "else", "for", "while", "switch", "case",
    "try", "catch", "finally", "throw", "throws", "new", "null",
    "true", "false", "void", "int", "long", "double", "float",
    "boolean", "String", "List", "Map", "Set", "import", "class",
    "interface", "extends", "implements", "public", "private",
    "protected", "static", "final", "abstract", "synchronized",
)


def normalize_url(url: Column) -> Column:
    """Lower case, one trailing slash off, `<x>`, `:x` and `{x}` to `{}` in that order; null: empty."""
    u = F.trim(F.lower(F.coalesce(url, F.lit(""))))
    u = F.when(u.endswith("/") & (F.length(u) > 1), F.left(u, F.length(u) - 1)).otherwise(u)
    for pattern in (r"<[^>]+>", r":[^/]+", r"\{[^}]+\}"):
        u = F.regexp_replace(u, pattern, "{}")
    return u


def normalize_entry_key(key: Column) -> Column:
    """`get /Users/{id}` to `GET /users/{}`; without a method only the path."""
    key = F.coalesce(key, F.lit(""))
    at = F.instr(key, " ")
    return F.when(at == 0, normalize_url(key)).otherwise(F.concat_ws(" ", F.upper(F.substring_index(key, " ", 1)), normalize_url(F.substr(key, at + 1))))


def normalize_frontend_url(url: Column) -> Column:
    """`/api` prefix off, `${x}` to `:param`, a leading slash; null: empty."""
    u = F.trim(url)
    u = F.when(u.startswith("/api/"), F.substr(u, F.lit(5))).when(u == "/api", "").otherwise(u)
    u = F.regexp_replace(u, r"\$\{[^}]+\}", ":param")
    return F.when(url.isNull(), "").when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u))


def normalize_route(route: Column) -> Column:
    """Query off, numeric path segments to `{id}`; null: empty."""
    return F.regexp_replace(F.substring_index(F.coalesce(route, F.lit("")), "?", 1), r"/\d+", "/{id}")


def strip_proxy(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), "|".join(PROXY_SUFFIXES), "")


def topic_tail(topic: Column) -> Column:
    return F.element_at(F.split(topic, ":"), -1)


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def package_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.?[^.]*$", "")


def java_hash(text: Column) -> Column:
    """31-based hash of a text's code units in 32-bit arithmetic, as int; null: null. Characters beyond the basic plane count by their code point."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda x: F.when(x.bitwiseAND(0xFFFFFFFF) > 0x7FFFFFFF, x.bitwiseAND(0xFFFFFFFF) - 0x100000000).otherwise(x.bitwiseAND(0xFFFFFFFF))
    return F.when(text == "", 0).otherwise(F.aggregate(points, F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + c))).cast("int")


def own_or_inner(name: Column, cls: str) -> Column:
    """The class itself or one of its inner classes."""
    return (name == cls) | name.startswith(f"{cls}$")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(text, F.lit(w)), F.lit(False)) for w in words], F.lit(False))


def mutual_prefix(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


def mutual_substring(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def query_type_scores(query: Column) -> dict[str, Column]:
    """Scores of the query kinds in their order of precedence; the patterns and points are fixed values."""
    q = F.trim(query)
    full = lambda p: q.rlike(f"^(?:{p})$")
    first = lambda *pairs: reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(pairs), F.lit(0))
    part, low = "[a-z][a-z0-9]*", "[a-z][a-zA-Z0-9]*"
    upper = "[A-Z][a-zA-Z0-9]*"
    has = lambda s: F.contains(q, F.lit(s))
    points = lambda test, n: F.when(test, n).otherwise(0)
    code = (
        points(has("(") | has(")"), 3) + points(has("{") | has("}"), 2) + points(has(";"), 2)
        + points(F.arrays_overlap(F.split(q, r"[\s(){};.,<>=+\-*/&|!\[\]]+"), F.array(*[F.lit(k) for k in CODE_KEYWORDS])), 3)
        + points(has("->"), 2) + points(has("=") & ~has("=="), 1) + points(has("."), 1)
    )
    return {
        "NATURAL_LANGUAGE": points(q.rlike(r"[一-鿿]"), 8) + points(F.size(F.split(q, r"\s+")) >= 3, 8),
        "METHOD_NAME": first((full(rf"{upper}\.{low}"), 12), (full(low), 10), (full(r"(?i)(?:select|insert|update|delete|get|find|save|query|count|exists)[A-Z].*"), 10)),
        "FULL_QUALIFIED_NAME": first((full(rf"{part}(\.{part}){{2,}}\.{upper}\.{low}"), 20), (full(rf"{part}(\.{part})+\.{upper}\.{low}"), 12), (full(r"[a-z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*){2,}"), 18)),
        "FULL_QUALIFIED_CLASS_NAME": first((full(rf"{part}(\.{part}){{2,}}\.{upper}"), 22), (full(rf"{part}(\.{part})+\.{upper}"), 13)),
        "CLASS_NAME": points(full(upper), 12) - points(full(upper) & q.rlike("(Exception|Error|Fault|Failure)$"), 5),
        "SQL_SNIPPET": points(full(r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|WITH|MERGE)\s+.*"), 15),
        "HTTP_URI": first((full(r"(?i)(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/.*"), 20), (full(r"/\S+"), 10)),
        "CODE_SNIPPET": F.when(code >= 4, code).otherwise(0),
        "ANNOTATION": points(full(r"@[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*(\(.*\))?"), 20),
        "EXCEPTION_TYPE": points(full(rf"{upper}(Exception|Error|Fault|Failure)"), 15),
    }


def query_type(query: Column) -> Column:
    """The kind with the best score, the earlier one if equal; below 4, null or blank: natural language."""
    scores = query_type_scores(query)
    best = lambda s: F.when(F.array_max(s) < 4, "NATURAL_LANGUAGE").otherwise(F.element_at(F.array(*map(F.lit, scores)), F.array_position(s, F.array_max(s)).cast("int")))
    kind = F.get(F.transform(F.array(F.array(*scores.values())), best), F.lit(0))  # a lambda's variable: the scores are computed once
    return F.when(query.isNull() | (F.trim(query) == ""), "NATURAL_LANGUAGE").otherwise(kind)
