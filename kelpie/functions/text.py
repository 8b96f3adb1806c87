"""Scalar text functions as column expressions: normalising, fingerprints, entities, tags, snippets.

Every function takes and gives columns, stays in the JVM and gives a defined result for null
(as for the empty string). Arrays come out distinct and sorted.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
CONFIG_KEY_PATTERNS = (
    r"([a-zA-Z0-9_.-]+\.(?:timeout|ttl|deadline|retry|interval|delay)[a-zA-Z0-9_.-]*)",
    r"""@Value\s*\(\s*["']?\$\{([^}]+)\}""",
    r"""@ConfigurationProperties\s*\(\s*prefix\s*=\s*["']([^"']+)""",
    r"Configuration\[([^\]]+)\]",
    r"""appsettings[^"]*"([^"]+)\"""",
    r"""GetValue[<\(][^>)]*[>)]?\s*\(\s*["']([^"']+)""",
)
ENUM_PATTERNS = (r"enum\s+(\w+)", r"(\w+Status)\.\w+", r"(\w+State)\.\w+", r"(\w+Type)\.\w+")
CONSTANT_PATTERN = r"\b([A-Z][A-Z0-9_]{2,})\b"
CONSTANT_NOISE = (
    "SELECT", "UPDATE", "INSERT", "DELETE", "FROM", "WHERE", "NULL", "TRUE", "FALSE", "AND", "OR", "NOT", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "ORDER", "GROUP",
    "HAVING", "LIMIT", "OFFSET", "CREATE", "ALTER", "DROP", "TABLE", "INDEX", "BEGIN", "END", "DECLARE", "SET", "EXEC", "PROCEDURE", "FUNCTION",
)
TAG_PATTERNS = {
    "timeout": r"timeout|ttl|deadline",
    "state-machine": r"state\s*machine|transition|enum.*status",
    "config": r"configuration|appsettings|\.config|\.yaml|\.json",
    "database": r"select|insert|update|delete|stored\s*proc|tbl\w+|sp\w+",
    "robot": r"robot|automation|playwright|selenium",
    "transaction": r"transaction|deposit|payout|transfer",
    "api": r"controller|endpoint|api|route",
    "callsite": r"\w+\.\w+\(|\w+::\w+",
    "invocation": r"invoke|call|execute|trigger",
    "error-handling": r"exception|error|catch|throw|try",
    "async": r"async|await|task|promise",
}
PATH_TAGS = (("robot", ("robot",)), ("job", ("job",)), ("service", ("service",)), ("controller", ("controller",)), ("config", ("config", "appsettings")), ("database", (".sql", "stored")))
ACCEPT_PATTERNS = {
    "config key": (r"\.timeout", r"\.ttl", r"config\[", r"@Value", r"Configuration\["),
    "default value": (r"default\s*[:=]", r"fallback", r"\?\?", r"\|\|"),
    "where read": (r"GetValue", r"Configuration\[", r"@ConfigurationProperties", r"IOptions"),
    "enum definition": (r"enum\s+\w+", r"public\s+enum"),
    "transition": (r"transition", r"ChangeState", r"UpdateStatus", r"SetStatus"),
    "entry point": (r"public\s+(async\s+)?Task", r"\[Http", r"@\w+Mapping", r"Main\("),
    "call edge": (r"\w+\.\w+\(", r"await\s+\w+", r"\.Invoke\(", r"\.Execute\("),
}
CAUSAL_VERBS = ("update", "change", "transition", "set", "modify", "trigger", "call", "invoke", "execute", "retry", "timeout", "handle", "process", "create", "delete", "insert", "save")

LINE_NUMBER = r"^\s*\d+[\s:|\-]+\s*"
DATE_TIME, DATE = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?", r"\d{4}-\d{2}-\d{2}"
#: The characters that end a line, as Python's splitlines sees them; a carriage return takes a line feed with it.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
UNICODE = "(?U)"  # Java's classes as wide as Python's


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_content(c: Column | str) -> Column:
    """Without line numbers, dates and runs of white space; of long texts both ends."""
    lines = F.split(strip(text_or_empty(c)), LINE_END, -1)
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, UNICODE + LINE_NUMBER, "")), " ")
    s = F.regexp_replace(joined, r"(?U)\s+", " ")
    s = F.regexp_replace(F.regexp_replace(s, UNICODE + DATE_TIME, ""), UNICODE + DATE, "")
    return strip(F.when(F.length(s) > 200, F.concat(F.substring(s, 1, 100), F.right(s, F.lit(100)))).otherwise(s))


def fingerprint(text: Column | str, chunk_id: Column | str = "", path: Column | str = "") -> Column:
    """16 hexadecimal digits of the normalised text; of an empty one, of the raw text's head or of id and path."""
    part = lambda c: F.lit(c) if c == "" else text_or_empty(c)
    norm = F.nullif(normalize_content(text), F.lit(""))
    raw = F.nullif(F.substring(strip(text_or_empty(text)), 1, 200), F.lit(""))
    own = F.concat(part(chunk_id) if isinstance(chunk_id, str) else text_or_empty(chunk_id), F.lit(":"), part(path) if isinstance(path, str) else text_or_empty(path))
    return F.substring(F.md5(F.coalesce(norm, raw, own)), 1, 16)


def _found(c: Column, patterns: tuple[str, ...], flags: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(flags + p), F.lit(1)) for p in patterns)))))


def config_keys(c: Column | str) -> Column:
    return _found(text_or_empty(c), CONFIG_KEY_PATTERNS, "(?iU)")


def enums(c: Column | str) -> Column:
    return _found(text_or_empty(c), ENUM_PATTERNS, UNICODE)


def constants(c: Column | str) -> Column:
    return F.array_except(_found(text_or_empty(c), (CONSTANT_PATTERN,), UNICODE), F.array(*map(F.lit, CONSTANT_NOISE)))


def named_entities(c: Column | str) -> Column:
    return F.struct(config_keys(c).alias("config_keys"), enums(c).alias("enums"), constants(c).alias("constants"))


def occurs(t: Column, pattern: str) -> Column:
    """Whether one of a pattern's alternatives occurs in a lower-cased text.

    Plain words are looked for as strings; an expression runs only where the plain words that it
    begins and ends with occur. A run at either end of an expression may as well be one character.
    """
    found = []
    for part in pattern.split("|"):
        if re.fullmatch(r"(?:[a-z]|\\\.)+", part):
            found.append(t.contains(part.replace("\\", "")))
            continue
        plain = {m for m in (re.match(r"[a-z]*", part)[0], re.search(r"[a-z]*$", re.sub(r"\\.", " ", part))[0]) if m}
        short = re.sub(r"\\w\+$", r"\\w", re.sub(r"^\\w\+", r"\\w", part))
        found.append(reduce(lambda a, b: a & b, [*(t.contains(m) for m in sorted(plain)), t.rlike(UNICODE + short)]))
    return reduce(lambda a, b: a | b, found)


def tags(text: Column | str, path: Column | str) -> Column:
    """Tags of a text and its path, in order. The lowered text is a lambda's variable, and so worked out once for all patterns."""
    p = F.lower(text_or_empty(path))

    def of_text(t: Column) -> Column:
        return F.array(*(F.when(occurs(t, x), F.lit(k)) for k, x in TAG_PATTERNS.items()))

    low = F.translate(F.lower(text_or_empty(text)), "ſı", "si")  # in any case these are s and i, though lower-casing leaves them
    of_path = F.array(*(F.when(reduce(lambda a, b: a | b, [p.contains(x) for x in xs]), F.lit(k)) for k, xs in PATH_TAGS))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(F.array(low), of_text)), of_path))))


def source_kind(path: Column | str) -> Column:
    p = F.lower(text_or_empty(path))
    ends = lambda *xs: reduce(lambda a, b: a | b, [p.endswith(x) for x in xs])
    has = lambda *xs: reduce(lambda a, b: a | b, [p.contains(x) for x in xs])
    return (
        F.when(ends(".sql"), "sql")
        .when(ends(".md", ".txt", ".rst"), "doc")
        .when(ends(".yaml", ".yml", ".json", ".xml", ".config") | has("appsettings", "config"), "config")
        .when(has("jira", "issue"), "jira")
        .when(has("knowledge", "docs/"), "doc")
        .otherwise("code")
    )


def snippet(c: Column | str, n: int = 200) -> Column:
    s = F.regexp_replace(strip(text_or_empty(c)), r"(?U)\s+", " ")
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def has_causal_verb(c: Column | str) -> Column:
    t = F.lower(text_or_empty(c))
    return F.exists(F.array(*map(F.lit, CAUSAL_VERBS)), lambda v: F.contains(t, v))


def accept_patterns(item: str) -> list[str]:
    return list(ACCEPT_PATTERNS.get(item, (re.escape(item),)))


def covers(c: Column | str, item: str) -> Column:
    """Whether a text meets an accept item: any of its patterns, or the item itself, in any case."""
    return reduce(lambda a, b: a | b, [text_or_empty(c).rlike("(?iU)" + p) for p in accept_patterns(item)])


def content_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(text_or_empty(c), 256), 1, 16)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text_or_empty(c)) / 4).cast("long")


def keyword_variants(keyword: str) -> dict[str, str]:
    """Spellings of a keyword, on the driver."""
    words = re.split(r"[\s_-]+", keyword.strip("_- \t\n")) if keyword.strip("_- \t\n") else []
    return {
        "original": keyword,
        "lower": keyword.lower(),
        "upper": keyword.upper(),
        "camel": keyword[:1].lower() + keyword[1:],
        "pascal": "".join(w.capitalize() for w in words) or keyword,
        "snake": "_".join(words).lower() or keyword.lower(),
    }
