"""Column functions on log lines and stack traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of framework classes, whose frames don't count. Two prefixes of a vendor's own libraries are left out.
FRAMEWORK_PREFIXES = (
    "java.", "javax.", "sun.", "com.sun.",
    "jakarta.",
    "org.springframework.", "org.mybatis.spring",
    "org.apache.",
    "com.amazonaws.",
    "feign.", "reactor.feign.",
    "com.google.", "io.netty.", "reactor.", "org.slf4j.",
    "ch.qos.logback.", "com.fasterxml.", "com.grapecity.",
)
# What an error type and a stack frame look like.
ERROR_TYPE = r"(?:Caused by:\s*)?([\w.]+(?:Exception|Error|Throwable))[:\s]"
FRAME = r"at\s+([\w.]+)\.([\w]+|<[\w]+>)\([\w.]+:\d+\)"
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]?\d*)\s+\[([^\]]+)\]\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(\S+)(?:\s+\[([^\]]*)\])?\s*[-:]\s*(.*)"


def error_type(text: Column) -> Column:
    """The first error type; null if there is none."""
    return F.nullif(F.regexp_extract(text, ERROR_TYPE, 1), F.lit(""))


def last_cause(text: Column) -> Column:
    return F.element_at(F.regexp_extract_all(text, F.lit(r"Caused by:\s*([\w.$]+)"), F.lit(1)), -1)


def own_frames(text: Column, most: int = 3, prefixes: tuple[str, ...] = FRAMEWORK_PREFIXES) -> Column:
    """class.method of the first frames whose class doesn't begin with one of the prefixes (a caller may give its own list)."""
    whole = F.regexp_extract_all(text, F.lit(FRAME), F.lit(0))
    frames = F.transform(whole, lambda f: F.regexp_replace(F.regexp_replace(f, r"^at\s+", ""), r"\([^()]*\)$", ""))
    framework = lambda f: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(f, p))
    return F.slice(F.filter(frames, lambda f: ~framework(f)), 1, most)


def fingerprint(text: Column) -> Column:
    """md5 of the error type and the first own frames. A text with neither is its own md5, so that unlike logs stay apart; empty: zeros."""
    kind = F.coalesce(F.concat(error_type(text), F.lit("|")), F.lit(""))
    frames = F.concat_ws("", F.transform(own_frames(text), lambda f: F.concat(f, F.lit("|"))))
    # a lambda's variable holds the extracts, so that they are made once a row
    named = F.get(F.transform(F.array(F.concat(kind, frames)), lambda parts: F.when(parts == "", F.md5(text)).otherwise(F.md5(parts))), F.lit(0))
    return F.when(text.isNull() | (text == ""), "0" * 32).otherwise(named)


def parsed_line(line: Column) -> Column:
    """time, thread, level, logger, trace id and message of a standard line; nulls if it isn't one."""
    field = lambda k: F.nullif(F.regexp_extract(line, LOG_LINE, k), F.lit(""))
    return F.struct(*[field(k).alias(n) for k, n in enumerate(("time", "thread", "level", "logger", "trace_id", "message"), 1)])


def first_field(raw: Column, names: list[str]) -> Column:
    """The first of the aliases that the JSON object has."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in names])
