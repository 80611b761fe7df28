"""Content types of texts, as one expression over the first lines of each.

The checks run in a fixed order and the first that is sure enough decides:
blank, JSON array, diff, HTML, search results, build log, source code, text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines, prefix, trim

#: The patterns of each type, as regular expressions.
SEARCH = r"^[^\s:]+:\d+:"
DIFF_HEADER = r"^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@|@@@+\s+-\d+(?:,\d+)?\s+(?:-\d+(?:,\d+)?\s+)+\+\d+(?:,\d+)?\s+@@@+)"
DIFF_CHANGE = r"^[+-][^+-]"
HTML_DOCTYPE = r"(?i)^\s*<!doctype\s+html"
HTML_HTML = r"(?i)<html[\s>]"
HTML_HEAD = r"(?i)<head[\s>]"
HTML_BODY = r"(?i)<body[\s>]"
HTML_PART = r"(?i)<(div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[\s>]"
LOG = [
    r"(?i)\b(ERROR|FAIL|FAILED|FATAL|CRITICAL)\b",
    r"(?i)\b(WARN|WARNING)\b",
    r"(?i)\b(INFO|DEBUG|TRACE)\b",
    r"^\s*\d{4}-\d{2}-\d{2}",
    r"^\s*\[\d{2}:\d{2}:\d{2}\]",
    r"^={3,}|^-{3,}",
    r"^\s*PASSED|^\s*FAILED|^\s*SKIPPED",
    r"^npm ERR!|^yarn error|^cargo error",
    r"Traceback \(most recent call last\)",
    r"^\s*at\s+[\w.$]+\(",
]
CODE = {
    "python": [r"^\s*(def|class|import|from|async def)\s+\w+", r"^\s*@\w+", r'^\s*"""', r"^\s*if __name__\s*=="],
    "javascript": [r"^\s*(function|const|let|var|class|import|export)\s+", r"^\s*(async\s+function|=>\s*\{)", r"^\s*module\.exports"],
    "typescript": [r"^\s*(interface|type|enum|namespace)\s+\w+", r"^:\s*(string|number|boolean|any|void)\b"],
    "go": [r"^\s*(func|type|package|import)\s+", r"^\s*func\s+\([^)]+\)\s+\w+"],
    "rust": [r"^\s*(fn|struct|enum|impl|mod|use|pub)\s+", r"^\s*#\["],
    "java": [r"^\s*(public|private|protected)\s+(class|interface|enum)", r"^\s*@\w+", r"^\s*package\s+[\w.]+;"],
}
#: Lines or bytes looked at, and the least confidence of each type.
DIFF_LINES, HTML_BYTES, SEARCH_LINES, LOG_LINES, CODE_LINES = 500, 3000, 100, 200, 100
LEAST = {"diff": 0.7, "html": 0.7, "search": 0.6, "build": 0.5, "source_code": 0.5}
#: Compressor of each type.
ROUTES = {"json_array": "smart_crusher", "build": "log_stripper", "source_code": "ast_code", "diff": "ast_code", "search": "semantic", "html": "semantic", "text": "semantic"}


def _one(value: Column) -> Column:
    return F.least(F.lit(1.0), value)


def _counted(rows: Column, pattern: str) -> Column:
    return F.size(F.filter(rows, lambda x: x.rlike(pattern)))


def _filled(rows: Column) -> Column:
    return F.size(F.filter(rows, lambda x: F.length(trim(x)) > 0))


def json_confidence(text: Column) -> Column:
    own = trim(text)

    def of(items: Column) -> Column:
        objects = (F.size(items) > 0) & F.forall(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
        return F.when(items.isNull(), 0.0).when(objects, 1.0).otherwise(0.8)

    return F.when(own.startswith("["), let(F.try_variant_get(F.try_parse_json(own), "$", "array<variant>"), of)).otherwise(0.0)


def json_array(text: Column) -> Column:
    """Struct of item_count and is_dict_array of a JSON array; null for other texts."""

    def of(items: Column) -> Column:
        objects = (F.size(items) > 0) & F.forall(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
        return F.when(items.isNotNull(), F.struct(F.size(items).alias("item_count"), objects.alias("is_dict_array")))

    return F.when(trim(text).startswith("["), let(F.try_variant_get(F.try_parse_json(trim(text)), "$", "array<variant>"), of))


def diff_confidence(text: Column) -> Column:
    def of(rows: Column) -> Column:
        some = lambda h: F.when(h == 0, 0.0).otherwise(_one(0.5 + 0.2 * h + 0.05 * _counted(rows, DIFF_CHANGE)))
        return let(_counted(rows, DIFF_HEADER), some)

    return let(lines(text, DIFF_LINES), of)


def html_confidence(text: Column) -> Column:
    has = lambda p, w: F.when(p, w).otherwise(0.0)

    def of(x: Column) -> Column:
        total = has(x["doctype"], 0.5) + has(x["html"], 0.3) + has(x["head"], 0.1) + has(x["body"], 0.1) + F.least(0.03 * x["parts"], F.lit(0.3))
        return F.when(~(x["doctype"] | x["html"] | (x["parts"] >= 3)) | (total < 0.5), 0.0).otherwise(_one(total))

    def found(head: Column) -> Column:
        return let(F.struct(head.rlike(HTML_DOCTYPE).alias("doctype"), head.rlike(HTML_HTML).alias("html"), head.rlike(HTML_HEAD).alias("head"), head.rlike(HTML_BODY).alias("body"), F.regexp_count(head, F.lit(HTML_PART)).alias("parts")), of)

    return let(prefix(text, HTML_BYTES), found)


def search_confidence(text: Column) -> Column:
    share = let(lines(text, SEARCH_LINES), lambda rows: _counted(rows, SEARCH) / F.greatest(_filled(rows), F.lit(1)))
    return let(share, lambda s: F.when(s < 0.3, 0.0).otherwise(_one(0.4 + 0.6 * s)))


def log_confidence(text: Column) -> Column:
    alone = F.filter(lines(text, LOG_LINES), lambda x: F.length(trim(x)) > 0)

    def of(rows: Column) -> Column:
        errors = _counted(rows, "|".join(f"(?:{p})" for p in LOG[:2]))
        share = _counted(rows, "|".join(f"(?:{p})" for p in LOG)) / F.greatest(F.size(rows), F.lit(1))
        return let(share, lambda s: F.when(s < 0.1, 0.0).otherwise(_one(0.3 + 0.5 * s + 0.05 * errors)))

    return let(alone, of)


def _first(rows: Column, pattern: str) -> Column:
    """Place of the first line that matches, 0 if none does."""
    return F.array_position(F.transform(rows, lambda x: x.rlike(pattern)), True)


def code_best(text: Column) -> Column:
    """Struct of score, language and confidence of the language that most lines show.

    Of equal scores the language seen first wins, then the first in the list.
    """

    def of(rows: Column) -> Column:
        each = []
        for k, (language, patterns) in enumerate(CODE.items()):
            hit = "|".join(f"(?:{p})" for p in patterns)
            each.append(F.struct(_counted(rows, hit).alias("score"), (-_first(rows, hit)).alias("first"), F.lit(-k).alias("place"), F.lit(language).alias("language")))
        sure = lambda b: F.when(b["score"] < 3, 0.0).otherwise(_one(0.4 + 0.4 * b["score"] / F.greatest(_filled(rows), F.lit(1)) + 0.02 * b["score"]))
        return let(F.array_max(F.array(*each)), lambda b: F.struct(b["score"].alias("score"), b["language"].alias("language"), sure(b).alias("confidence")))

    return let(lines(text, CODE_LINES), of)


def detect(text: Column) -> Column:
    """Struct of content_type, confidence and language.

    Each check runs only where those before it weren't sure, and once.
    """
    result = lambda kind, confidence, language=None: F.struct(F.lit(kind).alias("content_type"), F.round(confidence.cast("double"), 9).alias("confidence"), (F.lit(None) if language is None else language).cast("string").alias("language"))
    sure = lambda kind, confidence, rest: let(confidence, lambda c: F.when(c >= LEAST[kind], result(kind, c)).otherwise(rest))
    out = let(code_best(text), lambda b: F.when(b["confidence"] >= LEAST["source_code"], result("source_code", b["confidence"], b["language"])).otherwise(result("text", F.lit(0.5))))
    for kind, check in (("build", log_confidence), ("search", search_confidence), ("html", html_confidence), ("diff", diff_confidence)):
        out = sure(kind, check(text), out)
    rest = let(json_confidence(text), lambda j: F.when(j > 0, result("json_array", j)).otherwise(out))
    return F.when(F.length(trim(F.coalesce(text, F.lit("")))) == 0, result("text", F.lit(0.0))).otherwise(rest)


def route(content_type: Column, enabled: tuple[str, ...] = ("smart_crusher", "log_stripper", "ast_code", "semantic")) -> Column:
    """Compressor of a content type; passthrough where it isn't enabled."""
    out = None
    for kind, name in ROUTES.items():
        name = name if name in enabled else "passthrough"
        out = F.when(content_type == kind, name) if out is None else out.when(content_type == kind, name)
    return out.otherwise("passthrough")
