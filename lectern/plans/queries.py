"""The operators applied to the driver's tables, with SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as detect_
from ..functions import focus, keys, tokens
from ..functions.text import lines
from ..operators import agent, bands, cache, kernels, logs, paragraphs, recall, rich, series, summary, tags
from ..operators.conversation import CompactConfig, compact
from ..sources import store
from ..streaming import session
from . import pipeline
from .views import AGENT_MESSAGES, CONVERSATIONS, EVENT_ITEMS, EVENT_VALUES, LOG_LINES, PARAGRAPHS, PARAGRAPHS_SQL, PAYLOADS, TABLE_PAYLOADS, cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUESTION = "where is the request that failed in the job"


def _query(sql: str | None = None, needs: tuple[tuple[str, str], ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ",\n".join(cte(n, v) for n, v in needs) + "\n" if needs else "") + sql
        return f

    return add


A, L, V, I, P, C, Y = ("am", AGENT_MESSAGES), ("ll", LOG_LINES), ("ev", EVENT_VALUES), ("ei", EVENT_ITEMS), ("pa", PARAGRAPHS_SQL), ("cv", CONVERSATIONS), ("pl", PAYLOADS)
_TOK = "greatest(1, CAST(ceil(octet_length(encode(content)) / 4.0) AS BIGINT))"
_ERR = "(" + " OR ".join(f"contains(content, '{p}')" for p in agent.ERROR_PATTERNS) + ")"
_TYPE = f"CASE WHEN role = 'system' THEN 'system' WHEN role IN ('tool', 'function') THEN CASE WHEN coalesce(tool_status = 'error', false) OR {_ERR} THEN 'tool_result_error' ELSE 'tool_result_success' END WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown' END"
_CLEARED = f"""
t AS (SELECT *, {_TYPE} AS type FROM am),
r AS (SELECT *, type = 'tool_result_success' AND NOT pinned AND row_number() OVER (PARTITION BY conv_id, type = 'tool_result_success' AND NOT pinned ORDER BY turn DESC) > 3 AS cleared FROM t),
cl AS (SELECT conv_id, turn, role, type, pinned, cleared, content AS original, 's2:' || left(sha256(content), 32) AS key,
  CASE WHEN cleared THEN '[tool:' || coalesce(nullif(tool_name, ''), 'unknown') || '] result cleared (' || {_TOK} || ' tokens) — original retrievable via <<ccr:s2:' || left(sha256(content), 32) || '>>' ELSE content END AS content FROM r)"""


@_query(f", {_CLEARED} SELECT conv_id, turn, role, type, cleared, content FROM cl".replace(", \nt AS", ",\nt AS", 1), (A,))
def clear_tool_results(spark, d):
    """Flagship: stale tool results as stubs."""
    return agent.clear_tool_results(view(spark, d, AGENT_MESSAGES)).select("conv_id", "turn", "role", "type", "cleared", "content")


@_query(f"SELECT conv_id, CAST(sum({_TOK}) + 4 * count(*) AS BIGINT) AS tokens FROM cv GROUP BY conv_id", (C,))
def token_estimate(spark, d):
    return view(spark, d, CONVERSATIONS).groupBy("conv_id").agg(tokens.count_messages(F.col("content")).alias("tokens"))


@_query(f"SELECT conv_id, turn, {_TYPE} AS type FROM am", (A,))
def classify_messages(spark, d):
    return agent.classified(view(spark, d, AGENT_MESSAGES)).select("conv_id", "turn", "type")


@_query(f"SELECT conv_id, turn, coalesce(sum({_TOK} + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 AS protected FROM am", (A,))
def protected_tail(spark, d):
    return view(spark, d, AGENT_MESSAGES).select("conv_id", "turn", agent.protected_tail(200).alias("protected"))


@_query(f", t AS (SELECT *, {_TYPE} AS type FROM am) SELECT conv_id, turn, type = 'assistant' AND row_number() OVER (PARTITION BY conv_id, type = 'assistant' ORDER BY turn DESC) <= 2 AS recent FROM t", (A,))
def recent_assistant(spark, d):
    return agent.recent_assistant(view(spark, d, AGENT_MESSAGES)).select("conv_id", "turn", "recent")


@_query(f""", {_CLEARED} SELECT conv_id, count(*) AS messages, count(*) FILTER (type = 'tool_result_success') AS tool_results, count(*) FILTER (cleared) AS cleared,
  count(*) FILTER (type = 'tool_result_success' AND NOT cleared) AS kept, count(*) FILTER (pinned) AS pinned, count(*) FILTER (type = 'tool_result_error') AS errors,
  CAST(sum(greatest(1, CAST(ceil(octet_length(encode(original)) / 4.0) AS BIGINT))) + 4 * count(*) AS BIGINT) AS tokens_before, CAST(sum({_TOK}) + 4 * count(*) AS BIGINT) AS tokens_after FROM cl GROUP BY conv_id""", (A,))
def agent_stats(spark, d):
    return agent.stats(view(spark, d, AGENT_MESSAGES))


@_query(f""", {_CLEARED}, t2 AS (SELECT conv_id, turn, type FROM t), x AS (SELECT conv_id, turn, type, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, type = 'assistant' AND row_number() OVER (PARTITION BY conv_id, type = 'assistant' ORDER BY turn DESC) <= 2 AS recent FROM t2)
  SELECT conv_id, CAST(count(*) - coalesce(min(i) FILTER (recent), count(*)) AS BIGINT) AS recent_span FROM x GROUP BY conv_id""", (A,))
def preserve_counts(spark, d):
    return agent.preserve_counts(view(spark, d, AGENT_MESSAGES)).select("conv_id", "recent_span")


@_query("SELECT doc_id, 's2:' || left(sha256(text), 32) AS key, '<<ccr:s2:' || left(sha256(text), 32) || '>>' AS marker FROM documents")
def content_key(spark, d):
    k = keys.key(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", k.alias("key"), keys.marker(k).alias("marker"))


@_query(f", {_CLEARED} SELECT DISTINCT conv_id, key AS id FROM cl WHERE cleared", (A,))
def referenced_ids(spark, d):
    rows = agent.clear_tool_results(view(spark, d, AGENT_MESSAGES))
    return rows.select("conv_id", F.explode(keys.referenced(F.col("content"), F.col("ccr_id"))).alias("id")).distinct()


def _count(pattern: str, rows: str) -> str:
    return f"len(list_filter({rows}, lambda x: regexp_matches(x, '{pattern.replace(chr(39), chr(39) * 2)}')))"


def _prefix(text: str, limit: int) -> str:
    """SQL for the longest prefix of at most ``limit`` bytes."""
    return f"left({text}, CAST(list_max(list_filter(range(0, {limit} + 1), lambda k: octet_length(encode(left({text}, CAST(k AS INT)))) <= {limit})) AS INT))"


_HTML = f"""h AS (SELECT page_id, {_prefix('html', 3000)} AS x FROM pages),
c AS (SELECT page_id, regexp_matches(x, '{detect_.HTML_DOCTYPE}') AS dt, regexp_matches(x, '{detect_.HTML_HTML}') AS ht, regexp_matches(x, '{detect_.HTML_HEAD}') AS hd, regexp_matches(x, '{detect_.HTML_BODY}') AS bd, len(regexp_extract_all(x, '{detect_.HTML_PART}')) AS n FROM h),
s AS (SELECT *, CASE WHEN dt THEN 0.5 ELSE 0.0 END + CASE WHEN ht THEN 0.3 ELSE 0.0 END + CASE WHEN hd THEN 0.1 ELSE 0.0 END + CASE WHEN bd THEN 0.1 ELSE 0.0 END + least(0.03 * n, 0.3) AS t FROM c)"""


@_query(f"WITH {_HTML} SELECT page_id, round(CAST(CASE WHEN NOT (dt OR ht OR n >= 3) OR t < 0.5 THEN 0 ELSE least(1, t) END AS DOUBLE), 6) AS confidence FROM s")
def detect_html(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.round(detect_.html_confidence(F.col("html")).cast("double"), 6).alias("confidence"))


_LOGRE = "|".join(f"(?:{p})" for p in detect_.LOG)


@_query(f""", n AS (SELECT log_id, line_no, line FROM ll WHERE line_no < 200)
SELECT log_id, round(least(1.0, 0.3 + 0.5 * avg(CAST(regexp_matches(line, '{_LOGRE}') AS INT)) + 0.05 * sum(CAST(regexp_matches(line, '(?:{detect_.LOG[0]})|(?:{detect_.LOG[1]})') AS INT))), 6) AS confidence FROM n GROUP BY log_id""", (L,))
def detect_log(spark, d):
    text = view(spark, d, LOG_LINES).groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return text.select("log_id", F.round(detect_.log_confidence(F.col("t")).cast("double"), 6).alias("confidence"))


@_query("SELECT * FROM (VALUES (1, 'diff', 'ast_code'), (2, 'search', 'semantic'), (3, 'build', 'log_stripper'), (4, 'source_code', 'ast_code'), (5, 'json_array', 'smart_crusher'), (6, 'json_array', 'smart_crusher'), (7, 'text', 'semantic'), (8, 'text', 'semantic'), (9, 'html', 'semantic'), (10, 'source_code', 'ast_code')) x(payload_id, content_type, compressor)")
def route_compressor(spark, d):
    rows = pipeline.routed(view(spark, d, PAYLOADS))
    return rows.select("payload_id", F.col("detected.content_type").alias("content_type"), "compressor")


@_query()
def route_payloads(spark, d):
    """The routes of whole tables; ``route_compressor`` holds those of the ten literals against SQL."""
    rows = pipeline.routed(view(spark, d, TABLE_PAYLOADS))
    return rows.select("source", "payload_id", F.col("detected.content_type").alias("content_type"), "compressor")


_SEARCH_N = _count(detect_.SEARCH, "ls")


@_query(f"WITH x AS (SELECT doc_id, string_split(text, chr(10))[1:100] AS ls, string_split(text, chr(10))[1:500] AS ld FROM documents) SELECT doc_id, CAST({_SEARCH_N} AS INT) AS search_lines, CAST({_count(detect_.DIFF_HEADER, 'ld')} AS INT) AS diff_headers, CAST({_count(detect_.DIFF_CHANGE, 'ld')} AS INT) AS diff_changes FROM x")
def detect_line_counts(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    n = lambda k, p: F.size(F.filter(lines(F.col("text"), k), lambda x: x.rlike(p)))
    return rows.select("doc_id", n(100, detect_.SEARCH).alias("search_lines"), n(500, detect_.DIFF_HEADER).alias("diff_headers"), n(500, detect_.DIFF_CHANGE).alias("diff_changes"))


_TERMS = focus.terms(QUESTION)
_REL = " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{t}') AS INT)" for t in _TERMS)


@_query(f"SELECT doc_id, ({_REL}) > 0 AS matches, CAST(100.0 * ({_REL}) AS DOUBLE) AS relevance FROM documents")
def focus_relevance(spark, d):
    c = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", focus.matches(c, _TERMS).alias("matches"), focus.relevance(c, _TERMS).cast("double").alias("relevance"))


@_query("SELECT series_id, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS deviation, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM ev GROUP BY series_id", (V,))
def number_stats(spark, d):
    rows = series.statistics(view(spark, d, EVENT_VALUES), "series_id", "value")
    return rows.select("series_id", "n", "low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "median", "deviation", "p25", "p75")])


@_query("SELECT series_id, idx, coalesce(abs(value - avg(value) OVER w) > 2 * stddev_samp(value) OVER w, false) AS outlier FROM ev WINDOW w AS (PARTITION BY series_id)", (V,))
def number_outliers(spark, d):
    return series.outliers(view(spark, d, EVENT_VALUES), "series_id", "value").select("series_id", "idx", "outlier")


@_query(""", x AS (SELECT series_id, idx, count(*) OVER p AS n, stddev_samp(value) OVER p AS sd, avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM ev WINDOW p AS (PARTITION BY series_id))
SELECT series_id, idx, n > 10 AND idx >= 5 AND idx < n - 5 AND abs(a - b) > 1 * sd AS change FROM x""", (V,))
def change_points(spark, d):
    return series.change_points(view(spark, d, EVENT_VALUES), "series_id", "idx", "value", times=1.0).select("series_id", "idx", "change")


@_query(""", x AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY idx) AS r, count(*) OVER (PARTITION BY array_id) AS n, row_number() OVER (PARTITION BY array_id ORDER BY length(item) DESC, idx) AS k FROM ei)
SELECT array_id, idx, n <= 15 OR r <= 4 OR r > n - 2 OR k <= 9 AS kept FROM x""", (I,))
def dict_array_sample(spark, d):
    return series.sample_records(view(spark, d, EVENT_ITEMS), "array_id", "idx", "item").select("array_id", "idx", "kept")


_BAD = " OR ".join(f"contains(lower(para), '{w}')" for w in series.ERROR_WORDS)


@_query(f"SELECT text_id, pos, ({_BAD}) AS bad, coalesce(abs(length(para) - avg(length(para)) OVER w) > 2 * stddev_samp(length(para)) OVER w, false) AS odd FROM pa WINDOW w AS (PARTITION BY text_id)", (P,))
def string_anomalies(spark, d):
    return series.string_flags(view(spark, d, PARAGRAPHS), "text_id", "para").select("text_id", "pos", "bad", "odd")


_PRINTS = """, g AS (SELECT array_id, idx, unnest(CASE WHEN length(item) <= 3 THEN [item] ELSE list_transform(range(1, length(item) - 2), lambda i: substr(item, i, 4)) END) AS g FROM (SELECT array_id, idx, lower(item) AS item FROM ei)),
m AS (SELECT array_id, idx, md5(g) AS h FROM g),
b AS (SELECT array_id, idx, k, sum(CASE WHEN (('0x' || substr(h, 1 + 4 * CAST(floor((63 - k) / 16) AS INT), 4))::INT >> (k % 16)) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM m, (SELECT unnest(range(0, 64)) AS k) GROUP BY ALL),
pr AS (SELECT array_id, idx, CAST(sum(CASE WHEN v > 0 THEN CASE WHEN k = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(k AS INT) END ELSE 0 END) AS BIGINT) AS print FROM b GROUP BY array_id, idx)"""


@_query(_PRINTS + " SELECT * FROM pr", (I,))
def simhash_fingerprint(spark, d):
    return view(spark, d, EVENT_ITEMS).select("array_id", "idx", series.simhash(F.col("item")).alias("print"))


@_query(_PRINTS + """, li AS (SELECT array_id, list(print ORDER BY idx) AS ps FROM pr GROUP BY array_id)
SELECT array_id, CAST(len(list_reduce(ps, lambda acc, p: CASE WHEN len(list_filter(acc, lambda q: bit_count(xor(p[1], q)) <= 3)) > 0 THEN acc ELSE list_concat(acc, p) END, CAST([] AS BIGINT[]))) AS INT) AS clusters FROM (SELECT array_id, list_transform(ps, lambda p: [p]) AS ps FROM li)""", (I,))
def simhash_clusters(spark, d):
    rows = view(spark, d, EVENT_ITEMS).select("array_id", "idx", series.simhash(F.col("item")).alias("print"))
    prints = F.transform(F.array_sort(F.collect_list(F.struct("idx", "print"))), lambda x: x["print"])
    return rows.groupBy("array_id").agg(series.clusters(prints).alias("clusters"))


_BIGRAMS = """, w AS (SELECT text_id, pos, list_filter(string_split_regex(lower(para), '\\s+'), lambda x: x <> '') AS ws FROM pa),
b AS (SELECT text_id, pos, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [coalesce(ws[1], '') || ' '] END) AS p FROM w),
f AS (SELECT text_id, pos, count(*) AS n FROM (SELECT text_id, p, min(pos) AS pos FROM b GROUP BY text_id, p) GROUP BY text_id, pos),
c AS (SELECT text_id, pos, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY text_id ORDER BY pos) AS BIGINT) AS "distinct" FROM w LEFT JOIN f USING (text_id, pos))"""


@_query(_BIGRAMS + " SELECT * FROM c", (P,))
def bigram_curve(spark, d):
    return series.bigram_curve(view(spark, d, PARAGRAPHS), "text_id", "pos", "para")


@_query(_BIGRAMS + """, k AS (SELECT text_id, row_number() OVER o - 1 AS i, count(*) OVER p AS n, "distinct" AS y, min("distinct") OVER p AS lo, max("distinct") OVER p AS hi FROM c WINDOW p AS (PARTITION BY text_id), o AS (PARTITION BY text_id ORDER BY pos)),
a AS (SELECT *, CASE WHEN hi <> lo THEN (y - lo) / (hi - lo) - i / (n - 1) END AS above FROM k),
m AS (SELECT *, max(above) OVER (PARTITION BY text_id) AS top FROM a)
SELECT text_id, CAST(CASE WHEN max(n) < 3 THEN NULL WHEN max(hi - lo) = 0 THEN 1 WHEN max(top) >= 0.05 THEN min(i) FILTER (above = top) + 1 END AS INT) AS knee FROM m GROUP BY text_id""", (P,))
def knee(spark, d):
    return series.knee(series.bigram_curve(view(spark, d, PARAGRAPHS), "text_id", "pos", "para"), "text_id", "pos", "distinct")


_LEVEL = "CASE WHEN contains(upper(line), 'ERROR') OR contains(upper(line), 'FATAL') OR contains(upper(line), 'CRITICAL') THEN 'error' WHEN contains(upper(line), 'FAIL') THEN 'fail' WHEN contains(upper(line), 'WARN') THEN 'warn' WHEN contains(upper(line), 'INFO') THEN 'info' WHEN contains(upper(line), 'DEBUG') THEN 'debug' WHEN contains(upper(line), 'TRACE') THEN 'trace' ELSE 'unknown' END"
_SIM = r"regexp_extract(line, '^([^:=]*)', 1) || regexp_replace(regexp_replace(regexp_replace(substr(line, length(regexp_extract(line, '^([^:=]*)', 1)) + 1), '[0-9]+', 'N', 'g'), '[0-9a-fA-F]+', 'H', 'g'), '/[^\s]*', '/P/', 'g')"


@_query(f"SELECT log_id, line_no, {_LEVEL} AS level, starts_with(line, '===') AS summary FROM ll", (L,))
def log_levels(spark, d):
    return view(spark, d, LOG_LINES).select("log_id", "line_no", logs.level(F.col("line")).alias("level"), logs.is_summary(F.col("line")).alias("summary"))


@_query(f", w AS (SELECT log_id, line_no, line, {_SIM} AS key FROM ll WHERE {_LEVEL} = 'warn') SELECT log_id, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM w GROUP BY log_id, key", (L,))
def warning_dedup(spark, d):
    return logs.warnings_once(view(spark, d, LOG_LINES)).select("log_id", "line_no", "line")


_SELECTED = f""", v AS (SELECT log_id, line_no, line, {_LEVEL} AS level, starts_with(line, '===') AS summary, {_SIM} AS sim, count(*) OVER (PARTITION BY log_id) AS n FROM ll),
s AS (SELECT *, round(least(1.0, CASE level WHEN 'error' THEN 1.0 WHEN 'fail' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'info' THEN 0.1 WHEN 'unknown' THEN 0.1 WHEN 'debug' THEN 0.05 ELSE 0.02 END + CASE WHEN summary THEN 0.4 ELSE 0.0 END), 2) AS score, CASE WHEN level = 'warn' THEN sim END AS key FROM v),
q AS (SELECT *, row_number() OVER (PARTITION BY log_id, level ORDER BY line_no) = 1 OR row_number() OVER (PARTITION BY log_id, level ORDER BY line_no DESC) = 1 AS ends, count(*) OVER (PARTITION BY log_id, level) AS c, row_number() OVER (PARTITION BY log_id, level, key ORDER BY line_no) AS once FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY log_id, level, ends ORDER BY score DESC, line_no) AS rest, row_number() OVER (PARTITION BY log_id, level = 'warn', once = 1 ORDER BY line_no) AS wn FROM q),
h AS (SELECT *, (level IN ('error', 'fail') AND (c <= 10 OR ends OR rest <= 8)) OR (level = 'warn' AND once = 1 AND wn <= 5) OR summary AS chosen FROM u),
y AS (SELECT *, max(CAST(chosen AS INT)) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near FROM h),
z AS (SELECT *, n < 50 OR near AND row_number() OVER (PARTITION BY log_id, near ORDER BY score DESC, line_no) <= 100 AS kept FROM y)"""


@_query(_SELECTED + " SELECT log_id, line_no, kept FROM z", (L,))
def log_select(spark, d):
    return logs.select_lines(view(spark, d, LOG_LINES)).select("log_id", "line_no", "kept")


@_query(_SELECTED + """, f AS (SELECT log_id, count(*) AS lines, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept AND level = 'error') AS e, count(*) FILTER (NOT kept AND level = 'fail') AS f, count(*) FILTER (NOT kept AND level = 'warn') AS w, count(*) FILTER (NOT kept AND level = 'info') AS i FROM z GROUP BY log_id)
SELECT log_id, lines, kept, CASE WHEN e + f + w + i > 0 THEN '[' || (lines - kept) || ' lines omitted: ' || concat_ws(', ', CASE WHEN e > 0 THEN e || ' ERROR' END, CASE WHEN f > 0 THEN f || ' FAIL' END, CASE WHEN w > 0 THEN w || ' WARN' END, CASE WHEN i > 0 THEN i || ' INFO' END) || ']' END AS note FROM f""", (L,))
def log_footer(spark, d):
    return logs.footers(logs.select_lines(view(spark, d, LOG_LINES)))


@_query()
def log_strip(spark, d):
    """Whole logs through the kernel, traces and footers included."""
    text = view(spark, d, LOG_LINES).groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    out = pipeline.reduce(text.withColumn("compressor", F.lit("log_stripper")), pipeline.CompressConfig())
    return out.select("log_id", F.col("reduced").alias("content"), F.get("saved", F.lit(0))["id"].alias("ccr_id"))


_PARAS = r""", k AS (SELECT text_id, pos, para, trim(regexp_replace(para, '\s+', ' ', 'g')) AS key FROM pa),
n AS (SELECT *, row_number() OVER (PARTITION BY text_id, key ORDER BY pos) AS nth FROM k WHERE key <> ''),
r AS (SELECT *, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY pos) AS reps FROM n),
e AS (SELECT *, CAST(sum(CASE WHEN nth = 1 OR reps <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY pos) - 1 AS BIGINT) AS out_pos FROM r),
f AS (SELECT *, min(CASE WHEN nth = 1 THEN out_pos END) OVER (PARTITION BY text_id, key) AS fp FROM e)"""


@_query(_PARAS + " SELECT text_id, pos, out_pos, CASE WHEN nth > 1 THEN '[see paragraph ' || (fp + 1) || ']' WHEN octet_length(encode(para)) > 800 THEN " + _prefix("para", 800) + " || '... [truncated]' ELSE para END AS out FROM f WHERE nth = 1 OR reps <= 3", (P,))
def semantic_compress(spark, d):
    return paragraphs.semantic(view(spark, d, PARAGRAPHS)).select("text_id", "pos", "out_pos", "out")


@_query(r", t AS (SELECT text_id, pos, regexp_replace(para, '^\s+|\s+$', '', 'g') AS para FROM pa), n AS (SELECT *, row_number() OVER (PARTITION BY text_id, para ORDER BY pos) AS nth FROM t WHERE para <> ''), s AS (SELECT *, sum(CASE WHEN nth > 1 THEN octet_length(encode(para)) ELSE 0 END) OVER (PARTITION BY text_id ORDER BY pos) AS saved FROM n) SELECT text_id, pos, CASE WHEN nth = 1 THEN para ELSE chr(10) || '<<ccr:s2:' || left(sha256(para), 32) || '>>' END AS out FROM s WHERE nth = 1 OR saved > 100", (P,))
def dedup_ref(spark, d):
    return paragraphs.dedup_ref(view(spark, d, PARAGRAPHS))


@_query()
def stack_traces(spark, d):
    """The lines of every payload that stand inside a stack trace."""
    rows = logs.traces(view(spark, d, TABLE_PAYLOADS), "content")
    return rows.select("source", "payload_id", F.size("traces").alias("n_lines"), F.array_join("traces", ",").alias("lines"))


@_query()
def code_strip(spark, d):
    """Every payload through the code reducer, whatever its route."""
    rows = view(spark, d, TABLE_PAYLOADS).withColumn("compressor", F.lit("ast_code"))
    out = pipeline.reduce(rows, pipeline.CompressConfig())
    return out.select("source", "payload_id", F.col("reduced").alias("content"), F.get("saved", F.lit(0))["id"].alias("ccr_id"))


@_query()
def payload_reduction(spark, d):
    """All payloads of the tables, and the literals, through their kernels."""
    out = pipeline.compress(view(spark, d, TABLE_PAYLOADS)).messages
    return out.select("source", "payload_id", "compressor", "content", "ccr_id")


_FIELDS = ", p AS (SELECT array_id, idx, item, regexp_extract(item, '\"id\":([0-9]+)', 1) AS id, regexp_extract(item, '\"type\":\"([a-z]+)\"', 1) AS type FROM ei)"


@_query(_FIELDS + " SELECT array_id, idx, item AS aligned, item AS small, 'Row ' || id || ' is ' || type || ' ok' AS prose_aligned, 'Row ' || id || '   is ' || type || ' ok' AS prose_small FROM p", (I,))
def json_minify_align(spark, d):
    """JSON with keys out of order and white space, and prose of several lines."""
    rows = view(spark, d, EVENT_ITEMS)
    of = lambda k: F.get_json_object("item", f"$.{k}")
    loose = F.concat(F.lit(' { "type" : "'), of("type"), F.lit('",\n "note":   "'), of("note"), F.lit('", "id" : '), of("id"), F.lit("}\n"))
    prose = F.concat(F.lit("  Row "), of("id"), F.lit("   is "), of("type"), F.lit("\n \n\tok  "))
    return rows.select("array_id", "idx", *[f(c).alias(n) for c, p in ((loose, ""), (prose, "prose_")) for f, n in ((pipeline.align_text, f"{p}aligned"), (pipeline.minify, f"{p}small"))])


@_query(r""", s AS (SELECT conv_id, turn, trim(regexp_extract(content, '^([^.!?]*)', 1)) AS s FROM cv),
j AS (SELECT conv_id, string_agg(s, ' | ' ORDER BY turn) AS x FROM s WHERE s <> '' GROUP BY conv_id) SELECT conv_id, CASE WHEN octet_length(encode(x)) > 800 THEN """ + _prefix("x", 800) + """ || '…' ELSE x END AS summary FROM j""", (C,))
def summarise_turns(spark, d):
    return summary.summarise_turns(view(spark, d, CONVERSATIONS))


def _summary(am: str, tag: str = "") -> str:
    """CTE ``sm`` of structured summaries of a view of messages."""
    out = _SUMMARY
    for name in ("l", "k", "r", "g", "fi", "b", "sm"):
        for before, after in ((f"{name} AS (", f"{name}{tag} AS ("), (f"FROM {name} ", f"FROM {name}{tag} "), (f"JOIN {name} ", f"JOIN {name}{tag} ")):
            out = out.replace(before, after)
    return out.replace("FROM am", f"FROM {am}")


_SUMMARY = r""", l AS (SELECT conv_id, turn, content AS line FROM am),
k AS (SELECT conv_id, line, min(turn) AS t, CASE WHEN starts_with(lower(line), 'decision:') THEN 'd' WHEN """ + _ERR.replace("content", "line") + r""" THEN 'e' WHEN starts_with(lower(line), 'todo') THEN 'n' END AS c FROM l GROUP BY conv_id, line),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, c ORDER BY t) AS i FROM k WHERE c IS NOT NULL),
g AS (SELECT conv_id, string_agg(line, '#' ORDER BY t) FILTER (c = 'd') AS decisions, string_agg(line, '#' ORDER BY t) FILTER (c = 'e') AS errors, string_agg(line, '#' ORDER BY t) FILTER (c = 'n') AS next_steps FROM r WHERE i <= 20 GROUP BY conv_id),
fi AS (SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(content, '[A-Za-z0-9_./\-]+\.(?:rs|py)\b'))))), '#') AS files FROM am GROUP BY conv_id),
b AS (SELECT conv_id, coalesce(trim(regexp_extract(arg_min(content, turn) FILTER (role = 'user'), '^([^.!?]*)', 1)), '') AS intent, count(*) AS turns_covered FROM am GROUP BY conv_id)
, sm AS (SELECT conv_id, intent, coalesce(files, '') AS files, coalesce(decisions, '') AS decisions, coalesce(errors, '') AS errors, coalesce(next_steps, '') AS next_steps, turns_covered FROM b LEFT JOIN g USING (conv_id) LEFT JOIN fi USING (conv_id))"""


@_query(_summary("am") + " SELECT * FROM sm", (A,))
def structured_summary(spark, d):
    rows = summary.summarize(view(spark, d, AGENT_MESSAGES))
    return rows.select("conv_id", "intent", *[F.array_join(c, "#").alias(c) for c in ("files", "decisions", "errors", "next_steps")], "turns_covered")


_SECTIONS = [("Files touched", "files"), ("Key decisions", "decisions"), ("Unresolved errors", "errors"), ("Next steps", "next_steps")]
_BULLETS = ", ".join(f"CASE WHEN {c} <> '' THEN '## {t}' || chr(10) || '- ' || replace({c}, '#', chr(10) || '- ') END" for t, c in _SECTIONS)


@_query(_summary("am") + f" SELECT conv_id, concat_ws(chr(10) || chr(10), CASE WHEN intent <> '' THEN '## Session intent' || chr(10) || intent END, {_BULLETS}) AS markdown FROM sm", (A,))
def summary_markdown(spark, d):
    rows = summary.summarize(view(spark, d, AGENT_MESSAGES))
    return rows.select("conv_id", summary.markdown(rows).alias("markdown"))


_LISTS = ("intent", "files", "decisions", "errors", "next_steps")


@_query(", e AS (SELECT * FROM am WHERE turn < 20)" + _summary("am") + _summary("e", "1") + f""", c AS (SELECT conv_id, count(*) AS n FROM am WHERE turn >= 20 GROUP BY conv_id)
SELECT conv_id, {", ".join(f"sm.{c}" for c in _LISTS)}, sm1.turns_covered + CASE WHEN {" OR ".join(f"sm.{c} <> sm1.{c}" for c in _LISTS)} THEN n ELSE 0 END AS turns_covered FROM sm JOIN sm1 USING (conv_id) JOIN c USING (conv_id)""", (A,))
def summary_merge(spark, d):
    """Summaries of earlier turns, and what later ones add."""
    rows = view(spark, d, AGENT_MESSAGES)
    merged = summary.merge(summary.summarize(rows.where("turn < 20")), summary.summarize(rows.where("turn >= 20")))
    return merged.select("conv_id", "intent", *[F.array_join(c, "#").alias(c) for c in _LISTS[1:]], "turns_covered")


@_query(""", i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM am),
a AS (SELECT *, max(CASE WHEN role NOT IN ('tool', 'function') AND idx <= greatest(n - 14, 0) THEN idx END) OVER (PARTITION BY conv_id) AS al, min(CASE WHEN pinned THEN idx END) OVER (PARTITION BY conv_id) AS pin FROM i),
m AS (SELECT *, CASE WHEN pin IS NOT NULL AND pin < coalesce(al, 0) THEN pin ELSE coalesce(al, 0) END AS start FROM a)
SELECT conv_id, turn, CASE WHEN n <= 4 OR idx >= n - 4 THEN 'recent' WHEN idx >= start THEN 'middle' ELSE 'old' END AS band FROM m""", (A,))
def band_assignment(spark, d):
    return bands.assign(view(spark, d, AGENT_MESSAGES), recent=4, middle=10).select("conv_id", "turn", "band")


_HISTORY = f""", i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM am),
a AS (SELECT *, max(CASE WHEN role NOT IN ('tool', 'function') AND idx <= greatest(n - 14, 0) THEN idx END) OVER (PARTITION BY conv_id) AS al, min(CASE WHEN pinned THEN idx END) OVER (PARTITION BY conv_id) AS pin FROM i),
m AS (SELECT *, CASE WHEN pin IS NOT NULL AND pin < coalesce(al, 0) THEN pin ELSE coalesce(al, 0) END AS start FROM a),
bd AS (SELECT *, n > 4 AND idx < n - 4 AND idx < start AS old FROM m),
s AS (SELECT conv_id, turn, trim(regexp_extract(content, '^([^.!?]*)', 1)) AS s FROM bd WHERE old),
j AS (SELECT conv_id, string_agg(s, ' | ' ORDER BY turn) AS x FROM s WHERE s <> '' GROUP BY conv_id),
h AS (SELECT conv_id, '[Earlier conversation context]: ' || CASE WHEN octet_length(encode(x)) > 800 THEN {_prefix('x', 800)} || '…' ELSE x END AS y FROM j),
w AS (SELECT conv_id, -1 AS turn, 'system' AS role, CASE WHEN octet_length(encode(y)) > 800 AND NOT regexp_matches(y, '{_LOGRE}') THEN {_prefix('y', 800)} || '... [truncated]' ELSE y END AS content FROM h
  UNION ALL SELECT conv_id, turn, role, content FROM bd WHERE NOT old)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, role, content FROM w"""


@_query(_HISTORY, (A,))
def compress_history(spark, d):
    return bands.compress_history(view(spark, d, AGENT_MESSAGES), recent=4, middle=10).select("conv_id", "idx", "role", "content")


@_query()
def budget_cascade(spark, d):
    out = compact(view(spark, d, AGENT_MESSAGES), CompactConfig(limit=400))
    return out.reports.select("conv_id", "tokens_initial", "tokens_final", F.array_join("steps", ",").alias("steps"), "error", "messages", "dropped")


@_query(f", {_CLEARED} SELECT conv_id, turn AS start, turn + 1 AS \"end\", 'cleared' AS kind, 's2:' || left(sha256(original), 32) AS ccr_id, greatest(1, CAST(ceil(octet_length(encode(original)) / 4.0) AS BIGINT)) AS original_tokens, {_TOK} AS replacement_tokens FROM cl WHERE cleared", (A,))
def fold_ledger(spark, d):
    """What clearing alone folds."""
    return compact(view(spark, d, AGENT_MESSAGES), CompactConfig()).folds.select("conv_id", "start", "end", "kind", "ccr_id", "original_tokens", "replacement_tokens")


@_query()
def fold_ledger_budget(spark, d):
    return compact(view(spark, d, AGENT_MESSAGES), CompactConfig(limit=400)).folds.select("conv_id", "id", "kind", "start", "end", "original_tokens", "replacement_tokens")


_TAGS = r""", p AS (SELECT conv_id, array_to_string(list_sort(list_distinct(list(tool_name) FILTER (tool_name <> ''))), ',') AS tool_names,
 array_to_string(list_sort(list_distinct(flatten(list(list_filter([CASE WHEN tool_status = 'error' THEN 'tool_error' END, CASE WHEN contains(content, 'Error:') OR contains(content, 'error:') OR contains(content, 'ERROR') THEN 'error' END], lambda x: x IS NOT NULL))))), ',') AS error_classes,
 array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(content, 'src/m[0-9]/[a-z]+\.(?:rs|py)'))))), ',') AS file_paths FROM am GROUP BY conv_id)"""


@_query(_TAGS + " SELECT conv_id, coalesce(tool_names, '') AS tool_names, error_classes, file_paths FROM p", (A,))
def fold_tags(spark, d):
    rows = tags.tags(view(spark, d, AGENT_MESSAGES), ["conv_id"])
    return rows.select("conv_id", *[F.array_join(c, ",").alias(c) for c in ("tool_names", "error_classes", "file_paths")])


@_query(_TAGS + " SELECT conv_id FROM p WHERE list_contains(string_split(file_paths, ','), 'src/m3/job.py')", (A,))
def find_by_tag(spark, d):
    return recall.find_by_tag(tags.tags(view(spark, d, AGENT_MESSAGES), ["conv_id"]), "file_paths", "SRC/M3/job.py").select("conv_id")


_WORDS = r"""WITH cv AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS content FROM documents), t AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(content, '[\s"''`(),;:\[\]{}=<>|!?*&@#%+~^$]+'), lambda x: regexp_replace(x, '^[^\pL\pN/._\\-]+|[^\pL\pN/._\\-]+$', '', 'g')), lambda x: length(regexp_replace(x, '[^\pL\pN]', '', 'g')) >= 2)) AS tok FROM cv),
s AS (SELECT id, lower(tok) AS term FROM t UNION ALL SELECT id, p AS term FROM (SELECT id, tok, unnest(list_transform(string_split_regex(regexp_replace(tok, '([\p{Ll}\pN])(\p{Lu})', '\1/\2', 'g'), '[/._\\-]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS p FROM t) WHERE p <> lower(tok) AND length(p) >= 2)"""


def _recall_docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content"))


@_query(_WORDS + " SELECT id, term, count(*) AS tf FROM s GROUP BY id, term")
def recall_terms(spark, d):
    return recall.build(_recall_docs(spark, d), "id", "content")[1]


@_query(_WORDS + """, dl AS (SELECT ln.id, count(s.term) AS len FROM cv ln LEFT JOIN s ON s.id = ln.id GROUP BY ln.id), tot AS (SELECT count(*) AS n, avg(len) AS av FROM dl),
tf AS (SELECT id, term, count(*) AS tf FROM s WHERE term IN ('the', 'then', 'eau', 'que') GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS score FROM tf JOIN df USING (term) JOIN dl USING (id), tot GROUP BY id)
SELECT id, round(score, 6) AS score FROM sc ORDER BY score DESC, id LIMIT 10""")
def recall_search(spark, d):
    docs, postings = recall.write_index(_recall_docs(spark, d), "id", "content")
    return recall.search(docs, postings, "the then: eau que", 10).select("id", F.round("score", 6).alias("score"))


_PREFIX = f""", i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM cv),
p AS (SELECT conv_id, count(*) FILTER (idx < n - 1) AS prefix_messages, CAST(coalesce(sum({_TOK} + 4) FILTER (idx < n - 1), 0) AS BIGINT) AS prefix_tokens, string_agg(role || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY idx) FILTER (idx < n - 1) AS whole FROM i GROUP BY conv_id)"""


@_query(_PREFIX + " SELECT conv_id, 'openai' AS policy, prefix_messages, prefix_tokens, prefix_tokens >= 1024 AS cacheable, CASE WHEN prefix_messages > 0 THEN 'prefix-s2:' || left(sha256(whole), 32) END AS content_key, CASE WHEN prefix_messages > 0 AND prefix_tokens < 1024 THEN 'stable prefix is ' || prefix_tokens || ' tokens; provider prompt caching typically engages around 1024+' ELSE '' END AS notes FROM p", (C,))
def cache_plan(spark, d):
    rows = cache.plan(view(spark, d, CONVERSATIONS), "openai", 1)
    return rows.select("conv_id", "policy", "prefix_messages", "prefix_tokens", "cacheable", "content_key", F.array_join("notes", ";").alias("notes"))


@_query(_PREFIX + ", s AS (SELECT conv_id, turn, idx, n, max(CASE WHEN role = 'system' THEN idx END) OVER (PARTITION BY conv_id) AS sys FROM i) SELECT conv_id, turn, CASE WHEN idx = sys OR (n > 2 AND idx = n - 3 AND (sys IS NULL OR n - 3 > sys)) THEN 'ephemeral' END AS cache_control FROM s", (C,))
def cache_breakpoints(spark, d):
    return cache.breakpoints(view(spark, d, CONVERSATIONS), 2).select("conv_id", "turn", "cache_control")


@_query(_PREFIX + " SELECT conv_id, prefix_messages, prefix_tokens, CASE WHEN prefix_messages = 0 THEN 'no stable prefix: every message is treated as volatile' WHEN prefix_tokens < 1024 THEN 'stable prefix is ' || prefix_tokens || ' tokens; OpenAI auto-caching engages around 1024' END AS note FROM p", (C,))
def openai_prefix(spark, d):
    return cache.stable_prefix_report(view(spark, d, CONVERSATIONS), 1, "openai").select("conv_id", "prefix_messages", "prefix_tokens", "note")


@_query(_PREFIX + " SELECT conv_id, prefix_tokens, prefix_tokens >= 1024 AS cacheable, CASE WHEN prefix_messages > 0 THEN 'prefix-s2:' || left(sha256(whole), 32) END AS content_key FROM p", (C,))
def gemini_candidate(spark, d):
    return cache.plan(view(spark, d, CONVERSATIONS), "gemini", 1).select("conv_id", "prefix_tokens", "cacheable", "content_key")


_BLOCK = "'{\"type\":\"text\",\"text\":' || to_json(content) || CASE WHEN marked THEN ',\"cache_control\":{\"type\":\"ephemeral\"}' ELSE '' END || '}'"


@_query(_PREFIX + f""", s AS (SELECT *, max(CASE WHEN role = 'system' THEN idx END) OVER (PARTITION BY conv_id) AS sys FROM i),
m AS (SELECT *, coalesce(idx = sys, false) OR (n > 1 AND idx = n - 2 AND (sys IS NULL OR n - 2 > sys)) AS marked FROM s), bl AS (SELECT *, {_BLOCK} AS block FROM m)
SELECT conv_id, '{{"system":[' || coalesce(string_agg(block, ',' ORDER BY idx) FILTER (role = 'system'), '') || '],"messages":[' || coalesce(string_agg('{{"role":"' || CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END || '","content":[' || block || ']}}', ',' ORDER BY idx) FILTER (role <> 'system'), '') || ']}}' AS request FROM bl GROUP BY conv_id""", (C,))
def provider_render(spark, d):
    return cache.render(view(spark, d, CONVERSATIONS), 1)


def _rich(spark, d) -> DataFrame:
    """Assistant rows before a tool row call it, tool rows hold the result."""
    from pyspark.sql import Window

    rows, o = view(spark, d, AGENT_MESSAGES), Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumns({"next": F.lead("role").over(o), "call": F.concat(F.lit("t"), F.sum((F.col("role") == "assistant").cast("int")).over(o).cast("string"))})
    text = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))
    use = F.struct(F.lit("tool_use").alias("type"), F.col("call").alias("id"), F.lit("run").alias("name"), F.lit("{}").alias("input_json"))
    result = F.struct(F.lit("tool_result").alias("type"), F.col("call").alias("tool_use_id"), (F.col("tool_status") == "error").alias("is_error"), F.to_json(F.array(text)).alias("content_json"))
    of = lambda *b: F.from_json(F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(x) for x in b]), F.lit("]")), f"array<{rich.BLOCK}>")
    blocks = F.when(F.col("role") == "tool", of(result)).when((F.col("role") == "assistant") & (F.col("next") == "tool"), of(text, use))
    return rows.select("conv_id", "turn", "role", F.when(blocks.isNull(), F.col("content")).alias("text"), blocks.alias("blocks"))


_RICH = """, n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM am),
f AS (SELECT conv_id, turn, CASE WHEN role = 'tool' THEN CASE WHEN tool_status = 'error' THEN '[tool_result error] ' ELSE '[tool_result] ' END || content WHEN role = 'assistant' AND nx = 'tool' THEN content || chr(10) || '[tool_use run: {}]' ELSE content END AS content FROM n)"""


@_query(_RICH + f" SELECT conv_id, turn, content AS flat, {_TOK} + 4 AS tokens FROM f", (A,))
def rich_flatten(spark, d):
    t, b = F.col("text"), F.col("blocks")
    return _rich(spark, d).select("conv_id", "turn", rich.flatten(t, b).alias("flat"), rich.rich_tokens(t, b).alias("tokens"))


@_query()
def rich_render(spark, d):
    return rich.render_turns(_rich(spark, d)).select("conv_id", "run", "side", F.to_json("blocks").alias("blocks"))


@_query()
def rich_compress(spark, d):
    rows = rich.compress_blocks(_rich(spark, d))
    return rows.select("conv_id", "turn", rich.flatten(F.col("text"), F.col("blocks")).alias("flat"), "ccr_id")


@_query()
def rich_compact(spark, d):
    """The flat cascade's folds, and shorter blocks in what it kept."""
    rows, _ = rich.compact_rich(_rich(spark, d), CompactConfig(limit=900))
    return rows.select("conv_id", "idx", "role", rich.flatten(F.col("text"), F.col("blocks")).alias("flat"), "ccr_id")


_KEYS = """, n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, 't' || CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS BIGINT) AS call FROM am),
b AS (SELECT conv_id, turn, role, content, CASE WHEN role = 'tool' THEN '[{"type":"tool_result","tool_use_id":"' || call || '","is_error":' || CASE WHEN tool_status = 'error' THEN 'true' ELSE 'false' END || ',"content_json":' || to_json('[{"type":"text","text":' || to_json(content) || '}]') || '}]'
  WHEN role = 'assistant' AND nx = 'tool' THEN '[{"type":"text","text":' || to_json(content) || '},{"type":"tool_use","id":"' || call || '","name":"run","input_json":"{}"}]' END AS blocks FROM n)
SELECT conv_id, 'rich-s2:' || left(sha256(string_agg(role || chr(31) || CASE WHEN blocks IS NULL THEN content ELSE '' END || chr(31) || coalesce(blocks, ''), chr(30) ORDER BY turn)), 32) AS content_key FROM b GROUP BY conv_id"""


@_query(_KEYS, (A,))
def rich_keys(spark, d):
    return rich.canonical(_rich(spark, d))


@_query(f", {_CLEARED}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, cleared ORDER BY turn DESC) AS k FROM cl) SELECT DISTINCT key AS id FROM o WHERE cleared AND k > 5 AND key NOT IN (SELECT key FROM o WHERE cleared AND k <= 5)", (A,))
def retention_gc(spark, d):
    """Originals that nothing refers to once each conversation keeps five stubs."""
    rows = agent.clear_tool_results(view(spark, d, AGENT_MESSAGES))
    kept, removed = session.retained(rows.withColumn("final", F.col("cleared")), 5)
    return store.collect_garbage(agent.originals(rows), removed, kept)


@_query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE epoch(ts) + 86400 > (SELECT max(epoch(ts)) FROM events) ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1000")
def store_ttl_capacity(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("original"), F.col("ts").alias("created_at"), F.lit(86_400).cast("long").alias("ttl_seconds"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return store.within_capacity(store.live(rows, now), 1000).select("id")


@_query()
def session_replay(spark, d):
    rows = session.replay(view(spark, d, AGENT_MESSAGES), CompactConfig(limit=600), every=12, max_final=10)
    return rows.select("conv_id", "step", "messages", "tokens", "new_folds", F.size("evicted").alias("evicted"), "error")


@_query(f""", r AS (SELECT content, CASE WHEN trim(content) = '' THEN '' WHEN octet_length(encode(content)) > 800 THEN {_prefix('content', 800)} || '... [truncated]' ELSE content END AS reduced FROM cv),
t AS (SELECT count(*) AS messages, CAST(sum({_TOK}) AS BIGINT) AS original_tokens, CAST(sum(floor(octet_length(encode(reduced)) / 4)) AS BIGINT) AS compressed_tokens FROM r)
SELECT compressor, messages, original_tokens, compressed_tokens, compressed_tokens / original_tokens AS ratio, 0 AS errors FROM t, (VALUES ('semantic'), ('mixed')) v(compressor)""", (C,))
def pipeline_stats(spark, d):
    return pipeline.compress(view(spark, d, CONVERSATIONS)).stats


@_query()
def sized_samples(spark, d):
    """How many records of each array are worth keeping."""
    from ..operators import sizer

    rows = view(spark, d, EVENT_ITEMS).groupBy("array_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda x: x["item"]).alias("items"))

    @F.pandas_udf("int")
    def best(items):
        return items.map(lambda x: sizer.optimal_k(list(x), 1.0, 3, 15))

    return rows.select("array_id", best("items").alias("k"), F.size("items").alias("n"))


_STORED = "'[no content stored for ' || key || ']'"


@_query(f", {_CLEARED} SELECT conv_id, turn, key AS id, CASE WHEN right(key, 1) = '0' THEN {_STORED} ELSE original END AS original FROM cl WHERE cleared", (A,))
def store_roundtrip(spark, d):
    """Originals saved twice, some deleted, and all asked for by their markers."""
    rows = agent.clear_tool_results(view(spark, d, AGENT_MESSAGES))
    own = store.entries(agent.originals(rows), "id", "original")
    table = store.delete(store.save(store.save(own.limit(0), own), own), own.where("id like '%0'"))
    asked = rows.where("cleared").select("conv_id", "turn", keys.first_marker(F.col("content")).alias("request"))
    return store.retrieve(asked, "request", store.live(table)).select("conv_id", "turn", "id", "original")


@_query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"payload":1,"media_type":"text/plain","enc":"utf8","data":' || to_json(props) ELSE '{"payload":1,"media_type":"text/plain","enc":"hex","data":"ff' || printf('%02x', event_id % 256) || '"' END || ',"metadata":{"type":"' || event_type || '"}}' AS coded,
CASE WHEN event_id % 2 = 0 THEN lower(hex(props)) ELSE 'ff' || printf('%02x', event_id % 256) END AS data, event_type AS kind FROM events""")
def payload_codec(spark, d):
    """Text and bytes as JSON envelopes and back."""
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props").cast("binary")).otherwise(F.unhex(F.format_string("FF%02x", F.col("event_id") % 256)))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", store.encode_payload(raw, F.lit("text/plain"), F.create_map(F.lit("type"), "event_type")).alias("coded"))
    back = store.decode_payload(F.col("coded"))
    return rows.select("event_id", "coded", F.lower(F.hex(back["data"])).alias("data"), back["metadata"]["type"].alias("kind"))


@_query(", c AS (SELECT series_id, CAST(count(*) AS INT) % 40 + 1 AS n FROM ev GROUP BY series_id), f AS (SELECT series_id, n, least(greatest(1, CAST(round_even(n * 0.3, 0) AS INT)), n) AS a FROM c) SELECT series_id, a AS first, least(greatest(1, CAST(round_even(n * 0.15, 0) AS INT)), greatest(n - a, 0)) AS last FROM f", (V,))
def end_items(spark, d):
    """How many items stay at the ends of arrays of different sizes."""
    rows = view(spark, d, EVENT_VALUES).groupBy("series_id").agg((F.count("*").cast("int") % 40 + 1).alias("n"))
    first, last = series.split_k(F.col("n"))
    return rows.select("series_id", first.alias("first"), last.alias("last"))


@_query(f", t AS (SELECT conv_id, CAST(sum({_TOK}) + 4 * count(*) AS BIGINT) AS n FROM cv GROUP BY conv_id) SELECT conv_id, CAST(n - ceil(n * 0.05) AS BIGINT) AS by_default, CAST(n - ceil(n * 0.2) AS BIGINT) AS by_fifth FROM t", (C,))
def effective_limits(spark, d):
    rows = token_estimate(spark, d)
    return rows.select("conv_id", tokens.effective_limit(F.col("tokens")).alias("by_default"), tokens.effective_limit(F.col("tokens"), 0.2).alias("by_fifth"))


@_query(r"WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 160 THEN left(x, 160) || '…' ELSE x END AS preview FROM t")
def recall_preview(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", recall.preview(F.coalesce("text", F.lit(""))).alias("preview"))


@_query(""", t AS (SELECT 'f' || conv_id || '-' || (turn % 3) AS id, turn, content, tool_name FROM am WHERE tool_name IS NOT NULL)
SELECT id, arg_max(content, turn) AS text, array_to_string(list_sort(list_distinct(list(tool_name))), ',') AS tool_names FROM t WHERE NOT ends_with(id, '-0') GROUP BY id""", (A,))
def recall_upkeep(spark, d):
    """An index that grows, replaces texts, merges tags and loses ids."""
    rows = view(spark, d, AGENT_MESSAGES).where("tool_name is not null")
    none = F.array().cast("array<string>")
    folded = rows.select(F.concat(F.lit("f"), "conv_id", F.lit("-"), F.col("turn") % 3).alias("id"), F.col("content").alias("text"), F.array("tool_name").alias("tool_names"), none.alias("error_classes"), none.alias("file_paths"), F.col("turn").alias("seq"))
    index = recall.upsert(folded.limit(0).drop("seq"), folded.where("seq < 20"))
    index = recall.upsert(index, folded.where("seq >= 20"))
    return recall.remove(index, index.where("id like '%-0'")).select("id", "text", F.array_join("tool_names", ",").alias("tool_names"))


_FORMATTED = """
SELECT user_id AS log_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS line_no,
  CASE WHEN event_type = 'error' THEN 'make: stopped' WHEN user_id % 6 = 0 THEN 'PASSED [x]' WHEN user_id % 6 = 1 THEN 'npm WARN x' WHEN user_id % 6 = 2 THEN 'Compiling x' WHEN user_id % 6 = 3 THEN 'PASS x' ELSE concat('gcc ', event_type) END AS line
FROM {events}
"""
_FORMATS = ", ".join(f"CAST(sum(CASE WHEN {' OR '.join(f'contains(line, {chr(39)}{p}{chr(39)})' for p in parts)} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, parts in kernels.LOG_FORMATS.items())
_MOST = "greatest(" + ", ".join(kernels.LOG_FORMATS) + ")"


@_query(f", c AS (SELECT log_id, {_FORMATS} FROM fl WHERE line_no < 100 GROUP BY log_id) SELECT log_id, CASE WHEN {_MOST} = 0 THEN 'generic' {' '.join(f'WHEN {n} = {_MOST} THEN {chr(39)}{n}{chr(39)}' for n in kernels.LOG_FORMATS)} END AS format FROM c", (("fl", _FORMATTED),))
def log_formats(spark, d):
    return logs.log_format(view(spark, d, _FORMATTED))


@_query("SELECT event_id, format('{:.4g}', event_id / 7.0) AS seventh, format('{:.4g}', event_id / 7.0e9) AS small, CAST(event_id AS VARCHAR) AS whole FROM events")
def number_format(spark, d):
    n = F.col("event_id").cast("double")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", series.format_g(n / 7.0).alias("seventh"), series.format_g(n / 7.0e9).alias("small"), series.format_number(n).alias("whole"))


_POLICIES = [("none", 0), ("generic", 1024), ("anthropic", 4096), ("openai", 1024), ("gemini", 1024)]


@_query(_PREFIX + f""", po(policy, least) AS (VALUES {', '.join(map(str, _POLICIES))}),
q AS (SELECT p.*, policy, least FROM p CROSS JOIN po)
SELECT conv_id, policy, CASE WHEN policy = 'none' THEN 0 ELSE prefix_messages END AS prefix_messages, CASE WHEN policy = 'none' THEN 0 ELSE prefix_tokens END AS prefix_tokens, policy <> 'none' AND prefix_tokens >= least AS cacheable,
  CASE WHEN prefix_messages > 0 AND policy NOT IN ('none', 'anthropic') THEN 'prefix-s2:' || left(sha256(whole), 32) END AS content_key,
  CASE WHEN policy = 'none' OR prefix_messages = 0 OR prefix_tokens >= least THEN '' WHEN policy = 'gemini' THEN 'candidate prefix is ' || prefix_tokens || ' tokens; Gemini explicit-cache minimums are model-dependent (~' || least || '+)' ELSE 'stable prefix is ' || prefix_tokens || ' tokens; provider prompt caching typically engages around ' || least || '+' END AS notes FROM q""", (C,))
def cache_policies(spark, d):
    """The plans of all policies; the smallest prefix is that of one model."""
    rows, out = view(spark, d, CONVERSATIONS), None
    for policy, _ in _POLICIES:
        own = cache.plan(rows, policy, 1, "opus-4-5").select("conv_id", "policy", "prefix_messages", "prefix_tokens", "cacheable", "content_key", F.array_join("notes", ";").alias("notes"))
        out = own if out is None else out.unionByName(own)
    return out


@_query(", t AS (SELECT array_id, count(*) AS n FROM ei GROUP BY array_id) SELECT array_id, CASE array_id % 3 WHEN 0 THEN n WHEN 1 THEN n + 1 END AS item_count, CASE array_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_dict_array FROM t", (I,))
def json_arrays(spark, d):
    """Arrays of objects, mixed arrays, and texts that are no array."""
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda x: x["item"]), ",")
    kind = F.col("array_id") % 3
    rows = view(spark, d, EVENT_ITEMS).groupBy("array_id").agg(inner.alias("items"))
    text = F.when(kind == 0, F.concat(F.lit(" ["), "items", F.lit("]"))).when(kind == 1, F.concat(F.lit("["), "items", F.lit(", 1]"))).otherwise(F.concat(F.lit("["), "items"))
    return rows.select("array_id", detect_.json_array(text).alias("j")).select("array_id", F.col("j.item_count").cast("long").alias("item_count"), "j.is_dict_array")


@_query(f", t AS (SELECT conv_id, {_TOK} + 4 AS tok, coalesce(sum({_TOK} + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300 AS safe FROM am) SELECT conv_id, CAST(sum(tok) FILTER (safe) AS BIGINT) AS protected_tokens, count(*) FILTER (safe) AS protected FROM t GROUP BY conv_id", (A,))
def protected_reports(spark, d):
    out = compact(view(spark, d, AGENT_MESSAGES), CompactConfig(policy=agent.AgentPolicy(protected_tail_tokens=300)))
    return out.reports.select("conv_id", "protected_tokens", F.size("protected").cast("long").alias("protected"))


@_query(f", {_CLEARED}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM cl) SELECT conv_id, 'ok' AS status, CAST(count(*) FILTER (i < n) AS BIGINT) AS prefix_messages, 'prefix-s2:' || left(sha256(string_agg(role || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY turn) FILTER (i < n)), 32) AS content_key FROM x GROUP BY conv_id HAVING count(*) > 1", (A,))
def compact_plans(spark, d):
    """Status and cache plan of compacted conversations."""
    out = compact(view(spark, d, AGENT_MESSAGES), CompactConfig(cache_policy="openai"))
    return out.status.join(out.plans, "conv_id").where("content_key is not null").select("conv_id", "status", "prefix_messages", "content_key")


@_query("SELECT conv_id, turn, 'compression.reversible requested but ccr is disabled; reversible markers are disabled' AS warning FROM am", (A,))
def compact_warnings(spark, d):
    """Without a store nothing is cleared, and each conversation is warned."""
    rows = view(spark, d, AGENT_MESSAGES)
    out = compact(rows, CompactConfig(stored=False))
    same = out.messages.select("conv_id", F.col("idx").alias("turn"), "content").join(rows.select("conv_id", "turn", "content"), ["conv_id", "turn", "content"], "left_semi")
    return same.join(out.warnings, "conv_id").select("conv_id", "turn", "warning")


__all__ = ["ORACLES", "QUERIES", "kernels"]
