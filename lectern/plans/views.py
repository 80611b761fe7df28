"""Views over the base tables: the same SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AGENT_MESSAGES = """
SELECT conv_id, turn,
  CASE WHEN turn = 0 THEN 'system' WHEN event_type = 'view' THEN 'user'
       WHEN event_type = 'click' THEN 'assistant' ELSE 'tool' END AS role,
  CASE WHEN turn = 0 THEN 'You are a helpful agent.'
       WHEN event_type = 'view' THEN concat('Please check item ', CAST(event_id AS STRING), '. Then report.')
       WHEN event_type = 'click' AND event_id % 5 = 0 THEN concat('Decision: keep plan ', CAST(event_id % 11 AS STRING))
       WHEN event_type = 'click' AND event_id % 5 = 1 THEN concat('TODO: retry job ', CAST(event_id % 13 AS STRING))
       WHEN event_type = 'click' THEN concat('Looking at src/m', CAST(event_id % 7 AS STRING), '/lib.rs now')
       WHEN event_type = 'error' AND event_id % 3 <> 0 THEN concat('Error: request ', CAST(event_id AS STRING), ' failed in src/m', CAST(event_id % 7 AS STRING), '/job.py')
       WHEN event_type = 'error' THEN concat('request ', CAST(event_id AS STRING), ' returned nothing')
       ELSE concat('row ', CAST(event_id AS STRING), ' ', props, ' ', repeat('ok ', CAST(event_id % 120 AS INT))) END AS content,
  CASE WHEN turn > 0 AND event_type IN ('error', 'purchase', 'signup') THEN event_type END AS tool_name,
  CASE WHEN turn > 0 AND event_type = 'error' AND event_id % 2 = 0 THEN 'error'
       WHEN turn > 0 AND event_type IN ('error', 'purchase', 'signup') THEN 'success' END AS tool_status,
  (turn > 0 AND event_id % 37 = 0) AS pinned
FROM (SELECT user_id AS conv_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS turn, event_id, event_type, props FROM {events}) e
"""

LOG_LINES = """
SELECT user_id AS log_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS line_no,
  CASE WHEN event_id % 97 = 0 THEN concat('=== summary ', CAST(event_id % 9 AS STRING), ' ===')
       WHEN event_type = 'error' THEN concat('ERROR worker: request ', CAST(event_id AS STRING), ' gave up')
       WHEN event_type = 'signup' AND event_id % 2 = 0 THEN concat('FAIL check ', CAST(event_id % 5 AS STRING))
       WHEN event_type = 'purchase' THEN concat('WARN cache: slow path id=', CAST(event_id % 17 AS STRING))
       WHEN event_type = 'click' THEN concat('DEBUG step ', CAST(event_id AS STRING))
       ELSE concat('INFO worker: batch ', CAST(event_id AS STRING)) END AS line
FROM {events}
"""

EVENT_VALUES = """
SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS idx, value FROM {events}
"""

EVENT_ITEMS = """
SELECT user_id AS array_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS idx,
  concat('{{"id":', CAST(event_id AS STRING), ',"note":"', repeat('n', CAST(event_id % 23 AS INT)), '","type":"', event_type, '"}}') AS item
FROM {events}
"""

#: Lines of a document as its paragraphs, in a bounded text for each document.
PARAGRAPHS = """
SELECT text_id, CAST(pos AS INT) AS pos, para FROM (SELECT doc_id AS text_id, posexplode(split(coalesce(text, ''), '\\n')) AS (pos, para) FROM {documents}) p
"""
PARAGRAPHS_SQL = """
SELECT text_id, CAST(k - 1 AS INT) AS pos, ls[k] AS para FROM (SELECT doc_id AS text_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}) a) b
"""

CONVERSATIONS = """
SELECT conv_id, CAST(turn AS INT) AS turn, role, coalesce(text, '') AS content FROM {conversations}
"""

PAYLOADS = """
SELECT * FROM (
  SELECT CAST(1 AS INT) AS payload_id, concat('diff --git a/x b/x', chr(10), '--- a/x', chr(10), '+++ b/x', chr(10), '@@ -1,3 +1,4 @@', chr(10), '-old line', chr(10), '+new line') AS content
  UNION ALL SELECT 2, concat('src/a.py:10: hit one', chr(10), 'src/b.py:22: hit two', chr(10), 'src/c.py:7: hit three')
  UNION ALL SELECT 3, concat('INFO start', chr(10), 'WARN slow', chr(10), 'ERROR bad', chr(10), 'DEBUG more', chr(10), 'INFO end')
  UNION ALL SELECT 4, concat('import os', chr(10), 'def f(x):', chr(10), '    # comment', chr(10), '    return x', chr(10), 'class A:', chr(10), '    pass')
  UNION ALL SELECT 5, '[1, 2, 3]'
  UNION ALL SELECT 6, '[{{"a": 1}}, {{"a": 2}}]'
  UNION ALL SELECT 7, '   '
  UNION ALL SELECT 8, 'plain words only'
  UNION ALL SELECT 9, '<!DOCTYPE html><html><body><div>x</div></body></html>'
  UNION ALL SELECT 10, concat('fn main() {{', chr(10), '  // note', chr(10), 'use std::io;', chr(10), 'pub struct S;', chr(10), '#[derive]', chr(10), '}}')
) p
"""

_TRACED = """
  UNION ALL SELECT {id}, concat('INFO job started', chr(10), 'ERROR job failed', chr(10), {lines}, chr(10), 'INFO job ended')"""
_TRACES = [
    ["Traceback (most recent call last):", '  File "a.py", line 3, in run', "ValueError: bad"],
    ["TypeError: x is not a function", "    at run (/srv/a.js:3:7)", "    at main (/srv/b.js:9:1)"],
    ["java.lang.IllegalStateException: bad", "    at com.acme.Job.run(Job.java:42)", "    at com.acme.Main.main(Main.java:7)"],
    ["thread main panicked", "  --> src/main.rs:3:5", "  --> src/job.rs:9:1"],
    ["goroutine 1 [running]:", "  1: 0x45d1a0 main.run", "  2: 0x45d2b4 main.main"],
]
#: Languages and trace flavours that ``PAYLOADS`` doesn't have.
MORE_PAYLOADS = (
    """
  SELECT 11 AS payload_id, concat('import fs from "fs";', chr(10), 'const x = 1;', chr(10), 'function f() {{', chr(10), '  // note', chr(10), '  return x;', chr(10), '}}') AS content
  UNION ALL SELECT 12, concat('interface A {{', chr(10), '  x: number;', chr(10), '}}', chr(10), 'type B = string;', chr(10), 'enum C {{ D }}', chr(10), 'namespace E {{}}')
  UNION ALL SELECT 13, concat('package main', chr(10), 'import "fmt"', chr(10), 'func (s S) Run() {{', chr(10), '  // note', chr(10), '}}', chr(10), 'type S struct{{}}')
  UNION ALL SELECT 14, concat('package com.acme;', chr(10), 'public class A {{', chr(10), '  @Override', chr(10), '  // note', chr(10), '}}', chr(10), 'private interface B {{}}')"""
    + "".join(_TRACED.format(id=15 + k, lines=", chr(10), ".join(f"'{x}'" for x in t)) for k, t in enumerate(_TRACES))
)

#: All literals, and every row of three tables.
TABLE_PAYLOADS = f"""
SELECT 'literal' AS source, CAST(payload_id AS BIGINT) AS payload_id, content FROM ({PAYLOADS} UNION ALL {MORE_PAYLOADS}) x
UNION ALL SELECT 'pages', CAST(page_id AS BIGINT), coalesce(html, '') FROM {{pages}}
UNION ALL SELECT 'documents', CAST(doc_id AS BIGINT), coalesce(text, '') FROM {{documents}}
UNION ALL SELECT 'event_items', CAST(array_id AS BIGINT), concat('[', array_join(transform(array_sort(collect_list(struct(idx, item))), x -> x.item), ','), ']')
  FROM ({EVENT_ITEMS}) i GROUP BY array_id
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view on Spark."""
    tables = [t for t in ("events", "documents", "conversations", "pages") if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}) if tables else spark.sql(sql.replace("{{", "{").replace("}}", "}"))


def cte(name: str, sql: str) -> str:
    """The view as a common table expression over tables of their own names."""
    return f"{name} AS ({sql.format(events='events', documents='documents', conversations='conversations')})"
