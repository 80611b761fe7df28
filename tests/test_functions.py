"""Column functions against plain Python."""

import base64
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import detect, focus, keys, text, tokens
from lectern.operators import agent, conversation, kernels, logs, recall, series, sizer, tags
from lectern.plans import extensions, pipeline
from lectern.sources import shared, store

ODD = ["", " ", "a" * 3000, "\x00\x01", "[1, 2", '[{"a": 1}]', "[]", '{"a": 1}', "😀é日本" * 300, "a\r\nb\rc\n", "<html><body><div>", "Error: x", "x\n\n\nx", "diff --git a b\n--- a/x\n+y\n-z\n+w", "INFO a\nERROR b", "def f():\n  pass\nclass A:\nimport os"]


def column(spark, values, expr):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in frame.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize("limit", [4, 5, 6, 7, 800])
def test_prefix_ends_between_characters(spark, limit):
    assert column(spark, ODD, lambda c: text.prefix(c, limit)) == [kernels.prefix(v, limit) for v in ODD]


def test_keys_markers_and_tokens(spark):
    assert column(spark, ODD, keys.key) == [kernels.key(v) for v in ODD]
    assert column(spark, ODD, tokens.estimate) == [conversation.tokens(v) for v in ODD]
    assert column(spark, ODD, lambda c: tokens.estimate(c, "claude-x")) == [conversation.tokens(v, "claude-x") for v in ODD]
    assert column(spark, ["a <<ccr:x>> b <<ccr:y\nz>> <<ccr:", "none"], keys.referenced) == [["x", "y\nz"], []]
    assert column(spark, [" <<ccr:k>> ", "k"], keys.requested) == ["k", "k"]


def test_detection_agrees_with_the_kernel(spark):
    rng = random.Random(4)
    made = ["\n".join(rng.choice(ODD[8:] + ["INFO x", "src/a.py:3: y", "fn main() {", "2024-01-01 z", "use x;", "@@ -1,2 +1,2 @@", "<div>", "plain"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    values = ODD + made
    assert column(spark, values, lambda c: detect.detect(c)["content_type"]) == [conversation.detect(v) for v in values]


def test_classification_agrees_with_the_kernel(spark):
    rows = [(r, c, s, t) for r in ("system", "user", "assistant", "tool", "function", "other") for c in ("fine", "x" * 520 + "Error:", "stderr: y") for s in (None, "error", "success") for t in (None, "user", "nonsense")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, role string, content string, status string, tag string")
    got = [r[0] for r in frame.select("i", agent.classify(F.col("role"), F.col("content"), F.col("status"), F.col("tag")).alias("o")).orderBy("i").select("o").collect()]
    assert got == [conversation.kind(conversation.Message(r, c, tool_status=s, tag=t)) for r, c, s, t in rows]


def test_focus():
    assert focus.terms("Where is the Login-bug in auth.rs? a") == ["auth", "bug", "login", "rs"]
    assert focus.terms(None) == []


def test_log_levels_and_summaries(spark):
    values = ["ERROR a", "failed b", "warn c", "info d", "debug", "trace", "x", "=== a", "3 passed in 2s", "Tests: 4", "Test: x", "Total 3", "Build succeeded", "Test run complete", "Suite  9", "errorless"]
    assert column(spark, values, logs.level) == [kernels.level(v) for v in values]
    assert column(spark, values, logs.is_summary) == [kernels.is_summary(v) for v in values]
    warnings = ["WARN a: id=12 at /tmp/x9", "WARN b = 0xfF", "WARN"]
    assert column(spark, warnings, logs.similar) == [kernels.similar(v) for v in warnings]


def test_simhash_and_sizes(spark):
    values = ["", "abc", "abcd", "the quick brown fox", "日本語テキスト"]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert column(spark, values, series.simhash) == [signed(sizer.simhash(v)) for v in values]
    assert sizer.optimal_k([f"row {i}" for i in range(8)]) == 8
    assert 3 <= sizer.optimal_k([f"row {i} of {i % 7} things" for i in range(60)], 1.0, 3, 15) <= 15


def test_number_format(spark):
    values = [0.0, 1.0, 12.5, 1234.5678, 12345.678, 0.00012346, 0.000012346, -3.14159, 99999.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in frame.select("i", series.format_g(F.col("v")).alias("o")).orderBy("i").select("o").collect()]
    assert got == [f"{v:.4g}" for v in values]


def test_terms(spark):
    values = ["src/auth/loginForm.rs failed: (JWT) x", "HTTPServer2Go a.b-c_d\\e", "", "  ..  ", "Ünïcode camelÉcole"]
    for v, got in zip(values, column(spark, values, recall.terms), strict=True):
        assert set(recall.query_terms(v)) == set(got)


def test_paths(spark):
    values = ["see src/auth/login.rs, Cargo.toml and 1.2.3 e.g U.S.A", "a/b.unknownext x/y.toolongextension (lib.PY)", ".rs"]
    assert column(spark, values, tags.paths) == [["src/auth/login.rs", "Cargo.toml"], ["a/b.unknownext", "lib.PY"], []]


def test_payload_codec(spark):
    frame = spark.createDataFrame([(bytearray(b"text"),), (bytearray(b"\xff\x00"),)], "d binary")
    coded = frame.select(store.encode_payload(F.col("d"), F.lit("a/b"), F.create_map(F.lit("k"), F.lit("v"))).alias("c"))
    back = [r[0] for r in coded.select(store.decode_payload(F.col("c"))).collect()]
    assert [(bytes(b.data), b.media_type, b.metadata) for b in back] == [(b"text", "a/b", {"k": "v"}), (b"\xff\x00", "a/b", {"k": "v"})]
    plain = column(spark, ["not json", '{"payload": 2}'], lambda c: store.decode_payload(c)["data"].cast("string"))
    assert plain == ["not json", '{"payload": 2}']


def test_store(spark):
    rows = spark.createDataFrame([("a", "1", 10, None), ("b", "2", 20, 5), ("a", "3", 30, None)], "id string, original string, t long, ttl_seconds long")
    table = rows.withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    merged = store.save(table.limit(2), table.where("original = '3'"))
    assert sorted((r.id, r.original) for r in merged.collect()) == [("a", "3"), ("b", "2")]
    assert [r.id for r in store.live(merged, F.timestamp_seconds(F.lit(26))).collect()] == ["a"]
    asked = spark.createDataFrame([("<<ccr:a>>",), ("zz",)], "request string")
    assert sorted(r.original for r in store.retrieve(asked, "request", merged).collect()) == ["3", "[no content stored for zz]"]
    assert [r.id for r in store.within_capacity(merged, 1).collect()] == ["a"]
    assert store.EngineConfig.from_env({"LECTERN_TTL": "7"}).ttl_seconds == 7
    with pytest.raises(ValueError):
        store.EngineConfig.from_env({"LECTERN_TTL": "x"})


def test_table_store(spark, tmp_path):
    """Versions of a folder: saved, replaced, bounded, deleted, expired."""
    own = store.EngineConfig.from_env({"LECTERN_ORIGINALS": str(tmp_path / "o"), "LECTERN_CAPACITY": "2", "LECTERN_TTL": "50"}).open(spark)
    at = lambda rows, t: store.entries(spark.createDataFrame(rows, "id string, original string"), "id", "original", 50).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp() + t))
    own.save(at([("a", "1")], -3))
    own.save(at([("b", "2")], -2))
    own.save(at([("a", "3")], -1))
    assert {(r.id, r.original) for r in own.table().collect()} == {("a", "3"), ("b", "2")}  # saving again refreshes a
    own.save(at([("c", "4")], 0))
    assert {r.id for r in own.table().collect()} == {"a", "c"}
    own.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r.original for r in own.retrieve(spark.createDataFrame([("<<ccr:c>>",)], "q string"), "q").collect()] == ["4"]
    assert own.table(F.timestamp_seconds(F.unix_timestamp() + 100)).count() == 0 and len(list((tmp_path / "o").iterdir())) <= 2
    with pytest.raises(ValueError):
        store.EngineConfig().open(spark)


def test_compressors_of_ones_own(spark):
    rows = spark.createDataFrame([(1, 0, "plain words"), (1, 1, '[{"a": 1}]')], "conv_id long, turn int, content string")
    own = extensions.Compressor("upper", lambda text, focus, reversible: (text.upper(), []), ("text",))
    done = extensions.Pipeline().add_compressor(own).add_step(lambda df: df.where("turn >= 0")).with_options(reversible=False).run(rows)
    assert {r.turn: (r.compressor, r.content) for r in done.messages.collect()} == {0: ("upper", "PLAIN WORDS"), 1: ("smart_crusher", '[{"a":1}]')}
    assert pipeline.CompressConfig(enabled=("dedup_ref", "upper"), compressors=(own,)).enabled[0] == "dedup_ref"
    bad = extensions.Compressor("bad", lambda *a: 1 / 0, ("text",))
    kept = extensions.Pipeline().add_compressor(bad).run(rows).messages.where("turn = 0").first()
    assert kept.content == "plain words" and "ZeroDivisionError" in kept.failed


def test_dedup_kernel_keeps_what_it_saw():
    para, seen = "p" * 60, set()
    text = f"{para}\n\nother\n\n{para}\n\n{para}"
    out, saved = kernels.dedup_ref(text, seen=seen)
    assert out == f"{para}\n\nother\n{kernels.marker(kernels.key(para))}" and saved[0] == (kernels.key(para), para)
    assert kernels.dedup_ref(para, seen=seen)[0] == "\n[dedup: 60 bytes of repeated content]"


def test_token_counters(spark):
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257}
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/own.tiktoken"
        with open(path, "wb") as f:
            f.writelines(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())
        library = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        own = {"o200k": (path, r"\S+|\s+")}
        exact, proxy = extensions.counter_for("gpt-4o-mini", own), extensions.counter_for("claude-x", own)
        want = [max(1, len(library.encode_ordinary(v))) for v in ODD]
        assert column(spark, ODD, exact.column) == want == [exact.count(v) for v in ODD] and exact.kind() == ("exact", None, 0.0)
        assert column(spark, ODD, proxy.column) == [proxy.count(v) for v in ODD] and proxy.kind()[0] == "estimated"
    assert extensions.counter_for("gpt-4") == extensions.Estimate("gpt-4")
    assert column(spark, ODD, extensions.Estimate("claude-x").column) == [extensions.Estimate("claude-x").count(v) for v in ODD]


def test_alignment(spark):
    values = [*ODD, ' {"b": 1.0, "a": [2.50, 1e3]} ', "null", "nullify  x", "-", "12 x", '"q"']
    assert column(spark, values, pipeline.align_text) == [kernels.align(v) for v in values]


def test_shared_folder(spark):
    path = shared.shared_dir(spark)
    table = shared.materialise(spark.range(3).toDF("n"), "t")
    assert table.count() == 3 and path != shared.shared_dir(spark) and shared.clean(spark) >= 1


def test_unknown_compressor_is_an_error():
    with pytest.raises(ValueError):
        pipeline.CompressConfig(enabled=("nope",))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.sampled_from(sorted(kernels.COMPRESSORS)))
def test_kernels_fail_closed(value, name):
    out, saved, error = kernels.compress(name, value)
    assert kernels.compress(name, value) == (out, saved, error)
    if error:
        assert out == value and not saved
    assert all(k == kernels.key(v) for k, v in saved)


def test_bigram_curve_and_knee(spark):
    """Blank and null items count once as the empty word; of equal heights the first is the knee."""

    def curve(items):
        seen, out = set(), []
        for item in items:
            words = (item or "").lower().split()
            seen |= set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(words[0] if words else "", "")}
            out.append(len(seen))
        return out

    def turn(ys):
        if len(ys) < 3 or ys[0] == ys[-1]:
            return None if len(ys) < 3 else 1
        high = [(y - ys[0]) / (ys[-1] - ys[0]) - i / (len(ys) - 1) for i, y in enumerate(ys)]
        return high.index(max(high)) + 1 if max(high) >= 0.05 else None

    rng = random.Random(23)
    some = ["", "  ", None, "a", "A b", "a b c", "b c", "c  d\te f", "g", "a b a b"]
    lists = [[rng.choice(some) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    frame = spark.createDataFrame([(k, i, x) for k, items in enumerate(lists) for i, x in enumerate(items)], "id int, idx int, text string")
    rows = series.bigram_curve(frame, "id", "idx", "text")
    got = {k: [] for k in range(len(lists))}
    for r in rows.orderBy("id", "idx").collect():
        got[r.id].append(r.distinct)
    assert got == {k: curve(items) for k, items in enumerate(lists)}
    assert got == {k: sizer.bigram_curve([x or "" for x in items]) for k, items in enumerate(lists)}
    assert {r.id: r.knee for r in series.knee(rows, "id", "idx", "distinct").collect()} == {k: turn(curve(items)) for k, items in enumerate(lists)}


def test_traces_of_whole_texts(spark):
    rows = [(1, "INFO a\nTraceback (most recent call last):\n  File \"a.py\", line 3, in run\nValueError: bad\n\nINFO b"), (2, "no trace"), (3, ""), (4, None), (5, "x" * 5_000_000)]
    got = {r.id: r.traces for r in logs.traces(spark.createDataFrame(rows, "id int, text string"), "text").select("id", "traces").collect()}
    assert got == {1: [i for i, f in enumerate(kernels.trace_flags(rows[0][1].split("\n"))) if f], 2: [], 3: [], 4: [], 5: []} and got[1][:2] == [1, 2]
