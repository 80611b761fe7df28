"""The budget cascade, folds and sessions."""

import json
import random

from pyspark.sql import functions as F

from lectern.operators import agent, conversation, kernels, series
from lectern.operators.conversation import Cascade, CompactConfig, Message, compact, compact_one, kind, tail_mask, total
from lectern.streaming import session


def history(rng, n):
    roles = ["user", "assistant", "tool", "tool", "assistant", "system"]
    return [Message(rng.choice(roles), "x" * rng.randrange(1, 200) if rng.random() < 0.8 else "Error: y", tool_name="t", pinned=rng.random() < 0.1) for _ in range(n)]


def naive_drop(messages, limit, tail_budget=None):
    """The loop as it is defined: look again from the start after each group that goes."""
    now = list(messages)
    while total(now) > limit and len(now) > 4:
        tail = tail_mask(now, tail_budget)
        user = max((i for i, m in enumerate(now) if kind(m) == "user"), default=-1)
        free = [not (t or m.pinned or i == user or kind(m) in ("system", "tool_result_error")) for i, (m, t) in enumerate(zip(now, tail, strict=True))]
        i, group = 0, None
        while i < len(now):
            end = i + 1
            if now[i].role == "assistant":
                while end < len(now) and now[end].role in ("tool", "function"):
                    end += 1
            if all(free[i:end]) and len(now) - (end - i) >= 4:
                group = (i, end)
                break
            i = end
        if group is None:
            break
        del now[group[0] : group[1]]
    return now


def test_one_pass_drop_equals_the_loop():
    rng = random.Random(11)
    for _ in range(3000):
        messages = history(rng, rng.randrange(0, 25))
        limit, tail = rng.randrange(10, 900), rng.choice([None, 60])
        cascade = Cascade(CompactConfig(policy=agent.AgentPolicy(protected_tail_tokens=tail)))
        assert cascade.drop(messages, limit) == naive_drop(messages, limit, tail)


def test_summarizer_of_ones_own():
    """Its text heads the history; where it fails, first sentences do."""
    rng = random.Random(5)
    messages = [Message(rng.choice(["user", "assistant"]), f"Turn {k}. More.") for k in range(30)]
    config = CompactConfig(limit=120, summarizer=lambda old: f"{len(old)} turns")
    head = compact_one(messages, config)["messages"][0]
    assert head.content.startswith(conversation.SUMMARY + "\n") and head.content.endswith("turns")
    failing = compact_one(messages, CompactConfig(limit=120, summarizer=lambda old: 1 / 0))["messages"][0]
    assert failing.content.startswith(conversation.CONTEXT + ": Turn 0")


def test_budget_is_met_or_nothing_changes():
    rng = random.Random(12)
    for _ in range(300):
        messages = history(rng, rng.randrange(1, 40))
        config = CompactConfig(limit=rng.randrange(50, 1500))
        out = compact_one(messages, config)
        if out["report"]["error"]:
            assert [(m.role, m.content) for m in out["messages"]] == [(m.role, m.content) for m in messages] and not out["folds"]
        else:
            assert total(out["messages"]) <= config.limit - -(-config.limit * 5 // 100)
        pinned = {m.content for m in messages if m.pinned}
        assert pinned <= {m.content for m in out["messages"]}
        for f in out["folds"]:
            if f["kind"] == "cleared":
                assert out["originals"][f["ccr_id"].split("#")[0]] == messages[f["start"]].content


def test_every_message_is_kept_or_folded():
    rng = random.Random(13)
    for _ in range(200):
        messages = history(rng, 30)
        out = compact_one(messages, CompactConfig(limit=700))
        if not out["report"]["error"]:
            folded = {i for f in out["folds"] for i in range(f["start"], f["end"])}
            same = {m.origin for m in out["messages"] if m.origin is not None and m.content == messages[m.origin].content}
            assert folded | same >= set(range(30))


def test_clearing_by_windows_equals_the_kernel(spark):
    rng = random.Random(14)
    rows, want = [], []
    for conv in range(12):
        messages = history(rng, 25)
        rows += [(conv, t, m.role, m.content, m.tool_name, m.tool_status, m.pinned) for t, m in enumerate(messages)]
        cleared = Cascade(CompactConfig(policy=agent.AgentPolicy(protected_tail_tokens=90))).clear(messages)
        want += [(conv, t, m.content) for t, m in enumerate(cleared)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, content string, tool_name string, tool_status string, pinned boolean")
    policy = agent.AgentPolicy(protected_tail_tokens=90)
    for parts in (1, 8):
        got = agent.clear_tool_results(frame.repartition(parts), policy).select("conv_id", "turn", "content").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    result = compact(frame, CompactConfig(policy=policy))
    marked = result.messages.where("ccr_id is not null").select(F.col("ccr_id").alias("id")).distinct()
    assert marked.join(result.originals, "id", "left_anti").count() == 0


def test_samples_equal_the_kernel(spark):
    rng = random.Random(15)
    items = [{"id": i, "v": "z" * rng.randrange(40)} for i in range(50)]
    texts = [kernels.compact_json(x) for x in items]
    frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "a int, i int, t string")
    kept = [json.loads(r.t) for r in series.sample_records(frame, "a", "i", "t", 15).where("kept").orderBy("i").collect()]
    saved = []
    assert kernels.crush_records(items, 1.0, [], saved)[:-1] == kept and json.loads(saved[0][1]) == items
    numbers = [rng.gauss(0, 1) for _ in range(40)] + [50.0]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(numbers)], "a int, i int, v double")
    assert {r.i for r in series.outliers(frame, "a", "v").where("outlier").collect()} == kernels.outliers(numbers)
    assert {r.i for r in series.change_points(frame, "a", "i", "v").where("change").collect()} == kernels.change_points(numbers)


def test_session_never_touches_final_messages():
    rng = random.Random(16)
    s = session.Session([], [], {})
    config = CompactConfig(limit=900)
    final: list[str] = []
    for _ in range(8):
        s.push(history(rng, 12))
        step = s.compact(config, max_final=None)
        assert step["tokens"] <= 900 or step["error"]
        now = [m.content for m in s.messages if m.final]
        assert [x for x in final if x in now] == final
        final = now
        assert session.Session.load(s.dump()) == s
    assert len(s.fold_ids) == len(set(s.fold_ids))


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(17)
    rows = [(c, t, m.role, m.content, m.tool_name, m.tool_status, m.pinned) for c in range(3) for t, m in enumerate(history(rng, 20))]
    schema = "conv_id long, turn int, role string, content string, tool_name string, tool_status string, pinned boolean"
    config = CompactConfig(limit=800)
    frame = spark.createDataFrame(rows, schema)
    want = session.replay(frame, config, every=10).select("conv_id", "step", "messages", "tokens", "new_folds").collect()
    for k in (0, 1):
        frame.where(f"turn div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = session.stream(source, config).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("conv_id", "step", "messages", "tokens", "new_folds").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_folds_of_a_summary():
    messages = [Message("user", f"topic {i}. More words follow here {'y' * 120}") for i in range(30)]
    out = compact_one(messages, CompactConfig(limit=800))
    kinds = {f["kind"] for f in out["folds"]}
    assert out["report"]["error"] is None and ("summarized" in kinds or "dropped" in kinds)
    assert out["messages"][-1].content == messages[-1].content


def test_conversation_module_names_are_public():
    assert conversation.compact is compact
