"""One conversation's budget cascade and fold ledger, in plain Python.

Each step depends on what the one before left, so a conversation is one state
machine; conversations are independent.  :func:`compact` runs it by ``conv_id``
in Arrow batches, :mod:`lectern.streaming.session` inside a stateful stream.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import focus as focus_
from ..sources.shared import materialise
from . import kernels
from .agent import ERROR_BYTES, ERROR_PATTERNS, TYPES, AgentPolicy

#: Fixed value: the warning where markers are wanted and nothing can be stored.
NO_STORE = "compression.reversible requested but ccr is disabled; reversible markers are disabled"
CONTEXT, SUMMARY = "[Earlier conversation context]", "[Earlier conversation summary]"


@dataclass(frozen=True)
class Message:
    role: str
    content: str
    tool_name: str | None = None
    tool_status: str | None = None
    pinned: bool = False
    ccr_id: str | None = None
    tag: str | None = None
    origin: int | None = None
    final: bool = False


@dataclass(frozen=True)
class CompactConfig:
    limit: int | None = None
    margin: float = 0.05
    model: str = ""
    question: str | None = None
    reversible: bool = True
    policy: AgentPolicy = field(default_factory=AgentPolicy)
    enabled: tuple[str, ...] = ("smart_crusher", "log_stripper", "ast_code", "semantic")
    #: Whether there is a store for originals; without one nothing is cleared or marked.
    stored: bool = True
    #: A summariser of one's own for old turns; where it fails, first sentences do.
    summarizer: Callable[[list[Message]], str] | None = None
    compressors: tuple = ()
    cache_policy: str = "none"
    cache_suffix: int = 1

    @property
    def marks(self) -> bool:
        return self.reversible and self.stored

    @property
    def warnings(self) -> list[str]:
        return [NO_STORE] if self.reversible and not self.stored else []


def _patterns(*parts: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in (x.replace("(?i)", "") for x in parts)))


_SEARCH, _DIFF_H, _DIFF_C = re.compile(D.SEARCH), re.compile(D.DIFF_HEADER), re.compile(D.DIFF_CHANGE)
_LOG = [re.compile(p) for p in D.LOG]
_CODE = {k: [re.compile(p) for p in v] for k, v in D.CODE.items()}
_HTML = [(re.compile(D.HTML_DOCTYPE), 0.5), (re.compile(D.HTML_HTML), 0.3), (re.compile(D.HTML_HEAD), 0.1), (re.compile(D.HTML_BODY), 0.1)]
_HTML_PART = re.compile(D.HTML_PART)


def detect(text: str) -> str:
    """The content type, by the rules of :func:`lectern.functions.detect.detect`."""
    own = text.strip()
    if not own:
        return "text"
    if own.startswith("["):
        try:
            if isinstance(json.loads(own), list):
                return "json_array"
        except ValueError:
            pass
    lines = text.split("\n")
    h = sum(bool(_DIFF_H.search(x)) for x in lines[: D.DIFF_LINES])
    c = sum(bool(_DIFF_C.search(x)) for x in lines[: D.DIFF_LINES])
    if h and min(1.0, 0.5 + 0.2 * h + 0.05 * c) >= D.LEAST["diff"]:
        return "diff"
    head = kernels.prefix(text, D.HTML_BYTES)
    found = [bool(p.search(head)) for p, _ in _HTML]
    parts = len(_HTML_PART.findall(head))
    total = sum(w for (_, w), f in zip(_HTML, found, strict=True) if f) + min(0.03 * parts, 0.3)
    if (found[0] or found[1] or parts >= 3) and total >= D.LEAST["html"]:
        return "html"
    filled = lambda rows: sum(bool(x.strip()) for x in rows) or 1
    rows = lines[: D.SEARCH_LINES]
    share = sum(bool(_SEARCH.search(x)) for x in rows if x.strip()) / filled(rows)
    if share >= 0.3 and min(1.0, 0.4 + 0.6 * share) >= D.LEAST["search"]:
        return "search"
    rows = lines[: D.LOG_LINES]
    first = [next((i for i, p in enumerate(_LOG) if p.search(x)), None) for x in rows]
    share = sum(i is not None for i in first) / filled(rows)
    if share >= 0.1 and min(1.0, 0.3 + 0.5 * share + 0.05 * sum(i is not None and i < 2 for i in first)) >= D.LEAST["build"]:
        return "build"
    rows = lines[: D.CODE_LINES]
    best = max(sum(any(p.search(x) for p in ps) for x in rows) for ps in _CODE.values())
    if best >= 3 and min(1.0, 0.4 + 0.4 * best / filled(rows) + 0.02 * best) >= D.LEAST["source_code"]:
        return "source_code"
    return "text"


def tokens(text: str, model: str = "") -> int:
    return max(1, math.ceil(len(text.encode()) / (3.5 if model.startswith("claude-") else 4.0)))


def total(messages: list[Message], model: str = "") -> int:
    return sum(tokens(m.content, model) + 4 for m in messages)


def kind(m: Message) -> str:
    if m.tag in TYPES:
        return m.tag
    if m.role in ("tool", "function"):
        head = kernels.prefix(m.content, ERROR_BYTES)
        return "tool_result_error" if m.tool_status == "error" or any(p in head for p in ERROR_PATTERNS) else "tool_result_success"
    return m.role if m.role in ("system", "user", "assistant") else "unknown"


def tail_mask(messages: list[Message], budget: int | None) -> list[bool]:
    out, running = [], 0
    for m in reversed(messages):
        out.append(bool(budget) and running < budget)
        running += tokens(m.content) + 4
    return out[::-1]


class Cascade:
    """The steps on one conversation; originals are gathered in ``saved``."""

    def __init__(self, config: CompactConfig):
        self.config, self.saved = config, {}
        self.focus = focus_.terms(config.question)
        self.steps: list[str] = []
        self.dropped: list[Message] = []

    def run(self, messages: list[Message]) -> tuple[list[Message], str | None]:
        """Messages within the budget, or an error and the messages as they were."""
        c = self.config
        if c.limit is None:
            return self.clear(messages), None
        limit = c.limit - math.ceil(c.limit * c.margin)
        fits = lambda m: total(m, c.model) <= limit
        now = messages
        for name, step in (("agent_rules", self.clear), ("compress_middle", self.middle), ("summarize_old", self.summarize), ("drop_old", lambda m: self.drop(m, limit))):
            if fits(now):
                return now, None
            before, now = now, step(now)
            if name != "drop_old" or len(now) < len(before):
                self.steps.append(name)
        return (now, None) if fits(now) else (messages, f"budget exceeded: needs {total(now, c.model)}, limit {limit}")

    def clear(self, messages: list[Message]) -> list[Message]:
        p = self.config.policy
        if not p.clear_stale or not self.config.marks:
            return messages
        tail, out, slots = tail_mask(messages, p.protected_tail_tokens), list(messages), 0
        for i in range(len(messages) - 1, -1, -1):
            m = messages[i]
            if kind(m) != "tool_result_success" or m.pinned:
                continue
            slots += 1
            if slots > p.keep_tool_results and not tail[i]:
                id_ = kernels.key(m.content)
                self.saved[id_] = m.content
                stub = f"[tool:{m.tool_name or 'unknown'}] result cleared ({tokens(m.content)} tokens) — original retrievable via {kernels.marker(id_)}"
                out[i] = replace(m, content=stub, ccr_id=id_, tag="tool_result_success")
        return out

    def compress(self, m: Message) -> Message:
        if m.pinned:
            return m
        kind_ = detect(m.content)
        own = {c.name: c.run for c in self.config.compressors}
        name = next((c.name for c in self.config.compressors if kind_ in c.content_types), D.ROUTES[kind_])
        if name not in self.config.enabled and name not in own:
            return m
        text, saved, _ = kernels.compress(name, m.content, self.focus, self.config.marks, own)
        if text == m.content:
            return m
        self.saved.update(saved)
        # the first original stays the one a marker leads to
        return replace(m, content=text, ccr_id=m.ccr_id or (saved[-1][0] if saved else None))

    def _recent(self, messages: list[Message]) -> int:
        p = self.config.policy
        at = [i for i, m in enumerate(messages) if kind(m) == "assistant"][-p.keep_recent_assistant :] if p.keep_recent_assistant else []
        return max(4, sum(tail_mask(messages, p.protected_tail_tokens)), len(messages) - at[0] if at else 0)

    def _bands(self, messages: list[Message], width: int) -> tuple[int, int]:
        """Starts of the middle and recent bands."""
        recent = max(0, len(messages) - self._recent(messages))
        start = max(0, recent - width)
        while start > 0 and messages[start].role in ("tool", "function"):
            start -= 1
        return next((i for i in range(start) if messages[i].pinned), start), recent

    def middle(self, messages: list[Message]) -> list[Message]:
        start, recent = self._bands(messages, len(messages))
        return [*messages[:start], *map(self.compress, messages[start:recent]), *messages[recent:]] if len(messages) > self._recent(messages) else messages

    def summarize(self, messages: list[Message]) -> list[Message]:
        if len(messages) <= self._recent(messages):
            return messages
        start, recent = self._bands(messages, 4)
        old = messages[:start]
        head = [Message("system", self._summary(old))] if old else []
        return [*map(self.compress, head + messages[start:recent]), *messages[recent:]]

    def _summary(self, old: list[Message]) -> str:
        if self.config.summarizer is not None:
            try:
                return f"{SUMMARY}\n{self.config.summarizer(old)}"
            except Exception:  # noqa: BLE001  whatever goes wrong, first sentences do
                pass
        return f"{CONTEXT}: {summarise(old)}"

    def drop(self, messages: list[Message], limit: int) -> list[Message]:
        """Oldest groups of a call and its results, in one pass.

        A tool row that follows a kept call once what stood between them has
        gone belongs to that call, and stays with it.
        """
        tail = tail_mask(messages, self.config.policy.protected_tail_tokens)
        user = max((i for i, m in enumerate(messages) if kind(m) == "user"), default=-1)
        free = [not (t or m.pinned or i == user or kind(m) in ("system", "tool_result_error")) for i, (m, t) in enumerate(zip(messages, tail, strict=True))]
        is_tool = [m.role in ("tool", "function") for m in messages]
        running, left, kept, i, after_call = total(messages, self.config.model), len(messages), [], 0, False
        while i < len(messages):
            end = i + 1
            if messages[i].role == "assistant":
                while end < len(messages) and is_tool[end]:
                    end += 1
            size = end - i
            if running > limit and left > 4 and all(free[i:end]) and left - size >= 4 and not (after_call and is_tool[i]):
                self.dropped += messages[i:end]
                running -= total(messages[i:end], self.config.model)
                left -= size
            else:
                kept += messages[i:end]
                after_call = messages[i].role == "assistant" or after_call and is_tool[i]
            i = end
        return kept


def summarise(turns: list[Message]) -> str:
    first = (re.split(r"[.!?]", m.content, maxsplit=1)[0].strip() for m in turns)
    text = " | ".join(x for x in first if x)
    return text if len(text.encode()) <= 800 else kernels.prefix(text, 800) + "…"


def folds(original: list[Message], now: list[Message], dropped: list[Message], model: str = "") -> list[dict]:
    """What became of each original message that isn't as it was."""
    out, present = [], set()
    head = next((i for i, m in enumerate(now) if m.origin is None and m.content.startswith((CONTEXT, SUMMARY))), None)
    stubs = {m.origin: m for m in dropped}

    def record(what: str, start: int, end: int, at: int | None, new: Message | None) -> dict:
        span = original[start:end]
        mark = re.search(r"(?s)<<ccr:(.*?)>>", new.content) if new else None
        ccr = new and (new.ccr_id or (mark and mark[1])) or None
        whole = "\n---\n".join(f"{m.role}\n{m.content}" for m in span)
        return {
            "id": ccr or "fold-" + kernels.key(whole), "kind": what, "start": start, "end": end, "replacement_index": at, "roles": [m.role for m in span],
            "original_tokens": sum(tokens(m.content, model) for m in span), "replacement_tokens": tokens(new.content, model) if new and at is not None else 0,
            "ccr_id": ccr, "marker": mark[0] if mark else None, "text": "\n".join(m.content for m in span),
        }

    for at, m in enumerate(now):
        if m.origin is None:
            continue
        present.add(m.origin)
        if m.content != original[m.origin].content or m.ccr_id != original[m.origin].ccr_id:
            cleared = m.ccr_id and m.content.startswith("[tool:") and " result cleared " in m.content
            out.append(record("cleared" if cleared else "compressed", m.origin, m.origin + 1, at, m))
    gone = [i for i in range(len(original)) if i not in present]
    if head is not None and gone:
        end = gone[0]
        while end < len(original) and end not in present:
            end += 1
        out.append(record("summarized", gone[0], end, head, now[head]))
        gone = [i for i in gone if i >= end]
    out += [record("dropped", i, i + 1, None, stubs.get(i)) for i in gone]
    return sorted(out, key=lambda f: (f["start"], math.inf if f["replacement_index"] is None else f["replacement_index"]))


def uniquify(new: list[dict], earlier: list[str]) -> list[dict]:
    """Ids that occur before get ``#2``, ``#3`` and so on."""
    counts: dict[str, int] = {}
    for id_ in earlier:
        base = id_.split("#")[0]
        counts[base] = counts.get(base, 0) + 1
    for f in new:
        counts[f["id"]] = n = counts.get(f["id"], 0) + 1
        if n > 1:
            f["id"] = f"{f['id']}#{n}"
    return new


def compact_one(messages: list[Message], config: CompactConfig) -> dict:
    """All results of one conversation; on an error the messages as they were."""
    own = [replace(m, origin=i) for i, m in enumerate(messages)]
    cascade = Cascade(config)
    now, error = cascade.run(own)
    tail = tail_mask(messages, config.policy.protected_tail_tokens)
    report = {
        "tokens_initial": total(own, config.model), "tokens_final": total(now, config.model), "steps": cascade.steps, "error": error, "messages": len(now),
        "dropped": 0 if error else len(cascade.dropped), "protected_tokens": sum(tokens(m.content, config.model) + 4 for m, t in zip(messages, tail, strict=True) if t), "protected": [i for i, t in enumerate(tail) if t],
    }
    done = [] if error else folds(own, now, cascade.dropped, config.model)
    return {"messages": now, "folds": uniquify(done, []), "report": report, "originals": {} if error else cascade.saved}


MESSAGE = "role string, content string, tool_name string, tool_status string, pinned boolean, ccr_id string, tag string, origin int, final boolean"
FOLD = "id string, kind string, start int, end int, replacement_index int, roles array<string>, original_tokens long, replacement_tokens long, ccr_id string, marker string, text string"
REPORT = "tokens_initial long, tokens_final long, steps array<string>, error string, messages int, dropped int, protected_tokens long, protected array<int>"


@dataclass
class CompactResult:
    messages: DataFrame
    folds: DataFrame
    reports: DataFrame
    originals: DataFrame
    plans: DataFrame
    warnings: DataFrame
    status: DataFrame


def columns(messages: DataFrame) -> DataFrame:
    for name, type_ in (("tool_name", "string"), ("tool_status", "string"), ("pinned", "boolean"), ("ccr_id", "string"), ("tag", "string")):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(type_))
    return messages.select("conv_id", "turn", "role", "content", "tool_name", "tool_status", "pinned", "ccr_id", "tag")


def to_messages(rows: list[dict]) -> list[Message]:
    rows = sorted(rows, key=lambda r: r["turn"])
    return [Message(r["role"] or "", r["content"] or "", r["tool_name"], r["tool_status"], bool(r["pinned"]), r["ccr_id"], r["tag"]) for r in rows]


def compact(messages: DataFrame, config: CompactConfig = CompactConfig()) -> CompactResult:
    """Compact every conversation; one shuffle by ``conv_id``, one pass, results in one written table."""
    rows = columns(messages)
    kind_ = rows.schema["conv_id"].dataType.simpleString()

    def run(key, table):
        out = compact_one(to_messages(table.to_pylist()), config)
        body = [("message", i, asdict(m)) for i, m in enumerate(out["messages"])] + [("fold", i, f) for i, f in enumerate(out["folds"])]
        body += [("report", 0, out["report"])] + [("original", i, {"id": k, "original": v}) for i, (k, v) in enumerate(sorted(out["originals"].items()))]
        n = len(body)
        return pa.table({"conv_id": pa.array([key[0].as_py()] * n, table.schema.field("conv_id").type), "what": [b[0] for b in body], "seq": pa.array([b[1] for b in body], pa.int32()), "body": [json.dumps(b[2], ensure_ascii=False) for b in body]})

    done = materialise(rows.groupBy("conv_id").applyInArrow(run, f"conv_id {kind_}, what string, seq int, body string"), "compact")
    from .cache import plan

    part = lambda what, schema: done.where(F.col("what") == what).select("conv_id", "seq", F.from_json("body", schema).alias("b")).select("conv_id", F.col("seq").alias("idx"), "b.*")
    now, reports = part("message", MESSAGE), part("report", REPORT).drop("idx")
    plans = plan(now.select("conv_id", F.col("idx").alias("turn"), "role", "content"), config.cache_policy, config.cache_suffix, config.model)
    warned = reports.select("conv_id", F.explode(F.array(*map(F.lit, config.warnings)).cast("array<string>")).alias("warning"))
    status = reports.select("conv_id", F.when(F.col("error").isNull(), "ok").otherwise("budget_exceeded").alias("status"), "error")
    return CompactResult(now, part("fold", FOLD), reports, part("original", "id string, original string").drop("idx", "conv_id").dropDuplicates(["id"]), plans, warned, status)
