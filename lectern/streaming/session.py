"""Conversations as sessions: messages arrive in steps, each step is compacted.

What a fold leaves is final and pinned, so later steps don't touch it; the
ledger only grows.  :func:`replay` runs steps of a batch table, :func:`stream`
keeps a session's state in a stateful stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels
from ..operators.conversation import CompactConfig, Message, columns, compact_one, to_messages, tokens, total, uniquify

STEP = "step int, messages int, tokens long, new_folds int, fold_ids array<string>, evicted array<string>, error string"


@dataclass
class Session:
    """One conversation's state between steps."""

    messages: list[Message]
    fold_ids: list[str]
    originals: dict[str, str]
    step: int = 0

    def push(self, rows: list[Message]) -> None:
        self.messages += rows

    def compact(self, config: CompactConfig, max_final: int | None = None) -> dict:
        """One step; an error leaves the state as it was."""
        working = [replace(m, pinned=m.pinned or m.final) for m in self.messages]
        done = compact_one(working, config)
        report, self.step = done["report"], self.step + 1
        if report["error"]:
            return {"step": self.step, "messages": len(self.messages), "tokens": total(self.messages, config.model), "new_folds": 0, "fold_ids": [], "evicted": [], "error": report["error"]}
        new = uniquify(done["folds"], self.fold_ids)
        final = {f["replacement_index"] for f in new}
        now = [replace(m, origin=None, final=m.final or i in final) for i, m in enumerate(done["messages"])]
        self.originals |= done["originals"]
        now, evicted = self._retain(now, max_final)
        self.messages, self.fold_ids = now, self.fold_ids + [f["id"] for f in new]
        return {"step": self.step, "messages": len(now), "tokens": sum(tokens(m.content, config.model) + 4 for m in now), "new_folds": len(new), "fold_ids": [f["id"] for f in new], "evicted": evicted, "error": None}

    def _retain(self, now: list[Message], most: int | None) -> tuple[list[Message], list[str]]:
        """Only the newest final messages; originals that nothing refers to any more go."""
        final = [i for i, m in enumerate(now) if m.final]
        if most is None or len(final) <= most:
            return now, []
        out = set(final[: len(final) - most])
        kept = [m for i, m in enumerate(now) if i not in out]
        refers = lambda m: {m.ccr_id, *kernels.re.findall(r"(?s)<<ccr:(.*?)>>", m.content)} - {None}
        live = set().union(*map(refers, kept)) if kept else set()
        gone = sorted(set().union(*(refers(now[i]) for i in out)) - live)
        for id_ in gone:
            self.originals.pop(id_, None)
        return kept, gone

    def dump(self) -> str:
        return json.dumps({"messages": [asdict(m) for m in self.messages], "fold_ids": self.fold_ids, "originals": self.originals, "step": self.step}, ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Session:
        state = json.loads(text)
        return cls([Message(**m) for m in state["messages"]], state["fold_ids"], state["originals"], state["step"])


def replay(messages: DataFrame, config: CompactConfig, every: int = 10, max_final: int | None = None) -> DataFrame:
    """Push ``every`` messages at a time and compact: one row for each step of each conversation."""
    rows = columns(messages)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(key, table):
        own, session, steps = to_messages(table.to_pylist()), Session([], [], {}), []
        for k in range(0, len(own), every):
            session.push(own[k : k + every])
            steps.append(session.compact(config, max_final))
        types = {"step": pa.int32(), "messages": pa.int32(), "tokens": pa.int64(), "new_folds": pa.int32(), "fold_ids": pa.list_(pa.string()), "evicted": pa.list_(pa.string()), "error": pa.string()}
        return pa.table({"conv_id": pa.array([key[0].as_py()] * len(steps), table.schema.field("conv_id").type)} | {n: pa.array([s[n] for s in steps], t) for n, t in types.items()})

    return rows.groupBy("conv_id").applyInArrow(run, f"conv_id {kind}, {STEP}")


def stream(messages: DataFrame, config: CompactConfig, max_final: int | None = None) -> DataFrame:
    """The same over a stream: each micro-batch's messages of a conversation are one step."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = columns(messages)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session.load(state.get[0]) if state.exists else Session([], [], {})
        arrived = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
        session.push(to_messages(arrived))
        step = session.compact(config, max_final)
        state.update((session.dump(),))
        yield pd.DataFrame([{"conv_id": key[0], **step}])

    return rows.groupBy("conv_id").applyInPandasWithState(run, f"conv_id {kind}, {STEP}", "state string", "append", GroupStateTimeout.NoTimeout)


def retained(messages: DataFrame, max_final: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of messages with ``final``: only the newest final ones of a conversation stay."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id", "final").orderBy(F.desc("turn")))
    rows = messages.withColumn("_rank", rank)
    out = F.col("final") & (F.col("_rank") > max_final)
    return rows.where(~out).drop("_rank"), rows.where(out).drop("_rank")
