"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant messages in turn, the last one an assistant's.
Each turn may keep its role or take another (``RELABEL``; ``UNKNOWN`` if its own is none of the three), may be merged into a message
of its role just before (``MERGE``), and empty messages may be inserted before it or at the end (``INSERT`` each). Dynamic programming
over the states *nothing yet, system, user, assistant* finds the cheapest repair; of equally cheap ones it goes, from the end, to
the lowest state that can come before.

A long conversation is never gathered: rows are dealt out by ranges of conversation and turn, so each task holds runs of
consecutive turns. A run gives a 4 x 4 matrix of least costs from state to state; the matrices of the runs of a conversation are
multiplied (min, +) in order, which gives the costs at each run's start; each run then tells which state before it every state
behind it leads back to; following these from the end gives the state at each run's end, and every run is traced back on its own.
Only conversations of several runs take part in the scans, with one small row per run.

``render`` gives one text per turn: joined in order they are the whole conversation. Null and unknown roles cost ``UNKNOWN``
whatever they become; null texts are empty; turns are ordered by number (null first), then role and text; null conversation
ids are one conversation; repeated rows are turns of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import spread
from sessionlens.session import stage

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
RELABEL, UNKNOWN, MERGE, INSERT = 2.0, 1.0, 1.0, 3.0
INF = float("inf")
#: What stands between state (row) and message (column): cost, and the empty messages inserted. States: 0 nothing, 1 system, 2 user, 3 assistant.
LINK = (
    ((0.0, ()), (0.0, ()), (INSERT, ("user",))),
    ((MERGE, ()), (0.0, ()), (INSERT, ("user",))),
    ((INF, ()), (MERGE, ()), (0.0, ())),
    ((INF, ()), (0.0, ()), (MERGE, ())),
)
#: Messages to add behind the last state.
ENDING = ((), ("user", "assistant"), ("assistant",), ())
START = [0.0, INF, INF, INF]


def role_of(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def role_costs(role: str | None) -> tuple[float, float, float]:
    name = role_of(role)
    return tuple(UNKNOWN if name is None else 0.0 if name == r else RELABEL for r in ROLES)


def step(costs: list[float], role: str | None) -> list[float]:
    own = role_costs(role)
    return [INF, *(min(costs[s] + LINK[s][t][0] for s in range(4)) + own[t] for t in range(3))]


def transfer(roles: list[str | None]) -> list[float]:
    """Least cost from every state before the turns to every state behind them, row by row."""
    out = []
    for s in range(4):
        costs = [INF] * 4
        costs[s] = 0.0
        for role in roles:
            costs = step(costs, role)
        out.extend(costs)
    return out


def trace(before: list[float], roles: list[str | None], last: int) -> list[int]:
    """States before the first turn and behind every turn, for costs ``before`` and the state ``last`` behind all."""
    table = [before]
    for role in roles:
        table.append(step(table[-1], role))
    states = [last]
    for i in range(len(roles) - 1, -1, -1):
        t = states[-1]
        own = role_costs(roles[i])[t - 1] if t else INF
        states.append(min(range(4), key=lambda s: (table[i][s] + (LINK[s][t - 1][0] if t else INF) + own, s)))  # noqa: B023
    return states[::-1]


def best_end(costs: list[float]) -> int:
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(ENDING[s]), s))


def message(role: str, text: str = "") -> str:
    return f"<|im_start|>{role}\n{text}"


END = "<|im_end|>\n"


def rendered(roles: list[str | None], texts: list[str], states: list[int], ends: bool) -> Iterator[tuple]:
    """``(role, action, inserted, cost, text)`` of every turn."""
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        s, t = states[i], states[i + 1]
        new, (cost, inserted) = ROLES[t - 1], LINK[s][t - 1]
        own = role_costs(role)[t - 1]
        merge = s == t
        actions = [a for a, on in (("relabel", own > 0), ("merge", merge), ("insert", bool(inserted))) if on]
        added = list(inserted)
        if merge:
            out = "\n\n" + text
        else:
            out = (END if s else "") + "".join(message(r) + END for r in inserted) + message(new, text)
        if ends and i == len(roles) - 1:
            out += END + "".join(message(r) + END for r in ENDING[t])
            added += ENDING[t]
            cost += INSERT * len(ENDING[t])
            if ENDING[t]:
                actions.append("close")
        yield new, "+".join(actions) or "keep", len(added), cost + own, out


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows of one conversation and part, from rows in that order."""
    held, last = [], None
    for frame in frames:
        names = list(zip(frame["conv_id"].isna(), frame["conv_id"].fillna(0), frame["part"], strict=True))
        start = 0
        for i, name in enumerate(names):
            if name != last:
                if i > start:
                    held.append(frame.iloc[start:i])
                if held:
                    yield pd.concat(held) if len(held) > 1 else held[0]
                held, start, last = [], i, name
        if len(frame) > start:
            held.append(frame.iloc[start:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _per_run(rows: DataFrame, solve: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def table(held: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(held, columns=columns)
        return frame.astype({c: "Int64" for c in ("conv_id", "turn") if c in columns})

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for run in _runs(frames):
            held.extend(solve(run))
            if len(held) >= 2000:
                yield table(held)
                held = []
        if held:
            yield table(held)

    return rows.mapInPandas(go, schema)


def _name(run: pd.DataFrame) -> tuple:
    c = run["conv_id"].iloc[0]
    return (None if pd.isna(c) else int(c)), int(run["part"].iloc[0])


def _scan(chunks: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return chunks.groupBy("conv_id").applyInPandas(lambda g: solve(g.sort_values("part")), schema)


def repaired(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, action, inserted, cost, rendered``."""
    rows = turns.select(F.col(id_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), F.col(role_column).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    order = ("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    rows = stage(rows, "turns")

    def together(df: DataFrame) -> DataFrame:
        return spread(df, "conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")

    def matrices(run: pd.DataFrame) -> list[tuple]:
        return [(*_name(run), transfer(run["role"].tolist()))]

    chunks = stage(_per_run(together(rows.select("conv_id", "part", "seq", "role")), matrices, "conv_id long, part int, m array<double>"), "matrices")
    several = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("conv_id", "c")
    is_several = chunks["conv_id"].eqNullSafe(several["c"])

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        costs, out = START, []
        for m in group["m"]:
            out.append(costs)
            costs = [min(costs[s] + m[s * 4 + t] for s in range(4)) for t in range(4)]
        return pd.DataFrame({"conv_id": group["conv_id"].astype("Int64"), "part": group["part"], "before": out, "last_costs": [costs] * len(group)})

    scanned = stage(_scan(chunks.join(several, is_several, "left_semi"), starts, "conv_id long, part int, before array<double>, last_costs array<double>"), "starts")

    def back(run: pd.DataFrame) -> list[tuple]:
        before, roles = list(run["before"].iloc[0]), run["role"].tolist()
        return [(*_name(run), [trace(before, roles, t)[0] for t in range(4)], list(run["last_costs"].iloc[0]))]

    def on_run(df: DataFrame, other: DataFrame) -> DataFrame:
        o = other.withColumnsRenamed({"conv_id": "_c", "part": "_p"})
        return df.join(o, df["conv_id"].eqNullSafe(o["_c"]) & (df["part"] == o["_p"])).drop("_c", "_p")

    maps = _per_run(together(on_run(rows.select("conv_id", "part", "seq", "role"), scanned)), back, "conv_id long, part int, lead array<int>, last_costs array<double>")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        state, out = best_end(list(group["last_costs"].iloc[-1])), []
        for lead in reversed(group["lead"].tolist()):
            out.append(state)
            state = int(lead[state])
        return pd.DataFrame({"conv_id": group["conv_id"].astype("Int64"), "part": group["part"], "state": out[::-1], "ends": [False] * (len(group) - 1) + [True]})

    exits = _scan(maps, ends, "conv_id long, part int, state int, ends boolean")
    plans = on_run(scanned.select("conv_id", "part", "before"), exits)
    single = chunks.join(several, is_several, "left_anti").select("conv_id", "part", F.lit(None).cast("array<double>").alias("before"), F.lit(None).cast("int").alias("state"), F.lit(True).alias("ends"))
    plans = stage(plans.select("conv_id", "part", "before", "state", "ends").unionByName(single), "plans")

    def write(run: pd.DataFrame) -> list[tuple]:
        roles, texts = run["role"].tolist(), run["text"].tolist()
        ends_here, known = bool(run["ends"].iloc[0]), run["before"].iloc[0]
        before = START if known is None else list(known)
        if known is None:
            costs = before
            for role in roles:
                costs = step(costs, role)
            last = best_end(costs)
        else:
            last = int(run["state"].iloc[0])
        c, _ = _name(run)
        numbers = [None if pd.isna(t) else int(t) for t in run["turn"]]
        return [(c, n, *r) for n, r in zip(numbers, rendered(roles, texts, trace(before, roles, last), ends_here), strict=True)]

    out = _per_run(together(on_run(rows, plans)), write, "conv_id long, turn long, role string, action string, inserted int, cost double, rendered string")
    return out
