"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import arrow_map

ROLES = ("system", "user", "assistant")
#: Which turns may follow which; a chat may begin with system or user and must end with assistant.
LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MERGE, RELABEL, NAME, INSERT = 2, 3, 1, 4


def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    """The least cost of turning messages with these roles into a legal chat, and its steps, each (what, role): insert an empty turn, or for the next message: keep, name (it had no known role), relabel, or merge into the turn before ("merge" if of its role, else "merge_as").

    Dynamic programming over (messages done, role of the last turn). Of equal costs: the fewest steps, then the first alphabetically by the latest steps."""
    best: dict[str | None, tuple] = {None: (0, 0, (), None)}

    def better(into: dict, state: str, new: tuple) -> None:
        if state not in into or new[:3] < into[state][:3]:
            into[state] = new

    def inserts(states: dict) -> dict:
        out = dict(states)
        for _ in range(2):
            for s, way in list(out.items()):
                for x in LEGAL[s]:
                    better(out, x, (way[0] + INSERT, way[1] + 1, ("insert", x), way))
        return out

    for r in roles:
        new: dict[str | None, tuple] = {}
        for s, way in inserts(best).items():
            for x in LEGAL[s]:
                what, cost = ("keep", 0) if r == x else ("name", NAME) if r not in ROLES else ("relabel", RELABEL)
                better(new, x, (way[0] + cost, way[1] + 1, (what, x), way))
            if s is not None:
                what, cost = ("merge", MERGE) if r == s else ("merge_as", MERGE + (NAME if r not in ROLES else RELABEL))
                better(new, s, (way[0] + cost, way[1] + 1, (what, s), way))
        best = new
    if not roles:
        return 0, ()
    way = inserts(best)["assistant"]
    cost, steps = way[0], []
    while way[3] is not None:
        steps.append(way[2])
        way = way[3]
    return cost, tuple(reversed(steps))


def render(steps: tuple[tuple[str, str], ...], texts: list[str]) -> str:
    """One <|im_start|>role ... <|im_end|> block a turn; merged texts are a blank line apart. A text's own "<|" becomes "< |", so that it can't end its turn."""
    turns: list[tuple[str, list[str]]] = []
    rest = iter(texts)
    for what, role in steps:
        if what.startswith("merge"):
            turns[-1][1].append(next(rest))
        else:
            turns.append((role, [] if what == "insert" else [next(rest)]))
    return "".join(f"<|im_start|>{role}\n" + "\n\n".join(own).replace("<|", "< |") + "<|im_end|>\n" for role, own in turns)


def format_chats(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text, ...) to (conv_id, n_messages, n_turns, cost, kept, named, relabelled, merged, inserted, rendered), one row for each conversation.

    A legal chat is an optional system turn, then user and assistant by turns, the last an assistant's. The cheapest repair is taken: merging a message into the turn before costs 2, another role 3, a role where there was none known 1, an empty turn 4.

    Roles count trimmed and in small letters; null and unknown ones are to be named. Messages go by turn, null turns last, ties by role and text. Rows alike in all four are one message. A null text is an empty one, and stays a turn. Rows without conv_id are left out; other columns don't matter; an empty table gives an empty one. One shuffle, by conversation."""
    rows = messages.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNull().alias("late"), F.col("turn").cast("bigint").alias("turn"), F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("m")).alias("m")).select("conv_id", F.col("m.role").alias("roles"), F.col("m.text").alias("texts"))
    counted = {"kept": ("keep",), "named": ("name",), "relabelled": ("relabel", "merge_as"), "merged": ("merge", "merge_as"), "inserted": ("insert",)}

    def make(x: dict) -> Iterator[dict]:
        known = functools.cache(repair)  # most chats have one of few sequences of roles
        got = [known(tuple(r)) for r in x["roles"]]
        out = {"conv_id": x["conv_id"], "n_messages": [len(r) for r in x["roles"]], "n_turns": [sum(not w.startswith("merge") for w, _ in s) for _, s in got], "cost": [c for c, _ in got], "rendered": [render(s, t) for (_, s), t in zip(got, x["texts"])]}
        yield out | {k: [sum(w in names for w, _ in s) for _, s in got] for k, names in counted.items()}

    return arrow_map(grouped, make, "conv_id bigint, n_messages int, n_turns int, cost int, kept int, named int, relabelled int, merged int, inserted int, rendered string")
