"""Chat formatting by minimum-cost role repair.

The legal sequences of turns are those of a small automaton: an optional system turn, then user and assistant turns
in alternation, the last by the assistant. Each given turn is kept, merged into the turn before, relabelled, or
preceded by inserted empty turns, so that the whole conversation is legal at the least total cost; of several ways
of that cost the one whose roles come first in the order system, user, assistant is taken, turn by turn, however the
table is partitioned. The repaired sequence is rendered in chunks, one for each given turn, whose concatenation in order is the formatted text.

How it is distributed: turns are sorted by conversation over range partitions, so a long conversation spans several.
The effect of a run of turns is a matrix of least costs between states, and matrices compose, so every run is reduced
on its own, the runs of a conversation (no more than there are partitions) give each run's first and last state, and
runs are then decided on their own again. No task needs more than a partition's turns of a conversation.

Defined results: turns are ordered by turn number (null first), then role, then text; roles other than system, user
and assistant (``human``, ``gpt``, ``tool``, null and so on) are unknown and can become any of the three, unless
``aliases`` says what they mean; null texts count as empty ones, texts of any length go whole into their chunk;
repeated rows are separate turns; a null conv_id is a conversation; an empty table gives an empty result; extra columns
pass through and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import fresh, others, require, written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
FAR = 10**9
RESULTS = ("position", "out_role", "action", "inserted", "chunk", "conversation_cost")
Step = tuple[int, str, tuple[int, ...]]


def bridge(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that make ``role`` legal after ``state``."""
    paths: list[tuple[int, ...]] = [()]
    for _ in range(len(ROLES)):
        for p in paths:
            if role in NEXT[p[-1] if p else state]:
                return p
        paths = [(*p, r) for p in paths for r in NEXT[p[-1] if p else state]]
    return None


def step(state: int, given: int, role: int) -> Step:
    """Least cost, action and inserted roles for a turn ``given`` (0: unknown) that becomes ``role`` after ``state``."""
    renamed = 0 if given == role else RELABEL if given else NAME
    said = "" if given == role else "relabel" if given else "name"
    options: list[Step] = []
    if (between := bridge(state, role)) is not None:
        options.append((renamed + INSERT * len(between), "+".join(filter(None, [said, "insert" if between else ""])) or "keep", between))
    if state == role:
        options.append((renamed + MERGE, "+".join(filter(None, [said, "merge"])), ()))
    return min(options, default=(FAR, "", ()))


STEPS = {(q, g, r): step(q, g, r) for q in range(4) for g in range(4) for r in (SYSTEM, USER, ASSISTANT)}
LAST = {q: () if q in (START, ASSISTANT) else (*(bridge(q, ASSISTANT) or ()), ASSISTANT) for q in range(4)}


Best = list[tuple[int, int]]  # by state: the least cost, and the place of its way among the states' ways
NOWHERE = (FAR, len(ROLES))


def advanced(best: Best, given: int) -> tuple[Best, list[int]]:
    """``best`` after one more turn, and the state before it on the way to each state.

    Of several ways of one cost that whose roles come first, compared turn by turn, is taken. Ways that end in
    different states differ, so their places tell all that later turns need to know.
    """
    came = [START, *(min((best[q][0] + STEPS[q, given, r][0], best[q][1], q) for q in range(4))[2] for r in (SYSTEM, USER, ASSISTANT))]
    costs = [FAR, *(min(best[came[r]][0] + STEPS[came[r], given, r][0], FAR) for r in (SYSTEM, USER, ASSISTANT))]
    return placed(costs, [(best[came[r]][1], r) for r in range(4)]), came


def placed(costs: list[int], ways: list[tuple[int, int]]) -> Best:
    """Costs with the places of their ways; states out of reach come last."""
    order = sorted((costs[r] >= FAR, ways[r]) for r in range(4))
    return [(costs[r], order.index((costs[r] >= FAR, ways[r])) if costs[r] < FAR else NOWHERE[1]) for r in range(4)]


def first_state(state: int) -> Best:
    return [(0, 0) if q == state else NOWHERE for q in range(4)]


def run_costs(given: list[int]) -> list[int]:
    """Least costs from each state to each state over a run of turns, and the places of their ways, row by row."""
    out = []
    for first in range(4):
        best = first_state(first)
        for g in given:
            best, _ = advanced(best, g)
        out += [x for c in best for x in c]
    return out


def run_ends(matrices: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The cost of a conversation given its runs' matrices, and each run's first and last state on the best way."""
    best, back = first_state(START), []
    for m in matrices:
        cost, place = (lambda q, r: m[8 * q + 2 * r]), (lambda q, r: m[8 * q + 2 * r + 1])
        came = [min((best[q][0] + cost(q, r), best[q][1], q) for q in range(4))[2] for r in range(4)]
        back.append(came)
        costs = [min(best[came[r]][0] + cost(came[r], r), FAR) for r in range(4)]
        best = placed(costs, [(best[came[r]][1], place(came[r], r)) for r in range(4)])
    total, _, state = min((best[q][0] + INSERT * len(LAST[q]), best[q][1], q) for q in range(4))
    ends = []
    for came in reversed(back):
        ends.append((came[state], state))
        state = came[state]
    return total, ends[::-1]


def decide(given: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """(state before, role) of each turn of a run on its best way from ``first`` to ``last``."""
    best, back = first_state(first), []
    for g in given:
        best, came = advanced(best, g)
        back.append(came)
    out, state = [], last
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def tag(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


END = "<|end|>\n"
MATRIX = T.ArrayType(T.LongType())
ENDS = T.StructType().add("cost", "long").add("first", T.ArrayType(T.IntegerType())).add("last", T.ArrayType(T.IntegerType()))
TURN = T.StructType().add("pos", "long").add("before", "integer").add("role", "integer").add("action", "string").add("inserted", T.ArrayType(T.StringType())).add("head", "string").add("tail", "string")


@F.pandas_udf(MATRIX)
def _matrix(given: pd.Series) -> pd.Series:
    return given.map(lambda g: run_costs([int(x) for x in g]))


@F.pandas_udf(ENDS)
def _ends(matrices: pd.Series) -> pd.DataFrame:
    found = [run_ends([[int(x) for x in m] for m in ms]) for ms in matrices]
    return pd.DataFrame({"cost": [c for c, _ in found], "first": [[a for a, _ in e] for _, e in found], "last": [[b for _, b in e] for _, e in found]})


@F.pandas_udf(T.ArrayType(TURN))
def _turns(pos: pd.Series, given: pd.Series, first: pd.Series, last: pd.Series, ends: pd.Series) -> pd.Series:
    """A run's turns, each with what is rendered before and after its text."""
    out = []
    for ps, gs, a, b, is_last in zip(pos, given, first, last, ends, strict=True):
        turns = []
        decided = decide([int(g) for g in gs], int(a), int(b))
        for k, (p, g, (before, role)) in enumerate(zip(ps, gs, decided, strict=True)):
            _, action, inserted = STEPS[before, int(g), role]
            if "merge" in action:
                head = "\n\n"
            else:
                head = ("" if before == START else END) + "".join(tag(r) + END for r in inserted) + tag(role)
            tail = END + "".join(tag(r) + END for r in LAST[role]) if is_last and k + 1 == len(gs) else ""
            turns.append((int(p), before, role, action, [ROLES[r] for r in inserted], head, tail))
        out.append(turns)
    return pd.Series(out)


def role_code(role: Column, aliases: Mapping[str, str]) -> Column:
    name = F.lower(F.trim(role))
    out = F.lit(0)
    for known, means in {**aliases, **{r: r for r in ROLES[1:]}}.items():
        out = F.when(name == known, ROLES.index(means)).otherwise(out)
    return out


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", aliases: Mapping[str, str] = {}) -> DataFrame:
    """``df`` with ``position`` (a number that orders turns), ``out_role``, ``action``, ``inserted`` (roles), ``chunk`` and ``conversation_cost``."""
    require(df, [conv, turn, role, text])
    mine = others(df, *RESULTS)
    at, part = fresh(df.columns, "_pos", "_part")
    order = [F.col(conv), F.col(turn), F.col(role), F.col(text)]
    spread = df.select(*mine).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = written(spread.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "turns")
    plain = rows.select(F.col(conv).alias("_conv"), F.col(part).alias("_part"), F.struct(F.col(at).alias("pos"), role_code(F.col(role), aliases).alias("given")).alias("turn"))
    runs = plain.groupBy("_conv", "_part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    runs = written(runs.select("_conv", "_part", "turns.pos", "turns.given"), "runs")
    costs = runs.select("_conv", "_part", _matrix("given").alias("m"))
    joined = costs.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_part", "m"))).alias("runs"))
    ends = joined.select("_conv", "runs._part", _ends("runs.m").alias("e"))
    each = ends.select("_conv", F.col("e.cost").alias("cost"), F.size("_part").alias("n"), F.posexplode(F.arrays_zip("_part", F.col("e.first").alias("first"), F.col("e.last").alias("last"))).alias("k", "r"))
    each = written(each.select(F.col("_conv").alias("_c"), F.col("r._part").alias("_p"), "cost", F.col("r.first").alias("first"), F.col("r.last").alias("last"), (F.col("k") + 1 == F.col("n")).alias("ends")), "run-ends")
    decided = runs.join(each, runs["_conv"].eqNullSafe(each["_c"]) & (runs["_part"] == each["_p"]))
    turns = decided.select("cost", F.explode(_turns("pos", "given", "first", "last", "ends")).alias("t"))
    turns = written(turns.select(F.col("t.pos").alias(at), F.struct("t.role", "t.action", "t.inserted", "t.head", "t.tail", "cost").alias("turn")), "decided-turns")
    done = rows.join(turns.withColumnsRenamed({"turn": (turn_of := fresh(df.columns, "_turn")[0])}), at)
    name = F.element_at(F.array(*(F.lit(r) for r in ROLES)), F.col(f"{turn_of}.role") + 1)
    return done.select(
        *mine,
        F.col(at).alias("position"),
        name.alias("out_role"),
        F.col(f"{turn_of}.action").alias("action"),
        F.col(f"{turn_of}.inserted").alias("inserted"),
        F.concat(f"{turn_of}.head", F.coalesce(F.col(text), F.lit("")), f"{turn_of}.tail").alias("chunk"),
        F.col(f"{turn_of}.cost").alias("conversation_cost"),
    )


def render(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, rendered): whole conversations in one value each, for those that fit into one."""
    parts = F.sort_array(F.collect_list(F.struct("position", "chunk")))
    return repaired.groupBy(conv).agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("rendered"))
