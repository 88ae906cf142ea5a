"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, by turn, are edited in order: Keep (0), Rerole to user or assistant (3), Delete (4,
required for blank and repeated rows), Insert an empty user or assistant turn anywhere (3). A truncated row
that stays costs 3 more. The roles left must read ``(s?(ua)+)?`` by their initials. Of all cheapest edits
the ASCII-least string of initials (D, I, K, R) is the answer.

``Search`` runs depth-first in ASCII order under a cost bound that grows to the least cost seen beyond it.
A transposition table keeps, for every failed (row, state of the grammar), the least cost that any path
from there needs; it holds across bounds, so no state is searched twice with the same budget. The first
accepting path under the least sufficient bound is cheapest and ASCII-least.

Conversations of up to ``LONG_ROWS`` rows are read as sorted streams, one conversation in memory at a time.
A longer one, such as one id that holds a third of all rows, is cut into blocks of ``BLOCK_ROWS`` rows that
are searched anywhere, once for each pair of grammar states before and after the block. Blocks are then
folded ``FOLD`` at a time, level by level, by least cost and ASCII order: every block's edits end with an
edit of its last row, so none is a prefix of another and the whole string is least if its parts are. Going
down the levels again gives each block its states, hence its edits. Only the contract's own values then pass
one task a conversation: its edit string, and a SHA-256 that is fed block by block in order.

Defined cases: a NULL text or role counts as one space (such a text is blank, such a role can't be kept); a
role that is empty or starts with another letter than s, u, a can't be kept either. NULL turns come
first; equal turns are ordered by role and text, so repeated rows stand together and all but the first are
duplicates. NULL conversation ids form one conversation. One whose rows are all gone gives zeros, an empty
audit and the hash of the empty string. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import materialize, pa_schema
from riskspark.operators.ordered import row_index

LONG_ROWS = 512  # rows of a conversation that one task reads at once
LONG_BYTES = 32 << 20  # and bytes of its texts
BLOCK_ROWS = 64  # rows of a block of a longer one
FOLD = 256  # blocks folded at once

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
FINE, GONE, CUT = 0, 1, 2  # a row's fault: none, must be deleted (blank or repeated), truncated

# states of (s?(ua)+)?: nothing yet, after s, after u, after a; and what follows in each
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
FILL = (USER, USER, ASSISTANT, USER)  # the only turn that Insert and Rerole can give there
ACCEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what is inserted after the last row
NEVER = 1 << 60


class Search:
    """Cheapest, ASCII-least edits of rows ((role initial, fault) each) to an end in ``goals``."""

    def __init__(self, rows: list[tuple[str, int]], goals: tuple[int, ...] = ENDS, tail: bool = True) -> None:
        self.rows, self.goals, self.tail = rows, goals, tail
        self.early = max(goals) if max(goals) < USER else None  # a goal before the first user: no other turn may stay
        forced = [0]  # no path from a row on is cheaper than the faults that remain
        for _, fault in reversed(rows):
            forced.append(forced[-1] + (DELETE if fault == GONE or self.early is not None else TRUNCATED if fault == CUT else 0))
        self.needs = [n for n in reversed(forced) for _ in STATES]  # by 4 * row + state
        if self.early == SYSTEM:  # one row may stay
            self.needs[::4] = [max(0, n - DELETE) for n in self.needs[::4]]

    def edits(self, at: int) -> list[tuple[str, int, int]]:
        """(initial, cost, next place) in ASCII order."""
        row, state = at >> 2, at & 3
        if self.early is not None:
            stays = row < len(self.rows) and self.rows[row][0] == "s" and self.rows[row][1] != GONE and state < self.early
            more = [("K", TRUNCATED if self.rows[row][1] == CUT else KEEP, row + 1 << 2 | SYSTEM)] if stays else []
            return [("D", DELETE, row + 1 << 2 | state), *more] if row < len(self.rows) else []
        insert = ("I", INSERT, row << 2 | FILL[state])
        if row == len(self.rows):
            return [insert] if self.tail else []
        role, fault = self.rows[row]
        found, after = [("D", DELETE, row + 1 << 2 | state), insert], row + 1 << 2
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            kept = ACCEPT[role][state] if role in ACCEPT else None
            if kept is not None:
                found.append(("K", KEEP + more, after | kept))
            found.append(("R", REROLE + more, after | FILL[state]))
        return found

    def reachable(self, start: int, goal: int) -> bool:
        """Whether rows (one at least) can lead from a state to another without a tail."""
        if goal == SYSTEM:
            return start == SYSTEM or start == START and any(role == "s" and fault != GONE for role, fault in self.rows)
        return goal != START or start == START

    def run(self, start: int = START) -> tuple[int, str]:
        """(cost, edits' initials): deepening bounds until a path is accepted."""
        bound = self.needs[start]
        while True:
            path = self.deepen(start, bound)
            if path is not None:
                return bound, path
            bound = self.needs[start]

    def deepen(self, start: int, bound: int) -> str | None:
        """The first accepting path of at most ``bound``; failed places learn what they need at least."""
        needs, end, path = self.needs, len(self.rows) << 2, []
        if start >= end and start & 3 in self.goals:
            return ""
        stack = [[start, bound, iter(self.edits(start)), NEVER]]
        while stack:
            top = stack[-1]
            for letter, cost, at in top[2]:
                left = top[1] - cost
                if at >= end and at & 3 in self.goals:
                    if left >= 0:
                        return "".join(path) + letter
                    least = cost
                elif needs[at] <= left:
                    path.append(letter)
                    stack.append([at, left, iter(self.edits(at)), NEVER])
                    break
                else:
                    least = cost + needs[at]
                top[3] = min(top[3], least)
            else:
                stack.pop()
                needs[top[0]] = max(needs[top[0]], top[3])
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[3] = min(above[3], above[1] - top[1] + needs[top[0]])
        return None


def repaired(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[str]:
    """``role:text`` lines that the edits leave of (role, text) rows."""
    names, lines, row = {USER: "user", ASSISTANT: "assistant"}, [], 0
    for edit in audit:
        if edit == "I":
            state = FILL[state]
            lines.append(f"{names[state]}:")
            continue
        role, text = rows[row]
        row += 1
        if edit == "K":
            state = ACCEPT[role[:1]][state]
            lines.append(f"{role}:{text}")
        elif edit == "R":
            state = FILL[state]
            lines.append(f"{names[state]}:{text}")
    return lines


def misplaced(initials: list[str]) -> int:
    """Adjacent initials other than su, ua, au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, live): rows after damage by crc32 of ``conv:turn`` modulo 20; dropped rows stay as not live."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat_ws(":", said(conv_col), said(turn_col)).cast("binary")), F.lit(20))
    text = F.when(harm == 1, "").when(harm == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(harm == 4, "user").otherwise(said(role_col)).alias("role"),
        F.when(harm == 0, "").otherwise(text).alias("text"), (harm != 0).alias("live"), F.when(harm == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def row_faults(rows: DataFrame, repeated: Column) -> Column:
    """blank, duplicate, truncated or NULL: a row's first fault."""
    said = F.rtrim("text", F.lit(BLANKS))
    return F.when(said == "", "blank").when(repeated, "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FAULTS = {"blank": GONE, "duplicate": GONE, "truncated": CUT, None: FINE}


def _repair_one(rows: list[tuple]) -> dict:
    """Counts, audit and hash of one conversation's live rows (turn, role, text, fault) in order; a fault is
    blank, truncated or NULL, repeated rows are found here."""
    seen: set[tuple[str, str]] = set()
    faults: list[str | None] = []
    for _, role, text, fault in rows:
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        faults.append(fault)
    turns = {t for t, *_ in rows if t is not None}
    initials = [role[:1] for _, role, _, _ in rows]
    cost, audit = Search([(i, FAULTS[f]) for i, f in zip(initials, faults)]).run()
    lines = repaired([(role, text) for _, role, text, _ in rows], audit)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{kind: faults.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": misplaced(initials),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _short_schema(kind: str) -> str:
    return f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def repair_short(rows: DataFrame) -> DataFrame:
    """Conversations that a task can hold one by one: sorted within partitions by conversation, and read as a stream."""
    ddl = _short_schema(rows.schema["conv"].dataType.simpleString())
    schema = pa_schema(rows.sparkSession, ddl)
    ready = rows.withColumn("fault", row_faults(rows, F.lit(False)))
    ready = ready.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").select("conv", "turn", "role", "text", "fault", "live")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        at, held = (), []

        def close() -> None:
            if at:
                out["conv"].append(at[0])
                for k, v in _repair_one(held).items():
                    out[k].append(v)

        for b in batches:
            for conv, turn, role, text, fault, live in zip(*(c.to_pylist() for c in b.columns)):
                if at != (conv,):
                    close()
                    at, held = (conv,), []
                if live:
                    held.append((turn, role, text, fault))
            if len(out["conv"]) >= 1_000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {f.name: [] for f in schema}
        close()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return ready.mapInArrow(run, ddl)


# ----------------------------------------------------------------------------- long conversations


def search_block(rows: list[tuple[str, int]]) -> tuple[list[int], list[str | None]]:
    """Cost and edits for each (state before, state after), by 4 * before + after; NEVER where there is no way."""
    costs, audits = [NEVER] * 16, [None] * 16
    for goal in STATES:
        search = Search(rows, (goal,), tail=False)
        for start in STATES:
            if search.reachable(start, goal):
                costs[4 * start + goal], audits[4 * start + goal] = search.run(start)
    return costs, audits


def ranked(costs: list[int], audits: list) -> list[int]:
    """Place of each audit among those with the same state before, in ASCII order."""
    ranks = [0] * 16
    for start in STATES:
        ends = sorted((e for e in STATES if costs[4 * start + e] < NEVER), key=lambda e: audits[4 * start + e])
        for place, e in enumerate(ends):
            ranks[4 * start + e] = place
    return ranks


def fold(costs: list[list[int]], ranks: list[list[int]], start: int) -> list[tuple[int, bytes, bytes] | None]:
    """For each state after all blocks: (cost, ranks on the way, states on the way) of the best way from ``start``.
    Ways from one state compare by their ranks as their edits compare in ASCII order."""
    best: list[tuple[int, bytes, bytes] | None] = [(0, b"", b"") if s == start else None for s in STATES]
    for cost, rank in zip(costs, ranks):
        after: list[tuple[int, bytes, bytes] | None] = [None] * 4
        for s in STATES:
            if best[s] is None:
                continue
            for e in STATES:
                c = cost[4 * s + e]
                if c < NEVER:
                    way = (best[s][0] + c, best[s][1] + bytes([rank[4 * s + e]]), best[s][2] + bytes([e]))
                    if after[e] is None or way[:2] < after[e][:2]:
                        after[e] = way
        best = after
    return best


def _lists(column: pd.Series) -> list[list[int]]:
    return [list(map(int, v)) for v in column]


def _folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the blocks of a group: its costs and ranks."""
    pdf = pdf.sort_values("block")
    costs, keys = [NEVER] * 16, [None] * 16
    for start in STATES:
        for e, way in enumerate(fold(_lists(pdf["costs"]), _lists(pdf["ranks"]), start)):
            if way is not None:
                costs[4 * start + e], keys[4 * start + e] = way[0], way[1]
    return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "block": [int(pdf["group"].iloc[0])], "costs": [costs], "ranks": [ranked(costs, keys)]})


def _assigned(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before and after each block of a group, from those of the group (``before``, ``after``)."""
    pdf = pdf.sort_values("block")
    before, after = int(pdf["before"].iloc[0]), int(pdf["after"].iloc[0])
    states = list(fold(_lists(pdf["costs"]), _lists(pdf["ranks"]), before)[after][2])
    return pdf[["conv", "block"]].assign(before=[before, *states[:-1]], after=states)


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The whole conversation's states and cost, the turns inserted after its last row included."""
    costs, ranks = pdf["costs"].iloc[0], pdf["ranks"].iloc[0]
    cost, _, end = min((costs[e] + INSERT * len(TAIL[e]), ranks[e], e) for e in STATES if costs[e] < NEVER)
    return pdf[["conv", "block"]].assign(before=START, after=end, cost=cost)


def block_states(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, block, before, after) of every block, and (conv, cost, after) of every conversation: up the levels by folding
    ``FOLD`` blocks at a time, down again with the states of the best way."""
    kind = blocks.schema["conv"].dataType.simpleString()
    levels = [blocks.select("conv", "block", "costs", "ranks")]
    while levels[-1].agg(F.max("block")).first()[0]:
        group = levels[-1].withColumn("group", F.floor(F.col("block") / FOLD))
        up = group.groupBy("conv", "group").applyInPandas(_folded, f"conv {kind}, block long, costs array<long>, ranks array<int>")
        levels.append(materialize(up, "conversation-level"))
    top = levels[-1].groupBy("conv", "block").applyInPandas(_ends, f"conv {kind}, block long, before int, after int, cost long")
    whole = materialize(top, "conversation-ends")
    states = whole.select("conv", "block", "before", "after")
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("block", "group").withColumnRenamed("conv", "_conv")
        held = level.withColumn("group", F.floor(F.col("block") / FOLD))
        held = held.join(above, held["conv"].eqNullSafe(above["_conv"]) & (held["group"] == above["group"])).select("conv", held["group"], "block", "costs", "ranks", "before", "after")
        states = materialize(held.groupBy("conv", "group").applyInPandas(_assigned, f"conv {kind}, block long, before int, after int"), "conversation-states")
    return states, whole.select("conv", "cost", "after")


def repair_long(rows: DataFrame) -> DataFrame:
    """Conversations of any length, block by block; results equal ``repair_short``."""
    spark, kind = rows.sparkSession, rows.schema["conv"].dataType.simpleString()
    live = materialize(rows.where("live").drop("live").withColumn("_seq", F.monotonically_increasing_id()), "conversation-rows")
    null_first = F.when(F.col("turn").isNull(), F.lit(0)).otherwise(1)
    placed = row_index(live, [null_first, F.coalesce("turn", F.lit(0)), "role", "text", "_seq"], by=["conv"], name="pos")
    text_key = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    placed = materialize(placed.withColumn("block", F.floor(F.col("pos") / BLOCK_ROWS)).withColumn("key", text_key).select("conv", "pos", "block", "turn", "role", "text", "key"), "conversation-places")
    firsts = placed.groupBy("conv", "key").agg(F.min("pos").alias("first")).select(F.col("conv").alias("_conv"), F.col("key").alias("_key"), F.col("first"))
    flagged = placed.join(firsts, placed["conv"].eqNullSafe(firsts["_conv"]) & (placed["pos"] == firsts["first"]), "left")
    # a row that is not the first of its role and text has been seen earlier
    flagged = flagged.withColumn("fault", row_faults(flagged, F.col("first").isNull())).select("conv", "block", "pos", "turn", "role", "text", "fault")
    flagged = materialize(flagged, "conversation-faults")

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        initials = pdf["initial"].tolist()
        costs, audits = search_block([(i, FAULTS[f]) for i, f in zip(initials, pdf["fault"].where(pdf["fault"].notna(), None))])
        row = {"costs": costs, "audits": audits, "ranks": ranked(costs, audits), "first": initials[0], "last": initials[-1], "illegal": misplaced(initials)}
        return pdf[["conv", "block"]].iloc[:1].assign(**{k: [v] for k, v in row.items()})

    narrow = flagged.select("conv", "block", "pos", F.substring("role", 1, 1).alias("initial"), "fault")
    blocks = materialize(
        narrow.groupBy("conv", "block").applyInPandas(searched, f"conv {kind}, block long, costs array<long>, audits array<string>, ranks array<int>, first string, last string, illegal long"),
        "conversation-blocks",
    )
    states, whole = block_states(blocks)
    chosen = blocks.join(states.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "before", "after"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    chosen = chosen.select("conv", "block", "before", F.get("audits", F.col("before") * 4 + F.col("after")).alias("piece"), "first", "last", "illegal")

    follows = blocks.select(F.col("conv").alias("_conv"), (F.col("block") - 1).alias("_block"), F.col("first").alias("next"))
    seams = blocks.join(follows, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    bad_seam = F.when(F.col("next").isNotNull() & ~F.concat("last", "next").isin("su", "ua", "au"), 1).otherwise(0)
    illegal = seams.groupBy("conv").agg(F.sum(F.col("illegal") + bad_seam).alias("illegal"))
    is_kind = lambda k: F.count(F.when(F.col("fault") == k, 1)).alias(k)
    turns = flagged.groupBy("conv", "turn").agg(*[is_kind(k) for k in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")]
    )

    def lines(own: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        left = repaired(list(zip(own["role"], own["text"])), piece["piece"].iloc[0], int(piece["before"].iloc[0]))
        return piece[["conv", "block", "piece"]].assign(lines="\n".join(left), n=len(left))

    texts = flagged.select("conv", "block", "pos", "role", "text").groupBy("conv", "block").cogroup(chosen.select("conv", "block", "before", "piece").groupBy("conv", "block"))
    texts = texts.applyInPandas(lines, f"conv {kind}, block long, piece string, lines string, n long")
    end = whole.select(F.col("conv").alias("_conv"), "after")
    texts = texts.join(end, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "block", "piece", "lines", "n", "after")
    texts = texts.repartition("conv").sortWithinPartitions("conv", "block")
    ddl = f"conv {kind}, audit string, repaired_sha256 string"
    schema = pa_schema(spark, ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, audit, sha, any_line, after = (), [], hashlib.sha256(), False, START

        def add(line: str) -> None:
            nonlocal any_line
            sha.update(("\n" + line if any_line else line).encode())
            any_line = True

        def close() -> pa.RecordBatch:
            state = after
            for _ in TAIL[after]:
                state = FILL[state]
                add({USER: "user:", ASSISTANT: "assistant:"}[state])
            return pa.RecordBatch.from_pydict({"conv": [at[0]], "audit": ["".join(audit) + TAIL[after]], "repaired_sha256": [sha.hexdigest()]}, schema=schema)

        for b in batches:
            for conv, _, piece, text, n, end in zip(*(c.to_pylist() for c in b.columns)):
                if at != (conv,):
                    if at:
                        yield close()
                    at, audit, sha, any_line = (conv,), [], hashlib.sha256(), False
                audit.append(piece)
                after = end
                if n:
                    add(text)
        if at:
            yield close()

    out = texts.mapInArrow(digest, ddl)
    for part in (counts, illegal, whole.select("conv", "cost")):
        part = part.withColumnRenamed("conv", "_conv")
        out = out.join(part, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return out.select("conv", *COUNTS, "audit", "repaired_sha256")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Counts, cheapest edits and hash of the repaired turns for every conversation of ``damaged`` rows (conv, turn, role, text, live)."""
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv").alias("_long")), "long-conversations")
    n_long = long.count()
    if n_long == 0:
        return repair_short(rows)
    if n_long <= 10_000:
        long = F.broadcast(long)
    same = F.col("conv").eqNullSafe(F.col("_long"))
    short = repair_short(rows.join(long, same, "left_anti"))
    found = repair_long(rows.join(long, same, "left_semi"))
    return short.unionByName(found).unionByName(_all_gone(rows.join(long, same, "left_semi")))


def _all_gone(rows: DataFrame) -> DataFrame:
    """Rows of zeros for long conversations that damage left without any row."""
    empty = hashlib.sha256(b"").hexdigest()
    gone = rows.groupBy("conv").agg(F.max("live").alias("live")).where(~F.col("live"))
    return gone.select("conv", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"), F.lit(empty).alias("repaired_sha256"))
