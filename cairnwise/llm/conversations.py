"""Repairing the structure of conversations by depth-first branch and bound.

A conversation should be an optional system turn and then pairs of a user and
an assistant turn. Rows are kept, given another role, deleted or inserted; the
cheapest edits win, among equal costs the least audit (one letter an edit).

The search walks the rows depth first with an explicit stack. A node is (row,
state); the state says what was written last. Prefixes are cut when their cost
plus a lower bound of the remaining rows exceeds the incumbent, or meets it with
a greater audit, and when the node's dominance table holds a prefix with a
smaller (cost, audit). Two prefixes of a node have read the same rows, so
neither audit begins with the other at equal cost and their order decides that
of the whole audits. Insertions stand in front of a row, or behind the last
one, which keeps this true for pieces of a conversation too.

Conversations of any length are solved in segments: rows are range-partitioned
by conversation and turn, a task searches its segments from every state to
every state, and a chain over segments (costs and audit ranks only) picks one
path. A conversation with a third of all rows is therefore spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwise.session import materialise

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a segment at most.
SEGMENT = 2048
#: Shares into which the rows of one text of a conversation are dealt.
SALTS = 16
#: States of a written prefix: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role initial) -> state
_NEXT = {(NOTHING, "s"): SYSTEM, **{(s, "u"): USER for s in (NOTHING, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
#: The role that may follow a state.
_FOLLOWS = {NOTHING: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
#: Least cost of ending a conversation in each state.
_CLOSING = [0, 2 * INSERT, INSERT, 0]
_PAIRS = {"su", "ua", "au"}
INFINITE = float("inf")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by a checksum of conversation and turn; nulls count as one space there and in role and text."""
    c, blank = conversations, F.lit(" ")
    seed = F.concat(F.coalesce(c["conv_id"].cast("string"), blank), F.lit(":"), F.coalesce(c["turn"].cast("string"), blank))
    rows = c.select(
        c["conv_id"].cast("bigint").alias("conv_id"),
        c["turn"].cast("bigint").alias("turn"),
        F.coalesce(c["role"], blank).alias("role"),
        F.coalesce(c["text"], blank).alias("text"),
        (F.crc32(seed) % 20).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


@lru_cache(maxsize=1024)
def _moves(item: tuple) -> list[list[tuple[int, str, int]]]:
    """For each state the edits that pass a row: (cost, letters, next state).

    An item is (role initial, must be deleted, cost of staying, further copies).
    Copies are always deleted, right behind the row. No insertion stands in
    front of a deletion, since "DI" is less than "ID"; more than two in front
    of a row would only repeat a state.
    """
    initial, doomed, stay, copies = item
    extra, tail = copies * DELETE, "D" * copies
    moves = []
    for state in range(4):
        out = [(DELETE + extra, "D" + tail, state)]
        front, paid, letters = state, 0, ""
        for _ in range(0 if doomed else 3):
            kept = _NEXT.get((front, initial))
            if kept is not None:
                out.append((paid + stay + extra, letters + "K" + tail, kept))
            role, after = _FOLLOWS[front]
            if role[0] != initial:
                out.append((paid + stay + REROLE + extra, letters + "R" + tail, after))
            front, paid, letters = after, paid + INSERT, letters + "I"
        moves.append(out)
    return moves


def _floors(items: list[tuple], last: list[float]) -> list[list[float]]:
    """Lower bound of the cost behind every (row, state): the remaining rows without regard to their audits.

    ``last`` is what ending in each state costs, infinite where it is not asked for.
    """
    floors = [last]
    for item in reversed(items):
        behind = floors[-1]
        floors.append([min(more + behind[after] for more, _, after in out) for out in _moves(item)])
    return floors[::-1]


def _search(items: list[tuple], start: int, floors: list[list[float]]) -> tuple[int, str, int] | None:
    """The least (cost, audit, end state) from ``start`` over all items, by depth-first branch and bound."""
    n, best = len(items), None
    tables: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + floors[i][state]
        if bound == INFINITE or (best is not None and (bound, audit) > (best[0], best[1][: len(audit)])):
            continue
        known = tables[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        tables[i][state] = (cost, audit)
        if i == n:
            closing = "I" * (floors[n][state] // INSERT)
            if best is None or (bound, audit + closing) < best[:2]:
                best = (bound, audit + closing, state)
            continue
        behind = floors[i + 1]
        children = sorted(((more + behind[after], edits, more, after) for more, edits, after in _moves(items[i])[state]), reverse=True)
        for _, edits, more, after in children:  # the one with the least bound, then audit, is popped first
            stack.append((i + 1, after, cost + more, audit + edits))
    return best


def _replay(audit: str, state: int, roles: list[str], copies: list[int]) -> Iterator[tuple[int | None, str]]:
    """(row, role) of every written row; row None was inserted."""
    i = 0
    letters = iter(audit)
    for letter in letters:
        if letter == "I":
            role, state = _FOLLOWS[state]
            yield None, role
            continue
        for _ in range(copies[i]):  # the deletions of the row's copies
            next(letters)
        if letter == "K":
            state = _NEXT[state, roles[i][:1]]
            yield i, roles[i]
        elif letter == "R":
            role, state = _FOLLOWS[state]
            yield i, role
        i += 1


def _items(initials: list[str], doomed: list[bool], cut: list[bool], copies: list[int]) -> list[tuple]:
    return [(a, d, TRUNCATED if t else 0, k) for a, d, t, k in zip(initials, doomed, cut, copies)]


_SEGMENT = (
    "conv_id bigint, sid bigint, first_turn bigint, first_role string, first_key binary, first_initial string, last_initial string,"
    " illegal bigint, closed boolean, costs array<bigint>, audits array<string>, roles array<string>, copies array<bigint>, keys array<binary>"
)


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """Solved segments. ``costs`` and ``audits`` hold 16 paths, start by end state, or one path of a whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, number = TaskContext.get().partitionId(), [], 0
        held: list[tuple] = []
        whole = False  # all rows of the conversation so far are held; never for a task's first one

        def solve(closed: bool) -> None:
            nonlocal number
            conv = held[0][0]
            _, turns, roles, keys, copies, doomed, cut = zip(*held)
            more = [c - 1 for c in copies]
            initials = [r[:1] for r in roles]
            items = _items(initials, doomed, cut, more)
            if closed:
                paths = [_search(items, NOTHING, _floors(items, _CLOSING))]
            else:
                floors = [_floors(items, [0 if e == end else INFINITE for e in range(4)]) for end in range(4)]
                paths = [_search(items, start, floors[end]) for start in range(4) for end in range(4)]
            costs, audits = [p and p[0] for p in paths], [p and p[1] for p in paths]
            illegal = sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:])) + sum(more)
            made.append(
                (conv, part << 32 | number, turns[0], roles[0], keys[0], initials[0], initials[-1], illegal, closed, costs, audits, roles, more, keys)
            )
            number += 1
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "key", "n", "doomed", "cut"))):
                if held and row[0] != held[0][0]:
                    solve(whole)
                    whole = True
                elif len(held) >= segment:
                    solve(False)
                    whole = False
                held.append(row)
            if len(made) >= 256:
                yield _batch(made, _SEGMENT_ARROW)
                made.clear()
        if held:
            solve(False)
        if made:
            yield _batch(made, _SEGMENT_ARROW)

    ordered = rows.repartitionByRange("conv_id", "turn", "role", "key").sortWithinPartitions("conv_id", "turn", "role", "key")
    return materialise(
        ordered.select("conv_id", "turn", "role", "key", "n", "doomed", "cut").mapInArrow(run, _SEGMENT), "conversation-segments"
    )


_SEGMENT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("sid", pa.int64()), ("first_turn", pa.int64()), ("first_role", pa.string()), ("first_key", pa.binary())]
    + [("first_initial", pa.string()), ("last_initial", pa.string()), ("illegal", pa.int64()), ("closed", pa.bool_())]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    + [("roles", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary()))]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _chain(group: pa.Table) -> pa.Table:
    """One path through the segments of a conversation: the place of the cheapest, then least, whole audit.

    Needs costs and ranks only: from the back, every state's best continuation
    has a cost and an order number among those of the other states.
    """
    rows = sorted(
        group.to_pylist(), key=lambda r: (r["first_turn"] is not None, r["first_turn"] or 0, r["first_role"].encode(), r["first_key"])
    )
    ahead = {s: (_CLOSING[s], _CLOSING[s]) for s in range(4)}  # (cost, order); closing audits differ by length alone
    picks = []
    for r in reversed(rows):
        state, pick = {}, {}
        for s in range(4):
            paths = [
                (r["costs"][4 * s + e] + ahead[e][0], r["ranks"][4 * s + e], ahead[e][1], e) for e in range(4) if r["costs"][4 * s + e] is not None
            ]
            state[s], pick[s] = min(paths)[:3], min(paths)[3]
        order = {v: k for k, v in enumerate(sorted({x[1:] for x in state.values()}))}
        ahead = {s: (x[0], order[x[1:]]) for s, x in state.items()}
        picks.append(pick)
    out, s = [], NOTHING
    for at, (r, pick) in enumerate(zip(rows, reversed(picks))):
        e = pick[s]
        last = at == len(rows) - 1
        closing = _CLOSING[e] if last else 0
        between = 0 if last else int(r["last_initial"] + rows[at + 1]["first_initial"] not in _PAIRS)
        out.append((r["sid"], at, s, 4 * s + e, closing, between))
        s = e
    return pa.Table.from_batches([_batch(out, _CHAIN_ARROW)])


_CHAIN_ARROW = pa.schema(
    [("sid", pa.int64()), ("at", pa.int64()), ("start", pa.int32()), ("path", pa.int32()), ("closing", pa.int64()), ("between", pa.int64())]
)


def _ranks(audits: Column) -> Column:
    """Order numbers of the audits among themselves; equal ones share theirs."""
    distinct = F.array_sort(F.array_distinct(F.filter(audits, lambda a: a.isNotNull())))
    return F.transform(audits, lambda a: F.array_position(distinct, a))


def solve(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(segments, counts) of rows ``conv_id, turn, role, text`` without null roles and texts.

    ``segments``: ``conv_id, sid, at, start, audit, cost, illegal, roles,
    copies, keys``, in conversation order by ``at``. ``counts``: ``conv_id,
    gaps, blank, duplicate, truncated``. Rows of a turn are ordered by role and
    a digest of turn, role and text, so equal rows are neighbours; null turns
    come first. Equal rows travel as one with a count. ``segment`` bounds the rows
    that are searched at once; it changes no result.
    """
    trimmed = F.trim("text", F.lit(BLANKS))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    thin = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5(said)).alias("said"),
        key_of("conv_id", "turn", "role", "text").alias("key"),
        (F.length(trimmed) == 0).alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    thin = thin.groupBy("conv_id", "turn", "role", "said", "key", "blank", "open").agg(F.count(F.lit(1)).alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = thin.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(when).alias("earliest"), F.count(F.lit(1)).alias("m"))
    again = again.where("m > 1").select("c", "s", "earliest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    thin = thin.withColumn("salt", F.pmod(F.hash("turn"), F.lit(SALTS)))
    flagged = thin.join(
        again, thin["conv_id"].eqNullSafe(again["c"]) & (thin["said"] == again["s"]) & (thin["salt"] == again["share"]), "left"
    ).withColumn("repeated", F.coalesce(when > F.col("earliest"), F.lit(False)))
    rows = materialise(
        flagged.select("conv_id", "turn", "role", "key", "n", "blank", "repeated", (F.col("open") & ~F.col("blank")).alias("cut")), "turns"
    )
    rows = rows.withColumn("doomed", F.col("blank") | F.col("repeated"))
    per_turn = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - 1 + F.col("repeated").cast("int"))).alias("duplicate"),
        F.sum((F.col("cut") & ~F.col("doomed")).cast("bigint")).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = per_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    segments = _segments(rows, segment)
    open_ones = segments.where("not closed").select(
        "conv_id", "sid", "first_turn", "first_role", "first_key", "first_initial", "last_initial", "costs", _ranks(F.col("audits")).alias("ranks")
    )
    chained = open_ones.groupBy("conv_id").applyInArrow(_chain, "sid bigint, at bigint, start int, path int, closing bigint, between bigint")
    chained = materialise(chained, "conversation-paths").withColumnRenamed("sid", "chosen")
    path = F.coalesce("path", F.lit(0))
    closing = F.coalesce("closing", F.lit(0))
    picked = segments.join(chained, segments["sid"] == chained["chosen"], "left").select(
        "conv_id",
        "sid",
        F.coalesce("at", F.lit(0)).alias("at"),
        F.coalesce("start", F.lit(NOTHING)).alias("start"),
        F.concat(F.get("audits", path), F.repeat(F.lit("I"), (closing / INSERT).cast("int"))).alias("audit"),
        (F.get("costs", path) + closing).alias("cost"),
        (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"),
        "roles",
        "copies",
        "keys",
    )
    return picked, counts


def key_of(*columns: str) -> Column:
    """Digest of conversation, turn, role and text."""
    conv, turn, role, text = columns
    parts = [F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" "))]
    return F.unhex(F.md5(F.concat_ws(":", *parts, F.length(role).cast("string"), F.concat(role, text))))


def repaired_rows(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``conv_id, at, row, role, text`` of the repaired conversations, ordered by ``at`` and ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "at", "start", "audit", "roles", "copies", "keys")
        for batch in batches:
            made = []
            for conv, at, start, audit, roles, copies, keys in zip(*(batch.column(c).to_pylist() for c in names)):
                for row, (i, role) in enumerate(_replay(audit, start, roles, copies)):
                    made.append((conv, at, row, role, None if i is None else keys[i]))
            if made:
                yield _batch(made, _WRITTEN_ARROW)

    written = segments.mapInArrow(run, "conv_id bigint, at bigint, row bigint, role string, key binary")
    texts = rows.select(key_of("conv_id", "turn", "role", "text").alias("of"), "text").groupBy("of").agg(F.first("text").alias("text"))
    return written.join(texts, written["key"] == texts["of"], "left").select(
        "conv_id", "at", "row", written["role"], F.coalesce("text", F.lit("")).alias("text")
    )


_WRITTEN_ARROW = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("row", pa.int64()), ("role", pa.string()), ("key", pa.binary())])


def digests(written: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: a digest of each conversation's ``role:text`` lines, read as a stream in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, of, started, out = hashlib.sha256(), None, False, []
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if started and conv != of:
                    out.append((of, sha.hexdigest()))
                    started = False
                if started:
                    sha.update(b"\n")
                else:
                    sha, of, started = hashlib.sha256(), conv, True
                sha.update(line.encode())
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if started:
            out.append((of, sha.hexdigest()))
        if out:
            yield _batch(out, schema)

    lines = written.select("conv_id", "at", "row", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "row").select("conv_id", "line")
    return ordered.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults of ``rows``, cost, audit and a digest of the repaired rows.

    A null id is a conversation of its own; one without rows has zeros, an empty
    audit and the digest of an empty text. Extra columns are not read.
    """
    segments, counts = solve(rows, segment)
    segments = materialise(segments, "conversation-repairs")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"])
    solved = segments.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(steps, "").alias("audit")
    )
    found = digests(repaired_rows(rows, segments))
    out = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for right in (counts, solved, found):
        right = right.withColumnRenamed("conv_id", "other")
        out = out.join(right, out["conv_id"].eqNullSafe(right["other"]), "left").drop("other")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in zero],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
