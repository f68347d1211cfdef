"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import pytest

from cairnwise.llm import conversations as c

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, at int, n int"


def legal(roles):
    body = roles[1:] if roles[:1] == ["s"] else roles
    return not roles or (len(body) > 0 and len(body) % 2 == 0 and body == ["u", "a"] * (len(body) // 2))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(BLANKS)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Every edit sequence with at most two insertions in front of a row and at the end."""
    kinds, best = faults(rows), None
    choices = []
    for (_, role, _), fault in zip(rows, kinds):
        one = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            stay = 5 * (fault == "truncated")
            one += [("K", stay, role)] + [("R", 1 + stay, r) for r in ("user", "assistant")]
        choices.append(one)
    inserts = [[]] + [list(x) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    fronts = [inserts] * (len(rows) + 1)
    for picked in itertools.product(*choices):
        for before in itertools.product(*fronts):
            cost = sum(p[1] for p in picked) + 5 * sum(map(len, before))
            if best and cost > best[0]:
                continue
            audit, written = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(before[k])
                written += [(r, "") for r in before[k]]
                if k < len(rows):
                    audit += picked[k][0]
                    if picked[k][2] is not None:
                        written.append((picked[k][2], rows[k][2]))
            if legal([r[:1] for r, _ in written]) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, written)
    return best


def programmed(rows):
    """The same by keeping the least (cost, audit) of every state."""
    states = {0: (0, "", [])}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def better(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, w) in list(states.items()):
                role = "assistant" if s == 2 else "user"
                better(states, step[s, role[0]], (cost + 5, audit + "I", w + [(role, "")]))

    for (_, role, text), fault in zip(rows, faults(rows)):
        inserted(states)
        after = {}
        for s, (cost, audit, w) in states.items():
            better(after, s, (cost + 2, audit + "D", w))
            if fault in ("blank", "duplicate"):
                continue
            stay = 5 * (fault == "truncated")
            if (s, role[:1]) in step:
                better(after, step[s, role[:1]], (cost + stay, audit + "K", w + [(role, text)]))
            for r in ("user", "assistant"):
                if (s, r[0]) in step:
                    better(after, step[s, r[0]], (cost + stay + 1, audit + "R", w + [(r, text)]))
        states = after
    inserted(states)
    return min(states[s] for s in (0, 3) if s in states)


def order(row):
    conv, turn, role, text = row
    key = ":".join([" " if conv is None else str(conv), " " if turn is None else str(turn), str(len(role)), role + text])
    return (turn is not None, turn or 0, role.encode(), hashlib.md5(key.encode()).digest())


def report(rows, solver):
    """{conv: report} of (conv, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(r[1], r[2], r[3]) for r in sorted((r for r in rows if r[0] == conv), key=order)]
        kinds, turns = faults(mine), {r[0] for r in mine if r[0] is not None}
        cost, audit, written = solver(mine)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest(),
        )
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


def got(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "User", "änderung"]
TEXTS = ["Yes.", "No", "Yes.", "  ", "", "Why? ", "wait\n", "!", "Ja.\t", "x" * 30, "é."]


def random_rows(conv, n, seed):
    r = random.Random(seed)
    return [(conv, r.choice([None, *range(n), 2**40]), r.choice(ROLES[: r.choice([2, 3, 10])]), r.choice(TEXTS)) for _ in range(n)]


def test_search_equals_all_edit_sequences():
    for seed in range(60):
        rows = random_rows(1, seed % 4, seed)
        mine = [(r[1], r[2], r[3]) for r in sorted(rows, key=order)]
        assert programmed(mine)[:2] == exhaustive(mine)[:2]
        kinds = faults(mine)
        items = [(r[:1], f in ("blank", "duplicate"), 5 * (f == "truncated"), 0) for (_, r, _), f in zip(mine, kinds)]
        assert c._search(items, 0, c._floors(items, c._CLOSING))[:2] == exhaustive(mine)[:2]


@pytest.mark.parametrize("segment", [1, 3, 2048])
def test_reports(spark, segment):
    rows = [r for conv in range(40) for r in random_rows(conv, conv % 12, conv)]
    rows += random_rows(None, 7, 77) + random_rows(-5, 300, 5)
    frame = table(spark, rows)
    assert got(c.repair_report(frame, frame.select("conv_id", "turn", "role", "text"), segment)) == report(rows, programmed)


def test_damage_and_nulls(spark):
    rows = [(conv, t, r, x) for conv in [*range(30), None] for t, r, x in [(0, "user", "A?"), (1, None, "B."), (None, "user", None), (2, "assistant", "C.")]]
    rows += [(99, t, "user", "Q?") for t in range(60)] + [(7, 3, "user", "same.")] * 5
    frame = table(spark, rows)
    assert sorted(map(repr, map(tuple, c.damage(frame).collect()))) == sorted(map(repr, damaged(rows)))
    want = report(damaged(rows), programmed)
    result = got(c.repair_report(frame, c.damage(frame)))
    for conv in {r[0] for r in rows}:
        assert result[conv] == want.get(conv, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(k for k in range(10**6) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = table(spark, [(gone, 0, "user", "x.")])
    assert got(c.repair_report(frame, c.damage(frame))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = table(spark, []).where("false")
    assert c.repair_report(empty, c.damage(empty)).collect() == []


def test_one_conversation_over_many_tasks(spark):
    """Segments of one conversation come from several tasks, and long runs of equal rows travel as one."""
    rows = [(1, t // 2, ("user", "assistant", "system")[t % 7 % 3], TEXTS[t % 11]) for t in range(3000)] + [(1, 9, "user", "again.")] * 500
    frame = table(spark, rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments, _ = c.solve(frame.select("conv_id", "turn", "role", "text"), 200)
        assert segments.where("audit <> ''").select((segments["sid"] / 2**32).cast("int")).distinct().count() > 1
        assert got(c.repair_report(frame, frame.select("conv_id", "turn", "role", "text"), 200)) == report(rows, programmed)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "." * 1_000_000 + " " * 500_000), (1, 2, "user", " " * 500_000)]
    frame = table(spark, rows)
    assert got(c.repair_report(frame, frame.select("conv_id", "turn", "role", "text"))) == report(rows, programmed)
