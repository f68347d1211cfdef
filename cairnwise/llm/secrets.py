"""Secret scanning with built-in functions only.

Three fixed patterns give the base spans. Besides, every candidate string (a
long run of key-like characters) is scanned by a sliding window; the window's
character counts are updated incrementally and give its Shannon entropy and its
character class, whose threshold it has to reach. So a key behind a name or a
path is judged by the windows inside it. Windows that overlap a match of an
allow list are suppressed. The work grows with the length of a candidate.
Everything runs in the scan stage: no shuffle and no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base patterns. Greedy runs that are too short are dropped afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidates of the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits of a window, by class; digits alone are never a secret.
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
#: What looks random but is no secret.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?i)abcdefghijklmnop|0123456789abcdef|example|placeholder|your[_-]",
)
#: Order of the kinds in lists of spans.
KINDS = ("assign", "access", "hex", "entropy")

#: Stands for the characters of an allowed match; the code point behind those of candidates.
MASK = "{"
_FIRST, _SYMBOLS = 43, 81  # code points 43 to 122, and the mask

_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _located(text: Column, pattern: str) -> Column:
    """All matches with their code point offsets: array<struct<start, stop, found>>.

    The pieces between matches and the matches alternate, so offsets are
    running sums of their lengths.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    start = F.struct(
        F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,found:string>>)").alias("out")
    )
    parts = F.arrays_zip(pieces.alias("piece"), found.alias("hit"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["piece"])
        end = begin + F.length(F.coalesce(part["hit"], F.lit("")))
        one = F.struct(begin.alias("start"), end.alias("stop"), part["hit"].alias("found"))
        return F.struct(
            end.alias("at"),
            F.when(part["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _as_spans(located: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.transform(
        located, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["stop"].alias("stop"))
    )


def _masked(candidate: Column, pattern: str) -> Column:
    """The candidate with every character of a match replaced by ``MASK``."""
    parts = F.arrays_zip(
        F.split(candidate, pattern, -1).alias("piece"), F.regexp_extract_all(candidate, F.lit(pattern), 0).alias("hit")
    )
    joined = F.transform(parts, lambda p: F.concat(p["piece"], F.repeat(F.lit(MASK), F.length(F.coalesce(p["hit"], F.lit(""))))))
    return F.when(candidate.rlike(pattern), F.array_join(joined, "")).otherwise(candidate)


def _hot_windows(candidate: Column, window: int) -> Column:
    """Merged spans of the candidate's windows whose entropy reaches the threshold of their class.

    With counts c of the window's characters the entropy is
    log2(w) - sum(c log2 c) / w; a step changes two counts and two terms. The
    window's masked characters, its letters, and those that are not hexadecimal are counted as well.
    """
    chars = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - _FIRST)
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)
    code = lambda c: ord(c) - _FIRST
    between = lambda c, low, high: c.between(code(low), code(high))
    letter = lambda c: F.when(between(c, "0", "9"), 0).otherwise(1)
    other = lambda c: F.when(between(c, "0", "9") | between(c, "A", "F") | between(c, "a", "f"), 0).otherwise(1)
    masked = lambda c: F.when(c == code(MASK), 1).otherwise(0)
    start = F.struct(
        F.array_repeat(F.lit(0), _SYMBOLS).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(0).alias("at"),
        F.lit(0).alias("letters"),
        F.lit(0).alias("others"),
        F.lit(0).alias("masks"),
        F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("out"),
    )
    # Each character beside the one that leaves the window when it comes: the same array, shifted.
    shifted = F.concat(F.array_repeat(F.lit(None).cast("int"), window), chars)
    steps = F.slice(F.arrays_zip(chars.alias("into"), shifted.alias("away")), 1, F.length(candidate))

    def put(counts: Column, place: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), place), F.array(value), F.slice(counts, place + 2, F.lit(_SYMBOLS)))

    def step(acc: Column, x: Column) -> Column:
        leaves = x["away"].isNotNull()
        gone = F.get(acc["counts"], x["away"])
        less = F.when(leaves, term(gone) - term(gone - 1)).otherwise(0.0)
        left = F.when(leaves, put(acc["counts"], x["away"], gone - 1)).otherwise(acc["counts"])
        come = F.get(acc["counts"], x["into"]) - F.when(leaves & (x["away"] == x["into"]), 1).otherwise(0)
        total = acc["total"] - less + term(come + 1) - term(come)
        net = lambda f: f(x["into"]) - F.when(leaves, f(x["away"])).otherwise(0)
        at = acc["at"] + 1
        letters, others, masks = acc["letters"] + net(letter), acc["others"] + net(other), acc["masks"] + net(masked)
        least = F.when(letters == 0, 99.0).when(others == 0, THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"])
        hot = (at >= window) & (masks == 0) & (F.round(F.lit(math.log2(window)) - total / window, 6) >= least)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        one = lambda begin: F.array(F.struct(begin.alias("start"), at.alias("stop")))
        out = (
            F.when(~hot, acc["out"])
            .when(last["stop"] >= at - window, F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), one(last["start"])))
            .otherwise(F.concat(acc["out"], one(at - window)))
        )
        return F.struct(
            put(left, x["into"], come + 1).alias("counts"),
            total.alias("total"),
            at.alias("at"),
            letters.alias("letters"),
            others.alias("others"),
            masks.alias("masks"),
            out.alias("out"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def secret_spans(text: Column, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<start, kind, stop>> of one text, sorted; ``kind`` indexes KINDS."""
    assign = F.when(
        text.rlike(ASSIGN),
        _as_spans(
            F.filter(_located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_LEAST),
            "assign",
        ),
    ).otherwise(_none())
    access = F.when(text.contains("AKIA"), _as_spans(_located(text, ACCESS), "access")).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _as_spans(_located(text, HEX), "hex")).otherwise(_none())
    shown = lambda c: _masked(c, "|".join(f"(?:{p})" for p in allowed)) if allowed else c
    entropy = F.when(
        text.rlike(CANDIDATE),
        F.flatten(
            F.transform(
                F.transform(_located(text, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), shown(x["found"]).alias("found"))),
                lambda x: F.transform(
                    _hot_windows(x["found"], window),
                    lambda s: F.struct(
                        (x["start"] + s["start"]).alias("start"),
                        F.lit(KINDS.index("entropy")).alias("kind"),
                        (x["start"] + s["stop"]).alias("stop"),
                    ),
                ),
            )
        ),
    ).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes, entropy))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, spans`` (see :func:`secret_spans`).

    A null text counts as empty and has no spans; a null id stays null; repeated
    rows give repeated results; other columns are not read. An assign span
    covers the whole match, from the key word to the end of the value.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text")).select(
        "doc_id", secret_spans(F.col("text"), **options).alias("spans")
    )
