"""Conversation structure repair by dynamic programming over the turns that stay.

Roles must begin as ``(s?(ua)+)?`` (system, user, assistant). A turn is kept, given another role or deleted, and empty turns may be
inserted, at the least cost. A state is a turn that stays and the role it has then; between two such turns lie deletions, priced by
prefix sums, and insertions, which the two roles determine. So the best continuation is a minimum over later turns that only the state's role and a
running minimum for each role decide; one pass from the end finds them all, in time linear in the turns. Among equal costs the least audit (the edits'
initials, D < I < K < R) wins: more deletions first, then more insertions, then keeping before another role.

Turns are ordered by turn (nulls first), then role and text. A conversation is repaired as a whole by one task, which streams over its sorted
partition and holds one conversation at a time. Defined results: null roles and texts count as one blank; an empty role can't be kept; rows
without conv_id are one conversation; a conversation without rows has an empty audit; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}
#: What must be inserted between two roles; "^" and "$" are the ends. A pair that isn't here can't be.
BETWEEN = {
    "^u": "", "^a": "u", "^s": "", "^$": "", "su": "", "sa": "u", "s$": "ua",
    "ua": "", "uu": "a", "u$": "a", "au": "", "aa": "u", "a$": "",
}
_AFTER = {p: [(q, len(x), x) for (o, q), x in BETWEEN.items() if o == p] for p in "^sua"}


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each turn's first fault: blank, duplicate, truncated, or nothing."""
    out, seen = [], set()
    for row in rows:
        said = row[1].strip(BLANKS)
        out.append("blank" if not said else "duplicate" if row in seen else "" if said[-1] in ENDS else "truncated")
        seen.add(row)
    return out


def plan(initials: list[str], found: list[str]) -> tuple[int, list[tuple[str, int, str]]]:
    """The cost and the edits in order: (D, turn, ""), (I, -1, role initial), (K or R, turn, role initial)."""
    n = len(initials)
    # of each role: the least of 2 * (turns before) + own cost + what follows, and its turn; of equals the last turn
    best: dict[str, tuple[int, int]] = {"$": (DELETE * n, n)}
    follow: list[dict[str, tuple[str, int]]] = [{} for _ in range(n + 1)]

    def cheapest(role: str, after: int) -> tuple[int, tuple[str, int]]:
        """The cost of all that comes after a turn that stays, and the next state."""
        options = []
        for q, k, _ in _AFTER[role]:
            if q in best:
                total, at = best[q]
                kept = q == "$" or initials[at] == q
                options.append((total - DELETE * (after + 1) + INSERT * k, -at, -k, not kept, q))
        cost, at, _, _, q = min(options)
        return cost, (q, -at)

    for j in range(n - 1, -1, -1):
        if found[j] in ("blank", "duplicate"):
            continue
        own = TRUNCATED if found[j] else 0
        new = {}
        for q in "uas" if initials[j] == "s" else "ua":
            rest, follow[j][q] = cheapest(q, j)
            new[q] = DELETE * j + own + (0 if initials[j] == q else REROLE) + rest
        for q, total in new.items():
            if q not in best or total < best[q][0]:
                best[q] = total, j
    cost, step = cheapest("^", -1)
    edits: list[tuple[str, int, str]] = []
    role, at = "^", -1
    while True:
        q, j = step
        edits += [("D", i, "") for i in range(at + 1, j)]
        edits += [("I", -1, x) for x in BETWEEN[role + q]]
        if q == "$":
            return cost, edits
        edits.append(("K" if initials[j] == q else "R", j, q))
        role, at, step = q, j, follow[j][q]


def repaired(rows: list[tuple[str, str]], found: list[str]) -> tuple[int, str, list[dict[str, str]]]:
    """Cost, audit and the turns as they are then."""
    cost, edits = plan([r[:1] for r, _ in rows], found)
    turns = [
        {"role": ROLES[x], "text": ""} if e == "I" else {"role": rows[i][0] if e == "K" else ROLES[x], "text": rows[i][1]}
        for e, i, x in edits if e != "D"
    ]
    return cost, "".join(e for e, _, _ in edits), turns


_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
_LEGAL = {"su", "ua", "au"}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted batches conv_id, present, turn, role, text."""
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = [pa.int64()] * 7 + [pa.string(), turns]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    out: list[tuple] = []
    size = 0
    for conv, own in groupby(_rows(batches), key=lambda r: r[0]):
        own = [r for r in own if r[1]]
        rows, numbers = [(r[3], r[4]) for r in own], [r[2] for r in own if r[2] is not None]
        found = faults(rows)
        cost, audit, kept = repaired(rows, found)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, kept))
        size += sum(len(t["text"]) for t in kept)
        if len(out) >= 1000 or size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, the turns (role, text) in order.

    ``present``: of the columns of ``conversations``; rows where it is false only name their conversation."""
    here = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", here.alias("present"), "turn", blank("role"), blank("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "present", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(_repair, _SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with known faults, by a checksum of ``conv_id:turn``: of twenty rows one is dropped (present: false), one emptied, one loses its
    sentence ends, one comes twice, one is the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), f"[{ENDS}]", "")).otherwise(blank("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")
