"""Conversation structure repair by signature deduplication (operator 13).

A row is at fault when it is blank, repeats an earlier row's role and text, or ends without a
sentence mark (the first of these counts). A conversation becomes a string with one character
a row: its role's initial (o for any other), capital if it is cut off, x if it must go. Most
conversations share such a signature, so each distinct one is solved once: the cheapest edits
that leave the roles ``(s?(ua)+)?``, found by recursion over (row, last role) with a memo. The
audits are joined back, and replayed over the sorted rows, which stream through a task with
one row and one audit in memory.

Edits: K keeps a row (0), R gives it the role that is due (3), D removes it (4), I adds an
empty row of the role that is due (3); a row that is cut off and stays adds 3. The role that
is due follows from the last one, so an audit says all; of equal costs the ASCII-least counts.

Defined cases: null role and text read as one space (such a row is blank, its role is none of
the three); null turns come first, null conv_id is a conversation of its own; rows of one turn
stand by role, then text; a conversation whose rows are all gone has zeros and an empty audit;
other columns are ignored; an empty table gives no rows. A conversation's digest is one
SHA-256 over its texts, which is sequential: a conversation of any size needs one task's
time, but only one of its rows at a time in memory, and its signature, one byte a row.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

FILLED, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Rows of a conversation whose codes are joined in one group before the groups are.
BLOCK = 4096
#: Last role: none yet, s, u, a. Where the role that is due leads, and its name.
_START, _S, _U, _A = range(4)
_DUE = (_U, _U, _A, _U)
_NAME = {_U: "user", _A: "assistant"}
_KEPT = {("s", _START): _S, ("u", _START): _U, ("u", _S): _U, ("u", _A): _U, ("a", _U): _A}
_NEVER = 1 << 60


class Solver:
    """Cheapest edits of one signature, by recursion over (row, last role) with a memo."""

    def __init__(self, signature: str):
        self.codes = signature
        self.memo = array("q", [-1]) * (4 * (len(signature) + 1))

    def steps(self, at: int, last: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost, next row, next role) of what may be done, in ASCII order of the edits."""
        row = self.codes[at : at + 1]
        if row:
            yield "D", 4, at + 1, last
        yield "I", 3, at, _DUE[last]
        if row and row != "x":
            more = 3 if row.isupper() else 0
            if (row.lower(), last) in _KEPT:
                yield "K", more, at + 1, _KEPT[row.lower(), last]
            yield "R", 3 + more, at + 1, _DUE[last]

    def taking(self, at: int, last: int) -> int:
        """Least cost when the next edit takes row ``at`` (or the conversation ends)."""
        i = 4 * at + last
        if self.memo[i] < 0:
            if at == len(self.codes):
                self.memo[i] = 0 if last in (_START, _A) else _NEVER
            else:
                self.memo[i] = min(c + self.least(to, role) for e, c, to, role in self.steps(at, last) if e != "I")
        return self.memo[i]

    def least(self, at: int, last: int) -> int:
        """Least cost from row ``at``: a third insertion in a row would only close a circle."""
        one = _DUE[last]
        return min(self.taking(at, last), 3 + self.taking(at, one), 6 + self.taking(at, _DUE[one]))

    def solve(self) -> tuple[int, str]:
        for at in range(len(self.codes), -1, -1):  # the memo is filled from the end, so no recursion goes deep
            for last in range(4):
                self.taking(at, last)
        at, last, audit = 0, _START, []
        left = cost = self.least(0, _START)
        while at < len(self.codes) or last not in (_START, _A):
            edit, paid, at, last = next(s for s in self.steps(at, last) if s[1] + self.least(s[2], s[3]) == left)
            left -= paid
            audit.append(edit)
        return cost, "".join(audit)


def _solved(batches):
    for batch in batches:
        found = [Solver(s).solve() for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text, gone): the rows as crc32(conv_id:turn) % 20 damages
    them; dropped rows stay, marked as gone, so that every conversation keeps its id."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", copies.alias("copy"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"))


def coded(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, and perhaps copy, gone) with their place (at, from 1) in
    the conversation, fault, signature code, and whether the role may not follow the one before."""
    extra = [c for c in (("copy", F.lit(0)), ("gone", F.lit(False))) if c[0] not in rows.columns]
    rows = rows.withColumns({**dict(extra), "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    turn = F.col("turn").asc_nulls_first()
    by = Window.partitionBy("conv_id", "gone").orderBy(turn, "role", "text", "copy")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(turn, "copy")) > 1
    fault = F.when(~F.col("text").rlike(FILLED), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    first = F.substring("role", 1, 1)
    pair = F.concat(F.lag(first).over(by), first)
    rows = rows.withColumn("again", again).withColumn("fault", fault)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.when(first.isin("s", "u", "a"), first).otherwise("o"))
    rows = rows.withColumns({
        "at": F.row_number().over(by).cast("long"),
        "code": F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code),
        "illegal": (F.row_number().over(by) > 1) & ~F.coalesce(pair.isin("su", "ua", "au"), F.lit(False)),
        "fresh": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(by)),
    })
    return rows.select("conv_id", "turn", "at", "role", "text", "gone", "fault", "code", "illegal", "fresh")


def _count(cond) -> F.Column:
    return F.count(F.when(cond, 1))


def _joined(parts: str, order: str, value: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), "").alias(parts)


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``coded`` rows: gaps, faults, illegal pairs, signature. Codes
    are joined in blocks of rows first, so a long conversation is no single group of rows."""
    here = ~F.col("gone")
    shown = F.when(here, F.col("turn"))
    own = rows.withColumn("code", F.when(here, F.col("code")).otherwise("")).withColumn("block", F.floor(F.col("at") / BLOCK))
    sums = {"blank": F.col("fault") == "blank", "duplicate": F.col("fault") == "duplicate", "truncated": F.col("fault") == "truncated", "illegal": F.col("illegal"), "turns": F.col("fresh")}
    blocks = own.groupBy("conv_id", "gone", "block").agg(*[_count(here & c).alias(k) for k, c in sums.items()], F.min(shown).alias("lo"), F.max(shown).alias("hi"), _joined("part", "at", "code"))
    per = blocks.groupBy("conv_id").agg(*[F.sum(k).alias(k) for k in sums], F.min("lo").alias("lo"), F.max("hi").alias("hi"), _joined("signature", "block", "part"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return per.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "signature")


def audits(per: DataFrame) -> DataFrame:
    """``signatures`` with cost and audit: each distinct signature is solved once."""
    solved = per.select("signature").distinct().mapInArrow(_solved, "signature string, cost long, audit string")
    return per.join(cut(solved, "solved"), "signature")


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _replay(batches) -> Iterator[tuple]:
    """For each conversation in the stream: its head, then (edit, role, text) of what is left.
    The head carries the audit and comes before the conversation's rows."""
    parts, last, rows, tail = iter(()), _START, 0, 0

    def due(edit: str):
        nonlocal last
        last = _DUE[last]
        return edit, _NAME[last], ""

    for batch in batches:
        for conv_id, at, role, text, *stats in zip(*(c.to_pylist() for c in batch.columns)):
            if at == 0:
                audit = stats[-1]
                body = audit.rstrip("I")
                parts, last, rows, tail = re.finditer("I*[DKR]", body), _START, len(body) - body.count("I"), len(audit) - len(body)
                yield conv_id, stats, None
            else:
                rows -= 1
                part = next(parts)[0]
                for _ in range(len(part) - 1):
                    yield conv_id, None, due("I")
                if part[-1] == "K":
                    last = _KEPT[role[:1], last]
                    yield conv_id, None, ("K", role, text)
                elif part[-1] == "R":
                    yield conv_id, None, (*due("R")[:2], text)
            if rows == 0:  # the last row is done, or there is none
                for _ in range(tail):
                    yield conv_id, None, due("I")


def _digests(batches):
    """A row per conversation: the head's figures and the digest of what is left."""
    done: list[tuple] = []
    head = digest = None
    for conv_id, stats, row in _replay(batches):
        if stats is not None:
            if head:
                done.append((*head, digest.hexdigest()))
            head, digest, sep = (conv_id, *stats), hashlib.sha256(), b""
            if len(done) >= 1000:
                yield done
                done = []
        else:
            digest.update(sep + f"{row[1]}:{row[2]}".encode())
            sep = b"\n"
    if head:
        done.append((*head, digest.hexdigest()))
    yield done


def _streamed(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Heads and rows of each conversation, in order, in one partition."""
    heads = per.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *_STATS)
    rows = rows.where(~F.col("gone")).select("conv_id", "at", "role", "text", *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in _STATS])
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at")


@tidy
def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation of ``rows`` (conv_id, turn, role, text, and perhaps copy, gone)."""
    rows = cut(coded(rows), "coded")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_STATS, "repaired_sha256"]
    stream = _streamed(rows, cut(audits(signatures(rows)), "audits"))
    arrow = pa.schema([("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        kinds = None

        def seen():
            nonlocal kinds
            for batch in batches:
                kinds = kinds or [batch.schema.field(0).type, *arrow.types]
                yield batch

        for done in _digests(seen()):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names)

    return stream.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


@tidy
def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at (from 1), role, text, edit (K, R or I)."""
    rows = cut(coded(rows), "coded")
    kind = rows.schema["conv_id"].dataType.simpleString()
    stream = _streamed(rows, cut(audits(signatures(rows)), "audits"))

    def run(batches):
        kind = None

        def seen():
            nonlocal kind
            for batch in batches:
                kind = kind or batch.schema.field(0).type
                yield batch

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "at", "role", "text", "edit"])

        out, at = [], 0
        for conv_id, stats, row in _replay(seen()):
            if stats is not None:
                at = 0
                continue
            at += 1
            out.append((conv_id, at, row[1], row[2], row[0]))
            if len(out) >= 1000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    return stream.mapInArrow(run, f"conv_id {kind}, at long, role string, text string, edit string")
