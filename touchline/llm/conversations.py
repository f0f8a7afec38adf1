"""Conversation structure repair (operator 13): the cheapest edits that make a conversation well formed.

Well formed is an optional system turn and then pairs of a user's and an assistant's turn, or nothing:
``(s?(ua)+)?`` in the roles' initials.  A turn is kept (0), given another role (2) or deleted (3; blank and
repeated turns must be); empty turns may be inserted anywhere (2); a truncated turn that stays adds 1.

A forward Viterbi pass goes through a conversation's turns in order.  Its four states are what the last turn
was: nothing, system, user, assistant.  Each carries its cheapest way there: the cost, the audit string of the
edits' initials (of equal costs the least in ASCII) and the digest of the repaired text so far.  After each
turn the layer is closed under insertions, of which two suffice: one leads from any state to a user's turn, a
second to an assistant's.  Two ways of one cost into one state end in the same number of turns, so neither
audit is the beginning of the other and the lesser one stays the lesser.

Turns reach the pass sorted, by Spark's own shuffle and sort; what has been seen earlier is marked there as
well.  The pass holds four ways and no turns; ways share their beginning sooner or later and what they share
is put aside, so a long conversation needs memory for its audit string only.  A conversation is read by one
task, as a digest of its whole text has no parallel form; it streams through.

Edge cases: null roles and texts are one blank, null turns come first; turns of one number are ordered by role
and text; null conv_ids are one conversation; repeated rows are repeated turns; conversations that lose all
turns have zeros, an empty audit and the digest of nothing; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_batches

#: Costs of edits, what a turn that breaks off adds, transitions that are well formed.
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: State after a turn of a role, by the state before: a system's turn only at the beginning.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after a fixed damage by a hash of conversation and turn; rows
    that were dropped are marked ``gone``, so their conversation is still known."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(key) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    role = F.when(hit == 4, F.lit("user")).otherwise(role)
    text = F.when(hit == 0, F.lit("")).when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("gone"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``fault``, the first of blank, duplicate and truncated that holds, else 0; null for gone ones.
    Partitioned by conversation, and sorted inside."""
    ends = F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    some = F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    seen = rows.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(F.col("gone"), None).when(~some, BLANK).when(F.col("again"), DUPLICATE).when(~ends, TRUNCATED).otherwise(0)
    order = ["gone", F.asc_nulls_first("turn"), "role", "text", "again"]
    return seen.withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), *order).select("conv_id", "turn", "role", "text", "fault")


class Way(NamedTuple):
    """A way into a state; the least is the cheapest, of equally cheap ones the one with the least audit."""

    cost: int
    audit: str
    text: object  # a running digest of the repaired turns

    def turn(self, cost: int, edit: str, role: str, text: str) -> Way:
        digest = self.text.copy()
        digest.update(f"{chr(10) if digest.turns else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        digest.turns += 1
        return Way(self.cost + cost, self.audit + edit, digest)


class Digest:
    """SHA-256 of what was added, and how many turns that were."""

    __slots__ = ("hash", "turns")

    def __init__(self, hash=None, turns: int = 0):
        self.hash, self.turns = hash or hashlib.sha256(), turns

    def copy(self) -> Digest:
        return Digest(self.hash.copy(), self.turns)

    def update(self, data: bytes) -> None:
        self.hash.update(data)


class Repair:
    """The pass over one conversation: ``add`` its turns in order, then ``result``."""

    def __init__(self):
        self.counts = [0, 0, 0, 0]
        self.low = self.high = None
        self.distinct = self.illegal = 0
        self.before: str | None = None
        self.agreed: list[str] = []  # beginnings of the audit that all ways share
        self.ways: list[Way | None] = [Way(0, "", Digest()), None, None, None]
        self._close(self.ways)

    @staticmethod
    def _offer(layer: list[Way | None], state: int, way: Way) -> None:
        if layer[state] is None or way[:2] < layer[state][:2]:
            layer[state] = way

    def _close(self, layer: list[Way | None]) -> None:
        """Insertions: to a user's turn from any other state, then from it to an assistant's."""
        for to, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for state in sources:
                if layer[state] is not None and (layer[to] is None or layer[state].cost + INSERT <= layer[to].cost):
                    self._offer(layer, to, layer[state].turn(INSERT, "I", ROLES[to], ""))

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        layer: list[Way | None] = [None] * 4
        extra = BROKEN if fault == TRUNCATED else 0
        for state, way in enumerate(self.ways):
            if way is None:
                continue
            self._offer(layer, state, Way(way.cost + DELETE, way.audit + "D", way.text))
            if fault in (BLANK, DUPLICATE):
                continue
            to = AFTER.get(initial, {}).get(state)
            if to is not None:
                self._try(layer, to, way, extra, "K", role, text)
            for to, name in ROLES.items():
                if AFTER[name[0]].get(state) == to:
                    self._try(layer, to, way, REROLE + extra, "R", name, text)
        self._close(layer)
        # A turn that could only begin a conversation can be deleted instead, for 3; else the state after an
        # assistant's turn can go on as those two can.  What is dearer than that is never the cheapest way.
        cost = layer[ASSISTANT].cost
        for state, most in ((NOTHING, cost + DELETE), (SYSTEM, cost)):
            if layer[state] is not None and layer[state].cost > most:
                layer[state] = None
        self.ways = layer
        if sum(self.counts) % 256 == 0:
            self._agree()

    def _try(self, layer, to: int, way: Way, cost: int, edit: str, role: str, text: str) -> None:
        best = layer[to]
        if best is None or (way.cost + cost, way.audit + edit) < best[:2]:
            layer[to] = way.turn(cost, edit, role, text)

    def _agree(self) -> None:
        same = commonprefix([w.audit for w in self.ways if w is not None])
        self.agreed.append(same)
        self.ways = [w and w._replace(audit=w.audit[len(same) :]) for w in self.ways]

    def result(self) -> tuple:
        best = min((w for w in (self.ways[NOTHING], self.ways[ASSISTANT]) if w is not None), key=lambda w: w[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *self.counts[1:], self.illegal, best.cost, "".join(self.agreed) + best.audit, best.text.hash.hexdigest())


def repair(rows: DataFrame) -> DataFrame:
    """The repair of each conversation of rows (conv_id, turn, role, text, gone)."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches):
        schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
        now, held, done = None, None, []
        for batch in batches:
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv != now:
                    if held is not None:
                        done.append((now, *held.result()))
                    now, held = conv, Repair()
                if fault is not None:
                    held.add(turn, role, text, fault)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if held is not None:
            done.append((now, *held.result()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return text_batches(faults(rows)).mapInArrow(run, RESULT)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations.select("conv_id", "turn", "role", "text")))
