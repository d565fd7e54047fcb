"""Conversation structure repair: the cheapest keeps, reroles, deletions and insertions that give turns in order.

A repaired conversation is empty, or an optional system turn and then pairs of
user and assistant. The retained turns are a subsequence of the logged ones, so
the cost of a repair is that of its retained turns and of the gaps between
them: in a gap turns are deleted, which prefix sums price, and turns are
inserted, whose number the roles on both sides determine. From the end of the
conversation on, the least over all next retained turns of a role is a running
minimum, so each turn costs a constant number of steps. Of the cheapest repairs
the one with the least string of edits is read off from the front: the least
edit that keeps the cost is taken each time.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserted turns between a retained role and the next one; a pair that isn't listed can't be mended by insertions.
BETWEEN = {START: {SYSTEM: 0, USER: 0, ASSISTANT: 1}, SYSTEM: {USER: 0, ASSISTANT: 1}, USER: {USER: 1, ASSISTANT: 0}, ASSISTANT: {USER: 0, ASSISTANT: 1}}
#: Inserted turns after the last retained role.
AFTER = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: What an insertion after a role adds.
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}

#: Bytes of a conversation's texts that are held in memory; what is more waits in a temporary file that goes with the conversation.
HELD_BYTES = 32 << 20
FLUSH_ROWS = 4096
FLUSH_BYTES = 8 << 20

_BLANKS = " \t\n\v\f\r"


def cheapest(turns: list[tuple[int, bool, bool]]) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of turns (role, whether it must go, whether it is cut short); of equals, that of the least edits."""
    n = len(turns)
    rest = [[0] * (n + 1) for _ in range(4)]
    least = dict.fromkeys((SYSTEM, USER, ASSISTANT), float("inf"))
    for j in range(n, -1, -1):
        if j < n:
            role, must_go, short = turns[j]
            if not must_go:
                for kept in least:
                    if kept == role or kept in ROLES:
                        price = (0 if kept == role else REROLE) + CUT_SHORT * short
                        least[kept] = min(least[kept], DELETE * j + price + rest[kept][j + 1])
        for before, follow in BETWEEN.items():
            gap = min([DELETE * n + INSERT * AFTER[before], *[INSERT * k + least[kept] for kept, k in follow.items()]])
            rest[before][j] = gap - DELETE * j
    out, at, j = [], START, 0
    while j < n or rest[at][j]:
        left = rest[at][j]
        if j < n and left == DELETE + rest[at][j + 1]:
            out.append("D")
            j += 1
            continue
        if left == INSERT + rest[ADDED[at]][j]:
            out.append("I")
            at = ADDED[at]
            continue
        role, _, short = turns[j]
        fits = [kept for kept, k in BETWEEN[at].items() if k == 0]
        if role in fits and left == CUT_SHORT * short + rest[role][j + 1]:
            out.append("K")
            at = role
        else:
            out.append("R")
            at = next(kept for kept in fits if kept in ROLES and left == REROLE + CUT_SHORT * short + rest[kept][j + 1])
        j += 1
    return rest[START][0], "".join(out)


class Conversation:
    """One conversation's turns in order: flags and counts in memory, texts in a spooled file, and what repairs them."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.turns: list[tuple[int, bool, bool]] = []
        self.seen: set[bytes] = set()
        self.texts = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)  # noqa: SIM115
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = None
        self.different = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.different += turn != self.last
            self.last = turn
        whole = f"{role}\0{text}".encode()
        key = blake2b(whole, digest_size=16).digest()
        solid = text.rstrip(_BLANKS)
        short = bool(solid) and solid[-1] not in ".!?"
        fault = "blank" if not solid else "duplicate" if key in self.seen else "truncated" if short else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        self.seen.add(key)
        self.turns.append((OF_INITIAL.get(initial, -1), fault in ("blank", "duplicate"), short))
        r, t = role.encode(), text.encode()
        self.texts.write(struct.pack("<QQ", len(r), len(t)) + r + t)

    def repaired(self, edits: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that edits leave."""
        self.texts.seek(0)
        at = START
        for edit in edits:
            if edit == "I":
                at = ADDED[at]
                yield edit, ROLES[at], ""
                continue
            r, t = struct.unpack("<QQ", self.texts.read(16))
            role, text = self.texts.read(r).decode(), self.texts.read(t).decode()
            if edit == "D":
                continue
            at = OF_INITIAL[role[0]] if edit == "K" else USER if at != USER else ASSISTANT
            yield edit, role if edit == "K" else ROLES[at], text

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.different


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """The conversations of rows (conv_id, turn, role, text, times) sorted by the first four."""
    now: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, times in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now
                    now.texts.close()
                now = Conversation(conv_id)
            for _ in range(times):
                now.add(turn, role, text)
    if now is not None:
        yield now
        now.texts.close()


def _in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition and in order, with nulls as the docstring of report() has them."""
    times = F.col("times").cast("int") if "times" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], times.alias("times"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def damaged(turns: DataFrame) -> DataFrame:
    """turns with known damage, as a test of repair(): times says how often a row is there, 0 for one that is dropped.

    The CRC-32 of conv_id:turn (a null is one space), modulo 20, drops the row
    (0), empties its text (1), removes its full stops, exclamation and question
    marks (2), repeats it (3), makes its role user (4) or leaves it (else). A
    null role or text is one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of turns(conv_id, turn, role, text).

    An optional column times says how often each row is there; a conversation
    all whose rows are there no times has zeros, no edits and the hash of the
    empty string. Turns are in order of turn, nulls first, then role and text,
    so rows that are equal in all are next to each other. A null role or text
    counts as one space; rows with a null conv_id are one conversation; a role
    that starts with none of s, u, a can be deleted or reroled only. A turn is
    blank without a character other than the six blanks, a duplicate if role and
    text came before, and cut short if its last such character ends no sentence;
    only the first of these counts. Other columns are ignored; no rows give no
    rows.

    One shuffle brings a conversation's turns together in order; as its result
    is one hash over its turns, a conversation is one task's pass, whatever its
    length. Of it a task holds a few numbers for each turn and HELD_BYTES of
    text; longer texts wait in a temporary file of the task, which it deletes.
    """
    kind = turns.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for c in _conversations(batches):
            cost, edits = cheapest(c.turns)
            digest, between = hashlib.sha256(), b""
            for _, role, text in c.repaired(edits):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            rows.append((c.conv_id, c.gaps(), *c.counts.values(), cost, edits, digest.hexdigest()))
            if len(rows) >= FLUSH_ROWS:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    return _in_order(turns).mapInArrow(run, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each repaired conversation from 1 on, with how each came about (K, R or I).

    Rules, nulls and memory are those of report(); a conversation that is
    repaired to nothing has no rows.
    """
    schema = StructType([StructField("conv_id", turns.schema["conv_id"].dataType), StructField("place", LongType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for c in _conversations(batches):
            _, edits = cheapest(c.turns)
            for place, (edit, role, text) in enumerate(c.repaired(edits), 1):
                rows.append((c.conv_id, place, edit, role, text))
                held += len(text)
                if held >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, arrow)

    return _in_order(turns).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _moved(state: str, cost: str, edit: str, turn: str) -> str:
    return f"struct_pack(c := {state}.c + {cost}, x := {state}.x || '{edit}', t := {state}.t || {turn})"


def _inserted(state: str, role: str) -> str:
    return _moved(state, str(INSERT), "I", f"chr(10) || '{role}:'")


def _oracle() -> str:
    """The repair read from the front: after each turn, the cheapest way to each last role, with all edits and texts written out."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda h, i: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)), 4294967295)"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    never = "struct_pack(c := 1000000000::BIGINT, x := '~', t := '')"
    short = f"{CUT_SHORT} * n.short::INTEGER"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j,
      rtrim(text, {blanks}) AS solid, left(role, 1) AS initial FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 AS again FROM o),
n AS (SELECT *, solid = '' OR again AS must_go, solid <> '' AND right(solid, 1) NOT IN ('.', '!', '?') AS short, chr(10) || role || ':' || text AS line,
      lag(initial) OVER (PARTITION BY conv_id ORDER BY j) || initial AS pair FROM r),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (solid = '') AS blank, count(*) FILTER (solid <> '' AND again) AS duplicate,
      count(*) FILTER (NOT must_go AND short) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY conv_id),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS j, struct_pack(c := 0::BIGINT, x := '', t := '') AS b, {never} AS s, {never} AS u, {never} AS a FROM conversations
  UNION ALL
  SELECT conv_id, j, b, s, u, a FROM (
    SELECT w.conv_id, n.j, {_moved('w.b', str(DELETE), 'D', "''")} AS b,
      least({_moved('w.s', str(DELETE), 'D', "''")}, CASE WHEN NOT n.must_go AND n.initial = 's' THEN {_moved('w.b', short, 'K', 'n.line')} ELSE {never} END) AS s,
      least({_moved('w.u', str(DELETE), 'D', "''")}, CASE WHEN NOT n.must_go AND n.initial = 'u' THEN {_moved('w.to_u', short, 'K', 'n.line')} ELSE {never} END,
            CASE WHEN NOT n.must_go THEN {_moved('w.to_u', f"{REROLE} + {short}", 'R', "chr(10) || 'user:' || n.text")} ELSE {never} END) AS u,
      least({_moved('w.a', str(DELETE), 'D', "''")}, CASE WHEN NOT n.must_go AND n.initial = 'a' THEN {_moved('w.u', short, 'K', 'n.line')} ELSE {never} END,
            CASE WHEN NOT n.must_go THEN {_moved('w.u', f"{REROLE} + {short}", 'R', "chr(10) || 'assistant:' || n.text")} ELSE {never} END) AS a
    FROM (SELECT *, least(b, s, a) AS to_u FROM (SELECT conv_id, j, b, s, u, least(a, {_inserted('u', 'assistant')}) AS a FROM (
            SELECT conv_id, j, b, s, least(u, {_inserted('b', 'user')}, {_inserted('s', 'user')}, {_inserted('a', 'user')}) AS u, a FROM w))) AS w
    JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.j = w.j + 1)),
e AS (SELECT conv_id, j, least(b, a, {_inserted('u2', 'assistant')}) AS best FROM (SELECT *, least(u, {_inserted('s', 'user')}) AS u2 FROM w))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.x AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM e LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.j = coalesce(counts.n, 0)
"""


ORACLE = _oracle()
