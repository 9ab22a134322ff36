"""Conversation structure repair by scalar big-integer weights (operator 13).

A conversation is well formed when the initials of its roles spell ``(s?(ua)+)?``.  The
cheapest edits that make it so are the shortest path through a layered graph of row and
grammar state.  A path's weight is one integer,

    cost << 3 * width  |  audit

whose high digits are the cost and whose ``width`` low digits of three bits are the audit
letters by position, D = 1, I = 2, K = 3, R = 4, padded with zeros at the end.  The zero
is below every letter and the letters stand in ASCII order, so the least integer is the
cheapest path and, among those, the one with the ASCII-least audit: plain integer minima
decide everything.  The graph is walked from its end; an edge puts its letter before the
audit of the rest, which moves the rest one place down.  State and letter determine the
new role, so the repaired turns follow from the audit alone.

The edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows can
only be deleted), Insert an empty user or assistant turn 5; a truncated row that stays
adds 5.  Two inserts at a place reach every state; a third is never needed.

Skew.  Ordinary conversations are hashed by id, sorted and streamed, one shuffle in all.
One of more than ``long_rows`` rows or ``long_bytes`` bytes would be a hot key: its rows
get positions by a restarting count over range partitions, blocks of ``BLOCK`` rows become
4 x 4 matrices of weights (from state, to state), and the matrices are multiplied in a
tree.  Two paths over the same rows and of the same cost never are prefixes of each other
(the longer one would hold more inserts, hence cost more), so the product is exact.  Only
the audit, a letter for a row, and the digest of the repaired text, which is sequential by
nature and streamed without holding rows, are made in one task.

Defined cases: a null role or text is one space, a null id or turn is a space in the text
that chooses the damage; null ids are one conversation; rows of one turn stand in the order
of role, then text; a role without an initial cannot be kept; an empty table gives an empty
result; repeated rows count as duplicates; a conversation without rows after damage has
zeros, an empty audit and the digest of nothing; extra columns are ignored.  ``repaired`` is
null for the long conversations (their digest is given, their turns would not fit a row).
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from growthlab.functions.ordered import group_positions, materialize
from growthlab.llm.common import BLANKS, shuffle_width, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> initial -> next state.
GRAMMAR = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: State -> the role that an insert or a new role gives there.
NEXT_ROLE = ["user", "user", "assistant", "user"]
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
FINE, BLANK, TRUNCATED, DUPLICATE = range(4)
#: Rows of a block of a long conversation, and blocks that are multiplied in one task.
BLOCK, FAN = 512, 64
#: Ids of long conversations that are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 100_000
FIELDS = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, repaired array<struct<role: string, text: string>>")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, mark, gone): the rows after the planned damage.  A
    dropped row stays with ``gone``, so that its conversation is not lost."""
    text_id = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(text_id) % 20
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "conv_id", "turn", kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("gone", F.col("kind") == 0)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    mark = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "conv_id", "turn", "role", "text", mark.alias("mark"), "gone", F.explode(copies).alias("copy")).drop("copy")


def steps_back(rows: list[tuple[str, int]], ends: list[int | None], width: int) -> list[int | None]:
    """Least weight from each state before ``rows`` (initial, fault) to an end, given the
    weights ``ends`` of the states after them; audits have ``width`` places."""
    bits = 3 * width
    top, low = bits - 3, (1 << bits) - 1

    def edge(rest: int | None, cost: int, letter: int) -> int | None:
        return None if rest is None else ((rest >> bits) + cost) << bits | letter << top | (rest & low) >> 3

    def least(*found: int | None) -> int | None:
        return min((w for w in found if w is not None), default=None)

    def inserted(after: list[int | None]) -> list[int | None]:
        for _ in range(2):
            after = [least(w, edge(after[GRAMMAR[s][NEXT_ROLE[s][0]]], INSERT_COST, INSERT)) for s, w in enumerate(after)]
        return after

    best = inserted(ends)
    for initial, fault in reversed(rows):
        here = []
        for s in range(4):
            ways = [edge(best[s], DELETE_COST, DELETE)]
            if fault in (FINE, TRUNCATED):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                if initial in GRAMMAR[s]:
                    ways.append(edge(best[GRAMMAR[s][initial]], extra, KEEP))
                ways.append(edge(best[GRAMMAR[s][NEXT_ROLE[s][0]]], REROLE_COST + extra, REROLE))
            here.append(least(*ways))
        best = inserted(here)
    return best


def _read(weight: int, width: int) -> tuple[int, str]:
    """(cost, audit) of a weight."""
    digits, letters = weight & ((1 << 3 * width) - 1), []
    for place in range(width - 1, -1, -1):
        digit = digits >> 3 * place & 7
        if not digit:
            break
        letters.append(LETTERS[digit])
    return weight >> 3 * width, "".join(letters)


def _width(n_rows: int) -> int:
    return 3 * n_rows + 2


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows (initial, fault)."""
    width = _width(len(rows))
    return _read(steps_back(rows, [0, None, None, 0], width)[START], width)


class Turns:
    """Follows an audit row by row and yields the repaired (role, text) turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = GRAMMAR[self.state][role[0]]
            yield role, text
        elif letter == "R":
            yield self._new(), text

    def _new(self) -> str:
        role = NEXT_ROLE[self.state]
        self.state = GRAMMAR[self.state][role[0]]
        return role


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def repair(rows: list[tuple[int | None, str, str, int]]) -> tuple:
    """The result columns of one conversation from its ordered (turn, role, text, mark)."""
    seen, faults = set(), []
    for _, role, text, mark in rows:
        faults.append(DUPLICATE if mark != BLANK and (role, text) in seen else mark)
        seen.add((role, text))
    cost, audit = cheapest([(role[:1], fault) for (_, role, _, _), fault in zip(rows, faults)])
    turns = Turns(audit)
    new = [t for _, role, text, _ in rows for t in turns.row(role, text)] + list(turns.inserts())
    known = {t for t, *_ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(not _legal(a[1], b[1]) for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
    return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, digest, new


def _streamed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Conversations from rows sorted by (conv, turn, role, text)."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2 + [turns]
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done)]
        columns[-1] = [[{"role": r, "text": t} for r, t in new] for new in columns[-1]]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def all_rows() -> Iterable[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("conv", "conv_id", "gone", "turn", "role", "text", "mark")))

    held = 0
    for _, rows in itertools.groupby(all_rows(), key=lambda r: r[0]):
        rows = list(rows)
        held += sum(len(r[5]) for r in rows) + 200
        done.append((rows[0][1], *repair([r[3:] for r in rows if not r[2]])))
        if held > 1 << 22:
            yield out()
            held = 0
    if done:
        yield out()


def _matrix(batch: pa.Table) -> pa.Table:
    """One block of a long conversation as 4 x 4 (cost, audit), by state before and after."""
    rows = sorted(zip(batch["pos"].to_pylist(), batch["initial"].to_pylist(), batch["fault"].to_pylist()))
    pairs = [(i, f) for _, i, f in rows]
    width = _width(len(pairs))
    ways: list[list] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        found = steps_back(pairs, [0 if s == end else None for s in range(4)], width)
        for s, w in enumerate(found):
            ways[s][end] = None if w is None else _read(w, width)
    return _part(batch, batch["block"][0].as_py(), ways)


def _part(batch: pa.Table, block: int, ways: list) -> pa.Table:
    return pa.table({"conv": pa.array([batch["conv"][0].as_py()], pa.string()), "block": pa.array([block], pa.int64()),
                     "ways": pa.array([pickle.dumps(ways)], pa.binary())})


def _product(batch: pa.Table) -> pa.Table:
    """The product of the matrices of neighbouring blocks."""
    parts = [pickle.loads(w) for _, w in sorted(zip(batch["block"].to_pylist(), batch["ways"].to_pylist()))]
    total = parts[0]
    for part in parts[1:]:
        total = [[min(((a[0] + b[0], a[1] + b[1]) for a, b in ((total[s][m], part[m][e]) for m in range(4)) if a and b), default=None)
                  for e in range(4)] for s in range(4)]
    return _part(batch, batch["part"][0].as_py(), total)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, cost, audit) of finished products."""
    for batch in batches:
        best = [min(w for w in (pickle.loads(x)[START][START], pickle.loads(x)[START][ASSISTANT]) if w) for x in batch["ways"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"conv": batch["conv"], "cost": pa.array([c for c, _ in best], pa.int64()), "audit": pa.array([a for _, a in best], pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) from rows sorted by (conv, pos); position 0 holds the audit."""
    conv = turns = digest = None
    first = True

    def add(new: Iterable[tuple[str, str]]) -> None:
        nonlocal first
        for role, text in new:
            digest.update((("" if first else "\n") + f"{role}:{text}").encode())
            first = False

    def out() -> pa.RecordBatch:
        add(turns.inserts())
        return pa.RecordBatch.from_pydict({"conv": pa.array([conv], pa.string()), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})

    for batch in batches:
        for own, pos, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "pos", "role", "text"))):
            if pos == 0:
                if conv is not None:
                    yield out()
                conv, turns, digest, first = own, Turns(text), hashlib.sha256(), True
            else:
                add(turns.row(role, text))
    if conv is not None:
        yield out()


def _long(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The result columns of long conversations by blocks; ``ids`` holds (conv, conv_id)."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    placed = group_positions(rows.where(~F.col("gone")).withColumn("initial", F.substring("role", 1, 1)), "conv", order, previous=("initial", "before"))
    placed = placed.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    earliest = placed.groupBy("conv", "said").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("earliest"))
    narrow = (placed.select("conv", "pos", "turn", "initial", "before", "mark").join(earliest, ["conv", "pos"], "left")
              .withColumn("fault", F.when((F.col("mark") != BLANK) & F.col("earliest").isNull(), DUPLICATE).otherwise(F.col("mark"))))
    narrow = materialize(narrow.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("long")))
    kind = "conv string, block long, ways binary"
    parts = materialize(narrow.select("conv", "block", "pos", "initial", "fault").groupBy("conv", "block").applyInArrow(_matrix, kind))
    while parts.where(F.col("block") > 0).limit(1).count():
        grouped = parts.withColumn("part", F.floor(F.col("block") / FAN).cast("long")).groupBy("conv", "part")
        parts = materialize(grouped.applyInArrow(_product, kind))
    answers = materialize(parts.mapInArrow(_answers, "conv string, cost long, audit string"))
    pair = F.concat("before", "initial")
    illegal = F.count(F.when((F.col("pos") > 1) & ~F.coalesce(pair, F.lit("")).isin("su", "ua", "au"), 1))
    # a level by turn first: a long conversation has many turns, and they are counted apart
    by_turn = narrow.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))], illegal.alias("illegal"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    stream = placed.select("conv", "pos", "role", "text").unionByName(answers.select("conv", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")))
    digests = stream.repartition(shuffle_width(rows), "conv").sortWithinPartitions("conv", "pos").mapInArrow(_digests, "conv string, repaired_sha256 string")
    found = ids.join(counts, "conv", "left").join(answers, "conv", "left").join(digests, "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    turns = F.lit(None).cast("array<struct<role: string, text: string>>").alias("repaired")
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"), turns)


def repair_conversations(conversations: DataFrame, long_rows: int = 2048, long_bytes: int = 1 << 25) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256, repaired (array of role and text)."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    sizes = conversations.groupBy(key, "conv_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size"))
    ids = materialize(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("conv", "conv_id"))
    n_long = ids.count()
    ordinary = rows
    if n_long:
        known = ids.select("conv")
        known = F.broadcast(known) if n_long <= BROADCAST_IDS else known
        ordinary = rows.join(known, "conv", "left_anti")
    dealt = ordinary.repartition(shuffle_width(rows), "conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    id_type = conversations.schema["conv_id"].dataType
    arrow_id = to_arrow_type(id_type)
    found = dealt.mapInArrow(lambda batches: _streamed(batches, arrow_id), f"conv_id {id_type.simpleString()}, {FIELDS}")
    return found.unionByName(_long(rows.join(known, "conv", "left_semi"), ids)) if n_long else found
