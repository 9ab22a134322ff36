"""op13 against a brute-force search over edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from plain import BLANKS
from pyspark.sql import functions as F

from growthlab.llm import conversation_repair as R
from growthlab.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def after_damage(rows):
    """{conv_id: ordered (turn, role, text)} after the damage."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = found.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in found.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows, marks):
    """(cost, audit, repaired): least-cost-first search over whole edit sequences, the
    pattern judged by a regular expression of the initials."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, new = heapq.heappop(heap)
        if at == len(rows) and GOOD.match(initials):
            return cost, audit, list(new)
        if (at, initials, audit) in done or not re.match(r"s?(ua)*u?\Z", initials):
            continue
        done.add((at, initials, audit))
        for role in ("user", "assistant"):
            if audit[-2:] != "II":
                heapq.heappush(heap, (cost + 5, audit + "I", at, initials + role[0], (*new, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, new))
            if marks[at] in ("", "truncated"):
                more = 5 if marks[at] else 0
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*new, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, initials + to[0], (*new, (to, text))))


def expected(rows):
    out = {}
    for conv, own in after_damage(rows).items():
        marks = faults(own)
        cost, audit, new = brute(own, marks)
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest)
    return out


def got(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


def messy(n_convs, most, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n_convs), None]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "cut off", "", None, " \t", "Why?", f"Long é {turn}.", f"{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_equals_brute_force(spark):
    rows = messy(150, 7, 1)
    found = R.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert got(found) == expected(rows)


@pytest.mark.parametrize("limit", [0, 3])
def test_blocks_of_long_conversations_give_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BLOCK", 2)
    monkeypatch.setattr(R, "FAN", 2)
    rows = messy(40, 7, 2)
    found = R.repair_conversations(spark.createDataFrame(rows, SCHEMA), long_rows=limit)
    assert got(found) == expected(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"Turn {i // 9}." if i % 5 else "cut") for i in range(6000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(R.repair_conversations(docs)) == got(R.repair_conversations(docs, long_rows=10_000))


def test_whole_table_and_turns(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01")) == expected(rows)
    for r in R.repair_conversations(spark.read.parquet(path)).collect():
        assert GOOD.match("".join(t.role[0] for t in r.repaired))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.repaired).encode()).hexdigest() == r.repaired_sha256


def test_nothing_left_empty_table_and_other_columns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert got(R.repair_conversations(docs)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(R.repair_conversations(docs, long_rows=0)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repair_conversations(docs.limit(0)).collect() == []
    odd = docs
    for name in ("conv", "mark", "gone", "copy", "kind", "pos", "block"):
        odd = odd.withColumn(name, F.lit(name))
    assert got(R.repair_conversations(odd)) == got(R.repair_conversations(docs))
