"""Conversation repair against an exhaustive search over edits, spilled and not."""

import hashlib
import heapq
import random
import re
import zlib

from limnos.llm import conversations as C
from limnos.llm import queries

SPACE = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def faults(rows):
    """Each row's first fault; rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dijkstra over (cost, audit, rows used, roles): the first accepted one is cheapest and ASCII-least."""
    kinds = faults(rows)
    good = re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        state = (at, "" if not roles else roles if roles == "s" else roles[-1])
        if at == len(rows) and good.fullmatch(roles):
            return cost, audit, list(out)
        if state in done:
            continue
        done.add(state)
        given = "assistant" if roles.endswith("u") else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", at, roles + given[0], (*out, (given, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, out))
            if kinds[at] in ("", "truncated"):
                late = 5 * (kinds[at] == "truncated")
                heapq.heappush(heap, (cost + late + 1, audit + "R", at + 1, roles + given[0], (*out, (given, text))))
                if role and re.fullmatch(r"s|s?(ua)*u?", roles + role[:1]):
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, roles + role[:1], (*out, (role, text))))
    raise AssertionError


def brute(table, damaged=False):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    groups = {}
    for conv, turn, role, text in table:
        held = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        if damaged:
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            role = "user" if fault == 4 else role
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            held.extend([(turn, role, text)] * (fault == 3))
        held.append((turn, role, text))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds = faults(rows)
        turns = {r[0] for r in rows if r[0] is not None}
        initials = [r[1][:1] for r in rows]
        cost, audit, fixed = cheapest(rows)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"),
                     kinds.count("duplicate"), kinds.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def collected(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_table(seed, conversations=120):
    r = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "why", "é?", "cut off ", "", " \n", None, "a. ", "日本。", "x" * 300 + "."]
    out = []
    for conv in [None, *range(conversations)]:
        turn = 0
        for _ in range(r.randint(1, 9)):
            out.append((conv, r.choice([None, turn, turn]) if conv and conv % 5 == 0 else turn, r.choice(roles), r.choice(texts)))
            turn += r.choice([0, 1, 1, 1, 3])
    r.shuffle(out)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_exhaustive_search(spark):
    for seed in (1, 2):
        table = random_table(seed)
        df = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA + ", present int, earlier string").repartition(4)
        assert collected(C.repair(df)) == brute(table)
        assert collected(C.repair(df, spill=200)) == brute(table)
        lost = C.damage(df)
        assert collected(C.repair(lost, present=lost["present"])) == brute(table, damaged=True)
    assert C.repair(df.limit(0)).count() == 0


def test_long_conversation_spills_and_is_whole(spark):
    r = random.Random(7)
    table = [(1, k, r.choice(["user", "assistant", "system"]), f"turn {k}{r.choice(['.', '!', ''])}") for k in range(3000)]
    table += [(1, 5000 + k, "user", "again.") for k in range(2000)] + [(2, 0, "user", "alone.")]
    df = spark.createDataFrame(table, SCHEMA)
    want = collected(C.repair(df))
    assert collected(C.repair(df, spill=10_000)) == want
    turns = C.repaired_turns(df, spill=10_000).orderBy("conv_id", "position").collect()
    for conv in (1, 2):
        rows = [x for x in turns if x.conv_id == conv]
        assert [x.position for x in rows] == list(range(len(rows)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x.role[0] for x in rows))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in rows).encode()).hexdigest() == want[conv][-1]
    assert want[1][2] == 1999 and want[2][5:7] == (2, "D")


def test_costs_of_small_cases():
    def run(*rows):
        cost, audit, fixed = cheapest([(0, *x) for x in rows])
        one = C.Repairer()
        for (role, text), kind in reversed(list(zip(rows, faults([(0, *x) for x in rows]), strict=True))):
            one.add(role, text, kind in ("blank", "duplicate"), kind == "truncated")
        walked = list(one.walk())
        assert (one.total(), "".join(e for e, *_ in walked)) == (cost, audit)
        assert [(r, t) for e, r, t in walked if e != "D"] == fixed
        return cost, audit
    assert run() == (0, "")
    assert run(("user", "a.")) == (2, "D")
    assert run(("system", "s."), ("user", "a."), ("assistant", "b.")) == (0, "KKK")
    assert run(("user", "a."), ("user", "b.")) == (1, "KR")
    assert run(("user", "a."), ("assistant", "b")) == (4, "DD")
    assert run(("tool", "a."), ("", "b.")) == (2, "RR")


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    df = queries.QUERIES["op11_conversation_repair"](spark, folder)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert collected(df) == brute(table, damaged=True)
