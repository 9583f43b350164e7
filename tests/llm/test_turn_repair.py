"""Repair of conversations against all edits of small ones, and segments against whole ones."""

import hashlib
import random
import re

import pytest

from gridloom.llm import turn_repair

ROWS = "conv_id long, turn long, role string, text string, place int, range string, fault string, n int"
GOOD = re.compile(r"(s?(ua)+)?")


def _all_edits(turns, most_inserts):
    """(cost, audit, roles) of every sequence of edits with a legal result."""

    def go(i, cost, audit, roles, inserts):
        if i == len(turns) and GOOD.fullmatch("".join(roles)):
            yield cost, audit, roles
        if inserts < most_inserts:
            for r in "ua":
                yield from go(i, cost + 5, audit + "I", [*roles, r], inserts + 1)
        if i < len(turns):
            initial, fault = turns[i]
            yield from go(i + 1, cost + 2, audit + "D", roles, inserts)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                yield from go(i + 1, cost + more, audit + "K", [*roles, initial or "?"], inserts)
                for r in "ua":
                    yield from go(i + 1, cost + 1 + more, audit + "R", [*roles, r], inserts)

    return list(go(0, 0, "", [], 0))


def test_against_all_edits():
    r = random.Random(3)
    for _ in range(150):
        turns = [(r.choice("suaut "), r.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(r.randrange(5))]
        cost, audit, _ = min(_all_edits(turns, 2))
        _, got_cost, got = next(x for x in turn_repair.paths(turns) if x[0] in turn_repair.ENDS)
        assert (got_cost, got) == (cost, audit)


def _plain(rows):
    """The report of one conversation by relaxing a table until nothing changes."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or " ", x[2] or " "))
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, turns = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        turns.append((role[:1], "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    best = {(0, 0): (0, "", [])}
    changed = True
    while changed:
        changed = False
        for (i, s), (cost, audit, made) in list(best.items()):
            to = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[s]
            steps = [((i, to[0]), 5, "I", [(to[1], "")])]
            if i < len(turns):
                initial, fault = turns[i]
                steps.append(((i + 1, s), 2, "D", []))
                if fault in ("", "truncated"):
                    more = 5 if fault else 0
                    steps.append(((i + 1, to[0]), 1 + more, "R", [(to[1], rows[i][2])]))
                    if initial == "s" and s == 0:
                        steps.append(((i + 1, 1), more, "K", [rows[i][1:]]))
                    if initial == to[1][0]:
                        steps.append(((i + 1, to[0]), more, "K", [rows[i][1:]]))
            for at, c, letter, out in steps:
                way = (cost + c, audit + letter, made + out)
                if at not in best or way[:2] < best[at][:2]:
                    best[at], changed = way, True
    cost, audit, made = min((best[len(turns), s] for s in (0, 3) if (len(turns), s) in best), key=lambda x: x[:2])
    numbers = [t for t, _, _ in rows if t is not None]
    kinds = [f for _, f in turns]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()), made


def _table(spark, convs):
    rows = [(c, t, r, x, 1, "r", "f", 2) for c, own in convs.items() for t, r, x in own]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def convs():
    r = random.Random(5)
    texts = ["Yes.", "No!", "Why", "", None, "  \n", "Long text that ends", "Ends. \t", "é?", " "]
    roles = ["user", "assistant", "system", "tool", "u", None, "User", ""]
    out = {c: [(r.choice([None, 0, 1, 2, 3, 4, 5, 9]), r.choice(roles[: 3 if c % 2 else 8]), r.choice(texts)) for _ in range(r.randrange(1, 9))] for c in range(120)}
    out[None] = [(0, "user", "A."), (1, "assistant", "B.")]
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_report(spark, convs):
    got = {r["conv_id"]: tuple(r[c] for c in COUNTS) for r in turn_repair.report(_table(spark, convs)).collect()}
    assert got == {c: _plain(own)[0] for c, own in convs.items()}


def test_repaired_turns(spark, convs):
    got = {}
    for r in sorted(turn_repair.repaired(_table(spark, convs)).collect(), key=lambda r: (r["part"], r["place"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {c: made for c, own in convs.items() if (made := [tuple(m) for m in _plain(own)[1]])}
    assert got == want


def test_a_conversation_of_many_segments(spark):
    r = random.Random(9)
    rows = [(t, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Same.", f"Text {t}.", f"Text {t}.", f"cut {t}", ""])) for t in range(3500) if t % 11]
    got = turn_repair.report(_table(spark, {7: rows, 8: rows[:3], 6: rows[-2:]})).collect()
    by = {x["conv_id"]: tuple(x[c] for c in COUNTS) for x in got}
    assert by[8] == _plain(rows[:3])[0] and by[6] == _plain(rows[-2:])[0]
    counts, audit = by[7][:6], by[7][6]
    # one path over the whole conversation
    seen, turns = set(), []
    for _, role, text in rows:
        turns.append((role[:1], "blank" if not text else "duplicate" if (role, text) in seen else "" if text[-1] == "." else "truncated"))
        seen.add((role, text))
    _, cost, want = next(x for x in turn_repair.paths(turns) if x[0] in turn_repair.ENDS)
    made = list(turn_repair.edited([x[1] for x in rows], [x[2] for x in rows], want))
    assert audit == want and by[7][7] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
    kinds = [f for _, f in turns]
    assert counts == (3499 - 1 + 1 - len(rows), kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost)


def test_a_very_long_text_and_no_rows(spark):
    long = "word " * 1_500_000 + "end."
    got = turn_repair.report(_table(spark, {1: [(0, "user", long), (1, "assistant", long + "!"), (2, "user", long)]})).collect()
    assert [(r["duplicate"], r["audit"]) for r in got] == [(1, "KKD")]
    assert turn_repair.report(_table(spark, {})).collect() == []
    assert turn_repair.repaired(_table(spark, {})).collect() == []


def test_query_on_an_empty_table_and_on_dropped_turns(spark, tmp_path):
    import zlib

    from gridloom.llm import queries

    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op13_turn_repair(spark, f"{tmp_path}/none").collect() == []
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nulls = [(gone, 0, "user", "Gone.", 1, "", "", 1), (None, None, None, None, 1, "", "", 1)]
    spark.createDataFrame(nulls, ROWS).write.parquet(f"{tmp_path}/two/conversations.parquet")
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: tuple(r[c] for c in COUNTS) for r in queries.op13_turn_repair(spark, f"{tmp_path}/two").collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", empty)
    kind = zlib.crc32(b" : ") % 20
    assert kind not in (0, 3, 4) and got[None] == (0, 1, 0, 0, 0, 2, "D", empty)
