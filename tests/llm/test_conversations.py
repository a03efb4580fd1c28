"""Conversation repair against enumerated edits, on small tables with nulls, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from textquarry.llm import conversations
from textquarry.llm.conversations import Solver, damaged, ordered, repair, repaired_rows

SCHEMA = "conv_id string, turn int, role string, text string, audit string, part string, place string, code string"
FORM = re.compile("(s?(ua)+)?")


def cheapest(signature, most=4):
    """By trying all edits of all rows with up to `most` insertions."""
    best = None
    for edits in itertools.product("KRD", repeat=len(signature)):
        if any(x == "x" and e != "D" for x, e in zip(signature, edits, strict=True)):
            continue
        price = sum({"K": 0, "R": 2, "D": 3}[e] + (x.isupper() and e != "D") for x, e in zip(signature, edits, strict=True))
        for k in range(most + 1):
            if best and price + 2 * k > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(signature) + 1), k):
                steps = []
                for i in range(len(signature) + 1):
                    steps += ["I"] * places.count(i)
                    steps += [(edits[i], signature[i])] if i < len(signature) else []
                free = [x for x in steps if x == "I" or x[0] != "D"]
                for roles in itertools.product("ua", repeat=sum(x == "I" or x[0] == "R" for x in free)):
                    given = iter(roles)
                    form = "".join(x[1].lower() if x[0] == "K" else next(given) for x in free)
                    if FORM.fullmatch(form):
                        new = (price + 2 * k, "".join(x[0] for x in steps))
                        best = min(best or new, new)
    return best


def test_solver_is_enumeration():
    rng, solver = random.Random(3), Solver()
    for _ in range(150):
        x = "".join(rng.choice("ssuuaaoSUAOx") for _ in range(rng.randint(0, 4)))
        assert solver.solve(x) == cheapest(x), x


def test_long_signatures_and_forgetting():
    rng, solver, small = random.Random(5), Solver(), Solver(longest=2, most=3)
    for n in (1, 63, 64, 65, 1000):
        x = "".join(rng.choice("suaoUAx") for _ in range(n))
        assert solver.solve(x) == small.solve(x)
    cost, audit = solver.solve("ua" * 100_000 + "u")
    assert (cost, len(audit)) == (2, 200_002)
    assert solver.solve("ox" * 3) == (4 * 3 + 2 * 2, "DDRDRD")


def plain(rows):
    """The whole result of one conversation's rows (turn, role, text), by loops."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, letters, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        x = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else x.upper() if fault else x
    cost, audit = cheapest(letters) if len(letters) < 6 else Solver().solve(letters)
    out, kept = [], 0
    left = iter(rows)
    for e in audit:
        row = next(left) if e != "I" else None
        if e == "D":
            continue
        system = bool(out) and out[0][0][:1] == "s"
        role = row[1] if e == "K" else "user" if (kept - system) % 2 == 0 else "assistant"
        out.append((role, row[2] if row else ""))
        kept += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest), out


@pytest.fixture(scope="module")
def many():
    rng = random.Random(8)
    rows = []
    for c in [None, *map(str, range(40))]:
        for _ in range(rng.randint(1, 5)):
            turn = rng.choice([None, 0, 1, 2, 3, 9])
            role = rng.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool", "éa"])
            text = rng.choice([None, "", " \t", "Yes.", "No", "ends! \n", "x" * 5000 + "?", "　", "Üb."])
            rows += [(c, turn, role, text)] * rng.choice([1, 1, 1, 2])
    rows += [("hot", k, ["user", "assistant"][k % 2], f"{k % 50} is it.") for k in range(600)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def by_conv(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(tuple(r))
    return out


def test_repair_is_the_plain_one(spark, many):
    docs = frame(spark, many)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(docs).collect()}
    want = {c: plain(r) for c, r in by_conv(many).items()}
    assert got == {c: w[0] for c, w in want.items()}
    rows = ordered(docs)
    lines = {}
    for r in sorted(repaired_rows(rows, repair(docs)).collect(), key=lambda r: r["at"]):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_damage(spark, many):
    want = []
    for c, t, r, x in many:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    got = damaged(frame(spark, many))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    found = {r["conv_id"]: tuple(r)[1:] for r in repair(frame(spark, many), got).collect()}
    assert found == {c: plain(by_conv(want).get(c, []))[0] for c in by_conv(many)}


def test_rows_that_all_go_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    docs = frame(spark, [(str(gone), 0, "user", "Hi.")])
    assert [tuple(r) for r in repair(docs, damaged(docs)).collect()] == [(str(gone), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair(frame(spark, [])).count() == 0


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(conversations.REPAIR_SQL).fetchall()
    assert sorted(map(tuple, conversations.op11_conversation_repair(spark, sf).collect())) == sorted(want)
