"""Repair of conversations against a plain walk over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from stallwise.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, harm int, hash string, kind string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    found = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            found += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return found


def plain(rows):
    """Brute force: by rows and states of the roles' order the least (cost, audit, lines), over at most two insertions between rows."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def put(into, state, way):
        if state is not None and (state not in into or way < into[state]):
            into[state] = way

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for c in "ua":
                    put(ways, after.get((state, c)), (cost + 3, audit + "I", lines + (names[c] + ":",)))
        return ways

    counts, seen, ways = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), inserted({"": (0, "", ())})
    for _, _, role, text in rows:
        left = text.strip(SPACE)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        now = {}
        for state, (cost, audit, lines) in ways.items():
            put(now, state, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                put(now, after.get((state, role[:1])), (cost + more, audit + "K", lines + (f"{role}:{text}",)))
                for c in "ua":
                    put(now, after.get((state, c)), (cost + more + 3, audit + "R", lines + (f"{names[c]}:{text}",)))
        ways = inserted(now)
    cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
    return counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    found, live = {}, damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in live if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        counts, cost, audit, digest = plain(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        found[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return found


def talks(rng, n, most=9):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " ", "", None]
    texts = ["One.", "Two!", "no end", "", " \n", None, "Three?", "x. ", "é.", "same.", "User ."]
    rows = []
    for conv in range(n):
        turn = rng.choice([0, 0, 1, -3, 510])
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
            turn += rng.choice([0, 1, 1, 1, 1, 2, 700] if rng.random() < 0.3 else [1])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "h", "k") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("params", [repair.Params(), repair.Params(segment_rows=3, stretch_bits=1), repair.Params(segment_rows=2, segment_bytes=8, stretch_bits=40)])
def test_repairs_are_the_cheapest_and_least(spark, params):
    rng = random.Random(3)
    rows = talks(rng, 150) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, "system", "S.")]
    rows += [(900, 5, "user", "again and again.")] * 40 + [(901, t, ("user", "assistant")[t % 2], f"number {t // 3}.") for t in range(1300)]
    rows += [(902, 3, "user", "long " * 200_000 + "end.")] + [(903, 1, f"user{k % 2}", f"tied {k}.") for k in range(30)]
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(frame(spark, rows)), params).collect()}
    want = expected(rows)
    assert set(found) == set(want)
    for conv in want:
        assert found[conv] == want[conv], conv


def test_the_heaps_agree_with_a_plain_walk_on_every_short_conversation():
    """All conversations of up to four rows of five kinds."""
    import itertools

    kinds = [("system", "S."), ("user", "U."), ("assistant", "A"), ("assistant", "A."), ("tool", "T.")]
    for n in range(5):
        for picked in itertools.product(kinds, repeat=n):
            rows = [(0, 0, role, f"{i}{text}") for i, (role, text) in enumerate(picked)]
            steps = [repair.edits(r[2][0], repair.FINE if r[3][-1] == "." else repair.CUT_OFF) for r in rows]
            cost, audit, _ = repair.cheapest(steps, 0, repair.ENDS)
            lines = repair.repaired([r[2:] for r in rows], audit)
            _, *want = plain(rows)
            assert [cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] == want


def test_dropped_conversations_and_an_empty_table(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = repair.repair(repair.damaged(frame(spark, [(c, 0, "user", "Hi.") for c in gone]))).collect()
    assert sorted(map(tuple, rows)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]
    assert repair.repair(repair.damaged(frame(spark, []))).collect() == []


def test_every_conversation_of_a_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))).collect()}
    assert found == expected(rows)
