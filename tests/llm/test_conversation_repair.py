"""Repaired conversations against exhaustive search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from relmill.llm.conversation_repair import damaged, repair, solve

SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(SPACE)[-1:]
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by trying every edit of every row."""
    best = [(10**9, "")]

    def go(i, inserts, cost, audit, roles, lines):
        if (cost, audit) > best[0][:2] and cost >= best[0][0]:
            return
        if i == len(rows):
            if LEGAL.fullmatch(roles):
                best[0] = min(best[0], (cost, audit, lines))
        else:
            role, text = rows[i]
            go(i + 1, 0, cost + 4, audit + "D", roles, lines)
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                if role:  # without an initial a row cannot be kept
                    go(i + 1, 0, cost + more, audit + "K", roles + role[0], [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, 0, cost + 3 + more, audit + "R", roles + new[0], [*lines, f"{new}:{text}"])
        if inserts < 2:
            for new in ("user", "assistant"):
                go(i, inserts + 1, cost + 3, audit + "I", roles + new[0], [*lines, f"{new}:"])

    best[0] = (4 * len(rows), "D" * len(rows), [])
    go(0, 0, 0, "", "", [])
    return best[0]


def plain(rows):
    """rows: (conv_id, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows if r[0] == conv)
        turns = [t for known, t, _, _ in own if known]
        body = [(role, text) for _, _, role, text in own]
        f = faults(body)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(body, body[1:], strict=False))
        cost, audit, lines = cheapest(body, f)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", "User"], ["Hi.", "Yes?", "No", "", " \n", "ok!  ", "é"]


def made(n, most, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, most + 1)):
            rows.append((conv, turn + r.randrange(2) * r.randrange(3) if r.random() < 0.9 else None, r.choice(ROLES[: r.choice([2, 3, 6])]), r.choice(TEXTS[: r.choice([2, 4, 7])])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_exhaustive(spark):
    rows = made(120, 5, 1) + [(None, None, "user", "Hi."), (None, 3, "assistant", "x" * 300_000 + "."), (None, 9, "user", "no")]
    assert result(repair(spark.createDataFrame(rows, SCHEMA).repartition(7))) == plain(rows)


@pytest.mark.parametrize("segment", [1, 2, 3])
def test_segments_are_joined(spark, segment):
    """Conversations that are cut every few rows come out as the whole ones do."""
    rows = made(90, 6, segment)
    assert result(repair(spark.createDataFrame(rows, SCHEMA), segment=segment)) == plain(rows)


def test_long_conversation(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(3_000)] + [(7, 3_000, "user", "text 4."), (8, 0, "user", "Hi.")]
    cut, whole = (result(repair(spark.createDataFrame(rows, SCHEMA).repartition(9), segment=n)) for n in (100, 10_000))
    assert cut == whole
    assert cut[7][:6] == (0, 0, 1, 0, 0, 4)
    assert cut[7][6] == "K" * 3_000 + "D"
    assert cut[8] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())


def test_damage(spark):
    rows = [(i, t, "system" if t == 0 else "user", f"A. b? {t}!") for i in range(60) for t in range(4)] + [(None, None, None, None)] * 2
    want = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", kind int")
    assert sorted(map(tuple, damaged(df).collect()), key=str) == sorted(want, key=str)
    out = result(repair(damaged(df), df))
    assert set(out) == {r[0] for r in rows}
    assert {k: v for k, v in out.items() if k in {w[0] for w in want}} == plain(want)


def test_nothing(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(4, 0, "user", "Hi.")], SCHEMA)
    assert repair(none, none).count() == 0
    assert result(repair(none, one)) == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_signature_of_some_length():
    steps, tail, price, end = solve("ua" * 4_000 + "U")[0]
    assert (steps[:5], tail, price, end) == ("K,K,K", "", 4, 3) and steps.endswith("K,D")
    assert solve("") == [("", "", 0, 0), ("", "ua", 6, 3), ("", "a", 3, 3), ("", "", 0, 3)]
