import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewright.llm import chat_repair

TURNS = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(cost, edits) by trying every string of edits, cheapest first."""
    best = None
    for insertions in range(len(turns) + 3):
        for edits in itertools.product("DKR", repeat=len(turns)):
            slots = len(turns) + 1
            for places in itertools.combinations_with_replacement(range(slots), insertions):
                for roles in _choices(edits, turns):
                    line, names, cost, j = [], [], 0, 0
                    for slot in range(slots):
                        for _ in range(places.count(slot)):
                            line.append("I")
                            names.append("?")
                            cost += 3
                        if slot < len(turns):
                            edit, (_, _, short) = edits[slot], turns[slot]
                            line.append(edit)
                            cost += 4 if edit == "D" else (3 if edit == "R" else 0) + 3 * short
                            if edit != "D":
                                names.append(roles[j])
                                j += 1
                    if any(_fits(names, n) for n in (len(names),)):
                        found = (cost, "".join(line))
                        best = found if best is None or found < best else best
    return best


def _choices(edits, turns):
    if any(e != "D" and gone for e, (_, gone, _) in zip(edits, turns, strict=True)):
        return []
    return itertools.product(*[["sua"[r - 1] if r > 0 else "-"] if e == "K" else "ua" for e, (r, _, _) in zip(edits, turns, strict=True) if e != "D"])


def _fits(names, n):
    pattern = "ua" * (n // 2) if n % 2 == 0 else "s" + "ua" * (n // 2)
    return n != 1 and all(a == b or a == "?" and b in "ua" for a, b in zip(names, pattern, strict=True))


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_equals_all_strings_tried(seed):
    draw = random.Random(seed)
    turns = [(draw.choice([1, 2, 2, 3, 3, -1]), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randrange(5))]
    assert chat_repair.cheapest(turns) == brute(turns)


def test_long_conversations_take_linear_steps():
    turns = [(2 + i % 2, i % 7 == 0, i % 11 == 0) for i in range(60_000)]
    cost, edits = chat_repair.cheapest(turns)
    assert cost > 0
    assert len(edits) - edits.count("I") == 60_000


def plain(rows):
    """report() of (conv_id, turn, role, text) with times 1, by itself."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv))
        seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            turns.append(({"s": 1, "u": 2, "a": 3}.get(role[:1], -1), fault in ("blank", "duplicate"), bool(solid) and solid[-1] not in ".!?"))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        known = {t for there, t, _, _ in mine if there}
        cost, edits = chat_repair.cheapest(turns)
        lines, left = [], iter(mine)
        size = len(edits) - edits.count("D")
        roles = iter(["user", "assistant"] * (size // 2) if size % 2 == 0 else ["system"] + ["user", "assistant"] * (size // 2))
        for e in edits:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            name = next(roles)
            lines.append(f"{row[2] if e == 'K' else name}:{row[3] if row else ''}")
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_report_and_repaired(spark):
    draw = random.Random(3)
    text = ["Yes.", "No!", "", " \t", "An open end", None, "Why?\n", "u" * 100_000 + "."]
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([None, 0, 1, 2, 3, 7]), draw.choice(["user", "assistant", "system", None, "tool", ""]), draw.choice(text)) for _ in range(60)]
    rows += [(9, None, None, None), (10, 0, "system", "Only this."), (11, 5, "user", "A."), (11, 6, "assistant", "B.")]
    turns = spark.createDataFrame([(*r, "x", 0) for r in rows], TURNS + ", edit string, place long")
    got = chat_repair.report(turns).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain(rows)
    assert len(got) == len({r[0] for r in rows})
    whole = {}
    for r in sorted(chat_repair.repaired(turns).collect(), key=lambda r: (r["conv_id"] or 0, r["place"])):
        whole.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in got:
        assert hashlib.sha256("\n".join(whole.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in whole.get(r["conv_id"], [])))
    assert chat_repair.report(turns.limit(0)).collect() == chat_repair.repaired(turns.limit(0)).collect() == []


def test_texts_that_wait_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "HELD_BYTES", 10)
    conversation = chat_repair.Conversation(1)
    for i in range(6):
        conversation.add(i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.")
    assert [t for _, _, t in conversation.repaired("KKKKKK")] == [f"Turn {i}." for i in range(6)]
    assert [t for _, _, t in conversation.repaired("DDKKKK")] == [f"Turn {i}." for i in range(2, 6)]


def test_damage(spark):
    rows = [(c, t, "assistant", "So it is. Is it?!") for c in range(40) for t in range(4)] + [(None, 1, None, None), (5, None, "system", "A.")]
    got = chat_repair.damaged(spark.createDataFrame(rows, TURNS)).collect()
    assert len(got) == len(rows)
    for r in got:
        kind = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        assert r["times"] == {0: 0, 3: 2}.get(kind, 1)
        if r["conv_id"] is not None and r["turn"] is not None:
            assert (r["role"], r["text"]) == ("user" if kind == 4 else "assistant", {1: "", 2: "So it is Is it"}.get(kind, "So it is. Is it?!"))
    gone = [c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    lost = chat_repair.report(chat_repair.damaged(spark.createDataFrame([(c, 0, "user", "A.") for c in gone], TURNS))).collect()
    assert sorted(r["conv_id"] for r in lost) == gone
    assert {tuple(r)[1:] for r in lost} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
