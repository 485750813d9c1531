import hashlib
import itertools
import random
import re
import zlib

import pytest

from disarm.llm import queries
from disarm.llm.turn_repair import LEGAL, Conversation, Parser, Repair, ROLE_GRAMMAR, conversation_report, repair_turns

SPACE = r"[\x20\x09-\x0D]"


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        said = re.sub(SPACE + r"+\Z", "", text)
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def brute(rows):
    """Least (cost, audit) over all edits with at most two inserts at a place, and what it makes."""
    puts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults(rows)]
    name, best = {"u": "user", "a": "assistant"}, None
    for edits in itertools.product(*choices):
        for put in itertools.product(puts, repeat=len(rows) + 1):
            cost, audit, lines, initials = 0, "", [], ""
            for (_, role, text), edit, before, fault in zip([*rows, (None, "", "")], [*edits, ""], put, [*faults(rows), None]):
                cost, audit, initials = cost + 5 * len(before), audit + "I" * len(before), initials + "".join(before)
                lines += [f"{name[b]}:" for b in before]
                cost, audit = cost + {"D": 2, "R": 1}.get(edit[:1], 0) + (5 if fault == "truncated" and edit != "D" else 0), audit + edit[:1]
                if edit[:1] in ("K", "R"):
                    initials += role[:1] if edit == "K" else edit[1]
                    initials += "" if edit != "K" or role else "?"
                    lines.append(f"{role if edit == 'K' else name[edit[1]]}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def walked(rows):
    """The same by states of the expression, for any length."""
    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows)):
        after = {}

        def offer(state, value):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        for state, (c, a, lines) in best.items():
            offer(state, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            stay = 5 if fault == "truncated" else 0
            for put in ("", "user", "assistant"):
                at, c2, a2, l2 = state, c, a, lines
                if put:
                    if (put == "assistant") != (at == "u"):
                        continue
                    at, c2, a2, l2 = put[0], c + 5, a + "I", lines + [f"{put}:"]
                for new, edit, price in [(role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)]:
                    step = new[:1]
                    if step == "s" and at == "" or step == "u" and at in ("", "s", "a") or step == "a" and at == "u":
                        offer(step, (c2 + price + stay, a2 + edit, l2 + [f"{new}:{text}"]))
        best = after
    ends = []
    for state, (c, a, lines) in best.items():
        more = {"": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[state]
        ends.append((c + 5 * len(more), a + "I" * len(more), lines + more))
    cost, audit, lines = min(ends, key=lambda e: e[:2])
    return cost, audit, "\n".join(lines)


def report(rows):
    """One conversation's row, by the plain ways."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, found = [t for t, _, _ in rows if t is not None], faults(rows)
    cost, audit, lines = walked(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((x[1][:1], y[1][:1]) not in LEGAL for x, y in zip(rows, rows[1:]))
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def odd(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "usher", "élan", None]
    texts = ["Yes.", "No", " \n", "", "What?", "né!  ", "a\x85", ". ", None, "x.y"]
    return [(rng.choice([None, *range(9)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.") for _ in range(n)]


def test_short_ones_equal_all_possible_edits():
    rng = random.Random(12)
    for _ in range(60):
        rows = [(t, r or "", x or "") for t, r, x in odd(rng, rng.randint(0, 3))]
        assert walked(rows) == brute(rows)
        one = Conversation(Repair())
        edits = [e for row, f in zip(rows, faults(rows)) for e in one.add(row, row[1][:1], f)] + one.finish()
        assert "".join(e[0] for e in edits) == brute(rows)[1]


def test_parser_accepts_the_grammar_only():
    parser = Parser(ROLE_GRAMMAR)
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stacks = [(0, None)]
            for symbol in word:
                stacks = [to for s in stacks for to in parser.shift(s, symbol)]
            assert any(parser.accepts(s) for s in stacks) == bool(re.fullmatch("(s?(ua)+)?", "".join(word)))


@pytest.mark.parametrize("parts", [1, 5])
def test_reports_equal_plain_versions(spark, parts):
    rng = random.Random(parts)
    talks = {c: odd(rng, rng.choice([1, 2, 3, 8, 40])) for c in range(120)} | {None: odd(rng, 4), 500: [(t, ("user", "assistant")[t % 2], f"T{t}.") for t in range(5000)],
        501: [(t, "tool", f"T{t}.") for t in range(1500)], 502: odd(rng, 1200), 503: [(None, None, None)] * 3,
        504: [(t // 2, ('user', 'assistant')[t // 2 % 2], ('No', f'T{t // 2}')[t % 4 > 1]) for t in range(60)]}
    rows = [(c, *r, 7) for c, rs in talks.items() for r in rs]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").repartition(parts)
    edits = repair_turns(turns)
    assert {r.conv_id: tuple(r)[1:] for r in conversation_report(edits).collect()} == {c: report(rs) for c, rs in talks.items()}
    by = {}
    for r in edits.where("conv_id = 502").collect():
        by.setdefault(r.conv_id, []).append(r)
    kept = "\n".join(f"{r.repaired_role}:{r.text}" for r in sorted(by[502], key=lambda r: r.seq) if r.edit != "D")
    assert hashlib.sha256(kept.encode()).hexdigest() == report(talks[502])[-1]
    assert edits.where("edit = 'D' AND repaired_role IS NOT NULL OR edit = 'I' AND turn IS NOT NULL").count() == 0


def test_absent_rows_and_no_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", False), (1, 1, "user", "Hi.", None), (2, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", False)],
                                  "conv_id string, turn int, role string, text string, here boolean")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_report(repair_turns(turns, present="here")).collect()}
    assert got == {"1": report([]), "2": report([(0, "user", "Hi.")])}
    assert repair_turns(turns.where("false")).collect() == [] and conversation_report(repair_turns(turns.where("false"))).collect() == []


def test_damage(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["A. B!", None, "c?"])) for c in [*range(60), None] for t in [0, 1, 2, None]]
    got = sorted((tuple(r)[:4] for r in queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("present").collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        want += [(c, t, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    assert got == sorted(want, key=repr)
