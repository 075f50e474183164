"""Repair of conversations against a search over all audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ward_analytics.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, audit string, block int, kind long"


def cheapest(kinds):
    """Least cost, then least audit, of all audits with at most two inserts in a row; kinds: (initial, fault) of each row."""
    best = (3 * len(kinds), "D" * len(kinds))

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserted + 1)
        if i < len(kinds):
            initial, fault = kinds[i]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if initial:
                    go(i + 1, roles + initial, cost + extra, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def plain(rows, known=()):
    """The summary of each conversation; rows: (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c in known:
        by[c] = []
    for c, turn, role, text in rows:
        by[c].append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "none" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            kinds.append((role[:1], fault))
        cost, audit = cheapest(kinds)
        roles, at, said = "", 0, []
        for letter in audit:
            due = "assistant" if roles.endswith("u") else "user"
            if letter == "I":
                said.append(f"{due}:")
            else:
                _, role, text = turns[at]
                at += 1
                if letter == "D":
                    continue
                due = role if letter == "K" else due
                said.append(f"{due}:{text}")
            roles += due[:1]
        times = [t for t, _, _ in turns if t is not None]
        initials = [role[:1] for _, role, _ in turns]
        faults = [f for _, f in kinds]
        out[c] = (
            max(times) - min(times) + 1 - len(set(times)) if times else 0, *(faults.count(f) for f in conv.FAULTS[1:]),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def table(workers, rows):
    return workers.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([None, t, t, t, t, 2 * t])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No?", "cut", "", " \t", None, "Wait!\r\n", "é.", "a, b", f"text {rng.random()}."])
            rows.append((c if c else None, turn, role, text))
    return rows


@pytest.mark.parametrize("block_rows", [1, 2, 3, 100])
def test_all_audits(workers, block_rows):
    rows = random_rows(block_rows, 60, 5)
    assert found(conv.repair(table(workers, rows), block_rows=block_rows)) == plain(rows)


def test_damage_and_conversations_without_rows(workers):
    rng = random.Random(8)
    rows = [(c, t if t != 2 or c % 3 else None, ("user", "assistant")[t % 2], rng.choice(["Is it? Yes.", None, "x!"])) for c in range(120) for t in range(rng.randint(1, 4))]
    rows += [(None, None, None, None), (next(c for c in range(500, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Gone.")]
    damaged, gone = [], set()
    for c, t, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        row = (c, t, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
        damaged += [row] * (0 if case == 0 else 2 if case == 3 else 1)
        gone |= {c} if case == 0 else set()
    want = plain(damaged, [c for c, *_ in rows])
    assert any(w[-2] == "" for w in want.values()) and gone
    given = table(workers, rows)
    assert found(conv.repair(conv.damage(given), known=given)) == want


def test_repaired_turns(workers):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (2, 0, "user", "Why"), (3, 0, "user", "")]
    turns = [tuple(r) for r in conv.repair(table(workers, rows), turns=True).orderBy("conv_id", "seq").collect()]
    assert turns == [
        (1, 0, "Keep", "system", "Be kind."), (1, 1, "Insert", "user", ""), (1, 2, "Keep", "assistant", "Hi."),
        (2, 0, "Keep", "user", "Why"), (2, 1, "Insert", "assistant", ""),
    ] or plain(rows)[2][-2] == "D"
    assert {r[0] for r in turns} <= {1, 2}


def test_odd_tables(workers):
    assert conv.repair(table(workers, [])).collect() == []
    rows = [(1, 0, "user", "x" * 300_000 + " " * 300_000), (1, 1, "assistant", " " * 300_000)]
    assert found(conv.repair(table(workers, rows))) == plain(rows)


def test_long_conversations_in_blocks_equal_whole_ones(workers):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "tool"]), f"{t}{rng.choice(['.', ''])}") for c in (1, 2) for t in range(2_000)]
    whole, parts = (found(conv.repair(table(workers, rows), block_rows=b)) for b in (10_000, 64))
    assert whole == parts and len(whole) == 2


def test_equal_hashes_are_verified(monkeypatch):
    """With a modulus of 2 most hashes are equal; the order of audits is still that of their letters."""
    monkeypatch.setattr(conv, "_MODULUS", 2)
    rng = random.Random(1)
    for _ in range(200):
        audits, words = conv.Audits(), []
        for _ in range(2):
            node, word = 0, []
            for _ in range(12):
                word.append(rng.randint(0, 1))
                node = audits.add(node, word[-1], 0)
            words.append((node, word))
        (a, x), (b, y) = words
        order = audits.compare(a, b)
        assert (order > 0) - (order < 0) == (x > y) - (x < y)
    kinds = [rng.choice([4, 8, 12, 7, 0]) for _ in range(300)]
    audits, live = conv.solve([conv.EDGES[k] for k in kinds], conv.START)
    collided = {q: (cost, conv.text_of(audits, node)) for q, (cost, node) in live.items()}
    monkeypatch.undo()
    audits, live = conv.solve([conv.EDGES[k] for k in kinds], conv.START)
    assert collided == {q: (cost, conv.text_of(audits, node)) for q, (cost, node) in live.items()}


def test_ancestors():
    audits, node = conv.Audits(), 0
    for i in range(100):
        node = audits.add(node, i % 5, 0)
    assert all(audits.up[100][k] == 100 - 2**k for k in range(7)) and len(audits.up[100]) == 7
