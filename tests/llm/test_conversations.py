"""Conversation repair against a plain loop, at any cut into ranges and blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from trawl.llm import conversations, role_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def plain_audit(rows):
    """Least (cost, audit) of rows (initial, cut, gone), by a search over parse positions without a stack."""
    ahead = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    now = {"": (0, "")}

    def spread(ways):
        for _ in range(4):
            for state, (cost, audit) in list(ways.items()):
                for role in "ua":
                    if role in ahead[state]:
                        to, way = ahead[state][role], (cost + 3, audit + "I")
                        ways[to] = min(ways.get(to, way), way)
        return ways

    spread(now)
    for initial, cut, gone in rows:
        new = {}
        for state, (cost, audit) in now.items():
            ways = [(state, cost + 4, "D")]
            if not gone:
                if initial in ahead[state]:
                    ways.append((ahead[state][initial], cost + 3 * cut, "K"))
                ways += [(ahead[state][r], cost + 3 * cut + 3, "R") for r in "ua" if r in ahead[state]]
            for to, c, edit in ways:
                new[to] = min(new.get(to, (c, audit + edit)), (c, audit + edit))
        now = spread(new)
    return min(w for state, w in now.items() if state in ("", "a"))


def all_audits(rows):
    """The same by trying every edit of every row, with at most two inserts in each gap."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, (*edits, "")))
            cost = 3 * sum(gaps)
            choices = [["u", "a"]] * gaps[0]
            for (initial, cut, gone), edit, gap in zip(rows, edits, gaps[1:]):
                if gone and edit != "D":
                    break
                cost += {"K": 0, "R": 3, "D": 4}[edit] + (3 * cut if edit != "D" else 0)
                choices = choices + ([[initial]] if edit == "K" else [["u", "a"]] if edit == "R" else []) + [["u", "a"]] * gap
            else:
                if (best is None or (cost, audit) < best) and any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*choices)):
                    best = (cost, audit)
    return best


def plain(rows):
    """The contract over rows (conv_id, turn, role, text), conversation by conversation."""
    found = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            row = (turn, "user" if kind == 4 else role, text)
            kept += [] if kind == 0 else [row, row] if kind == 3 else [row]
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        if not kept:
            found[conv] = NONE
            continue
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = duplicate = truncated = 0
        seen, marks = set(), []
        for _, role, text in kept:
            shown = text.strip(" \t\n\x0b\x0c\r")
            cut = gone = False
            if not shown:
                blank, gone = blank + 1, True
            elif (role, text) in seen:
                duplicate, gone = duplicate + 1, True
            elif shown[-1] not in ".!?":
                truncated, cut = truncated + 1, True
            seen.add((role, text))
            marks.append((role[:1], cut, gone))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = plain_audit(marks)
        out, before, at = [], "", iter(kept)
        for edit in audit:
            expected = "assistant" if before == "u" else "user"
            role, text = (expected, "") if edit == "I" else next(at)[1:]
            if edit != "D":
                role = role if edit == "K" else expected
                out.append(f"{role}:{text}")
                before = role[:1]
        found[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "uncle", None])
            text = rng.choice(["Hello there.", "Why? ", "cut off", "", " \t\n", "a.b", "Fine!\n", None, f"text {rng.random()}.", " ", "x . \x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
            turn += rng.choice([0, 1, 1, 1, 4])
    return rows


def test_automaton_accepts_the_language():
    graph = role_repair.GRAPH
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stacks = {0}
            for c in word:
                stacks = {x for node in stacks for x in graph.moves[node][c]}
            assert bool(stacks & graph.accepts) == bool(re.fullmatch("(s?(ua)+)?", "".join(word))), word


def test_another_grammar():
    graph = role_repair.StackGraph(role_repair.Automaton({"A": ["B", "Ab"], "B": ["", "c"]}))
    for n in range(6):
        for word in itertools.product("bc", repeat=n):
            stacks = {0}
            for c in word:
                stacks = {x for node in stacks for x in graph.moves[node][c]}
            assert bool(stacks & graph.accepts) == bool(re.fullmatch("c?b*", "".join(word))), word
    with pytest.raises(ValueError):
        role_repair.StackGraph(role_repair.Automaton({"A": ["", "bAc"]}))


def marks_of(rng, n):
    return [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(n)]


def code(mark):
    initial, cut, gone = mark
    return "d" if gone else initial.upper() if cut else initial


def test_least_edits_by_every_trial():
    rng = random.Random(3)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3]:
        for _ in range(6):
            marks = marks_of(rng, n)
            table = role_repair.block_table(0, "".join(map(code, marks)))
            best = min(w for node, w in table.items() if node in role_repair.GRAPH.accepts)
            assert best == plain_audit(marks) == all_audits(marks), marks


def test_blocks_join_to_the_same_path():
    rng = random.Random(4)
    for _ in range(150):
        marks = marks_of(rng, rng.randrange(1, 60))
        rows, fold, pieces, at = "".join(map(code, marks)), role_repair.Fold(), [], 0
        while at < len(rows):
            size = rng.randrange(1, 9)
            tables = {start: role_repair.block_table(start, rows[at : at + size]) for start in role_repair.GRAPH.live}
            fold.add(tables), pieces.append(tables)
            at += size
        cost, steps = fold.path()
        assert (cost, "".join(t[a][b][1] for t, (a, b) in zip(pieces, steps))) == plain_audit(marks)


def compare(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", copy string, dropped int")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df), **how).collect()}
    assert got == plain(rows)


def test_repair_against_a_loop(spark):
    rows = random_rows(7, 60, 14) + [(None, 0, "user", "Ask."), (None, 1, "assistant", "Answer."), (5, None, None, None)]
    rows += rows[:9]
    compare(spark, rows)
    compare(spark, rows, block_rows=2, ranges=7)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(8)
    long = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["A.", f"b {i}.", f"c {i}", ""])) for i in range(900)]
    long += [(1, 77, "user", "again.")] * 50 + [(2, 0, "user", "y" * 500000 + ".")]
    compare(spark, long + random_rows(9, 6, 9), block_rows=16, ranges=5)


def test_empty(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
