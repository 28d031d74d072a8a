"""Chat changes in order against a loop over them."""

import random
import re

from trawl.functions import fixed_values as fv
from trawl.operators.chat_changes import apply_chat_changes_in_order, latest_alive

CHATS = "session_id string, chat_id string, title string, created_at bigint, updated_at bigint"
CHANGES = "seq bigint, session_id string, action string, chat_id string, title string, timestamp bigint"
DEFAULT = fv.DEFAULT_CHAT_TITLE


def number(title):
    found = re.match(rf"^{DEFAULT}.*\s(\d+)\s*$", title or "")
    return int(found[1]) if found else 1 if (title or "").strip() == DEFAULT else 0


def one_by_one(chats, changes):
    state, order = {}, []
    for session, chat, title, made, touched in chats:
        state[session, chat] = [title, made, touched]
    order = sorted(state, key=lambda k: (state[k][2] or 0, [-b for b in k[1].encode()] + [1]))
    top = max([number(v[0]) for v in state.values()], default=0)

    def touch(key):
        if key in order:
            order.remove(key)
        order.append(key)

    for _, session, action, chat, title, at in sorted(changes, key=lambda c: c[0]):
        title = (title or "").strip()
        if action == "rename" and not chat:
            chat = next((c for s, c in reversed(order) if s == session), None)
        key = (session, chat)
        if not chat or (action in ("rename", "delete") and key not in state) or action == "other":
            continue
        if action == "delete":
            del state[key]
            order.remove(key)
        elif action == "rename":
            state[key] = [title or state[key][0], state[key][1], at]
            touch(key)
        else:
            if not title:
                title = f"{DEFAULT} {1 + (sum(s == session for s, _ in state) if action == 'create' else top)}"
            state[key] = [title, at, at]
            touch(key)
        top = max([top, *[number(v[0]) for v in state.values()]])
    return sorted((*k, *v) for k, v in state.items())


def random_case(rng, n):
    titles = ["A", DEFAULT, f"{DEFAULT} 4", None]
    chats = [(f"s{i % 2}", f"c{i}", rng.choice(titles), i, rng.choice([None, *range(5)])) for i in range(rng.randrange(14))]
    changes, at = [], 100
    for seq in rng.sample(range(10 * n), n):
        changes.append([seq])
    changes.sort()
    for row in changes:
        at += rng.randrange(3)
        action = rng.choice(["create", "create_session", "rename", "rename", "delete", "delete", "other"])
        known = [f"c{rng.randrange(14)}", f"n{rng.randrange(12)}"]
        chat = f"n{rng.randrange(12)}" if action.startswith("create") else rng.choice([*known, None if action == "rename" else known[0], ""])
        row += [f"s{rng.randrange(3)}", action, chat, rng.choice([None, " ", f" T{row[0]} ", f"{DEFAULT} {rng.randrange(9)}"]), at]
    rng.shuffle(changes)
    return chats, [tuple(c) for c in changes]


def test_changes_in_order_equal_a_loop(spark):
    rng = random.Random(5)
    for case in range(5):
        chats, changes = random_case(rng, [40, 80, 80, 0, 60][case])
        got = apply_chat_changes_in_order(spark.createDataFrame(chats, CHATS), spark.createDataFrame(changes, CHANGES), ranges=[None, 5, None, None, 3][case])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(one_by_one(chats, changes), key=str)


def test_the_last_touch_that_is_alive_is_found_across_ranges(spark):
    rng = random.Random(8)
    touches, asks = [], []
    for seq in range(400):
        if rng.random() < 0.3:
            asks.append(("s", seq))
        else:
            touches.append(("s", seq, seq + rng.choice([1, 3, 20, 300]), f"c{seq}"))
    got = latest_alive(spark.createDataFrame(touches, "session_id string, seq bigint, ends bigint, chat_id string"), spark.createDataFrame(asks, "session_id string, seq bigint"), 7)
    want = {}
    for _, at in asks:
        alive = [c for _, seq, ends, c in touches if seq < at < ends]
        if alive:
            want[at] = alive[-1]
    assert {r.seq: r.chat_id for r in got.collect()} == want
