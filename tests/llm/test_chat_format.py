from itertools import product

import pytest
from helpers import SF

from sessionmill.llm import chat_format as cf

COLUMNS = "conv_id long, turn long, role string, text string, rendered string, piece int"


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest)) and (rest or not roles)


def cheapest(given):
    """Least cost over all ways to relabel and merge, with the cheapest empty turns for each."""
    best = 10**9
    for roles in product(cf.ROLES, repeat=len(given)):
        cost = sum(0 if r == g else cf.RELABEL if g else cf.RELABEL_UNKNOWN for r, g in zip(roles, given))
        for cuts in product((False, True), repeat=max(0, len(given) - 1)):
            if any(m and roles[i] != roles[i + 1] for i, m in enumerate(cuts)):
                continue
            turns = [roles[0]] + [roles[i + 1] for i, m in enumerate(cuts) if not m] if roles else []
            total = cost + cf.MERGE * sum(cuts)
            if "system" in turns[1:]:
                continue
            empty, last = 0, "assistant"
            for t in turns:
                if t != "system":
                    empty += t == last
                    last = t
            empty += last == "user"
            empty += 2 * (turns == ["system"])
            best = min(best, total + cf.INSERT * empty)
    return best


def repaired(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.out_turn, r.part)):
        convs.setdefault(r.conv_id, []).append(r)
    return convs


def check(rows, source):
    """Legal turns, every source turn once and in order, least cost, markup in place."""
    for conv, out in repaired(rows).items():
        given = source[conv]
        turns = [r.role for r in out if r.part == 0]
        assert legal(turns), (conv, turns)
        assert [(r.source_role, r.text) for r in out if r.action != "insert"] == [(role, text or "") for role, text in given]
        assert [r.out_turn for r in out if r.part == 0] == list(range(len(turns)))
        for a, b in zip(out, out[1:]):
            assert b.part == (a.part + 1 if b.out_turn == a.out_turn else 0) and (b.part > 0) == (b.action == "merge")
        names = [cf.ALIASES.get((role or "").strip().lower(), (role or "").strip().lower()) for role, _ in given]
        names = [n if n in cf.ROLES else None for n in names]
        done = [r.role for r in out if r.action != "insert"]
        cost = sum(0 if r == n else cf.RELABEL if n else cf.RELABEL_UNKNOWN for r, n in zip(done, names))
        cost += cf.MERGE * sum(r.action == "merge" for r in out) + cf.INSERT * sum(r.action == "insert" for r in out)
        if len(given) <= 6:
            assert cost == cheapest(names), (given, out)
        whole = {t: "\n".join(r.text for r in out if r.out_turn == t) for t in range(len(turns))}
        assert "".join(r.rendered for r in out) == "".join(f"<|im_start|>{role}\n{whole[t]}<|im_end|>\n" for t, role in enumerate(turns))


def test_all_short_role_sequences(spark):
    rows, source = [], {}
    for n in range(1, 5):
        for given in product([*cf.ROLES, None], repeat=n):
            conv = len(source)
            source[conv] = [(r, f"t{k}") for k, r in enumerate(given)]
            rows += [(conv, k, r, f"t{k}", "x", 1) for k, r in enumerate(given)]
    out = cf.repair_roles(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(repaired(out)) == len(source)
    check(out, source)


def test_one_conversation_over_many_pieces(spark):
    import random

    rng = random.Random(4)
    given = [(rng.choice(["user", "user", "assistant", "tool", "system", "Human "]), f"text {k}") for k in range(3000)]
    given += [("user", f"late {k}") for k in range(800)]  # one turn that spans pieces
    rows = [(7, k, r, t, "x", 1) for k, (r, t) in enumerate(given)] + [(8, 0, "user", "hi", "x", 1)]
    out = cf.repair_roles(spark.createDataFrame(rows, COLUMNS)).collect()
    source = {7: given, 8: [("user", "hi")]}
    check(out, source)
    names = [cf.ALIASES.get(r.strip().lower(), r.strip().lower()) for r, _ in given]
    names = [n if n in cf.ROLES else None for n in names]
    total = cf.piece_matrix(names)[cf.START]
    best = min(int(total[s]) + cf.end_cost(s) for s in range(4))
    own = [r for r in out if r.conv_id == 7]
    cost = cf.MERGE * sum(r.action == "merge" for r in own) + cf.INSERT * sum(r.action == "insert" for r in own)
    cost += sum(0 if r.role == n else cf.RELABEL if n else cf.RELABEL_UNKNOWN for r, n in zip([x for x in repaired(out)[7] if x.action != "insert"], names))
    assert cost == best


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "u"), (None, 1, None, None), (1, None, "USER", "first"), (1, 0, "gpt", ""), (1, 0, "gpt", ""), (1, 0, "assistant", "tie"),
        (2**60 + 1, 0, "user", "a" * 100_000), (2**60, 5, "bot", "b"), (2**60, 4, "odd role", "c"),
    ]
    out = cf.repair_roles(spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)).collect()
    check(
        out,
        {
            None: [("user", "u"), (None, None)],
            1: [("USER", "first"), ("assistant", "tie"), ("gpt", "")],
            2**60 + 1: [("user", "a" * 100_000)],
            2**60: [("odd role", "c"), ("bot", "b")],
        },
    )
    assert cf.repair_roles(spark.createDataFrame([], COLUMNS)).collect() == []


def test_given_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    source = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        source.setdefault(r.conv_id, []).append((r.role, r.text))
    out = cf.repair_roles(rows).collect()
    assert len(repaired(out)) == len(source)
    check(out, source)


@pytest.mark.parametrize("given", [["user"], [None, None], ["assistant", "assistant", "user"]])
def test_matrix_and_path_agree(given):
    total = cf.piece_matrix(given)[cf.START]
    for last in range(1, 4):
        state, cost = cf.START, 0
        for role, now in zip(given, cf.best_path(given, cf.START, last)):
            cost += cf.step_cost(state, now, role)[0]
            state = now
        assert min(cost, cf._NEVER) == total[last]
