import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from sessionmill.llm import prefix_trie as pt
from sessionmill.llm.zfast_trie import ZFastTrie, fattest

SCHEMA = "conv_id long, turn long, role string, text string, depth string, h1 string, n string"


def brute(rows):
    """rows: (conv_id, turn, role, text); equal turns are not tested here."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    members, ends, size, parent = defaultdict(list), defaultdict(list), {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made = own.get(c - c % 5, [])[:h] + own[c][h:]
        key = b""
        members[0, key].append(c)
        for d, (role, text) in enumerate(made, 1):
            above, key = key, hashlib.sha256(key + repr((role, text)).encode()).digest()
            members[d, key].append(c)
            size[d, key], parent[d, key] = len(text.encode()), (d - 1, above)
        ends[len(made), key].append(c)
    kids = Counter(parent.values())
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=lambda x: -x[0]):
        leaves[node] += kids[node] == 0
        saved[node] += (len(members[node]) - 1) * size.get(node, 0)
        if node in parent:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return Counter(
        (
            min(m), node[0], min(members[parent[node]]) if node in parent else None, len(m), kids[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def got(spark, rows):
    return Counter(map(tuple, pt.prefix_trie(frame(spark, rows)).collect()))


def planted(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.randrange(0, 400)
        if any(r[0] == c for r in rows):
            continue
        length = rng.choice([1, 1, 2, 3, 5, 8, 12, 30])
        turns = rng.sample(range(100), length)
        if rng.random() < 0.3:
            turns[0] = None
        rows += [(c, t, rng.choice(["user", None, ""]), rng.choice(["hi", "hi", None, "", "Ünï\U0001f511", "x" * 50])) for t in turns]
    rng.shuffle(rows)
    return [*rows, (None, 1, "user", "no id"), (None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = planted(seed)
    assert got(spark, rows) == brute(rows)


def test_long_conversations_are_cut_into_segments(spark):
    rows = [(c, t, "user", "same" if t < 5000 else f"{c % 7}-{t % 3}") for c in (10, 11, 13, 400) for t in range(8500 + c % 2)]
    assert got(spark, rows) == brute(rows)


def test_copies_and_one_hot_beginning(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(500) for t in range(4)] + [(c, t, "user", f"turn {t * (c % 3)}") for c in range(500, 600) for t in range(6)]
    assert got(spark, rows) == brute(rows)


def test_equal_turns_have_one_order(spark):
    rows = [(3, 1, "user", x) for x in "abcdefghijkl"]
    one, two = got(spark, rows), got(spark, rows[::-1])
    assert one == two and sum(one.values()) >= 1


def test_empty_tables(spark):
    assert got(spark, []) == Counter()
    assert got(spark, [(None, 1, "user", "x")]) == Counter()


def test_two_fattest_numbers():
    for low in range(40):
        for high in range(low + 1, 41):
            assert fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


def chains(sequences):
    for s in sequences:
        keys, key = [], b"root"
        for x in s:
            key = hashlib.md5(key + bytes([x])).digest()
            keys.append(key)
        yield keys


@pytest.mark.parametrize("seed", range(6))
def test_the_trie_finds_every_exit(seed):
    rng = random.Random(seed)
    words = [[rng.choice([0, 0, 0, 1]) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    words += [w[: rng.randint(0, len(w))] + [2] * rng.randint(0, 3) for w in words]
    lists = list(chains(words))
    trie, known = ZFastTrie(0, b"root"), set()
    for at in range(0, len(lists), 37):
        batch = [(keys, [1] * len(keys), at + k) for k, keys in enumerate(lists[at : at + 37])]
        trie.insert_batch(batch)
        known |= {k for keys, _, _ in batch for k in keys}
        for keys in lists:
            on, below = trie.locate(keys)
            shared = sum(k in known for k in keys)  # keys of prefixes in the trie are the first ones
            assert on.end <= shared and (on.end == shared if below is None else on.end < shared <= below.end)
    count = Counter(k for keys in lists for k in keys)
    assert {key: n for key, _, _, _, n, _ in trie.expand()} == count
    least = {}
    for n, keys in enumerate(lists):
        for k in keys:
            least.setdefault(k, n)
    assert {key: x for key, _, _, _, _, x in trie.expand()} == least


def test_a_full_task_gives_out_its_nodes(spark, monkeypatch):
    turns = pt.checkpointed(pt.own_turns(frame(spark, planted(3))))
    pieces = pt.segments(pt.rebuilt(turns)[1]).toArrow().to_batches()

    def total(held):
        monkeypatch.setattr(pt, "HELD", held)
        out = Counter()
        for batch in pt._tries(b.slice(k, 5) for b in pieces for k in range(0, b.num_rows, 5)):
            for h1, h2, n in zip(*[batch[c].to_pylist() for c in ("h1", "h2", "n")], strict=True):
                out[h1, h2] += n
        return out

    assert isinstance(pieces[0], pa.RecordBatch) and total(1) == total(1 << 18)
