import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import odd_docs

from sessionmill.llm import collocations as co


def brute(rows, least=10, top=2000):
    """rows: (lang, text)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            total[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + 2] for p, a in cand.items() if len(p) == 3 for i in (0, 1) if 100 * a >= 50 * counts[p[i : i + 2]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min(
                    (1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
                )
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(docs):
    return sorted(map(tuple, co.collocations(docs).collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")


def planted(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["a", "A", "bb", "Über", "ÜBER", "x" * 500, "new", "York", "city", " ", "'s", "\U0001d7d8", "-", "cc"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(["new york city", "bb cc", rng.choice(vocabulary), rng.choice(vocabulary)]) for _ in range(rng.randint(0, 12))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for p in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([text, text, None, ""]) if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = planted(seed)
    assert got(frame(spark, rows)) == brute(rows)


def test_bursts_and_spills_change_nothing(spark, monkeypatch):
    rows = planted(3)
    monkeypatch.setattr(co, "BURST", 4)
    monkeypatch.setattr(co, "HELD", 20)
    monkeypatch.setattr(co, "_MOST_WORDS", 12)
    table = np.full(co.BITS // 8, 255, dtype=np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["lang", "text"])
    parts = [batch.slice(at, 25) for at in range(0, len(rows), 25)]
    for order, bits in ((2, None), (3, table)):
        seen = defaultdict(int)
        for out in co._counting(iter(parts), order, bits):
            for lang, phrase, f in zip(*[c.to_pylist() for c in out.columns], strict=True):
                seen[lang, phrase] += f
        want = Counter()
        for lang, text in rows:
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
                words = [w for w in re.split(r"[ \t]", piece) if w]
                sizes = (1, 2) if order == 2 else (3,)
                want.update((lang or "und", " ".join(words[i : i + s])) for s in sizes for i in range(len(words) - s + 1))
                if order == 2:
                    want[lang or "und", ""] += len(words)
        assert {k: v for k, v in seen.items() if v} == {k: v for k, v in want.items() if v}


def test_a_long_text_of_one_word(spark):
    rows = [("en", "same " * 200_000), ("en", "y" * 300_000), ("de", "a b")]
    assert got(frame(spark, rows)) == brute(rows)


def test_the_table_of_pairs_holds_each(spark):
    pairs = [("en", f"w{i} w{i * 7 % 50}") for i in range(500)] + [("und", "w1 w7")]
    table = co.pair_table(spark.createDataFrame(pairs, "lang string, phrase string"))
    for lang, phrase in pairs:
        (place,) = co.pair_places(*(co.word_hashes([w]) for w in phrase.split(" ")), lang).tolist()
        assert table[place >> 3] >> (place & 7) & 1
    assert np.unpackbits(table).sum() <= len(pairs)


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    assert got(docs) == brute([(r.lang, r.text) for r in docs.collect()])
    assert got(docs.where("false")) == []
    assert got(docs.where("text is null")) == []


def test_exact_scores_beyond_64_bits(spark):
    big = 5 * 10**9
    value = spark.sql(f"SELECT 1000000 * cast({big} AS decimal(15,0)) * cast({big} AS decimal(15,0)) div (cast({big} AS decimal(19,0)) * cast({big + 1} AS decimal(19,0))) AS s")
    assert value.first().s == 1_000_000 * big * big // (big * (big + 1))
