"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every text: bad (1), good (-1) or no vote (0). Expectation
maximisation over the counts of all vote patterns (at most 3^labellers rows, whatever the corpus) estimates
for each labeller how it votes on good and on bad texts, and gives each pattern a posterior. A linear
scorer over hashed features (stems of words, word lists, the signs between words, letter case, repeats)
then learns the posteriors, from `SAMPLE` rows, and judges every text. Half of these rows go to the vote patterns by their share
of the documents, the others to the rare patterns first (`quotas`); of a pattern, those rows are taken whose key
hashes come first, and they weigh as much as all rows of the pattern.

There are two such targets: junk and abuse. A text is kept if neither scorer finds it more likely bad than
good. The list of insults knows few languages, so two labellers of abuse do not rest on it: hashed words and
hashed stems (the first `STEM` bytes of a word), whose weights are fitted on at most `LABELLED` rows of the
labels table, half of them toxic at most, those whose id hashes come first. Where these vote, a text without a
listed word is no evidence against abuse. Without a labels table the list decides alone. `quality` of the
labels table is not used; it and all labelled rows outside that sample serve the tests as held-out truth.

Defined cases: a null text counts as empty; a text without words gets no vote and no feature, so it is judged
by the prior. Repeated rows are judged each. An empty table gives an empty result. `keep_good` keeps all
columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import map_rows, plain_columns, row_keys
from sessionmill.llm.words import mix, prefix_sums, span_hashes, text_slices, window_hashes

SAMPLE = 6000
FEATURES = 1 << 15
ROUNDS_EM, ROUNDS_FIT = 60, 300
LEAST_SEEN, RIDGE, RATE = 3, 1e-4, 1.0
_HASHES = 1 << 40
_FEATURE_ROWS = "place long, votes array<string>, index array<int>, value array<float>"
_LABELLED_ROWS = (
    "place long, toxic int, words_index array<int>, words_value array<float>, stems_index array<int>, stems_value array<float>"
)

STEM = 5
#: Rows of the labels table that the labellers `words` and `stems` learn from, at most half of them toxic.
LABELLED = 4000
#: Chances between which the learnt labellers do not vote.
_LEARNT_GOOD, _LEARNT_BAD = 0.3, 0.5
LEARNT = ("words", "stems")
_KINDS = 5

STOP_WORDS = (
    "the of and to in is that it for on with as was at by be this are from or an a not have "
    "le la les de des du et un une en est que qui dans pour par sur au avec ce il ne pas se "
    "der die das und ist von den dem mit zu sich auf für ein eine im nicht als auch es an werden aus "
    "el los las y del se con su al lo como más pero sus una por para"
).split()
INSULTS = (
    "idiot moron stupid scum clown worthless pathetic loser trash disgusting garbage filth vermin imbecile "
    "idiote imbécile crétin abruti stupide ordure minable pathétique "
    "dummkopf trottel abschaum wertlos erbärmlich versager widerlich "
    "idiota estúpido imbécil basura escoria payaso patético inútil asqueroso"
).split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "#$%&*|~^<>{}[]_=+\\/@"]] = True


def _word_list(words: list[str]) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), dtype=np.uint8) for w in words]
    return np.unique(np.concatenate([span_hashes(prefix_sums(r), np.array([0]), np.array([len(r)])) for r in raw]))


_STOP, _INSULT = _word_list(STOP_WORDS), _word_list(INSULTS)
_PLAIN = _word_list([" ", ", ", ". ", ".\n", "\n", "; ", ": ", "? ", "! ", ".", "'", "-"])


@dataclass
class Measured:
    """Counts per text, and the hashed features of all its words."""

    counts: dict[str, np.ndarray]
    features: np.ndarray  # all features of all texts, `_KINDS` a word
    begins: np.ndarray  # where those of each text begin
    words: np.ndarray | None = None  # one more feature a word, itself

    def learnt(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """What the labeller of this name reads: features, and where those of each text begin."""
        return self.words if name == "words" else self.features[::_KINDS], self.begins // _KINDS


def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _measure(texts: pa.Array) -> Measured:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (np.concatenate([[True], ~letter[:-1]])[: len(raw)] | edge[:-1]))
    ends = np.flatnonzero(letter & (np.concatenate([~letter[1:], [True]])[: len(raw)] | edge[1:])) + 1
    sums = prefix_sums(_LOWER[raw])
    word = span_hashes(sums, starts, ends)
    begins = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    text_end = offsets[owner + 1]
    follow = np.minimum(np.concatenate([starts[1:], [len(raw)]])[: len(starts)], text_end)
    gap = span_hashes(prefix_sums(raw), ends, follow)
    ups = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    upper = ups[ends] - ups[starts]
    size = ends - starts
    capital = (upper == size) & (size > 1)
    case = np.where(capital, 2, np.where(upper > 0, 1, 0)).astype(np.uint64)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[begins[1:]] - total[begins[:-1]]

    signs = np.concatenate([[0], np.cumsum(_SIGN[raw])])
    runs = window_hashes(word, 5)
    repeated = np.zeros(len(texts))
    for k, (low, high) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
        if high - low > 5:
            repeated[k] = 1 - len(np.unique(runs[low : high - 4])) / (high - 4 - low)
    stop, insult = _in(_STOP, word), _in(_INSULT, word)
    counts = {
        "bytes": np.diff(offsets),
        "words": np.diff(begins),
        "signs": signs[offsets[1:]] - signs[offsets[:-1]],
        "capital": per_text(capital),
        "again": per_text(again),
        "plain": per_text(_in(_PLAIN, gap) | (follow == text_end)),
        "heavy": per_text((follow - ends > 3)),
        "stop": per_text(stop),
        "letters": per_text(size),
        "insults": per_text(insult),
        "repeated": repeated,
    }
    listed = stop.astype(np.uint64) + np.uint64(2) * insult.astype(np.uint64)
    stem = span_hashes(sums, starts, np.minimum(ends, starts + STEM))
    kinds = [stem, mix(listed + np.uint64(31)), mix(gap + np.uint64(1)), mix(case * np.uint64(3) + again.astype(np.uint64) + np.uint64(11)), mix(gap + case * np.uint64(7919))]
    place = lambda k: (k >> np.uint64(40)).astype(np.int64) % FEATURES
    return Measured(counts, np.stack([place(k) for k in kinds], axis=1).ravel(), begins * _KINDS, place(word))


def measured(texts: pa.Array) -> Iterator[tuple[int, int, Measured]]:
    """Slices (first, end, measures) of about a megabyte each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    for first, stop in text_slices(texts):
        yield first, stop, _measure(texts.slice(first, stop - first))


def _vote(value: np.ndarray, good: float, bad: float) -> np.ndarray:
    """-1 up to `good`, 1 from `bad` on, else 0 (the other way round if bad < good)."""
    if bad < good:
        return np.where(value >= good, -1, np.where(value <= bad, 1, 0))
    return np.where(value <= good, -1, np.where(value >= bad, 1, 0))


def votes(m: Measured, learnt: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Votes by target: one row per text, one column per labeller; `learnt` holds the weights of those of LEARNT."""
    counts = m.counts
    words = np.maximum(counts["words"], 1)
    share = {name: counts[name] / words for name in ("capital", "again", "plain", "heavy", "stop", "letters", "insults")}
    junk = [
        _vote(counts["signs"] / np.maximum(counts["bytes"], 1), 0.01, 0.06),
        _vote(share["capital"], 0.05, 0.3),
        _vote(share["again"], 0.02, 0.2),
        _vote(share["plain"], 0.9, 0.6),
        _vote(share["heavy"], 0.05, 0.3),
        _vote(share["stop"], 0.08, 0.01),
        _vote(counts["repeated"], 0.1, 0.4),
        _vote(np.abs(share["letters"] - 6), 3.0, 7.0),
    ]
    abuse = [
        _vote(counts["insults"], 0, 2),
        _vote(share["insults"], 0.0, 0.004),
        _vote(np.sqrt(counts["insults"] * share["insults"]), 0.02, 0.1),
    ]
    if learnt:
        abuse += [_vote(_chance(*m.learnt(name), learnt[name]), _LEARNT_GOOD, _LEARNT_BAD) for name in LEARNT]
    none = counts["words"] == 0
    return {target: np.where(none[:, None], 0, np.stack(v, axis=1)) for target, v in (("junk", junk), ("abuse", abuse))}


TARGETS = ("junk", "abuse")
_LISTED = 3  # labellers of abuse that follow the list


def _chance(features: np.ndarray, begins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each text's chance of being bad by a scorer's weights."""
    total = np.concatenate([[0.0], np.cumsum(weights[features])])
    margin = (total[begins[1:]] - total[begins[:-1]]) / np.sqrt(np.maximum(np.diff(begins), 1)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS_EM, quiet: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of `bad` per vote pattern, and P(vote | class) as [class, labeller, vote + 1].

    Labellers count as independent given the class. It starts from the majority vote. Of the first `quiet`
    labellers only the votes for bad are evidence.
    """
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeller, vote
    heard = onehot.copy()
    heard[:, :quiet, :2] = 0
    score = heard[:, :, 2].sum(axis=1) - heard[:, :, 0].sum(axis=1)
    bad = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    rates = np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds if len(counts) else 0):
        weight = np.stack([(1 - bad) * counts, bad * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        rates = np.einsum("cp,plv->clv", weight, onehot) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        odds = np.log(prior)[:, None] + np.einsum("plv,clv->cp", heard, np.log(rates))
        bad = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
    return bad, rates


def fit_scorer(index: np.ndarray, value: np.ndarray, owner: np.ndarray, labels: np.ndarray, amount: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer; entries are a feature, its value and its row.

    A row stands for `amount` rows. Features that fewer than `LEAST_SEEN` rows carry weigh nothing.
    """
    if not len(labels):
        return np.zeros(FEATURES + 1)
    # Both classes weigh the same, so that a rare one is learnt.
    amount = np.ones(len(labels)) if amount is None else amount / amount.mean()
    share = min(max(float((labels * amount).mean()), 1e-4), 1 - 1e-4)
    weight = amount * np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share))
    seen = np.bincount(index, minlength=FEATURES) >= LEAST_SEEN  # rarer ones only learn rows by heart
    index, value, owner = index[seen[index]], value[seen[index]], owner[seen[index]]
    weights, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    for _ in range(ROUNDS_FIT):  # AdaGrad over the whole sample
        margin = np.bincount(owner, value * weights[index], len(labels)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * weight / len(labels)
        slope = np.append(np.bincount(index, value * error[owner], FEATURES), error.sum()) + RIDGE * weights
        squares += slope * slope
        weights -= RATE * slope / np.sqrt(squares)
    return weights


def _values(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their values: counts over the root of the text's length."""
    index, count = np.unique(features, return_counts=True)
    return index, count / np.sqrt(max(1, len(features)))


class Model:
    """Weights by target, and what was learnt about the labellers."""

    def __init__(self, weights: dict[str, np.ndarray], rates: dict[str, np.ndarray]):
        self.weights, self.rates = weights, rates

    def scores(self, texts: pa.Array) -> dict[str, np.ndarray]:
        out: dict[str, list[np.ndarray]] = {t: [] for t in self.weights}
        for _, _, m in measured(texts):
            for target, weights in self.weights.items():
                out[target].append(_chance(m.features, m.begins, weights))
        return {t: np.concatenate([np.zeros(0), *parts]) for t, parts in out.items()}


def _vote_keys(v: np.ndarray) -> list[str]:
    return ["".join("-.+"[x + 1] for x in row) for row in v]


def _cast_votes(batches: Iterator[pa.RecordBatch], learnt: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, m in measured(batch["text"]):
            v = votes(m, learnt)
            yield pa.RecordBatch.from_arrays([pa.array(_vote_keys(v[t]), pa.string()) for t in TARGETS], list(TARGETS))


def learn_labellers(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict[str, np.ndarray] | None:
    """Weights of the labellers of LEARNT, from at most `most` labelled rows; None if one class is missing."""
    labels = plain_columns(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    toxic = min(counts[1], most // 2)
    share = {1: toxic / counts[1], 0: min(1.0, (most - toxic) / counts[0])}
    place = F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(_HASHES))
    bound = F.when(F.col("toxic") == 1, int(share[1] * _HASHES)).otherwise(int(share[0] * _HASHES))
    picked = F.broadcast(labels.where(place < bound).limit(2 * most))
    rows = docs.join(picked, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64(*row_keys()).alias("place"))
    part = rows.mapInArrow(_labelled, _LABELLED_ROWS).limit(2 * most).toArrow().sort_by([("place", "ascending"), ("toxic", "ascending")])
    part, learnt = part.slice(0, most).combine_chunks(), {}
    for name in LEARNT:
        index, value, owner = _entries(part[f"{name}_index"], part[f"{name}_value"])
        learnt[name] = fit_scorer(index, value, owner, part["toxic"].to_numpy().astype(float))
    return learnt


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, stop, m in measured(batch["text"]):
            columns = [batch["place"].slice(first, stop - first), batch["toxic"].slice(first, stop - first)]
            for name in LEARNT:
                features, begins = m.learnt(name)
                columns += _packed([_values(features[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)])
            names = [f"{name}_{x}" for name in LEARNT for x in ("index", "value")]
            yield pa.RecordBatch.from_arrays(columns, ["place", "toxic", *names])


def _packed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    return [
        pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
        pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32())),
    ]


def _entries(index: pa.ChunkedArray, value: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = pc.list_value_length(index).to_numpy()
    return pc.list_flatten(index).to_numpy(), pc.list_flatten(value).to_numpy(), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Labellers' rates over all documents, and scorers fitted on at most `sample` rows."""
    docs = plain_columns(docs, "doc_id", "text")
    learnt = None if labels is None else learn_labellers(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    # One pass for both targets: at most 3^13 pairs of patterns, in practice a few hundred.
    cast = docs.select("text").mapInArrow(lambda batches: _cast_votes(batches, shared.value), ", ".join(f"{t} string" for t in TARGETS))
    counted = cast.groupBy(*TARGETS).count().collect()
    posterior, rates = {}, {}
    for target in TARGETS:
        table: dict[str, int] = {}
        for row in counted:
            table[row[target]] = table.get(row[target], 0) + row["count"]
        keys = sorted(table)
        patterns = np.array([["-.+".index(c) - 1 for c in k] for k in keys], dtype=int).reshape(len(keys), -1 if keys else 1)
        quiet = _LISTED if learnt and target == "abuse" else 0
        bad, rates[target] = expectation_maximisation(patterns, np.array([table[k] for k in keys], dtype=float), quiet=quiet)
        posterior[target] = dict(zip(keys, bad, strict=True))
    # Rows whose key hash lies below their pattern's bound, which lets some more than the quota pass; they are
    # few and spread over all tasks, so only their features travel.
    order = F.pmod(F.xxhash64(*row_keys(), F.lit("sample")), F.lit(_HASHES))
    held = {tuple(row[t] for t in TARGETS): row["count"] for row in counted}
    quota = dict(zip(held, quotas(np.array(list(held.values()), dtype=float), sample), strict=True))
    bounds = {k: min(_HASHES, 1 + int((n + 2 * np.sqrt(n) + 1) / held[k] * _HASHES)) for k, n in quota.items()}
    picks = docs.sparkSession.sparkContext.broadcast((learnt, bounds))
    chosen = docs.select("text", order.alias("place")).mapInArrow(lambda batches: _features(batches, *picks.value), _FEATURE_ROWS)
    part = chosen.limit(4 * sample).toArrow().sort_by("place").combine_chunks()
    pattern, taken, rows = [tuple(v) for v in part["votes"].to_pylist()], dict.fromkeys(held, 0), []
    for k, key in enumerate(pattern):
        if taken.get(key, np.inf) < quota.get(key, 0):
            taken[key] += 1
            rows.append(k)
    part = part.take(pa.array(rows, pa.int64())).combine_chunks()
    index, value, owner = _entries(part["index"], part["value"])
    amount = np.array([held[pattern[k]] / taken[pattern[k]] for k in rows])
    truth = {t: np.array([posterior[t][pattern[j][k]] for j in rows]) for k, t in enumerate(TARGETS)}
    return Model({t: fit_scorer(index, value, owner, truth[t], amount) for t in TARGETS}, rates)


def quotas(counts: np.ndarray, sample: int) -> np.ndarray:
    """Rows to take of each pattern, about `sample` together: half by share, the rest where a pattern has fewest."""
    if counts.sum() <= sample:
        return counts
    shared, low, high = counts / counts.sum() * sample / 2, 0.0, float(sample)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(counts, np.maximum(shared, middle)).sum() <= sample else (low, middle)
    return np.minimum(counts, np.maximum(shared, low))


def _features(
    batches: Iterator[pa.RecordBatch], learnt: dict[str, np.ndarray] | None, bounds: dict[tuple[str, ...], int]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, stop, m in measured(batch["text"]):
            v = votes(m, learnt)
            keys = list(zip(*[_vote_keys(v[t]) for t in TARGETS], strict=True))
            place = batch["place"].slice(first, stop - first)
            taken = np.flatnonzero(place.to_numpy() < np.array([bounds.get(k, 0) for k in keys]))
            pairs = [_values(m.features[m.begins[k] : m.begins[k + 1]]) for k in taken]
            votes_taken = pa.array([list(keys[k]) for k in taken], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([place.take(pa.array(taken, pa.int64())), votes_taken, *_packed(pairs)], ["place", "votes", "index", "value"])


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, the score of each target (chance of being bad), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch["text"])
            kept = np.logical_and.reduce([scores[t] <= 0.5 for t in TARGETS])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(scores[t]) for t in TARGETS], pa.array(kept)], ["doc_id", *TARGETS, "kept"])

    docs = plain_columns(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{t} double' for t in TARGETS)}, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that no scorer rejects, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(place))
            yield batch.filter(pa.array(np.logical_and.reduce([scores[t] <= 0.5 for t in TARGETS])))

    return map_rows(docs, run)
