"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into symbols: insult, threat, target, negation, reported speech, other. Small machines for
negation (holds for some words), reported speech (holds to the end of the clause), target and threat read those symbols;
their composition is one table of states. Where an insult or a threat is read, the state says in which setting it stands
(negated, reported, aimed at somebody), and the match is worth the word's weight plus the weight of that setting. A clause
counts its best match, a text the sum over its clauses, and a logistic curve makes that a score between 0 and 1.

Insults are learned: words, and stems of four to six bytes, with a high log-odds ratio between toxic and clean labelled
texts that is significant at the number of labels: by the binomial chance of so many toxic texts among those with the
feature, at a false discovery rate of ``FALSE_SHARE`` over all features of the sample. Near copies count once there, else
every word of a copied toxic text would pass for an insult; they are texts that share one of ``BANDS`` keys of ``BAND_ROWS``
least hashes of their runs of ``RUN`` words, and what these link. So are the weights of the settings and the curve. Labels are read from at most ``per_class`` toxic and three times as
many clean rows, those with the least hash of their id; scoring reads every whole text.

Defined results: a null or empty text matches nothing and gets the score of no match; rows are scored one by one, so
repeated rows repeat; without labels nothing is learned and every score is that of no match; among several labels of one
id the toxic one holds; a null id is never a labelled one. Other columns are untouched.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.llm.frames import by_slices, lists
from smsight.llm.words import LETTERS, Words, mix, shingles

PER_CLASS = 4000
FALSE_SHARE = 0.01
RUN = 5
BANDS, BAND_ROWS = 8, 3
LEAST_WEIGHT = 3.0
STEMS = (4, 5, 6)
NEGATION_REACH = 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# closed word classes of English, French, German and Spanish
CLOSED = {
    THREAT: "kill hurt destroy attack beat burn shoot stab tuer frapper détruire brûler töten schlagen vernichten verbrennen "
            "matar golpear destruir quemar",
    TARGET: "you your yours they them their he she him her tu toi vous vos ils elles leur du dich dein sie ihr euch tú ti "
            "usted ustedes ellos ellas",
    NEGATION: "not no never nobody isn aren don doesn ne pas jamais aucun nicht kein keine nie niemals nunca jamás tampoco",
    REPORT: "said says say quoted wrote claimed called according dit disent écrit selon cité sagte sagt schrieb laut zitiert "
            "dijo dice escribió según citó",
}

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".!?;:\n\r")] = True


class Machine:
    """A finite-state transducer over word symbols; what it shows in a state is read when a match is made."""

    def __init__(self, moves: dict[tuple[int, int], int], rest: dict[int, int], shows: dict[int, int]):
        self.moves, self.rest, self.shows = moves, rest, shows

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), self.rest.get(state, state))


def machines(reach: int = NEGATION_REACH) -> list[Machine]:
    fading = {s: s - 1 for s in range(1, reach + 1)}
    return [
        Machine({(s, NEGATION): reach for s in range(reach + 1)}, fading | {0: 0}, {s: int(s > 0) for s in range(reach + 1)}),
        Machine({(0, REPORT): 1}, {}, {0: 0, 1: 1}),
        Machine({(0, TARGET): 1}, {}, {0: 0, 1: 1}),
    ]


class Grammar:
    """The composition of the machines: ``follow[state, symbol]`` and the setting that each state shows."""

    def __init__(self, parts: list[Machine] | None = None):
        parts = machines() if parts is None else parts
        states = list(itertools.product(*(sorted(m.shows) for m in parts)))
        number = {s: i for i, s in enumerate(states)}
        self.start = number[tuple(0 for _ in parts)]
        self.follow = np.array([[number[tuple(m.step(x, symbol) for m, x in zip(parts, s))] for symbol in range(6)] for s in states])
        self.setting = np.array([sum(m.shows[x] << k for k, (m, x) in enumerate(zip(parts, s))) for s in states])
        self.settings = 1 << len(parts)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes of insult words and stems
    weights: np.ndarray
    settings: np.ndarray  # weight of an insult in each setting, then of a threat in each
    slope: float = 1.0
    base: float = -4.0


def _closed() -> tuple[np.ndarray, np.ndarray]:
    names = [(w, symbol) for symbol, text in CLOSED.items() for w in text.split()]
    words = Words(pa.array([w for w, _ in names]), LETTERS)
    hashes = words.hashes()
    order = np.argsort(hashes)
    return hashes[order], np.array([s for _, s in names])[order]


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    hit = np.flatnonzero(table[at] == values)
    return hit, at[hit]


def _matches(words: Words, model: Model, grammar: Grammar, closed) -> list[tuple[int, int, int, float]]:
    """(text, clause, setting, weight of the word) of every insult, and of threats at somebody (setting beyond the insults')."""
    weight = np.zeros(len(words))
    symbol = np.zeros(len(words), np.int64)
    hashes = words.hashes()
    hit, number = _find(closed[0], hashes)
    symbol[hit] = closed[1][number]
    if len(model.features):
        marks = np.zeros(1 << 16, bool)
        marks[model.features >> np.uint64(48)] = True
        for values in [hashes, *(words.hashes(prefix=k) for k in STEMS)]:
            near = np.flatnonzero(marks[values >> np.uint64(48)])
            hit, number = _find(model.features, values[near])
            weight[near[hit]] = np.maximum(weight[near[hit]], model.weights[number])
    symbol[weight > 0] = INSULT
    events = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(events):
        return []
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[words.data])])
    text = words.text_of_word()
    clause = breaks[words.starts] + text  # a new text is a new clause, too
    out = []
    for c in np.unique(clause[events]):
        first, last = np.searchsorted(clause, c), np.searchsorted(clause, c, "right")
        inside = symbol[first:last]
        aimed = bool((inside == TARGET).any())
        state, before = grammar.start, first
        for i in first + np.flatnonzero(inside != OTHER):
            for _ in range(min(int(i) - before, NEGATION_REACH)):
                state = grammar.follow[state, OTHER]
            s = int(symbol[i])
            if s == INSULT:
                out.append((int(text[i]), int(c), int(grammar.setting[state]), float(weight[i])))
            elif s == THREAT and aimed:
                out.append((int(text[i]), int(c), grammar.settings + int(grammar.setting[state]), 1.0))
            state, before = grammar.follow[state, s], int(i) + 1
    return out


def _strength(found: list[tuple[int, int, int, float]], model: Model, n: int) -> np.ndarray:
    """Per text the sum over clauses of the best match."""
    best: dict[tuple[int, int], float] = {}
    for text, clause, setting, weight in found:
        best[text, clause] = max(best.get((text, clause), 0.0), weight + float(model.settings[setting]))
    out = np.zeros(n)
    for (text, _), value in best.items():
        out[text] += max(0.0, value)
    return out


def band_keys(texts: pa.Array) -> np.ndarray:
    """[text, band]: keys that near copies share with a high chance; those of a text without words are all its own 0."""
    words = Words(texts, LETTERS)
    value, begins = shingles(words.hashes(), words.first, RUN)
    out = np.zeros((len(texts), BANDS), np.uint64)
    some = np.flatnonzero(np.diff(begins))
    if not len(some):
        return out
    for band in range(BANDS):
        for row in range(BAND_ROWS):
            seed = mix(np.array([1 + band * BAND_ROWS + row], np.uint64))
            out[some, band] = mix(out[some, band] + np.minimum.reduceat(mix(value ^ seed), begins[some]))
    return out


def near_groups(keys: list[int], bands: list[list[int]]) -> dict[int, int]:
    """The group of each text (given by its key): texts that share a key of a band are linked."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for key, own in zip(keys, bands):
        for band, value in enumerate(own):
            if value:
                above[top((band, value))] = top(key)
    return {key: top(key) for key in keys}


def chance(bad: int, good: int, share: float) -> float:
    """The chance of at least ``bad`` toxic ones among bad + good texts if toxic ones had ``share`` of them."""
    n = bad + good
    if not 0 < share < 1:
        return 1.0
    whole = math.lgamma(n + 1)
    return min(1.0, sum(math.exp(whole - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(share) + (n - x) * math.log(1 - share))
                        for x in range(bad, n + 1)))


def significant(counts: dict[int, tuple[int, int]], all_bad: int, all_good: int, tested: int, false_share: float = FALSE_SHARE) -> set[int]:
    """Those of the features (bad, good texts) that Benjamini and Hochberg's rule keeps, out of ``tested`` ones."""
    share = (all_bad + 1) / (all_bad + all_good + 2)
    order = sorted((chance(b, g, share), f) for f, (b, g) in counts.items())
    last = max((k for k, (p, _) in enumerate(order, 1) if p <= false_share * k / max(tested, 1)), default=0)
    return {f for _, f in order[:last]}


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column,
                    per_class: int) -> DataFrame:
    """(text, toxic) of the bounded labelled rows that may be learned from."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic"))
    order = F.xxhash64(F.col("labelled").cast("string"))
    some = [known.where(F.col("toxic") == 1).orderBy(order).limit(per_class), known.where(F.col("toxic") == 0).orderBy(order).limit(3 * per_class)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # at most 4 * per_class rows of an id and a number
    return documents.select(F.col(id_col).alias("labelled"), F.col(text_col).cast("string").alias("text")).join(picked, "labelled").select("text", "toxic")


def train(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn lexicon, setting weights and curve; ``learn`` is a condition on rows of ``labels``."""
    sample = labelled_sample(documents, labels, id_col, text_col, label_col, learn, per_class)
    spark, grammar, closed = documents.sparkSession, Grammar(), _closed()

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"), LETTERS)
        text = words.text_of_word()
        flat = [np.zeros(0, np.uint64)]
        toxic = [np.zeros(0, np.int64)]
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for values in [words.hashes(), *(words.hashes(prefix=k) for k in STEMS)]:
            own = np.unique(np.stack([text[values != 0].astype(np.uint64), values[values != 0]], 1), axis=0)
            flat.append(own[:, 1])
            toxic.append(label[own[:, 0].astype(np.int64)])
        return pa.record_batch({"feature": pa.array(np.concatenate(flat).view(np.int64)), "toxic": pa.array(np.concatenate(toxic), pa.int64())})

    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    counted = by_slices(sample, "text", features, "feature bigint, toxic bigint").groupBy("feature").agg(
        F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    likely = F.collect_list(F.when((F.col("bad") > 0) & (ratio >= LEAST_WEIGHT), F.col("feature")))
    tested, likely = counted.agg(F.count(F.lit(1)), likely).first()
    lexicon = spark.sparkContext.broadcast(np.array(sorted(f & 0xFFFFFFFFFFFFFFFF for f in likely), np.uint64))

    def banded(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(batch.column("text"))
        return pa.record_batch({"text_key": batch.column("text_key"), "bands": lists(
            keys.view(np.int64).reshape(-1), np.arange(batch.num_rows + 1) * BANDS, pa.int64())})

    # the sample is bounded, so are its keys here
    keyed = sample.withColumn("text_key", F.xxhash64("text"))
    bands = by_slices(keyed, "text", banded, "text_key bigint, bands array<bigint>").distinct().collect()
    found = near_groups([r.text_key for r in bands], [r.bands for r in bands])
    number = {g: i for i, g in enumerate(sorted(set(found.values()), key=str))}
    texts = np.array(sorted(found), np.int64)
    groups = spark.sparkContext.broadcast((texts, np.array([number[found[x]] for x in texts.tolist()], np.int64)))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Likely features beside the group of near copies that their text belongs to."""
        words = Words(batch.column("text"), LETTERS)
        text, hashes = words.text_of_word(), words.hashes()
        group = groups.value[1][np.searchsorted(groups.value[0], batch.column("text_key").to_numpy())]
        owner, feature = [np.arange(batch.num_rows)], [np.full(batch.num_rows, -1)]  # -1: the text itself
        for values in [hashes, *(words.hashes(prefix=k) for k in STEMS)]:
            hit, number = _find(lexicon.value, values)
            owner.append(text[hit])
            feature.append(number)
        own = np.unique(np.stack([np.concatenate(owner), np.concatenate(feature)], 1), axis=0)
        return pa.record_batch({
            "feature": pa.array(own[:, 1], pa.int64()), "near": pa.array(group[own[:, 0]], pa.int64()),
            "toxic": pa.array(batch.column("toxic").to_numpy(zero_copy_only=False)[own[:, 0]], pa.int64())})

    apart = by_slices(keyed, "text", spread, "feature bigint, near bigint, toxic bigint").distinct().groupBy("feature").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()
    apart = {r.feature: (r.bad, r.good) for r in apart}
    all_bad, all_good = apart.pop(-1, (0, 0))
    weight = {f: math.log((b + 0.5) / (all_bad + 1)) - math.log((g + 0.5) / (all_good + 1)) for f, (b, g) in apart.items()}
    sure = significant(apart, all_bad, all_good, tested)
    rows = sorted((int(lexicon.value[f]), w) for f, w in weight.items() if f in sure and w >= LEAST_WEIGHT)
    prior = np.zeros(2 * grammar.settings)
    model = Model(np.array([f for f, _ in rows], np.uint64), np.array([w for _, w in rows]), prior)
    if not bad or not good:
        return model

    sent = spark.sparkContext.broadcast(model)

    def matched(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for text, clause, setting, weight in _matches(Words(batch.column("text"), LETTERS), sent.value, grammar, closed):
            found[text] += [float(clause), float(setting), weight]
        return pa.record_batch({"toxic": batch.column("toxic"), "found": pa.array(found, pa.list_(pa.float64()))})

    seen = by_slices(sample, "text", matched, "toxic int, found array<double>").collect()
    label = np.array([r.toxic for r in seen], float)
    found = [[(i, int(c), int(s), w) for c, s, w in zip(r.found[::3], r.found[1::3], r.found[2::3])] for i, r in enumerate(seen)]
    texts_with = np.zeros((2, 2 * grammar.settings))
    for y, own in zip(label, found):
        for setting in {s for _, _, s, _ in own}:
            texts_with[int(y), setting] += 1
    # the log-odds of a setting over those of any match, drawn to zero where there are few
    share = (texts_with[1] + 5) / (texts_with.sum(0) + 10)
    whole = (texts_with[1].sum() + 5) / (texts_with.sum() + 10)
    model.settings = np.log(share / (1 - share)) - np.log(whole / (1 - whole))
    x = np.log1p(_strength([m for own in found for m in own], model, len(seen)))
    a, b = 1.0, -2.0
    for _ in range(50):  # Newton steps of a logistic curve with a small penalty
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, v = label - p, p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() - 0.5 * a, r.sum() - 0.5 * b])
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.base = float(a), float(b)
    return model


def toxicity(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a score between 0 and 1."""
    own = [c for c in documents.columns if c != score_col]
    out = documents.select(*own)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema] + [f"`{score_col}` double"])
    sent, grammar, closed = documents.sparkSession.sparkContext.broadcast(model), Grammar(), _closed()

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _matches(Words(batch.column(text_col).cast(pa.string()), LETTERS), sent.value, grammar, closed)
        x = np.log1p(_strength(found, sent.value, batch.num_rows))
        p = 1 / (1 + np.exp(-(sent.value.slope * x + sent.value.base)))
        return pa.record_batch({c: batch.column(c) for c in own} | {score_col: pa.array(p)})

    return by_slices(out, text_col, score, schema)
