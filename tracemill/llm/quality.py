"""Quality classifier: a weak-label model whose posterior labels train a hashed linear scorer.

Two questions are asked of a text: is it junk, and is it abusive? For each, several labellers vote: heuristics on the
text, and where there is a curated label, that label. Votes overlap and contradict each other. Expectation-maximisation
over the counts of all vote patterns estimates how each labeller votes on texts of either kind, and gives each pattern a
posterior. Texts with clear posteriors train a linear scorer over hashed words, word beginnings and shape features; the
scorer judges every text, whether labelled or not. A text is rejected if either score reaches one half.

Vote patterns are counted over all different rows (id and text): a row that is repeated counts once, in the counts as in
the draw. There are at most 3^labellers patterns, and only their counts reach the driver.
The scorers are fitted on a bounded sample: about ``per_side`` texts for each question and answer, drawn by a hash of id
and text from all clear patterns, with a floor for each pattern. A drawn text weighs as many texts as it stands for, so
that the kinds of text have the same shares at every table size. Texts are read whole.

Defined cases: a null text is an empty one; texts without words get no votes but curated ones, and are rejected as junk.
Repeated rows are judged alike. Several labels of one document: the worse counts. Rows with a null doc_id have no curated
label. Ties at one half are rejected. If no text is clearly on one side, a scorer never rejects. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracemill.llm import sieve
from tracemill.llm.words import alphanumeric, encoded, hashed
from tracemill.session import through_table

BITS = 17
QUESTIONS = ("junk", "abuse")
# Words of abuse in English; the curated labels teach the scorer others.
ABUSE = frozenset(b"idiot idiots moron morons scum stupid pathetic worthless loser losers trash disgusting clown dumb filth vermin imbecile".split())


@dataclass(frozen=True)
class Shape:
    """Measures of a text that the labellers and the scorer share."""

    words: int
    repeated: float  # share of words equal to the word before
    distinct: float
    upper: float
    symbols: float
    bars: float
    ends: float  # share of words that end a sentence
    abuse: int


def shape(text) -> tuple[Shape, list[bytes]]:
    raw = encoded(text)
    words = raw.split()
    n = max(1, len(words))
    letters = np.frombuffer(raw, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    space = int(((letters == 32) | ((letters >= 9) & (letters <= 13))).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    beyond = int((letters >= 128).sum())
    symbols = len(raw) - upper - lower - space - digits - beyond
    tokens = alphanumeric(text)
    ends = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    return (
        Shape(
            len(words), sum(map(bytes.__eq__, words[1:], words)) / n, len(set(words)) / n, upper / max(1, upper + lower), symbols / max(1, len(raw) - space),
            words.count(b"|") / n, ends / n, sum(t in ABUSE for t in tokens),
        ),
        tokens,
    )


def votes(s: Shape) -> str:
    """One character a labeller: ``b`` bad, ``g`` good, ``-`` no vote. First those on junk, then that on abuse."""
    if not s.words:
        return "-" * 7
    pick = lambda bad, good: "b" if bad else "g" if good else "-"
    long = s.words >= 20
    return "".join((
        pick(s.repeated > 0.15, long and s.repeated < 0.05),
        pick(s.upper > 0.5, s.upper < 0.25),
        pick(s.symbols > 0.15, s.symbols < 0.07),
        pick(s.bars > 0.1, s.bars == 0),
        pick(long and s.distinct < 0.2, long and s.distinct > 0.35),
        pick(long and s.ends < 0.005, s.ends > 0.03),
        pick(s.abuse > 0, s.abuse == 0),
    ))


JUNK_VOTES = 6


def label_model(patterns: dict[str, float], rounds: int = 100, trust: float = 0.998) -> dict[str, float]:
    """The probability of ``bad`` for each vote pattern, by expectation-maximisation over their counts.

    The last labeller is the curated label: its accuracy is given, those of the others are estimated.
    """
    names = sorted(patterns)
    if not names:
        return {}
    weight = np.array([patterns[p] for p in names], float)
    vote = np.array([["bg-".index(c) for c in p] for p in names])
    # Starts from the share of bad votes; labellers begin better than chance.
    bad, good = (vote == 0).sum(1), (vote == 1).sum(1)
    p = np.where(bad + good > 0, (bad + 0.1) / (bad + good + 0.5), 0.2)
    p = np.where(vote[:, -1] == 0, trust, np.where(vote[:, -1] == 1, 1 - trust, p))
    for _ in range(rounds):
        prior = np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99)
        log_bad, log_good = np.full(len(names), np.log(prior)), np.full(len(names), np.log(1 - prior))
        curated = np.log(trust / (1 - trust))
        log_bad += np.where(vote[:, -1] == 0, curated, 0.0)
        log_good += np.where(vote[:, -1] == 1, curated, 0.0)
        for j in range(vote.shape[1] - 1):
            for v in range(3):
                of = vote[:, j] == v
                a = ((weight * p)[of].sum() + 1) / ((weight * p).sum() + 3)
                b = ((weight * (1 - p))[of].sum() + 1) / ((weight * (1 - p)).sum() + 3)
                log_bad[of] += np.log(a)
                log_good[of] += np.log(b)
        new = 1 / (1 + np.exp(np.clip(log_good - log_bad, -500, 500)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return dict(zip(names, p.tolist()))


def features(s: Shape, tokens: list[bytes]) -> np.ndarray:
    """Hashed features that a text has: its words, their beginnings, and steps of its measures."""
    words = set(tokens)
    starts = {b"4" + w[:4] for w in words if len(w) > 4} | {b"6" + w[:6] for w in words if len(w) > 6}
    steps = [
        b"=%s%d" % (name.encode(), int(value * 40))
        for name, value in (("rep", min(s.repeated, 0.5)), ("dis", s.distinct / 2), ("up", s.upper), ("sym", min(s.symbols, 0.5)), ("bar", s.bars), ("end", min(s.ends, 0.25) * 4))
    ]
    flags = [b"=v%d%c" % (i, ord(c)) for i, c in enumerate(votes(s))]
    return np.unique(hashed([*words, *starts, *steps, *flags]) >> np.uint64(64 - BITS)).astype(np.int32)


def quotas(counts: dict[str, int], per_side: int) -> dict[str, float]:
    """How many texts of each pattern to draw, ``per_side`` in all: three quarters by size, one quarter alike for each. What
    a pattern does not have is drawn from the others."""
    out: dict[str, float] = {}
    while open_ := {p: n for p, n in counts.items() if p not in out}:
        left, total = per_side - sum(out.values()), sum(open_.values())
        share = {p: left * (0.75 * n / total + 0.25 / len(open_)) for p, n in open_.items()}
        short = {p: float(n) for p, n in open_.items() if n <= share[p]}
        out |= short or share
    return out


def fitted(
    rows: list[np.ndarray], bad: np.ndarray, weight: np.ndarray, steps: int = 200, l1: float = 5e-5, rate: float = 0.3
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer with an L1 penalty, by full-batch adaptive gradient steps."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not len(rows) or bad.min() == bad.max():
        return w, -10.0
    at = np.concatenate(rows).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen, gb = np.full(len(w), 1e-8), 1e-8
    side = weight * np.where(bad > 0, 0.5 / weight[bad > 0].sum(), 0.5 / weight[bad == 0].sum())  # both answers weigh the same
    for _ in range(steps):
        z = np.bincount(of, w[at], minlength=len(rows)) + bias
        g = side * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - bad)
        gw = np.bincount(at, g[of], minlength=len(w))
        seen += gw * gw
        eta = rate / np.sqrt(seen)
        w = w - eta * gw
        w = np.sign(w) * np.maximum(np.abs(w) - eta * l1, 0)
        gb += g.sum() ** 2
        bias -= rate / np.sqrt(gb) * g.sum()
    return w, float(bias)


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray]
    bias: dict[str, float]
    posteriors: dict[str, dict[str, float]]

    def scores(self, text) -> tuple[float, float]:
        s, tokens = shape(text)
        if not s.words:
            return 1.0, 0.0
        at = features(s, tokens)
        z = [float(self.weights[q][at].sum()) + self.bias[q] for q in QUESTIONS]
        return tuple(float(1 / (1 + np.exp(-np.clip(x, -40, 40)))) for x in z)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and u, a hash of both in [0, 1)."""
    return docs.select("doc_id", "text", (F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("u"))


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, u (a hash in [0, 1)) and the votes on the text, once for each different row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({"u": b["u"], "votes": [votes(shape(t)[0]) for t in b["text"]]})
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    return keyed(docs).mapInPandas(run, "doc_id long, u double, votes string").distinct()


def patterns(votes_: DataFrame, labels: DataFrame) -> DataFrame:
    """The votes with those of curated labels: columns doc_id, u, junk, abuse."""
    curated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    said = lambda c, bad: F.when(F.col(c) == bad, "b").when(F.col(c) == 1 - bad, "g").otherwise("-")
    return votes_.join(curated, "doc_id", "left").select(
        "doc_id", "u", F.concat(F.substring("votes", 1, JUNK_VOTES), said("quality", 0)).alias("junk"),
        F.concat(F.substring("votes", JUNK_VOTES + 1, 1), said("toxic", 1)).alias("abuse"),
    )


def trained(docs: DataFrame, labels: DataFrame, per_side: int = 1500, clear: float = 0.8) -> Model:
    """Labellers' model and scorers. ``labels``: doc_id, quality (0 or 1), toxic (0 or 1)."""
    known = through_table(patterns(voted(docs), labels))
    posteriors, counts = {}, {}
    for q in QUESTIONS:
        counts[q] = {r[q]: r["n"] for r in known.groupBy(q).agg(F.count("*").alias("n")).collect()}
        posteriors[q] = label_model(counts[q])
    # Texts with clear posteriors, thinned by a hash to about per_side for each question and answer.
    chosen = []
    for q in QUESTIONS:
        for bad in (1, 0):
            of = {p: counts[q][p] for p, x in posteriors[q].items() if (x >= clear if bad else x <= 1 - clear)}
            if of:
                rates = [x for p, n in quotas(of, per_side).items() for x in (F.lit(p), F.lit(n / of[p]))]
                rated = known.withColumn("rate", F.create_map(*rates)[F.col(q)]).where("u < rate")
                chosen.append(rated.select("doc_id", "u", F.lit(q).alias("question"), F.lit(bad).alias("bad"), "rate"))
    weights, bias = {q: np.zeros(1 << BITS) for q in QUESTIONS}, dict.fromkeys(QUESTIONS, -10.0)
    if chosen:
        picked = chosen[0]
        for c in chosen[1:]:
            picked = picked.unionByName(c)
        picked = through_table(
            picked.groupBy("doc_id", "u").agg(F.collect_set(F.struct("question", "bad", "rate")).alias("answers"))  # at most four
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"u": b["u"], "answers": b["answers"], "at": [features(*shape(t)).tobytes() for t in b["text"]]})

        # Only rows that may have been drawn are shuffled; repeated ones meet in their task before.
        likely = sieve.likely(keyed(docs).where("doc_id is not null"), picked, ["doc_id", "u"])
        texts = likely.dropDuplicates(["doc_id", "u"]).join(picked, ["doc_id", "u"])
        answers = F.transform("answers", lambda a: F.concat(a["question"], F.lit(":"), a["bad"].cast("string"), F.lit(":"), a["rate"].cast("string"))).alias("answers")
        got = texts.select("u", answers, "text").mapInPandas(run, "u double, answers array<string>, at binary").toPandas().sort_values("u")
        rows = [np.frombuffer(x, np.int32) for x in got["at"]]
        for q in QUESTIONS:
            mine = [(r, *map(float, a.split(":")[1:])) for r, many in zip(rows, got["answers"]) for a in many if a.startswith(q + ":")]
            bad, rate = np.array([x for _, *x in mine]).reshape(-1, 2).T
            weights[q], bias[q] = fitted([r for r, *_ in mine], bad, 1 / rate)
            # The sample holds both answers alike; in all texts they have the shares that the label model found.
            share = sum(counts[q][p] * x for p, x in posteriors[q].items()) / sum(counts[q].values())
            bias[q] += float(np.log(share / (1 - share)))
    return Model({q: w.astype(np.float32) for q, w in weights.items()}, bias, posteriors)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, junk and abuse (0 to 1), score (0 to 1, high is good), keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            out["doc_id"] = b["doc_id"].astype("Int64")
            out[["junk", "abuse"]] = [model.scores(t) for t in b["text"]] if len(b) else np.zeros((0, 2))
            yield out[["doc_id", "junk", "abuse"]]

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, junk double, abuse double")
    worst = F.greatest("junk", "abuse")
    return scored.select("doc_id", "junk", "abuse", (1 - worst).alias("score"), (worst < 0.5).alias("keep"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all of their columns."""

    @pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series([max(model.scores(t)) < 0.5 for t in text], dtype=bool)

    return docs.where(good(F.col("text")))

