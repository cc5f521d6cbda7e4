"""Keeping, gating and retrieving past episodes.

An episode is ``run_id, seq, query, tools`` (plus payload); a query is
``run_id, seq, query, available``. ``seq`` is unique within a run and grows with time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.functions import ordered as O
from tracemill.functions import text as X
from tracemill.operators import toolset as TS
from tracemill.session import through_table


def gate(runs: DataFrame) -> DataFrame:
    """Whether each run may be stored as an episode, and why not.

    Needs ``error, n_actions, same_outcome, n_gold``. Runs whose gold list is empty
    are right by doing nothing and therefore teach nothing.
    """
    status = (
        F.when(F.col("error") != "", "error").when(F.col("n_actions") == 0, "no actions")
        .when(~F.col("same_outcome"), "incorrect").when(F.col("n_gold") == 0, "no-op correct")
        .otherwise("stored")
    )
    return runs.withColumn("gate_status", status)


def gate_counts(gated: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    return gated.groupBy(*by, "gate_status").agg(F.count("*").alias("n"))


def cold_start(
    queries: DataFrame, stored: Column, minimum: int, loaded: int = 0, width: int = O.WIDTH
) -> DataFrame:
    """Store size seen by each query, and whether it is large enough to retrieve from.

    ``loaded`` episodes were there before the run; a minimum of 0 always allows.
    """
    out = O.running_sum(queries, ["run_id"], "seq", stored.cast("int"), "store_size", width=width)
    size = (F.col("store_size") + loaded).cast("long")
    return out.withColumn("store_size", size).withColumn("may_retrieve", size >= minimum)


def eligible_counts(episodes: DataFrame, queries: DataFrame, width: int = O.WIDTH) -> DataFrame:
    """How many earlier episodes of its run each query could use.

    Counts per tool signature are running sums over the merged sequence of
    episodes and queries, so no episode-query pairs are formed.
    """
    pairs = TS.eligible_signatures(episodes, queries)
    q = queries.select("run_id", "seq", X.key_of(F.col("available")).alias("query_tools"))
    asked = q.join(pairs, "query_tools").select("run_id", "episode_tools", "seq", F.lit(0).alias("stored"))
    kept = episodes.select(
        "run_id", X.key_of(F.col("tools")).alias("episode_tools"), "seq", F.lit(1).alias("stored")
    )
    counted = O.running_sum(
        asked.unionByName(kept), ["run_id", "episode_tools"], "seq", F.col("stored"), "before",
        # A query comes before an episode of the same number.
        ties=["stored"], width=width,
    )
    per_query = counted.where("stored = 0").groupBy("run_id", "seq").agg(F.sum("before").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return queries.select("run_id", "seq").join(per_query, ["run_id", "seq"], "left").select(
        "run_id", "seq", n.alias("n_eligible")
    )


# --- similarity top-k --------------------------------------------------------------------

STEP = 16
BANDS = 16
SLACK = 1e-6
# Text pairs up to which a level is met pair by pair, and entries of vectors in a block of queries and of episodes beyond that.
MOST_PAIRS = 1_000_000
ASKED_BLOCK = 500_000
STORED_BLOCK = 1_000_000


def _text_id(c: str) -> Column:
    """32 bytes; every shuffled entry of a vector carries them, and they do not compress."""
    return F.unhex(F.sha2(F.col(c), 256))


def _level(postings: Column, max_postings: int) -> Column:
    over = F.floor(F.log(postings / F.lit(float(max(max_postings, 1)))) / F.log(F.lit(float(STEP)))).cast("int")
    return F.when(postings <= max_postings, 0).otherwise(F.greatest(over, F.lit(0)) + 1)


def text_vectors(episodes: DataFrame, queries: DataFrame, max_postings: int) -> DataFrame:
    """Unit TF-IDF vector of every distinct text of each run.

    Weight: raw term count x (ln((1 + N) / (1 + df)) + 1), N and df over the run's
    stored episodes. Copies of a text are counted, but worked on once. Terms have a level by the number of distinct
    episode texts that hold them: 0 up to ``max_postings``, then one more for each factor of ``STEP``. Vectors list the lowest level first.
    """
    own = lambda df, stored, asked: df.select(
        "run_id", _text_id("query").alias("text_id"), "query", F.lit(stored).alias("n"), F.lit(asked).alias("q")
    )
    texts = (
        own(episodes, 1, 0).unionByName(own(queries, 0, 1)).groupBy("run_id", "text_id")
        .agg(F.first("query").alias("query"), F.sum("n").alias("copies"), F.sum("q").alias("asked"))
    )
    terms = (
        texts.select("run_id", "text_id", "copies", "asked", F.explode(X.words(F.col("query"))).alias("term"))
        .groupBy("run_id", "text_id", "copies", "asked", "term").agg(F.count("*").alias("tf"))
    )
    size = episodes.groupBy("run_id").agg(F.count("*").alias("n_stored"))
    found = (
        terms.groupBy("run_id", "term")
        .agg(F.sum("copies").alias("df"), F.count_if(F.col("copies") > 0).alias("postings"))
        .join(size, "run_id", "left")
        .select(
            "run_id", "term", "postings",
            (F.log((1 + F.coalesce("n_stored", F.lit(0))) / (1 + F.col("df"))) + 1).alias("idf"),
        )
    )
    # The vocabulary comes in one copy for each salt, which Spark's estimate does not see: as a broadcast it would fill the driver.
    weighted = O.salted_lookup(terms, found.hint("merge"), ["run_id", "term"], F.col("text_id"))
    entry = F.struct(
        _level(F.col("postings"), max_postings).alias("level"), "term", (F.col("tf") * F.col("idf")).alias("w"),
        (F.col("postings") > 0).alias("shared"),
    )
    vectors = weighted.groupBy("run_id", "text_id").agg(
        F.max("copies").alias("copies"), F.max("asked").alias("asked"), F.collect_list(entry).alias("vec")
    )
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v["w"] * v["w"]))
    return vectors.withColumn("norm", norm).select(
        "run_id", "text_id", "copies", "asked",
        F.transform(
            # Terms no episode has count for the norm only.
            F.sort_array(F.filter("vec", lambda v: v["shared"])),
            lambda v: F.struct(v["level"].alias("level"), v["term"].alias("term"), (v["w"] / F.col("norm")).alias("w")),
        ).alias("vec"),
    )


def _dot(a: Column, b: Column) -> Column:
    """Inner product of a list of (level, term, w) and a map from term to weight."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v["w"] * F.coalesce(F.try_element_at(b, v["term"]), F.lit(0.0)))


def _as_map(vec: Column) -> Column:
    return F.map_from_entries(F.transform(vec, lambda v: F.struct(v["term"], v["w"])))


def _candidates(vectors: DataFrame) -> DataFrame:
    """Exact similarity of text pairs that share a term of level 0."""
    rare = lambda name: F.inline(F.filter("vec", lambda v: v["level"] == 0)).alias("_l", "term", name)
    q = vectors.where("asked > 0").select("run_id", F.col("text_id").alias("q_text"), rare("qw"))
    e = vectors.where("copies > 0").select("run_id", F.col("text_id").alias("e_text"), rare("ew"))
    dots = (
        q.drop("_l").join(e.drop("_l"), ["run_id", "term"])
        .groupBy("run_id", "q_text", "e_text").agg(F.sum(F.col("qw") * F.col("ew")).alias("dot"))
    )
    rest = vectors.select("run_id", "text_id", F.filter("vec", lambda v: v["level"] > 0).alias("rest")).where(F.size("rest") > 0)
    qh = rest.select("run_id", F.col("text_id").alias("q_text"), F.col("rest").alias("q_rest"))
    eh = rest.select("run_id", F.col("text_id").alias("e_text"), _as_map(F.col("rest")).alias("e_rest"))
    joined = dots.join(eh, ["run_id", "e_text"], "left").join(qh, ["run_id", "q_text"], "left")
    total = F.col("dot") + F.coalesce(F.when(F.col("e_rest").isNotNull(), _dot(F.col("q_rest"), F.col("e_rest"))), F.lit(0.0))
    return joined.select("run_id", "q_text", "e_text", F.round(total, 6).alias("score"))


def _scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact similarity of given text pairs, from whole vectors."""
    q = vectors.select("run_id", F.col("text_id").alias("q_text"), F.col("vec").alias("q_vec"))
    e = vectors.select("run_id", F.col("text_id").alias("e_text"), _as_map(F.col("vec")).alias("e_vec"))
    met = pairs.join(q, ["run_id", "q_text"]).join(e, ["run_id", "e_text"])
    return met.select("run_id", "q_text", "e_text", F.round(_dot(F.col("q_vec"), F.col("e_vec")), 6).alias("score"))


def _earliest_copies(episodes: DataFrame, k: int) -> DataFrame:
    """Of episodes alike in text and tools only the first k can be among the k best of
    any query: they score the same, are seen by every query that sees a later copy, and win ties."""
    alike = W.partitionBy("run_id", "e_text", "e_sig").orderBy("e_seq")
    return (
        episodes.select(
            "run_id", F.col("seq").alias("e_seq"), _text_id("query").alias("e_text"),
            X.key_of(F.col("tools")).alias("e_sig"), "tools",
        )
        .withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= k).drop("_rn")
    )


def _ever_best(k: int):
    """Keeps the episodes of one group that are among the k best of those up to their own time."""

    def keep(group: pa.Table) -> pa.Table:
        group = group.sort_by("e_seq")
        best: list[float] = []
        rows = []
        for i, score in enumerate(group.column("score").to_pylist()):
            if len(best) < k:
                heapq.heappush(best, score)
            elif score > best[0]:
                heapq.heapreplace(best, score)
            else:
                continue
            rows.append(i)
        return group.take(rows)

    return keep


def _thinned(pairs: DataFrame, often: DataFrame, k: int) -> DataFrame:
    """Candidates without those that no query can retrieve, for texts that many queries ask.

    An episode behind k earlier ones with the same tools and no lower score loses to them
    in every query that sees it. What is left grows with the logarithm of the candidates.
    """
    pairs = through_table(pairs)
    thin = (
        pairs.join(often, ["run_id", "q_text"], "left_semi").groupBy("run_id", "q_text", "e_sig")
        .applyInArrow(_ever_best(k), pairs.schema)
    )
    return pairs.join(often, ["run_id", "q_text"], "left_anti").unionByName(thin)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("run_id", "seq").orderBy(F.desc("score"), "e_seq")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _reach(level: int) -> Column:
    """The most that an episode can score which shares only terms above ``level``."""
    return F.sqrt(F.aggregate(F.filter("vec", lambda v: v["level"] > level), F.lit(0.0), lambda s, v: s + v["w"] * v["w"]))


def _open(asked: DataFrame, ranked: DataFrame, vectors: DataFrame, level: int, k: int) -> DataFrame:
    """Queries that terms above ``level`` may still change, with the score a new episode has to reach (0 below k hits)."""
    kth = ranked.groupBy("run_id", "seq").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    reach = vectors.where("asked > 0").select("run_id", F.col("text_id").alias("q_text"), _reach(level).alias("reach")).where("reach > 0")
    met = asked.join(reach, ["run_id", "q_text"]).join(kth, ["run_id", "seq"], "left")
    theta = F.when(F.col("n") >= k, F.greatest(F.col("kth") - SLACK, F.lit(0.0))).otherwise(0.0)
    return met.withColumn("theta", theta).where(F.col("theta") <= F.col("reach")).select(*asked.columns, "theta")


def _band(angle: Column) -> Column:
    return F.least(F.greatest(F.floor(angle / (math.pi / 2) * BANDS), F.lit(0)), F.lit(BANDS - 1)).cast("int")


def _wanted(open_: DataFrame, vectors: DataFrame, level: int) -> DataFrame:
    """The terms at ``level`` of what is open, with the bands of posting weights that can reach its score.

    An episode met first on term t, with weight sin(a), scores at most q * sin(a) + r * cos(a), where q is the query's weight and r the
    length of its later terms. That is rho * cos(a - phi), so weights that can reach theta have their angles around phi.
    """
    asks = open_.withColumn("of", X.key_of(F.col("available"))).groupBy("run_id", "q_text", "of").agg(
        F.min("theta").alias("theta"), F.max("seq").alias("last"), F.first("available").alias("available")
    )
    v = vectors.select("run_id", F.col("text_id").alias("q_text"), F.filter("vec", lambda v: v["level"] >= level).alias("left"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v["w"] * v["w"])
    terms = F.filter(
        F.transform(
            "left",
            lambda v, i: F.struct(
                v["level"].alias("level"), v["term"].alias("term"), v["w"].alias("q"),
                F.sqrt(square(F.slice("left", i + 2, F.size("left")))).alias("r"),
            ),
        ),
        lambda t: t["level"] == level,
    )
    met = asks.join(v, ["run_id", "q_text"]).select("run_id", "q_text", "theta", "last", "available", F.inline(terms))
    rho, phi = F.sqrt(F.col("q") * F.col("q") + F.col("r") * F.col("r")), F.atan2("q", "r")
    met = met.withColumn("rho", rho).where(F.col("theta") <= F.col("rho") + SLACK)
    half = F.acos(F.least(F.col("theta") / F.col("rho"), F.lit(1.0))) + SLACK
    return met.withColumn("band", F.explode(F.sequence(_band(phi - half), _band(phi + half)))).drop("level", "rho")


def _postings(vectors: DataFrame, first: DataFrame, level: int) -> DataFrame:
    """Episode texts by term at ``level`` and band of weight, one row for each set of tools, with the first time seen."""
    heads = first.groupBy("run_id", "e_text", "e_sig").agg(F.min("e_seq").alias("e_first"), F.first("tools").alias("tools"))
    held = F.inline(F.filter("vec", lambda v: v["level"] == level)).alias("_l", "term", "e")
    e = vectors.where("copies > 0").select("run_id", F.col("text_id").alias("e_text"), held).drop("_l")
    return e.join(heads, ["run_id", "e_text"]).withColumn("band", _band(F.asin(F.least("e", F.lit(1.0)))))


def _met(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """Text pairs that can reach what is asked: earlier, with tools at hand, and by the bound on the score."""
    bound = F.col("q") * F.col("e") + F.col("r") * F.sqrt(F.greatest(1 - F.col("e") * F.col("e"), F.lit(0.0)))
    fit = (bound >= F.col("theta") - SLACK) & (F.col("e_first") < F.col("last")) & TS.fits(F.col("tools"), F.col("available"))
    return wanted.join(postings, ["run_id", "term", "band"]).where(fit).select("run_id", "q_text", "e_text").distinct()


def _pairs_by_level(vectors: DataFrame) -> dict[int, int]:
    """How many text pairs meet on the terms of each level."""
    asked, stored = F.count_if(F.col("asked") > 0), F.count_if(F.col("copies") > 0)
    terms = vectors.select("run_id", "asked", "copies", F.inline(F.transform("vec", lambda v: F.struct(v["level"].alias("level"), v["term"].alias("term")))))
    met = terms.groupBy("run_id", "level", "term").agg((asked.cast("double") * stored).alias("n"))
    return {r["level"]: r["n"] for r in met.groupBy("level").agg(F.sum("n").alias("n")).collect()}


def _best_of_block(k: int, schema: pa.Schema):
    """For each query of a block, its k best usable earlier episodes of a block of episodes, by postings within the block."""

    def best(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return schema.empty_table()
        lists = lambda t, c: t.column(c).combine_chunks()
        e_terms, heads = lists(stored, "terms"), lists(stored, "heads")
        words = e_terms.flatten().dictionary_encode()
        term = words.indices.to_numpy(zero_copy_only=False)
        by_term = np.argsort(term, kind="stable")
        texts = np.repeat(np.arange(len(e_terms)), e_terms.value_lengths().to_numpy(zero_copy_only=False))[by_term]
        weights = lists(stored, "weights").flatten().to_numpy(zero_copy_only=False)[by_term]
        ends = np.cumsum(np.bincount(term, minlength=len(words.dictionary)))
        place = {t: (e - n, e) for t, e, n in zip(words.dictionary.to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist())}
        # Episodes in the order of time, so that those before a query are the first ones.
        rows = heads.flatten()
        time = rows.field("e_seq").to_numpy(zero_copy_only=False)
        order = np.argsort(time, kind="stable")
        time = time[order]
        text_of = np.repeat(np.arange(len(heads)), heads.value_lengths().to_numpy(zero_copy_only=False))[order]
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault(tuple(t), len(kinds)) for t in rows.field("tools").to_pylist()])[order]
        asked = asked.sort_by("q_text")
        out: list[tuple] = []
        was, scores, usable = None, None, {}
        columns = [asked.column(c).to_pylist() for c in ("q_text", "seq", "available")]
        q_terms, q_weights = lists(asked, "terms"), lists(asked, "weights")
        for i, (text, seq, available) in enumerate(zip(*columns)):
            if text != was:
                was, usable, total = text, {}, np.zeros(len(e_terms))
                for t, w in zip(q_terms[i].as_py(), q_weights[i].as_py()):
                    lo, hi = place.get(t, (0, 0))
                    total[texts[lo:hi]] += w * weights[lo:hi]
                scores = np.floor(total * 1e6 + 0.5)[text_of]
            key = tuple(available)
            if key not in usable:
                has = set(key)
                fits = np.array([has.issuperset(t) for t in kinds], dtype=bool)
                at = np.flatnonzero((scores > 0) & fits[kind])
                usable[key] = at, time[at], scores[at]
            at, when, score = usable[key]
            n = np.searchsorted(when, seq)
            if n > k:
                at = at[:n][score[:n] >= np.partition(score[:n], n - k)[n - k]]
                # The order of time settles ties.
                at = at[np.argsort(-scores[at], kind="stable")[:k]]
            else:
                at = at[:n]
            out += [(seq, e, total[x]) for e, x in zip(time[at].tolist(), text_of[at].tolist())]
        seqs, found, raw = zip(*out) if out else ((), (), ())
        run = pa.array([asked.column("run_id")[0].as_py()] * len(out), schema.field("run_id").type)
        return pa.table([run, pa.array(seqs, pa.int64()), pa.array(found, pa.int64()), pa.array(raw, pa.float64())], schema=schema)

    return best


def _met_in_blocks(asked: DataFrame, vectors: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """``run_id, seq, e_seq, score`` of the k best of each query and block of episodes, scored on all terms.

    Blocks of queries meet blocks of episodes of their run. A block holds a bounded number of vector entries, and what leaves it are k rows a
    query, so memory is bounded and no list of text pairs is ever written.
    """
    entries = F.size("vec").cast("long")
    count = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    sizes = vectors.groupBy("run_id").agg(
        count(F.sum(F.col("asked") * entries), ASKED_BLOCK).alias("q_blocks"),
        count(F.sum(F.when(F.col("copies") > 0, entries)), STORED_BLOCK).alias("e_blocks"),
    )
    parts = (F.transform("vec", lambda v: v["term"]).alias("terms"), F.transform("vec", lambda v: v["w"]).alias("weights"))
    dealt = lambda df, key, own, other: df.join(sizes, "run_id").withColumns(
        {own: F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))}
    ).drop("q_blocks", "e_blocks")
    q = asked.where("available IS NOT NULL AND seq IS NOT NULL").join(vectors.select("run_id", F.col("text_id").alias("q_text"), *parts), ["run_id", "q_text"])
    heads = first.where("tools IS NOT NULL AND e_seq IS NOT NULL").groupBy("run_id", "e_text").agg(F.collect_list(F.struct("e_seq", "tools")).alias("heads"))
    e = vectors.where("copies > 0").select("run_id", F.col("text_id").alias("e_text"), *parts).join(heads, ["run_id", "e_text"])
    q = dealt(q.withColumn("seq", F.col("seq").cast("long")), "seq", "q_block", "e_block").where(F.size("terms") > 0)
    e = dealt(e, "e_text", "e_block", "q_block").drop("e_text").where(F.size("terms") > 0)
    out = asked.select("run_id", F.col("seq").cast("long"), F.col("seq").cast("long").alias("e_seq"), F.lit(0.0).alias("score")).schema
    keys = ["run_id", "q_block", "e_block"]
    met = q.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInArrow(_best_of_block(k, to_arrow_schema(out)), out)
    return met.select("run_id", "seq", "e_seq", F.round("score", 6).alias("score"))


def similar_episodes(
    episodes: DataFrame, queries: DataFrame, k: int, max_postings: int = 500, max_asked: int = 64
) -> DataFrame:
    """The k most similar usable earlier episodes of each query: ``run_id, seq, e_seq, score, rank``.

    Cosine of TF-IDF vectors, rounded to six places, ties to the earlier episode;
    episodes that share no term are not returned. The result is exact:

    1. Texts meet on terms of level 0, through an inverted index. For a text that more than
       ``max_asked`` queries ask, candidates that none of them can retrieve are dropped first.
    2. A query is settled if its k-th score beats the most that its terms of higher levels could give, which is the length of that part
       of its vector.
    3. What is open goes one level deeper: first to the postings of greatest weight of its terms at that level, which raise its k-th
       score, then to those whose band of weights can reach that score. Levels follow each other until nothing is open.

    There is one round for each factor of ``STEP`` in the number of episode texts, and each reads only what is still open.

    A level at which more than ``MOST_PAIRS`` text pairs meet is not met pair by pair: what is open then meets all earlier usable episodes of
    its run in blocks, on all terms, and is settled by that.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vectors = through_table(text_vectors(episodes, queries, max_postings))
    first = _earliest_copies(episodes, k)
    asked = queries.select("run_id", "seq", "available", _text_id("query").alias("q_text"))
    n_pairs = _pairs_by_level(vectors)
    if n_pairs.get(0, 0) > MOST_PAIRS:
        return through_table(_ranked(_met_in_blocks(asked, vectors, first, k), k))
    often = vectors.where(F.col("asked") > max_asked).select("run_id", F.col("text_id").alias("q_text"))
    thin = not often.isEmpty()

    def hits(scores: DataFrame, of: DataFrame) -> DataFrame:
        pairs = scores.where("score > 0").join(first, ["run_id", "e_text"])
        if thin:
            pairs = _thinned(pairs, often, k)
        seen = (F.col("e_seq") < F.col("seq")) & TS.fits(F.col("tools"), F.col("available"))
        return pairs.join(of, ["run_id", "q_text"]).where(seen).select("run_id", "seq", "e_seq", "score")

    ranked = _ranked(hits(_candidates(vectors), asked), k)
    top = vectors.where("asked > 0").agg(F.max(F.array_max(F.transform("vec", lambda v: v["level"])))).first()[0] or 0
    if top:
        first, ranked = through_table(first), through_table(ranked)
    for level in range(top):
        open_ = through_table(_open(asked, ranked, vectors, level, k))
        if open_.isEmpty():
            break
        if n_pairs.get(level + 1, 0) > MOST_PAIRS:
            settled = ranked.join(open_, ["run_id", "seq"], "left_anti")
            mine = _ranked(_met_in_blocks(open_.drop("theta"), vectors, first, k).distinct(), k)
            return through_table(settled.unionByName(mine))
        postings = through_table(_postings(vectors, first, level + 1))
        heaviest = W.partitionBy("run_id", "term", "e_sig").orderBy(F.desc("e"), "e_first", "e_text")
        few = postings.withColumn("_rn", F.row_number().over(heaviest)).where(F.col("_rn") <= 4 * k).drop("_rn")
        keys = ["run_id", "seq"]
        settled, mine = ranked.join(open_, keys, "left_anti"), ranked.join(open_.select(*keys), keys, "left_semi")
        for some in (few, postings):
            scores = _scored(through_table(_met(_wanted(open_, vectors, level + 1), some)), vectors)
            found = hits(scores, open_.drop("theta")).unionByName(mine.drop("rank")).distinct()
            mine = through_table(_ranked(found, k))
            # With a better k-th score fewer queries are open, and fewer postings reach it.
            open_ = through_table(_open(open_.drop("theta"), mine, vectors, level, k))
            if open_.isEmpty():
                break
            if some is few:
                settled = settled.unionByName(mine.join(open_, keys, "left_anti"))
                mine = mine.join(open_.select(*keys), keys, "left_semi")
        ranked = through_table(settled.unionByName(mine))
    return ranked


# --- few-shot examples -------------------------------------------------------------------


def few_shot(examples: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """First k examples by position whose domain key equals the query's and whose tools it has.

    The choice depends only on domain key and available tools, so it is made once
    per distinct pair of these and then looked up. ``examples`` has ``domains, pos, tools``.
    """
    ex = examples.select(X.key_of(F.col("domains")).alias("domain_key"), "pos", "tools").withColumn(
        "sig", X.key_of(F.col("tools"))
    )
    alike = W.partitionBy("domain_key", "sig").orderBy("pos")
    ex = ex.withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= k)
    q = queries.withColumns(
        {"domain_key": X.key_of(F.col("domains")), "avail_key": X.key_of(F.col("available"))}
    )
    kinds = q.groupBy("domain_key", "avail_key").agg(F.first("available").alias("available"))
    w = W.partitionBy("domain_key", "avail_key").orderBy("pos")
    chosen = (
        kinds.join(ex, "domain_key").where(TS.fits(F.col("tools"), F.col("available")))
        .withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        .groupBy("domain_key", "avail_key")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "pos"))).alias("picks"))
    )
    found = O.salted_lookup(
        q.select("query_id", "domain_key", "avail_key"), chosen, ["domain_key", "avail_key"], F.col("query_id")
    )
    return found.select("query_id", F.inline("picks"))
