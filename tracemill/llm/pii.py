"""Personal data: fixed formats, and further spans chosen by boosted trees over candidates.

The base kinds (email, ip, card, phone) are leftmost, non-overlapping matches that pass a check. Beyond them, generators
with high recall propose spans, overlapping ones too: tokens that mix letters and digits, groups of numbers, things that
look like addresses. Boosted trees judge a candidate by its format and by what stands before it. They are taught by weak
labels: a candidate is one if it covers a base span, has the format of a known kind of key, is a token of high entropy
after a word for secrets, a number after a word for numbers of persons, or an address with its sign written out; the
others are not. Thresholds are calibrated for each generator on a third of the candidates that the trees have not seen, as the
least score from which on the wanted share of candidates is right; without such a score a generator adds nothing.

All work on texts is done by SQL expressions inside the row, the trees included: there is no shuffle but for the counts of candidates.
Candidates have no longest length. Places, what stands before and overlaps come from sweeps over the matches in order, so a
text costs about its length, however many matches it has.
All candidates of all texts, read whole, teach the trees or calibrate the thresholds: those alike in generator, label and
features are one weighted row. Only the places where a feature may be split are Spark's own estimate.

Defined cases: a null text is an empty one and has no spans. Rows are independent: repeated rows and null ids change
nothing else. Positions are code points, ends exclusive. Without candidates of both labels no spans are added. Spans
added that touch a base span are left out, as the base span stays. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import let
from tracemill.session import through_table

KINDS = ("email", "ip", "card", "phone")
# The formats of the base kinds. Where a run of characters can only match as a whole, matches start at its first
# character, and nothing is given back: this changes no match, and keeps long runs from being tried at every place.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidate generators: name of the kind they add, pattern.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+(?![A-Za-z0-9_/+=-])",
    "number": r"(?<![0-9])[+(]?[0-9][0-9()\x20./-]{5,}[0-9](?![0-9])",
    "contact": r"(?<!\S)[^\s@]+(?:@|\x20?[\[(]at[\])]\x20?)[^\s@]++(?!\S)",
}
# Formats of keys that their issuers give a fixed prefix.
KEY_FORMAT = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
HINTS = r"(?i)(?:mail|phone|tel|call|fax|mobile|contact|key|token|secret|password|card|visa|iban|account|ssn|passport|id)[\s:=#.\"'-]*$"
# Weak labels: words before a secret, words before a number of a person, addresses with the sign written out.
SECRET_BEFORE = r"(?i)(?:key|token|secret|password|passwd|pwd|credential|bearer)s?[\s:=#.\"'-]*$"
NUMBER_BEFORE = r"(?i)(?<![a-z])(?:phone|tel|fax|mobile|ssn|iban|account|passport|card|visa)[\s:=#.\"'-]*$"
WRITTEN_AT = r"[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LEAST_ENTROPY = 3.0
FIELDS = "struct<start:bigint,end:bigint,kind:int,s:string>"
FOUND = "struct<start:bigint,end:bigint,kind:int,s:string,before:string>"
CANDIDATE = "struct<start:bigint,end:bigint,kind:int,s:string,before:string,covered:boolean,f:array<double>>"
CONTEXT = 24  # characters before a candidate that are looked at
BLOCK = 256


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """Runs a state over an array: ``step(state, item)`` gives the next state and an output of type ``out``; the outputs.

    Appending to an array copies it, so outputs are gathered in blocks: an array of n items costs about n * BLOCK / 2
    moved references instead of n * n / 2.
    """

    def one(acc: Column, x: Column) -> Column:
        new, says = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(says.cast(out))).alias("out"))

    def block(a: Column, acc: Column, b: Column) -> Column:
        part = F.slice(a, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def whole(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(((F.size(a) - 1) / BLOCK).cast("int"), F.lit(0)))
        first = F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.aggregate(blocks, first, lambda acc, b: block(a, acc, b), lambda acc: F.flatten(acc["out"]))

    return let(items, whole)


def _last(s: Column) -> Column:
    return F.substr(s, F.lit(-CONTEXT), F.lit(CONTEXT))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places and what stands before: running sums over the text between matches and the matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, hits, lambda gap, s: F.struct(gap.alias("gap"), s.alias("s")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        new = F.struct(end.cast("bigint").alias("at"), _last(F.concat(state["tail"], x["gap"], x["s"])).alias("tail"))
        return new, F.struct(start, end, F.lit(kind), x["s"], _last(F.concat(state["tail"], x["gap"])))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"))
    return scanned(F.filter(pairs, lambda x: x["s"].isNotNull()), first, step, FOUND)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the check sum."""
    d = F.reverse(_digits(s))
    value = lambda i: F.substr(d, i.cast("int"), F.lit(1)).cast("int")
    doubled = lambda i: F.when(value(i) * 2 > 9, value(i) * 2 - 9).otherwise(value(i) * 2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0),
        lambda acc, i: acc + F.coalesce(F.when(i % 2 == 0, doubled(i)).otherwise(value(i)), F.lit(0)),
    )
    return (F.length(d) > 0) & (total % 10 == 0)


def _passes(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return {
        "email": F.lit(True), "ip": F.rlike(s, F.lit(rf"^{byte}(?:\.{byte}){{3}}$")), "card": n.between(12, 19) & luhn(s), "phone": n.between(9, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, kind, s) by kind; ``text`` is not null."""
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = F.rlike(text, F.lit("[0-9]"))
    right = lambda kind: lambda x: _passes(kind, x["s"])
    return {
        kind: F.when(
            gate.get(kind, digit),
            F.transform(F.filter(_found(text, PATTERNS[kind], i), right(kind)), lambda x: F.struct(*(x[n].alias(n) for n in ("start", "end", "kind", "s")))),
        ).otherwise(F.array().cast(f"array<{FIELDS}>"))
        for i, kind in enumerate(KINDS)
    }


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def _written(spans: Column, names: list[str]) -> Column:
    named = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", named[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


FEATURES = (
    "generator", "length", "digits", "upper", "lower", "dots", "spaces", "dashes", "distinct share", "at sign", "plus", "check sum", "hint before", "space before",
    "digit changes",
)


def entropy(s: Column) -> Column:
    """Bits a character, by the shares of the characters of ``s``."""
    share = lambda x: (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(s)
    seen = F.filter(F.array_distinct(F.split(s, "")), lambda x: x != "")
    return F.aggregate(seen, F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x)))


def weak_label(c: Column) -> Column:
    """Whether a candidate counts as personal data; context and format decide, not the trees' features alone."""
    s, before = c["s"], c["before"]
    after = lambda words: F.rlike(before, F.lit(words))
    digits = F.length(_digits(s))
    return c["covered"] | F.rlike(s, F.lit(KEY_FORMAT)) | (
        F.when(c["kind"] == 0, after(SECRET_BEFORE) & (entropy(s) >= LEAST_ENTROPY))
        .when(c["kind"] == 1, after(NUMBER_BEFORE) & (digits >= 7)).otherwise(F.rlike(s, F.lit(WRITTEN_AT)))
    )


def candidates(text: Column, base: Column) -> Column:
    """Proposed spans: start, end, kind (generator), s, before, whether a span of ``base`` covers part of it, and features f."""
    may = F.rlike(text, F.lit("[0-9@]|[\\[(]at[\\])]"))
    every = F.concat(*(_found(text, p, i) for i, p in enumerate(GENERATORS.values())))
    # A long token without a digit, or of digits alone, is a word or a number, not a key.
    wanted = F.filter(every, lambda c: (c["kind"] != 0) | (F.rlike(c["s"], F.lit("[0-9]")) & F.rlike(c["s"], F.lit("[A-Za-z]"))))
    count = lambda s, p: F.length(F.regexp_replace(s, p, "")).cast("double")

    def features(c: Column, covered: Column) -> Column:
        s, before = c["s"], c["before"]
        flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), s.alias("s"), before.alias("before"), covered.alias("covered"),
            F.array(
                c["kind"].cast("double"), F.length(s).cast("double"), count(s, "[^0-9]"), count(s, "[^A-Z]"), count(s, "[^a-z]"), count(s, r"[^.]"),
                count(s, r"[^\x20]"), count(s, "[^-]"), F.size(F.array_distinct(F.split(s, ""))) / F.length(s), flag(F.contains(s, F.lit("@"))),
                flag(F.startswith(s, F.lit("+"))), flag(luhn(s)), flag(F.rlike(before, F.lit(HINTS))), flag(F.rlike(before, F.lit(r"\s$")) | (c["start"] == 0)),
                F.length(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "0"), "[^0]", "")).cast("double"),
            ).alias("f"),
        )

    proposed = let(wanted, lambda w: F.zip_with(w, _covered(w, base), features))
    return F.when(may, proposed).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def _covered(spans: Column, base: Column) -> Column:
    """For each of ``spans``, whether it overlaps one of ``base``: a sweep from either side over all of them in order."""
    event = lambda x, at: F.struct(x["start"].alias("start"), at.cast("int").alias("at"), x["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b, F.lit(-1))), F.transform(spans, event)))
    is_base = lambda x: x["at"] < 0

    def forth(state: Column, x: Column) -> tuple[Column, Column]:
        new = F.struct(F.when(is_base(x), F.greatest(state["to"], x["end"])).otherwise(state["to"]).alias("to"))
        return new, F.struct(x["start"], x["end"], x["at"], state["to"] > x["start"])

    def back(state: Column, x: Column) -> tuple[Column, Column]:
        new = F.struct(F.when(is_base(x), x["start"]).otherwise(state["to"]).alias("to"))
        return new, F.struct(x["at"], x["hit"] | (state["to"] < x["end"]))

    at = lambda n: F.struct(F.lit(n).cast("bigint").alias("to"))
    there = scanned(events, at(-1), forth, "struct<start:bigint,end:bigint,at:int,hit:boolean>")
    both = scanned(F.reverse(there), at((1 << 62)), back, "struct<at:int,hit:boolean>")
    return F.transform(F.array_sort(F.filter(both, lambda x: ~is_base(x))), lambda x: x["hit"])


@dataclass(frozen=True)
class Chooser:
    """``margin``: SQL over an array ``f`` of features; ``thresholds``: by generator, None for none."""

    margin: str | None
    thresholds: tuple[float | None, ...]


def _tree_sql(node) -> str:
    if node.numDescendants() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"if(f[{split.featureIndex()}] <= {float(split.threshold())!r}D, {_tree_sql(node.leftChild())}, {_tree_sql(node.rightChild())})"


def margin_sql(model) -> str:
    parts = [f"{float(w)!r}D * {_tree_sql(t._call_java('rootNode'))}" for t, w in zip(model.trees, model.treeWeights)]
    return " + ".join(parts)


def _prepared(docs: DataFrame, *carried: str) -> DataFrame:
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("was_null"), *carried)
    base = base_spans(F.col("text"))
    return text.select("doc_id", "text", "was_null", *carried, *(base[k].alias(f"b_{k}") for k in KINDS)).select(
        "*", F.concat(*(F.col(f"b_{k}") for k in KINDS)).alias("base")
    )


def trained(docs: DataFrame, alike: int = 6000, precision: float = 0.95, seed: int = 5) -> Chooser:
    """Fits the trees on all candidates of two parts of three, weighted, and calibrates thresholds on all of the third.

    Candidates of one generator, label and list of features are one row with their number. ``alike`` is the weight that generators and labels
    share: those with more candidates than their part weigh alike, others as many as they have.
    """
    c = F.col("c")
    every = (
        _prepared(docs).select("doc_id", F.explode(candidates(F.col("text"), F.col("base"))).alias("c"))
        .select(
            c["kind"].alias("kind"), c["f"].alias("f"), weak_label(c).cast("double").alias("label"),
            F.xxhash64(F.lit(seed), c["s"], "doc_id", c["start"]).alias("u"),
        )
    )
    # Repeated rows have one u; they count once.
    counted = every.distinct().groupBy("kind", "label", "f", (F.pmod("u", F.lit(3)) == 0).alias("held")).agg(F.count("*").alias("n"))
    taught = through_table(counted.orderBy("kind", "label", "held", "f"))
    there = taught.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()
    weights, left = {}, alike
    for i, r in enumerate(sorted(there, key=lambda r: (r["n"], r["kind"], r["label"]))):
        share = left / (len(there) - i)
        weights[r["kind"], r["label"]] = min(1.0, share / r["n"])
        left -= min(share, r["n"])
    if len({label for _, label in weights}) < 2:
        return Chooser(None, (None,) * len(GENERATORS))
    weight = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("label") == x), F.lit(v)) for (k, x), v in weights.items()))
    learn = taught.where("not held").select(array_to_vector("f").alias("features"), "label", (F.col("n") * weight).alias("weight"))
    if learn.select("label").distinct().count() < 2:
        return Chooser(None, (None,) * len(GENERATORS))
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=seed, maxBins=32, featureSubsetStrategy="all", weightCol="weight").fit(learn)
    margin = margin_sql(model)
    # Margins are sums of leaves: there are as many as the trees tell apart, whatever the number of candidates.
    cells = taught.where("held").groupBy("kind", F.expr(margin).alias("m")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("m"))
    from_on = cells.select("kind", "m", "right", F.sum("n").over(down).alias("n_from"), F.sum("right").over(down).alias("right_from"))
    best = F.min(F.when(F.col("right_from") >= precision * F.col("n_from"), F.col("m")))
    found = {r["kind"]: r["m"] for r in from_on.groupBy("kind").agg(best.alias("m"), F.sum("right").alias("right")).where("right >= 5").collect()}
    return Chooser(margin, tuple(found.get(g) for g in range(len(GENERATORS))))


def with_spans(docs: DataFrame, chooser: Chooser, *carried: str) -> DataFrame:
    """doc_id, text, was_null (the text was), the columns ``carried``, arrays b_<kind> of base spans, base and spans: sorted arrays of (start, kind, end); kinds number
    the base kinds, then the generators."""
    found = _prepared(docs, *carried).withColumn("base", _ordered(F.col("base")))
    if chooser.margin is None or not any(t is not None for t in chooser.thresholds):
        return found.withColumn("spans", F.col("base"))
    limit = " ".join(f"when c.kind = {g} then {t!r}D" for g, t in enumerate(chooser.thresholds) if t is not None)
    margin = chooser.margin.replace("f[", "c.f[")
    scored = found.withColumn("c", candidates(F.col("text"), F.col("base"))).withColumn(
        "added", F.expr(f"filter(c, c -> not c.covered and coalesce({margin} >= case {limit} end, false))")
    )
    more = F.transform("added", lambda x: F.struct(x["start"].alias("start"), (x["kind"] + len(KINDS)).alias("kind"), x["end"].alias("end")))
    return scored.withColumn("spans", F.array_sort(F.concat("base", more))).drop("c", "added")


NAMES = [*KINDS, *GENERATORS]


def found(docs: DataFrame, **training) -> DataFrame:
    """One row per document: doc_id, n_<kind> for the base kinds, base_sha256, spans."""
    all_ = with_spans(docs, trained(docs, **training))
    return all_.select(
        "doc_id", *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_written(F.col("base"), NAMES), 256).alias("base_sha256"), _written(F.col("spans"), NAMES).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    wide = 4096
    # The end of the text is a span of no name. A piece is cut from the few chunks it lies in, not from the whole text.
    named = F.array(*(F.lit(f"[{n.upper()}]") for n in NAMES), F.lit(""))
    end = F.struct(F.length(text).cast("bigint").alias("start"), F.lit(len(NAMES)).alias("kind"), F.length(text).cast("bigint").alias("end"))

    def pieces(chunks: Column) -> Column:
        def step(state: Column, x: Column) -> tuple[Column, Column]:
            at, to = state["at"], x["start"]
            first, last = (at / wide).cast("int"), (to / wide).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            piece = F.concat(F.substr(near, (at % wide + 1).cast("int"), (to - at).cast("int")), named[x["kind"]])
            return F.struct(F.greatest(at, x["end"]).alias("at")), F.when(to >= at, piece).otherwise("")

        return F.array_join(scanned(F.concat(spans, F.array(end)), F.struct(F.lit(0).cast("bigint").alias("at")), step, "string"), "")

    cut = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{wide}}}"), F.lit(0)), pieces)
    return F.when(F.size(spans) > 0, cut).otherwise(text)
