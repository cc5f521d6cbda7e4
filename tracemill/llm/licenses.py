"""License scans: ordered signature rules with a keyword prefilter.

The rules come from a catalogue of license families: names, versions and the phrases in which people state them give a
few hundred regular expressions. A rule has a label, a keyword, a priority and a confidence. It runs only if its keyword
occurs in the text, so that most texts cost a few substring tests. Of overlapping detections, one whose span lies inside
a span of higher priority is dropped (of equal priority: inside a longer one), and what is left gives the labels.

``scanned`` also counts the base phrases: places where the words of a phrase stand consecutively, in words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined cases: a null or empty text has no words and no labels (an empty string) and scores 0. Rows are independent of
each other: a repeated row, a null doc_id or a tie changes nothing elsewhere. Whole texts are read, however long.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from tracemill.llm.words import LETTERS_AND_DIGITS, encoded

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Families: label, keyword, pattern of the name, versions (empty: none).
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit", ()),
    ("apache", "apache", r"(?:the )?apache", ("1.0", "1.1", "2.0")),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lesser general", r"(?:the )?(?:gnu )?lesser general public", ("2.1", "3")),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl", ("2.1", "3")),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public", ("1", "3")),
    ("agpl", "agpl", r"(?:the )?(?:gnu )?agpl", ("1", "3")),
    ("bsd", "bsd", r"(?:the )?(?:new |modified |simplified )?bsd", ("0", "2", "3", "4")),
    ("mpl", "mozilla", r"(?:the )?mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"(?:the )?eclipse public", ("1.0", "2.0")),
    ("eupl", "european union", r"(?:the )?european union public", ("1.1", "1.2")),
    ("cddl", "development and distribution", r"(?:the )?common development and distribution", ("1.0", "1.1")),
    ("isc", "isc", r"(?:the )?isc", ()),
    ("zlib", "zlib", r"(?:the )?zlib", ()),
    ("bsl", "boost", r"(?:the )?boost software", ("1.0",)),
    ("artistic", "artistic", r"(?:the )?artistic", ("1.0", "2.0")),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", ("2",)),
    ("ofl", "open font", r"(?:the )?(?:sil )?open font", ("1.0", "1.1")),
    ("odbl", "open database", r"(?:the )?open database", ("1.0",)),
    ("psf", "python software", r"(?:the )?python software foundation", ("2",)),
)
CREATIVE_COMMONS = (
    ("by", r"by", "attribution"), ("by-sa", r"by[- ]sa", "attribution[- ]sharealike"), ("by-nd", r"by[- ]nd", "attribution[- ]noderivatives"),
    ("by-nc", r"by[- ]nc", "attribution[- ]noncommercial"), ("by-nc-sa", r"by[- ]nc[- ]sa", "attribution[- ]noncommercial[- ]sharealike"),
    ("by-nc-nd", r"by[- ]nc[- ]nd", "attribution[- ]noncommercial[- ]noderivatives"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# How a license is stated: pattern around the name, priority, confidence.
STATEMENTS = (
    (r"licen[sc]ed under {name}(?: licen[sc]e)?", 60, 0.95), (r"released under {name}(?: licen[sc]e)?", 60, 0.95),
    (r"under the terms of {name}(?: licen[sc]e)?", 60, 0.95), (r"subject to {name} licen[sc]e", 50, 0.9),
    (r"{name} licen[sc]e", 40, 0.85), (r"licen[sc]e *[:=] *{name}\b", 50, 0.9), (r"spdx-licen[sc]e-identifier: *{name}\b", 90, 1.0),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All signature rules in order of priority."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for text, priority, confidence in STATEMENTS:
            stated = text.format(name=rf"\b{name}")
            out.append(Rule(label, keyword, re.compile(stated), priority, confidence))
            for v in versions:
                number = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") or "." not in v else "")
                if label == "bsd":
                    forms = stated + rf"|\b{v}[- ]clause bsd licen[sc]e|\bbsd[- ]{v}[- ]clause" if v != "0" else r"\b0bsd\b|\bzero[- ]clause bsd"
                    pattern = forms if v == "0" else rf"\b{v}[- ]clause bsd licen[sc]e|\bbsd[- ]{v}[- ]clause"
                    out.append(Rule(f"bsd-{v}-clause", keyword, re.compile(pattern), priority + 5, confidence))
                    continue
                tail = rf",?[ -]*(?:version |v\.? ?)?{number}(?![0-9.]*[0-9])(?:-only|-or-later|\+)?"
                out.append(Rule(f"{label}-{v}", keyword, re.compile(stated.removesuffix(r"\b") + tail), priority + 5, confidence))
    for short, code, words in CREATIVE_COMMONS:
        for v in CC_VERSIONS:
            number = re.escape(v)
            out += [
                *(Rule(f"cc-{short}-{v}", f"cc{gap}by", re.compile(rf"\bcc{gap}{code}[- ]{number}"), 70, 0.95) for gap in " -"),
                Rule(f"cc-{short}-{v}", "creative commons", re.compile(rf"creative commons {words}(?: licen[sc]e)?(?: international| unported)?,? *(?:version |v)?{number}"), 70, 0.95),
                Rule(f"cc-{short}-{v}", "creativecommons.org", re.compile(rf"creativecommons\.org/licen[sc]es/{short}/{number}"), 80, 1.0),
            ]
        out += [Rule(f"cc-{short}", f"cc{gap}by", re.compile(rf"\bcc{gap}{code}\b(?![- ](?:nc|nd|sa))"), 30, 0.8) for gap in " -"]
    out += [
        Rule("cc0", "cc0", re.compile(r"\bcc0(?:[- ]1\.0)?\b"), 60, 0.9),
        Rule("public-domain", "public domain", re.compile(r"(?:released|dedicated|placed) (?:in|in?to) the public domain"), 50, 0.8),
        Rule("proprietary", "all rights reserved", re.compile(r"all rights reserved"), 10, 0.6),
    ]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label)))


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """Spans (start, end, rule) that are left after suppression, in a text with A-Z lower-cased."""
    gate: dict[str, bool] = {}
    found = []
    for rule in rules():
        if rule.keyword not in gate:
            gate[rule.keyword] = rule.keyword in text
        if gate[rule.keyword]:
            found += [(*m.span(), rule) for m in rule.pattern.finditer(text)]
    found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].label))
    # The largest end among kept spans that start at or before a place, in a Fenwick tree over the starts.
    starts = sorted({f[0] for f in found})
    place = {s: i + 1 for i, s in enumerate(starts)}
    reach = [0] * (len(starts) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        i, most = place[start], 0
        while i:
            most, i = max(most, reach[i]), i & (i - 1)
        if most < end:
            kept.append((start, end, rule))
            i = place[start]
            while i < len(reach):
                reach[i], i = max(reach[i], end), i + (i & -i)
    return kept


def base_places(words: list[bytes], phrases: Mapping[str, str] = BASE) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        at = -1
        try:
            while True:
                at = words.index(parts[0], at + 1)
                if words[at : at + len(parts)] == parts:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def scan(text) -> tuple:
    """One text: words, base places, first, last, base labels, labels, score."""
    raw = encoded(text).lower()
    cut = raw.translate(LETTERS_AND_DIGITS)
    words = cut.split()
    base = base_places(words) if b"license" in cut else []
    # The rules need one of few stems; most texts have none of them.
    stems = (b"licen", b"cc by", b"cc-by", b"cc0", b"creative commons", b"public domain", b"all rights", b"spdx", b"gpl", b"under the terms", b"released under", b"bsd")
    found = detections(raw.decode("utf-8", "surrogatepass")) if any(s in raw for s in stems) else []
    labels = {label for _, label in base}
    return (
        len(words), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {r.label for *_, r in found})), max([r.confidence for *_, r in found] + [1.0] * bool(base), default=0.0),
    )


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([scan(t) for t in b["text"]], columns=list(COLUMNS))
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
