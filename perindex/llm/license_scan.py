"""License mentions in texts: ordered signature rules behind a keyword prefilter.

A rule is a pattern over the words of a text, joined by single spaces. Its keyword must occur
in the text before the pattern is tried. Of the detections that lie within another one's words
the longer stays; of two on the same words the rule of the higher priority, the earlier one.
The base phrases are counted apart from this and always keep their labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns, whole_text

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,score:double>>"
)

# Fixed values of the contract: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Rule:
    """A signature: the earlier in the list, the higher its priority."""

    label: str
    keyword: str
    pattern: str
    score: float


def version(number: str) -> str:
    """A version as words: ``2 0`` for 2.0, with the mark and the trailing zero optional."""
    major, _, minor = number.partition(".")
    tail = rf"(?: {minor})" if minor and minor != "0" else r"(?: 0)?"
    return rf"v?{major}{tail}"


def family(label: str, name: str, keyword: str, versions: tuple[str, ...], or_later: bool = False) -> list[Rule]:
    """Rules of a license with versions: each version in notices and by name, then the bare name."""
    rules = []
    for number in versions:
        tag = f"{label}-{number.removesuffix('.0')}"
        at = rf"(?: license| licence)?(?: version)? {version(number)}\b"
        if or_later:
            rules.append(Rule(f"{tag}-or-later", keyword, rf"\b(?:{name}){at} or (?:\(?at your option\)? )?(?:any )?later", 0.97))
            rules.append(Rule(f"{tag}-only", keyword, rf"\b(?:{name}){at} only\b", 0.97))
        rules.append(Rule(tag, keyword, rf"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name}){at}", 0.95))
        rules.append(Rule(tag, keyword, rf"\bspdx license identifier (?:{name}) {version(number)}\b", 1.0))
        rules.append(Rule(tag, keyword, rf"\b(?:{name}){at}", 0.85))
    rules.append(Rule(label, keyword, rf"\b(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:{name})\b", 0.8))
    rules.append(Rule(label, keyword, rf"\b(?:{name}) licen[sc]e\b", 0.7))
    return rules


def creative_commons() -> list[Rule]:
    long = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?"}
    rules = []
    for parts in (("by", "nc", "sa"), ("by", "nc", "nd"), ("by", "nc"), ("by", "sa"), ("by", "nd"), ("by",)):
        label = "cc-" + "-".join(parts)
        for number in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            rules.append(Rule(f"{label}-{number}", "cc", rf"\bcc {' '.join(parts)} {version(number)}\b", 0.95))
            rules.append(Rule(f"{label}-{number}", "creative", rf"\bcreative commons {' '.join(long[p] for p in parts)} {version(number)}\b", 0.95))
        rules.append(Rule(label, "cc", rf"\bcc {' '.join(parts)}\b", 0.8))
        rules.append(Rule(label, "creative", rf"\bcreative commons {' '.join(long[p] for p in parts)}\b", 0.85))
    return [*rules, Rule("cc0-1", "cc0", r"\bcc0(?: 1 0)?\b", 0.9), Rule("cc", "creative", r"\bcreative commons licen[sc]e\b", 0.6)]


def signatures() -> list[Rule]:
    """All rules by priority: exact notices first, families by version, then looser words."""
    gnu = r"general public licen[sc]e|gpl|gnu gpl|gnu general public licen[sc]e"
    rules = [
        Rule("mit", "mit", r"\bunder the (?:terms of the )?mit licen[sc]e\b", 0.95),
        Rule("mit", "mit", r"\bspdx license identifier mit\b", 1.0),
        Rule("mit", "permission", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b", 0.95),
        Rule("mit", "mit", r"\bmit licen[sc]e\b", 0.8),
        Rule("isc", "isc", r"\b(?:isc licen[sc]e|identifier isc)\b", 0.8),
        Rule("bsd", "redistribution", r"\bredistribution and use in source and binary forms with or without modification are permitted\b", 0.9),
        Rule("proprietary", "reserved", r"\ball rights reserved\b", 0.5),
        Rule("public-domain", "domain", r"\b(?:released|placed|dedicated) (?:in|into|to) the public domain\b", 0.85),
        Rule("unlicense", "unlicense", r"\b(?:the )?unlicense\b", 0.8),
        Rule("wtfpl", "wtfpl", r"\bwtfpl\b", 0.9),
        Rule("zlib", "zlib", r"\bzlib licen[sc]e\b", 0.9),
        Rule("postgresql", "postgresql", r"\bpostgresql licen[sc]e\b", 0.9),
        Rule("openssl", "openssl", r"\bopenssl licen[sc]e\b", 0.9),
        Rule("boost-1", "boost", r"\bboost software licen[sc]e(?: version)?(?: 1(?: 0)?)?\b", 0.9),
    ]
    for clauses, word in ((0, "zero"), (2, "two"), (3, "three"), (4, "four")):
        rules.append(Rule(f"bsd-{clauses}-clause", "bsd", rf"\b(?:bsd (?:{clauses}|{word}) clause|(?:{clauses}|{word}) clause bsd)\b", 0.95))
    rules += family("agpl", r"gnu affero general public licen[sc]e|affero general public licen[sc]e|agpl|gnu agpl", "affero|agpl", ("1.0", "3.0"), True)
    rules += family("lgpl", r"gnu (?:lesser|library) general public licen[sc]e|(?:lesser|library) general public licen[sc]e|lgpl|gnu lgpl", "lesser|library|lgpl", ("2.0", "2.1", "3.0"), True)
    rules += family("gpl", gnu, "general public|gpl", ("1.0", "2.0", "3.0"), True)
    rules += family("gfdl", r"gnu free documentation licen[sc]e|gfdl", "free documentation|gfdl", ("1.1", "1.2", "1.3"), True)
    rules += family("apache", r"apache|apache software", "apache", ("1.0", "1.1", "2.0"))
    rules += family("mpl", r"mozilla public|mozilla public licen[sc]e|mpl", "mozilla|mpl", ("1.0", "1.1", "2.0"))
    rules += family("epl", r"eclipse public|eclipse public licen[sc]e|epl", "eclipse|epl", ("1.0", "2.0"))
    rules += family("eupl", r"european union public|european union public licen[sc]e|eupl", "european union|eupl", ("1.0", "1.1", "1.2"))
    rules += family("cddl", r"common development and distribution|cddl", "common development|cddl", ("1.0", "1.1"))
    rules += family("artistic", r"artistic", "artistic", ("1.0", "2.0"))
    rules += family("osl", r"open software|osl", "open software|osl", ("1.0", "2.0", "2.1", "3.0"))
    rules += family("afl", r"academic free|afl", "academic free|afl", ("1.1", "1.2", "2.0", "2.1", "3.0"))
    rules += family("ofl", r"sil open font|open font|ofl", "open font|ofl", ("1.0", "1.1"))
    rules += family("ms-pl", r"microsoft public|ms pl", "microsoft public|ms pl", ("1.0",))
    rules += family("python", r"python software foundation|psf", "python software|psf", ("2.0",))
    rules += family("bsd", r"bsd", "bsd", ("1.0",))
    rules += family("odbl", r"open database|odbl", "open database|odbl", ("1.0",))
    rules += creative_commons()
    return [*rules, Rule("mentioned", "licen", r"\blicen[sc]ed? under (?:the )?\w+(?: \w+){0,2}", 0.3)]


class Scanner:
    """All rules, compiled, with an automaton over their keywords."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [(rule, re.compile(rule.pattern)) for rule in rules]
        self.automaton = ahocorasick.Automaton()
        gated: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for word in rule.keyword.split("|"):
                gated.setdefault(word, []).append(k)
        for word, places in gated.items():
            self.automaton.add_word(word, places)
        self.automaton.make_automaton()
        self.base = {tuple(phrase.split(" ")): label for phrase, label in BASE.items()}

    def base_places(self, words: list[str], joined: str) -> list[tuple[int, str]]:
        """Word places of each base phrase, overlapping ones included."""
        found = []
        for phrase, label in self.base.items():
            if " ".join(phrase) not in joined:
                continue
            size = len(phrase)
            found += [
                (i, label) for i, word in enumerate(words) if word == phrase[0] and tuple(words[i : i + size]) == phrase
            ]
        return sorted(found)

    def detections(self, joined: str) -> list[tuple[str, int, int, float]]:
        """Label, first and last word (exclusive) and score of what remains after suppression."""
        tried = sorted({k for _, places in self.automaton.iter(joined) for k in places})
        found = []
        for k in tried:
            rule, pattern = self.rules[k]
            found += [(m.start(), m.end(), k) for m in pattern.finditer(joined) if m.end() > m.start()]
        if not found:
            return []
        # Sorted so, whatever lies within an earlier one ends no later than the furthest end so far.
        found.sort(key=lambda f: (f[0], -f[1], f[2]))
        starts = [i + 1 for i, c in enumerate(joined) if c == " "]
        out, reach = [], -1
        for start, end, k in found:
            if end <= reach:
                continue
            reach = end
            rule = self.rules[k][0]
            out.append((rule.label, bisect_right(starts, start), bisect_right(starts, end - 1) + 1, rule.score))
        return out

    def scan(self, text: str) -> tuple:
        # The lower() of bytes touches A-Z only; what is no ASCII is part of a word.
        words = WORD.findall(text.encode().lower().decode())
        joined = " ".join(words)
        base = self.base_places(words, joined)
        found = self.detections(joined)
        base_labels = sorted({label for _, label in base})
        labels = sorted({label for label, *_ in found} | set(base_labels))
        score = max([f[3] for f in found] + [0.9] * bool(base), default=0.0)
        return (
            len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(base_labels), ",".join(labels), score,
            [{"label": a, "start": b, "end": c, "score": d} for a, b, c, d in found],
        )


KNOWN: list[Scanner] = []


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, base phrases, labels, detections and the best score of every text.

    A null text counts as empty: no words, no labels, score 0. Repeated rows give repeated
    results, other columns are not carried, an empty table gives an empty one.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def make():
        if not KNOWN:
            KNOWN.append(Scanner(signatures()))
        scan = KNOWN[0].scan

        def scanned(keys: list[int], texts: list[str]) -> dict[str, list]:
            rows = [scan(t) for t in texts]
            return {"doc_id": keys, **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

        return scanned

    return map_columns(docs, [F.col(f"`{doc_id}`").cast("long"), whole_text(text)], make, SCANNED)
