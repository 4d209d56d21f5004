"""Whole-word dictionary matching as Catalyst expressions.

Semantics (the original's): an entry hits a text when ``\\b<entry>\\b``
matches the lower-cased text, both lower-cased; the original-case entry is
reported.  ``\\b`` is Unicode-aware here (``(?U)``).

Plan: think of the lower-cased text as alternating runs of word and
non-word characters (``(?U)\\w+|\\W+``).  An entry that starts and ends with
a word character matches exactly when some window of consecutive runs
concatenates to it: its boundaries fall on run edges, and its inner runs
must be equal whole runs.  One-run entries are therefore an
``array_intersect`` of the word tokens with the dictionary literal (hash
lookups); longer entries are found with one look-ahead alternation per run
count.  Everything runs inside one projection: no join, no shuffle, no
Python, no lambda.  Entries whose first or last character is not a word
character (e.g. ``c++``) keep the regex form, one ``rlike`` each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"\w+|\W+")
_WORD = re.compile(r"\w")
RUN_PATTERN = r"(?U)\w+|\W+"

# Above this many entries the per-row literal / alternation gets costly;
# skill_pairs(strategy="auto") then uses the table form (skill_pairs_join).
MAX_LITERAL_TERMS = 5000


@dataclass
class TermDictionary:
    """A term list prepared for matching.  ``terms`` keeps the original
    strings (distinct, first-seen order); matching is on lower case."""

    terms: list[str]
    edge: str = "word"  # "word" = \b semantics; "lookaround" = no word char on either side
    by_lower: dict[str, list[str]] = field(init=False)
    ngram_terms: dict[int, list[str]] = field(init=False)
    regex_terms: list[str] = field(init=False)

    def __post_init__(self):
        seen: dict[str, None] = {}
        for t in self.terms:
            if t is not None and t != "":
                seen.setdefault(t, None)
        self.terms = list(seen)
        self.by_lower = {}
        for t in self.terms:
            self.by_lower.setdefault(t.lower(), []).append(t)
        self.ngram_terms = {}
        self.regex_terms = []
        for low in self.by_lower:
            # word characters at both ends: \b and look-around agree, and the
            # run n-gram test is exact
            if _WORD.match(low[0]) and _WORD.match(low[-1]):
                n = len(_RUN.findall(low))
                self.ngram_terms.setdefault(n, []).append(low)
            else:
                self.regex_terms.append(low)

    @property
    def lower_terms(self) -> list[str]:
        return list(self.by_lower)

    def __len__(self) -> int:
        return len(self.terms)


def _regex_for(term: str, edge: str) -> str:
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)
    if edge == "lookaround":
        return r"(?U)(?<!\w)" + quoted + r"(?!\w)"
    return r"(?U)\b" + quoted + r"\b"


def _quote(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def multi_run_pattern(entries: list[str]) -> str:
    """Zero-width matches at every word start followed by one of the
    entries and a word boundary.  Captured in a lookahead, so overlapping
    hits are all found; entries of one run count cannot both match at the
    same start, so one pattern per run count is exact."""
    alts = "|".join(_quote(e) for e in sorted(entries, key=lambda e: (-len(e), e)))
    return r"(?U)\b(?=(" + alts + r")\b)"


def match_terms(text: Column, dic: TermDictionary) -> Column:
    """Sorted distinct lower-case dictionary entries found in ``text``.

    No lambda functions: single-run entries are an ``array_intersect`` of
    the text's word tokens with the dictionary literal (hash lookups);
    entries spanning several runs use one look-ahead pattern per run count;
    entries with a non-word first or last character use their own regex.
    All of it compiles into the whole-stage code."""
    low = F.lower(text)
    empty = F.array().cast("array<string>")
    parts = []
    singles = dic.ngram_terms.get(1, [])
    if singles:
        words = F.coalesce(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), 0), empty)
        parts.append(F.array_intersect(words, F.array(*[F.lit(t) for t in singles])))
    for n in sorted(k for k in dic.ngram_terms if k > 1):
        hits = F.regexp_extract_all(low, F.lit(multi_run_pattern(dic.ngram_terms[n])), 1)
        parts.append(F.coalesce(hits, empty))
    if dic.regex_terms:
        hits = [F.when(F.coalesce(low.rlike(_regex_for(t, dic.edge)), F.lit(False)), F.lit(t))
                for t in dic.regex_terms]
        parts.append(F.array_compact(F.array(*hits)))
    if not parts:
        return empty
    out = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.array_sort(F.array_distinct(out))


def original_terms(lower_hits: Column, dic: TermDictionary) -> Column:
    """Map lower-case hits back to every original-case entry
    (``Salesforce`` and ``salesforce`` are two entries, two hits)."""
    if all(len(v) == 1 and v[0] == k for k, v in dic.by_lower.items()):
        return lower_hits
    pairs = []
    for low, origs in dic.by_lower.items():
        pairs += [F.lit(low), F.array(*[F.lit(o) for o in origs])]
    m = F.create_map(*pairs)
    return F.array_sort(F.flatten(F.transform(lower_hits, lambda x: F.try_element_at(m, x))))
