"""URL filter: listed rules first, a weighted vocabulary for what no rule fits.

A rule is a host and the beginning of a path (``example.com/en/``) with a
verdict. It fits its host and all subdomains where the url's path starts with
the rule's. Of the rules that fit, the longest decides.

Other urls are read once by an Aho-Corasick automaton over all terms of the
vocabulary. A hit counts only between characters that are neither letters nor
digits of ASCII, so ``sex`` isn't found in ``sussex``. Each distinct term counts
once with its weight. A strict term weighs ``LIMIT`` and is enough alone; soft
terms reject when several distinct ones weigh ``LIMIT`` together. Host and path
are read, query strings and fragments aren't: they quote other sites' names.

Rules and vocabulary are short lists that a user passes in; they travel with
the task. Each url is judged where it is, in Arrow batches without a shuffle,
so a host that holds a third of all rows is no hot key.

Defined cases: a null url, an empty one and one without ``://`` have an empty
host and path, no rule and the verdict ``allow``; repeated rows get equal
verdicts; urls are read whole at any length; rules of equal length that fit
both go by the longer host, then ``block`` before ``allow``; an empty table gives
an empty table; other columns are kept, and the verdict's column is ``verdict``,
lengthened while ``pages`` has one of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import free_name

ALLOW, BLOCK = "allow", "block"
LIMIT = 3
#: Weights: one strict term, two strong soft ones, a strong and a weak, or three weak ones reach the limit.
STRICT, STRONG, WEAK = 3, 2, 1
TERMS = {
    STRICT: """porn porno xxx hentai milf camsex livesex sexcam sexcams escort escorts erotic erotica nude nudes casino casinos poker roulette
        slots jackpot betting bets sportsbook viagra cialis warez keygen torrent torrents phishing malware payday""".split(),
    STRONG: "adult sex sexy cam cams dating bet gamble gambling crack cracked pills pharmacy replica ads adserver banner popup popunder affiliate loan loans spam".split(),
    WEAK: "x hot girls free win winner bonus prize cheap deal deals track tracker tracking click clicks promo offer offers sponsored download cash credit farm".split(),
}
VOCABULARY = {term: weight for weight, terms in TERMS.items() for term in terms}
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = frozenset(_Z + "0123456789")
VERDICT = "rule string, verdict string, n_strict long, n_soft long, weight long"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _A, _Z), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


class Rules:
    """Rules by host, then by path: a url looks up each of its parent hosts once."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"a rule's verdict is {ALLOW} or {BLOCK}, not {verdict}")
            host, slash, path = rule.partition("/")
            paths = self.by_host.setdefault(host.lower(), {})
            if paths.get(slash + path) != BLOCK:
                paths[slash + path] = verdict
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}
        self.depth = max((h.count(".") + 1 for h in self.by_host), default=0)

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        labels = host.rsplit(".", self.depth)
        parents = [host] if len(labels) <= self.depth else []
        parents += [".".join(labels[i:]) for i in range(1, len(labels))]
        if "" in self.by_host and "" not in parents:
            parents.append("")
        found = None
        for parent in parents:
            for n in self.lengths.get(parent, ()):
                verdict = self.by_host[parent].get(path[:n]) if n <= len(path) else None
                if verdict:
                    if found is None or (len(parent) + n, len(parent)) > found[0]:
                        found = (len(parent) + n, len(parent)), parent + path[:n], verdict
                    break
        return found[1:] if found else (None, None)


class Vocabulary:
    """All terms in one automaton."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for term in weights:
            if not re.fullmatch(r"[a-z0-9](?:[ -~]*[a-z0-9])?", term) or re.search("[A-Z]", term):
                raise ValueError(f"a term is lower-case ASCII between letters or digits, not {term!r}")
            self.automaton.add_word(term, term)
        if weights:
            self.automaton.make_automaton()

    def terms(self, text: str) -> set[str]:
        """Distinct terms that stand alone in ``text``."""
        if not self.weights:
            return set()
        found, last = set(), len(text) - 1
        for end, term in self.automaton.iter(text):
            before = end - len(term)
            if (before < 0 or text[before] not in _INSIDE) and (end == last or text[end + 1] not in _INSIDE):
                found.add(term)
        return found

    def judge(self, text: str) -> tuple[str, int, int, int]:
        """Verdict, strict terms, soft terms and the weight of all."""
        weights = [self.weights[t] for t in self.terms(text)]
        strict = sum(w >= LIMIT for w in weights)
        return BLOCK if sum(weights) >= LIMIT else ALLOW, strict, len(weights) - strict, sum(weights)


def judge(rules: Iterable[tuple[str, str]], weights: dict[str, int] | None = None):
    """A function of columns (host, path) that gives ``VERDICT``; the two lists are built once a task."""
    rules, weights = list(rules), dict(VOCABULARY if weights is None else weights)
    Rules(rules), Vocabulary(weights)  # raise here, not in a task

    @F.pandas_udf(VERDICT)
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        listed, vocabulary = Rules(rules), Vocabulary(weights)
        lower = str.maketrans(_A, _Z)
        for hosts, paths in batches:
            rows = []
            for host, path in zip(hosts, paths):
                rule, verdict = listed.best(host, path)
                own, strict, soft, weight = vocabulary.judge(host + path.translate(lower))
                rows.append((rule, verdict or own, strict, soft, weight))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "n_strict", "n_soft", "weight"])

    return verdicts


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]], weights: dict[str, int] | None = None, url: str = "url", into: str | None = None) -> DataFrame:
    """``pages`` with a last struct column: host, path, rule (null if none fits), verdict, n_strict, n_soft, weight."""
    into = into or free_name(pages, "verdict")
    host, path = host_and_path(F.col(url))
    judged = judge(rules, weights)(host, path)
    return pages.withColumn(into, judged).withColumn(into, F.struct(host.alias("host"), path.alias("path"), f"{into}.*"))
