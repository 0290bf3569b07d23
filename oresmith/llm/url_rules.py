"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a pattern: ``*`` stands for any characters, ``^`` for one separator (a character that
is no letter, digit, ``_``, ``-``, ``.`` or ``%``) or the end; ``||`` in front means the start of
the host or of one of its parent domains; all else is literal. Runs of letters and digits that
the pattern delimits on both sides are its literal tokens: every url that fits has them among
its own tokens. The rule is filed under the one that is rarest among the urls. A url looks up
its tokens, and only the rules found there run their regular expressions.

Urls are compared with A-Z in lower case; rules that match case see the path and all after it
as they are.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_tokens = re.compile(r"[a-z0-9]+").findall
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


@dataclass(frozen=True)
class PatternRule:
    """A pattern with a verdict. Of the rules that fit a url, the one of highest rank counts; of
    equal ranks, the one of greatest name."""

    name: str
    pattern: str
    verdict: str
    rank: tuple[int, ...]
    match_case: bool = False

    @cached_property
    def regex(self) -> str:
        """The same as a regular expression."""
        body, start = self.pattern, ""
        if body.startswith("||"):
            body, start = body[2:], r"^(?:(?!://)(?s:.))*://(?:[^/?#]*\.)?"
        elif body.startswith("^"):
            body, start = body[1:], r"(?:^|[^a-z0-9_.%-])"
        parts = {"*": "(?s:.)*", "^": _SEPARATOR}
        return start + "".join(parts.get(c) or re.escape(c) for c in body)

    @cached_property
    def tokens(self) -> list[str]:
        """Tokens of every url that fits: runs with a literal or separator on both sides."""
        found = []
        lower = self.pattern.translate(_LOWER)
        for run in re.finditer(r"[a-z0-9]+", lower):
            before, after = lower[: run.start()], lower[run.end() : run.end() + 1]
            if before and before[-1] != "*" and after and after != "*":
                found.append(run.group())
        return found


def host_rule(rule: str, verdict: str, rank: tuple[int, ...]) -> PatternRule:
    """A rule for a host with its subdomains and the start of a path, written ``host/path``."""
    return PatternRule(rule, f"||{rule}", verdict, rank, match_case=True)


def _lower_host(url: str) -> str:
    """The url with A-Z in lower case up to the end of its host."""
    scheme, mark, rest = url.partition("://")
    end = re.search(r"[/?#]|$", rest).start()
    return (scheme + mark + rest[:end]).translate(_LOWER) + rest[end:] if mark else url


class RuleIndex:
    """Rules by their rarest token; rules without a token are tried on every url."""

    def __init__(self, rules: list[PatternRule], token_counts: dict[str, int]):
        self.filed: dict[str, list[tuple[PatternRule, re.Pattern]]] = {}
        self.always: list[tuple[PatternRule, re.Pattern]] = []
        for rule in sorted(rules, key=lambda r: r.rank, reverse=True):
            entry = (rule, re.compile(rule.regex))
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (token_counts.get(t, 0), -len(t), t))
                self.filed.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def best(self, url: str | None) -> PatternRule | None:
        if url is None:
            return None
        lower = url.translate(_LOWER)
        candidates = list(self.always)
        for token in set(_tokens(lower)):
            candidates += self.filed.get(token, ())
        cased = _lower_host(url)
        fitting = [rule for rule, regex in candidates if regex.search(cased if rule.match_case else lower)]
        return max(fitting, key=lambda r: (r.rank, r.name), default=None)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path:
    then up to ``?``, ``#`` or the end. Both empty for NULL or without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def token_counts(urls: DataFrame, url_column: str, rules: list[PatternRule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs, counted over the whole table.

    The result has at most one entry per token of the rules.
    """
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    lower = F.translate(F.col(url_column), string.ascii_uppercase, string.ascii_lowercase)
    tokens = F.array_distinct(F.split(lower, "[^a-z0-9]+"))
    named = F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]))
    counts = urls.select(F.explode(named).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def judge_urls(urls: DataFrame, url_column: str, rules: list[PatternRule], keep: list[str]) -> DataFrame:
    """The ``keep`` columns with host, path, rule and verdict, one row for every row of ``urls``.

    ``rule`` and ``verdict`` are those of the fitting rule of highest rank; NULL if none fits.
    A NULL or empty url fits no rule. Rows are judged where they are; nothing is shuffled.
    """
    index = RuleIndex(rules, token_counts(urls, url_column, rules))

    @F.pandas_udf(T.StructType().add("rule", "string").add("verdict", "string"))
    def judged(values: pd.Series) -> pd.DataFrame:
        best = [index.best(url) for url in values]
        return pd.DataFrame(
            {"rule": [b and b.name for b in best], "verdict": [b and b.verdict for b in best]}, dtype=object
        )

    host, path = host_and_path(url_column)
    found = urls.select(*keep, host.alias("host"), path.alias("path"), judged(F.col(url_column)).alias("judged"))
    return found.select(*keep, "host", "path", "judged.rule", "judged.verdict")
