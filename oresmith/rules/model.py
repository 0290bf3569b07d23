"""Rules as data: one definition drives enforcement, issues, status and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DECLARATIVE = "declarative"
IMPERATIVE = "imperative"


@dataclass(frozen=True)
class Rule:
    """One catalog rule.

    ``kind`` says how to read it: a ``predicate`` is SQL text that must hold on every row, a
    ``duplicate`` rule names ``columns`` that must be unique together, a ``foreign_key`` rule
    names ``columns`` that must resolve to a dimension. Only predicates are evaluated as text.
    """

    rule_id: str
    object_name: str
    group: str
    expression: str
    action: str
    severity: str
    kind: str = "predicate"
    columns: tuple[str, ...] = ()

    @property
    def layer(self) -> str:
        return self.object_name.split("_", 1)[0]


@dataclass(frozen=True)
class Expectation:
    """A named row predicate; failing rows are dropped (``drop``) or only counted (``monitor``)."""

    name: str
    object_name: str
    predicate: str
    action: str = "drop"


@dataclass(frozen=True)
class Reason:
    code: str
    predicate: str


@dataclass(frozen=True)
class IssueSpec:
    """Which rows of an object to report for a rule, under which keys, and why."""

    object_name: str
    rule_id: str
    group: str
    keys: tuple[str, ...]
    reasons: tuple[Reason, ...]


def holds(predicate: str) -> Column:
    """True only where the predicate is true: NULL counts as a failure."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def violates(predicate: str) -> Column:
    return ~holds(predicate)


def first_reason(reasons: tuple[Reason, ...]) -> Column:
    """Code of the first reason whose predicate is true, else UNKNOWN."""
    head, *tail = reasons
    code = F.when(F.expr(head.predicate), F.lit(head.code))
    for reason in tail:
        code = code.when(F.expr(reason.predicate), F.lit(reason.code))
    return code.otherwise(F.lit("UNKNOWN"))


def any_reason(reasons: tuple[Reason, ...]) -> Column:
    """True where at least one reason applies, never NULL."""
    return holds(" OR ".join(f"({r.predicate})" for r in reasons))


def variant_rule_id(rule_id: str, variant: str) -> str:
    """Rule ids start with DP_ in the declarative and IP_ in the imperative variant."""
    if variant == IMPERATIVE and rule_id.startswith("DP_"):
        return "IP_" + rule_id[3:]
    return rule_id
