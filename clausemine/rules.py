"""Rules as plain Python values, for writing them by hand and reading them back."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame, Row, SparkSession

from .functions.rule_columns import RULE_SCHEMA, with_keys


# Members of the enumerations, names of classes and fields, and how rules are shown are the public interface: fixed values.
class RuleType(StrEnum):
    CYCLIC = "cyclic"
    AC1 = "ac1"
    AC2 = "ac2"


class TermKind(StrEnum):
    VARIABLE = "variable"
    CONSTANT = "constant"


@dataclass(frozen=True)
class Term:
    """A variable with a name or a constant with an entity id, of one node type."""

    kind: TermKind
    node_type: str
    name: str | None = None
    entity_id: int | None = None

    def __post_init__(self) -> None:
        if self.kind is TermKind.VARIABLE and (self.name is None or self.entity_id is not None):
            raise ValueError("a variable has a name and no entity id")
        if self.kind is TermKind.CONSTANT and (self.entity_id is None or self.name is not None):
            raise ValueError("a constant has an entity id and no name")

    @classmethod
    def variable(cls, name: str, node_type: str) -> Term:
        return cls(TermKind.VARIABLE, node_type, name=name)

    @classmethod
    def constant(cls, entity_id: int, node_type: str) -> Term:
        return cls(TermKind.CONSTANT, node_type, entity_id=entity_id)

    def __str__(self) -> str:
        return self.name if self.kind is TermKind.VARIABLE else f"{self.node_type}:{self.entity_id}"


@dataclass(frozen=True)
class Atom:
    relation: str
    subject: Term
    object: Term

    @property
    def edge_signature(self) -> tuple[str, str, str]:
        return self.subject.node_type, self.relation, self.object.node_type

    def __str__(self) -> str:
        return f"{'_'.join(self.edge_signature)}({self.subject}, {self.object})"


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    rule_type: RuleType | None = None

    def __post_init__(self) -> None:
        if self.rule_type is None:
            object.__setattr__(self, "rule_type", classify_rule(self.head, self.body))

    @property
    def length(self) -> int:
        return len(self.body)

    @property
    def terms(self) -> list[Term]:
        return [t for a in (self.head, *self.body) for t in (a.subject, a.object)]

    @property
    def variables(self) -> set[str]:
        return {t.name for t in self.terms if t.kind is TermKind.VARIABLE}

    @property
    def constants(self) -> set[tuple[int, str]]:
        return {(t.entity_id, t.node_type) for t in self.terms if t.kind is TermKind.CONSTANT}

    @property
    def is_tautological(self) -> bool:
        return self.head in self.body

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}"


def classify_rule(head: Atom, body: tuple[Atom, ...]) -> RuleType:
    """A constant in the head: AC1; both head variables in the body: CYCLIC; else AC2."""
    ends = (head.subject, head.object)
    if any(t.kind is TermKind.CONSTANT for t in ends):
        return RuleType.AC1
    used = {t.name for a in body for t in (a.subject, a.object)}
    return RuleType.CYCLIC if all(t.name in used for t in ends) else RuleType.AC2


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a DataFrame, with ``ord`` as their place in the list."""
    term = lambda t: (str(t.kind), t.node_type, t.name, t.entity_id)
    atom = lambda a: (a.relation, term(a.subject), term(a.object))
    rows = [(i, str(r.rule_type), atom(r.head), [atom(a) for a in r.body]) for i, r in enumerate(rules)]
    return with_keys(spark.createDataFrame(rows, RULE_SCHEMA))


def rule_of(row: Row) -> Rule:
    """Back from a row with ``rule_type, head, body``."""
    term = lambda t: Term(TermKind(t["kind"]), t["node_type"], t["name"], t["entity_id"])
    atom = lambda a: Atom(a["relation"], term(a["subject"]), term(a["object"]))
    return Rule(atom(row["head"]), tuple(map(atom, row["body"])), RuleType(row["rule_type"]))
