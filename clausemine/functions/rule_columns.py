"""Column expressions over rules: terms and atoms as structs, a body as an array of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = "struct<kind: string, node_type: string, name: string, entity_id: bigint>"
ATOM = f"struct<relation: string, subject: {TERM}, object: {TERM}>"
IF = " :- "
RULE_SCHEMA = f"ord bigint, rule_type string, head {ATOM}, body array<{ATOM}>"


def variable(name: Column, node_type: Column) -> Column:
    return F.struct(F.lit("variable").alias("kind"), node_type.alias("node_type"), name.alias("name"), F.lit(None).cast("long").alias("entity_id"))


def constant(entity_id: Column, node_type: Column) -> Column:
    return F.struct(F.lit("constant").alias("kind"), node_type.alias("node_type"), F.lit(None).cast("string").alias("name"), entity_id.cast("long").alias("entity_id"))


def atom(relation: Column, subject: Column, obj: Column) -> Column:
    return F.struct(relation.alias("relation"), subject.alias("subject"), obj.alias("object"))


def signature(a: Column) -> Column:
    """The edge type of an atom."""
    return F.struct(a["subject"]["node_type"].alias("src_type"), a["relation"].alias("relation"), a["object"]["node_type"].alias("dst_type"))


def chain(body: Column) -> Column:
    """A body's edge types in order; variable names play no part in grounding."""
    return F.transform(body, signature)


def rule_type(head: Column, body: Column) -> Column:
    used = lambda t: F.exists(body, lambda a: (a["subject"]["name"] == t["name"]) | (a["object"]["name"] == t["name"]))
    grounded = (head["subject"]["kind"] == "constant") | (head["object"]["kind"] == "constant")
    return F.when(grounded, "ac1").when(F.coalesce(used(head["subject"]) & used(head["object"]), F.lit(False)), "cyclic").otherwise("ac2")


def tautological(head: Column, body: Column) -> Column:
    return F.exists(body, lambda a: a.eqNullSafe(head))


def terms(head: Column, body: Column) -> Column:
    both = lambda a: F.array(a["subject"], a["object"])
    return F.concat(both(head), F.flatten(F.transform(body, both)))


def variables(head: Column, body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(terms(head, body), lambda t: t["kind"] == "variable"), lambda t: t["name"])))


def constants(head: Column, body: Column) -> Column:
    """``type:id`` of each constant."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(terms(head, body), lambda t: t["kind"] == "constant"), shown_term)))


def shown_term(t: Column) -> Column:
    return F.when(t["kind"] == "variable", t["name"]).otherwise(F.concat_ws(":", t["node_type"], t["entity_id"].cast("string")))


def shown_atom(a: Column) -> Column:
    return F.concat(F.concat_ws("_", a["subject"]["node_type"], a["relation"], a["object"]["node_type"]), F.lit("("), shown_term(a["subject"]), F.lit(", "), shown_term(a["object"]), F.lit(")"))


def shown_body(body: Column) -> Column:
    return F.concat_ws(", ", F.transform(body, shown_atom))


def shown_rule(head: Column, body: Column) -> Column:
    return F.concat(shown_atom(head), F.lit(IF), shown_body(body))


def with_keys(rules: DataFrame) -> DataFrame:
    """Adds ``rule_key`` (the whole rule) and ``chain_key`` (its body's edge types), both free of collisions."""
    return rules.withColumns({"rule_key": F.to_json(F.struct("rule_type", "head", "body")), "chain_key": F.to_json(F.struct(chain(F.col("body")).alias("c")))})


def noisy_or(confidence: Column) -> Column:
    """The aggregate 1 - product(1 - c); 0 for no rows."""
    return F.coalesce(1 - F.product(1 - confidence), F.lit(0.0))
