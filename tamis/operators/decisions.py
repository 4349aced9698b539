"""Deterministic decisions from five judged dimensions, and the hard gate before they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import rules

DIMENSIONS = ["p", "i", "c", "o", "s"]


def result(c: Column) -> Column:
    """PASS, FAIL or UNCERTAIN, aliases included; null for anything else."""
    out = F.when(c.isin(rules.RESULTS), c)
    for alias, value in rules.RESULT_ALIASES.items():
        out = out.when(c == alias, value)
    return out


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether a lower-cased text has one of the terms."""
    return F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)), F.lit(False))


def derive(df: DataFrame, c_text: Column, o_text: Column) -> DataFrame:
    """Adds derived_decision and derived_code, in the order P, I, O, C, S."""
    r = [result(F.col(d)) for d in DIMENSIONS]
    unknown = r[0].isNull() | r[1].isNull() | r[2].isNull() | r[3].isNull() | r[4].isNull()
    fail = {d: x == "FAIL" for d, x in zip(DIMENSIONS, r)}
    code = (
        F.when(fail["p"], "E1").when(fail["i"], "E2")
        .when(fail["o"], F.when(any_term(o_text, rules.NON_PROCEDURAL), "E3").otherwise("E4"))
        .when(fail["c"], F.when(any_term(c_text, rules.INTERNAL_COMPARATOR), "E10").otherwise("E5"))
        .when(fail["s"], "E6")
    )
    all_pass = (r[0] == "PASS") & (r[1] == "PASS") & (r[2] == "PASS") & (r[3] == "PASS") & (r[4] == "PASS")
    return df.withColumn("derived_code", F.when(~unknown, code)).withColumn("derived_decision", F.when(unknown, None).when(all_pass, "INCLUDE").when(F.col("derived_code").isNotNull(), "EXCLUDE").otherwise("MAYBE"))


def hard_gate(df: DataFrame, c_text: Column, o_text: Column) -> DataFrame:
    """Adds gate_issues, final_decision and final_code. df: decision, code and what ``derive`` adds.
    Any issue, a mere difference of codes included, makes the decision MAYBE without a code."""
    known = F.col("derived_decision").isNotNull()
    now = F.coalesce("derived_decision", "decision")
    now_code = F.when(known, F.when(now == "EXCLUDE", F.col("derived_code"))).otherwise(F.col("code"))
    transfer = any_term(o_text, rules.TRANSFER) & ~any_term(o_text, rules.NO_TRANSFER)
    only_knowledge = any_term(o_text, rules.KNOWLEDGE) & ~any_term(o_text, rules.SKILL_TOOLS)
    issues = F.array_compact(F.array(
        F.when(known & ~F.col("decision").eqNullSafe(F.col("derived_decision")), "decision_mismatch"),
        F.when(known & F.col("decision").eqNullSafe(F.col("derived_decision")) & (F.col("derived_decision") == "EXCLUDE") & ~F.col("code").eqNullSafe(F.col("derived_code")), "code_mismatch"),
        F.when((now == "INCLUDE") & any_term(c_text, rules.INTERNAL_COMPARATOR), "internal_comparator"),
        F.when((now == "EXCLUDE") & (now_code == "E4") & (result(F.col("o")) == "FAIL") & transfer, "transfer_signal"),
        F.when((now == "INCLUDE") & only_knowledge, "knowledge_only"),
    ))
    out = df.withColumn("gate_issues", issues)
    bad = F.size("gate_issues") > 0
    return out.withColumn("final_decision", F.when(bad, "MAYBE").otherwise(now)).withColumn("final_code", F.when(~bad, now_code))


def validate(df: DataFrame) -> DataFrame:
    """One row per problem of a record: (key, issue). df: key, decision, code, path and the dimensions."""
    blank = F.coalesce(F.trim("path"), F.lit("")) == ""
    issues = F.array_compact(F.array(
        F.when(F.col("decision").isNull(), "missing decision"),
        F.when(~F.col("decision").isin("INCLUDE", "EXCLUDE", "MAYBE", "SKIPPED"), "invalid decision"),
        F.when((F.col("decision") == "EXCLUDE") & ~F.coalesce(F.col("code").isin(rules.CODES), F.lit(False)), "invalid code"),
        F.when((F.col("decision") == "INCLUDE") & blank, "include without document"),
        *[F.when(result(F.col(d)).isNull(), f"{d}: invalid result") for d in DIMENSIONS],
    ))
    return df.select("key", F.explode(issues).alias("issue"))
