"""Quality of judgements: parsing, structure, consistency and grounding of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import rules
from tamis.functions import text as T

DIMENSIONS = ["P", "I", "C", "O", "S"]
JUDGEMENT = "decision string, exclusion_code string, picos map<string, struct<result: string, evidence: array<string>, analysis: string>>, reason string"
DECISIONS = ["INCLUDE", "EXCLUDE", "MAYBE"]


def parse(response: Column) -> Column:
    """A judge's answer as JUDGEMENT, from the whole answer or its outermost braces; null without JSON,
    without a valid decision or without picos. Dimensions that lack are UNCERTAIN without evidence."""
    raw = T.parse_object(response, JUDGEMENT)
    blank = F.struct(F.lit("UNCERTAIN").alias("result"), F.array().cast("array<string>").alias("evidence"), F.lit("").alias("analysis"))
    whole = F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.coalesce(F.try_element_at(raw["picos"], F.lit(d)), blank))])
    ok = raw["decision"].isin(DECISIONS) & raw["picos"].isNotNull()
    return F.when(ok, F.struct(raw["decision"].alias("decision"), raw["exclusion_code"].alias("exclusion_code"), whole.alias("picos"), F.coalesce(raw["reason"], F.lit("")).alias("reason")))


def issues(results: DataFrame) -> DataFrame:
    """(key, issue, severe, warning) of judgements: key, decision, exclusion_code, picos (as in
    JUDGEMENT) and text. Severe issues call for another attempt; evidence that is not in the text is
    a warning only. Without picos nothing but that is reported of the structure."""
    text = T.quote_normal(F.coalesce("text", F.lit("")))
    rows = results.withColumn("_text", text)
    dims = {d: F.try_element_at("picos", F.lit(d)) for d in DIMENSIONS}
    result = {d: dims[d]["result"] for d in DIMENSIONS}
    has = lambda c, x: F.coalesce(c == x, F.lit(False))
    fail = [has(result[d], "FAIL") for d in DIMENSIONS]
    uncertain = [has(result[d], "UNCERTAIN") for d in DIMENSIONS]
    passed = [has(result[d], "PASS") for d in DIMENSIONS]
    any_of = lambda xs: xs[0] | xs[1] | xs[2] | xs[3] | xs[4]
    all_pass = passed[0] & passed[1] & passed[2] & passed[3] & passed[4]
    decision, some = F.col("decision"), F.col("picos").isNotNull()

    def issue(when: Column, message: str, severe: bool, warning: bool = False) -> Column:
        return F.when(when, F.struct(F.lit(message).alias("issue"), F.lit(severe).alias("severe"), F.lit(warning).alias("warning")))

    found = [
        issue(decision.isNull(), "decision missing", True), issue(~some, "picos missing", True), issue(some & ~F.coalesce(decision.isin(DECISIONS), F.lit(False)), "decision invalid", True),
        issue(some & has(decision, "EXCLUDE") & ~F.coalesce(F.col("exclusion_code").isin(rules.CODES), F.lit(False)), "code invalid", True),
        issue(some & all_pass & ~has(decision, "INCLUDE"), "all pass, not INCLUDE", True), issue(some & any_of(fail) & ~has(decision, "EXCLUDE"), "a fail, not EXCLUDE", True),
        issue(some & any_of(uncertain) & ~any_of(fail) & has(decision, "INCLUDE"), "uncertain, but INCLUDE", True),
    ]
    for d in DIMENSIONS:
        evidence = F.coalesce(dims[d]["evidence"], F.array().cast("array<string>"))
        ungrounded = F.exists(evidence, lambda e: (F.length(e) >= 10) & (F.length(T.quote_normal(e)) >= 20) & ~F.contains(F.col("_text"), T.quote_normal(e)))
        found += [
            issue(some & result[d].isNull(), f"{d}: result missing", True), issue(some & ~result[d].isin(rules.RESULTS), f"{d}: result invalid", True), issue(some & (F.size(evidence) == 0), f"{d}: evidence missing", True),
            issue(some & (F.coalesce(dims[d]["analysis"], F.lit("")) == ""), f"{d}: analysis missing", True), issue(some & F.exists(evidence, lambda e: (e != "") & (F.length(e) < 10)), f"{d}: evidence too short", False),
            issue(some & (F.col("_text") != "") & ungrounded, f"{d}: evidence not in the text", False, True),
        ]
    return rows.select("key", F.explode(F.array_compact(F.array(*found))).alias("i")).select("key", "i.*")


def needs_retry(found: DataFrame) -> DataFrame:
    """(key, n_severe) of judgements with severe issues."""
    return found.filter("severe").groupBy("key").agg(F.count("*").alias("n_severe"))
