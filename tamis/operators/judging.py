"""Pluggable judges: a protocol over batches of texts, and a deterministic one by rules."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import rules
from tamis.operators.shared import stored

RESULT = "doc_id long, p string, i string, c string, o string, s string, reason string"


class Judge(Protocol):
    """Judges a batch (doc_id, text): one row per text, columns of RESULT. Must be deterministic, as tasks may run again."""

    def judge(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class RuleJudge:
    """Five dimensions by plain rules; too short a text is uncertain in all."""

    def __init__(self, least: int = 100):
        self.least = least

    def judge(self, batch: pd.DataFrame) -> pd.DataFrame:
        text = batch["text"].fillna("")
        short = text.str.len() < self.least
        of = lambda bad: bad.map({True: "FAIL", False: "PASS"}).mask(short, "UNCERTAIN")
        return pd.DataFrame({
            "doc_id": batch["doc_id"], "p": of(text.str.contains("review", case=False, regex=False)), "i": of(text.str.len() < 2 * self.least), "c": of(text.str.contains("licensed under", case=False, regex=False)),
            "o": of(text.str.contains("@", regex=False)), "s": of(text.str.contains(" | ", regex=False)), "reason": short.map({True: "too short", False: ""}),
        })


def judge_all(docs: DataFrame, judge: Judge) -> DataFrame:
    """The judge over all rows, batch by batch; a batch that fails is uncertain, not lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield judge.judge(batch)
            except Exception as error:  # noqa: BLE001  a failing judge degrades to uncertain, with its reason
                yield pd.DataFrame({"doc_id": batch["doc_id"], **{d: "UNCERTAIN" for d in "picos"}, "reason": f"judge failed: {type(error).__name__}"})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, RESULT)


def attempts(calls: DataFrame, base_seconds: int = 30, most: int = 3) -> DataFrame:
    """Retries of each call with their waits of base * 2^n seconds."""
    n = F.sequence(F.lit(0), F.lit(most - 1))
    return calls.select("*", F.explode(n).alias("attempt")).withColumn("wait_seconds", F.when(F.col("attempt") == 0, 0).otherwise(F.lit(base_seconds) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int"))


SECOND = "doc_id long, label string, confidence string, reason string"


class SecondJudge(Protocol):
    """Looks at title and abstract again: label REVIEW, NOT_REVIEW or UNCERTAIN, confidence high, medium or low."""

    def look(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class RuleSecondJudge:
    """REVIEW where a title has one of the words of reviews; UNCERTAIN without title and abstract."""

    def look(self, batch: pd.DataFrame) -> pd.DataFrame:
        text = (batch["title"].fillna("") + " " + batch["abstract"].fillna("")).str.lower()
        review = text.map(lambda x: any(w in x for w in rules.REVIEW_KEYWORDS))
        label = review.map({True: "REVIEW", False: "NOT_REVIEW"}).mask(text.str.strip() == "", "UNCERTAIN")
        confidence = batch["abstract"].fillna("").str.len().ge(100).map({True: "high", False: "medium"}).mask(label == "UNCERTAIN", "low")
        return pd.DataFrame({"doc_id": batch["doc_id"], "label": label, "confidence": confidence, "reason": ""})


def look_again(papers: DataFrame, judge: SecondJudge) -> DataFrame:
    """A second judge over (doc_id, title, abstract), batch by batch; a batch that fails is UNCERTAIN."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield judge.look(batch)
            except Exception as error:  # noqa: BLE001  as in ``judge_all``
                yield pd.DataFrame({"doc_id": batch["doc_id"], "label": "UNCERTAIN", "confidence": "low", "reason": f"judge failed: {type(error).__name__}"})

    return papers.select("doc_id", F.col("title").cast("string").alias("title"), F.col("abstract").cast("string").alias("abstract")).mapInPandas(run, SECOND)


TRIED = RESULT + ", problem string"


class RetryJudge(Protocol):
    """Judges a batch (doc_id, text) at an attempt: columns of TRIED, problem null where the verdict stands, else
    rate_limited, severe (the verdict's quality asks for another) or failed. Must be deterministic."""

    def judge(self, batch: pd.DataFrame, attempt: int) -> pd.DataFrame: ...


class FlakyJudge:
    """A judge whose calls fail by the first digit of the md5 of id and attempt: 0 to 3 rate_limited, 4 and 5
    failed, 6 severe. For trying out the rounds without a network."""

    def __init__(self, judge: Judge):
        self.inner = judge

    def judge(self, batch: pd.DataFrame, attempt: int) -> pd.DataFrame:
        digit = batch["doc_id"].map(lambda i: int(hashlib.md5(f"{i}:{attempt}".encode()).hexdigest()[0], 16))
        return self.inner.judge(batch).assign(problem=["rate_limited" if d < 4 else "failed" if d < 6 else "severe" if d == 6 else None for d in digit])


def _tried(docs: DataFrame, judge: RetryJudge, attempt: int) -> DataFrame:
    def halves(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield judge.judge(batch, attempt)
        except Exception as error:  # noqa: BLE001  a batch that fails is halved until the row is alone, so that none fails for another
            if len(batch) > 1:
                yield from halves(batch.iloc[: len(batch) // 2])
                yield from halves(batch.iloc[len(batch) // 2 :])
            else:
                yield pd.DataFrame({"doc_id": batch["doc_id"], **{d: "UNCERTAIN" for d in "picos"}, "reason": f"judge failed: {type(error).__name__}", "problem": "failed"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from halves(batch)

    return docs.mapInPandas(run, TRIED)


def judge_with_retries(docs: DataFrame, judge: RetryJudge, most: int = 3, base_seconds: int = 30, pause_seconds: int = 5, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """All attempts (doc_id, attempt, problem, wait_seconds, verdict) of a judge over documents with unique
    doc_id. Rows that fail go round again, ``most`` times in all. Each round is one job over the rows
    that are left, stored in the shared folder, so a lost executor repeats part of one round and no verdict
    that stands is asked for twice. wait_seconds is what follows the attempt: base * 2^attempt after
    rate_limited, a pause after failed, none after severe, a verdict or the last attempt. Rounds wait
    together: ``sleep`` (none: no waiting) is called once between two rounds with the longest wait, and
    no task holds a core meanwhile. Null texts are given to the judge as they are."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rounds: list[DataFrame] = []
    for attempt in range(most):
        left = texts if not rounds else texts.join(rounds[-1].filter("problem is not null").select("doc_id"), "doc_id", "left_semi")
        last = attempt == most - 1
        wait = F.lit(0) if last else F.when(F.col("problem") == "rate_limited", base_seconds * 2**attempt).when(F.col("problem") == "failed", pause_seconds).otherwise(0)
        rounds.append(stored(_tried(left, judge, attempt).withColumn("attempt", F.lit(attempt)).withColumn("wait_seconds", wait.cast("int")), f"attempt-{attempt}"))
        waits = rounds[-1].agg(F.count("problem").alias("n"), F.max("wait_seconds").alias("s")).first()
        if not waits.n:
            break
        if sleep and waits.s:
            sleep(waits.s)
    return reduce(DataFrame.unionByName, rounds)


def verdicts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """One row per document of ``judge_with_retries`` (the same ``most``): the verdict that stands, or uncertain
    in all dimensions where the last attempt had a problem. Rows only are filtered; nothing is exchanged."""
    gave_up = F.col("problem").isNotNull()
    ends = attempts.filter(~gave_up | (F.col("attempt") == most - 1))
    dims = [F.when(gave_up, "UNCERTAIN").otherwise(F.col(d)).alias(d) for d in "picos"]
    return ends.select("doc_id", *dims, F.when(gave_up, f"given up after {most} attempts").otherwise(F.col("reason")).alias("reason"), (F.col("attempt") + 1).alias("attempts"))
