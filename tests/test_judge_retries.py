import hashlib

import pandas as pd

from tamis.operators import judging


class Broken:
    def judge(self, batch, attempt):
        raise ValueError("never")


class Poisoned:
    """Fails as a whole wherever one of some documents is in the batch."""

    def judge(self, batch, attempt):
        if batch["doc_id"].isin([3, 40, 41]).any():
            raise RuntimeError("poison")
        return judging.RuleJudge().judge(batch).assign(problem=None)


def expected(ids):
    out = []
    for i in ids:
        for attempt in range(3):
            d = int(hashlib.md5(f"{i}:{attempt}".encode()).hexdigest()[0], 16)
            problem = "rate_limited" if d < 4 else "failed" if d < 6 else "severe" if d == 6 else None
            wait = 0 if attempt == 2 else {"rate_limited": 30 * 2**attempt, "failed": 5}.get(problem, 0)
            out.append((i, attempt, problem, wait))
            if problem is None:
                break
    return sorted(out, key=str)


def test_failed_rows_go_round_again(spark):
    docs = spark.createDataFrame([(i, None if i == 7 else "text " * i, "extra") for i in range(150)], "doc_id long, text string, problem string")
    slept = []
    got = judging.judge_with_retries(docs.repartition(3), judging.FlakyJudge(judging.RuleJudge()), sleep=slept.append)
    rows = sorted(((r.doc_id, r.attempt, r.problem, r.wait_seconds) for r in got.collect()), key=str)
    assert rows == expected(range(150)) and slept == [30, 60]
    again = judging.judge_with_retries(docs.repartition(7), judging.FlakyJudge(judging.RuleJudge()))  # other batches, same rows
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    final = {r.doc_id: r for r in judging.verdicts(got).collect()}
    assert len(final) == 150
    plain = judging.RuleJudge().judge(pd.DataFrame({"doc_id": range(150), "text": [r.text for r in docs.orderBy("doc_id").collect()]})).set_index("doc_id")
    for i, row in final.items():
        last = max((x for x in rows if x[0] == i), key=lambda x: x[1])
        assert row.attempts == last[1] + 1
        assert (row.p, row.reason) == (("UNCERTAIN", "given up after 3 attempts") if last[2] else (plain.p[i], plain.reason[i]))


def test_errors_are_rows_and_rounds_end_early(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    broken = judging.judge_with_retries(docs, Broken(), most=2).collect()
    assert sorted((r.doc_id, r.attempt, r.problem, r.reason) for r in broken) == [(i, a, "failed", "judge failed: ValueError") for i in (1, 2) for a in (0, 1)]
    poisoned = judging.judge_with_retries(spark.range(100).selectExpr("id as doc_id", "'a' as text"), Poisoned()).filter("problem is not null")
    assert sorted((r.doc_id, r.attempt) for r in poisoned.collect()) == [(i, a) for i in (3, 40, 41) for a in range(3)]
    assert judging.judge_with_retries(docs.limit(0), Broken()).count() == 0
