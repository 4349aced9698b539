"""Matching texts with rules, quotes and names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from tamis.functions import text as T
from tamis.operators import likeness, shared, terms


def first_rule(text: Column, patterns: list[str], keywords: list[str]) -> Column:
    """Struct (rule_id, reason) of the first pattern, else the first keyword, that a text matches."""
    low = F.lower(text)
    hit = None
    for i, (kind, rule) in enumerate([*(("pattern", p) for p in patterns), *(("keyword", k) for k in keywords)], 1):
        test = F.rlike(low, F.lit(rule)) if kind == "pattern" else F.contains(low, F.lit(rule))
        found = F.struct(F.lit(i).alias("rule_id"), F.lit(f"{kind}: {rule}").alias("reason"))
        hit = F.when(test, found) if hit is None else hit.when(test, found)
    return hit


#: Names of either side in one block at most; blocks of right names that a task reads one after another at most; left
#: names that are compared with a block of right ones together; right names that each of these is compared with in the first
#: step (twice as many in each further one), and of how many the first of all are taken.
NAMES_LEFT, NAMES_RIGHT, IN_TURN, AT_ONCE, FIRST, FIRST_OF = 4000, 32000, 8, 512, 32, 2000
#: Left names of a block at least, where there are so many.
AT_LEAST = 128
#: Likeness of names one of which is within the other.
CONTAINED = 0.95


class _Best:
    """The right names that can be among the ``top`` rows of each left name, of all blocks of right names added so far. Left
    names stand in ``name`` with ``sure``: rows of ``CONTAINED`` that are known without a search (names within each other are
    then none of those found here). ``held`` of a right name says how many rows it stands for. ``rule`` gives scores that
    are known without comparing letters (nan: none). Of the others no ratio is above twice the longest common
    subsequence, and so the shared letters, over all letters: of a few that share most the best set a place
    to reach, subsequences are measured of those whose letters allow it, and ratios in the order of these, a step at a
    time for many left names together, until they are below the last place."""

    def __init__(self, left: pd.DataFrame, least: float, top: int, rule, contained: bool):
        self.left, self.least, self.top, self.rule, self.contained = left, least, top, rule, contained
        self.found: list[list[tuple[float, int, int]]] = [[] for _ in range(len(left))]
        self.cuts = np.array([max(least, CONTAINED) if n >= top else least for n in left.sure])

    def add(self, right: pd.DataFrame) -> None:
        names = likeness.Names(self.left.name.tolist(), right.name.tolist())
        held, ids = right.held.to_numpy(), right.nth.to_numpy()
        for low in range(0, len(self.left), AT_ONCE):
            self._add(names, right, range(low, min(low + AT_ONCE, len(self.left))), held, ids)

    def _keep(self, i: int, more: list[tuple[float, int, int]]) -> None:
        own = sorted(self.found[i] + more, key=lambda x: -x[0])
        rows = np.cumsum([n for _, _, n in own])
        sure = int(self.left.sure.iloc[i])
        if sure and len(own):  # those stand before what scores less
            rows += np.where(np.array([x for x, _, _ in own]) <= CONTAINED, sure, 0)
        last = int(np.searchsorted(rows, self.top))
        if last < len(own):
            self.cuts[i] = max(self.cuts[i], own[last][0])
        self.found[i] = [x for x in own if x[0] >= self.cuts[i]]

    def _compare(self, names: likeness.Names, todo: list[tuple[int, np.ndarray]], held: np.ndarray, ids: np.ndarray) -> None:
        i, j = np.repeat([i for i, _ in todo], [len(x) for _, x in todo]), np.concatenate([x for _, x in todo])
        scores = names.ratios(i, j, self.cuts[i], bounded=True)
        more: dict[int, list[tuple[float, int, int]]] = {}
        for k in np.flatnonzero(scores >= self.cuts[i]).tolist():
            a, b = names.left[i[k]], names.right[j[k]]
            if not self.contained or not (a in b or b in a):
                more.setdefault(int(i[k]), []).append((float(scores[k]), int(ids[j[k]]), int(held[j[k]])))
        for k, x in more.items():
            self._keep(k, x)

    def _add(self, names: likeness.Names, right: pd.DataFrame, some: range, held: np.ndarray, ids: np.ndarray) -> None:
        todo, seeds = [], []
        for i, bound in zip(some, names.bounds_of(some)):
            order = np.flatnonzero(bound >= self.cuts[i] - 1e-5)
            if self.rule:
                known = self.rule(self.left.iloc[i], right)
                self._keep(i, [(float(known[j]), int(ids[j]), int(held[j])) for j in np.flatnonzero(known >= self.cuts[i])])
                order = order[np.isnan(known[order]) & (bound[order] >= self.cuts[i] - 1e-5)]
            if len(order) > FIRST_OF and self.cuts[i] == self.least:
                few = order[np.argpartition(-bound[order], FIRST_OF)[:FIRST_OF]]
                few = few[np.argsort(-names.ceilings([(i, few, bound[few])])[0], kind="stable")[:FIRST]]
                seeds.append((i, few))
                order = np.setdiff1d(order, few, assume_unique=True)
            todo.append((i, order, bound[order]))
        if seeds:
            self._compare(names, seeds, held, ids)
        todo = [(i, order[may], bound[may]) for i, order, bound in todo for may in [bound >= self.cuts[i] - 1e-5]]
        for k, most in enumerate(names.ceilings(todo)):
            i, order, _ = todo[k]
            by = np.argsort(-most, kind="stable")
            by = by[most[by] >= self.cuts[i] - 1e-5]
            todo[k] = (i, order[by], most[by])
        at, step = 0, FIRST
        while True:
            parts = [(i, order[at : at + step][most[at : at + step] >= self.cuts[i] - 1e-5]) for i, order, most in todo if at < len(order)]
            parts = [x for x in parts if len(x[1])]
            if not parts:
                return
            self._compare(names, parts, held, ids)
            at, step = at + step, 2 * step


def _numbered(df: DataFrame) -> DataFrame:
    return shared.stored(df.withColumn("nth", F.monotonically_increasing_id()), "names")


def _blocks(df: DataFrame, count: int, name: str) -> DataFrame:
    """A partition and a row with a list of all of its rows for each of ``count`` equal parts of ``df``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, kind).combine_chunks().to_struct_array()
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=[name])

    kind = to_arrow_schema(df.schema)
    return df.repartition(count).mapInArrow(gather, StructType([StructField(name, ArrayType(df.schema))]))


def _matches(mine: DataFrame, theirs: DataFrame, least: float, top: int, rule, contained: bool = False) -> DataFrame:
    """(id, other, score, place) from mine (id, key: a struct with name) and theirs (other, key). Distinct
    keys of both sides are dealt into blocks, each a row, and every two blocks meet in a Cartesian product, which
    reads the blocks where they lie: no pair is lost, and no name is written once for each block that it meets. A task
    reads a few blocks of right names in turn, so that what one has is the least that the next ones have to reach. Of rows
    with one key only the first ``top`` can have a place. ``contained``: names within each other are found by
    automata, and right names too long for a ratio of ``least`` are not compared."""
    place = lambda i, *by: F.row_number().over(Window.partitionBy(i).orderBy(*by))
    theirs = theirs.withColumnRenamed("key", "other_key").withColumn("_p", place("other_key", "other")).filter(F.col("_p") <= top).drop("_p")
    a, b = _numbered(mine.select("key").distinct()), _numbered(theirs.groupBy("other_key").agg(F.count("*").alias("held")))
    left, right, within = a.select("key.*", "nth", F.lit(0).cast("long").alias("sure")), b.select("other_key.*", "nth", "held"), None
    if contained and least <= CONTAINED:
        within = shared.stored(_contained(a.select("nth", "key.name"), b.select("nth", "other_key.name")), "within")
        sure = within.join(right.select(F.col("nth").alias("b_nth"), "held"), "b_nth").groupBy(F.col("a_nth").alias("nth")).agg(F.least(F.sum("held"), F.lit(top)).alias("sure"))
        left = left.drop("sure").join(sure, "nth", "left").withColumn("sure", F.coalesce("sure", F.lit(0)))
    longest = left.agg(F.max(F.length("name"))).first()[0] or 0
    if not rule and least > 0:
        right = right.filter(F.length("name") <= int(longest * (2 / least - 1)) + 1)
    few = 3 * int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks that meet, at least
    n, m = a.count(), right.count()
    parts = max(-(-n // NAMES_LEFT), min(-(-n // (AT_LEAST if m <= NAMES_RIGHT else AT_ONCE)), few)) or 1
    blocks = max(-(-m // NAMES_RIGHT), min(-(-m // FIRST_OF), -(-few // parts))) or 1
    groups = max(-(-blocks // IN_TURN), min(blocks, -(-few // parts)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of = None, None
        out = lambda: pa.RecordBatch.from_pydict({"a_nth": pa.array([of[i] for i, x in enumerate(best.found) for _ in x], pa.int64()), "b_nth": pa.array([j for x in best.found for _, j, _ in x], pa.int64()), "score": pa.array([s for x in best.found for s, _, _ in x], pa.float64())})
        for batch in batches:
            for x, y in zip(*batch.columns):
                x, y = (pd.DataFrame({f.name: z.values.field(f.name).to_numpy(zero_copy_only=False) for f in z.values.type}) for z in (x, y))
                if of != (now := x.nth.tolist()):
                    if best:
                        yield out()
                    best, of = _Best(x, least, top, rule, contained), now
                best.add(y)
        if best:
            yield out()

    met = _blocks(left, parts, "mine").crossJoin(_blocks(right, blocks, "theirs").coalesce(groups).hint("shuffle_replicate_nl"))
    scored = met.mapInArrow(score, "a_nth long, b_nth long, score double")
    if within is not None:
        scored = scored.unionByName(within.withColumn("score", F.lit(CONTAINED)))
    rows = theirs.join(b.select("other_key", F.col("nth").alias("b_nth")), "other_key").select("b_nth", "other")
    ranked = scored.join(rows, "b_nth").withColumn("place", place("a_nth", F.desc("score"), "other")).filter(F.col("place") <= top)
    return mine.join(a.withColumnRenamed("nth", "a_nth"), "key").join(ranked, "a_nth").select("id", "other", "score", "place")


def _contained(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(a_nth, b_nth): which of the distinct names (nth, name) of both sides are within each other."""
    out = []
    for texts, words, names in ((theirs, mine, ("b_nth", "a_nth")), (mine, theirs, ("a_nth", "b_nth"))):
        longest = texts.agg(F.max(F.length("name"))).first()[0] or 0
        found = terms.found_terms(texts.select(F.col("nth").alias("key"), F.col("name").alias("text")), words.filter(F.length("name") <= longest).select(F.col("nth").alias("term_id"), F.col("name").alias("term")))
        out.append(found.withColumnsRenamed({"key": names[0], "term_id": names[1]}).select("a_nth", "b_nth"))
    return out[0].unionByName(out[1]).distinct()


def _within(name: str, names: pd.Series) -> np.ndarray:
    return np.fromiter((x in name or name in x for x in names), dtype=bool, count=len(names))


def _contained_rule(one: pd.Series, many: pd.DataFrame) -> np.ndarray:
    return np.where(_within(one["name"], many.name), CONTAINED, np.nan)


def best_matches(left: DataFrame, right: DataFrame, least: float = 0.3, top: int = 5, contained: bool = True) -> DataFrame:
    """left (id, name) and right (other, name): the ``top`` most similar of all names that score at
    least ``least``, as (id, other, score, place). Containment scores 0.95 (with ``contained``), else the matching-blocks
    similarity of difflib counts; names are normalized, and those that are then empty have no match.

    Below a ratio of 2/3 two names need not share any two neighbouring letters, so no index of
    q-grams can say which pairs count: all are bounded by their letters, those left by their longest common
    subsequences, and those that may have a place are compared many at once (see ``likeness``). The time so
    grows with both sides."""
    named = lambda df, who: df.select(who, T.normalize(F.col("name")).alias("n")).filter("n <> ''").select(who, F.struct(F.col("n").alias("name")).alias("key"))
    return _matches(named(left, "id"), named(right, "other"), least, top, None, contained)


def mutual_best(matches: DataFrame) -> DataFrame:
    """Pairs that are each other's best match: an order-free assignment that uses each name once."""
    mine = matches.withColumn("a", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    both = mine.withColumn("b", F.row_number().over(Window.partitionBy("other").orderBy(F.desc("score"), "id")))
    return both.filter("a = 1 and b = 1").select("id", "other", "score")


#: Rows of a part of ``each_once`` about at most.
PART = 100_000


def each_once(matches: DataFrame) -> DataFrame:
    """(id, other, score): what results if one id after another (in ascending order) takes its best
    ``other`` that is still free (of equal scores, the least). Deferred acceptance, whose result no order of asking
    changes: ids are dealt into parts, mostly with those that want the same. In each round the ids of a part take
    turns among themselves, and what one of them has taken refuses all later ones of the part for good. Of
    those parts that have given one ``other`` away, the least id holds it and all later ids are refused by it, whether they
    have asked yet or not. Ends when none is refused between parts; chains of refusals within a part take no rounds."""
    spark = matches.sparkSession
    left = shared.stored(matches.select("id", "other", "score").dropDuplicates(["id", "other"]), "matches")
    label = left.groupBy("id").agg(F.min("other").alias("label"))
    for _ in range(3):  # the least ``other`` a few steps away
        near = left.join(label, "id").groupBy("other").agg(F.min("label").alias("label"))
        label = left.join(near, "other").groupBy("id").agg(F.min("label").alias("label"))
    labelled = left.join(label, "id")
    sizes = labelled.groupBy("label").agg(F.ceil(F.count("*") / PART).alias("of"))  # large ones are dealt into several parts
    left = shared.stored(labelled.join(sizes, "label").select("id", "other", "score", F.xxhash64("label", F.pmod(F.xxhash64("id"), "of")).alias("part")), "matches")
    kinds = left.schema.add("asks", "boolean")
    arrow = to_arrow_schema(kinds)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, now, got = set(), None, False
        for batch in batches:
            keep, asks = [], []
            for k, (one, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if one != now:
                    now, got = one, False
                if other not in taken:
                    keep.append(k)
                    asks.append(not got)
                    if not got:
                        mine, got = other, True
                        taken.add(mine)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, pa.array(asks, pa.bool_())], schema=arrow)

    n = left.count()
    while True:
        parts = max(-(-n // PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000))) or 1
        asked = shared.stored(left.repartition(parts, "part").sortWithinPartitions("id", F.desc("score"), "other").mapInArrow(turns, kinds), "asked")
        held = asked.filter("asks").groupBy("other").agg(F.min("id").alias("holder"))
        left = shared.stored(asked.join(held, "other", "left").filter("holder is null or id <= holder").select("id", "other", "score", "part"), "matches")
        before, n = asked.count(), left.count()
        if n == before:  # nobody was refused, so what each id asks for is its own
            return asked.filter("asks").select("id", "other", "score")


