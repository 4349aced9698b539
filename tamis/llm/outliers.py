"""Quality rules: robust multivariate outliers by minimum covariance determinants (MCD).

Each document has counts of its words, symbols, repeated lines and repeated passages. A few plain
rules fail the worst; of the others, transformed ratios of the counts form a vector. For each
language and source, the MCD mean and covariance are those of the h = 75 % of its vectors that lie
closest together. From each of several starts (medians with quantile ranges; the same with the
correlations of the coordinates' hyperbolic tangents, and of their spatial signs) concentration
steps take the h rows nearest by Mahalanobis distance and estimate anew, until no determinant falls
by a thousandth any more; of the starts the one with the least determinant counts. A document is rejected where its
squared distance is above CUT.

Everything is DataFrame functions. The corpus is read once, into a table of counts; each step is
two aggregations of it, for all groups and starts, with sums (about the last mean) that combine
before the exchange, whatever the size of a group. The h rows are found by a histogram of
distances, so ties share a fate and repeated runs agree. Coordinates are bounded, so a histogram
has some thousands of buckets a group at most. Determinants fall at every step but the last, so the
steps end; more than MOST_STEPS raise.

FLOORS are added to the covariance as least deviations of each coordinate: where three quarters of
the documents have no symbol at all, the covariance alone would be singular and any symbol an
outlier. Languages and sources with fewer than LEAST_ROWS rows are pooled by language, and then
over all languages; pools below LEAST_ROWS are not judged, and kept.

Handling of odd rows: a null or wordless text has counts of zero and fails the base rules; null lang
and source are values of their own; repeated rows are judged each; no rows give no rows; columns
other than doc_id, text, lang and source are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, MOST_REPEATED_PERCENT, SPAN = 20, 30, 8
#: Least deviation of each coordinate, the share h, its consistency factor (chi-square, 4 degrees:
#: 0.75 / P(chi2(6) < 5.385)), rows of a group at least, steps from which the search is broken off, and the cut (chi-square's
#: 1 - 3e-7 quantile for 4 degrees).
FLOORS = (0.1, 0.05, 0.15, 0.15)
SHARE, CONSISTENCY, LEAST_ROWS, MOST_STEPS, CUT = 0.75, 1.485, 100, 100, 36.0
#: By how much a step has to lower a log determinant to be followed by another.
LEAST_FALL = 1e-3
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]


def counts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*keep, text.alias("_t")).withColumn("_b", F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")))
    out = out.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", common.SPACE)))
    out = out.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    n = F.size("_w")
    out = out.select(
        *[out[c] for c in out.columns if c not in ("_t", "_b", "_w", "_l")],
        n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # Hash of each window of words; only texts in which one occurs again go on to find where.
    windows = F.when(F.size("_h") < SPAN, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_h") - SPAN), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(SPAN)])))
    out = out.withColumn("_v", windows).drop("_h")
    sorted_ = F.sort_array(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_v")) < F.size("_v"), sorted_).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_v")
    same = lambda i, d: F.coalesce(F.get("_s", i + d)["h"] == F.get("_s", i)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.transform("_s", lambda s, i: F.struct(s["i"].alias("i"), (same(i, -1) | same(i, 1)).alias("again"))), lambda s: s["again"]), lambda s: s["i"]))
    out = out.withColumn("_p", places).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(SPAN), F.coalesce(F.get("_p", i + 1) - p, F.lit(SPAN)))), F.lit(0), lambda a, b: a + b)
    out = out.withColumn("n_repeat_words", covered.cast("long")).drop("_p")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def vector() -> list[Column]:
    """The coordinates: the logarithm of the mean word length, and the arcsines of the roots of the
    shares of symbols, repeated lines and repeated words (shares so have like variance at any level)."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0))))
    size = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    return [x.alias(n) for x, n in zip((size, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")), X)]


def _own() -> Column:
    # xxhash64 skips nulls; the marks keep a null lang apart from a null source.
    return F.xxhash64(F.lit(1), F.col("lang").isNull(), "lang", F.col("source").isNull(), "source")


def _groups(rows: DataFrame) -> DataFrame:
    """(_own, g): for each language and source the number of the group by whose estimate its rows
    are judged, null if there is none."""
    lang, all_ = F.xxhash64(F.lit(2), F.col("lang").isNull(), "lang"), F.xxhash64(F.lit(3))
    n = common.materialise(rows.groupBy(_own().alias("_own"), lang.alias("pool")).agg(F.count("*").alias("n")), "own")
    n = n.withColumn("g", F.when(F.col("n") >= LEAST_ROWS, F.col("_own")))
    for name, pool in (("pool", F.col("pool")), ("all", all_)):
        n = n.withColumn("_p", pool)
        left = n.filter("g is null").groupBy("_p").agg(F.sum("n").alias("_left")).filter(F.col("_left") >= LEAST_ROWS)
        n = common.materialise(n.join(left, "_p", "left").withColumn("g", F.coalesce("g", F.when(F.col("_left").isNotNull(), F.col("_p")))).drop("_p", "_left"), name)
    return n.select("_own", "g")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.withColumn("_k", _own()).join(groups, F.col("_k") == F.col("_own"), "left").drop("_k", "_own")


def _upto(histogram: DataFrame, by: list[str], share: float, name: str) -> DataFrame:
    """The least bucket up to which ``share`` of each group's rows are. histogram: by, bucket, n."""
    w = Window.partitionBy(*by)
    upto = histogram.withColumn("c", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    return upto.filter(F.col("c") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(F.min("bucket").alias(name))


def _bucket(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * 256).cast("int")


def distance(columns: dict[str, Column] | None = None) -> Column:
    """Squared Mahalanobis distance from columns m0.. (mean) and l00, l10, l11.. (Cholesky factor)."""
    z: list[Column] = []
    for i in range(P):
        part = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            part = part - F.col(f"l{i}{j}") * z[j]
        z.append(part / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in z])


LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
MODEL = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in LOWER], "logdet"]


def _factored(rows: DataFrame, keep: list[str], cov: dict[tuple[int, int], Column]) -> DataFrame:
    """``keep`` and m0.. of ``rows`` with the Cholesky factor and log determinant of ``cov``."""
    for i, j in LOWER:
        c = cov[i, j]
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # The floors keep pivots positive; rounding may not push them below a hundredth of that.
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOORS[i] ** 2 / 100))) if i == j else c / F.col(f"l{j}{j}"))
    return rows.withColumn("logdet", reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(P)])).select(*keep, *MODEL)


def _estimate(near: DataFrame) -> DataFrame:
    """Mean and factor of the rows ``near`` by g and start; they hold y0.., the coordinates less the
    last mean m0.., so that sums of squares don't cancel."""
    sums = near.groupBy("g", "start").agg(F.count("*").alias("n"), *[F.first(f"m{i}").alias(f"o{i}") for i in range(P)], *[F.avg(f"y{i}").alias(f"a{i}") for i in range(P)], *[F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"s{i}{j}") for i, j in LOWER])
    sums = sums.select("*", *[(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(P)])
    cov = {}
    for i, j in LOWER:
        c = F.col(f"s{i}{j}") / F.col("n") - F.col(f"a{i}") * F.col(f"a{j}")
        cov[i, j] = F.greatest(c, F.lit(0.0)) * CONSISTENCY + FLOORS[i] ** 2 if i == j else c * CONSISTENCY
    return _factored(sums, ["g", "start"], cov)


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, m0.., l00.., logdet): where the concentration steps of each group begin."""
    # Medians, and half the range between the 16 % and 84 % quantiles, on a grid of 1/200.
    grid = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * 200).cast("int").alias("bucket")) for i, x in enumerate(X)])).alias("e"))
    grid = common.materialise(grid.select("g", "e.*").groupBy("g", "dim", "bucket").agg(F.count("*").alias("n")), "grid")
    q = reduce(lambda a, b: a.join(b, ["g", "dim"]), [_upto(grid, ["g", "dim"], s, f"q{int(100 * s)}") for s in (0.16, 0.5, 0.84)])
    here = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    scale = F.sqrt(((F.col("q84") - F.col("q16")) / 400) ** 2)
    middle = common.materialise(q.groupBy("g").agg(*[here(i, (F.col("q50") + 0.5) / 200).alias(f"m{i}") for i in range(P)], *[here(i, F.sqrt(scale**2 + FLOORS[i] ** 2)).alias(f"d{i}") for i in range(P)]), "middle")
    z = rows.join(middle, "g").select("g", *[((F.col(X[i]) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)])
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z{i}") ** 2 for i in range(P)]))
    sign = lambda i: F.when(length > 0, F.col(f"z{i}") / length).otherwise(0.0)
    kinds = {"t": lambda i: F.tanh(F.col(f"z{i}")), "u": sign}
    sums = z.groupBy("g").agg(*[F.sum(f(i) * f(j)).alias(f"{k}{i}{j}") for k, f in kinds.items() for i, j in LOWER])
    both = common.materialise(middle.join(sums, "g"), "signs")
    out = []
    for start, k in enumerate((None, "t", "u")):
        cov = {}
        for i, j in LOWER:
            if i == j:
                cov[i, j] = F.col(f"d{i}") ** 2
            elif k is None:
                cov[i, j] = F.lit(0.0)
            else:  # a correlation below one, so that the factor exists
                r = F.coalesce(F.try_divide(F.col(f"{k}{i}{j}"), F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}"))), F.lit(0.0))
                cov[i, j] = 0.9 * r * F.col(f"d{i}") * F.col(f"d{j}")
        out.append(_factored(both.withColumn("start", F.lit(start)), ["g", "start"], cov))
    return common.materialise(reduce(DataFrame.unionByName, out).withColumn("logdet", F.lit(float("inf"))), "starts")


def estimates(rows: DataFrame) -> DataFrame:
    """MCD estimate of each group g of ``rows`` (g, x0..)."""
    done, now = [], _starts(rows)
    for _ in range(MOST_STEPS):
        far = rows.join(now, "g").select("g", "start", *[f"m{i}" for i in range(P)], *[(F.col(x) - F.col(f"m{i}")).alias(f"y{i}") for i, x in enumerate(X)], _bucket(distance()).alias("bucket"))
        limit = _upto(far.groupBy("g", "start", "bucket").agg(F.count("*").alias("n")), ["g", "start"], SHARE, "most")
        new = _estimate(far.join(limit, ["g", "start"]).filter("bucket <= most"))
        fell = F.col("new.logdet") < F.col("old.logdet") - LEAST_FALL
        both = new.alias("new").join(now.alias("old"), ["g", "start"])
        both = common.materialise(both.select("g", "start", *[F.when(fell, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in MODEL], fell.alias("fell")), "mcd")
        done.append(both.filter("not fell").drop("fell"))  # these have settled
        now = both.filter("fell").drop("fell")
        if now.isEmpty():
            break
    else:
        raise RuntimeError("concentration steps did not settle")
    every = reduce(DataFrame.unionByName, done)
    best = every.groupBy("g").agg(F.min_by(F.struct(*MODEL), F.struct("logdet", "start")).alias("b"))
    return common.materialise(best.select("g", "b.*"), "estimates")


def fit(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and their estimates, from the rows of ``counts`` (with lang and source)."""
    rows = base.filter("not base_failed").select("lang", "source", *vector())
    groups = _groups(rows)
    vectors = _grouped(rows, groups).filter("g is not null").select("g", *X)
    return groups, estimates(common.materialise(vectors, "vectors"))


def judge(base: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``base`` (of ``counts``, with lang and source) with distance2 (null: not judged) and kept."""
    groups, found = model
    out = _grouped(base.select("*", *vector()), groups).join(found, "g", "left")
    d2 = F.when(~F.col("base_failed"), distance())
    return out.select(*base.columns, d2.alias("distance2"), (~F.col("base_failed") & F.coalesce(d2 <= CUT, F.lit(True))).alias("kept"))


def _where() -> list[Column]:
    return [F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]


def verdicts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with its counts, distance2 and kept."""
    base = common.materialise(counts(docs, [*keep, *_where()]), "counts", "zstd")
    return judge(base, fit(base)).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Counted once: the rows wait with
    their counts in the shared folder until the verdicts are known, and are never exchanged."""
    row = common.whole(docs).alias("_row")
    return verdicts(docs, [row]).filter("kept").select("_row.*")


def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(common.load(spark, sf_dir, "documents"), [F.col("doc_id").cast("long").alias("doc_id")])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


QUERIES = {"op5_mcd_outliers": op5_mcd_outliers}
ORACLE_SQL: dict[str, str] = {}
