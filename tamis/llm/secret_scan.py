"""Secret scans: base patterns, and a battery of randomness tests with false-discovery control.

Base spans are matches of three patterns (assignments to names of secrets, access keys, long runs
of hexadecimal digits). The battery looks at every other maximal run of token characters. The least
alphabet that holds all its characters is its inferred encoding. Of a run of n symbols, three tests
must not reject a random draw from that alphabet: chi-squared uniformity (from the number of pairs of
equal symbols, by Wilson and Hilferty), runs above and below the middle of the alphabet (Wald and
Wolfowitz), and correlation of neighbours. Short or common words pass such tests too, so a run must also
be far more even than ordinary text of its very length: with the frequencies q that the alphabet's
characters have in the whole corpus, the number of equal pairs of ordinary text has mean
C(n,2) S2 and variance C(n,2) (S2 - S2^2 + 2 (n - 2) (S3 - S2^2)), Sk being the sum of the k-th powers of q, and
gives each run a p-value. Benjamini and Hochberg's rule at FALSE_SHARE, within each encoding and
length class, says which of them count. p-values are rounded up to a grid for that, so that the
rule needs only a histogram of bounded size; it is exact on the rounded values.

All of it is DataFrame functions: two readings of the texts (characters are counted, then runs are
found where they stand), no exchange of texts, aggregations that combine before the exchange. The
driver has a count for each character of the alphabets, and a limit for each encoding and length class.

Handling of odd rows: a null or empty text has no span; positions count code points; a null doc_id and
repeated rows are rows of their own; equal runs are judged alike; a text of any length is scanned
whole; no rows give no rows; other columns are not looked at, so any names may be there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query's contract: the patterns, and how long a match's decisive part must be.
ASSIGN = r"""(?i)(?=[pstaPSTA])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"  # as AKIA[A-Z0-9]+ of 18 and more: a run has one leftmost AKIA
HEX = r"[0-9a-f]{16,}+"
KINDS = ["assign", "access", "hex", "random"]
#: A run of token characters that is long enough to be judged.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: (name, pattern of the whole run, how it is folded, alphabet), least alphabet first.
ENCODINGS = [
    ("decimal", "[0-9]+", None, _DIGITS),
    ("hex", "[0-9a-f]+|[0-9A-F]+", "lower", _DIGITS + _LOWER[:6]),
    ("letters", "[a-z]+|[A-Z]+", "lower", _LOWER),
    ("base32", "[A-Z2-7]+", None, _UPPER + _DIGITS[2:8]),
    ("base36", "[a-z0-9]+|[A-Z0-9]+", "lower", _DIGITS + _LOWER),
    ("mixed letters", "[A-Za-z]+", None, _UPPER + _LOWER),
    ("base62", "[A-Za-z0-9]+", None, _DIGITS + _UPPER + _LOWER),
    ("base64", ".*", "base64", _UPPER + _LOWER + _DIGITS + "+/"),
]
#: Level of the battery as a whole, share of false discoveries, steps of the grid of -log p, and its end.
BATTERY_LEVEL, FALSE_SHARE, GRID, MOST_BUCKET = 0.001, 0.05, 64, 64 * 600
#: Matches whose places are summed up together (places are running sums; see ``_placed``).
RUN = 256


def _placed(text: Column, pattern: str, found: Column, kept=None) -> Column:
    """(start, end, match) of the ``found`` matches of a pattern, from the lengths of what lies
    between them. kept: a test of a match. Sums run over blocks of RUN matches, so that a text of very
    many matches costs little more than their number."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    size = F.size(found)
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), size)
    each = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("match"), (kept(m) if kept else F.lit(True)).alias("kept")))

    def one(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        span = F.array(F.struct(start.alias("start"), (start + m["n"]).alias("end"), m["match"].alias("match")))
        return F.struct((start + m["n"]).alias("at"), F.when(m["kept"], F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    def block(state: Column, ms: Column) -> Column:
        inner = F.aggregate(ms, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint,match:string>>>").alias("out"))

    def in_blocks(e: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.size(e) - 1) / RUN)), lambda b: F.slice(e, (b * RUN + 1).cast("int"), F.lit(RUN)))
        return F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"]))

    # A lambda's parameter is evaluated once; what it takes from outside, for each element.
    return F.when(size > 0, F.transform(F.array(each), in_blocks)[0]).otherwise(none)


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, runs): arrays of (start, end, match); runs are those of token
    characters that no base span overlaps."""
    all_of = lambda p: F.regexp_extract_all("_t", F.lit(p), F.lit(0))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    out = out.select("*", all_of(ASSIGN).alias("_a"), all_of(TOKEN).alias("_r"))
    within = lambda p: F.when(F.size("_r") > 0, all_of(p)).otherwise(F.array().cast("array<string>"))  # noqa: E731  (their matches lie in such runs)
    out = out.select("*", within(ACCESS).alias("_k"), within(HEX).alias("_h"))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    places = {"assign": (ASSIGN, "_a", long_enough), "access": (ACCESS, "_k", None), "hex": (HEX, "_h", None), "runs": (TOKEN, "_r", None)}
    out = out.select("doc_id", *[_placed(F.col("_t"), p, F.col(c), kept).alias(name) for name, (p, c, kept) in places.items()])
    # A match of ACCESS or HEX lies within one run, so the run itself tells of it.
    free = F.filter("runs", lambda r: ~F.rlike(r["match"], F.lit(f"{ACCESS}|{HEX}")) & ~F.exists("assign", lambda a: (a["start"] < r["end"]) & (r["start"] < a["end"])))
    return out.withColumn("runs", free)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (rational approximation with exp(-z^2 / 2))."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-a * a / 2) / 2.5066282746310002
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), i)


def frequencies(docs: DataFrame) -> list[tuple[float, float]]:
    """For each encoding the sums of squares and of cubes of its characters' shares in all texts."""
    # Three characters at a time: a third of the rows, and still few distinct ones.
    parts = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("(?s).{1,3}"), F.lit(0))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    chars = parts.select(F.explode(F.split("p", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    n = {r.c: r.n for r in chars.filter(F.rlike("c", F.lit("^[A-Za-z0-9+/_-]$"))).collect()}  # 66 characters
    out = []
    for _, _, fold, alphabet in ENCODINGS:
        held = dict.fromkeys(alphabet, 0)
        for c, k in n.items():
            c = c.lower() if fold == "lower" else {"-": "+", "_": "/"}.get(c, c) if fold == "base64" else c
            if c in held:
                held[c] += k
        total = sum(held.values()) + len(held)  # each character is taken to have been seen once more
        shares = [(k + 1) / total for k in held.values()]
        out.append((sum(q**2 for q in shares), sum(q**3 for q in shares)))
    return out


def _judged(run: Column, sums: list[tuple[float, float]]) -> Column:
    """(start, end, stratum, bucket, random) of a run: its class for the false-discovery rule, its
    p-value against ordinary text as a bucket of -log p, and whether the battery lets it pass."""
    bare = F.rtrim(run["match"], F.lit("="))
    which = reduce(lambda a, i: a.when(F.rlike(bare, F.lit(f"^({ENCODINGS[i][1]})$")), i + 1), range(1, len(ENCODINGS)), F.when(F.rlike(bare, F.lit(f"^{ENCODINGS[0][1]}$")), 1))
    step1 = F.struct(run["start"].alias("start"), run["end"].alias("end"), bare.alias("x"), which.alias("e"), F.length(bare).cast("double").alias("n"))

    def folded(r: Column) -> Column:
        x = F.when(_pick([f == "lower" for _, _, f, _ in ENCODINGS], r["e"]), F.lower(r["x"])).when(r["e"] == len(ENCODINGS), F.translate(r["x"], "-_", "+/")).otherwise(r["x"])
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["e"].alias("e"), r["n"].alias("n"), x.alias("x"), _pick([a for *_, a in ENCODINGS], r["e"]).alias("alphabet"), _pick([float(len(a)) for *_, a in ENCODINGS], r["e"]).alias("k"))

    def counted(r: Column) -> Column:
        often = F.transform(F.filter(F.split(r["alphabet"], ""), lambda c: c != ""), lambda c: (F.length(r["x"]) - F.length(F.replace(r["x"], c, F.lit("")))).cast("double"))
        pairs = F.aggregate(often, F.lit(0.0), lambda s, c: s + c * (c - 1) / 2)
        symbols = F.transform(F.filter(F.split(r["x"], ""), lambda c: c != ""), lambda c: (F.call_function("instr", r["alphabet"], c) - 1) - (r["k"] - 1) / 2)  # about their mean
        return F.struct(*[r[f].alias(f) for f in ("start", "end", "e", "n", "k")], pairs.alias("pairs"), symbols.alias("s"))

    def measured(r: Column) -> Column:
        high = F.aggregate(r["s"], F.lit(0.0), lambda a, s: a + (s > 0).cast("double"))
        first = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("products"))
        walk = F.aggregate(r["s"], first, lambda a, s: F.struct(s.alias("last"), (a["changes"] + F.coalesce(((s > 0) != (a["last"] > 0)).cast("double"), F.lit(0.0))).alias("changes"), (a["products"] + F.coalesce(s * a["last"], F.lit(0.0))).alias("products")))
        return F.struct(*[r[f].alias(f) for f in ("start", "end", "e", "n", "k", "pairs")], high.alias("high"), walk.alias("walk"))

    def tested(r: Column) -> Column:
        n, k = r["n"], r["k"]
        chi2, free = k / n * (n + 2 * r["pairs"]) - n, k - 1
        z_even = (F.pow(F.greatest(chi2, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        both = 2 * r["high"] * (n - r["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (r["walk"]["changes"] - both / n) / F.sqrt(spread)).otherwise(F.lit(99.0))  # all on one side
        z_next = r["walk"]["products"] / (F.sqrt(n - 1) * (k * k - 1) / 12)
        least = reduce(F.least, [2 * _upper_tail(F.abs(z)) for z in (z_even, z_runs, z_next)])
        s2, s3, of = _pick([a for a, _ in sums], r["e"]), _pick([b for _, b in sums], r["e"]), n * (n - 1) / 2
        z_plain = (of * s2 - r["pairs"]) / F.sqrt(of * (s2 - s2 * s2 + 2 * (n - 2) * F.greatest(s3 - s2 * s2, F.lit(0.0))))
        bucket = F.least(F.floor(-F.log(F.greatest(_upper_tail(z_plain), F.lit(1e-280))) * GRID), F.lit(MOST_BUCKET)).cast("int")
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), (r["e"] * 100 + F.floor(F.log2(n)).cast("int")).alias("stratum"), bucket.alias("bucket"), (least * 3 >= BATTERY_LEVEL).alias("random"))

    return reduce(F.transform, (folded, counted, measured, tested), F.array(step1))[0]


def limits(judged: DataFrame) -> dict[int, int]:
    """For each stratum of ``judged`` (runs) the bucket from which on Benjamini and Hochberg's rule counts a run."""
    per = judged.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    upto = per.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("bucket")))).withColumn("all", F.sum("n").over(w))
    passed = upto.filter(F.exp(-F.col("bucket") / GRID) * F.col("all") <= FALSE_SHARE * F.col("upto"))
    return {r.stratum: r.least for r in passed.groupBy("stratum").agg(F.min("bucket").alias("least")).collect()}  # eight encodings by lengths' logarithms


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of (start, end) in each row's text."""
    sums = frequencies(docs)
    judged = found_in(docs).withColumn("runs", F.transform("runs", lambda r: _judged(r, sums)))
    judged = common.materialise(judged.select("doc_id", *[F.col(k).cast("array<struct<start:bigint,end:bigint,match:string>>").alias(k) for k in KINDS[:3]], "runs"), "runs")
    least = limits(judged)
    table = F.create_map(*[F.lit(x) for pair in (least or {-1: 0}).items() for x in pair])
    random = F.filter("runs", lambda r: r["random"] & F.coalesce(r["bucket"] >= F.element_at(table, r["stratum"]), F.lit(False)))
    place = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return judged.select("doc_id", *[place(k).alias(k) for k in KINDS[:3]], place(random).alias("random"))


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans of the ``kinds``, by start, then kind, joined by commas."""
    def numbered(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), s["end"].alias("end")))

    every = F.concat(*map(numbered, kinds))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", _pick(KINDS, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(common.load(spark, sf_dir, "documents"))
    base = F.sha2(joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base, joined(KINDS).alias("spans"))


QUERIES = {"op13_randomness_battery": op13_randomness_battery}
ORACLE_SQL: dict[str, str] = {}
