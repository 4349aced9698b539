"""Binding records to files: by key, by author, year and title, by similar titles, by chosen candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators import likeness, matching, shared


def doi_variants(doi: Column) -> Column:
    """A normalized DOI as it may be printed: as it is, without slashes, with blanks for slashes and dashes."""
    return F.array(doi, F.replace(doi, F.lit("/"), F.lit("")), F.translate(doi, "/-", "  "))


def doi_found(doi: Column, text: Column) -> Column:
    """Whether a normalized, non-empty DOI is printed in a text; false if either is absent."""
    low = F.lower(text)
    return F.coalesce((doi != "") & F.exists(doi_variants(doi), lambda v: F.contains(low, v)), F.lit(False))


def acceptance(candidates: DataFrame, least: float = 0.35) -> DataFrame:
    """Adds doi_ok, n_tokens, title_overlap and accepted. candidates: doi, title, first_text (of the
    file's first pages). Either the DOI is there, or enough tokens of the title are."""
    out = candidates.withColumn("_n", T.normalize(F.coalesce("first_text", F.lit("")))).withColumn("_tk", T.title_tokens(F.coalesce("title", F.lit(""))))
    share = F.when((F.size("_tk") == 0) | (F.col("_n") == ""), F.lit(0.0)).otherwise(T.overlap(F.col("_tk"), F.col("_n")))
    out = out.withColumn("doi_ok", doi_found(T.normalize_doi(F.coalesce("doi", F.lit(""))), F.col("first_text"))).withColumn("n_tokens", F.size("_tk")).withColumn("title_overlap", share)
    return out.withColumn("accepted", F.col("doi_ok") | ((F.col("n_tokens") > 0) & (F.col("title_overlap") >= least))).drop("_n", "_tk")


def first_author(author: Column) -> Column:
    """The last word of the first author's name before a comma or semicolon, in lower case."""
    name = F.trim(F.split_part(F.split_part(F.lower(author), F.lit(","), F.lit(1)), F.lit(";"), F.lit(1)))
    return F.element_at(F.split(name, r"\s+"), -1)


def _substrings(c: Column, least: int, most: int) -> Column:
    """All distinct substrings of ``least`` to ``most`` characters of a short text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.substring(c, i, n)))))


def file_map(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file, how): papers (key, author, year, title) and files (file, a name with its suffix).

    A file of the key's name wins; else the first file by name whose name has the first author's
    name, the year and one of the first five words of the title's first thirty characters. Several
    papers may get one file. Names meet papers by the whole author and the year, both of which are
    parts of the name, so no pair is lost and not all are compared."""
    names = files.select("file", F.lower(F.regexp_replace("file", r"\.[^.]*$", "")).alias("stem"))
    exact = papers.select("key", F.lower("key").alias("stem")).join(names, "stem").groupBy("key").agg(F.min("file").alias("file")).withColumn("how", F.lit("key"))
    title = F.left(F.lower(F.col("title")), F.lit(30))
    rest = papers.join(exact, "key", "left_anti").select("key", first_author(F.col("author")).alias("author"), F.col("year").cast("string").alias("year"), F.slice(F.filter(F.split(title, r"\s+"), lambda w: w != ""), 1, 5).alias("words"))
    rest = rest.filter("author <> '' and year <> ''")
    by = _with_authors(names, rest)
    # The first file for each author, year and word: papers of one author and year share them.
    asked = rest.withColumn("word", F.explode(F.array_distinct("words")))
    found = asked.select("author", "year", "word").distinct().join(by, ["author", "year"]).filter(F.contains("stem", F.col("word"))).groupBy("author", "year", "word").agg(F.min("file").alias("file"))
    hits = asked.join(found, ["author", "year", "word"])
    return exact.unionByName(hits.groupBy("key").agg(F.min("file").alias("file")).withColumn("how", F.lit("author_year_title")))


def map_problems(mapping: DataFrame, papers: DataFrame) -> DataFrame:
    """(key, problem): keys of a map (key, file, sha256) that no paper has, and files that several keys share."""
    unknown = mapping.join(papers.select("key"), "key", "left_anti").select("key", F.lit("unknown key").alias("problem"))
    shared = mapping.groupBy("sha256").agg(F.countDistinct("key").alias("n")).filter("n > 1 and sha256 is not null").select("sha256")
    return unknown.unionByName(mapping.join(shared, "sha256").select("key", F.lit("file shared").alias("problem")))


def name_title(file: Column) -> Column:
    """The title in a file name ``author - year - title.pdf``; empty without that form."""
    return F.trim(F.regexp_extract(file, r"^.*?\s*-\s*\d{4}\s*-\s*(.+)\.pdf$", 1))


def plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


#: Likeness of names of one author and year; the least likeness of two authors of one year, from which
#: the names' score is ALIKE and a tenth of it.
SAME_WORK, ALIKE_AUTHORS, ALIKE = 0.98, 0.6, 0.85


def bare(c: Column) -> Column:
    """A name without ``.pdf`` in lower case, of which only letters, digits and ideographs are left."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.pdf$", ""), "[^a-z0-9\u4e00-\u9fff]", "")


def _work_rule(one: pd.Series, many: pd.DataFrame) -> np.ndarray:
    """Scores that the whole names' letters don't decide."""
    out = matching._contained_rule(one, many)
    if one["author"] and one["year"]:
        same = np.flatnonzero(np.isnan(out) & (many.year == one["year"]).to_numpy() & (many.author != "").to_numpy())
        if len(same):
            authors = many.author.iloc[same].tolist()
            alike = likeness.Names([one["author"]], authors).ratios(np.zeros(len(same), np.int64), np.arange(len(same)), np.zeros(len(same)))
            equal = np.array([a == one["author"] for a in authors])
            out[same] = np.where(equal, SAME_WORK, np.where(alike >= ALIKE_AUTHORS - 1e-12, ALIKE + 0.1 * alike, np.nan))
    return out


def name_scores(keys: DataFrame, files: DataFrame, least: float = 0.3, top: int = 5) -> DataFrame:
    """(id, other, score, place): keys (id, name ``author_year``) with the ``top`` most similar file names
    (other, name ``author - year - title.pdf``) of ``least`` or more. One name within the other scores 0.95;
    equal author and year 0.98; equal year and similar authors 0.85 and more; else the likeness of the whole names.
    Author and year are columns, parsed once from each name; of several authors the first counts."""
    parts = r"^(.*)_([^_]*)$", r"^(.*?)\s*-\s*([0-9]{4})"
    first = lambda c: F.split_part(F.regexp_replace(c, "[\u548c&\u7b49]", "\n"), F.lit("\n"), F.lit(1))
    cut = lambda df, who, p, of: df.select(who, F.struct(bare(F.col("name")).alias("name"), bare(of(F.regexp_extract("name", p, 1))).alias("author"), F.trim(F.regexp_extract("name", p, 2)).alias("year")).alias("key")).filter("key.name <> ''")
    return matching._matches(cut(keys, "id", parts[0], lambda c: c), cut(files, "other", parts[1], first), least, top, _work_rule)


def title_map(papers: DataFrame, files: DataFrame, least: float = 0.8, top: int = 32) -> DataFrame:
    """(key, file, score): what results if one paper (key, title) after another, in ascending order, takes its
    best file that is still free: one whose name's title is the same, else the most similar of
    ``least`` or more (of 80 characters); of equal scores the least file.

    Each paper is first given its ``top`` files. Papers up to the first that has found all of its files taken and
    may have more are settled; the others go on with the files that are left and eight times as many
    places, until nobody finds any. So many equal titles don't make all pairs."""
    mine = shared.stored(papers.select("key", plain_title(F.col("title")).alias("a")).filter("a <> ''").withColumn("n", F.left("a", F.lit(80))), "papers")
    theirs = shared.stored(files.select("file", plain_title(name_title(F.col("file"))).alias("b")).filter("b <> ''").withColumn("m", F.left("b", F.lit(80))), "files")
    done, alike, names = None, None, NAMES_OF
    while True:
        a = mine if done is None else mine.join(done, F.col("key") == F.col("id"), "left_anti")
        b = theirs if done is None else theirs.join(done, F.col("file") == F.col("other"), "left_anti")
        if alike is None:
            alike = shared.stored(_similar(a, b, least, names), "alike")
        found = shared.stored(_candidates(a, b, alike, top), "candidates")
        if done is not None and found.isEmpty():
            return done.select(F.col("id").alias("key"), F.col("other").alias("file"), F.least("score", F.lit(1.0)).alias("score"))
        got = shared.stored(matching.each_once(found.filter("live")), "got")
        cut = alike.groupBy("n").agg(F.count("*").alias("k")).filter(F.col("k") >= names).select("n", F.lit(True).alias("cut"))
        more = found.groupBy("id").agg(F.count("*").alias("k")).join(mine.select(F.col("key").alias("id"), "n"), "id").join(cut, "n", "left")
        open_ = more.filter((F.col("k") >= top) | F.col("cut")).join(got, "id", "left_anti").agg(F.min_by("cut", "id").alias("cut"), F.min("id").alias("open"))
        first = open_.first()  # one row: the first paper that may find more, and whether it needs more similar titles
        if first.open is not None:
            got = got.filter(F.col("id") < F.lit(first.open))
        done = shared.stored(got.select("id", "other", "score") if done is None else done.unionByName(got.select("id", "other", "score")), "bound")
        top *= 8
        if first.cut:
            names, alike = 8 * names, None


#: Similar titles that are looked for of each title at first.
NAMES_OF = 32


def _similar(mine: DataFrame, theirs: DataFrame, least: float, top: int) -> DataFrame:
    """(n, m, score): the ``top`` most similar of the distinct titles ``m`` of each distinct title ``n``."""
    found = matching.best_matches(mine.select(F.col("n").alias("id"), F.col("n").alias("name")).distinct(), theirs.select(F.col("m").alias("other"), F.col("m").alias("name")).distinct(), least, top, contained=False)
    return found.select(F.col("id").alias("n"), F.col("other").alias("m"), "score")


def _candidates(mine: DataFrame, theirs: DataFrame, alike: DataFrame, top: int) -> DataFrame:
    """(id, other, score, live): the ``top`` files of each paper; a file of the same title scores 2. Papers of one
    title want the same files in the same order, and each that is before another takes one of those: so
    the k-th of them can only get its k-th file or a later one, and the edges before are not live."""
    nth = lambda by: theirs.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("file"))).filter(F.col("k") <= top).drop("k")
    same = mine.join(nth("b"), F.col("a") == F.col("b")).select(F.col("key").alias("id"), F.col("file").alias("other"), F.lit(2.0).alias("score"))
    near = mine.select("key", "n").join(alike, "n").join(nth("m").select("file", "m"), "m").select(F.col("key").alias("id"), F.col("file").alias("other"), "score")
    turn = mine.select(F.col("key").alias("id"), F.row_number().over(Window.partitionBy("a").orderBy("key")).alias("turn"))
    every = same.unionByName(near).groupBy("id", "other").agg(F.max("score").alias("score"))
    return every.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).filter(F.col("k") <= top).join(turn, "id").select("id", "other", "score", (F.col("k") >= F.col("turn")).alias("live"))


def _with_authors(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """names (file, stem) for each of the ``wanted`` (author, year) that are part of the stem. Authors are found
    by equality, among the stem's parts of just the lengths that authors have."""
    lengths = [r.n for r in wanted.select(F.length("author").alias("n")).distinct().collect()]  # as many as lengths of a name
    parts = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, lengths or [1])), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("stem") - n + 1, F.lit(1))), lambda i: F.substring("stem", i, n)))))
    held = names.withColumn("author", F.explode(parts)).join(wanted.select("author").distinct(), "author")
    digits = F.filter(_substrings(F.col("stem"), 1, 8), lambda x: F.rlike(x, F.lit(r"^[0-9]+$")))
    return held.withColumn("year", F.explode(digits)).join(wanted.select("author", "year").distinct(), ["author", "year"])


def author_year_map(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file): the first file by name that has the author of ``author_year`` and the year. keys: key, year."""
    author = F.lower(F.element_at(F.split(F.regexp_extract("key", r"^(.*)_", 1), "[, ]"), 1))
    mine = keys.select("key", F.col("year").cast("string").alias("year"), author.alias("author")).filter("author <> '' and year <> ''")
    by = _with_authors(files.select("file", F.lower("file").alias("stem")), mine)
    return mine.join(by, ["author", "year"]).groupBy("key").agg(F.min("file").alias("file"))


def apply_choices(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, file, status): choices (key, choice: a candidate's number, 0 for none) on candidates (key, place, file)."""
    known = candidates.select("key").distinct().withColumn("known", F.lit(True))
    out = choices.join(known, "key", "left").join(candidates.withColumnRenamed("place", "choice"), ["key", "choice"], "left")
    status = F.when(F.col("choice") == 0, "skipped").when(F.col("known").isNull(), "no candidates").when(F.col("file").isNull(), "no such number").otherwise("applied")
    return out.select("key", F.when(F.col("choice") != 0, F.col("file")).alias("file"), status.alias("status"))
