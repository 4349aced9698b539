"""Many terms against many texts: an Aho-Corasick automaton, built from a table of terms, run once over each text.

Terms are read to the driver at most MOST_TERMS at a time, an amount that a worker holds as an
automaton; of more, the texts are scanned once for each such part, so a list of any length is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T

MOST_TERMS = 500_000
#: Words whose tokens a worker remembers.
MOST_WORDS = 1 << 20


def automaton(terms: list[str]):
    """Gives the place of each of the distinct, non-empty ``terms`` where it occurs."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, x in enumerate(terms):
        machine.add_word(x, i)
    machine.make_automaton()
    return machine


def _parts(terms: DataFrame, by: str) -> list[DataFrame]:
    """``terms`` in parts of about MOST_TERMS rows; rows of one value of ``by`` stay together."""
    n = -(-terms.count() // MOST_TERMS)
    return [terms.filter(F.pmod(F.xxhash64(by), F.lit(n)) == i) if n > 1 else terms for i in range(n)]


def found_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term_id) for each of the ``terms`` (term_id, term) that is part of a text (key, text); one row
    for a pair, however often it occurs. Null or empty texts and terms occur in nothing."""
    spark = texts.sparkSession
    named = terms.filter("term <> ''").select("term_id", "term").distinct()
    key = texts.schema["key"]
    kinds = texts.select("key").schema.add("term_id", named.schema["term_id"].dataType)
    plain = texts.select("key", F.col("text").cast("string").alias("text"))
    out = [spark.createDataFrame([], kinds)]
    for part in _parts(named, "term"):
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        kind = rows.schema.field("term_id").type
        held: dict[str, list] = {}
        for i, term in zip(rows["term_id"].to_pylist(), rows["term"].to_pylist()):
            held.setdefault(term, []).append(i)
        known = spark.sparkContext.broadcast((list(held), list(held.values())))

        def run(batches: Iterable[pa.RecordBatch], known=known, kind=kind) -> Iterator[pa.RecordBatch]:
            words, ids = known.value
            machine = automaton(words)
            for batch in batches:
                owner, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = {k for _, k in machine.iter(text)} if text else ()
                    for k in sorted(hits):
                        owner += [i] * len(ids[k])
                        found += ids[k]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(found, kind)], names=[key.name, "term_id"])

        out.append(plain.mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, out)


def quotes_in(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the normalized quote (item_id, text) is part of the normalized text (doc_id, text)."""
    texts = docs.select(F.col("doc_id").alias("key"), T.normalize(F.col("text")).alias("text"))
    found = found_terms(texts, quotes.select(F.col("item_id").alias("term_id"), T.normalize(F.col("text")).alias("term")))
    return found.select(F.col("term_id").alias("item_id"), F.col("key").alias("doc_id")).distinct()


def overlapping(docs: DataFrame, quotes: DataFrame, least: float = 0.72) -> DataFrame:
    """(item_id, doc_id, hits, tokens) where at least ``least`` of a quote's long tokens (repeats counted)
    are part of the document's normalized text. docs: doc_id, text; quotes: item_id, text.

    A token has no blank, so it lies within one word of the text: each distinct word is scanned for
    tokens once in a worker, and a text's tokens are those of its words."""
    spark = docs.sparkSession
    tokens = quotes.select(F.col("item_id").cast("long").alias("item_id"), F.explode(T.long_tokens(T.normalize(F.col("text")))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("m"))
    texts = docs.select("doc_id", T.normalize(F.col("text")).alias("norm"))
    kinds = spark.createDataFrame([], "item_id long").schema.add(docs.schema["doc_id"]).add("hits", "long").add("tokens", "long")
    out = [spark.createDataFrame([], kinds)]
    for part in _parts(tokens, "item_id"):
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        words = rows["token"].combine_chunks().dictionary_encode()
        items, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
        order = np.argsort(words.indices.to_numpy(), kind="stable")
        start = np.searchsorted(words.indices.to_numpy()[order], np.arange(len(words.dictionary) + 1))
        many = rows["m"].to_numpy()
        known = spark.sparkContext.broadcast((words.dictionary.to_pylist(), start, item[order], many[order], items, np.bincount(item, weights=many)))

        def run(batches: Iterable[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            vocabulary, start, item, many, items, total = known.value
            machine, seen = automaton(vocabulary), {}
            for batch in batches:
                owner, which, hits = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    held: set[int] = set()
                    for word in set(text.split(" ")) if text else ():
                        if len(word) >= 4:
                            own = seen.get(word)
                            if own is None:
                                if len(seen) >= MOST_WORDS:
                                    seen.clear()
                                own = seen[word] = tuple({k for _, k in machine.iter(word)})
                            held.update(own)
                    if held:
                        at = np.concatenate([np.arange(start[k], start[k + 1]) for k in held])
                        n = np.bincount(item[at], weights=many[at], minlength=len(items))
                        enough = np.flatnonzero((n > 0) & (n >= least * total))
                        owner += [i] * len(enough)
                        which.append(enough)
                        hits.append(n[enough])
                at, n = (np.concatenate(x) if x else np.zeros(0) for x in (which, hits))
                at = at.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items[at]), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(n.astype(np.int64)), pa.array(total[at].astype(np.int64))], names=["item_id", "doc_id", "hits", "tokens"])

        out.append(texts.mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, out)


def first_rule(texts: DataFrame, patterns: list[str], keywords: DataFrame) -> DataFrame:
    """(key, rule_id, reason) of the first of the ``patterns`` (numbered from 1), else the first of the
    ``keywords`` (term_id, term: numbered after them) that a text (key, text), in lower case, holds. Texts
    without a rule are left out; of rows that repeat a key the first rule of any counts."""
    low = texts.select("key", F.lower("text").alias("text"))
    hit: Column | None = None
    for i, p in enumerate(patterns, 1):
        found = F.struct(F.lit(i).cast("long").alias("rule_id"), F.lit(f"pattern: {p}").alias("reason"))
        hit = F.when(F.rlike("text", F.lit(p)), found) if hit is None else hit.when(F.rlike("text", F.lit(p)), found)
    by_pattern = low.select("key", hit.alias("r")).filter("r is not null") if patterns else None
    words = found_terms(low, keywords.select("term_id", F.lower("term").alias("term"))).join(keywords.select("term_id", "term"), "term_id")
    by_word = words.select("key", F.struct((F.col("term_id") + len(patterns)).cast("long").alias("rule_id"), F.concat(F.lit("keyword: "), "term").alias("reason")).alias("r"))
    every = by_word if by_pattern is None else by_pattern.unionByName(by_word)
    return every.groupBy("key").agg(F.min("r").alias("r")).select("key", "r.rule_id", "r.reason")
