"""Fill-in-middle transformation by an event scan with one automaton.

One Aho-Corasick automaton holds the sentinels and the ASCII characters at which the class of the
text changes for the unit in which it is cut: the line feed for lines, blanks for words, none for
characters. A text is scanned once. Between two such events units are counted by arithmetic (each
code point of a gap for characters; the gap and what ends it are one line or one word), so the sparse
events are all that is kept of a text: they give the number of units, the place of a unit of any
rank, and whether a sentinel occurs.

A text of n units is cut after two ranks drawn from a hash of seed and doc_id, and its parts are put
in another order behind sentinels (prefix-suffix-middle or suffix-prefix-middle). Texts that are
empty or hold a sentinel stay as they are, so ``restored`` gives back every text exactly. Documents
are transformed where they are read, without an exchange.

Handling of odd rows: a null text is empty, and a form of its own hash like any other; a null doc_id
is hashed as no digits; repeated rows are cut alike, ties in rank (both cuts equal) give an empty
middle; texts of any length are cut whole; no rows give no rows. All columns of the documents are
kept in ``row``, so their names clash with none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters at which a unit can end.
CLASS_CHANGES = {"char": "", "word": " \t\n\x0b\x0c\r", "line": "\n"}


def automaton(unit: str):
    """Finds class-changing characters (value 0) and sentinels (value 1) in one scan."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in CLASS_CHANGES[unit]:
        found.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, 1)
    found.make_automaton()
    return found


class Units:
    """The units of a text, from its events: ``n`` of them, the first ``k`` of which end at ``at(k)``."""

    def __init__(self, text: str, unit: str, machine):
        self.marked, events = False, []
        for end, sentinel in machine.iter(text):
            if sentinel:
                self.marked = True
            else:
                events.append(end + 1)
        self.ends = None
        if unit == "char":
            self.n = len(text)
            return
        ends = np.array(events, dtype=np.int64)
        if unit == "word" and len(ends):  # a word ends with the last of the blanks after it
            ends = ends[np.append(ends[1:] != ends[:-1] + 1, True)]
        if len(text) and (not len(ends) or ends[-1] < len(text)):
            ends = np.append(ends, len(text))
        self.ends, self.n = ends, len(ends)

    def at(self, k: int) -> int:
        return k if self.ends is None or k == 0 else int(self.ends[k - 1])


def cut(text: str, doc_id: int | None, units: Units, seed: int, rate: int, spm: int) -> tuple[str, str, int | None, int | None]:
    """(form, output, prefix_chars, middle_chars) of one text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or units.marked or h3 % 100 >= rate:
        return "plain", text, None, None
    first, last = sorted((units.at(h1 % (units.n + 1)), units.at(h2 % (units.n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", first, last - first
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", first, last - first


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for each row of ``docs``: ``row`` has all its
    columns, n counts units (``unit``: char, word or line), ``rate`` per cent are transformed, ``spm`` per
    cent of these to suffix-prefix-middle."""
    if unit not in CLASS_CHANGES:
        raise ValueError(f"unit must be one of {sorted(CLASS_CHANGES)}")
    row = common.whole(docs).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kinds = rows.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit)
        for batch in batches:
            for a, b in hashing.chunks(batch.column(2), 1 << 22):
                part = batch.slice(a, b - a)
                out = []
                for doc_id, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    units = Units(text, unit, machine)
                    out.append((units.n, *cut(text, doc_id, units, seed, rate, spm)))
                n, form, output, first, middle = zip(*out) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=[f.name for f in kinds])

    return rows.mapInArrow(run, kinds)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form: no part holds a sentinel, so each splits it once."""
    part = lambda x, by, i: F.split_part(x, F.lit(by), F.lit(i))
    psm, spm = part(output, PREFIX, 2), part(output, SUFFIX, 2)
    from_psm = F.concat(part(psm, SUFFIX, 1), part(output, MIDDLE, 2), part(part(psm, SUFFIX, 2), MIDDLE, 1))
    from_spm = F.concat(part(part(spm, PREFIX, 2), MIDDLE, 1), part(output, MIDDLE, 2), part(spm, PREFIX, 1))
    return F.when(form == "psm", from_psm).when(form == "spm", from_spm).otherwise(output)


def op12_aho_corasick_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    digests = [sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op12_aho_corasick_fim": op12_aho_corasick_fim}
ORACLE_SQL = {
    "op12_aho_corasick_fim": r"""with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
 u as (select *, string_split(text, chr(10)) as pieces, ('0x' || substr(x, 1, 8))::ubigint as h1, ('0x' || substr(x, 9, 8))::ubigint as h2, ('0x' || substr(x, 25, 8))::ubigint as h4 from t),
 v as (select *, case when text = '' then 0 when pieces[-1] = '' then len(pieces) - 1 else len(pieces) end as n from u),
 w as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') as plain from v),
 y as (select *, case when a = 0 then 0 when a = len(pieces) then length(text) else length(array_to_string(pieces[1:a], chr(10))) + 1 end as p, case when b = 0 then 0 when b = len(pieces) then length(text) else length(array_to_string(pieces[1:b], chr(10))) + 1 end as q from w),
 z as (select *, substr(text, 1, p) as prefix, substr(text, p + 1, q - p) as middle, substr(text, q + 1) as suffix, case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from y)
 select doc_id, cast(n as bigint) as n, form, case when not plain then cast(p as bigint) end as prefix_chars, case when not plain then cast(q - p as bigint) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from z"""
}
