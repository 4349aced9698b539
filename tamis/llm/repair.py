"""Token-ID files compressed by Re-Pair grammars, with random access to documents and id ranges.

A file holds blocks of whole documents in ascending id. Each block has a grammar of its own: in
rounds, the most frequent adjacent pairs of symbols become nonterminals (never across the end of
a document), until no pair has LEAST_USES uses, from which a rule pays, or all 16-bit symbols are
used. The pairs of a round hold symbols of earlier rounds only. A block stores its rules, the
length to which each rule expands (so that any id range of a document is found without expanding
the rest) and for each document its id, first symbol and number of ids.

Text that spells a special token is that token's id, as in a plain call of the library.

Handling of odd rows: null texts are empty (end id alone); a null doc_id sorts first and is kept;
repeated rows and doc_ids stay, each with ids of its own, in order of text; no rows give a table of
no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoding import piece_table
from .files import filesystem, write_file

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIII")  # magic, documents, symbols, rules, rounds, first rule
WIDE = 1 << 16
END = WIDE - 1
#: Uses from which a rule (8 bytes with its length) is shorter than the symbols that it saves (2 bytes a use).
LEAST_USES = 5


def _distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


class _Pairs:
    """A sequence of symbols with the number of adjacent pairs by hashed pair, kept up to date as
    pairs are replaced. Counts by hash are never too small, so they tell which pairs may be frequent."""

    BITS = 20
    NONE = 1 << BITS  # the slot of pairs that go across the end of a document

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.seq = ids.astype(np.uint16)
        self.seq[ends] = END
        self.slot = np.full(len(self.seq), self.NONE, dtype=np.int32)
        self.slot[:-1] = self._slots(np.arange(len(self.seq) - 1))
        self.count = np.bincount(self.slot, minlength=self.NONE + 1).astype(np.int32)
        self.count[self.NONE] = 0

    def _slots(self, at: np.ndarray) -> np.ndarray:
        a, b = self.seq[at], self.seq[at + 1]
        out = ((a.astype(np.uint32) << np.uint32(16) | b) * np.uint32(0x9E3779B1) >> np.uint32(32 - self.BITS)).astype(np.int32)
        out[(a == END) | (b == END)] = self.NONE
        return out

    def _add(self, slots: np.ndarray, by: int) -> None:
        np.add.at(self.count, slots, np.int32(by))
        self.count[self.NONE] = 0

    def frequent(self, cut: int, within: np.ndarray | None = None) -> np.ndarray:
        """Places (of ``within``) whose pair may occur ``cut`` times."""
        if within is None:
            return np.flatnonzero(self.count.take(self.slot) >= cut)
        return within.compress(self.count.take(self.slot.take(within)) >= cut)

    def choose(self, at: np.ndarray, cut: int, least: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the candidate places: pairs that occur ``cut`` times, the most frequent first, and the
        places to replace with the number of their pair. Of places that overlap the one with the
        more frequent pair is taken; a pair that so keeps fewer than ``least`` uses is not chosen."""
        pair = self.seq.take(at).astype(np.uint64) << np.uint64(16) | self.seq.take(at + 1)
        code = np.sort(pair << np.uint64(32) | np.arange(len(at), dtype=np.uint64))
        key = (code >> np.uint64(32)).astype(np.uint32)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(start, append=len(key))
        some = np.flatnonzero(n >= cut)
        some = some[np.argsort(-n[some], kind="stable")][:room]
        rank = np.zeros(len(n), dtype=np.uint32)
        rank[some] = np.arange(len(some), 0, -1)  # 0: not chosen
        each = np.repeat(rank, n)
        by_place = np.empty(len(at), dtype=np.int32)
        by_place[code.astype(np.uint32)] = each
        at, each = at.compress(by_place > 0), by_place.compress(by_place > 0)
        near = at[1:] - at[:-1] == 1
        same = np.concatenate(([False], near & (each[1:] == each[:-1])))
        if same.any():  # of a run of one symbol every other place
            place = np.arange(len(each))
            each[(place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 1] = 0
        ok = each > 0
        ok[1:] &= ~near | (each[1:] > each[:-1])
        ok[:-1] &= ~near | (each[:-1] > each[1:])
        at, each = at.compress(ok), each.compress(ok)
        good = np.bincount(each, minlength=len(some) + 1) >= least
        good[0] = False
        number = np.cumsum(good[::-1])[::-1] - 1
        ok = good[each]
        return key[start[some]][good[:0:-1]], at.compress(ok), number[each.compress(ok)]

    def replace(self, at: np.ndarray, symbols: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Puts ``symbols`` in place of the pairs at ``at``. Returns the places, in the shorter
        sequence, of pairs that changed and of ``others`` that are left."""
        if len(at) > len(self.seq) // 32:
            flag = np.zeros(len(self.seq), dtype=bool)
            for d in (-1, 0, 1):
                flag[at + d] = True
            flag[-1] = False  # where place 0 was replaced; the last place has no pair
            self._add(self.slot.compress(flag), -1)
            self.seq[at] = symbols
            stay = np.ones(len(self.seq), dtype=bool)
            stay[at + 1] = False
            stay = np.flatnonzero(stay)
            flag[:] = False
            flag[at - 1] = True
            flag[at] = True
            flag[-1] = False
            changed = np.flatnonzero(flag.take(stay))
            flag[others] = True
            left = np.flatnonzero(flag.take(stay))
            self.seq, self.slot = self.seq.take(stay), self.slot.take(stay)
        else:  # few places: the same without looking at all others
            gone = at + 1
            around = np.stack((at - 1, at), 1).reshape(-1)  # ascending, as places to replace don't overlap
            around = around[int(around[0] < 0) :]
            self._add(self.slot[_distinct(np.concatenate((around, gone)))], -1)
            self.seq[at] = symbols
            self.seq, self.slot = np.delete(self.seq, gone), np.delete(self.slot, gone)
            place = np.searchsorted(gone, around)
            kept = gone.take(place, mode="clip") != around
            changed = (around - place)[kept]
            place = np.searchsorted(gone, others)
            kept = gone.take(place, mode="clip") != others
            left = _distinct(np.concatenate(((others - place)[kept], changed)))
        self.slot[changed] = self._slots(changed)
        self._add(self.slot[changed], 1)
        return left


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, least: int = LEAST_USES, step: int = 64) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Symbols of ``ids`` (whole documents, ``ends``: positions of their last ids), rules (left,
    right), and the number of rules after each round. Symbol END stands for a document's end.

    Pairs that occur ``cut`` times are replaced in rounds, then the cut is lowered, down to
    ``least``; there the rounds go on until no pair has so many uses (or no symbol is left)."""
    pairs = _Pairs(ids, ends)
    rules: list[np.ndarray] = []
    counts: list[int] = []
    number = first_rule
    cut = max(least, int(pairs.count.max(initial=0)) // step)
    at = pairs.frequent(cut)
    while number < END:
        chosen = np.zeros(0, np.uint32)
        if len(at):
            chosen, spots, which = pairs.choose(at, cut, least, END - number)
        if not len(chosen) and cut == least:
            break
        few = not len(chosen) or len(spots) < len(at) // 4
        if len(chosen):
            at = pairs.replace(spots, number + which, at)
            rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(END)], 1))
            number += len(chosen)
            counts.append(number - first_rule)
        if few and cut > least:
            cut = max(least, cut // step)
            at = pairs.frequent(cut)
        else:
            at = pairs.frequent(cut, at)
    return pairs.seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), counts


def expansion_lengths(rules: np.ndarray, counts: list[int], first_rule: int) -> np.ndarray:
    """Number of ids to which each rule expands."""
    out = np.ones(WIDE, dtype=np.uint32)
    done = 0
    for upto in counts:
        out[first_rule + done : first_rule + upto] = out[rules[done:upto]].sum(1)
        done = upto
    return out[first_rule : first_rule + done]


class Grammar:
    """The expansion of every symbol, one after the other, so that symbols expand by one gather."""

    def __init__(self, rules: np.ndarray, counts: list[int], first_rule: int):
        self.flat = np.arange(WIDE, dtype=np.uint16)
        self.start, self.size = np.arange(WIDE, dtype=np.int64), np.ones(WIDE, dtype=np.int64)
        done = 0
        for upto in counts:  # a round's rules hold symbols of earlier rounds only
            ids = self.expand(rules[done:upto].reshape(-1))
            size = self.size[rules[done:upto]].sum(1)
            here = slice(first_rule + done, first_rule + upto)
            self.start[here], self.size[here] = len(self.flat) + np.cumsum(size) - size, size
            self.flat = np.concatenate((self.flat, ids))
            done = upto

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of ``symbols``; the ends of documents stay END."""
        size = self.size[symbols]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.flat[np.repeat(self.start[symbols] - upto + size, size) + np.arange(total)]


def write_block(doc_ids: list, parts: list[bytes], end_id: int, vocabulary: int) -> tuple[bytes, int]:
    """One block of whole documents (``parts``: their ids as 16-bit numbers without the end id), and its number of ids."""
    sizes = np.array([len(p) // 2 + 1 for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes) - 1
    tail = struct.pack("<H", end_id)
    ids = np.frombuffer(b"".join(x for p in parts for x in (p, tail)), dtype="<u2")
    symbols, rules, counts = compress(ids, ends, vocabulary)
    lengths = expansion_lengths(rules, counts, vocabulary)
    starts = np.concatenate(([0], np.flatnonzero(symbols == END)[:-1] + 1)).astype("<u4")
    body = [
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype="u1").tobytes(), starts.tobytes(), sizes.astype("<u4").tobytes(),
        np.array(counts, dtype="<u4").tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(),
    ]
    head = _HEAD.pack(MAGIC, len(parts), len(symbols), len(rules), len(counts), vocabulary)
    return head + struct.pack("<IQ", end_id, sum(map(len, body))) + b"".join(body), int(sizes.sum())


class Block:
    """A block read back. Documents are addressed by their place in the block."""

    def __init__(self, raw: bytes):
        magic, docs, symbols, rules, rounds, self.first_rule = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.end_id, _ = struct.unpack_from("<IQ", raw, _HEAD.size)
        at = _HEAD.size + 12
        out = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", docs), ("<u4", rounds), ("<u2", 2 * rules), ("<u4", rules), ("<u2", symbols)):
            out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += np.dtype(kind).itemsize * n
        self.doc_ids, nulls, self.starts, self.sizes, counts, pairs, self.lengths, self.symbols = out
        self.nulls, self.rules = nulls.astype(bool), pairs.reshape(-1, 2)
        self.grammar = Grammar(self.rules, counts.tolist(), self.first_rule)

    def all_ids(self) -> np.ndarray:
        ids = self.grammar.expand(self.symbols)
        ids[ids == END] = self.end_id
        return ids

    def ids(self, place: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of one document; only the symbols that cover the range are expanded."""
        last = self.starts[place + 1] if place + 1 < len(self.starts) else len(self.symbols)
        own = self.symbols[self.starts[place] : last]
        size = int(self.sizes[place])
        stop = size if stop is None else min(stop, size)
        if start >= stop:
            return np.zeros(0, dtype=np.uint16)
        each = np.ones(WIDE, dtype=np.int64)
        each[self.first_rule : self.first_rule + len(self.lengths)] = self.lengths
        upto = np.cumsum(each[own])
        a, b = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left") + 1
        skip = start - (int(upto[a - 1]) if a else 0)
        ids = self.grammar.expand(own[a:b])
        ids[ids == END] = self.end_id
        return ids[skip : skip + stop - start]


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 0, block_ids: int = 1 << 19) -> None:
    """Encodes the texts of ``docs`` (doc_id, text) and writes them in ascending doc_id under ``path``.

    One exchange by ranges of doc_id; each task streams its range into one file, a block at a
    time. The table ``path/manifest`` lists the files with their numbers of documents and ids.
    """

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = piece_table(vocabulary_path)
        vocabulary = table.words.tok.get_vocab_size()
        total = {"docs": 0, "ids": 0}
        name = f"{path}/part-{part:06d}.rpg"

        def blocks() -> Iterator[bytes]:
            ids, parts, size = [], [], 0
            for batch in batches:
                for doc, raw in zip(batch.column(0).to_pylist(), table.encode(text or "" for text in batch.column(1).to_pylist())):
                    ids.append(doc)
                    parts.append(raw)
                    size += len(raw) // 2 + 1
                    if size >= block_ids:
                        yield finish(ids, parts)
                        ids, parts, size = [], [], 0
            if parts:
                yield finish(ids, parts)

        def finish(ids: list, parts: list) -> bytes:
            block, n = write_block(ids, parts, end_id, vocabulary)
            total["docs"] += len(ids)
            total["ids"] += n
            return struct.pack("<Q", len(block)) + block

        def write(out) -> None:
            for block in blocks():
                out.write(block)

        write_file(name, write)
        if total["docs"]:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [total["docs"]], "n_ids": [total["ids"]]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange(common.tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(store, "part long, file string, n_docs long, n_ids long").write.parquet(f"{path}/manifest")


def _blocks(name: str) -> Iterator[Block]:
    files, at = filesystem(name)
    with files.open_input_stream(at) as source:
        while head := source.read(8):
            yield Block(source.read(struct.unpack("<Q", head)[0]))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document in the files under ``path``: doc_id, start (ids of all documents
    before it), n_tokens, and ids (32-bit little-endian binary), or with ``digest`` their crc32.
    The prefix sum runs over the manifest, which has one row per file."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for block in _blocks(name):
                    raw = block.all_ids().astype("<u4").tobytes()
                    bounds = np.concatenate(([0], np.cumsum(block.sizes.astype(np.int64))))
                    cuts = [memoryview(raw)[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    last = pa.array([zlib.crc32(c) for c in cuts], pa.int64()) if digest else pa.array([c.tobytes() for c in cuts], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.nulls), pa.array(start + bounds[:-1]), pa.array(block.sizes.astype(np.int64)), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                    start += int(bounds[-1])

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = spark.read.schema("part long, file string, n_docs long, n_ids long").parquet(f"{path}/manifest").select("file", before.cast("long").alias("start"))
    return files.repartition(common.tasks(spark), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    write_token_files(common.load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, digest=True)


QUERIES = {"op1_repair_token_files": op1_repair_token_files}
ORACLE_SQL: dict[str, str] = {}
