"""SimHash fingerprints of word shingles and their links, found by pigeonring filtering.

A fingerprint of 64 bits is a ring of five boxes. Two fingerprints with at most four differing
bits have a box from which every chain of l consecutive boxes differs in at most 4l/5 bits: none
in the first box, at most 1 in two boxes, 2 in three, 3 in four. So the first box is equal, and of
the next box one half; these are the keys under which fingerprints meet. Where fingerprints are
many, or a key is crowded, keys are lengthened along the chain (one third of the third box, then
one quarter of the fourth box, is equal too). Under a key, pairs that break the budget of a chain
are pruned before the full count of differing bits, and a spanning forest of the links is kept
instead of all pairs. Equal fingerprints are one node; components are found on the links.

Handling of odd rows: null, empty and wordless texts have fingerprint zero and are linked like
any other; texts of fewer words than a shingle are one shingle; a null doc_id is a row of its own
and takes part by its fingerprint only; repeated rows share a component; no rows give no rows. Other
columns are carried as one struct or not at all, so their names clash with none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

LIMIT = 4
#: (first bit, bits) of each box of the ring; one box more than differing bits are allowed.
BOXES = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
ONE = np.uint64(1)
MASKS = np.array([((1 << n) - 1) << at for at, n in BOXES], dtype=np.uint64)
#: Rows under a key from which the key is lengthened, and keys that are so at most.
CROWD, CROWDED_KEYS = 2_000, 50_000
#: Up to so many rows under a key all pairs are compared; above, a forest is grown.
FEW = 3


def simhash(text: str | None, words: int = 4) -> int:
    """The fingerprint of a whole text: bits that over half of the shingles' XXH64 (seed 42) have."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(line, 42)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    stop = np.cumsum(size + 1) - 1
    h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip((stop - size)[: 1 - words].tolist(), stop[words - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(at: int, n: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND((1 << n) - 1)


def _parts(box: int, many: int) -> list[Column]:
    """A box cut into ``many`` runs of bits of nearly equal length."""
    at, n = BOXES[box % 5]
    cuts = [at + n * k // many for k in range(many + 1)]
    return [_bits(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes with (start, key): ``depth`` boxes of the chain from ``start`` go into the key, and the seed."""
    keys = []
    for start in range(5):
        chains = [[F.col("seed"), F.lit(start), _bits(*BOXES[start])]]
        for k in range(1, depth):
            chains = [[*c, F.lit(j), part] for c in chains for j, part in enumerate(_parts(start + k, k + 1))]
        keys += [F.struct(F.lit(start).cast("tinyint").alias("start"), F.xxhash64(*c).alias("key")) for c in chains]
    return nodes.withColumn("k", F.explode(F.array(*keys))).select("fp", "rep", "k.start", "k.key")


def _near(fp: np.ndarray, other, start: np.ndarray | int, limit: int) -> np.ndarray:
    """Which pairs are linked: chains of two, three and four boxes within budget, then all bits."""
    x = fp ^ other
    so_far = np.bitwise_count(x & MASKS[start]).astype(np.int64)
    ok = so_far == 0
    for k in range(1, 4):
        so_far += np.bitwise_count(x & MASKS[(start + k) % 5])
        ok &= so_far <= limit * (k + 1) // 5
    ok[ok] = np.bitwise_count(x[ok]) <= limit
    return ok


def _forest(fp: np.ndarray, rep: np.ndarray, start: int, limit: int, out: list) -> None:
    """Edges of a spanning forest of the links under one crowded key, each of them a link. A reached
    member is compared only with those not yet reached, so a dense group costs little more than its size."""
    while len(fp) > 1:
        todo = [(fp[0], rep[0])]
        fp, rep = fp[1:], rep[1:]
        while todo and len(fp):
            one, of = todo.pop()
            hit = _near(fp, one, start, limit)
            if hit.any():
                out.append((rep[hit], np.full(int(hit.sum()), of)))
                todo.extend(zip(fp[hit], rep[hit]))
                fp, rep = fp[~hit], rep[~hit]


def _links(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Edges between reps, from rows (key, start, fp, rep) in the order of key."""

    def edges(key, start, fp, rep) -> pa.RecordBatch | None:
        out: list = []
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(first, append=len(key))
        for a, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
            order = a + np.argsort(rep[a : a + n])  # least first: trees under different keys then share their edges
            _forest(fp[order], rep[order], int(start[a]), limit, out)
        few = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
        key, start, fp, rep = key[few], start[few], fp[few], rep[few]
        for d in range(1, FEW):
            i = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else key[:0]
            if not len(i):
                break
            i = i[_near(fp[i], fp[i + d], start[i], limit)]
            out.append((rep[i], rep[i + d]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["u", "v"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))  # from here on the key may go on in the next batch
        if last or (held and held[0][0][0] != now[0][0]):
            if last == 0:
                whole, held = held, [now]
            else:
                whole, held = [*held, [c[:last] for c in now]], [[c[last:] for c in now]]
            key, start, fp, rep = (np.concatenate(x) for x in zip(*whole))
            if (got := edges(key, start.astype(np.int64), fp.view(np.uint64), rep)) is not None:
                yield got
        else:
            held.append(now)
    if held:
        key, start, fp, rep = (np.concatenate(x) for x in zip(*held))
        if (got := edges(key, start.astype(np.int64), fp.view(np.uint64), rep)) is not None:
            yield got


def links(nodes: DataFrame, limit: int = LIMIT, depth: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the reps of ``nodes`` (distinct seed, fp with a rep) whose
    fingerprints of one seed differ in at most ``limit`` (4 at most) bits: enough for all
    components, never all pairs. depth: boxes of the chain that go into every key, 2 to 4; by
    default such that a key has some tens of fingerprints. Keys that are crowded all the same are
    lengthened, box by box, up to the whole ring."""
    if limit > LIMIT:
        raise ValueError(f"the ring of five boxes holds for {LIMIT} bits at most")
    spark = nodes.sparkSession
    if "seed" not in nodes.columns:
        nodes = nodes.withColumn("seed", F.lit(0))
    sizes = [r["count"] for r in nodes.groupBy("seed").count().collect()]
    if depth is None:
        depth = 2 if max(sizes, default=0) <= 1 << 23 else 3 if max(sizes) <= 1 << 27 else 4
    parts, now = [], _keys(nodes, depth)
    for d in range(depth, 5):
        # At most CROWDED_KEYS keys can be above the limit, so they may be broadcast.
        crowd = max(CROWD, keys_per_node(d) * sum(sizes) // CROWDED_KEYS)
        crowded = common.materialise(now.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"), "crowded")
        if crowded.isEmpty():
            break
        parts.append(now.join(F.broadcast(crowded), "key", "left_anti").select("key", "start", "fp", "rep"))
        deep = now.join(F.broadcast(crowded), "key", "left_semi").select("fp", "rep", "start", F.col("key").alias("above"))
        more = [F.struct(F.lit(j).alias("j"), F.element_at(F.array(*[_parts(s + d, d + 1)[j] for s in range(5)]), F.col("start") + 1).alias("b")) for j in range(d + 1)]
        now = deep.withColumn("k", F.explode(F.array(*more))).select(F.xxhash64("above", "k.j", "k.b").alias("key"), "start", "fp", "rep")
    parts.append(now.select("key", "start", "fp", "rep"))
    keys = reduce(DataFrame.unionByName, parts).repartition(common.tasks(spark), "key").sortWithinPartitions("key")
    return keys.mapInArrow(lambda batches: _links(batches, limit), "u long, v long")


def keys_per_node(depth: int) -> int:
    """Keys under which each fingerprint is filed."""
    return 5 * int(np.prod(range(2, depth + 1), initial=1))


def near_duplicates(docs: DataFrame, words: int = 4, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: component_id is the smallest doc_id
    among all documents reachable over links."""
    fps = common.materialise(fingerprints(docs, words), "fps")
    nodes = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    known = nodes.filter("rep is not null")
    found = components(links(known.select("fp", "rep"), limit))
    # Only fingerprints of several documents, or with links, need to be looked up again.
    groups = known.join(found.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 or component < rep").select("fp", F.coalesce("component", "rep").alias("component"))
    groups = common.materialise(groups, "groups")
    return fps.join(groups, "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


#: Byte -> a number whose eight bytes are its bits: adds up 64 counters in eight sums.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
SEEDS, PAIR = 8, 2
#: Differing bits of all eight fingerprints together up to which a link holds: 49 are expected at a
#: likeness of 0.8 (see ``near_copies``), and their standard deviation is 7.
LIMIT_ALL = 56
#: Nodes of a block of a large component (see ``_dealt``), blocks up to which it stays so small, and nodes
#: of a block at most, however large the component (two are held in memory, 72 bytes a node).
BLOCK, BLOCKS, MOST_BLOCK = 500, 64, 100_000


def prints(texts: pa.Array, k: int = PAIR, seeds: int = SEEDS) -> np.ndarray:
    """One row per text: SimHash fingerprints of its runs of ``k`` words under each seed."""
    out = np.zeros((len(texts), seeds), dtype=np.uint64)
    for a, b in hashing.chunks(texts):
        data, offsets = hashing.raw(texts[a:b])
        data = hashing.LOWER[data]
        start, end, owner = hashing.find_words(data, offsets)
        h, owner = hashing.shingles(hashing.span(hashing.prefix(data), start, end), owner, k)
        if not len(h):
            continue
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(first, append=len(h))
        blocks = -(-size // 255)  # a byte counts to 255
        lead = np.cumsum(blocks) - blocks
        at = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(lead, blocks))
        for s in range(seeds):
            bits = _SPREAD[hashing.mix(h ^ np.uint64(s * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(np.add.reduceat(bits, at, axis=0).view(np.uint8).astype(np.int64), lead, axis=0)
            out[a + owner[first], s] = np.packbits(2 * sums > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _dealt(inside: DataFrame) -> DataFrame:
    """(key, rep, fps): the nodes that are compared with each other under each key. A component of
    more than BLOCK nodes is cut into blocks, and every two blocks have a key, so that each pair of
    its nodes meets and no task has them all. Up to BLOCKS blocks they have BLOCK nodes; then there
    are as many until blocks of MOST_BLOCK nodes are full, and from there on more (copies of a
    node grow with blocks, so few large ones cost least; blocks bound the memory)."""
    many = inside.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * BLOCK).select("component", F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("n") / MOST_BLOCK)).cast("int").alias("blocks"))
    some = F.broadcast(common.materialise(many, "many"))
    mine, other = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.col("other")
    cut = inside.join(some, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter(other != mine)
    cut = cut.select(F.xxhash64("component", F.least(mine, other), F.greatest(mine, other)).alias("key"), "rep", "fps")
    return inside.join(some, "component", "left_anti").select(F.xxhash64("component").alias("key"), "rep", "fps").unionByName(cut)


def _held(batches: Iterable[pa.RecordBatch], limit: int, limit_all: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest under each key of the links that hold, from rows (key, rep, fps) in
    the order of key: at most ``limit`` bits differ under some seed and ``limit_all`` under all. A
    member counts as reached only by such a link, so nodes that are linked are always in one tree."""
    key, held = None, []

    def edges() -> Iterator[pa.RecordBatch]:
        rep, fps = (np.concatenate(x) for x in zip(*held))
        out: list = []
        while len(rep) > 1:
            todo, rep, fps = [(rep[0], fps[0])], rep[1:], fps[1:]
            while todo and len(rep):
                of, one = todo.pop()
                apart = np.bitwise_count(fps ^ one)
                hit = (apart.min(axis=1) <= limit) & (apart.sum(axis=1, dtype=np.int64) <= limit_all)
                if hit.any():
                    out.append((rep[hit], np.full(int(hit.sum()), of)))
                    todo.extend(zip(rep[hit], fps[hit]))
                    rep, fps = rep[~hit], fps[~hit]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(keys), -1)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        for a, b in zip(first, [*first[1:], len(keys)]):
            if keys[a] != key and held:
                yield from edges()
                held = []
            key = keys[a]
            held.append((reps[a:b], rows[a:b]))
    if held:
        yield from edges()


def near_copies(docs: DataFrame, k: int = PAIR, seeds: int = SEEDS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``, by several fingerprints of pairs of words.

    Texts whose five-word shingles are 0.8 alike differ in one word of 43. One fingerprint of
    shingles as long then differs in about 10 of 64 bits, which no selective key finds; one of
    word pairs differs in 6 (cosine 0.955), and of eight under different seeds at least one is
    within 4 bits in nine cases of ten. At a likeness of 0.9 it is all but certain, while
    unrelated texts are 20 bits or more apart. A link under one seed must then hold under all
    together: of 512 bits 49 differ at a likeness of 0.8, 63 at 0.7 and 80 at 0.6. Components are
    those of all pairs that are linked so, however large a group is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = prints(batch.column(1), k, seeds).view(np.int64)
            flat = pa.array(fps.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, seeds), pa.int32()), flat)], names=["doc_id", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fps = common.materialise(rows.mapInArrow(run, "doc_id long, fps array<long>").withColumn("node", F.xxhash64("fps")), "prints")
    nodes = common.materialise(fps.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("fps").alias("fps")), "nodes")
    each = nodes.select("rep", F.posexplode("fps").alias("seed", "fp"))
    heads = common.materialise(each.groupBy("seed", "fp").agg(F.min("rep").alias("rep"), F.count("*").alias("n")), "heads")
    equal = each.join(heads.filter("n > 1").withColumnRenamed("rep", "v"), ["seed", "fp"]).filter("rep <> v").select(F.col("rep").alias("u"), "v")
    # One-seed links only say which nodes can be in one component; those that hold are looked for within.
    maybe = components(links(heads.select("seed", "fp", "rep"), limit).unionByName(equal))
    inside = common.materialise(nodes.join(maybe.withColumnRenamed("node", "rep"), "rep").select("component", "rep", "fps"), "inside")
    dealt = _dealt(inside).repartition(common.tasks(docs.sparkSession), "key").sortWithinPartitions("key")
    found = components(dealt.mapInArrow(lambda batches: _held(batches, limit, LIMIT_ALL * seeds // SEEDS), "u long, v long"))
    groups = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 or component < rep").select("node", F.coalesce("component", "rep").alias("component"))
    groups = common.materialise(groups, "groups")
    return fps.join(groups, "node", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the least of their component. Rows that repeat
    doc_id and text are one document; a null doc_id always stays."""
    gone = common.materialise(copies.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), common.whole(docs).alias("row"))
    left = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    again = common.materialise(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 and id is not null").select(F.col("id").alias("again")), "again")
    repeated = left.join(again, F.col("id") == F.col("again"), "left_semi").withColumn("t", F.col("row.text").cast("string")).dropDuplicates(["id", "t"]).drop("t")
    return left.join(again, F.col("id") == F.col("again"), "left_anti").unionByName(repeated).select("row.*")


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_pigeonring": op4_simhash_pigeonring}
ORACLE_SQL: dict[str, str] = {}
