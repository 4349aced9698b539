"""Prefix trie of conversations: the Cartesian tree over the LCP array of sorted conversations.

A conversation is its turns in order, each turn the first 16 bytes of the SHA-256 of its role and
text; the turns' digests one after the other are its key, so conversations in the order of their keys
have those with a common beginning side by side, whatever the order of the texts. Keys are exchanged
once, by ranges of (key, conv_id), so a conversation that many repeat is shared by several ranges.
Each range is a block; equal neighbours in it become one row, with its LCP, the number of turns that
it shares with the row before.

A node of the trie with several children is a maximal interval of rows between two LCPs below its
depth: the nearest smaller values on either side (ANSV), a node of the Cartesian tree over the LCP
array in which equal values are merged. Blocks find them in parallel with a stack. What a block can't
decide alone it gets from the minima of the other blocks: for each block the strictly falling minima
seen from its two ends, with the sums and least members of what lies between them, are folded over the
blocks once to the right and once to the left. A row then gives the nodes that begin with it: those
deeper than its LCP. Depths between a node of the Cartesian tree and its parent are expanded, with the
same interval; members, leaves and bytes are differences of running sums, and least members minima of
intervals.

Bounded: a block has about BLOCK_TURNS turns (one conversation, if that alone is longer, is one row);
the driver folds a row for each block, whose falling minima are no more than the turns of the
conversation at its edge. The ids that end at one node are hashed in order: blocks join theirs in parallel, and
only those of a conversation that goes on over blocks are streamed by one task, a string for each block.

Handling of odd rows: a null turn is first; rows with equal turn are in the order of role, then of the
digest; repeated rows are turns of their own; a null or empty role or text is empty; rows without conv_id
belong to no conversation and are left out; conversations without turns are members of the root;
texts of any length are hashed whole; no rows give no nodes; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WIDTH = 16
#: Turns of a block, about, and those that one conversation may take from its base at most (plus one).
BLOCK_TURNS, HEADS, EVERY = 1 << 20, 9, 5
EMPTY = hashlib.sha256(b"").hexdigest()


def _taken(conv: Column) -> Column:
    """How many turns of its base a rebuilt conversation begins with."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * WIDTH)))
    conv = F.col("conv_id").cast("long")
    return conversations.select(conv.alias("conv_id"), (conv - conv % EVERY).alias("base"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("bytes"), text.alias("text")).filter("conv_id is not null")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): each conversation with the first turns of its base (conv_id less
    conv_id % 5; as many as the crc32 of its number says) in place of its own, as digests and bytes
    of its turns. Conversations of one base are dealt together, so this is one exchange of digests."""
    spark = conversations.sparkSession
    dealt = _turns(conversations).drop("text").repartition(common.tasks(spark), "base")
    turn = F.struct("turn", "role", "digest", "bytes")
    own = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    both = own.withColumn("head", head).withColumn("h", _taken(F.col("conv_id")))
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    turns = F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest))
    out = both.select("conv_id", turns.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), ""))
    return out.select("conv_id", key.alias("key"), F.transform("t", lambda t: t["bytes"]).alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WIDTH


#: A row for each distinct conversation of a block. Of the first and the last the key and the joined
#: ids are kept, and with the last a summary of the block.
FALLING = "array<struct<value:int,cn:bigint,w:bigint,leaves:bigint,least:bigint,k:bigint>>"
ROWS = f"block int, at long, len int, n long, least long, lcp int, before long, sizes array<int>, total long, sha string, ids string, key binary, rows long, cn long, w long, leaves long, all_least long, head_least long, falling {FALLING}, rising {FALLING}"


def _summary(lcp: np.ndarray, length: np.ndarray, n: np.ndarray, least: np.ndarray, total: np.ndarray, before: np.ndarray) -> dict:
    """Sums and minima of a block whose first LCP isn't known yet (nor whether its last row is a leaf)."""
    own = total - before
    own[0] = total[0]
    leaf = np.append(lcp[1:] < length[:-1], False)
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (n, n * total - own, leaf.astype(np.int64))]
    out = {"rows": len(n), "cn": sums[0][-1], "w": sums[1][-1], "leaves": sums[2][-1], "all_least": least.min()}
    inner = lcp[1:]
    low = np.minimum.accumulate(inner)
    at = 1 + np.flatnonzero(np.append(True, low[1:] < low[:-1])) if len(inner) else np.zeros(0, np.int64)
    cuts = np.concatenate(([0], at))
    parts = np.minimum.reduceat(least, cuts)
    equal = np.add.reduceat(np.append(0, inner == low), cuts) if len(inner) else np.zeros(1, np.int64)
    out["head_least"] = parts[0]
    out["falling"] = [{"value": lcp[i], "cn": sums[0][i], "w": sums[1][i], "leaves": sums[2][i], "least": m, "k": k} for i, m, k in zip(at, parts[1:], equal[1:])]
    back = np.minimum.accumulate(inner[::-1])[::-1]  # the least from here to the end
    behind = np.minimum.accumulate(least[::-1])[::-1]
    out["rising"] = [{"value": inner[i], "least": behind[i + 1]} for i in np.flatnonzero(np.append(back[:-1] < back[1:], True))] if len(inner) else []
    plain = lambda x: [{k: int(v) for k, v in e.items()} for e in x] if isinstance(x, list) else int(x)
    return {k: plain(v) for k, v in out.items()}


def _blocks(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a block (see ROWS) from (block, conv_id, key, sizes) in the order of key and conv_id."""
    facts: list[tuple] = []
    out: list[dict] = []
    key = held = None  # of the run that is open

    def close(last: bool) -> None:
        row, ids = held
        text = ",".join(map(str, ids))
        row |= {"n": len(ids), "least": ids[0], "sha": hashlib.sha256(text.encode()).hexdigest()}
        facts.append((row["lcp"] if facts else 0, row["len"], row["n"], row["least"], row["total"], row["before"] or 0))
        if last or not row["at"]:
            row |= {"ids": text, "key": key}
        if last:
            row |= _summary(*(np.array(x, dtype=np.int64) for x in zip(*facts)))
        out.append(row)

    for batch in batches:
        for block, conv, now, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if now == key:
                held[1].append(conv)
                continue
            shared = shared_turns(key, now) if key is not None else None
            if key is not None:
                close(False)
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
            total, start = sum(sizes), shared or 0
            row = {"block": block, "at": len(facts), "len": len(sizes), "lcp": shared, "before": None if shared is None else sum(sizes[:start]), "sizes": sizes[start:], "total": total}
            key, held = now, (row, [conv])
    if key is not None:
        close(True)
        yield pa.RecordBatch.from_pylist(out, schema)


def _folded(blocks: list) -> tuple[list[dict], list[tuple[int, int, int]]]:
    """What each block has to know of the others, and (block, at, group) of the rows of conversations
    that go on over blocks. blocks: (block, summary row, key, sizes and len of its first row)."""
    out: list[dict] = []
    base, groups = [0, 0, 0], []
    for i, (s, first) in enumerate(blocks):
        lcp0 = shared_turns(blocks[i - 1][0].key, first.key) if i else -1
        own = {"block": s.block, "lcp0": lcp0, "p0": sum(first.sizes[: max(lcp0, 0)]), "base": list(base)}
        again = i > 0 and lcp0 == first.len
        if again:
            before = blocks[i - 1][0]
            if not groups or groups[-1][:2] != (before.block, before.at):
                groups.append((before.block, before.at, len(groups)))
            groups.append((s.block, 0, groups[-1][2]))
        leaf = i + 1 == len(blocks) or shared_turns(s.key, blocks[i + 1][1].key) < s.len
        base = [base[0] + s.cn, base[1] + s.w + own["p0"], base[2] + s.leaves + leaf]
        own["again"] = again
        out.append(own)

    # From the right: for each block the falling minima after it, nearest (deepest) last.
    stack = [{"value": -1, "sums": base, "least": (1 << 63) - 1, "k": 0}]
    for (s, _), own in zip(reversed(blocks), reversed(out)):
        own["right"] = [dict(e) for e in stack]
        b = own["base"]
        edge = {"value": own["lcp0"], "sums": b, "least": s.head_least, "k": int(not own["again"])}
        for e in [edge, *({"value": e.value, "sums": [b[0] + e.cn, b[1] + e.w + own["p0"], b[2] + e.leaves], "least": e.least, "k": e.k} for e in s.falling)][::-1]:
            while stack[-1]["value"] > e["value"]:
                e["least"] = min(e["least"], stack.pop()["least"])
            if stack[-1]["value"] == e["value"]:
                top = stack.pop()
                e |= {"least": min(e["least"], top["least"]), "k": e["k"] + top["k"]}
            stack.append(e)

    # From the left: the falling minima before it, with the least member from there to its edge.
    stack = []
    for (s, _), own in zip(blocks, out):
        own["left"] = [dict(e) for e in stack]
        rising = [{"value": e.value, "least": e.least} for e in s.rising]
        if not rising or own["lcp0"] < rising[0]["value"]:
            rising.insert(0, {"value": own["lcp0"], "least": s.all_least})
        stack = [{"value": e["value"], "least": min(e["least"], s.all_least)} for e in stack if e["value"] < rising[0]["value"]] + rising
    return out, groups


CONTEXT = "block int, lcp0 int, p0 long, base array<long>, again boolean, right array<struct<value:int,sums:array<long>,least:long,k:long>>, left array<struct<value:int,least:long>>, last_sha string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _block_nodes(rows: pa.Table, context: pa.Table) -> pa.Table:
    """The nodes that begin in a block."""
    rows = rows.sort_by("at")
    own = context.to_pylist()[0]
    length, n, least, total = (rows[c].to_numpy().astype(np.int64) for c in ("len", "n", "least", "total"))
    lcp = rows["lcp"].fill_null(own["lcp0"]).to_numpy().astype(np.int64)
    before = rows["before"].fill_null(own["p0"]).to_numpy().astype(np.int64)
    after = np.append(lcp[1:], own["right"][-1]["value"])
    sums = [b + np.concatenate(([0], np.cumsum(x)[:-1])) for b, x in zip(own["base"], (n, n * total - (total - before), (after < length).astype(np.int64)))]

    # The stack holds the falling minima to the right of a row, with the segments whose parent each is.
    stack = [[e["value"], e["sums"], e["least"], e["k"], []] for e in own["right"]]
    seg: list[list] = []  # row, first depth, last depth, sums at the end, least member, children at the last depth, parent
    lcps, lengths, leasts = lcp.tolist(), length.tolist(), least.tolist()
    at = list(zip(*(x.tolist() for x in sums)))
    for i in range(len(lcps) - 1, -1, -1):
        low, deep, member, kids, mine = lcps[i], lengths[i], leasts[i], 0, None
        upper = deep
        while stack[-1][0] > low:
            value, ends, segment_least, k, waiting = stack.pop()
            if upper > value:
                seg.append([i, value + 1, upper, ends, member, kids, None])
                waiting.append(len(seg) - 1)
            member, kids, upper = min(member, segment_least), k + 1 - (deep == value), value
            for j in waiting:
                seg[j][6] = member
        waiting = []
        if upper > low:
            seg.append([i, low + 1, upper, stack[-1][1], member, kids, None])
            waiting = [len(seg) - 1]
        if stack[-1][0] == low:
            top = stack[-1]
            top[1:] = [at[i], min(top[2], member), top[3] + (low < deep), top[4] + waiting]
        else:
            stack.append([low, at[i], member, int(low < deep), waiting])
    member = (1 << 63) - 1
    for value, _, segment_least, _, waiting in reversed(stack):
        member = min(member, segment_least)
        if waiting and value >= 0:
            left = next(e["least"] for e in reversed(own["left"]) if e["value"] < value)
            for j in waiting:
                seg[j][6] = min(member, left)

    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in names])
    if not seg:
        return kinds.empty_table()
    i, first, last, ends, member, kids, parent = zip(*seg)
    i, first, last, member, kids = (np.array(x, dtype=np.int64) for x in (i, first, last, member, kids))
    ends = np.array(ends, dtype=np.int64)
    here = np.array(at, dtype=np.int64)[i]
    n_convs, weight, leaves = (ends - here).T
    # Bytes of the turns before each depth: running sums over the sizes, of which a block's first row has all.
    sizes = rows["sizes"].combine_chunks()
    count = sizes.value_lengths().to_numpy().astype(np.int64)
    run = np.concatenate(([0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
    start = np.cumsum(count) - count
    start[0] += max(lcp[0], 0)
    many = last - first + 1
    owner = np.repeat(np.arange(len(seg)), many)
    depth = first[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row = i[owner]
    upto = before[row] + run[start[row] + np.maximum(depth - 1 - np.maximum(lcp[row], 0), 0)] - run[start[row]]
    saved = weight[owner] - before[row] - (n_convs[owner] - 1) * upto
    shas = rows["sha"].to_pylist()
    if own["last_sha"]:
        shas[-1] = own["last_sha"]
    whole = depth == length[row]
    up = np.array([-1 if p is None else p for p in parent], dtype=np.int64)[owner]
    lowest = depth == first[owner]
    no_parent = np.array([p is None for p in parent])[owner] & lowest
    columns = [member[owner], depth, pa.array(np.where(lowest, up, member[owner]), mask=no_parent), n_convs[owner], np.where(depth == last[owner], kids[owner], 1), leaves[owner], saved]
    sha = pa.array([shas[r] if w else None for r, w in zip(row.tolist(), whole.tolist())], pa.string())
    return pa.Table.from_arrays([*(pa.array(c) for c in columns), sha], schema=kinds)


def _joined_hashes(rows: DataFrame, groups: list[tuple[int, int, int]]) -> dict[int, str]:
    """For each group of rows of one conversation the SHA-256 of all its ids, streamed block by block."""
    spark = rows.sparkSession
    known = spark.createDataFrame(groups, "block int, at long, g int")
    parts = rows.filter("ids is not null").select("block", "at", "ids").join(F.broadcast(known), ["block", "at"]).select("g", "block", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, None
        done: dict = {}
        for batch in batches:
            for g, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if g != open_:
                    open_, state = g, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
                done[g] = state
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([s.hexdigest() for s in done.values()], pa.string())], names=["g", "sha"])

    dealt = parts.repartition(common.tasks(spark), "g").sortWithinPartitions("g", "block")
    return {r.g: r.sha for r in dealt.mapInArrow(run, "g int, sha string").collect()}  # a group has two blocks at least


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Nodes (see NODES) of the trie of ``conversations`` (conv_id, key, sizes; see ``rebuilt``): the
    least member and depth name a node; ends_sha256 is of the members that end there."""
    spark = conversations.sparkSession
    known = common.materialise(conversations, "rebuilt", "zstd")
    turns = known.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(common.tasks(spark), -(-turns // block_turns))
    dealt = known.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    dealt = dealt.select(F.spark_partition_id().alias("block"), "conv_id", "key", "sizes")
    empty = spark.createDataFrame([], ROWS)
    schema = pa.schema(empty.toArrow().schema)
    rows = common.materialise(dealt.mapInArrow(lambda batches: _blocks(batches, schema), ROWS), "rows", "zstd")
    edges = sorted(rows.filter("key is not null").select("block", "at", "len", "key", "sizes", "rows", "cn", "w", "leaves", "all_least", "head_least", "falling", "rising").collect(), key=lambda r: (r.block, r.at))
    firsts = {r.block: r for r in edges if not r.at}
    blocks = [(r, firsts[r.block]) for r in edges if r.rows is not None]
    context, groups = _folded(blocks)
    hashes = _joined_hashes(rows, groups) if groups else {}
    begin: dict[int, int] = {}
    for block, _, g in groups:
        begin.setdefault(g, block)
    whole = {block: hashes[g] for g, block in begin.items()}
    told = spark.createDataFrame([(c["block"], c["lcp0"], c["p0"], c["base"], c["again"], [(e["value"], e["sums"], e["least"], e["k"]) for e in c["right"]], [(e["value"], e["least"]) for e in c["left"]], whole.get(c["block"])) for c in context], CONTEXT)
    slim = rows.select("block", "at", "len", "n", "least", "lcp", "before", "sizes", "total", "sha")
    found = slim.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_block_nodes, NODES)
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn (null for the root)."""
    turns = _turns(conversations)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    placed = turns.select(F.col("conv_id").alias("_conv"), F.row_number().over(order).alias("_nth"), "role", "text")
    held = turns.groupBy(F.col("conv_id").alias("_base")).agg(F.count("*").alias("_held"))
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    asked = nodes.withColumn("_h", _taken(F.col("conv_id"))).join(held, base == F.col("_base"), "left").withColumn("_from", F.least("_h", F.coalesce("_held", F.lit(0))))
    inside = F.col("depth") <= F.col("_from")
    asked = asked.withColumn("_c", F.when(inside, base).otherwise(F.col("conv_id"))).withColumn("_n", F.when(inside, F.col("depth")).otherwise(F.col("depth") - F.col("_from") + F.col("_h")))
    out = asked.join(placed, (F.col("_c") == F.col("_conv")) & (F.col("_n") == F.col("_nth")) & (F.col("depth") > 0), "left")
    return out.select(*nodes.columns, "role", "text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(common.load(spark, sf_dir, "conversations")))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLE_SQL = {
    "op11_conversation_trie": """with o as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k from conversations where conv_id is not null),
 h as (select c, xor(list_reduce([4294967295::ubigint] || list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint), lambda a, b: list_reduce([xor(a, b)] || [0::ubigint, 0, 0, 0, 0, 0, 0, 0], lambda p, q: case when p % 2 = 1 then xor(p // 2, 3988292384::ubigint) else p // 2 end)), 4294967295::ubigint) % 9 as h from (select distinct c from o)),
 r as (select h.c, 0 as own, k, role, text from h join o on o.c = h.c - h.c % 5 and k <= h.h union all select h.c, 1, k, role, text from h join o on o.c = h.c and k > h.h),
 t as (select c, row_number() over (partition by c order by own, k) as d, role, text, len(role) || ':' || role || text as x from r),
 w as (select c, d, text, string_agg(md5(x), '') over (partition by c order by d) as p from t),
 m as (select c, d, p, octet_length(encode(text)) as b from w union all select c, 0, '', 0 from h),
 z as (select c, max(d) as len from m group by 1),
 n as (select p, d, min(c) as conv_id, count(*) as n_convs, max(b) as b, list(c::varchar order by c) filter (where d = len) as ends from m join z using (c) group by p, d),
 q as (select c.p, c.d, min(u.conv_id) as parent_conv_id from n c left join n u on u.d = c.d - 1 and u.p = left(c.p, 32 * (c.d - 1)) group by 1, 2),
 k as (select left(p, 32 * (d - 1)) as p, d - 1 as d, count(*) as n_children from n where d > 0 group by 1, 2),
 g as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (p, d)),
 s as (select a.p, a.d, cast(sum((g.n_convs - 1) * g.b) as bigint) as saved_tokens, count(*) filter (where g.n_children = 0) as n_leaves from (select distinct left(g.p, 32 * e.i) as p, e.i as d, g.p as gp, g.d as gd from g, lateral (select unnest(range(0, g.d + 1)) as i) e) a join g on g.p = a.gp and g.d = a.gd group by 1, 2)
 select g.conv_id, g.d as depth, q.parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(array_to_string(g.ends, ','), '')) as ends_sha256 from g join q using (p, d) join s using (p, d)"""
}
