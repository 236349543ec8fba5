"""Prefix trie of rebuilt conversations, by composable fingerprints of stored turns.

A rebuilt conversation is the head of a base conversation followed by a conversation's own later turns. Its text is never built:
the fingerprint of a sequence of turns is an element of a monoid, (length n, value sum of t_i B^i mod p) with

    (n, x) * (m, y) = (n + m, x + B^n y),

where t_i is a digest of turn i. So the fingerprint of each prefix of a rebuilt conversation follows from stored prefixes of the
base and of the own turns, by a product and, for leaving out an own head, a difference. The same rule composes the pieces of a
conversation that lies in several partitions of the sorted log: each piece is summed alone, and its offset is added after.
Four primes of 31 bits make 124 bits of a fingerprint.

Prefixes with one depth and fingerprint are a node. Equality is verified, not assumed. Turns with one digest have one role and text
(least and greatest are compared over the stored turns), and all members of a node refer to turns of one digest below
parents of one fingerprint; by induction over the depth the sequences are equal. Should a check fail, all is done again with
other digests and bases.

Sums over subtrees need no walk: every node belongs to its smallest member, the nodes of a member are the lower end of its path,
so a subtree's sum is the sum over its members of what they own from that depth on. Members are summed as rows, linearly.

Hot keys: a conversation with a third of all rows lies in pieces of a sorted partition each, and only pieces are windowed; a
node that a third of all conversations share is summed with partial aggregation, and joined by broadcast (`join_groups`: at most
2,000 such nodes). The digest of all ids that end at a node is sequential by its definition: ids are gathered by slices of 65,536
values, and the slices of one node are read in order by one task as a stream, in bounded memory.

Defined cases: null role and text are empty. Null turns come first; turns of equal number go by role, then text. Repeated rows are
turns of their own. A base that doesn't exist has no turns. Rows without conv_id take no part. A rebuilt conversation without turns
is a member of the root alone. An empty table gives an empty result. Other columns are ignored. A very long text is read once for
its digest and once for its comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import join_groups, staged

#: Primes below 2**31, and the base of each; products of two remainders fit a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525173, 1597334677, 1181783497)
LANES = range(len(PRIMES))
#: Positions are below 2**32: four digits of eight bits.
DIGITS, RADIX = 4, 256
#: Ids of one slice of the list of ids that end at a node.
SLICE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


def base_of(conv: Column, every: int = 20) -> Column:
    return conv - conv % every


def head_length(conv: Column, most: int = 4) -> Column:
    """How many turns come from the base: by the CRC-32 of the id in decimals."""
    return (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")


def _mod(x: Column, lane: int) -> Column:
    return F.pmod(x, F.lit(PRIMES[lane]))


def _base(lane: int, salt: int) -> int:
    return (BASES[lane] + 7919 * salt) % PRIMES[lane]


def power(n: Column, lane: int, salt: int) -> Column:
    """B^n mod p for 0 <= n < 2**32, from tables of B's powers by digits of n."""
    p, out = PRIMES[lane], None
    for d in range(DIGITS):
        step = pow(_base(lane, salt), RADIX**d, p)
        table = F.expr(f"array({', '.join(f'{pow(step, k, p)}L' for k in range(RADIX))})")
        factor = F.get(table, F.shiftright(n, 8 * d).bitwiseAND(RADIX - 1).cast("int"))
        out = factor if out is None else _mod(out * factor, lane)
    return out


def _shift_back(n: Column, lane: int, salt: int, most: int) -> Column:
    """B^-n mod p for 0 <= n < most."""
    inverse = pow(_base(lane, salt), -1, PRIMES[lane])
    return F.get(F.expr(f"array({', '.join(f'{pow(inverse, k, PRIMES[lane])}L' for k in range(most))})"), n.cast("int"))


def sorted_turns(turns: DataFrame, salt: int) -> DataFrame:
    """The log in order, without texts: conv_id, block (partition of the order), at (row in it), d1, d2 (digest) and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # equal rows are told apart for the ranges only, so that many of them don't have to lie in one
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    digests = [F.xxhash64(F.lit(salt + k), "role", F.lit(k), "text").alias(f"d{k + 1}") for k in range(2)]
    return ordered.select("conv_id", F.shiftright("_at", 33).alias("block"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("at"), *digests, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def digests_hold(turns: DataFrame, salt: int) -> bool:
    """Whether each digest stands for one role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(role.alias("role"), text.alias("text"))
    digests = [F.xxhash64(F.lit(salt + k), "role", F.lit(k), "text").alias(f"d{k + 1}") for k in range(2)]
    ends = rows.groupBy(*digests).agg(F.min("role").alias("a"), F.max("role").alias("b"), F.min("text").alias("c"), F.max("text").alias("d"))
    return ends.filter("a <> b OR c <> d").isEmpty()


def prefixes(log: DataFrame, salt: int) -> DataFrame:
    """Each stored turn's position in its conversation (from 1) and the fingerprint x0 to x3 of all turns up to it."""
    piece = Window.partitionBy("conv_id", "block").orderBy("at")
    lanes = [F.shiftright(F.col(f"d{1 + i // 2}"), 32 * (i % 2)).bitwiseAND(0x7FFFFFFF) for i in LANES]
    local = log.withColumn("i", F.row_number().over(piece).cast("long"))
    local = local.select("*", *[_mod(_mod(lanes[k], k) * power(F.col("i"), k, salt), k).alias(f"t{k}") for k in LANES])
    local = local.select("conv_id", "block", "at", "i", "d1", "d2", "words", *[_mod(F.sum(f"t{k}").over(piece), k).alias(f"x{k}") for k in LANES])
    pieces = local.groupBy("conv_id", "block").agg(F.max("i").alias("n"), *[F.max_by(f"x{k}", "i").alias(f"x{k}") for k in LANES])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.select("conv_id", "block", "off", *[power(F.col("off"), k, salt).alias(f"f{k}") for k in LANES], *[f"x{k}" for k in LANES])
    sums = [_mod(F.coalesce(F.sum(_mod(F.col(f"f{k}") * F.col(f"x{k}"), k)).over(before), F.lit(0)), k).alias(f"b{k}") for k in LANES]
    offsets = offsets.select("conv_id", "block", "off", *[f"f{k}" for k in LANES], *sums)
    return local.join(offsets, ["conv_id", "block"]).select(
        "conv_id", "block", (F.col("off") + F.col("i")).alias("i"), "d1", "d2", "words", *[_mod(F.col(f"b{k}") + F.col(f"f{k}") * F.col(f"x{k}"), k).alias(f"x{k}") for k in LANES]
    )


def _packed(lanes: list[Column]) -> list[Column]:
    """Two longs of a fingerprint."""
    return [F.shiftleft(lanes[2 * k], 31).bitwiseOR(lanes[2 * k + 1]) for k in range(2)]


def members(stored: DataFrame, salt: int, head: Column, base: Column, most: int) -> DataFrame:
    """A row for each conversation and depth of its rebuilt form, the root included: conv_id, block, depth, fingerprint k1 and k2,
    that of the prefix one shorter (p1, p2), digest and words of the last turn. block is -1 for what comes from the base."""
    fields = ["i", "d1", "d2", "words", *[f"x{k}" for k in LANES]]
    first = stored.filter(F.col("i") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("first"))
    convs = first.select("conv_id", "first", head.alias("h"), base.alias("base"))
    bases = first.select(F.col("conv_id").alias("base"), F.col("first").alias("theirs"))
    cut = F.coalesce(F.filter("theirs", lambda t: t["i"] <= F.col("h")), F.array().cast(first.schema["first"].dataType))
    convs = convs.join(bases, "base", "left").select("conv_id", "h", cut.alias("head"), F.filter("first", lambda t: t["i"] <= F.col("h")).alias("skipped"))
    of = lambda a, k: F.coalesce(F.try_element_at(a, F.lit(-1))[f"x{k}"], F.lit(0))
    convs = convs.select("conv_id", "h", "head", F.size("head").alias("n"), *[of(F.col("head"), k).alias(f"a{k}") for k in LANES], *[of(F.col("skipped"), k).alias(f"s{k}") for k in LANES])

    def row(depth: Column, lanes: list[Column], turn: dict[str, Column], block: Column) -> list[Column]:
        digest = (turn["d1"], turn["d2"])
        lane = [F.shiftright(digest[k // 2], 32 * (k % 2)).bitwiseAND(0x7FFFFFFF) for k in LANES]
        before = [_mod(lanes[k] - _mod(_mod(lane[k], k) * power(depth, k, salt), k), k) for k in LANES]
        keys, parents = _packed(lanes), _packed(before)
        return [F.col("conv_id"), block.alias("block"), depth.cast("long").alias("depth"), keys[0].alias("k1"), keys[1].alias("k2"), parents[0].alias("p1"), parents[1].alias("p2"), turn["d1"].alias("d1"), turn["d2"].alias("d2"), turn["words"].alias("words")]

    none = F.lit(None).cast("long")
    root = convs.select("conv_id", F.lit(-1).cast("long").alias("block"), *[F.lit(0).cast("long").alias(c) for c in KEY], *[none.alias(c) for c in ("p1", "p2", "d1", "d2")], F.lit(0).cast("long").alias("words"))
    heads = convs.select("conv_id", F.inline("head"))
    heads = heads.select(*row(F.col("i"), [F.col(f"x{k}") for k in LANES], {c: F.col(c) for c in ("d1", "d2", "words")}, F.lit(-1).cast("long")))
    # the conversation's numbers go to its pieces, so that a long one never meets in one task
    pieces = stored.select("conv_id", "block").distinct().join(convs.drop("head"), "conv_id")
    own = stored.join(pieces, ["conv_id", "block"]).filter(F.col("i") > F.col("h"))
    back = F.col("h") - F.col("n")
    lanes = [_mod(F.col(f"a{k}") + _mod(F.col(f"x{k}") - F.col(f"s{k}"), k) * _shift_back(back, k, salt, most), k) for k in LANES]
    shifted = own.select("conv_id", "block", (F.col("i") - back).alias("depth"), "d1", "d2", "words", *[lanes[k].alias(f"y{k}") for k in LANES])
    own = shifted.select(*row(F.col("depth"), [F.col(f"y{k}") for k in LANES], {c: F.col(c) for c in ("d1", "d2", "words")}, F.col("block")))
    return root.unionByName(heads).unionByName(own)


def ends_digests(rows: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ids, ascending and joined by commas, of the conversations whose last row has that key."""
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("e")).select("conv_id", "e.*")
    part = F.floor(F.col("conv_id") / SLICE).alias("part")
    lists = last.groupBy(*KEY, part).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    lists = staged(lists, "ends")
    many = lists.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = many.filter("n = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    rest = lists.join(many.filter("n > 1").select(*KEY), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in now], pa.array([state.hexdigest()])], [*KEY, "ends_sha256"])
        for b in batches:
            for key, ids in zip(zip(*[b.column(c).to_pylist() for c in KEY], strict=True), b.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if now is not None:
            yield done()

    return one.unionByName(rest.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string"))


def trie_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with what their members and children sum up to; `rows` and `nodes` are scratch tables."""
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").select(*KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = staged(nodes, "trie-nodes")
    n_rows = rows.count()
    of_node = nodes.select(*KEY, F.col("conv_id").alias("owner"), "n_convs", "saved", (F.col("n_children") == 0).alias("leaf"))
    met = join_groups(rows.select("conv_id", "block", *KEY), of_node, KEY, "n_convs", n_rows)
    mine = F.col("owner") == F.col("conv_id")
    met = staged(met.select("conv_id", "block", *KEY, F.when(mine, F.col("saved")).otherwise(0).alias("own"), (mine & F.col("leaf")).cast("int").alias("leaf")), "trie-members")
    pieces = met.groupBy("conv_id", "block").agg(F.sum("own").alias("own"), F.max("leaf").alias("leaf"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("own").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv_id", "block", (F.sum("own").over(whole) - before).alias("left"), F.max("leaf").over(whole).alias("ends_in_leaf"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = met.withColumn("passed", F.sum("own").over(inside) - F.col("own")).join(pieces, ["conv_id", "block"])
    sums = shares.groupBy(*KEY).agg(F.sum(F.col("left") - F.col("passed")).alias("saved_tokens"), F.sum("ends_in_leaf").cast("long").alias("n_leaves"))
    parents = nodes.select(F.col("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    below = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), "k1", "k2", "p1", "p2")
    below = join_groups(below, parents, ["depth", "p1", "p2"], "n_children", n_rows).select((F.col("depth") + 1).alias("depth"), "k1", "k2", "parent_conv_id")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(sums, KEY).join(below, KEY, "left").join(ends_digests(rows), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "k1", "k2"
    )


def prefix_trie(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    the fingerprint (k1, k2). Conversation c starts with the first CRC-32(c) % `most` turns of conversation c - c % `every`."""
    conv = F.col("conv_id")
    for salt in count(0, 2):
        if not digests_hold(turns, salt):
            continue
        stored = staged(prefixes(staged(sorted_turns(turns, salt), "turns"), salt), "prefixes")
        rows = staged(members(stored, salt, head_length(conv, most), base_of(conv, every), most), "members")
        refs = ["p1", "p2", "d1", "d2"]
        ends = [F.max(c).alias(f"max_{c}") for c in refs]
        nodes = staged(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.min(c).alias(c) for c in refs], *ends), "nodes")
        if nodes.filter(" OR ".join(f"{c} <> max_{c}" for c in refs)).isEmpty():
            return trie_of(rows, nodes)
