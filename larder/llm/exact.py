"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of `block_bytes` bytes. Equal blocks get one integer name, different blocks
different ones: blocks are dealt to buckets by a hash, sorted inside the bucket and numbered, and the name is the bucket
with that number. Then adjacent names are paired and the pairs are named in the same way, level by level, until each
document has one name; with its number of blocks that name is equal for two documents only if their texts are
equal. No digest decides equality.

Volume: one pass normalises, cuts and hashes the texts and writes rows and blocks to a scratch table; later steps read
its narrow columns. The text crosses one shuffle, as blocks; each level moves half as many integers as the one before. A
block or pair that many documents share would meet in one bucket, so such values are found first by counting their
hashes. Their rows never shuffle: the distinct hot values, at most `2 * hot_share` of them, are named apart and joined by
broadcast (bounded by that number times a block). Large groups of copies get their keeper by broadcast too (at most 2,000
such groups). Documents of one block leave after the first naming.

Defined cases: null text counts as empty; empty texts are all equal. Exactly one row of a group stays: the one of the
smallest doc_id, a null doc_id being larger than any other; of rows that share that doc_id, the one of the smallest hash
of the whole row (rows equal in all columns are interchangeable). So rows of one doc_id with different texts live and
die apart. A text of any length is cut like all others; it must fit a row. Empty tables give empty results. Extra columns
pass through `keep_first` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import ROW, WS, buckets_for, join_groups, let, numbered, packed, staged, text_or_empty, unpacked

#: Blocks or pairs in a bucket, about: what one window partition sorts.
PER_BUCKET = 2_000


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WS, " ")


def _named(rows: DataFrame, hashes: DataFrame, value: list[str], n_rows: int, hot_share: int) -> DataFrame:
    """`rows` with an integer `name`, equal exactly where the `value` columns are equal; `_h`, also in `hashes`, is their hash."""
    # more than 1 / hot_share of the rows: at most hot_share values; a hash, so a few cold values may join them
    least = max(64, n_rows // hot_share)
    hot = hashes.groupBy("_h").count().filter(F.col("count") > least).select("_h")
    hot_hashes = [r[0] for r in hot.collect()]  # at most hot_share numbers
    names_at = Window.partitionBy("_bucket").orderBy(*value)
    n_buckets = buckets_for(n_rows, PER_BUCKET)
    cold = rows.filter(~F.col("_h").isin(hot_hashes)) if hot_hashes else rows
    out = cold.withColumn("_bucket", F.pmod("_h", F.lit(n_buckets))).withColumn("name", F.shiftleft(F.col("_bucket") + 1, 32) + F.dense_rank().over(names_at))
    columns = [c for c in [*rows.columns, "name"] if c != "_h"]
    if not hot_hashes:
        return out.select(*columns)
    warm = rows.filter(F.col("_h").isin(hot_hashes))
    distinct = warm.select("_h", *value).distinct()
    within = distinct.withColumn("name", F.dense_rank().over(Window.partitionBy("_h").orderBy(*value)).cast("long"))
    ranks = F.array(*[F.lit(h) for h in sorted(hot_hashes)])
    within = within.withColumn("name", -(F.shiftleft(F.array_position(ranks, F.col("_h")), 32) + F.col("name")))
    return out.select(*columns).unionByName(warm.join(F.broadcast(within.drop("_h")), value).select(*columns))


def cut_texts(docs: DataFrame, block_bytes: int = 4096, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A scratch table of `docs` with row numbers, packed `carry` columns, text_sha256, n_blocks, blocks and their hashes."""

    def cut(b: Column) -> Column:
        n = F.greatest(F.ceil(F.octet_length(b) / block_bytes), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * block_bytes + 1, F.lit(block_bytes)))
        pieces = let(blocks, lambda p: F.struct(p.alias("blocks"), F.transform(p, lambda x: F.xxhash64(x)).alias("hashes")))
        return F.struct(F.sha2(b, 256).alias("text_sha256"), n.alias("n_blocks"), pieces.alias("p"))

    cuts = packed(docs, let(F.encode(normalised(F.col(f"`{text}`")), "utf-8"), cut).alias("_c"), carry=carry)
    return numbered(cuts.select("_d", "_tie", "_c.text_sha256", "_c.n_blocks", "_c.p.blocks", "_c.p.hashes"), "exact-cuts")


def identities(cuts: DataFrame, hot_share: int = 200) -> DataFrame:
    """(_row, n_blocks, name) of `cut_texts`: equal (n_blocks, name) exactly for equal normalised texts."""
    size, longest = cuts.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.max("n_blocks"), F.lit(1))).first()
    pieces = cuts.select(ROW, "n_blocks", F.posexplode(F.arrays_zip("hashes", "blocks")).alias("pos", "p"))
    blocks = pieces.select(ROW, "n_blocks", "pos", F.col("p.hashes").alias("_h"), F.col("p.blocks").alias("block"))
    level = staged(_named(blocks, cuts.select(F.explode("hashes").alias("_h")), ["block"], size, hot_share).drop("block"), "names")
    widths = [1 << k for k in range(max(0, int(longest) - 1).bit_length())]
    # pairs of each level: those of documents with more names than `width` blocks make
    sums = [F.coalesce(F.sum(F.when(F.col("n_blocks") > w, F.ceil(F.col("n_blocks") / (2 * w)))), F.lit(0)).alias(f"w{w}") for w in widths]
    counts = cuts.agg(*sums).first() if widths else ()
    done = []
    for width, n_pairs in zip(widths, counts, strict=True):
        done.append(level.filter(F.col("n_blocks") <= width).select(ROW, "n_blocks", "name"))
        paired = (
            level.filter(F.col("n_blocks") > width)
            .groupBy(ROW, "n_blocks", F.expr("pos div 2").cast("int").alias("pair"))
            .agg(F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"))
            .withColumnRenamed("pair", "pos")
        )
        paired = staged(paired.withColumn("_h", F.xxhash64("a", "b")), "pairs")
        level = staged(_named(paired, paired, ["a", "b"], n_pairs, hot_share).drop("a", "b"), "names")
    done.append(level.select(ROW, "n_blocks", "name"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _judged(cuts: DataFrame, hot_share: int, doc_id: str) -> DataFrame:
    """(_row, keep_id, group_size, kept, n_blocks) for each row of `cut_texts`."""
    names = identities(cuts, hot_share)
    of_row = F.col("_d").getField(doc_id)
    order = F.struct(of_row.isNull().alias("none"), of_row.alias("id"), "_tie", F.col(ROW).alias("row"))
    known = staged(cuts.select(ROW, order.alias("_o")).join(names, ROW), "exact-known")
    groups = staged(known.groupBy("n_blocks", "name").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = join_groups(known, groups, ["n_blocks", "name"], "group_size", known.count())
    return joined.select(ROW, F.col("_first.id").alias("keep_id"), "group_size", (F.col("_first.row") == F.col(ROW)).alias("kept"), "n_blocks")


def exact_dedup(docs: DataFrame, block_bytes: int = 4096, hot_share: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_blocks."""
    cuts = cut_texts(docs.select(doc_id, text), block_bytes, text, [doc_id])
    rows = cuts.select(ROW, F.col("_d").getField(doc_id).alias("doc_id"), "text_sha256")
    return rows.join(_judged(cuts, hot_share, doc_id), ROW).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_blocks")


def keep_first(docs: DataFrame, block_bytes: int = 4096, hot_share: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts."""
    cuts = cut_texts(docs, block_bytes, text)
    return unpacked(cuts.join(_judged(cuts, hot_share, doc_id).filter("kept").select(ROW), ROW, "left_semi"), docs)
