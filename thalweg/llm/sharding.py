"""Extendible hashing of rows into byte-bounded shards.

A row hashes to 60 bits.  The directory is a binary trie over hash prefixes: a bucket that exceeds the byte limit splits
on its next bit, every other bucket stays.  The final trie does not depend on arrival order: a leaf is the shortest
prefix whose rows fit, all shorter prefixes being too large.  So the trie is computed from one histogram of prefixes
instead of by inserting rows one by one, and only prefixes that are still too large are looked at again, a few bits
deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.storage import materialize

#: Production byte limit of a shard.
SHARD_BYTES = 16 << 20
HASH_BITS = 60
_STEP = 8


def hash_bits(id_col: str, text_col: str):
    """60 hash bits of a row: the first 15 hex digits of md5(id ':' md5(text)); null counts as an empty string."""
    content = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


#: Tables of more rows than this are not left to be broadcast.
_FEW = 10_000


def _sent(df: DataFrame, at_most: int) -> DataFrame:
    """A side of a join that has at most so many rows.  One that grows with the input is merged, as a broadcast goes through the driver."""
    return df if at_most <= _FEW else df.hint("merge")


def _trie_step(cells: DataFrame, base: int, deep: int, limit: int, at_most: int) -> DataFrame:
    """Leaves for the cells of one histogram.  cells(cell, bytes, n_rows): prefixes of ``deep`` bits below parents of ``base``
    bits that are known to be too large (or the root), ``at_most`` so many.  Returns cell -> (depth, prefix, shard_bytes, shard_rows); cells
    that are themselves too large have depth null.  A prefix with one row is not split, however large the row."""
    first = base + 1 if base else 0
    level = cells.select(
        "cell", "bytes", "n_rows", F.explode(F.sequence(F.lit(first), F.lit(deep))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
    nodes = level.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
    fits = level.join(_sent(nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)), at_most), ["depth", "prefix"])
    best = fits.groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf")
    )
    return cells.select("cell", "n_rows").join(_sent(best, at_most), "cell", "left").select("cell", "n_rows", "leaf.depth", "leaf.prefix", "leaf.shard_bytes", "leaf.shard_rows")


def extendible_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, shard, part, depth, shard_bytes, shard_rows``.

    ``n_bytes`` is the UTF-8 length of the text (null: 0).  ``shard`` is the trie leaf as a number, a leading 1 bit
    followed by the prefix bits (1: the root), so shards order along the hash space.  ``shard_bytes <= limit`` unless a
    single row is larger than the limit; such a row is alone in its shard, at the shortest prefix it has alone.

    Null ids and null texts hash as empty strings.  Rows equal in id and text have equal hashes; if they alone exceed
    the limit no bit parts them, so they are dealt by count into ``part`` 0, 1, ... (0 for all others).  Ties cannot
    arise elsewhere.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    rows = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"),
            hash_bits(id_col, text_col).alias("h"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4) if total > limit else 0
    base, todo, done, parents = 0, rows, [], 1
    while True:
        cell = F.expr(f"shiftright(h, {HASH_BITS - deep})")
        cells = todo.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n_rows"))
        at_most = parents << (deep - base)
        leaves = materialize(_trie_step(cells, base, deep, limit, at_most), "shard-leaves")
        placed = todo.withColumn("cell", cell).join(_sent(leaves.where("depth is not null").drop("n_rows"), at_most), "cell").drop("cell")
        done.append(placed.withColumn("part", F.lit(0)))
        large = leaves.where("depth is null").select("cell", "n_rows")
        parents = large.count()
        if not parents:
            break
        todo = todo.withColumn("cell", cell).join(_sent(large, parents), "cell")
        if deep == HASH_BITS:
            done.append(_deal_equal(todo, limit))
            break
        todo = materialize(todo.drop("cell", "n_rows"), "shard-large")
        base, deep = deep, min(HASH_BITS, deep + _STEP)
    out = done[0].select(*_COLUMNS)
    for more in done[1:]:
        out = out.unionByName(more.select(*_COLUMNS))
    return out.select(
        "doc_id", "n_bytes", F.expr("shiftleft(1L, depth) | prefix").alias("shard"), "part", "depth", "shard_bytes", "shard_rows"
    )


_COLUMNS = ("doc_id", "n_bytes", "depth", "prefix", "shard_bytes", "shard_rows", "part")


def _deal_equal(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that agree on all hash bits, so in id and text: they are interchangeable and dealt by count.  Each partition
    numbers its own rows; a small table of counts gives each partition its offset, so no group meets in one task."""
    here = materialize(rows.withColumn("pid", F.spark_partition_id()), "shard-equal")
    own = Window.partitionBy("cell", "pid").orderBy("n_bytes")
    counts = here.groupBy("cell", "pid").agg(F.count("*").alias("n"))
    ahead = counts.withColumn(
        "ahead", F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    dealt = (
        here.withColumn("k", F.row_number().over(own) - 1)
        .join(ahead, ["cell", "pid"])
        .withColumn("each", each)
        .withColumn("part", F.expr("cast((ahead + k) div each as int)"))
    )
    size = F.least(F.col("each"), F.col("n_rows") - F.col("part") * F.col("each"))
    return dealt.withColumns({"depth": F.lit(HASH_BITS), "prefix": F.col("cell"), "shard_rows": size, "shard_bytes": size * F.col("n_bytes")})


def directory(shards: DataFrame) -> DataFrame:
    """The directory of placed rows, one row per shard: ``shard, depth, first_slot, last_slot, slots, global_depth``.  A directory of
    ``global_depth`` bits has one slot per prefix of that many bits; a shard owns the slots from first to last."""
    leaves = shards.groupBy("shard").agg(F.first("depth").alias("depth"))
    both = leaves.crossJoin(F.broadcast(leaves.agg(F.max("depth").alias("global_depth"))))  # one row
    free = "global_depth - depth"
    first = F.expr(f"shiftleft(shard - shiftleft(1L, depth), {free})")
    return both.select("shard", "depth", first.alias("first_slot"), (first + F.expr(f"shiftleft(1L, {free})") - 1).alias("last_slot"), F.expr(f"shiftleft(1L, {free})").alias("slots"), "global_depth")
