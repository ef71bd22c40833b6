"""Shards of near-equal bytes from ordered atomic groups.

Rows of equal text form one atomic group.  Groups are ordered by a 64-bit hash
of the text, and the ordered sizes are cut into contiguous parts so that the
largest part is as small as possible: the capacity is found by binary search,
each candidate checked by filling shards greedily, and the cuts are made there.

The driver works on sums over ranges of the hash: 8,192 ranges first; ranges
that a cut may fall into are split 8,192 ways again until they hold one group
or no smaller capacity is possible.  What reaches the driver at a time is bounded
by those constants, whatever the size of the table.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.scratch import cut

LAW = "bytes"
#: Bits of the hash resolved by each pass over the sizes.
STEP = 13
#: Slots are numbered within this many cells for each shard.
CELLS = 4096
#: Most ranges split in one pass, the largest first; later passes split the rest.
SPLIT = 32


def _greedy(ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """Exclusive ends (as indexes) of contiguous parts within capacity, or None."""
    cuts, filled = [], 0
    for _ in range(shards):
        at = bisect_right(ends, filled + capacity)
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        filled = ends[at - 1] if at else 0
    return None


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity for contiguous parts, and the parts' ends."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0, [0] * shards
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, _greedy(ends, shards, low)


def _doubtful(order: list[tuple[int, int]], sizes: list[int], single: set, shards: int, lower: int, upper: int) -> list[int]:
    """Ranges that a cut may fall into for some capacity between the bounds."""
    ends = [0, *accumulate(sizes)]
    found: set[int] = set()
    low = high = 0
    for _ in range(shards - 1):
        low = ends[max(bisect_right(ends, low + lower) - 1, 0)]
        high = min(high + upper, ends[-1])
        first, last = bisect_right(ends, low) - 1, min(bisect_right(ends, high) - 1, len(order) - 1)
        found.update(i for i in range(first, last + 1) if order[i][1] and order[i] not in single)
    return sorted(found, key=lambda i: -sizes[i])


def plan(groups: DataFrame, shards: int) -> list[int]:
    """Lower bounds, as unsigned hashes, of all shards but the first.

    ``groups`` has a row for each atomic group: ``group_hash`` (long), ``size``.
    """
    leaves: dict[tuple[int, int], int] = {}
    single: set[tuple[int, int]] = set()
    split = [(0, 64)]
    while True:
        for depth in sorted({bits for _, bits in split}):
            low = max(depth - STEP, 0)
            cell = F.shiftrightunsigned(F.col("group_hash"), low)
            among = groups
            if depth < 64:
                among = groups.where(F.shiftrightunsigned(F.col("group_hash"), depth).isin([p for p, bits in split if bits == depth]))
            for row in among.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
                leaves[at := (row["cell"] % (1 << 64), low)] = row["size"]
                if row["n"] == 1:
                    single.add(at)
        for at in split:
            leaves.pop(at, None)
        order = sorted(leaves, key=lambda k: k[0] << k[1])
        sizes = [leaves[k] for k in order]
        capacity, ends = minimax(sizes, shards)
        lower = max([-(-sum(sizes) // shards), *(leaves[k] for k in order if k in single or not k[1])])
        doubtful = [] if capacity <= lower else _doubtful(order, sizes, single, shards, lower, capacity)
        if not doubtful:
            return [order[end][0] << order[end][1] if end < len(order) else 1 << 64 for end in ends[:-1]]
        split = [order[i] for i in doubtful[:SPLIT]]


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to ``shards`` with equal texts together and bytes near equal.

    A row weighs the UTF-8 bytes of its text plus 1; null text weighs 1 and is
    a group of its own kind (with the empty text).  Gives ``doc_id`` (the key),
    ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 within a
    shard) only; other columns are not looked at, whatever their names.  An empty
    table gives an empty result.  Null keys and repeated rows are kept.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    base = base.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    base = base.withColumn("group_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = cut(base.groupBy("group_hash").agg(F.sum("size").alias("size")))
    bounds = plan(groups, shards)
    # unsigned order of the hash: flip the sign bit, compare as signed
    flipped = F.col("group_hash").bitwiseXOR(F.lit(-(1 << 63)))
    shard = F.lit(0)
    for bound in bounds:
        shard = shard + (F.lit(0) if bound >= 1 << 64 else F.when(flipped >= F.lit(bound - (1 << 63)), 1).otherwise(0))
    # rows are dealt to the cells in turn, whatever their keys and texts, and stay there: the table is written
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    placed = cut(base.select("doc_id", "size", crc, "group_hash", shard.cast("int").alias("shard"), F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int").alias("cell")))
    counts = {(r["shard"], r["cell"]): r["n"] for r in placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).collect()}
    table, run, last = [], 0, None
    for at in sorted(counts):
        run = run if at[0] == last else 0
        table.append((at[0], at[1], run))
        run, last = run + counts[at], at[0]
    offsets = spark.createDataFrame(table, "shard int, cell int, before long")  # at most shards * CELLS rows
    rank = Window.partitionBy("shard", "cell").orderBy("doc_id", "group_hash")
    return (
        placed.withColumn("rank", F.row_number().over(rank) - 1)
        .join(F.broadcast(offsets), ["shard", "cell"])
        .withColumn("slot", F.col("before") + F.col("rank"))
        .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"))
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_bytes(docs, 8).withColumn("law", F.lit(LAW)).withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
