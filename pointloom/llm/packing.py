"""Best-fit packing of token sequences, decided on the histogram of lengths.

A piece's place depends on its length alone, and lengths are at most the
capacity; so the driver packs counts by length (at most ``capacity`` numbers)
into patterns with multiplicities, in time that does not grow with the corpus.
Pieces above one third of the capacity are matched greedily, at most two to a
sequence: the longest with the longest that still fits.  Smaller ones, longest
first, go where the remaining gap is smallest.  A piece then finds its place by
its rank among the pieces of its length; ranks come from counts by (length,
chunk), and rows are dealt to chunks in turn, so no length gathers in one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm import textnum as tn
from pointloom.scratch import cut

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
CHUNKS = 1024
#: The same vocabulary as merge ranks, and the name of its file.
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, ranks: str | None):
    """A function from text to ids.

    ``vocabulary`` is a file of ``tokenizers``, used as it is.  Where ``ranks``
    names the same vocabulary as merge ranks, ``tiktoken`` encodes by them, with the
    file's added tokens: the ids are equal (tests compare them).
    """
    import public_tokenizers

    if ranks is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(vocabulary), "rb") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{vocabulary} has added tokens that are not matched as they are")
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={t["content"]: t["id"] for t in added})
    return lambda text: encoding.encode(text, allowed_special="all")


def token_bytes(text: str, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> bytes:
    """Ids of a text as little-endian 32-bit words."""
    return np.array(_encoder(vocabulary, ranks)(text), "<u4").tobytes()


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; the first takes what does not fill one."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> DataFrame:
    """Pieces of every document (``doc_id``, ``text``); null text is empty.

    Repeated rows and null keys each have their pieces, an empty table has none.
    Other columns are not looked at, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = int(end).to_bytes(4, "little")
        for batch in tn.sliced(batches, "text", 4 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = token_bytes(text or "", vocabulary, ranks) + last
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that have it."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[list]] = {}  # gap -> [pattern, sequences]
    order: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append([pattern, times])

    while large:
        top = large[-1]
        at = bisect_left(large, capacity - top + 1) - 1
        if at < 0:
            put((top,), left[large.pop()])
            continue
        mate = large[at]
        if mate == top:
            pairs, odd = divmod(left[top], 2)
            large.pop()
            if pairs:
                put((top, top), pairs)
            if odd:
                left[top] = 1
                lower = at - 1
                if lower >= 0:
                    put((top, large[lower]), 1)
                    left[large[lower]] -= 1
                    if not left[large[lower]]:
                        large.pop(lower)
                else:
                    put((top,), 1)
            continue
        times = min(left[top], left[mate])
        put((top, mate), times)
        for n in (top, mate):
            left[n] -= times
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                full, rest = divmod(count, each)
                if full:
                    put((n,) * each, full)
                if rest:
                    put((n,) * rest, 1)
                break
            gap = order[at]
            pattern, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            used = min(times, count)
            count -= used
            put((*pattern, n), used)
            if times > used:
                put(pattern, times - used)
    return [(pattern, times) for gap in order for pattern, times in gaps[gap]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            at = ranks.get(n, 0)
            table.setdefault(n, []).append((at, sequence, offset))
            ranks[n] = at + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in table.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).

    Lengths must be from 1 to ``capacity``.  Repeated rows and rows of a null key are
    packed as often as they come; an empty table gives an empty result.  Other columns
    are not looked at, whatever their names.
    """
    # rows are dealt to chunks in turn, so that no key or copy gathers; written, as counts and ranks must see the same
    chunk = F.pmod(F.monotonically_increasing_id(), F.lit(CHUNKS)).cast("int")
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    pieces = cut(pieces.withColumn("chunk", chunk))
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = pieces.sparkSession.sparkContext.broadcast(places(pack_counts(sizes, capacity)))
    rank = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank.cast("long")).join(before.drop("n"), ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, where, place = sent.value[n]
                k = np.searchsorted(first, at[own], "right") - 1
                sequence[own] = where[k] + at[own] - first[k]
                offset[own] = place[k]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(tokenize(docs))
