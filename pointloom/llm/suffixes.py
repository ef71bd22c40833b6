"""Removal of repeated byte strings by two-stage suffix sorting.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier (in a
smaller document, or in the same one at an earlier byte).  Four steps:

1. Every window of ``LENGTH`` bytes is assigned an anchor, its least 24-byte
   gram by hash.  Equal windows have equal anchors at the same place, so they
   meet if anchors meet.  Consecutive windows with one anchor form a context;
   only (anchor, hash of the context, document, start, windows) is shuffled.
   Contexts equal to an earlier one of the same chunk are decided before that.
2. Where an anchor has equal contexts, all but the first are removed whole.
   Where it has different ones, the first of each goes on.
3. Those contexts' texts are sorted by two-stage suffix sorting: suffixes
   smaller than their successors are sorted directly, the others are induced by
   scanning the buckets of first bytes.  Neighbours with a common prefix of
   ``LENGTH`` bytes are equal windows; all but the first are removed.
   An anchor of more than ``CROWD`` contexts goes another way: each of its
   windows becomes a context of its own and passes step 2 again, so no anchor
   gathers without bound in one task.
4. The removed runs meet the documents again and are cut out.

Documents travel twice, by a bucket of their key and subkey, with the records of each
bucket before them; no step holds more than a bucket's records and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import blobs
from pointloom.llm import textnum as tn
from pointloom.scratch import cut

LENGTH = 100
GRAM = 24
CHUNK = 2 << 20
#: Windows of a chunk whose anchors are found at once.
BLOCK = 1 << 15
#: Positions are packed into this many bits beside the gram's hash.
PLACE = 24
#: Longer texts are worked on in pieces of this many bytes.
PIECE = 8 << 20
#: Contexts of one anchor sorted together at most.
CROWD = 4096
#: Bytes sorted together.
SLAB = 1 << 20
#: Bytes of text for each bucket of records, and of documents.
PER_BUCKET, PER_DOCS = 24 << 20, 8 << 20
FIRST_KEY = -(1 << 63)
RECORDS = "kind int, bucket int, blob binary"
#: Kinds of rows.
MET, GONE, SORT, SPLIT = 0, 1, 2, 3


# --- suffix sorting ---------------------------------------------------------


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number; zeros follow the text."""
    n = len(text)
    wide = np.zeros(n + 8 + LENGTH + 16, np.uint8)
    wide[:n] = text
    out = np.zeros(n + LENGTH + 16, np.uint64)
    for k in range(8):
        out |= wide[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the suffix after it (the last is not)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # the end is smaller than anything
    places = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(places[::-1])[::-1]
    return step[following] > 0


def direct_sort(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by ``depth`` bytes; equal ones stay in their order."""
    rounds = -(-depth // 8)
    order = np.argsort(words[places], kind="stable")
    places = places[order]
    key = words[places]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(places) else np.zeros(0, np.int64)
    for k in range(1, rounds):
        tied = np.zeros(len(places), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        own = np.flatnonzero(tied)
        if not len(own):
            break
        key, within = words[places[own] + 8 * k], group[own]
        order = np.lexsort((key, within))
        places[own] = places[own][order]
        key = key[order]
        # a group splits where the next word differs; ids stay increasing in place
        differs = np.zeros(len(places), bool)
        differs[1:] = group[1:] != group[:-1]
        inner = np.concatenate(([False], (key[1:] != key[:-1]) & (within[1:] == within[:-1])))
        differs[own[inner]] = True
        group = np.cumsum(differs)
    return places


def two_stage(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``text`` ordered by their first ``depth`` bytes at least.

    Suffixes smaller than their successors are sorted directly.  The others come
    by a scan over buckets of the first byte, from the smallest: a suffix that
    is larger than its successor takes the next free place of its own bucket
    when the scan meets the successor.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words_at(text) if words is None else words
    small = smaller_than_next(text)
    direct = direct_sort(np.flatnonzero(small), words, depth)
    counts = np.bincount(text[direct], minlength=256)
    starts = np.concatenate(([0], np.cumsum(counts)))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[int(text[-1])].append(np.array([n - 1]))  # the last suffix follows the end, which comes first
    done = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        induced = pending[c]
        fresh = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        parts = [fresh]
        while len(fresh):  # runs of one byte: the suffix before a larger one of the same bucket
            before = fresh[fresh > 0] - 1
            fresh = before[(text[before] == c) & ~small[before]]
            parts.append(fresh)
        bucket = np.concatenate((*parts, direct[starts[c] : starts[c + 1]]))
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = tn.runs(first)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                pending[int(first[a])].append(before[a:b])
    return np.concatenate(done)


def common_prefixes(order: np.ndarray, words: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to ``cap``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    left, right, own = order[:-1], order[1:], np.arange(1, len(order))
    for k in range(-(-cap // 8)):
        apart = words[left + 8 * k] ^ words[right + 8 * k]
        for byte in range(8):
            out[own] += (apart >> np.uint64(56 - 8 * byte)) == 0
        same = apart == 0
        left, right, own = left[same], right[same], own[same]
        if not len(own):
            break
    return np.minimum(out, cap)


# --- anchors ----------------------------------------------------------------


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(keys)
    blocks = -(-n // width) + 1
    wide = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = keys
    grid = wide.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
    """(anchor, hash, row, start in the row, windows) of each context of a buffer.

    Windows are met in blocks of ``block``, as each takes some 80 bytes of memory.
    A block has one window before its own, so that a context from the block before
    is not begun again, and those after it that its last context may reach.
    """
    n = len(data)
    found = []
    for at in range(0, max(n - LENGTH + 1, 1), block):
        low, high = max(at - 1, 0), min(at + block + 2 * LENGTH - GRAM, n)
        head = int(np.searchsorted(offsets, low, "right")) - 1 if n else 0
        tail = int(np.searchsorted(offsets, high)) if n else len(offsets) - 1
        own = np.clip(offsets[head : tail + 1], low, high) - low
        anchor, content, row, first, windows = _contexts(data[low:high], own)
        begun = (first >= at - low) & (first < at + block - low)
        anchor, content, row, first, windows = (c[begun] for c in (anchor, content, row, first, windows))
        row = row + head
        found.append((anchor, content, row, first + low - offsets[row], windows))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _contexts(data: np.ndarray, offsets: np.ndarray):
    """:func:`contexts` of a block, with starts in the block."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(tn.U), none.view(tn.U), none, none, none
    sums = tn.Sums(data)
    place = np.arange(n - GRAM + 1)
    gram = sums.spans(place, place + GRAM)
    mask = tn.U((1 << PLACE) - 1)
    least = _sliding_least((gram & ~mask) | place.astype(tn.U), LENGTH - GRAM + 1)
    anchor = (least & mask).astype(np.int64)
    start = np.arange(n - LENGTH + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    inside = start + LENGTH <= offsets[1:][row]
    start, anchor, row = start[inside], anchor[inside], row[inside]
    if not len(start):
        return none.view(tn.U), none.view(tn.U), none, none, none
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    at = np.flatnonzero(fresh)
    windows = np.diff(np.concatenate((at, [len(start)])))
    first, anchor, row = start[at], anchor[at], row[at]
    content = tn.mix(sums.spans(first, first + windows + LENGTH - 1) + (anchor - first).astype(tn.U))
    return gram[anchor], content, row, first, windows


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, keys, subkeys, first byte) of a batch; very long texts in overlapping pieces."""
    data, offsets = tn.packed(batch.column("text"))
    key, sub = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
    if len(data) <= PIECE:
        yield data, offsets, key, sub, np.zeros(len(key), np.int64)
        return
    for k in range(len(key)):
        own = data[offsets[k] : offsets[k + 1]]
        for at in range(0, max(len(own), 1), PIECE):
            part = own[at : at + PIECE + LENGTH - 1]
            yield part, np.array([0, len(part)]), key[k : k + 1], sub[k : k + 1], np.array([at])


def _decide(anchor, content, key, sub, start, windows):
    """Order records, each once (rows of one key and text have equal ones); (columns, first of its anchor and content)."""
    order = np.lexsort((start, sub, key, content, anchor))
    columns = [c[order] for c in (anchor, content, key, sub, start, windows)]
    fresh = _fresh(columns[:5])
    columns = [c[fresh] for c in columns]
    anchor, content = columns[:2]
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    return columns, first


def _fresh(columns: list[np.ndarray]) -> np.ndarray:
    """Rows that differ from the one before in some column."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _doc_bucket(key: np.ndarray, sub: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document; the texts of one key are spread over all."""
    return blobs.bucket_of(tn.mix((key.view(tn.U) + tn.U(77)) ^ tn.mix(sub.view(tn.U))), buckets)


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], names=["kind", "bucket", "blob"])


def _local(columns, first, buckets: int, doc_buckets: int) -> pa.RecordBatch:
    """Records that are first in a chunk, by bucket; the others are gone, by bucket of documents."""
    anchor, content, key, sub, start, windows = columns
    keep = np.flatnonzero(first)
    met = [anchor[keep], content[keep], key[keep], sub[keep], start[keep], windows[keep].astype(np.uint8)]
    out = [(MET, b, blob) for b, blob in blobs.dealt(blobs.bucket_of(tn.mix(met[0]), buckets), met)]
    out += _gone(*(c[~first] for c in (key, sub, start, windows)), doc_buckets)
    return _rows(out)


def _gone(key, sub, start, windows, doc_buckets: int) -> list[tuple[int, int, bytes]]:
    columns = [key, sub, start, start + windows + (LENGTH - 1)]
    order = np.lexsort((start, sub, key))
    columns = [c[order] for c in columns]
    return [(GONE, b, blob) for b, blob in blobs.dealt(_doc_bucket(columns[0], columns[1], doc_buckets), columns, (0, 2))]


def _anchored(docs: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.sliced(batches, "text", CHUNK):
            for data, offsets, key, sub, base in _pieces(batch):
                anchor, content, row, start, windows = contexts(data, offsets)
                yield _local(*_decide(anchor, content, key[row], sub[row], start + base[row], windows), buckets, doc_buckets)

    return docs.mapInArrow(run, RECORDS)


def _by_bucket(work):
    """Gather the values of each (bucket, kind) of a partition sorted by bucket and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
                if kind != MET:
                    yield _rows([(kind, bucket, blob)])
                    continue
                if bucket != at and parts:
                    yield from work(parts)
                    parts = []
                at = bucket
                parts.append(blob)
        if parts:
            yield from work(parts)

    return run


def _settle(doc_buckets: int, crowd: int):
    """Of one bucket: later equal contexts are gone; first ones of mixed anchors go on."""

    def work(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns, first = _decide(*blobs.joined(parts))
        anchor, content, key, sub, start, windows = columns
        later = ~first
        out = _gone(*(c[later] for c in (key, sub, start, windows)), doc_buckets)
        heads = np.flatnonzero(first)
        cuts = tn.runs(anchor[heads])
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        for kind, own in ((SORT, heads[(size > 1) & (size <= crowd)]), (SPLIT, heads[size > crowd])):
            rows = [anchor[own], key[own], sub[own], start[own], windows[own]]
            order = np.lexsort((rows[3], rows[2], rows[1]))
            rows = [r[order] for r in rows]
            out += [(kind, b, blob) for b, blob in blobs.dealt(_doc_bucket(rows[1], rows[2], doc_buckets), rows, (1,))]
        yield _rows(out)

    return work


def _meet(records: DataFrame, buckets: int, doc_buckets: int, crowd: int) -> DataFrame:
    """Settle all buckets of records."""
    dealt = records.repartition(min(buckets, 1 << 16), "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(_by_bucket(_settle(doc_buckets, crowd)), RECORDS)


# --- documents and their records --------------------------------------------


def _with_records(docs: DataFrame, records: DataFrame, doc_buckets: int) -> DataFrame:
    """Documents after the records of their bucket, in partitions by bucket."""
    more = [f for f in docs.schema if f.name not in ("key", "sub", "text")]
    spread = docs.select(F.lit(9).alias("kind"), _sql_bucket(doc_buckets).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "key", "sub", "text", *(f.name for f in more))
    marked = records.select("kind", "bucket", "blob", F.lit(FIRST_KEY).alias("key"), F.lit(0).cast("long").alias("sub"), F.lit(None).cast("string").alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
    return spread.unionByName(marked).repartition(min(doc_buckets, 1 << 16), "bucket").sortWithinPartitions("bucket", "kind")


def _sql_bucket(doc_buckets: int):
    """:func:`_doc_bucket` of the columns ``key`` and ``sub``, worked out by a small Arrow UDF."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def bucket(key: pa.Array, sub: pa.Array) -> pa.Array:
        return pa.array(_doc_bucket(key.to_numpy(), sub.to_numpy(), doc_buckets).astype(np.int32))

    return bucket("key", "sub")


def _streamed(work):
    """Call ``work(records by kind, batch of documents)`` for the documents of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, loaded = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            cuts = tn.runs(bucket)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if bucket[a] != at:
                    at, held, loaded = bucket[a], [], None
                part = batch.slice(a, b - a)
                kind = part.column("kind").to_numpy()
                records = int(np.searchsorted(kind, 9))
                if records:
                    held += zip(kind[:records].tolist(), part.column("blob").slice(0, records).to_pylist(), strict=True)
                if records < len(kind):
                    if loaded is None:
                        loaded = _sorted_records(held)
                        held = []
                    for piece in tn.sliced(iter([part.slice(records)]), "text", CHUNK):
                        yield from work(loaded, piece)

    return run


def _sorted_records(held: list[tuple[int, bytes]]) -> dict[int, tuple]:
    """By kind: columns ordered by key and subkey, and the range of each."""
    out = {}
    for kind in {k for k, _ in held}:
        columns = blobs.joined([b for k, b in held if k == kind])
        shift = 0 if kind == GONE else 1
        order = np.lexsort((columns[shift + 1], columns[shift]))
        columns = [c[order] for c in columns]
        key, sub = columns[shift], columns[shift + 1]
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1).tolist(), len(key)]
        out[kind] = columns, {(int(key[a]), int(sub[a])): (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
    return out


def _own(loaded: dict, kind: int, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray] | None:
    """Records of a kind for the rows of a batch, and each one's row."""
    if kind not in loaded:
        return None
    columns, ranges = loaded[kind]
    found = [(k, ranges[at]) for k, at in enumerate(zip(batch.column("key").to_pylist(), batch.column("sub").to_pylist(), strict=True)) if at in ranges]
    if not found:
        return None
    index = np.concatenate([np.arange(a, b) for _, (a, b) in found])
    row = np.repeat([k for k, _ in found], [b - a for _, (a, b) in found])
    return [c[index] for c in columns], row


TEXTS = "kind int, bucket int, blob binary, texts binary"


def _cut_out(buckets: int, doc_buckets: int):
    """Texts of the contexts to sort, by bucket; windows of crowded anchors as contexts of their own."""

    def work(loaded: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = tn.packed(batch.column("text"))
        out: list[tuple[int, int, bytes, bytes | None]] = []
        if (got := _own(loaded, SORT, batch)) is not None:
            (anchor, key, sub, start, windows), row = got
            which = blobs.bucket_of(tn.mix(anchor), buckets)
            order = np.lexsort((anchor, which))
            which = which[order]
            columns = [c[order] for c in (anchor, key, sub, start, windows)]
            begin, size = (offsets[:-1][row] + start)[order], windows[order].astype(np.int64) + LENGTH - 1
            cuts = tn.runs(which)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                text = data[tn.ranges(begin[a:b], size[a:b])].tobytes()
                out.append((SORT, int(which[a]), blobs.dump([c[a:b] for c in columns], ()), zstandard.ZstdCompressor(level=1).compress(text)))
        if (got := _own(loaded, SPLIT, batch)) is not None:
            (_, key, sub, start, windows), row = got
            count = windows.astype(np.int64)
            at = tn.ranges(start, count)
            row, key, sub = (np.repeat(c, count) for c in (row, key, sub))
            sums = tn.Sums(data)
            begin = offsets[:-1][row] + at
            whole, half = sums.spans(begin, begin + LENGTH), sums.spans(begin + LENGTH // 2, begin + LENGTH)
            columns, first = _decide(whole, half, key, sub, at, np.ones(len(at), np.uint8))
            local = _local(columns, first, buckets, doc_buckets)
            out += [(k, b, v, None) for k, b, v in zip(*(local.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True)]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["kind", "bucket", "blob", "texts"])

    return work


def repeated_windows(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts (places of ``text``) of windows that equal one of smaller rank.

    ``begin`` and ``windows`` are the contexts laid out in ``text``, a byte 255
    after each; ``rank`` orders contexts, places order windows within one.
    """
    words = words_at(text)
    order = two_stage(text, LENGTH, words)
    valid = np.zeros(len(text), bool)
    valid[tn.ranges(begin, windows)] = True
    order = order[valid[order]]
    if not len(order):
        return order
    equal = common_prefixes(order, words, LENGTH) >= LENGTH
    group = np.cumsum(~equal)
    context = np.searchsorted(begin, order, "right") - 1
    inner = np.lexsort((order, rank[context], group))
    order, group = order[inner], group[inner]
    later = np.concatenate(([False], group[1:] == group[:-1]))
    return np.sort(order[later])


def _sort_bucket(doc_buckets: int, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def work() -> Iterator[pa.RecordBatch]:
            anchor, key, sub, start, windows = blobs.joined([b for b, _ in parts])
            tool = zstandard.ZstdDecompressor()
            raw = np.concatenate([np.frombuffer(tool.decompress(t), np.uint8) for _, t in parts])
            size = windows.astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((start, sub, key, anchor))
            order = order[_fresh([c[order] for c in (anchor, key, sub, start)])]
            anchor, key, sub, start, windows, size, begin = (c[order] for c in (anchor, key, sub, start, windows, size, begin))
            heads = tn.runs(anchor)
            ends = np.cumsum(size + 1)
            a = 0
            while a < len(heads) - 1:  # whole anchors, up to a slab of text
                done = ends[heads[a] - 1] if heads[a] else 0
                b = max(a + 1, int(np.searchsorted(ends[heads[1:] - 1], done + slab, "right")))
                own = slice(heads[a], heads[b])
                text = np.full(int(size[own].sum()) + (heads[b] - heads[a]), 255, np.uint8)
                place = np.cumsum(size[own] + 1) - (size[own] + 1)
                text[tn.ranges(place, size[own])] = raw[tn.ranges(begin[own], size[own])]
                # contexts are in the order of key and start within an anchor; windows of two anchors never agree
                found = repeated_windows(text, place, windows[own].astype(np.int64), np.arange(heads[b] - heads[a]))
                if len(found):
                    context = np.searchsorted(place, found, "right") - 1
                    first = start[own][context] + found - place[context]
                    yield _rows(_gone(key[own][context], sub[own][context], first, np.ones(len(first), np.int64), doc_buckets))
                a = b

        for batch in batches:
            for bucket, blob, texts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "blob", "texts")), strict=True):
                if bucket != at and parts:
                    yield from work()
                    parts = []
                at = bucket
                parts.append((blob, texts))
        if parts:
            yield from work()

    return run


RESULT = "key long, sub long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(data: np.ndarray, offsets: np.ndarray, got) -> np.ndarray:
    edge = np.zeros(len(data) + 1, np.int32)
    if got is not None:
        (_, _, start, end), row = got
        np.add.at(edge, offsets[:-1][row] + start, 1)
        np.add.at(edge, offsets[:-1][row] + end, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(loaded: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = tn.packed(batch.column("text"))
    gone = _removed(data, offsets, _own(loaded, GONE, batch))
    total = np.concatenate(([0], np.cumsum(gone)))
    fresh = gone.copy()
    fresh[1:] &= ~gone[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    fresh[heads] = gone[heads]
    runs = np.concatenate(([0], np.cumsum(fresh)))
    kept, left = data[~gone].tobytes(), offsets - total[offsets]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    columns = [batch.column("key"), batch.column("sub"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])), pa.array(digests)]
    yield pa.RecordBatch.from_arrays(columns, names=["key", "sub", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keep(loaded: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = tn.packed(batch.column("text"))
    gone = _removed(data, offsets, _own(loaded, GONE, batch))
    total = np.concatenate(([0], np.cumsum(gone)))
    kept, left = data[~gone].tobytes(), offsets - total[offsets]
    texts = [kept[a:b].decode("utf-8", "ignore") for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    columns = [batch.column("rest"), pa.array(texts, pa.string())]
    yield pa.RecordBatch.from_arrays(columns, names=["rest", "text"])


def keyed(docs: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """``key`` (null: the least), ``sub`` and ``text``; with ``whole`` the other columns as ``rest``.

    Rows equal in key and text are one document and have one result; different
    texts of one key have their 64-bit hash as ``sub``, so a key may have any number.
    """
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)).alias("key"), F.col(text).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("rest")] if whole else []))
    repeated = base.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    # a null text has the hash of no columns, which is not null
    return base.withColumn("sub", F.xxhash64("text") if repeated else F.lit(0).cast("long"))


def _gone_records(docs: DataFrame, crowd: int, slab: int) -> tuple[DataFrame, int]:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets, doc_buckets = max(8, -(-size // PER_BUCKET)), max(8, -(-size // PER_DOCS))
    met = cut(_meet(_anchored(docs, buckets, doc_buckets), buckets, doc_buckets, crowd))
    onward = met.where(F.col("kind").isin(SORT, SPLIT))
    gone = met.where(F.col("kind") == GONE)
    if onward.limit(1).count():
        parts = _with_records(docs, onward, doc_buckets).mapInArrow(_streamed(_cut_out(buckets, doc_buckets)), TEXTS)
        split = met.where(F.col("kind") == SPLIT).limit(1).count() > 0
        if split:  # read twice
            parts = cut(parts)
        dealt = parts.where(F.col("kind") == SORT).repartition(min(buckets, 1 << 16), "bucket").sortWithinPartitions("bucket")
        gone = gone.unionByName(dealt.mapInArrow(_sort_bucket(doc_buckets, slab), RECORDS))
        if split:
            crowded = parts.where(F.col("kind") != SORT).select("kind", "bucket", "blob")
            gone = gone.unionByName(_meet(crowded, buckets, doc_buckets, 1 << 40).where(F.col("kind") == GONE))
    return gone, doc_buckets


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD, slab: int = SLAB) -> DataFrame:
    """``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every document.

    Null text is empty, a null key counts as the least.  Repeated rows of equal
    key and text are one document: each gets the same result, and they do not
    remove one another.
    """
    base = keyed(docs, key, text)
    gone, doc_buckets = _gone_records(base, crowd, slab)
    out = _with_records(base, gone, doc_buckets).mapInArrow(_streamed(_measure), RESULT)
    return out.select(F.when(F.col("key") != FIRST_KEY, F.col("key")).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD, slab: int = SLAB) -> DataFrame:
    """All documents with repeated strings cut out of ``text``; columns as they came.

    Bytes of characters that a removed run cuts apart go too, so texts stay
    UTF-8.  Null text becomes empty.
    """
    base = keyed(docs, key, text, True)
    gone, doc_buckets = _gone_records(base.select("key", "sub", "text"), crowd, slab)
    kept = _with_records(base, gone, doc_buckets).mapInArrow(_streamed(_keep), T.StructType([base.schema["rest"], T.StructField("text", T.StringType())]))
    return kept.select(*(F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes of all documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
