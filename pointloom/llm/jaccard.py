"""Exact Jaccard join of word 5-gram sets by universe partition.

A pair with similarity of at least 3/4 differs in at most ``(|x| + |y|) / 7``
tokens.  Sizes fall into bands; for the band of the larger set, tokens are
hashed into segments whose allocations sum to more than the largest difference
``H`` possible there.  By the pigeonhole principle a pair then agrees in a
segment of allocation 1 (equal), or differs by at most one token in a segment
of allocation 2 (found among the one-deletion neighbourhoods).  A cost model
per band picks how many segments have allocation 2 for sets of at most ``SMALL``
tokens; above, none has, and the spare segments are a fixed share (``SPARE``).

Spare segments allow skipping: with ``s`` spare ones a pair agrees in more than
``s``, so each set may leave out the last ``s`` of its unselective segments
(empty ones, and those whose signature is frequent) in one fixed order: the
first of those that a pair shares is then indexed by both.

Signatures meet in buckets.  A signature of few sets gives their pairs.  One of
many sets gives one link from each set to the smallest key.  Pairs are cut by
an exact bound on token histograms, then verified on whole texts, word by word.
Where, after skipping, different components still meet in a frequent signature,
their sets meet in blocks of bounded size: overlaps are counted in a block at
once, and only links that join components come out (:func:`joining_links`), so
no pairs are written.  Sets that are equal have one fingerprint and one node.
Components are found by alternating star contractions of the links, in tables;
nothing that grows with the input reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import blobs
from pointloom.llm import textnum as tn
from pointloom.scratch import cut

SHINGLE = 5
#: Similarity of at least 3/4.
NUMERATOR, DENOMINATOR = 3, 4
CHUNK = 2 << 20
#: Bands grow by this factor.
GROWTH = 1.25
#: Cost of an unselective segment in signatures.
PENALTY = 20.0
#: Spare segments of bands of larger sets, as shares of the largest difference.
SPARE = (0.6,)
#: Sets of more tokens have no segments of allocation 2: those cannot be skipped, and a frequent token beside
#: another is left alone by a deletion.  With them in all bands, 0.1 GB of documents had 2.16 million members
#: of frequent signatures in place of 0.31 million, and 270,000 sets that meet other components, not 2,400.
SMALL = 12
#: A signature of more sets is frequent.
FREQUENT = 6
#: Signatures that a bucket holds, about.
BUCKET = 1_500_000
#: Tokens that a block of sets holds, about; a set counts as ``LEAST`` tokens at least.
HELD, LEAST = 200_000, 100
#: Tokens of at most so many sets are counted by pairs, others by products of so many columns at once.
LIGHT, TILE = 16, 2048
#: Shingles compared byte by byte at a time.
COMPARED = 1 << 15
#: Bytes that separate words.
INSIDE = np.ones(256, bool)
INSIDE[[32, 9, 10, 11, 12, 13]] = False


class Scheme:
    """Segments for pairs whose larger set is in ``[low, high]``."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.least = -(-NUMERATOR * low // DENOMINATOR)
        self.apart = 2 * high * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        best = None
        for deletions in range((self.apart + 2) // 2 + 1 if high <= SMALL else 1):
            for spare in [math.ceil(share * self.apart) for share in SPARE] if high > SMALL else [0]:
                exact = max(0, self.apart + 1 + spare - 2 * deletions)
                segments = exact + deletions
                each = self.least / segments
                # of the band's smallest sets: segments of at most one token that no spare one makes up
                # for, and segments of allocation 2 that a deletion leaves so
                few = math.exp(-each) * (1 + each)
                bare = max(0.0, exact * few - spare) + deletions * (few + math.exp(-each) * each * each / 2)
                cost = exact + deletions * (1 + high / segments) + PENALTY * bare
                if best is None or cost < best[0]:
                    best = (cost, exact, deletions, spare)
        _, self.exact, self.deletions, self.spare = best
        self.segments = self.exact + self.deletions


@lru_cache(maxsize=1)
def schemes(longest: int = 1 << 40) -> tuple[list[Scheme], np.ndarray]:
    """All schemes up to sets of ``longest`` tokens, and the bands' lower ends."""
    out, low = [Scheme(1, 3)], 4
    while low <= longest:
        high = max(low + 2, int(low * GROWTH))
        if low > 1 << 24:  # texts of over 16 million words: one scheme each doubling keeps the list short
            high = 2 * low
        out.append(_Late(low, high))
        low = high + 1
    return out, np.array([s.low for s in out], np.int64)


class _Late(Scheme):
    """A scheme whose allocation is worked out when first needed."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self._done = low, high, False

    def __getattr__(self, name: str):
        if name.startswith("__") or self.__dict__.get("_done"):
            raise AttributeError(name)
        self._done = True
        Scheme.__init__(self, self.low, self.high)
        return getattr(self, name)


class Sets:
    """The sets of distinct 5-word shingles of many texts.

    Texts with fewer words have one shingle of all their words; without words none.
    ``token`` has the shingles' hashes in the order of rows and hashes, ``row``
    their rows, ``n`` the sets' sizes, ``word`` and ``width`` where the words of a
    shingle's first occurrence are among ``start`` and ``end``, places of ``low``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = tn.lower_ascii(data)
        self.start, self.end, first = tn.words(self.low, offsets, INSIDE)
        hashes = tn.Sums(self.low).spans(self.start, self.end)
        up, down = tn.powers(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, tn.U)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        counts = np.diff(first)
        size = np.minimum(counts, SHINGLE)
        per = np.where(counts > 0, counts - size + 1, 0)
        row = np.repeat(np.arange(len(counts)), per)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + first[row]
        width = size[row]
        tokens = tn.mix((sums[begin + width] - sums[begin]) * down[begin] + width.astype(tn.U))
        order = np.lexsort((tokens, row))
        tokens, row = tokens[order], row[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
        order = order[keep]
        self.token, self.row, self.word, self.width = tokens[keep], row[keep], begin[order], width[order]
        self.n = np.bincount(self.row, minlength=len(counts))
        self.first = np.cumsum(self.n) - self.n

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of rows ``i`` with rows ``j``: equal hashes, then equal words, byte by byte."""
        ni, nj = self.n[i], self.n[j]
        entry = np.concatenate((tn.ranges(self.first[i], ni), tn.ranges(self.first[j], nj)))
        pair = np.concatenate((np.repeat(np.arange(len(i)), ni), np.repeat(np.arange(len(j)), nj)))
        order = np.lexsort((self.token[entry], pair))
        entry, pair = entry[order], pair[order]
        met = np.flatnonzero((pair[1:] == pair[:-1]) & (self.token[entry[1:]] == self.token[entry[:-1]]))
        x, y, pair = entry[met], entry[met + 1], pair[met]
        good = self.width[x] == self.width[y]
        x, y, pair = x[good], y[good], pair[good]
        wrong = np.zeros(len(x), bool)
        for at in range(0, len(x), COMPARED):  # places of all bytes are many times the text, so some at a time
            wrong[at : at + COMPARED] = self._differ(x[at : at + COMPARED], y[at : at + COMPARED])
        return np.bincount(pair[~wrong], minlength=len(i))

    def _differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether shingles ``x`` and ``y`` of as many words differ in some byte of a word."""
        width = self.width[x]
        a, b, of = tn.ranges(self.word[x], width), tn.ranges(self.word[y], width), np.repeat(np.arange(len(x)), width)
        size = self.end[a] - self.start[a]
        wrong = np.zeros(len(x), bool)
        wrong[of[size != self.end[b] - self.start[b]]] = True
        own = ~wrong[of]
        a, b, of, size = a[own], b[own], of[own], size[own]
        apart = self.low[tn.ranges(self.start[a], size)] != self.low[tn.ranges(self.start[b], size)]
        wrong[np.repeat(of, size)[apart]] = True
        return wrong


def token_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct 5-word shingles of each row, their rows, and the sets' sizes."""
    sets = Sets(data, offsets)
    return sets.token, sets.row, sets.n


def similar(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of ``x`` and ``y`` tokens that share ``both`` are linked."""
    return (both > 0) & (DENOMINATOR * both >= NUMERATOR * (x + y - both))


def _bits(n: np.ndarray) -> np.ndarray:
    """Of sets of ``n`` tokens, the histograms have two to the power of this many cells."""
    return np.maximum(np.frexp(n.astype(float))[1], 2)


def _histograms(tokens: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Compressed counts of each set's tokens by their upper bits, at most 255 in a cell."""
    bits = _bits(n)
    sizes = 1 << bits
    base = np.cumsum(sizes) - sizes
    at = base[row] + (tokens >> (64 - bits[row]).astype(tn.U)).astype(np.int64)
    table = np.minimum(np.bincount(at, minlength=int(sizes.sum())), 255).astype(np.uint8).tobytes()
    tool = zstandard.ZstdCompressor(level=1)
    return [tool.compress(table[a : a + k]) for a, k in zip(base.tolist(), sizes.tolist(), strict=True)]


def _apart(x: bytes, y: bytes, tool) -> int:
    """Sum of differences of two histograms, the finer folded to the coarser: never above the sets' difference."""
    x, y = (np.frombuffer(tool.decompress(v), np.uint8).astype(np.int32) for v in (x, y))
    least = min(len(x), len(y))
    return int(np.abs(x.reshape(least, -1).sum(1) - y.reshape(least, -1).sum(1)).sum())


def _print(tokens: np.ndarray, row: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """64-bit fingerprint of each row's set."""
    total = np.zeros(rows, tn.U)
    np.add.at(total, row, tn.mix(tokens ^ tn.U(salt)))
    return tn.mix(total).view(np.int64)


#: Salts of the two fingerprints; the first names a set among the signatures.
SALTS = (0x1234567, 0x89ABCDEF1)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, 128-bit ``print_a``/``print_b`` and the histogram ``cells`` of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.sliced(batches, "text", CHUNK):
            tokens, row, n = token_sets(*tn.packed(batch.column("text")))
            prints = [_print(tokens, row, batch.num_rows, salt) for salt in SALTS]
            cells = _histograms(tokens, row, n)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, prints), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "print_a", "print_b", "cells"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print_a long, print_b long, cells binary")


def signatures(tokens: np.ndarray, row: np.ndarray, n: np.ndarray):
    """(signature, row, scheme, empties) of all indexed segments; scheme is negative for deletions."""
    table, lows = schemes()
    own = np.searchsorted(lows, n, "right") - 1
    top = np.searchsorted(lows, n * DENOMINATOR // NUMERATOR, "right") - 1
    out = []
    for step in range(int((top - own).max(initial=-1)) + 1):
        part = np.flatnonzero((n > 0) & (own + step <= top))
        if not len(part):
            continue
        which = own[part] + step
        kinds = {int(b): table[b] for b in np.unique(which)}
        get = lambda name: np.array([getattr(kinds[b], name) for b in which.tolist()], np.int64)  # noqa: E731, B023
        segments, exact, spare = get("segments"), get("exact"), get("spare")
        base = np.cumsum(segments) - segments
        place = np.full(len(n), -1, np.int64)
        place[part] = np.arange(len(part))
        mine = place[row] >= 0
        local, token = place[row[mine]], tokens[mine]
        salt = tn.mix((which + 1).astype(tn.U) * tn.U(0x9E3779B97F4A7C15))
        seat = ((tn.mix(token ^ salt[local]) >> tn.U(32)) * segments[local].astype(tn.U) >> tn.U(32)).astype(np.int64)
        at = base[local] + seat
        total = np.zeros(int(segments.sum()), tn.U)
        worth = tn.mix(token + tn.U(0xABCDEF))
        np.add.at(total, at, worth)
        owner = np.repeat(np.arange(len(part)), segments)
        segment = np.arange(len(total)) - base[owner]
        tag = tn.mix(salt[owner] + segment.astype(tn.U))
        filled = np.zeros(len(total), bool)
        filled[at] = True
        empty = ~filled & (segment < exact[owner])
        empties = np.bincount(owner[empty], minlength=len(part))
        # of its empty segments a set leaves out the last ones, up to the spare count
        before = np.cumsum(empty) - empty
        rank = before - before[base][owner]
        skipped = empty & (rank >= (empties - spare)[owner])
        kept = np.flatnonzero(~skipped)
        full = tn.mix(total + tag)
        out.append((full[kept], part[owner[kept]], np.where(segment[kept] < exact[owner[kept]], which[owner[kept]] + 1, -which[owner[kept]] - 1), empties[owner[kept]]))
        loose = np.flatnonzero(seat >= exact[local])
        if len(loose):
            place_of = at[loose]
            out.append((tn.mix(total[place_of] - worth[loose] + tag[place_of]), part[local[loose]], -which[local[loose]] - 1, empties[local[loose]]))
    if not out:
        return np.zeros(0, tn.U), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _indexed(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures of all sets by bucket, as packed columns; a set is named by its first fingerprint.

    Equal sets have equal records, so copies merge: in a chunk before the
    shuffle, and for good where their signatures meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.sliced(batches, "text", CHUNK):
            tokens, row, n = token_sets(*tn.packed(batch.column("text")))
            doc = _print(tokens, row, batch.num_rows, SALTS[0])
            once = np.zeros(len(doc), bool)
            once[np.unique(doc, return_index=True)[1]] = True
            kept = once[row]
            tokens, row, n = tokens[kept], row[kept], np.where(once, n, 0)
            sign, owner, scheme, empties = signatures(tokens, row, n)
            order = np.argsort(doc[owner], kind="stable")
            sign, owner, scheme, empties = sign[order], owner[order], scheme[order], empties[order]
            bytes6 = sign.view(np.uint8).reshape(-1, 8)[:, :6]
            columns = [doc[owner], n[owner].astype(np.int32), scheme.astype(np.int16), empties.astype(np.uint32), *(np.ascontiguousarray(bytes6[:, 2 * k : 2 * k + 2]).view(np.uint16).ravel() for k in range(3))]
            got = list(blobs.dealt(blobs.bucket_of(sign, buckets), columns, (0,)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([v for _, v in got], pa.binary())], names=["bucket", "blob"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "bucket int, blob binary")


MET = "kind int, bucket int, blob binary"
PAIRS = "kind int, a long, b long, scheme int, sign long"


def _meet(second: int):
    """Of one bucket: pairs and links to the smallest key (kind 0), members of frequent signatures (1).

    Both are dealt on to ``second`` buckets of the first key.
    """

    def work(parts: list[bytes], bucket: int) -> pa.RecordBatch:
        doc, n, scheme, empties, *low = blobs.joined(parts)
        sign = low[0].astype(np.int64) | low[1].astype(np.int64) << 16 | low[2].astype(np.int64) << 32
        order = np.lexsort((doc, sign))
        keep = np.ones(len(order), bool)
        keep[1:] = (sign[order][1:] != sign[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        sign, doc, n, scheme, empties = (c[order[keep]] for c in (sign, doc, n, scheme, empties))
        cuts = tn.runs(sign)
        size = np.diff(cuts)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return NUMERATOR * np.maximum(n[i], n[j]).astype(np.int64) <= DENOMINATOR * np.minimum(n[i], n[j]).astype(np.int64)

        a_parts, b_parts = [], []
        for count in np.unique(size[(size > 1) & (size <= FREQUENT)]).tolist():
            first = cuts[:-1][size == count]
            i, j = np.triu_indices(count, 1)
            left, right = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            good = near(left, right)
            a_parts.append(doc[left[good]])
            b_parts.append(doc[right[good]])
        large = np.flatnonzero(size > FREQUENT)
        members = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in large]) if len(large) else np.zeros(0, np.int64)
        heads = np.repeat(cuts[:-1][large], size[large])
        good = (members != heads) & near(members, heads)
        a_parts.append(doc[heads[good]])
        b_parts.append(doc[members[good]])
        a, b = _distinct(np.concatenate(a_parts), np.concatenate(b_parts))
        out = [(0, k, v) for k, v in blobs.dealt(_seat(a, second), [a, b], (0,))]
        # the signature is told from others of the same 48 bits by its bucket, whose bits come above
        rows = [doc[members], n[members], scheme[members], empties[members], sign[members] | (bucket & 0x7FFF) << 48, np.repeat(size[large], size[large]).astype(np.int32)]
        order = np.argsort(rows[0], kind="stable")
        rows = [r[order] for r in rows]
        out += [(1, k, v) for k, v in blobs.dealt(_seat(rows[0], second), rows, (0,))]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["kind", "bucket", "blob"])

    return work


def _seat(key: np.ndarray, buckets: int) -> np.ndarray:
    return blobs.bucket_of(tn.mix(key.view(tn.U)), buckets)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _narrow(spares: np.ndarray):
    """Distinct pairs, and members of frequent signatures that their sets may not skip.

    Of its frequent signatures a set skips the most frequent ones (ties by the
    signature; empty segments go before all), as far as its spare segments go.
    """

    def work(parts: list[tuple[int, bytes]], _: int) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        pairs, rest = ([v for k, v in parts if k == kind] for kind in (0, 1))
        a, b = _distinct(*blobs.joined(pairs)) if pairs else (none, none)
        doc = n = scheme = sign = none
        if rest:
            doc, n, scheme, empties, sign, often = blobs.joined(rest)
            order = np.lexsort((sign, often, scheme, doc))
            doc, n, scheme, empties, sign = (c[order] for c in (doc, n, scheme, empties, sign))
            last = np.ones(len(doc), bool)
            last[:-1] = (doc[1:] != doc[:-1]) | (scheme[1:] != scheme[:-1])
            ends = np.flatnonzero(last)
            after = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(doc)) + empties.astype(np.int64)
            keep = (scheme < 0) | (after >= spares[np.abs(scheme)])
            doc, n, scheme, sign = (c[keep] for c in (doc, n, scheme, sign))
        k, m = len(a), len(doc)
        columns = [np.repeat(np.array([0, 1], np.int32), [k, m]), np.concatenate((a, doc)), np.concatenate((b, n.astype(np.int64))), np.concatenate((np.zeros(k, np.int32), np.abs(scheme).astype(np.int32))), np.concatenate((np.zeros(k, np.int64), sign))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b", "scheme", "sign"])

    return work


def _by_bucket(work, kinds: bool = False):
    """Gather the values of each bucket of a partition sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            values = batch.column("blob").to_pylist()
            if kinds:
                values = list(zip(batch.column("kind").to_pylist(), values, strict=True))
            for bucket, value in zip(batch.column("bucket").to_pylist(), values, strict=True):
                if bucket != at and parts:
                    yield work(parts, at)
                    parts = []
                at = bucket
                parts.append(value)
        if parts:
            yield work(parts, at)

    return run


def candidates(docs: DataFrame, total: int) -> DataFrame:
    """Rows of :data:`PAIRS` for all sets; ``total`` is the number of tokens of all sets."""
    buckets = max(8, -(-total // BUCKET))
    second = max(8, buckets // 4)
    spares = np.array([0, *(s.spare for s in schemes()[0] if s.low <= max(total, 1))], np.int64)
    gather = lambda df, n: df.repartition(min(n, 1 << 16), "bucket").sortWithinPartitions("bucket")
    met = gather(_indexed(docs, buckets), buckets).mapInArrow(_by_bucket(_meet(second)), MET)
    return gather(met, second).mapInArrow(_by_bucket(_narrow(spares), True), PAIRS)


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of documents for pairs of fingerprints, where the histograms allow them.

    The sum of differences of the cells is at most the sets' difference.  Should
    different sets share a first fingerprint, each of them is paired.
    """
    left = classes.select(F.col("print_a").alias("x"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    right = classes.select(F.col("print_a").alias("y"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    pairs = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = pairs.join(left, "x").join(right, "y").select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = (na + nb) * (DENOMINATOR - NUMERATOR) // (NUMERATOR + DENOMINATOR)
            values = zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist(), most.tolist(), strict=True)
            good = pa.array([_apart(x, y, tool) <= limit for x, y, limit in values], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``docs`` whose sets are similar, from whole texts."""
    texts = docs.select("doc_id", "text")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half in tn.sliced(batches, "text", CHUNK // 2):
            for batch in tn.sliced(iter([half]), "other", CHUNK // 2):
                both = pa.concat_arrays([batch.column(c).cast(pa.large_string()) for c in ("text", "other")])
                sets, rows = Sets(*tn.packed(both)), np.arange(batch.num_rows)
                other = rows + batch.num_rows
                good = pa.array(similar(sets.shared(rows, other), sets.n[rows], sets.n[other]))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every key that has a link; the smallest key names a component.

    Alternates large-star and small-star steps until the links are stars; each
    round is written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    while before[0]:  # each round halves the links' depth
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id"))).distinct()


def _met(members: DataFrame, named: DataFrame) -> DataFrame:
    """``job, doc_id, weight, c``: sets that share a frequent signature with a set of another component ``c``.

    The largest component that meets in a signature is its job, so a set of a
    large group has one job however many signatures it shares with others.
    """
    kept = members.select("a", "scheme", "sign").join(named, "a")
    jobs = kept.groupBy("scheme", "sign").agg(F.max(F.struct("size", "c")).alias("_j"), F.min("c").alias("_l"), F.max("c").alias("_h")).where("_l < _h").select("scheme", "sign", F.col("_j.c").alias("job"))
    return kept.join(cut(jobs), ["scheme", "sign"]).select("job", "doc_id", F.greatest("n", F.lit(LEAST)).alias("weight"), "c").distinct()


def _blocks(met: DataFrame) -> DataFrame:
    """``job, i, j, side, doc_id, c``: the sets of each job in pairs of blocks of about ``HELD`` tokens.

    Sets of the job's own component are linked already and compared with the
    others only.  In a pair ``i = j`` the sets of side 0 are compared with one
    another and with side 1, else side 0 with side 1.
    """
    own = F.col("c") == F.col("job")
    weight = lambda cond: F.ceil(F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0)) / F.lit(HELD)).cast("int")
    sizes = met.groupBy("job").agg(F.greatest(weight(~own), F.lit(1)).alias("others"), F.greatest(weight(own), F.lit(1)).alias("owns"))
    seat = F.xxhash64("doc_id")
    own_block, block = F.pmod(seat, "owns").cast("int"), F.pmod(seat, "others").cast("int")
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    each = F.sequence(F.lit(0), F.col("others") - 1)
    among = F.transform(each, lambda k: at(F.least(k, block), F.greatest(k, block), F.when(block > k, 1).otherwise(0)))
    against = F.when(F.col("owns") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("owns") - 1, F.lit(1))), lambda k: at(block, F.col("others") + k, F.lit(0)))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    facing = F.transform(each, lambda k: at(k, F.when(own_block == 0, k).otherwise(F.col("others") + own_block), F.lit(1)))
    places = F.when(own, facing).otherwise(F.concat(among, against))
    return met.join(sizes, "job").select("job", "doc_id", "c", F.explode(places).alias("p")).select("job", "p.i", "p.j", "p.side", "doc_id", "c")


def _overlaps(sets: Sets, rows: slice, a: int) -> np.ndarray:
    """Numbers of shared tokens of the first ``a`` of the rows with all of them (0 with themselves)."""
    lo, hi = sets.first[rows.start], sets.first[rows.stop - 1] + sets.n[rows.stop - 1]
    m = rows.stop - rows.start
    token, row = sets.token[lo:hi], sets.row[lo:hi] - rows.start
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    cuts = tn.runs(token)
    often = np.diff(cuts)
    out = np.zeros((a, m), np.float32)
    light = LIGHT if m > LIGHT * LIGHT else 1
    for f in np.unique(often[(often > 1) & (often <= light)]).tolist():
        members = row[cuts[:-1][often == f][:, None] + np.arange(f)]
        for p in range(f):
            for q in range(f):
                if p != q:
                    x, y = members[:, p], members[:, q]
                    own = x < a
                    out += np.bincount(x[own] * m + y[own], minlength=a * m).reshape(a, m)
    heavy = np.flatnonzero(often > light)
    for k in range(0, len(heavy), TILE):
        part = heavy[k : k + TILE]
        grid = np.zeros((m, len(part)), np.float32)
        grid[row[tn.ranges(cuts[:-1][part], often[part])], np.repeat(np.arange(len(part)), often[part])] = 1
        out += grid[:a] @ grid.T
    out[np.arange(a), np.arange(a)] = 0
    return out


def linked_rows(sets: Sets, rows: slice, a: int, within: bool, c: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components ``c`` of the rows: the first ``a`` with the others, and ``within`` with one another.

    Links inside a component, given or found so far, are left out.
    """
    n = sets.n[rows].astype(np.float32 if sets.n[rows].max() < 1 << 20 else np.float64)  # products below stay exact
    link = similar(_overlaps(sets, rows, a), n[:a, None], n[None, :])
    if not within:
        link[:, :a] = False
    names, own = np.unique(c, return_inverse=True)
    out: list[tuple[int, int]] = []
    label = np.arange(len(names))
    i, j = np.nonzero(link)
    while len(i):
        apart = label[own[i]] != label[own[j]]
        i, j = i[apart], j[apart]
        if not len(i):
            break
        # one link of each pair of components, the least of each component first
        x, y = label[own[i]], label[own[j]]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        pick = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        good = similar(sets.shared(rows.start + i[pick], rows.start + j[pick]), n[i[pick]], n[j[pick]])
        drop = np.ones(len(i), bool)
        drop[pick] = False
        pick = pick[good]
        out += zip(i[pick].tolist(), j[pick].tolist(), strict=True)
        parent = np.arange(len(names))
        parent[high[pick]] = low[pick]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        i, j = i[drop], j[drop]
    return out


def _compare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Components that a link among the sets of whole pairs of blocks joins."""
    keys = [batch.column(k).to_numpy() for k in ("job", "i", "j")]
    fresh = np.ones(batch.num_rows, bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    cuts = np.append(np.flatnonzero(fresh), batch.num_rows)
    sets = Sets(*tn.packed(batch.column("text")))
    side, c = (batch.column(k).to_numpy() for k in ("side", "c"))
    links = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a = int(np.searchsorted(side[lo:hi], 1))
        within = bool(keys[1][lo] == keys[2][lo])
        if a and (within or a < hi - lo):
            links += [(c[lo + p], c[lo + q]) for p, q in linked_rows(sets, slice(lo, hi), a, within, c[lo:hi])]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where a pair of blocks ends, of about ``CHUNK`` bytes of text or one such pair."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in tn.sliced(batches, "text", CHUNK):
        keys = np.stack([batch.column(k).to_numpy() for k in ("job", "i", "j")])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if last is not None and (keys[:, 0] != last).any():
            ends = np.concatenate(([0], ends))
        at = 0
        if held and size >= CHUNK and len(ends):
            at = int(ends[0])
            if at:
                held.append(batch.slice(0, at))
            yield flush()
            held, size = [], 0
        held.append(batch.slice(at))
        size += int(tn.lengths(held[-1].column("text")).sum())
        last = keys[:, -1]
    if held:
        yield flush()


def joining_links(members: DataFrame, classes: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that a link joins between sets that share a frequent signature.

    Sets meet in their jobs in blocks, where their overlaps are counted at once;
    only links that join components leave a block, so a group gives at most as
    many rows as sets in each block.
    """
    named = classes.select(F.col("print_a").alias("a"), "doc_id", "n").join(groups, "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id")).drop("component_id")
    named = cut(named.join(named.groupBy("c").agg(F.count("*").alias("size")), "c"))
    places = _blocks(cut(_met(members, named)))
    texts = places.join(docs.select("doc_id", "text"), "doc_id").select("job", "i", "j", "side", "c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_compare, _whole_keys(batches))

    return texts.repartition("job", "i", "j").sortWithinPartitions("job", "i", "j", "side").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Texts without words (null and empty ones too) have no shingles and are
    linked with nothing.  Rows of equal key count as one node and keep their
    rows; a null key is linked with nothing and names no component (null).
    Keys are integers.  Other columns are not looked at, whatever their names.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = cut(describe(base))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    name = ["n", "print_a", "print_b"]
    known = sets.where("n > 0 and doc_id is not null")
    classes = cut(known.groupBy(*name).agg(F.min(F.struct("doc_id", "cells")).alias("_m")).select(*name, "_m.*"))
    met = cut(candidates(base, total))
    links = verified(_bounded(met.where("kind = 0"), classes), base)
    # a key of several rows may have several sets, which are one node
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    if repeated.limit(1).count():
        of = classes.select(*name, F.col("doc_id").alias("b"))
        links = links.unionByName(known.join(repeated, "doc_id").join(of, name).select(F.col("doc_id").alias("a"), "b"))
    links = cut(links)
    groups = components(links)
    named = classes.join(groups, "doc_id", "left").select(*(F.col(c).alias(f"_{c}") for c in name), F.coalesce("component_id", "doc_id").alias("component_id"))
    if met.where("kind = 1").limit(1).count():
        rest = cut(joining_links(met.where("kind = 1"), classes, groups, base))
        if rest.limit(1).count():  # components of components, of which there are few
            wider = components(rest).select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("_wider"))
            named = named.join(wider, "component_id", "left").withColumn("component_id", F.coalesce("_wider", "component_id")).drop("_wider")
    same = [F.col(c) == F.col(f"_{c}") for c in name]
    out = sets.join(named, [*same, F.col("n") > 0, F.col("doc_id").isNotNull()], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar documents among all documents."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
