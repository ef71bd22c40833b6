"""Benchmark decontamination by exact word windows.

Windows of ten consecutive words of every benchmark item (the whole item where
it is shorter) are hashed into a set; documents are scanned once with running
window hashes, matches are verified word by word, and hit words, spans and items
are reported.  The hash set goes to executors by broadcast, as arrays.  Its size
is checked first: equal texts count once, and a benchmark above ``BLOCK_BYTES``
is scanned in blocks of about that size (longer items in overlapping pieces),
one pass over the documents each, so the broadcast never grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import textnum as tn
from pointloom.scratch import cut

WINDOW = 10
#: Text of a block of items; with its windows some ten times that is sent.
BLOCK_BYTES = 8 << 20
CHUNK = 2 << 20
#: Bytes of words: digits, a-z and everything outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True

FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"


def _tokens(data: np.ndarray, offsets: np.ndarray):
    low = tn.lower_ascii(data)
    start, end, first = tn.words(low, offsets, INSIDE)
    return low, start, end, first, tn.Sums(low).spans(start, end)


class _Runs:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = tn.powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, tn.U)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, n: int) -> np.ndarray:
        count = max(len(self.sums) - n, 0)
        raw = (self.sums[n : n + count] - self.sums[:count]) * self.down[:count]
        return tn.mix(raw + tn.U(n))


class Windows:
    """The windows of one length: hashes in order, where their words are, and which texts have them.

    Arrays only, so that what is broadcast is some 50 bytes a window and the
    texts' bytes; a window that many texts share is held once.
    """

    def __init__(self, key: np.ndarray, word: np.ndarray, owner: np.ndarray, words: tuple, size: int):
        order = np.lexsort((word, key))
        key, word, owner = key[order], word[order], owner[order]
        cuts = tn.runs(key)
        head = np.repeat(cuts[:-1], np.diff(cuts))
        same = _equal(words, word, words, word[head], size)
        # windows of one hash and other words are texts of their own
        lead = ~same
        lead[cuts[:-1]] = True
        self.key, self.word, self.size = key[lead], word[lead], size
        of = np.where(same, np.cumsum(lead)[head] - 1, np.cumsum(lead) - 1)
        pair = np.unique(np.stack((of, owner)), axis=1)
        self.owner, self.first = pair[1].astype(np.int32), np.searchsorted(pair[0], np.arange(len(self.key) + 1))


def _equal(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from ``i`` of ``x`` are those from ``j`` of ``y``, byte by byte."""
    (xb, xs, xe), (yb, ys, ye) = x, y
    good = np.ones(len(i), bool)
    for k in range(size):
        own = np.flatnonzero(good)
        a, b = i[own] + k, j[own] + k
        long = xe[a] - xs[a]
        even = long == ye[b] - ys[b]
        good[own[~even]] = False
        own, a, b, long = own[even], a[even], b[even], long[even]
        apart = xb[tn.ranges(xs[a].astype(np.int64), long)] != yb[tn.ranges(ys[b].astype(np.int64), long)]
        good[np.repeat(own, long)[apart]] = False
    return good


class WindowSet:
    """All windows of some items: ``names`` of each text's items, and :class:`Windows` by length."""

    def __init__(self, items: list[tuple[list[str], str | None]], window: int = WINDOW):
        self.names = [names for names, _ in items]
        low, start, end, first, hashes = _tokens(*tn.packed(pa.array([t for _, t in items], pa.large_string())))
        self.words = low, start.astype(np.int32), end.astype(np.int32)
        self.windows: list[Windows] = []
        if not len(start):
            return
        runs, count = _Runs(hashes), np.diff(first)
        size = np.minimum(count, window)
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            per = count[own] - n + 1
            word = tn.ranges(first[own], per)
            self.windows.append(Windows(runs.of(n)[word], word, np.repeat(own, per), self.words, n))


def _scan(batch: pa.RecordBatch, known: WindowSet) -> tuple[list, list, list, list]:
    low, start, end, first, hashes = _tokens(*tn.packed(batch.column("text")))
    runs, row = _Runs(hashes), tn.row_of(first)
    edge = np.zeros(len(start) + 1, np.int64)
    n_words = np.diff(first)
    items: dict[int, set] = {}
    for w in known.windows:
        size = w.size
        if len(start) < size:
            continue
        got = runs.of(size)
        lo, hi = np.searchsorted(w.key, got), np.searchsorted(w.key, got, "right")
        hits = np.flatnonzero((hi > lo) & (row[: len(got)] == row[size - 1 :]))
        at, which = np.repeat(hits, (hi - lo)[hits]), tn.ranges(lo[hits], (hi - lo)[hits])
        good = _equal((low, start, end), at, known.words, w.word[which], size)
        at, which = at[good], which[good]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        # each row and window once, then their texts
        seen = np.unique(np.stack((row[at], which)), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        many = w.first[seen[1] + 1] - w.first[seen[1]]
        owners = np.stack((np.repeat(seen[0], many), w.owner[tn.ranges(w.first[seen[1]], many)]))
        for r, owner in np.unique(owners, axis=1).T.tolist() if len(at) else ():
            items.setdefault(r, set()).update(known.names[owner])
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[first[1:]] - total[first[:-1]]
    spans = [[] for _ in range(len(n_words))]
    for k in np.flatnonzero(n_hit).tolist():
        own = hit[first[k] : first[k + 1]]
        turns = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        spans[k] = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return n_words.tolist(), n_hit.tolist(), spans, [sorted(items.get(k, ())) for k in range(len(n_words))]


def _joined(old: list, new: list) -> list:
    marks = sorted((s["start"], s["end"]) for s in [*old, *new])
    out: list = []
    for a, b in marks:
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """``t`` and the distinct ids ``i`` of its items; texts over ``most`` bytes in pieces that overlap by a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.sliced(batches, "t", CHUNK):
            names, texts = [], []
            for name, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                raw = (text or "").encode()
                if len(raw) <= most:
                    names.append(name)
                    texts.append(text)
                    continue
                start, end, _ = tn.words(tn.lower_ascii(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)]), INSIDE)
                at = 0
                while at < len(start):
                    to = max(int(np.searchsorted(start, start[at] + most)), at + window)
                    names.append(name)
                    texts.append(raw[start[at] : end[min(to + window - 1, len(start)) - 1]].decode())
                    at = to if to + window - 1 < len(start) else len(start)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["i", "t"])

    return items.where("t is not null").mapInArrow(run, "i string, t string").groupBy("t").agg(F.collect_set("i").alias("i"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text: str, item: str, item_text: str, block_bytes: int) -> DataFrame:
    """``rest`` (a struct of all other columns), ``text`` and the added columns of each document."""
    spark = docs.sparkSession
    items = cut(_pieces(benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")), window, block_bytes))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    out = docs.select((F.struct(*rest) if rest else F.lit(None).cast("string")).alias("rest"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*out.schema.fields, *T._parse_datatype_string(FOUND).fields])
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(WindowSet([(r["i"], r["t"]) for r in part.collect()], window))  # about block_bytes of text

        def run(batches: Iterator[pa.RecordBatch], sent=sent, later=k > 0) -> Iterator[pa.RecordBatch]:
            for batch in tn.sliced(batches, "text", CHUNK):
                n_words, n_hit, spans, found = _scan(batch, sent.value)
                if later:
                    old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                    spans = [_joined(a, b) for a, b in zip(old_spans, spans, strict=True)]
                    found = [sorted({*a, *b}) for a, b in zip(old_items, found, strict=True)]
                    n_hit = [sum(s["end"] - s["start"] for s in row) for row in spans]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                columns = [batch.column("rest"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        out = out.mapInArrow(run, schema)
    return out


ADDED = ("n_words", "n_hit", "spans", "items")


def _columns(docs: DataFrame, text: str) -> list:
    return [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``spans`` (word positions) and ``items`` to every document.

    Words are runs of digits, a-z (after A-Z is lower-cased) and characters
    outside ASCII.  Null text has no words; items without words match nothing;
    items without id mark words but are not listed.  Repeated items count once,
    repeated rows each have their result.  Input columns of the added names are
    replaced; others stay, whatever their names.
    """
    found = _found(docs, benchmark, window, text, item, item_text, block_bytes)
    own = [c for c, name in zip(_columns(docs, text), docs.columns, strict=True) if name not in ADDED]
    return found.select(*own, *ADDED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Documents without any hit word; all columns as they came."""
    return _found(docs, benchmark, window, text, "item_id", "text", BLOCK_BYTES).where("n_hit = 0").select(*_columns(docs, text))


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM items), wins AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)
), hits AS (SELECT doc_id, n, p, item_id FROM wins JOIN items USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(found.n_items, 0) AS n_items,
  sha256(coalesce(found.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
