"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document.
Votes are counted by pattern over the whole table (at most 3 to the power of
the number of labellers patterns); expectation-maximisation on those counts
estimates the share of good documents and how often each labeller gives each
vote in either class.  Posterior labels of a bounded sample (``SAMPLE``
documents, those with the least hash of their key) train a linear scorer on
hashed features: trigrams of character classes and words.  Every document is
scored on its whole text; those below the threshold are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import textnum as tn

CHUNK = 2 << 20
#: Rows worked on together: each has a table of ``FEATURES`` numbers.
ROWS = 1000
#: Most documents that train the scorer.
SAMPLE = 3000
THRESHOLD = 0.5
GOOD, BAD, ABSTAIN = 1, 0, 2

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = True
#: Words are runs of anything but white space.
_inside = np.ones(256, bool)
_inside[[32, 9, 10, 11, 12, 13]] = False
#: Character classes of the trigrams: lower, upper, digit, blank, line end, sentence end, comma-like, bar, hash-like, other signs.
_classes = np.full(256, 9, np.int64)
_classes[97:123] = _classes[128:] = 0
_classes[65:91] = 1
_classes[48:58] = 2
_classes[[32, 9]] = 3
_classes[[10, 11, 12, 13]] = 4
_classes[[46, 63]] = 5
_classes[[44, 59, 58, 39, 34, 45, 40, 41]] = 6
_classes[[33]] = 7
_classes[[124, 35, 36, 37, 38, 42, 64, 94, 95, 126, 60, 62, 61, 43, 92, 47]] = 8
TRIGRAMS, WORDS = 1000, 1024
FEATURES = TRIGRAMS + WORDS + 2


class _Texts:
    """Counts of a buffer of texts, by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1
        self.size = np.diff(offsets).astype(float)
        self.start, self.end, self.first = tn.words(data, offsets, _inside)
        self.words = np.diff(self.first).astype(float)
        self.row = tn.row_of(self.first)
        self.hash = tn.Sums(tn.lower_ascii(data)).spans(self.start, self.end)
        self.again = np.zeros(len(self.start), bool)
        self.again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.row[1:] == self.row[:-1])
        order = np.lexsort((self.hash, self.row))
        h, r = self.hash[order], self.row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        self.distinct = np.bincount(r[fresh], minlength=self.rows).astype(float)
        self.repeats = np.bincount(self.row[self.again], minlength=self.rows).astype(float)

    def count(self, chosen: np.ndarray) -> np.ndarray:
        """Bytes of each row that are in ``chosen`` (256 flags)."""
        total = np.concatenate(([0], np.cumsum(chosen[self.data])))
        return np.diff(total[self.offsets]).astype(float)


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


SIGNS, ENDS, SHOUTS, BARS, CAPITALS = _flags("#$%&*@^_~<>=+\\{}[]"), _flags(".?!"), _flags("!"), _flags("|"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ASCII_LETTERS = CAPITALS | _flags("abcdefghijklmnopqrstuvwxyz")
#: Labellers that see a defect or abstain, and those that judge either way.
DEFECTS = ("signs", "capitals", "repeats", "shouts", "word_length", "bars")
#: Most good documents that a defect may be seen on.
RARE = 0.005
LABELLERS = (*DEFECTS, "variety", "sentences", "prose")


def votes(t: _Texts) -> np.ndarray:
    """A vote of each labeller (columns) on each row; few words: mostly abstentions."""
    n = np.maximum(t.words, 1)

    def judge(good, bad: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known & bad, BAD, np.where(known & good, GOOD, ABSTAIN))

    some, many = t.words >= 3, t.words >= 30
    signs, shouts, bars = t.count(SIGNS) / n, t.count(SHOUTS) / n, t.count(BARS) / n
    capitals = t.count(CAPITALS) / np.maximum(t.count(ASCII_LETTERS), 1)
    ends = t.count(ENDS) / n
    length = t.size / n
    repeats, variety = t.repeats / n, t.distinct / np.minimum(n, 400)
    clean = (signs < 0.05) & (shouts < 0.05) & (bars < 0.02) & (capitals < 0.25) & (repeats < 0.05)
    return np.stack(
        [
            judge(False, signs > 0.25, some),
            judge(False, capitals > 0.4, some),
            judge(False, repeats > 0.2, some),
            judge(False, shouts > 0.25, some),
            judge(False, (length < 2) | (length > 25), some),
            judge(False, bars > 0.15, some),
            judge(variety > 0.3, variety < 0.12, many),
            judge((ends > 0.03) & (ends < 0.5), (ends < 0.004) | (ends > 0.9), many),
            judge(clean, ~clean, some),
        ],
        axis=1,
    ).astype(np.int8)


def encode(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def decode(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(len(LABELLERS))]


def fit_votes(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of good documents and P(vote | class) by labeller, class and vote.

    An abstention is no evidence.  For labellers that judge either way the votes
    cast add up to 1; for those that see defects only, P(bad | good) stays at
    most ``RARE``: else a doubtful split of the patterns could pass defects off
    as noise of good documents.  An empty table gives the start.
    """
    share = 0.8
    table = np.ones((len(LABELLERS), 2, 3))
    table[:, :, :2] = [[0.6, 0.4], [0.1, 0.9]]
    table[: len(DEFECTS), :, BAD] = [0.3, RARE]
    if not counts:
        return share, table
    patterns = np.array([decode(p) for p in counts])
    weight = np.array(list(counts.values()), float)
    for _ in range(rounds):
        good = _posterior(patterns, share, table)
        before = table.copy()
        share = float(np.clip((weight * good).sum() / weight.sum(), 0.5, 0.98))
        for k in range(len(LABELLERS)):
            for c, w in ((BAD, weight * (1 - good)), (GOOD, weight * good)):
                seen = np.bincount(patterns[:, k], weights=w, minlength=3)
                if k < len(DEFECTS):
                    rate = (seen[BAD] + 1) / (seen.sum() + 4)
                    table[k, c, BAD] = min(rate, RARE) if c == GOOD else max(rate, 4 * RARE)
                else:
                    table[k, c, :2] = (seen[:2] + 1) / (seen[:2].sum() + 2)
        if np.abs(table - before).max() < 1e-6:
            break
    return share, table


def _posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    which = np.arange(table.shape[0])
    bad, good = (np.log(table[which, c, patterns]).sum(1) + math.log(p) for c, p in ((BAD, 1 - share), (GOOD, share)))
    return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))


def features(t: _Texts) -> np.ndarray:
    """Hashed features of each row, of length 1 (all zero for an empty text)."""
    out = np.zeros(t.rows * FEATURES)
    grid = out.reshape(t.rows, FEATURES)
    a = 0
    while a < t.rows:  # rows of some bytes at a time
        b = max(a + 1, int(np.searchsorted(t.offsets, t.offsets[a] + tn.STEP, "right")) - 1)
        kind = _classes[t.data[t.offsets[a] : t.offsets[b]]]
        if len(kind) >= 3:
            tri = kind[:-2] * 100 + kind[1:-1] * 10 + kind[2:]
            row = np.repeat(np.arange(b - a), np.diff(t.offsets[a : b + 1]))
            same = row[:-2] == row[2:]
            grid[a:b] += np.bincount(row[:-2][same] * FEATURES + tri[same], minlength=(b - a) * FEATURES).reshape(b - a, FEATURES)
        a = b
    word = (t.hash % tn.U(WORDS)).astype(np.int64)
    out += np.bincount(t.row * FEATURES + TRIGRAMS + word, minlength=len(out))
    table = np.sqrt(out.reshape(t.rows, FEATURES) / np.maximum(t.words, 1)[:, None])
    table[:, TRIGRAMS : TRIGRAMS + WORDS] *= 0.3
    table[:, -2] = 3 * np.sqrt(t.repeats / np.maximum(t.words, 1))
    table[:, -1] = 3 * np.sqrt(np.maximum(0, 1 - t.distinct / np.maximum(np.minimum(t.words, 400), 1)))
    return table / np.maximum(np.sqrt((table * table).sum(1)), 1e-12)[:, None]


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels, classes weighted alike."""
    weights, bias = np.zeros(x.shape[1]), 0.0
    if not len(x):
        return weights, 10.0  # nothing to learn from: keep
    share = float(np.clip(target.mean(), 0.5, 0.98))
    worth = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    for _ in range(rounds):
        miss = worth * (1 / (1 + np.exp(-(x @ weights + bias))) - target) / len(x)
        weights -= rate * (x.T @ miss + decay * weights)
        bias -= rate * miss.sum()
    return weights, bias


def _mapped(work, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tn.sliced(batches, "text", CHUNK, ROWS):
        yield work(batch, _Texts(*tn.packed(batch.column("text"))))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of each vote pattern, and the scorer, from ``doc_id`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(_, t: _Texts) -> pa.RecordBatch:
            pattern, n = np.unique(encode(votes(t)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

        yield from _mapped(work, batches)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch, t: _Texts) -> pa.RecordBatch:
            x = features(t).astype(np.float32)
            return pa.RecordBatch.from_arrays([batch.column("h"), pa.array(encode(votes(t))), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "pattern", "x"])

        yield from _mapped(work, batches)

    base = docs.select("doc_id", "text")
    found = base.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    share, table = fit_votes({r["pattern"]: r["n"] for r in found})
    posterior = {r["pattern"]: float(_posterior(np.array([decode(r["pattern"])]), share, table)[0]) for r in found}
    # rows of the least hashes; equal rows have one hash and count once, so there are ``sample`` at most
    hashed = base.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    least = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    rows = [] if least is None else hashed.where(F.col("h") <= least).dropDuplicates(["h"]).mapInArrow(gather, "h long, pattern long, x binary").collect()
    rows = [(p, bytes(v)) for _, p, v in sorted((r["h"], r["pattern"], r["x"]) for r in rows)]
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows], float).reshape(len(rows), FEATURES)
    weights, bias = fit_scorer(x, np.array([posterior[p] for p, _ in rows]))
    return posterior, weights, bias


ADDED = {"votes": "long", "posterior": "double", "score": "double", "keep": "boolean"}


def _judged(docs: DataFrame, sample: int, threshold: float) -> DataFrame:
    """``rest`` (a struct of all columns but the text), ``text`` and the added columns."""
    posterior, weights, bias = train(docs, sample)
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"), "text")
    sent = docs.sparkSession.sparkContext.broadcast((posterior, weights, bias))  # at most 3**9 numbers and FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, b = sent.value

        def work(batch: pa.RecordBatch, t: _Texts) -> pa.RecordBatch:
            pattern = encode(votes(t))
            score = 1 / (1 + np.exp(-(features(t) @ w + b)))
            keep = (score >= threshold) | (t.words < 3)
            extra = [pa.array(pattern), pa.array([known.get(p, 0.5) for p in pattern.tolist()]), pa.array(score), pa.array(keep)]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["rest", "text", *ADDED])

        yield from _mapped(work, batches)

    schema = T.StructType([*base.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in ADDED.items())])
    return base.mapInArrow(run, schema)


def _columns(docs: DataFrame) -> dict:
    return {c: (F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns}


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``votes`` (pattern), ``posterior``, ``score`` and ``keep`` to every row.

    ``docs`` has ``doc_id`` and ``text``; columns of the added names are replaced.
    Texts of fewer than three words get abstentions only and, having nothing
    against them, are kept; so are null and empty texts.  Repeated rows each have
    the same result, and count once in the sample that the scorer learns from.
    """
    own = [c for name, c in _columns(docs).items() if name not in ADDED]
    return _judged(docs, sample, threshold).select(*own, *ADDED)


def kept(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that :func:`classify` keeps; all columns as they came, whatever their names."""
    return _judged(docs, sample, threshold).where("keep").select(*_columns(docs).values())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and decision for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs).drop("text")
