"""Kernels and planners that need no session."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import blobs, decontam, jaccard, licences, media, packing, quality, sharding, suffixes, textnum


def packed(texts):
    return textnum.packed(pa.array(texts, pa.large_string()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é.\n", max_size=30) | st.none(), max_size=8))
def test_words(texts):
    data, offsets = packed(texts)
    start, end, first = textnum.words(data, offsets, jaccard.INSIDE)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [[w for w in (t or "").replace("\n", " ").split(" ") if w] for t in texts]


def test_span_hashes():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = textnum.Sums(data).spans(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_blobs():
    columns = [np.array([1, 5, 5, 9]), np.array([1, 2, 3, 4], np.uint8)]
    back = blobs.joined([blobs.dump(columns, (0,)), blobs.dump(columns)])
    assert back[0].tolist() == [1, 5, 5, 9] * 2 and back[1].dtype == np.uint8


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_two_stage_sorts_suffixes(text):
    t = np.frombuffer(text, np.uint8)
    order = suffixes.two_stage(t, len(t) + 8)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: text[i:])
    direct = suffixes.smaller_than_next(t)
    assert direct.tolist() == [text[i:] < text[i + 1 :] for i in range(len(t))]


def test_minimax_is_least():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        k = rng.randint(1, 4)
        capacity, ends = sharding.minimax(sizes, k)

        def best(i, left):
            if left == 1:
                return sum(sizes[i:])
            return min(max(sum(sizes[i:j]), best(j, left - 1)) for j in range(i, len(sizes) + 1))

        assert capacity == best(0, k) and ends[-1] == len(sizes)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=20))
def test_patterns_use_every_piece(counts):
    patterns = packing.pack_counts(counts, 64)
    seen = {}
    for pattern, times in patterns:
        assert sum(pattern) <= 64 and times > 0 and sum(3 * n > 64 for n in pattern) <= 2
        for n in pattern:
            seen[n] = seen.get(n, 0) + times
    assert seen == counts


def test_packing_is_near_the_bound():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        n = min(1024, int(rng.expovariate(1 / 300)) + 1)
        counts[n] = counts.get(n, 0) + 1
    used = sum(t for _, t in packing.pack_counts(counts, 1024))
    assert used <= 1.02 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_ranks_and_vocabulary_agree():
    texts = ["", " ", "Thé quick  brown\n\nfox's 12 apples!! <|endoftext|> x", "ÀÉ漢字 🙂\t\t tab ", "a" * 3000, "don't\u00a0stop \r\n"]
    for t in texts:
        assert packing.token_bytes(t) == packing.token_bytes(t, packing.VOCABULARY, None)


def test_added_tokens_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for t in ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "it's<|endoftext|>'s  \n<|endoftext|>   é", "<<|endoftext|", "<|endoftext|>"]:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert packing.token_bytes(t) == packing.token_bytes(t, packing.VOCABULARY, None) == np.array(ids, "<u4").tobytes()
        assert ids.count(50256) == t.count("<|endoftext|>")


def test_pieces():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)] and packing.pieces_of(8, 4) == [(0, 4), (4, 4)] and packing.pieces_of(1, 4) == [(0, 1)]


def test_schemes_cover_all_sizes():
    table, lows = jaccard.schemes()
    for a, b in zip(table[:40], table[1:41], strict=True):
        assert a.high + 1 == b.low
    for s in table[:40]:
        assert s.exact + 2 * s.deletions >= s.apart + 1 + s.spare


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 6, 8, 11, 17, 29, 40, 75, 200, 900]:
        for _ in range(20):
            x = rng.integers(1, 1 << 62, n).astype(np.uint64)
            drop = rng.integers(0, n // 7 + 1)
            y = np.concatenate((x[drop:], rng.integers(1, 1 << 62, rng.integers(0, n // 7 + 1)).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if not 100 * both >= 75 * (len(np.union1d(x, y))):
                continue
            tokens, row = np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)])
            sign, owner, *_ = jaccard.signatures(tokens, row, np.array([len(x), len(y)]))
            assert set(sign[owner == 0].tolist()) & set(sign[owner == 1].tolist())


def test_histogram_bound():
    import zstandard

    rng = np.random.default_rng(4)
    tool = zstandard.ZstdDecompressor()
    for _ in range(50):
        x, y = (rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2) for _ in range(2))
        y = np.unique(np.concatenate((x[: len(x) // 2], y)))
        x = np.unique(x)
        a, b = (jaccard._histograms(t, np.zeros(len(t), np.int64), np.array([len(t)]))[0] for t in (x, y))
        assert jaccard._apart(a, b, tool) <= len(np.setxor1d(x, y))


def test_windows_of_short_items():
    found = decontam.WindowSet([(["1"], "one two three"), (["2"], " ".join(f"w{k}" for k in range(12))), (["3"], "!!"), ([], "one  two-three")])
    assert {w.size: (len(w.key), w.owner.tolist()) for w in found.windows} == {3: (1, [0, 3]), 10: (3, [1, 1, 1])}


def test_windows_of_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(textnum, "mix", lambda x: np.zeros_like(x))
    found = decontam.WindowSet([(["1"], "one two"), (["2"], "six ten"), (["3"], "ONE two")])
    assert [(len(w.key), w.first.tolist()) for w in found.windows] == [(2, [0, 2, 3])]


def test_wav_round_trip():
    payload = media.padded(b"hello")
    assert len(payload) == 64 and media.from_wav(media.to_wav(payload)) == payload and len(media.padded(b"")) == 64
    when, code = media.fingerprints(np.frombuffer(media.padded(bytes(range(256)) * 9), np.uint8))
    assert len(when) == len(code) and (np.diff(when) >= 0).all()


def test_licence_model():
    m = licences.model()
    right = 0
    for words, family in (rows := licences.examples(99, 20)):
        h = licences.hash_words(words)
        best, p = m.classes(h, np.zeros(len(h), np.int64), 1) if len(h) else ([len(m.families) - 1], [1])
        right += m.families[best[0]] == family
    assert right / len(rows) > 0.9


def test_votes_separate_classes():
    rng = random.Random(5)
    counts = {}
    for _ in range(3000):
        good = rng.random() < 0.8
        v = [quality.ABSTAIN] * len(quality.LABELLERS)
        if not good:
            v[rng.randrange(3)] = quality.BAD
        for k in range(len(quality.DEFECTS), len(quality.LABELLERS)):
            v[k] = int(good if rng.random() < 0.9 else not good)
        p = int(quality.encode(np.array([v]))[0])
        counts[p] = counts.get(p, 0) + 1
    share, _ = quality.fit_votes(counts)
    assert share == pytest.approx(0.8, abs=0.1)
    assert quality.fit_votes({})[0] == 0.8


def parity_words(n=1024):
    """Two words that sums modulo a power of two cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_have_their_own_hash():
    x, y = parity_words()
    data = np.frombuffer((x + y + x).encode(), np.uint8)
    h = textnum.Sums(data).spans(np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert h[0] != h[1] and h[0] == h[2]


def test_shared_words_are_compared(monkeypatch):
    texts = ["a b c d e f g", "a b  c d e f h", "q r s t u v w", ""]
    sets = jaccard.Sets(*packed(texts))
    assert sets.shared(np.array([0, 0, 0, 3]), np.array([1, 2, 0, 3])).tolist() == [2, 0, 3, 0]
    monkeypatch.setattr(textnum, "mix", lambda x: np.zeros_like(x))  # all hashes collide
    sets = jaccard.Sets(*packed(["a b c d e", "v w x y z", "a b c d e"]))
    assert sets.shared(np.array([0, 0]), np.array([1, 2])).tolist() == [0, 1]


@pytest.mark.parametrize("light,tile", [(16, 2048), (1, 3), (40, 5)])
def test_links_of_a_block(monkeypatch, light, tile):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(t))
    sets = jaccard.Sets(*packed(texts))
    words = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    for a, within in ((40, True), (15, False), (15, True)):
        c = np.arange(40) if within else np.arange(40) // 2
        got = jaccard.linked_rows(sets, slice(0, 40), a, within, c)

        def groups(links, c=c):
            name = dict(zip(range(40), c.tolist(), strict=True))
            for i, j in links:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = {k: new if v == old else v for k, v in name.items()}
            return name

        want = [(i, j) for i in range(a) for j in range(40) if i != j and (j >= a or within) and 100 * len(words[i] & words[j]) >= 75 * len(words[i] | words[j])]
        assert groups(got) == groups(want) and set(got) <= set(want) and len(got) < 40
