"""Memory of the kernels that Python workers run on a chunk of text, and that working in blocks changes no result."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import quality, suffixes, textnum


def peak(work) -> float:
    """MB that a second call takes at most; the first fills what is kept between calls."""
    work()
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


@pytest.fixture(scope="module")
def chunk():
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"abcdefgh     .,", np.uint8), suffixes.CHUNK)
    return data, np.arange(0, len(data) + 1, 4096)


def test_contexts_of_a_chunk_take_little_memory(chunk):
    assert peak(lambda: suffixes.contexts(*chunk)) < 40


def test_features_of_a_chunk_take_little_memory(chunk):
    texts = quality._Texts(*chunk)
    assert peak(lambda: quality.features(texts)) < 60


def test_sums_of_a_chunk_take_little_memory(chunk):
    assert peak(lambda: textnum.Sums(chunk[0])) < 25


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 420), st.integers(1, 3)), min_size=1, max_size=6), st.sampled_from([1, 7, 76, 77, 78, 100, 500]), st.integers(0, 99))
def test_contexts_do_not_depend_on_blocks(texts, block, seed):
    rng = np.random.default_rng(seed)
    rows = [rng.integers(97, 97 + letters, size).astype(np.uint8) for size, letters in texts]
    data, offsets = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    parts, whole = suffixes.contexts(data, offsets, block), suffixes.contexts(data, offsets, 1 << 30)
    for a, b in zip(parts, whole, strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
    windows = [(r, k) for r, text in enumerate(rows) for k in range(len(text) - suffixes.LENGTH + 1)]
    assert [(r, s + k) for r, s, n in zip(*(c.tolist() for c in parts[2:]), strict=True) for k in range(n)] == windows


def test_sums_and_features_do_not_depend_on_steps(monkeypatch):
    rng = np.random.default_rng(8)
    data = rng.choice(np.frombuffer("aB1 .,|é\n".encode(), np.uint8), 3000)
    offsets = np.array([0, 0, 1, 3, 900, 901, 2000, 3000, 3000])
    got = []
    for step in (5, 1000, 1 << 30):
        monkeypatch.setattr(textnum, "STEP", step)
        got.append((textnum.Sums(data).sums.tobytes(), quality.features(quality._Texts(data, offsets)).tobytes()))
    assert got[0] == got[1] == got[2]
