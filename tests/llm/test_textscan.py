"""Hashes of runs: arithmetic against Python integers, and words that defeat sums modulo powers of two."""

import numpy as np
import pyarrow as pa
import pytest

from zonetide.llm import textscan as op
from zonetide.llm.jaccard import jaccard_components
from zonetide.llm.suffix import without_repeats
from zonetide.llm.unitigs import without_repeated_words
from zonetide.llm.wordmodel import units


def thue_morse(size, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(size))


def test_arithmetic():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, op.PRIME, 100_000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [0, op.PRIME - 1, op.PRIME - 1], [5, op.PRIME - 1, 1]
    some = [*range(50), 99_999]
    assert [int(op.times(a, b)[i]) for i in some] == [int(a[i]) * int(b[i]) % op.PRIME for i in some]
    assert [int(x) for x in op.running(a)[[0, 1, 2, 1000, 100_000]]] == [sum(map(int, a[:n])) % op.PRIME for n in (0, 1, 2, 1000, 100_000)]
    up, down = op.powers(1000)
    assert all(int(up[i]) == pow(op.BASE, i, op.PRIME) and int(up[i]) * int(down[i]) % op.PRIME == 1 for i in (0, 1, 2, 3, 500, 999))
    assert int(op.residue(np.array([(1 << 64) - 1], np.uint64))[0]) == ((1 << 64) - 1) % op.PRIME


@pytest.mark.parametrize("codes", [op.BYTE_CODE, op.mixed(np.arange(256, dtype=np.uint64))])
def test_runs_of_equal_symbols_have_equal_hashes(codes):
    rng = np.random.default_rng(2)
    codes = codes[rng.integers(0, 3, 3000)]
    prefix = op.Prefix(codes)
    assert prefix.halves == (codes.max() <= op.SMALL)
    for k in (1, 2, 7, 16, 29):
        start = np.arange(len(codes) - k + 1)
        found = prefix.of(start, start + k)
        for numbers in (found, op.grams(codes, k)):
            assert len(numbers) == len(start)
            named: dict = {}
            for i, h in enumerate(numbers.tolist()):
                assert named.setdefault(tuple(codes[i : i + k].tolist()), h) == h
            assert len(set(named.values())) == len(named)
        for i in (0, 5, 2000):
            raw = sum((int(c) % op.PRIME) * pow(op.BASE, j, op.PRIME) for j, c in enumerate(codes[i : i + k])) % op.PRIME
            assert op.mixed(np.array([(raw + k * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0] == found[i]
    assert len(op.grams(codes, len(codes) + 1)) == 0


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_collide_modulo_powers_of_two(size):
    x, y = thue_morse(size), thue_morse(size, True)
    words = op.Words(*op.buffers(pa.array([x, y, x])))
    assert words.hashes[0] != words.hashes[1] and words.hashes[0] == words.hashes[2]
    hashes, _ = units(pa.array([x, y, x]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_operators_tell_such_words_apart(few):
    t, u = thue_morse(1024), thue_morse(1024, True)
    tail = " ".join(f"z{i}" for i in range(49))
    docs = few([(1, t), (2, u), (3, f"{t} {tail}"), (4, f"q {u} {tail}"), (5, t)])
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1}  # the tails of 3 and 4 are alike
    assert {r.doc_id: r._cut.n_removed for r in without_repeated_words(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    bytes_ = few([(1, t), (2, "x" + u)])
    seen = {t[i : i + 100] for i in range(len(t) - 99)}
    first, want = set(), 0
    covered = np.zeros(len(u) + 1, bool)
    text = "x" + u
    for i in range(len(text) - 99):
        w = text[i : i + 100]
        if w in seen or w in first:
            covered[i : i + 100] = True
        first.add(w)
    want = int(covered.sum())
    assert {r.doc_id: r._cut.n_removed for r in without_repeats(bytes_).collect()}[2] == want


def test_powers_are_no_more_than_a_slice_needs():
    op.release()
    assert len(op.powers(1000)[0]) == op.LEAST_POWERS
    up, down = op.powers(op.LEAST_POWERS + 1)
    assert len(up) == len(down) == 2 * op.LEAST_POWERS and op.powers(10)[0] is up
    op.release()
    assert len(op.powers(10)[0]) == op.LEAST_POWERS
