import random

import numpy as np
import pytest
from brute import repeated_bytes, repeated_words

from zonetide.llm import suffix, unitigs
from zonetide.llm.textscan import sliding_min


def _bytes(df):
    return {r[0]: (r[1].n_bytes, r[1].n_removed, r[1].n_spans, bytes(r[1].kept)) for r in df.select("doc_id", "_cut").collect()}


def _words(df):
    return {r[0]: (r[1].n_words, r[1].n_removed, r[1].kept) for r in df.select("doc_id", "_cut").collect()}


@pytest.mark.parametrize("key_bytes", [suffix.KEY_BYTES, 500])
def test_bytes_against_brute_force(documents, known, monkeypatch, key_bytes):
    monkeypatch.setattr(suffix, "KEY_BYTES", key_bytes)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 4000)
    got = _bytes(suffix.without_repeats(documents))
    lost = got.pop(None)
    assert lost[1:3] == (0, 0) and lost[3] == b"lost words without an id"
    assert got == repeated_bytes(known, suffix.LENGTH)


def test_words_against_brute_force(documents, known):
    got = _words(unitigs.without_repeated_words(documents))
    assert got.pop(None) == (5, 0, "lost words without an id")
    assert got == repeated_words(known, unitigs.LENGTH)


def test_shared_passages_with_edits(few):
    rng = random.Random(2)
    words = [f"w{rng.randrange(40)}" for _ in range(400)]
    rows = []
    for i in range(60):
        part = words[rng.randrange(200) :][: rng.randrange(60, 300)]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = f"new{i}"
        rows.append((rng.randrange(10**6), " ".join(part)))
    assert _words(unitigs.without_repeated_words(few(rows))) == repeated_words(rows, unitigs.LENGTH)
    assert _bytes(suffix.without_repeats(few(rows))) == repeated_bytes(rows, suffix.LENGTH)


def test_columns_pass_and_empty_table(documents, nothing):
    assert suffix.without_repeats(documents).columns == [c for c in documents.columns if c != "_cut"] + ["_cut"]
    assert suffix.without_repeats(nothing).count() == 0
    assert unitigs.without_repeated_words(nothing).count() == 0


def test_classes_of_a_transform_equal_hash_classes():
    rng = random.Random(3)
    base = bytes(rng.randrange(97, 101) for _ in range(300))
    strings = [base[a : a + rng.randrange(20, 200)] for a in (rng.randrange(150) for _ in range(40))] + [b"a" * 150, b"a" * 90, bytes([0, 255]) * 30]
    for length in (1, 7, 20, 60):
        own, off = suffix.later_windows(np.arange(len(strings)), np.zeros(len(strings), int), strings, length)
        seen, want = set(), set()
        for i, s in enumerate(strings):
            for p in range(len(s) - length + 1):
                (want.add((i, p)) if s[p : p + length] in seen else seen.add(s[p : p + length]))
        assert set(zip(own.tolist(), off.tolist())) == want


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 2, 7])
    for width in range(1, 8):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_a_text_that_repeats_itself(few):
    rows = [(i, "ab " * (i * 37) + "thines " * 1500 + f"end{i} " + "is is the " * 700) for i in range(4)]
    assert _bytes(suffix.without_repeats(few(rows))) == repeated_bytes(rows, suffix.LENGTH)
    assert _words(unitigs.without_repeated_words(few(rows))) == repeated_words(rows, unitigs.LENGTH)


def test_large_keys_need_no_shuffle_of_texts_of_their_own(few, monkeypatch):
    """Nothing is run between the steps of a large key, so all of them can read one shuffle."""
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + common[: rng.randrange(150, 260)] + f"end {i}") for i in range(40)]
    monkeypatch.setattr(suffix, "KEY_BYTES", 300)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 4000)
    written, steps, write, cut_again = [], [], suffix.cut_lineage, suffix.finer
    monkeypatch.setattr(suffix, "cut_lineage", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(suffix, "finer", lambda *a: steps.append(a[-1]) or cut_again(*a))
    assert _bytes(suffix.without_repeats(few(rows))) == repeated_bytes(rows, suffix.LENGTH)
    assert written == ["runs"] and steps == [64, 100]
