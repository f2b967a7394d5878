"""Similarity joins of names, and names in texts, against all pairs."""

import difflib
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from zonetide.operators import matching, names

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
WORDS = st.text("abcABC é", max_size=9)


def _ratio(a, b):
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _distance(a, b):
    return 1.0 if a == b else 1 - _edits(a, b) / max(len(a), len(b))


def _brute(raw, official, least, score):
    fold = lambda t: t.strip().upper()
    listed = {}
    for o in sorted(official, reverse=True):
        listed[fold(o)] = o
    out = {}
    for r in set(raw):
        best = min(((-score(fold(r), f), o) for f, o in listed.items()), default=None)
        out[r] = (best[1], pytest.approx(-best[0])) if best and -best[0] >= least - 1e-12 else (None, None)
    return out


def _tables(spark, raw, official):
    return spark.createDataFrame([(r,) for r in [*raw, None]], "name string"), spark.createDataFrame([(o,) for o in [*official, None]], "o string")


@FEW
@given(st.lists(WORDS, max_size=14), st.lists(WORDS, max_size=14), st.sampled_from([0.3, 0.5, 0.7, 0.85, 1.0]), st.sampled_from(["ratio", "distance"]))
def test_matches_equal_all_pairs(spark, raw, official, least, kind):
    match, score = (matching.match_by_ratio, _ratio) if kind == "ratio" else (matching.match_by_distance, _distance)
    a, b = _tables(spark, raw, official)
    got = {r.name: (r.matched, r.score) for r in match(a, "name", b, "o", least).collect()}
    assert got == _brute(raw, official, least, score)


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9])
def test_longer_names(spark, least):
    """Enough letters for pairs of neighbours to tell names apart."""
    rng = np.random.default_rng(int(least * 10))
    official = ["".join(rng.choice(list("abcdefghij "), rng.integers(4, 30))) for _ in range(60)]
    raw = []
    for name in official[:40]:
        text = list(name)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(text)))
            text[at : at + 1] = rng.choice([[], ["x"], ["y", text[at]]], 1)[0] if False else [[], ["x"], ["y", text[at]]][int(rng.integers(0, 3))]
            text = text or ["q"]
        raw.append("".join(text))
    a, b = _tables(spark, raw, official)
    for match, score in ((matching.match_by_ratio, _ratio), (matching.match_by_distance, _distance)):
        got = {r.name: (r.matched, r.score) for r in match(a, "name", b, "o", least).collect()}
        assert got == _brute(raw, official, least, score)


def test_blanks_and_case_do_not_count(spark):
    a, b = _tables(spark, [" centro ", "Centro", "CENTR0", "   "], ["CENTRO", "centro", "NORTE"])
    got = {r.name: (r.matched, r.score) for r in matching.match_by_ratio(a, "name", b, "o", 0.8).collect()}
    assert got == {" centro ": ("CENTRO", 1.0), "Centro": ("CENTRO", 1.0), "CENTR0": ("CENTRO", pytest.approx(10 / 12)), "   ": (None, None)}
    above = matching.match_by_ratio(a, "name", b, "o", 10 / 12, inclusive=False).filter("name = 'CENTR0'").first()
    assert above.matched is None


def test_candidates_are_fewer_than_pairs(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 12))
    mine, theirs = {word() for _ in range(150)}, {word() for _ in range(150)}
    a, b = spark.createDataFrame([(x,) for x in mine], "a string"), spark.createDataFrame([(x,) for x in theirs], "b string")
    assert names.candidate_pairs(a, b, names.Ratio(0.85)).count() < 150 * 150 / 10
    with pytest.raises(ValueError):
        matching.match_by_ratio(a, "a", b, "b", 0.0)


def test_no_list_is_collected(spark):
    a, b = _tables(spark, ["ab"], ["abc"])
    plan = matching.match_by_ratio(a, "name", b, "o", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_o" not in plan and "scalar-subquery" not in plan


@FEW
@given(st.lists(st.one_of(st.none(), st.text("aAbB é.", max_size=12)), max_size=8), st.lists(st.one_of(st.none(), st.text("aAbB é.", max_size=5)), max_size=8))
def test_names_in_texts(spark, texts, listed):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, found_in string")
    some = spark.createDataFrame([(n,) for n in listed], "name string")
    got = sorted((r.id, r.found) for r in names.names_in_text(df, "t", some, "name").collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) if t is not None for n in {n.upper() for n in listed if n is not None} if n in t.upper())


def test_long_texts_are_walked_once(spark):
    """Time grows with the length of a text, not with its square; characters beyond two bytes count as one."""
    body = "".join(f"{i:x} " for i in range(120_000))
    df = spark.createDataFrame([(1, body + "Å😀Z"), (2, "😀Å" + body + "lang=q"), (3, body)], "id int, t string")
    some = spark.createDataFrame([("å😀z",), ("LANG=Q",), ("😀Å",), ("q",)], "name string")
    start = time.perf_counter()
    got = sorted((r.id, r.found) for r in names.names_in_text(df, "t", some, "name").collect())
    assert got == [(1, "Å😀Z"), (2, "LANG=Q"), (2, "Q"), (2, "😀Å")]
    assert time.perf_counter() - start < 40


@pytest.mark.parametrize("listed", [40, 600, 0])
def test_names_without_a_match_keep_their_best_score(spark, listed):
    rng = np.random.default_rng(listed)
    word = lambda: "".join(rng.choice(list("abcdef "), rng.integers(1, 9)))
    raw, official = [word() for _ in range(300 if listed == 40 else 30)] + ["zzz", "", "q  "], [word() for _ in range(listed)]
    a, b = _tables(spark, raw, official)
    got = {r.name: (r.matched, r.score) for r in matching.match_by_distance(a, "name", b, "o", 0.8, scored=True).collect()}
    for r, (matched, score) in _brute(raw, official, 0.8, _distance).items():
        best = max((_distance(r.strip().upper(), o.strip().upper()) for o in official), default=None)
        assert got.pop(r) == (matched, None if best is None else pytest.approx(best)), r
        assert matched is None or score == best
    assert not got
