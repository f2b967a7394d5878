import random

from brute import jaccard

from zonetide.llm import jaccard as op
from zonetide.llm.components import components


def _result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_documents_against_brute_force(documents, texts, known, monkeypatch):
    monkeypatch.setattr(op, "FRAGMENT_ROWS", 5000)  # several fragments
    got = _result(op.jaccard_components(documents))
    assert len(got) == len(texts)
    assert got.pop(None) == (1, None)
    assert got == jaccard(known)


def test_near_copies_of_one_text_join_through_each_other(few):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 5))):
            words[at] = f"z{i}_{at}"
        rows.append((999 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:100] + [f"u{i}_{j}" for j in range(i)])) for i in range(40)]
    assert _result(op.jaccard_components(few(rows))) == jaccard(rows)


def test_repeated_rows_and_empty_table(few, nothing):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (7, None), (7, None)]
    got = sorted(tuple(r) for r in op.jaccard_components(few(rows)).collect())
    assert got == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (7, 0, 7)]
    assert op.jaccard_components(nothing).count() == 0


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_copied_sets_are_named_in_each_fragment(few):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(80))) for i in range(40)]
    for copies in (0, 3):
        docs = few(rows + [(100 + i, rows[0][1]) for i in range(copies)]).repartition(4)
        packed = op.packed_shingles(docs, op.set_table(docs), 50).filter("tokens is not null").collect()
        assert sum(len(r.tokens) // 5 for r in packed) >= 40 * 76
        named = sum(len(r.nodes) for r in packed)
        assert (named > 0) == (copies > 0) and named <= 8 * 76 * (1 + copies)
        assert _result(op.jaccard_components(docs)) == jaccard([tuple(r) for r in docs.collect()])
