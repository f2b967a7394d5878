import pytest
from brute import WORD, targets

from zonetide.llm.mixing import mix, mixed_documents, mixed_stream


def test_targets_and_takings(documents):
    rows = documents.select("doc_id", "text", "source").collect()
    size = {(r.doc_id): len(WORD.findall(r.text or "")) for r in rows}
    whole = {}
    for r in rows:
        whole[r.source] = whole.get(r.source, 0) + size[r.doc_id]
    want, taken = targets(whole), dict.fromkeys(whole, 0)
    got = mix(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == whole[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mix(documents).collect()))


def test_stream_is_in_virtual_time_and_stops_at_the_budget(documents):
    rows, stream = mixed_stream(documents)
    got = sorted(stream.collect(), key=lambda r: r["at"])
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert all(a["at"] + a.words == b["at"] for a, b in zip(got, got[1:]))
    total = sum(r["size"] for r in rows.collect())
    assert abs(got[-1]["at"] + got[-1].words - 1.5 * total) <= 20


def test_hot_small_and_empty_sources(spark, nothing):
    rows = [(i, "a b c", "hot") for i in range(300)] + [(1000, "x " * 50, "s"), (1001, "", "empty"), (1002, None, None), (5, "a b c", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = targets({"hot": 903, "s": 50, "empty": 0, None: 0})
    got = mix(docs).collect()
    assert len(got) == len(rows) and {r.source: r.target for r in got} == pytest.approx(want)
    assert sum(r.taken for r in got if r.source == "hot") == pytest.approx(want["hot"], abs=1)
    assert mixed_documents(docs).columns == docs.columns
    assert mix(nothing).count() == 0 and mixed_documents(nothing).count() == 0
