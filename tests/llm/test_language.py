import math
import re
import zlib
from collections import Counter

import pytest

from zonetide.llm.language import labelled_sample, predict, train
from zonetide.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_words_first_then_shorter_grams(spark, few):
    sample = spark.createDataFrame([("der hund und die katze der hund", "de"), ("the dog and the cat the dog", "en")] * 3, "text string, lang string")
    model = train(sample)
    rows = [(1, "the the"), (2, "hunde katzen"), (3, None), (4, ""), (5, "123 !?"), (6, "dogs " * 5000), (7, "ж")]
    got = {r.doc_id: r._lang for r in predict(few(rows), model).collect()}
    assert [got[i].lang for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert got[7].lang in ("de", "en") and all(0 <= x.score <= 1 for x in got.values())


def test_nothing_learned_and_empty_table(documents, nothing):
    model = train(labelled_sample(nothing))
    assert {r.lang for r in predict(documents, model).select("_lang.lang").collect()} == {"und"}
    assert predict(nothing, model).count() == 0
    assert predict(documents, model).columns == [*documents.columns, "_lang"]


def _brute(sample, texts, longest=4, smooth=0.5):
    """Counters and loops over single words; every word and n-gram that comes twice."""
    word = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: [(f"<{w}>" if n > 1 else w)[i : i + n] for i in range(len(w) + 2 * (n > 1) - n + 1)]
    counts = {lang: Counter() for _, lang in sample}
    for text, lang in sample:
        counts[lang].update(word.findall(text.lower()))
    tables = [counts] + [{lang: Counter() for lang in counts} for _ in range(longest)]
    for n in range(1, longest + 1):
        for lang, c in counts.items():
            for w, k in c.items():
                for g in grams(w, n):
                    tables[n][lang][g] += k
    langs, logs = sorted(counts), []
    for t in tables:
        items = {i for c in t.values() for i in c if sum(t[x][i] for x in t) > 1}
        whole = {x: sum(n for i, n in t[x].items() if i in items) for x in langs}
        logs.append({i: [math.log(t[x][i] + smooth) - math.log(whole[x] + smooth * (len(items) + 1)) for x in langs] for i in items})

    def of(w):
        if w in logs[0]:
            return logs[0][w]
        for n in range(longest, 0, -1):
            known = [logs[n][g] for g in grams(w, n) if g in logs[n]]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        found = word.findall((text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        total = [sum(x) for x in zip(*map(of, found))]
        out.append((langs[total.index(max(total))], 1 / sum(math.exp(t - max(total)) for t in total)))
    return out


def test_against_counters(spark, documents):
    rows = documents.select("text", "lang").collect()
    extra = ["½ ² Ⅷ", "ǅ İstanbul ΑΣ", "naïve_word", "x1y2", "漢字 漢", "a\u0301b", "\U0001d54f\U0001f600 z", "ﬁn ß ŉ"]
    sample = [(r.text, r.lang) for i, r in enumerate(rows) if r.text is not None and r.lang is not None and i % 3]
    texts = [r.text for r in rows] + extra + [None]
    model = train(spark.createDataFrame(sample, "text string, lang string").repartition(3))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r._lang for r in predict(df, model).collect()}
    for i, (lang, score) in enumerate(_brute(sample, texts)):
        assert got[i].lang == lang and got[i].score == pytest.approx(score, rel=1e-6, abs=1e-9)


def test_ties_go_to_the_first_language(spark, few):
    model = train(spark.createDataFrame([("one two one two", "zz"), ("one two one two", "aa"), ("three three", "mm")], "text string, lang string"))
    got = {r.doc_id: r._lang for r in predict(few([(1, "one two"), (2, "ж ж"), (2, "ж ж")]), model).collect()}
    assert got[1].lang == "aa" and got[1].score < 0.51
    assert got[2].lang == "aa" and got[2].score == pytest.approx(1 / 3)


def test_words_of_rare_languages_stay(spark, few):
    """However much a language has, another one keeps every word that it repeats."""
    common = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600))
    sample = [(common, "big")] * 40 + [("qix qix zuv zuv", "small")]
    model = train(spark.createDataFrame(sample, "text string, lang string"))
    assert len(model.words.hashes) == 602
    assert predict(few([(1, "qix zuv")]), model).first()["_lang"].lang == "small"
