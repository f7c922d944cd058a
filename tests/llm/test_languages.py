"""Language labels: held-out accuracy, mixed texts, rejection."""

import os

import pytest

from siltstone.llm import languages as L

SENTENCES = {
    "en": "The report was sent to the wrong office before the end of the week. We believe that nobody has read it yet.",
    "de": "Der Bericht wurde vor dem Ende der Woche an das falsche Büro geschickt. Wir glauben, dass ihn noch niemand gelesen hat.",
    "fr": "Le rapport a été envoyé au mauvais bureau avant la fin de la semaine. Nous pensons que personne ne l'a encore lu.",
    "ru": "Отчёт был отправлен не в тот отдел до конца недели. Мы считаем, что его ещё никто не читал.",
    "ja": "報告書は週の終わりまでに間違った事務所に送られました。まだ誰も読んでいないと思います。",
}


def toy_model():
    texts, labels = [], []
    for code, t in SENTENCES.items():
        for i in range(30):
            words = t.split(" ") if code != "ja" else list(t)
            k = i % max(1, len(words) // 2)
            texts.append((" " if code != "ja" else "").join(words[k:] + words[:k]))
            labels.append(L.LANGUAGES.index(code))
    for i in range(6):  # wrong labels
        texts.append(SENTENCES["de"])
        labels.append(L.LANGUAGES.index("en"))
    return L.fit(texts, labels)


def found(texts, model):
    s, language, _ = L.decide(texts, model)
    return [{L.LANGUAGES[k] for k in language[(s.doc == i) & (language >= 0)]} for i in range(len(texts))]


def test_segments_and_rejection():
    model = toy_model()
    texts = [SENTENCES["de"], SENTENCES["en"] + " " + SENTENCES["fr"], SENTENCES["ja"] + SENTENCES["ru"], "4711; 8812; 9921", "----", "", "🙂🔥", "d3b04293270396c2 2bca30c354bafb2e"]
    assert found(texts, model) == [{"de"}, {"en", "fr"}, {"ja", "ru"}, set(), set(), set(), set(), set()]


def test_offsets():
    model = toy_model()
    texts = [SENTENCES["en"], SENTENCES["fr"] + "\n" + SENTENCES["de"]]
    s, language, _ = L.decide(texts, model)
    assert set(s.doc) == {0, 1} and s.end[-1] == len(texts[0]) + len(texts[1]) + 2
    assert (s.start[1:] == s.end[:-1]).all()


def test_very_long_sentence_is_cut_to_its_end():
    s = L.segment(["word " * 200_000])
    assert (s.end - s.start).max() < 250
    text = SENTENCES["en"].replace(".", ",") * 8_000 + SENTENCES["de"].replace(".", ",") * 8_000
    assert found([text], toy_model()) == [{"en", "de"}]


def test_one_block_or_many():
    model = toy_model()
    texts = [SENTENCES["en"], SENTENCES["de"], SENTENCES["ja"]] * 40
    s, language, _ = L.decide(texts, model)
    alone = [L.decide([t], model)[1].tolist() for t in texts[:3]]
    assert [language[s.doc == i].tolist() for i in range(3)] == alone


def test_labels(spark):
    rows = [("en",), ("en-US",), ("EN_gb",), (" de ",), (None,), ("",), ("und",)]
    assert [r[0] for r in spark.createDataFrame(rows, "l string").select(L.label_code("l")).collect()] == ["en", "en", "en", "de", None, "", "und"]
    cases = spark.createDataFrame([(1, "en", "en", False), (2, None, "de", False), (3, "fr", "de", False), (4, "de-AT", "de", True)], "id int, lang string, seg_lang string, mixed boolean")
    assert {r["id"] for r in L.wrong_labels(cases, "lang").collect()} == {2, 3, 4}


def test_operator_on_odd_tables(spark):
    model = toy_model()
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (3, "   ", "en", "x"), (4, SENTENCES["fr"] * 50, "en", "x"), (4, SENTENCES["fr"] * 50, "en", "x"), (5, "a" * 100_000, "en", "x"), (6, "12 34", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, seg_lang string")
    got = L.text_languages(df, model, "doc_id", "text", ["lang"]).collect()
    assert [(r["doc_id"], r["seg_lang"]) for r in got] == [(4, "fr"), (4, "fr")]
    seg = L.text_segments(df, model, "doc_id", "text").where("doc_id = 4").collect()
    assert len(seg) == 2 and seg[0]["start"] == 0 and seg[0]["n_chars"] >= len(SENTENCES["fr"]) * 50 - 2
    assert L.train(df.where("false"), "doc_id", "text", "lang") is None


def test_repeated_wrong_label_counts_once(spark):
    rows = []
    for code, t in SENTENCES.items():
        words = t.split(" ") if code != "ja" else list(t)
        for k in range(len(words)):
            rows.append((len(rows), (" " if code != "ja" else "").join(words[k:] + words[:k]), code))
    hot = "Nobody in the office has seen the other copies of the report, and we think that they were lost on the way."
    rows += [(10_000 + i, hot, "fr") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.train(df, "doc_id", "text", "lang", rows=30)
    found_ = {r["doc_id"]: r["seg_lang"] for r in L.text_languages(df, model, "doc_id", "text", []).collect()}
    assert {found_[10_000 + i] for i in range(600)} == {"en"}
    assert all(found_[i] == code for i, _, code in rows[:-600])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_labels(spark):
    """Texts outside the sample whose label is one of the ten: the found language is the label but for the wrong labels."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs, "doc_id", "text", "lang", rows=30)
    rows = L.text_languages(docs.where("length(text) > 200"), model, "doc_id", "text", ["lang"]).where("not mixed").withColumn("code", L.label_code("lang")).where(L.F.col("code").isin(*L.LANGUAGES))
    n, right = rows.count(), rows.where("code = seg_lang").count()
    assert n > 300 and right / n > 0.9


def test_characters_beyond_the_basic_plane():
    """Ideographs there are letters of their own, pictures are none."""
    a, b, c = L.segment(["𠀀𠀁𠀂"], whole=True), L.segment(["𠀃𠀄𠀅"], whole=True), L.segment(["🙂🔥🙂"], whole=True)
    assert a.letters.tolist() == b.letters.tolist() == [3] and c.letters.sum() == 0
    assert set(a.feature) != set(b.feature)
