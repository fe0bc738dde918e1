"""Language identification: codes, classifiers, held-out accuracy, odd input."""

import os

import numpy as np
import pytest
from corpus import frame, odd_rows
from pyspark.sql import functions as F

from millrace.llm import languages
from millrace.llm.queries import QUERIES

TABLES = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@needs_tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = QUERIES["op13_code_languages"](spark, TABLES)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6, 20, 60])
def test_codewords_are_far_apart(count):
    code = languages.codewords(count)
    bits = code.shape[1]
    assert set(np.unique(code)) == {-1.0, 1.0}
    assert all(len(set(code[:, b])) == 2 for b in range(bits))
    apart = (bits - code @ code.T) / 2
    least = apart[~np.eye(count, dtype=bool)].min()
    assert least >= (1 if count == 2 else 2 if count == 3 else 4)
    assert (code == languages.codewords(count)).all()


def test_decoding_corrects_a_wrong_bit():
    code = languages.codewords(4)
    model = languages.LanguageModel(list("abcd"), code, np.zeros((languages.DIMENSIONS + 1, 7)), np.ones(7), 1.0, 1.0)
    for k in range(4):
        for wrong in range(7):
            margins = 2 * code[k].copy()
            margins[wrong] *= -1
            assert model.losses(margins[None]).argmin() == k
        # A bit that is not trusted hardly counts, however sure it is.
        trust = np.ones(7)
        trust[0] = 1e-3
        unsure = languages.LanguageModel(list("abcd"), code, model.weights, trust, 1.0, 1.0)
        margins = code[k].copy()
        margins[0] *= -50
        assert unsure.losses(margins[None]).argmin() == k


def table_of(spark, rows, languages_):
    docs = frame(spark, rows)
    told = {i: lang for (i, _), lang in zip(rows, languages_)}
    return docs.join(spark.createDataFrame(list(told.items()), "k bigint, lang string"), docs["doc_id"].eqNullSafe(F.col("k")), "left").drop("k")


def test_odd_rows_and_few_languages(spark):
    rows = odd_rows()
    for told in ([None] * len(rows), ["xx"] * len(rows), ["xx" if k % 2 else "" for k in range(len(rows))]):
        docs = table_of(spark, rows, told)
        model = languages.fit_languages(docs, "doc_id", "text", "lang")
        got = languages.predict_languages(docs, "doc_id", "text", model).collect()
        assert len(got) == docs.count()
        for text, r in zip([d["text"] for d in docs.collect()], got):
            assert 0 <= r["score"] <= 1
            if not languages.has_letter(text) or not any(told):
                assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            else:
                assert r["lang_pred"] in set(told)
    empty = docs.where("false")
    model = languages.fit_languages(empty, "doc_id", "text", "lang")
    assert model.languages == [] and languages.predict_languages(empty, "doc_id", "text", model).count() == 0


def test_many_languages_and_long_texts(spark):
    draw = np.random.RandomState(1)
    letters = [list("abcdefghijklmnopqrstuvwxyz"[k : k + 6]) for k in range(0, 20, 2)] + [list("αβγδεζη"), list("дежзик")]
    words = [["".join(draw.choice(own, draw.randint(2, 7))) for _ in range(60)] for own in letters]
    prose = lambda k, n: " ".join(draw.choice(words[k], n))
    rows = [(i, prose(i % 12, 30)) for i in range(720)]
    rows[5] = (5, prose(5, 400_000))  # several MB
    docs = table_of(spark, rows, [f"l{i % 12:02}" for i, _ in rows])
    model = languages.fit_languages(docs, "doc_id", "text", "lang")
    assert len(model.languages) == 12
    got = {r["doc_id"]: r for r in languages.predict_languages(docs, "doc_id", "text", model).collect()}
    assert np.mean([got[i]["lang_pred"] == f"l{i % 12:02}" for i in range(720)]) > 0.97
    assert np.mean([got[i]["ambiguous"] for i in range(720)]) < 0.05
    # Texts half in one language and half in another are flagged.
    mixed = frame(spark, [(i, prose(i, 60) + " " + prose((i + 5) % 12, 60)) for i in range(12)])
    assert sum(r["ambiguous"] for r in languages.predict_languages(mixed, "doc_id", "text", model).collect()) >= 8


def test_labels_of_held_out_documents_are_not_read(spark):
    from millrace.llm.common import fold

    rows = [(i, ("alpha beta " if i % 2 else "gamma delta ") * 5) for i in range(200)]
    docs = table_of(spark, rows, ["p" if i % 2 else "q" for i, _ in rows])
    held = fold(F.col("doc_id")) == 0
    spoiled = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    assert languages.fit_languages(spoiled, "doc_id", "text", "lang").languages == ["p", "q"]
