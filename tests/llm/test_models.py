import numpy as np
import pytest

from eventsift.llm import language_id, quality_model, toxicity
from eventsift.llm.queries import QUERIES, fold, graded

FOLDER = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op1_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(odd):
    dictionaries = language_id.learn_dictionaries(odd)
    assert list(dictionaries) == ["de", "en"]
    got = language_id.identify(odd, dictionaries).collect()
    assert len(got) == odd.count()
    for r in got:
        has_letter = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] in dictionaries) == has_letter and (has_letter or (r["score"], r["accepted"]) == (0.0, False))
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    none = odd.where("false")
    assert language_id.learn_dictionaries(none) == {} and language_id.identify(none, dictionaries).collect() == []


def test_three_hundred_languages_with_one_long_text_among_them(spark):
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows, words = [], {}
    for i in range(300):
        words[i] = ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(40)]
        texts = 1 if i == 7 else 3
        rows += [(f"l{i}", " ".join(rng.choice(words[i], 4000 if i == 7 else 60))) for _ in range(texts)]
    rows += [("l0", rows[0][1])] * 2000  # copies fill no dictionary
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    dictionaries = language_id.learn_dictionaries(docs, size=2000)
    assert len(dictionaries) == 300
    assert len(dictionaries["l7"]) == 2000 and len(dictionaries["l0"]) > 900
    held = [(f"l{i}", " ".join(rng.choice(words[i], 30))) for i in range(0, 300, 10)] + [("l7", " ".join(rng.choice(words[7], 30)))]
    got = language_id.identify(spark.createDataFrame(held, "lang string, text string"), dictionaries).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_sizes_equal_those_of_the_library(spark):
    import zstandard

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null").limit(60)
    dictionaries = language_id.learn_dictionaries(spark.read.parquet(f"{FOLDER}/documents.parquet"), size=4000)
    for r in language_id.identify(docs, dictionaries).collect():
        data = language_id._letters(r["text"])
        sizes = {}
        for lang, content in dictionaries.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            make = zstandard.ZstdCompressor(level=9, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(make.compress(data[i : i + 8192])) for i in range(0, len(data), 8192))
        if data.strip():
            assert sizes[r["lang_pred"]] <= 1.002 * min(sizes.values())


def test_narrow_margins_are_rejected(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",)], "text string")
    same = {"a": b"the cat sat on the mat ", "b": b"the cat sat on the mat "}
    row = language_id.identify(docs, same).first()
    assert (row["lang_pred"], row["accepted"]) == ("a", False) and row["score"] == pytest.approx(0.5)


def test_grades_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = QUERIES["op8_quality_model"](spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.93 * len(got)
    assert all(0 <= r["p_grade_2"] <= r["p_grade_1"] <= 1 for r in got)
    assert all(r["expected_grade"] == pytest.approx(r["p_grade_1"] + r["p_grade_2"]) for r in got)


def test_rating_of_odd_rows(spark, odd):
    ratings = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (None, 1), (6, None), (6, 9)], "doc_id bigint, grade int")
    model = quality_model.learn(odd, ratings)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality_model.select(odd, model).collect()
    assert len(got) == odd.count() and all(len(r["tails"]) == 2 for r in got)
    none = odd.where("false")
    blank = quality_model.learn(none, ratings)
    assert quality_model.rate(none, blank).collect() == [] and not blank.weights.any()


def test_batch_margins_equal_features(odd):
    model = quality_model.OrdinalModel(np.random.default_rng(1).normal(size=(1 << 16) + 3), np.array([0.0, 1.0]))
    for r in odd.select("text").collect():
        columns, values = quality_model.features(r["text"])
        assert model.margins([r["text"]])[0] == pytest.approx(model.weights[columns] @ values)


def test_toxic_texts_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    caught = [r["predicted"] for r in got if r["toxic"] == 1]
    assert sum(caught) >= 0.7 * len(caught)
    assert sum(r["predicted"] for r in got if r["toxic"] == 0) <= 0.01 * len(got)


@pytest.mark.parametrize("share", [0.5, 0.06])
def test_exclusive_or_is_learned_by_factors_alone(spark, share):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(5000):
        insult, group = (rng.random(2) < share).tolist()
        words = [f"w{x}" for x in rng.integers(0, 300, 12)] + ["vermin"] * insult + ["strangers"] * group
        rows.append((i, " ".join(words), int(insult and group) if share < 0.5 else int(insult != group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:4000]], "doc_id bigint, toxic int")
    held = rows[4000:]

    def right(rank):
        model = toxicity.learn(docs, labels, rank=rank)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
        return sum((got[i] > 0.5) == y for i, _, y in held) / len(held)

    assert right(4) >= 0.97
    if share == 0.5:
        assert right(0) <= 0.6  # what weights without interactions reach


def test_predictions_are_not_those_of_the_weights_alone(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    linear = toxicity.FactorizationMachine(model.hashes, model.bias, model.linear, model.factors * 0)
    both = toxicity.score(docs, model, keep=["doc_id"]).join(
        toxicity.score(docs, linear, keep=["doc_id"]).select("doc_id", toxicity.F.col("predicted").alias("other")), "doc_id"
    )
    assert both.where("predicted <> other").count() > 0


def test_margin_equals_all_pairs():
    rng = np.random.default_rng(3)
    fm = toxicity.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = np.array([1, 4, 5, 8])
    pairs = sum(fm.factors[a] @ fm.factors[b] for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert fm.margin(rows) == pytest.approx(0.3 + fm.linear[rows].sum() + pairs)


def test_scoring_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (6, None), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.learn(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = odd.where("false")
    assert toxicity.score(none, toxicity.learn(none, labels.where("false"))).collect() == []


def test_folds_and_grades(spark):
    import zlib

    frame = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint")
    for r in frame.select("doc_id", fold("doc_id", 4).alias("f")).collect():
        assert r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    assert [r["grade"] for r in graded(labels).orderBy("doc_id").collect()] == [0, 0, 1, 2, 2]
