"""Operators that learn, by accuracy on rows set apart, gradients, and awkward rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.awkward import awkward, empty, texts
from tidecast.llm import language_gru, quality_gam, toxicity
from tidecast.llm.queries import QUERIES
from tidecast.llm.text_batches import texts_of

SF_DIR = "/root/testdata/sf0.01"


def held(doc_id, folds, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == remainder


def labelled(spark, name, column):
    rows = QUERIES[name](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").toPandas()
    assert (rows["held_out"] == [held(i, 5, 0) for i in rows["doc_id"]]).all() and rows["score"].between(0, 1).all()
    return rows[rows["held_out"]], rows[rows["held_out"]][column]


def test_quality_on_held_out_rows(spark):
    rows, label = labelled(spark, "op2_quality_gam", "quality")
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all() and (rows["predicted"] == label).mean() > 0.93


def test_quality_sample_is_a_share_of_rows_with_a_document(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(200_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = quality_gam.labelled_rows(docs, labels, "quality")
    assert 500 <= quality_gam.labelled_sample(rows, 500).count() < rows.count() and quality_gam.labelled_sample(rows, 5000).count() == rows.count()


def test_toxicity_on_held_out_rows(spark):
    rows, label = labelled(spark, "op8_toxicity_kneser_ney", "toxic")
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all() and (rows["predicted"] == label).mean() > 0.9
    # Of the small table's rows set apart, all toxic ones are caught and 3 % of the clean ones flagged.
    caught, flagged = rows["predicted"][label == 1].mean(), rows["predicted"][label == 0].mean()
    assert caught > 0.9 and flagged < 0.05


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_gru"](spark, SF_DIR).join(docs, "doc_id").toPandas()
    assert (rows["held_out"] == [held(i, 4, 2) for i in rows["doc_id"]]).all() and rows["score"].between(0, 1).all()
    rows = rows[rows["held_out"]]
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    parameters = {k: v.astype(float) for k, v in language_gru.new_parameters(3, rng).items()}
    ids, mask, owner = language_gru.as_steps([b"abc", b"a word longer than steps", b"z"])
    labels = np.array([0, 1, 2])[owner]

    def loss():
        logs = language_gru.log_probabilities(parameters, ids, mask)[0][:, np.arange(ids.shape[1]), labels]
        return -np.where(mask[:, :, 0], logs, 0).sum() / mask.sum()

    for name, gradient in language_gru.gradients(parameters, ids, mask, labels).items():
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        parameters[name][at] += 1e-4
        high = loss()
        parameters[name][at] -= 2e-4
        low = loss()
        parameters[name][at] += 1e-4
        np.testing.assert_allclose((high - low) / 2e-4, gradient[at], rtol=1e-3)


def test_word_results_do_not_depend_on_the_batch():
    model = language_gru.LanguageModel(["a", "b"], language_gru.new_parameters(2, np.random.default_rng(1)))
    words = [b"one", b"x" * 50, b"longer-word", b"q"]
    together = model.word_sums(words)[0]
    alone = np.concatenate([model.word_sums([w])[0] for w in words])
    np.testing.assert_allclose(together, alone, rtol=1e-4)


def test_kneser_ney_ratios():
    """Seen in one class only: evidence for it. Seen in neither: none beyond what the contexts say."""
    text = b"good good good bad bad"
    keys, _ = toxicity.windows([b"bad"])
    other, _ = toxicity.windows([b"good"])
    grams = np.concatenate([keys, other])
    model = toxicity.kneser_ney(grams, np.r_[[9] * len(keys), [0] * len(other)], np.r_[[0] * len(keys), [9] * len(other)])
    assert (model.ratios[np.isin(model.windows, keys[1:])] >= 0).all() and text
    assert (model.ratios[np.isin(model.windows, other[1:])] <= 0).all()
    import pyarrow as pa

    evidence = model.evidence(texts_of(pa.array(["bad bad", "good", "", None, "zzz"])), (0.5,))[:, 0]
    assert evidence[0] > 0 and evidence[1] == evidence[2] == evidence[3] == 0


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    gam = quality_gam.fit_gam(x[:3000], y[:3000])
    assert (0, 3) in gam.pairs and ((gam.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert quality_gam.Gam(*gam.state()).score(x[:5]).shape == (5,)


def test_awkward_rows(spark):
    docs, n = awkward(spark), len(texts())
    labels = spark.createDataFrame(
        [(1, 1, 0), (3, 0, 1), (3, None, 0), (None, 1, 1), (8, 1, 1), (16, 0, 0), (999, 0, 0)], "doc_id long, quality int, toxic int"
    )
    none = labels.limit(0)
    for query, column, threshold in ((quality_gam.quality, "quality", 0.3), (toxicity.toxicity, "toxic", 0.5)):
        for known in (labels, none):
            rows = query(docs, known).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
            assert [r.held_out for r in rows] == [held(r.doc_id, 5, 0) for r in rows]
        assert query(empty(spark), labels).collect() == []
    rows = language_gru.languages(docs).collect()
    assert len(rows) == n and {r.lang_pred for r in rows} == {"en", "und"}
    nothing = {i for i, t in texts() if not t or not any(c.isalpha() for c in t)}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == nothing
    unlabelled = language_gru.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    assert language_gru.languages(empty(spark)).collect() == []
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
