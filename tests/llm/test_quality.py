"""The classifier by held-out accuracy, and its edge cases."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.quality import Model, Settings, View, co_train, features, fit_models, score


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    rows = score(docs, fit_models(docs, labels.where(~held)), ["doc_id"]).join(labels.where(held), "doc_id").collect()
    right = [(r.quality_score >= 0.5) == (r.quality == 1) for r in rows]
    assert sum(right) > 0.96 * len(right)
    toxic = [r.toxic_score >= 0.5 for r in rows if r.toxic == 1]
    assert sum(toxic) > 0.7 * len(toxic)
    clean = [r.accepted for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(clean) > 0.985 * len(clean)


def test_confident_rows_of_one_view_teach_the_other():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 600)
    rows = np.arange(600)
    first = (rows, truth.copy())  # perfect in the first view
    second = (np.repeat(rows, 2), np.stack([np.where(rows < 60, 9, truth + 3), np.full(600, 5)], axis=1).ravel())  # uninformative where labelled
    labels = np.where(rows < 60, truth, -1)
    alone = View().fit(*second, np.arange(60), truth[:60], Settings(least_z=2))
    assert not len(alone.picked)
    taught = co_train([first, second], labels, Settings(share=0.5, least_z=2, sure=0.8))
    assert len(taught.views[1].picked)
    assert ((taught.views[1].scores(*second, 600)[60:] > 0) == truth[60:]).mean() > 0.99


def test_features_of_odd_texts():
    texts = ["", "a", "\n\n", "x" * 100_000, "!! !!", "é é"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(["de", None, "", "en", "en", "en"]), pa.array([None] * 6, pa.string()), pa.array([0, None, -5, 7, 5, 3], pa.int64())],
        names=["__sm_text", "__sm_lang", "__sm_source", "__sm_chars"],
    )
    for rows, dims in features(batch):
        assert len(rows) == len(dims) and len(set(zip(rows.tolist(), dims.tolist(), strict=True))) == len(rows)


def test_nulls_repeats_clashes_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None, 9), (1, "a b", None, None, None, 9), (None, None, "de", "s", 3, 9)],
                                 "doc_id long, text string, lang string, source string, n_chars long, accepted int")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    models = fit_models(docs, labels)
    assert all(m.constant == 0.5 for m in models.values())
    models["toxic"] = Model(constant=0.2)
    rows = score(docs, models, ["doc_id", "text"]).collect()
    assert len(rows) == 3 and all(r.accepted for r in rows)
    assert score(docs.where("false"), models, ["doc_id"]).count() == 0
    assert score(docs.select("doc_id"), models).count() == 3
