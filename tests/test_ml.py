"""Model training: beats the majority class, persists and reloads identically."""

import inspect
import tempfile

import pytest
from pyspark.sql import functions as F

from kiln.operators import ml
from kiln.operators.sensors import FEATURES
from kiln.plans import queries
from kiln.plans.context import Ctx

SF = "/root/testdata/sf0.001"


def test_failure_model_floor_and_persistence(spark):
    sensors = Ctx(spark, SF).sensor
    trained = ml.train_failure_model(sensors, trees=20, depth=6, boost_iter=1)
    res = {(r.approach, r.model): r for r in trained.results.collect()}
    assert set(res) == {(a, m) for a in ("Baseline", "SMOTE") for m in ("random_forest", "boosted_trees")}
    assert sum(r.selected for r in res.values()) == 1
    best = max(res.values(), key=lambda r: (r.f1_macro, -r.candidate_order))
    assert best.selected == 1 and {r.rounds for r in res.values()} == {20, 1}
    test = ml.failure_dataset(sensors).filter(F.col("split") == "test").cache()
    majority = test.groupBy("failure_type").count().agg(F.max("count")).first()[0] / test.count()
    assert max(r.accuracy for r in res.values()) > majority
    path = tempfile.mkdtemp(prefix="kiln-model-") + "/m"
    ml.save_model(trained.model, path)
    again = ml.load_model(path)
    assert ml.model_features(again) == FEATURES and ml.model_labels(again) == trained.labels
    # raw readings go in, in any column order
    raw = sensors.select("record_id", *reversed(FEATURES))
    a = sorted((r.record_id, r.predicted_failure) for r in ml.score_failures(trained.model, raw).collect())
    b = sorted((r.record_id, r.predicted_failure) for r in ml.score_failures(again, raw).collect())
    assert a == b and len(a) == sensors.count()


def test_top_classes(spark):
    from pyspark.ml.functions import array_to_vector
    p = spark.createDataFrame([([0.1, 0.2, 0.65, 0.05],)], "p array<double>")
    got = p.select(ml.top_classes(array_to_vector("p"), ["a", "b", "c", "d"])).first()[0]
    assert got == "c=65.00%, b=20.00%, a=10.00%"


def test_complaint_classifier_distribution(spark):
    from kiln.operators import split
    ds = split.prepare_text_dataset(Ctx(spark, SF).tickets).cache()
    model = ml.train_complaint_classifier(ds.filter("split = 'train'"), max_iter=20)
    out = ml.classify_complaints(model, ds.filter("split = 'test'")).collect()
    assert out
    for r in out[:20]:
        probs = {kv.split("=")[0]: float(kv.split("=")[1]) for kv in r.distribution.split(", ")}
        assert len(probs) == 4 and abs(sum(probs.values()) - 1) < 2e-3
        assert abs(max(probs.values()) - r.confidence) < 1e-3 and probs[r.predicted_label] == max(probs.values())


def test_registered_training_uses_all_rounds(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def rounds(*args, **kwargs):
        call = inspect.signature(train).bind(*args, **kwargs)
        call.apply_defaults()
        seen.append(call.arguments["boost_iter"])
        raise Stop

    train = ml.train_failure_model
    monkeypatch.setattr(ml, "train_failure_model", rounds)
    for name in ("train_failure_model", "score_failures"):
        with pytest.raises(Stop):
            queries.QUERIES[name](spark, SF)
    assert seen == [ml.BOOST_ITER] * 2 == [200, 200]


def test_classifier_hash_buckets():
    default = inspect.signature(ml.train_complaint_classifier).parameters["buckets"].default
    assert default == ml.TEXT_BUCKETS >= 1 << 18
