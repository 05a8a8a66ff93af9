"""Split quotas, row index, class weights, metrics and SMOTE properties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kiln.operators import indexing, metrics, ml, sensors, smote, split

COUNTS = {"keterlambatan_pengiriman": 57, "produk_cacat": 32, "retur_barang": 22, "eskalasi_kritikal": 9}


def _tickets(spark):
    rows = []
    for label, n in COUNTS.items():
        rows += [(f"{label}-{i}", label) for i in range(n)]
    return spark.createDataFrame(rows, "ticket_id string, label string")


def test_split_quotas_and_exactness(spark):
    s = split.stratified_split(_tickets(spark), "ticket_id", "label")
    tr = dict(s.filter("split = 'train'").groupBy("label").count().collect())
    assert sum(tr.values()) == 96 and s.filter("split = 'test'").count() == 24
    for label, n in COUNTS.items():
        assert abs(tr[label] - n * 0.8) < 1                                # floor + at most one leftover
    # the leftover rows go to the largest remainders, ties by label
    assert tr == {"keterlambatan_pengiriman": 46, "produk_cacat": 26, "retur_barang": 17, "eskalasi_kritikal": 7}
    assert s.select("ticket_id").distinct().count() == 120               # disjoint and complete


def test_row_index_equals_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = indexing.row_index(ev, "event_id", ("event_type",), name="ri", ranges=37)
    w = Window.partitionBy("event_type").orderBy("event_id")
    exp = ev.withColumn("ri2", F.row_number().over(w) - 1)
    j = got.join(exp, "event_id").filter(F.col("ri") != F.col("ri2"))
    assert j.count() == 0 and got.count() == ev.count()


def test_row_index_any_key_and_order(spark):
    """Null groups and null, string or timestamp orders, over many ranges."""
    rows = [(f"k{i:03d}" if i else None, None if i % 3 == 0 else f"g{i % 2}", i) for i in range(90)]
    df = (spark.createDataFrame(rows, "o string, g string, i int")
          .withColumn("t", F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, i)")))
    for order in ("o", "t"):
        got = indexing.row_index(df, order, ("g",), ranges=17)
        w = Window.partitionBy("g").orderBy(order)
        assert got.count() == 90
        assert got.withColumn("want", F.row_number().over(w) - 1).filter("row_index <> want").count() == 0


def test_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([(f"k{i}", None if i % 3 == 0 else "a") for i in range(30)], "id string, label string")
    out = split.stratified_split(df, "id")
    assert out.count() == 30 and out.filter("split = 'test'").count() == 6


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "q int")
    w = {r.label: r.weight for r in split.class_weights(df, "q").collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}


def test_macro_metrics_with_zero_division(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "truth string, prediction string")
    s = metrics.classification_scores(pred).first()
    assert s.accuracy == 0.5
    # a: p=1 r=1/2; b: tp=1 of 3 predicted -> p=1/3, r=1; c: never predicted -> p=0 r=0
    assert abs(s.precision_macro - (1 + 1 / 3 + 0) / 3) < 1e-12
    assert abs(s.recall_macro - (0.5 + 1 + 0) / 3) < 1e-12
    rep = {r.label: r for r in metrics.classification_report(pred).collect()}
    assert rep["c"].f1 == 0.0 and rep["accuracy"].f1 == 0.5 and rep["macro avg"].support == 4


def test_failure_derivation_priority(spark):
    raw = spark.createDataFrame([(0, 1, 1, 0, 0, 0), (1, 0, 1, 1, 0, 0), (1, 0, 0, 0, 0, 0), (1, 0, 0, 0, 1, 1)],
                                "machine_failure int, twf int, hdf int, pwf int, osf int, rnf int")
    got = [r.failure_type for r in sensors.derive_failure_type(raw).collect()]
    assert got == ["No Failure", "Heat Dissipation Failure", "Random Failure", "Overstrain Failure"]


def test_smote_balances_and_stays_in_hull(spark):
    rows = [(f"a{i}", "A", float(i), float(i % 3)) for i in range(40)]
    rows += [(f"b{i}", "B", 100.0 + i, 5.0 - i) for i in range(6)]
    rows += [("c0", "C", -7.0, -7.0)]                                      # single member: copies
    df = spark.createDataFrame(rows, "id string, label string, x double, y double")
    out = smote.smote(df, "id", "label", ["x", "y"])
    summ = {r.label: r for r in smote.smote_summary(out, "label").collect()}
    assert all(r.n_total == 40 and r.within_bounds == 1 for r in summ.values())
    c = out.filter("label = 'C'").select("features").distinct().collect()
    assert [list(r.features) for r in c] == [[-7.0, -7.0]]


def test_labels_are_joined_without_a_shuffle(spark):
    """Most rows have one label: dealt out by label they would meet in one task."""
    df = spark.createDataFrame([(i, "a" if i % 10 else None) for i in range(100)], "id int, label string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (split.stratified_split(df, "id"), split.with_class_weight(df)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and not [x for x in plan.splitlines() if "SortMergeJoin" in x and "_bucket" not in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_classifier_learns_in_as_many_partitions_as_cores(spark, monkeypatch):
    seen = []
    fit = ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    rows = spark.createDataFrame([(f"word{i % 2} text", "ab"[i % 2]) for i in range(60)], "text string, label string").repartition(30)
    model = ml.train_complaint_classifier(rows, buckets=64, max_iter=5)
    assert seen == [spark.sparkContext.defaultParallelism]
    got = ml.classify_complaints(model, rows).select("label", "predicted_label").distinct().collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "b")]


def test_forest_rows_of_a_task_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i,) for i in range(100)], "x int").coalesce(2)
    assert ml._in_parts(rows).rdd.getNumPartitions() == 2
    monkeypatch.setattr(ml, "FOREST_ROWS", 15)
    assert ml._in_parts(rows).rdd.getNumPartitions() == 7


def test_rank_in_place_equals_rank_by_window(spark):
    rows = [(i, [None, "a", "b", "b", "b"][i % 5]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(5)
    a, b = (indexing.row_index(df.withColumn("h", split.row_hash(F.col("id"))), "h", ("label",), ranges=7, in_place=p) for p in (True, False))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.select(a.columns).collect()}


def test_smote_takes_the_rank_of_the_split(spark, monkeypatch):
    rows = [(i, ["a", "b", "b", "b"][i % 4], float(i % 17), float(i % 5)) for i in range(200)]
    train = split.stratified_split(spark.createDataFrame(rows, "id long, label string, x double, y double"), "id", "label")
    train = train.filter("split = 'train'").cache()
    plain = {str(r) for r in smote.smote(train, "id", "label", ["x", "y"]).collect()}

    def ranked_again(*args, **kwargs):
        raise AssertionError("the rows have a rank")
    monkeypatch.setattr(smote, "row_index", ranked_again)
    known = smote.smote(train, "id", "label", ["x", "y"], rank_col="class_rank")
    assert {str(r) for r in known.collect()} == plain and len(plain) == 2 * 120


def test_smote_summary_reads_the_rows_once(spark):
    rows = [("a", 0, [0.0, 1.0]), ("a", 0, [2.0, 1.0]), ("a", 1, [1.0, 1.0]), ("b", 0, [5.0, 5.0]), ("b", 1, [5.0, 6.0]),
            (None, 0, [1.0, None]), ("c", 0, []), ("d", 0, [0.0, 0.0]), ("d", 1, [float("nan"), 0.0])]
    out = smote.smote_summary(spark.createDataFrame(rows, "y string, is_synthetic int, features array<double>").withColumn(
        "sample_id", F.lit("s")), "y")
    assert {tuple(r) for r in out.collect()} == {("a", 2, 1, 3, 1), ("b", 1, 1, 2, 0), (None, 1, 0, 1, 1), ("c", 1, 0, 1, 1), ("d", 1, 1, 2, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
