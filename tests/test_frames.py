"""Scenarios with known numbers: operators, inspections, checks, features and models."""

import math

import pytest
from pyspark.sql import functions as F

from pipelens import functions as ml
from pipelens import sources
from pipelens.checks import CheckStatus, InspectionResult, NoBiasIntroducedFor, NoIllegalFeatures, NoMissingEmbeddings, SimilarRemovalProbabilitiesFor
from pipelens.inspections import (
    ColumnPropagation, CompletenessOfColumns, CountDistinctOfColumns, HistogramForColumns, IntersectionalHistogramForColumns,
    MaterializeFirstOutputRows, MissingEmbeddings, RowLineage,
)
from pipelens.inspections.base import Annotation, Inspection
from pipelens.plans.model import LineageId, OperatorType
from pipelens.plans.recorder import Recorder

NAN = float("nan")


@pytest.fixture
def make(spark):
    recorder = Recorder(
        [HistogramForColumns(["A"]), IntersectionalHistogramForColumns(["A", "C"]), RowLineage(RowLineage.ALL_ROWS), ColumnPropagation(["A"], 2)], track_code=False
    )

    def literal(schema, *rows):
        return sources.literal_frame(spark, rows, schema, recorder)

    literal.recorder = recorder
    return literal


def f1(make):
    a = make("A string, B bigint", ("cat_a", 1), ("cat_b", 2), ("cat_a", 4), ("cat_c", 5), ("cat_b", 7))
    b = make("B bigint, C double", (1, 1.0), (2, 5.0), (3, 4.0), (4, 11.0), (5, None))
    return a, b


def values(frame, *columns):
    return [tuple(r) for r in frame.hidden.orderBy("__ord").select(*columns).collect()]


def lineage(frame):
    return [set(x) for x in RowLineage(RowLineage.ALL_ROWS).result(frame)["lineage"]]


def test_histogram_of_a_join(make):
    a, b = f1(make)
    joined = a.join(b, on="B")
    h = HistogramForColumns(["A"])
    assert h.result(a) == {"A": {"cat_a": 2, "cat_b": 2, "cat_c": 1}}
    assert h.result(b) == {"A": {}}
    assert h.result(joined) == {"A": {"cat_a": 2, "cat_b": 1, "cat_c": 1}}
    assert LineageId(0, 0) in lineage(joined)[0] and LineageId(1, 0) in lineage(joined)[0]
    assert sum(h.result(joined)["A"].values()) == joined.df.count()


def test_histogram_follows_what_was_projected_away(make):
    a = make("A string, B bigint, C bigint", ("cat_a", 1, 2), ("cat_b", 2, 2), ("cat_a", 4, 10), ("cat_c", 5, 5), ("cat_b", 7, 7))
    for frame in (a.select("B", "C"), a.select("B", "C").select("C")):
        assert HistogramForColumns(["A"]).result(frame) == {"A": {"cat_a": 2, "cat_b": 2, "cat_c": 1}}


def test_several_columns_in_one_pass_keep_nulls_apart(make):
    a = make("A string, C string", ("x", None), (None, None), ("x", "y"))
    h = HistogramForColumns(["A", "C"])
    a.recorder.inspections.append(h)
    again = sources.literal_frame(a.spark, [("x", None), (None, None), ("x", "y")], "A string, C string", a.recorder)
    assert h.result(again) == {"A": {"x": 2, None: 1}, "C": {None: 2, "y": 1}}


def test_intersectional(make):
    a = make("A string, B bigint, C boolean", ("cat_a", 1, True), ("cat_b", 2, False), ("cat_a", 4, True), ("cat_b", 5, True), ("cat_b", 7, True))
    b = make("B bigint, D double", (1, 1.0), (2, 5.0), (3, 4.0), (4, 11.0), (5, None))
    x = IntersectionalHistogramForColumns(["A", "C"])
    assert x.result(a) == {("cat_a", "true"): 2, ("cat_b", "false"): 1, ("cat_b", "true"): 2}
    assert x.result(b) == {(None, None): 5}
    assert x.result(a.join(b, on="B")) == {("cat_a", "true"): 2, ("cat_b", "false"): 1, ("cat_b", "true"): 1}


def test_completeness_and_distinct(make):
    a = make("A string, B bigint", ("cat_a", 1), (None, 2), ("cat_a", 4), ("cat_c", 5), (None, 7))
    b = make("B bigint, C double", (1, 1.0), (2, 5.0), (3, 4.0), (4, 11.0), (None, None))
    joined = a.join(b, on="B")
    c, d = CompletenessOfColumns(["A", "B"]), CountDistinctOfColumns(["A", "B"])
    assert c.result(a) == {"A": 0.6, "B": 1.0} and c.result(b) == {"B": 0.8}
    assert c.result(joined) == {"A": pytest.approx(2 / 3), "B": 1.0}
    assert d.result(a) == {"A": 3, "B": 5} and d.result(b) == {"B": 5} and d.result(joined) == {"A": 2, "B": 3}
    assert c.result(a.filter(F.lit(False))) == {"A": None, "B": None}
    e = make("B double", (1.0,), (None,), (NAN,), (None,), (7.0,))
    assert CountDistinctOfColumns(["B"]).result(e) == {"B": 3}
    assert CountDistinctOfColumns(["B"], nan_mode="reference").result(e) == {"B": 5}


def test_propagation_and_first_rows(make):
    a, b = f1(make)
    out = ColumnPropagation(["A"], 2).result(a.select("B").join(b, on="B"))
    assert out.values.tolist() == [[1, 1.0, "cat_a"], [2, 5.0, "cat_b"]]
    assert ColumnPropagation(["A"], 2).result(b)["propagated_A"].tolist() == [None, None]
    assert len(MaterializeFirstOutputRows(3).result(a)) == 3
    assert len(MaterializeFirstOutputRows(3).result(a.filter(F.lit(False)))) == 0


def test_joins(make):
    a = make("A bigint, B bigint", (0, 1), (2, 2), (4, 4), (8, 5), (5, 7))
    b = make("C bigint, D double", (1, 1.0), (2, 5.0), (3, 4.0), (4, 11.0))
    both = a.join(b, left_on="B", right_on="C")
    assert both.columns == ["A", "B", "C", "D"] and both.node.details.description == "on 'B' == 'C'"
    outer = a.join(b, left_index=True, right_index=True, how="outer")
    assert outer.node.details.description == "on left_index == right_index (outer)"
    assert values(outer, "A", "C")[-1] == (5, None) and len(lineage(outer)[-1]) == 1
    left = make("A bigint, B bigint", (0, 7), (2, 5), (4, 4), (8, 2), (5, 1))
    right = make("B bigint, C double", (1, 1.0), (4, 5.0), (3, 4.0), (2, 11.0), (5, None))
    assert [r.A for r in left.join(right, on="B", sort=True).df.collect()] == [5, 8, 4, 2]
    k = make("k string, x bigint", (None, 1), ("a", 2))
    assert sorted(values(k.join(make("k string, y bigint", (None, 3), ("b", 4)), on="k"), "x", "y")) == [(1, 3)]
    itself = k.join(k, on="k")
    assert itself.columns == ["k", "x_x", "x_y"] and itself.df.count() == 2


def test_unary_operators(make):
    a = make("A bigint, B double", (0, 1.0), (2, 5.0), (4, 4.0), (8, 11.0), (5, None))
    kept = a[F.col("A") > 3]
    assert values(kept, "A") == [(4,), (8,), (5,)] and lineage(kept)[0] == {LineageId(0, 2)}
    assert a.dropna().df.count() == 4
    assert values(a.with_column("A", F.col("A") + 1), "A")[0] == (1,)
    s = make("A string", ("Low",), ("Medium",), ("Low",), ("High",), (None,))
    assert values(s.replace("Medium", "Low"), "A") == [("Low",), ("Low",), ("Low",), ("High",), (None,)]
    y = make("A string", ("yes",), ("no",), ("no",), ("yes",))
    assert [x[0] for x in values(y.label_binarize(["no", "yes"]), "array")] == [[1.0], [0.0], [0.0], [1.0]]
    for wrong in (lambda: a[1], lambda: a.with_column(1, F.lit(1)), lambda: a.replace(F.lit(1), 2)):
        with pytest.raises(NotImplementedError):
            wrong()
    with pytest.raises(KeyError):
        a.select("nothing")


def test_groups_are_new_sources(make):
    g = make("group string, value bigint", ("A", 1), ("B", 2), ("A", 1), ("C", 3), ("B", 4), (None, 9)).groupby("group").agg(mean=("value", "mean"))
    assert values(g, "group", "mean") == [("A", 1.0), ("B", 3.0), ("C", 3.0)]
    assert lineage(g)[:2] == [{LineageId(1, 0)}, {LineageId(1, 1)}]


def test_split(make):
    a = make("A bigint", *[(i,) for i in range(4)])
    train, test = a.train_test_split(0.25, seed=0)
    assert train.df.count() == 3 and test.df.count() == 1
    assert sorted(r.A for r in train.df.union(test.df).collect()) == [0, 1, 2, 3]
    assert values(a.train_test_split(0.25, seed=0)[1], "A") == values(test, "A")
    assert a.train_test_split(0.0)[1].df.count() == 0 and a.train_test_split(1.0)[0].df.count() == 0
    empty = a.filter(F.lit(False)).train_test_split()
    assert [f.df.count() for f in empty] == [0, 0]


def check(make, check):
    return check.evaluate(InspectionResult(make.recorder.dag, make.recorder.frames))


def test_bias_of_a_join(make):
    a, b = f1(make)
    a.join(b, on="B")
    found = check(make, NoBiasIntroducedFor(["A"]))
    assert found.status == CheckStatus.FAILURE and "'A' loses share, its relative change of -0.375" in found.description
    assert found.details[0].table["relative_ratio_change"].tolist() == pytest.approx([0.25, -0.375, 0.25])
    assert check(make, SimilarRemovalProbabilitiesFor(["A"])).status == CheckStatus.SUCCESS


def test_bias_of_an_imputer(make):
    ml.SimpleImputer("most_frequent").fit_transform(make("A string", ("cat_a",), (None,), ("cat_a",), ("cat_c",)))
    found = check(make, NoBiasIntroducedFor(["A"]))
    assert found.status == CheckStatus.SUCCESS and found.details[0].value == 0
    table = found.details[0].table
    assert table["count_after"].tolist() == [3, 1, 0] and table["relative_ratio_change"].tolist() == [0.5, 0.0, -1.0]
    assert check(make, SimilarRemovalProbabilitiesFor(["A"])).details[0].value == 0


def test_removal_by_dropna(make):
    make("A string, B double", ("cat_a", None), ("cat_a", None), ("cat_c", 1.0), ("cat_c", 2.0), ("cat_c", None)).dropna()
    found = check(make, SimilarRemovalProbabilitiesFor(["A"]))
    assert found.status == CheckStatus.FAILURE and found.details[0].value == pytest.approx(3.0)


def test_nothing_removed_is_a_success(make):
    make("A string", ("x",), ("y",)).filter(F.lit(True))
    assert check(make, SimilarRemovalProbabilitiesFor(["A"])).status == CheckStatus.SUCCESS
    assert check(make, SimilarRemovalProbabilitiesFor(["A"], strict=True)).status == CheckStatus.FAILURE


def test_illegal_features(make):
    df = make("age bigint, B string, C string, target string", (1, "a", "x", "no"), (2, "b", "y", "yes"), (3, "a", "x", "no"), (4, "b", "y", "yes"))
    ct = ml.ColumnTransformer([("n", ml.StandardScaler(), ["age"]), ("c", ml.OneHotEncoder(), ["B", "C"])])
    ml.DecisionTreeClassifier().fit(ct.fit_transform(df.select("age", "B", "C")), df.select("target").label_binarize(["no", "yes"]))
    assert check(make, NoIllegalFeatures(["C"])).details == ["C", "age"]


def test_features(make):
    x = make("A double", (1.0,), (2.0,), (10.0,), (5.0,))
    array = lambda f: [v for (row,) in values(f, "array") for v in row]
    assert array(ml.StandardScaler().fit_transform(x)) == pytest.approx([-1, -0.71428571, 1.57142857, 0.14285714])
    assert array(ml.KBinsDiscretizer(3).fit_transform(x)) == [0, 0, 2, 1]
    c = make("A string", ("cat_a",), ("cat_b",), ("cat_a",), ("cat_c",))
    assert [r for (r,) in values(ml.OneHotEncoder().fit_transform(c), "array")] == [[1, 0, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1]]
    assert values(ml.SimpleImputer("most_frequent").fit_transform(make("A string", ("cat_a",), (None,), ("cat_a",), ("cat_c",))), "A")[1] == ("cat_a",)
    hashed = ml.HashingVectorizer(4, ngram_range=(1, 3), hash="murmur3").fit_transform(c)
    assert [r for (r,) in values(hashed, "array")] == [[0, 0, 0, -1], [0, -1, 0, 0], [0, 0, 0, -1], [0, 0, 0, -1]]
    mixed = make("A double, B string", (1.0, "cat_a"), (2.0, "cat_b"), (10.0, "cat_a"), (5.0, "cat_c"))
    ct = ml.ColumnTransformer([("n", ml.StandardScaler(), ["A"]), ("c", ml.OneHotEncoder(), ["B"])])
    assert [r for (r,) in values(ct.fit_transform(mixed), "array")][1] == pytest.approx([-0.71428571, 0, 1, 0])
    with pytest.raises(Exception, match="unknown category"):
        ml.OneHotEncoder().fit(c.filter(F.col("A") == "cat_a")).transform(c).df.collect()
    log = ml.FunctionTransformer(lambda v: F.log(v)).fit_transform(x)
    assert values(log, "A")[2] == (pytest.approx(math.log(10)),)


def test_missing_embeddings(make):
    words = make("A string", ("cat_a",), ("cat_b",), ("cat_a",), ("cat_c",))
    out = ml.Word2Vec(2, min_count=2).fit_transform(words)
    assert MissingEmbeddings().result(out) == {"missing": 2, "examples": ["cat_b", "cat_c"]}
    assert check(make, NoMissingEmbeddings()).status == CheckStatus.FAILURE


@pytest.mark.parametrize("model", [ml.DecisionTreeClassifier(), ml.SGDClassifier(loss="log_loss"), ml.LogisticRegression(C=10.0)])
def test_models_score(make, model):
    df = make("A double, B double, target string", (0.0, 0.0, "no"), (0.0, 0.1, "no"), (1.0, 1.0, "yes"), (1.0, 0.9, "yes"))
    model.fit(df.select("A", "B"), df.select("target").label_binarize(["no", "yes"]))
    test = make("A double, B double, target string", (0.0, 0.0, "no"), (1.0, 1.0, "yes"))
    assert model.score(test.select("A", "B"), test.select("target").label_binarize(["no", "yes"])) == 1.0
    last = make.recorder.dag.nodes[-1]
    assert [n.operator for n in make.recorder.dag.predecessors(last)] == [OperatorType.ESTIMATOR, OperatorType.TEST_DATA, OperatorType.TEST_LABELS]
    assert make.recorder.frames[last].hidden.count() == 2


def test_custom_annotation_follows_its_rows(spark):
    class Mark(Annotation):
        name = "__mark"

        def source(self, op_id, columns, row_id):
            return F.xxhash64(row_id)

        def nary(self, outputs, currents):
            return F.coalesce(*currents)

    class Marks(Inspection):
        def annotations(self):
            return [Mark()]

        def frame(self, at):
            return at.hidden.select("A", "__mark")

    recorder = Recorder([Marks()], track_code=False)
    a = sources.literal_frame(spark, [(i,) for i in range(20)], "A bigint", recorder)
    b = sources.literal_frame(spark, [(i, i) for i in range(0, 20, 2)], "A bigint, x bigint", recorder)
    out = a.filter(F.col("A") > 3).with_column("y", F.col("A")).join(b, on="A").dropna()
    want = {r.A: r.m for r in spark.range(20).select(F.col("id").alias("A"), F.xxhash64("id").alias("m")).collect()}
    got = [tuple(r) for r in Marks().frame(out).collect()]
    assert len(got) == 8 and all(want[a] == m for a, m in got)


def test_row_ids_of_several_files(spark, tmp_path):
    path = str(tmp_path / "a b")
    spark.range(100).withColumn("part", F.col("id") % 2).repartition(3).write.partitionBy("part").parquet(path)
    frame = sources.read_parquet(spark, path, recorder=Recorder(track_code=False))
    ids = [r[0] for r in frame.hidden.select(F.col("__ord")[0]).collect()]
    assert len(set(ids)) == 100 and sorted(r.id for r in frame.df.collect()) == list(range(100))
    again = dict((r.id, r.o) for r in frame.hidden.select("id", F.col("__ord")[0].alias("o")).collect())
    assert again == dict((r.id, r.o) for r in frame.hidden.repartition(5).select("id", F.col("__ord")[0].alias("o")).collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, sf):
    """Filters reach the scan, unused columns and annotations do not, and nothing runs in Python."""
    recorder = Recorder([RowLineage(5), HistogramForColumns(["c_mktsegment"])], track_code=False)
    at = sources.read_parquet(spark, f"{sf}/customer.parquet", normalize=False, recorder=recorder).filter(F.col("c_acctbal") > 100).select("c_custkey")
    physical = plan(HistogramForColumns(["c_mktsegment"]).frame(at)).split("== Physical Plan ==")[1]
    assert "GreaterThan(c_acctbal,100.0)" in physical and "c_name:string" not in physical and "Python" not in physical
    assert "__lin" not in physical


def test_pipeline_of_a_program(spark, sf, tmp_path):
    import json

    from pipelens.inspector import PipelineInspector
    from pipelens.plans.viz import describe, save_dot, to_dot

    program = f"""
from pyspark.sql import functions as F
from pipelens.functions import ColumnTransformer, LogisticRegression, OneHotEncoder, StandardScaler
data = spark.read.parquet("{sf}/customer.parquet")
clean = data.dropna()
labels = clean.select(
    "c_acctbal").withColumn("rich", (F.col("c_acctbal") > 0).cast("int")).select("rich")
features = ColumnTransformer([("c", OneHotEncoder(), ["c_mktsegment"]), ("n", StandardScaler(), ["c_acctbal"])]).fit_transform(clean)
LogisticRegression(max_iter=2).fit(features, labels)
"""
    lineages = RowLineage(2)
    result = PipelineInspector.on_pipeline_from_string(program).add_required_inspection(lineages).add_check(NoIllegalFeatures()).execute(spark)
    kinds = [n.operator for n in result.dag.nodes]
    assert kinds.count(OperatorType.TRANSFORMER) == 2 and kinds[-1] == OperatorType.ESTIMATOR and OperatorType.MISSING_OP not in kinds
    code = result.dag.find(OperatorType.PROJECTION)[0].optional_code_info
    assert code.source_code == 'clean.select(\n    "c_acctbal")' and code.code_reference.lineno == 6
    assert "->" in to_dot(result.dag) and "Selection [dropna]" in describe(result.dag)
    save_dot(result.dag, tmp_path / "dag.dot")
    assert all(len(r[lineages]) == 2 for r in result.dag_node_to_inspection_results.values())
    assert result.checks_frame(spark).count() == 1

    book = tmp_path / "p.ipynb"
    book.write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["%matplotlib inline\n", f"d = spark.read.parquet('{sf}/region.parquet')"]}, {"cell_type": "markdown", "source": ["x"]}, {"cell_type": "code", "source": ["e = d.limit(3)\n", "e.filter('r_regionkey > 0')"]}]}))
    dag = PipelineInspector.on_pipeline_from_ipynb_file(str(book)).set_code_reference_tracking(False).execute(spark).dag
    assert [n.node_id for n in dag.nodes] == [0, -1, 1] and dag.nodes[1].operator == OperatorType.MISSING_OP
    assert dag.nodes[0].optional_code_info is None

    before = type(spark.range(1)).filter
    with pytest.raises(ZeroDivisionError):
        PipelineInspector.on_pipeline_from_string("1 / 0").execute(spark)
    assert type(spark.range(1)).filter is before
    with pytest.raises(ValueError):
        sources.pipeline_source()


def test_streaming(spark, tmp_path):
    from pipelens.streaming import inspect_batches, windowed_histogram

    rows = [(i, "ab"[i % 2], f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    spark.createDataFrame(rows, "id bigint, k string, t string").select("id", "k", F.to_timestamp("t").alias("t")).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, h = [], HistogramForColumns(["k"])
    writer = inspect_batches(stream, lambda f: f.filter(F.col("id") >= 4), lambda n, r: seen.append(list(r.dag_node_to_inspection_results.values())[-1][h]["k"]), [h])
    writer.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(sum(x.values()) for x in seen) == 16
    windowed_histogram(stream, "k", "t", "10 seconds", "5 seconds").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["count"] for r in spark.table("w").collect()) == [5, 5, 5, 5]
