"""Row ids, quantiles and results when rows are many, dealt over several partitions, and recomputed."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pipelens import functions as ml
from pipelens import inspections, sources
from pipelens.checks import InspectionResult, NoBiasIntroducedFor, SimilarRemovalProbabilitiesFor
from pipelens.functions import transformers
from pipelens.inspections import CompletenessOfColumns, CountDistinctOfColumns, HistogramForColumns, MissingEmbeddings, RowLineage
from pipelens.inspector import PipelineInspector, evaluate
from pipelens.plans import figures
from pipelens.plans.model import OperatorType
from pipelens.plans.recorder import Recorder
from pipelens.storage import discard, grouped_median, order_statistics, staged


@pytest.fixture
def small_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_no_group_is_lost(spark, small_partitions, tmp_path):
    rows = spark.range(600_000).select((F.col("id") * 7919 % 300_000).alias("k"), *[F.xxhash64("id", F.lit(i)).alias(f"v{i}") for i in range(8)])
    groups = sources.adopt(rows, F.col("k"), Recorder([RowLineage(5)], track_code=False)).groupby("k").agg({f"v{i}": "max" for i in range(8)})
    assert groups._numbered is None and groups.df.count() == 300_000
    groups.hidden.select("k", F.col("__ord")[0].alias("o"), "v7", "__lin").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 300_000 and out.where("k <> o or __lin[0].row_id <> k").isEmpty()
    few = sources.adopt(spark.range(10).select(F.lit(None).cast("string").alias("k"), "id"), "id").groupby("k").agg({"id": "max"})
    assert few.hidden.count() == 0


def test_quantiles_equal_the_aggregate(spark, small_partitions):
    x = spark.range(30_001).select((F.col("id") * 31 % 1000 / 7).alias("v"), (F.col("id") % 13).alias("g"), (F.col("id") % 2).alias("h"))
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    assert order_statistics(x, F.col("v"), shares) == x.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
    assert order_statistics(x.where("false"), F.col("v"), shares) == [None] * 5
    assert order_statistics(x.limit(1), F.lit(2.0), [0.5]) == [2.0]
    found = grouped_median(x, ["g", "h"], F.col("v"), "m").join(x.groupBy("g", "h").agg(F.percentile("v", F.lit(0.5)).alias("e")), ["g", "h"])
    assert found.count() == 26 and found.where("m <> e").isEmpty()
    skewed = x.withColumn("v", F.when(F.col("g") < 9, 3.0).otherwise(F.col("v")))
    assert order_statistics(skewed, F.col("v"), [0.5]) == [3.0]


def test_ids_of_unknown_frames_stay(spark):
    unsure = spark.range(2000).repartition(5).withColumn("x", F.rand()).where("x > 0.5")
    frame = sources.adopt(unsure, recorder=Recorder(track_code=False))
    read = lambda: dict((r[0], r[1]) for r in frame.hidden.repartition(3).select("id", F.col("__ord")[0]).collect())
    first = read()
    assert first == read() and len(set(first.values())) == len(first) > 800


def test_nan_in_parquet_is_missing(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 4.0)], "id bigint, v double").write.parquet(path)
    frame = sources.read_parquet(spark, path, "id", recorder=Recorder(track_code=False))
    assert CompletenessOfColumns(["v"]).result(frame) == {"v": 0.5} and CountDistinctOfColumns(["v"]).result(frame) == {"v": 3}
    assert frame.filter(F.col("v") > 2).df.count() == 1
    assert sorted(r.v for r in ml.SimpleImputer("mean").fit_transform(frame.select("v")).df.collect()) == [1.0, 2.5, 2.5, 4.0]


def test_categories_beyond_the_literals_are_a_table(spark, monkeypatch):
    frame = sources.literal_frame(spark, [(c, i) for i, c in enumerate(["b", None, "c", "a", "b"])], "A string, B bigint", Recorder(track_code=False))
    few = [r.array for r in ml.OneHotEncoder().fit_transform(frame.select("A")).hidden.orderBy("__ord").collect()]
    monkeypatch.setattr(transformers, "LITERALS", 2)
    encoder = ml.OneHotEncoder()
    many = encoder.fit_transform(frame.select("A"))
    assert [r.array for r in many.hidden.orderBy("__ord").collect()] == few and encoder.tables[0] is not None
    ct = ml.ColumnTransformer([("n", ml.StandardScaler(), ["B"]), ("c", ml.OneHotEncoder(), ["A"])])
    assert [r.array[1:] for r in ct.fit_transform(frame).hidden.orderBy("__ord").collect()] == few
    with pytest.raises(Exception, match="unknown category"):
        ml.OneHotEncoder().fit(frame.filter(F.col("B") != 2).select("A")).transform(frame.select("A")).df.collect()


def test_kmeans_bins(spark):
    frame = sources.literal_frame(spark, [(v,) for v in (0.0, 0.1, 5.0, 5.2, 9.9, 10.0)], "A double", Recorder(track_code=False))
    out = ml.KBinsDiscretizer(3, strategy="kmeans").fit_transform(frame)
    assert [r.array for r in out.hidden.orderBy("__ord").collect()] == [[0.0], [0.0], [1.0], [1.0], [2.0], [2.0]]


def test_murmur_of_published_values():
    assert transformers.murmur3([b"", b"a", b"hello", b"hello, world"]).view(np.uint32).tolist() == [0, 0x3C2569B2, 0x248BFA47, 0x149BBB7F]


def test_murmur_hashing_in_runs(monkeypatch):
    texts = [None, "", "One two", "\u039f\u0394\u039f\u03a3'\u0391 \u039f\u0394\u039f\u03a3. \u0130stanbul", "..,," * 40, "ab,cd " * 60, "x" * 90 + " yy", "\u6f22\u5b57\u3001" * 50, "aa", "bb cc"]

    def plain(text, lo, hi):
        words = re.findall(transformers.TOKEN, (text or "").lower())
        out = [0.0] * 8
        for k in range(lo, hi + 1):
            for i in range(len(words) - k + 1):
                h = int(transformers.murmur3([" ".join(words[i : i + k]).encode()])[0])
                out[abs(h) % 8] += 1 if h >= 0 else -1
        return out

    for run in (8, 20, 64, 1 << 18):
        monkeypatch.setattr(transformers, "RUN", run)
        for lo, hi in ((1, 1), (1, 2), (2, 4)):
            assert transformers.gram_counts(pa.array(texts), 8, lo, hi).tolist() == [plain(t, lo, hi) for t in texts]


def test_murmur_hashing_of_a_long_batch_needs_little_memory(spark):
    """Two million words in one Arrow batch, half of them in one text."""
    psutil = pytest.importorskip("psutil")

    def megabytes(line):
        found = {}
        for p in psutil.Process().children(recursive=True):
            if "pyspark.daemon" in p.cmdline():
                status = Path(f"/proc/{p.pid}/status").read_text()
                found[p.pid] = int(re.search(rf"{line}:\s+(\d+)", status)[1]) / 1024
                Path(f"/proc/{p.pid}/clear_refs").write_text("5")  # the peak starts anew
        return found

    word = lambda i: F.hex(F.hash("id", i))
    n = F.when(F.col("id") == 0, 1_000_000).otherwise(1000)
    docs = spark.range(0, 1001, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), n), word), " ").alias("text"))
    frame = sources.adopt(docs, "id", Recorder(track_code=False)).select("text")
    out = ml.HashingVectorizer(8, ngram_range=(1, 2), hash="murmur3", norm=None).fit_transform(frame).df
    before = megabytes("VmRSS")
    assert out.where("exists(array, x -> x <> 0)").count() == 1001
    assert max(high - before.get(pid, 0) for pid, high in megabytes("VmHWM").items()) < 300


def test_large_results_are_tables(spark, monkeypatch):
    from pipelens import checks
    from pipelens.inspections import base

    monkeypatch.setattr(base, "RESULT_ROWS", 3)
    monkeypatch.setattr(checks, "RESULT_ROWS", 3)
    recorder = Recorder([HistogramForColumns(["A"]), RowLineage(RowLineage.ALL_ROWS)], track_code=False)
    frame = sources.literal_frame(spark, [(f"v{i % 6}",) for i in range(12)], "A string", recorder)
    frame.filter(F.col("A") != "v0")
    assert HistogramForColumns(["A"]).result(frame).count() == 6 and RowLineage(RowLineage.ALL_ROWS).result(frame).count() == 12
    found = NoBiasIntroducedFor(["A"]).evaluate(InspectionResult(recorder.dag, recorder.frames)).details[0]
    assert found.table.count() == 6 and not found.acceptable and found.value == -1.0
    with pytest.raises(ValueError):
        figures.ratio_figure(found)


def test_a_node_takes_few_jobs(spark):
    wanted = [HistogramForColumns(["A"]), HistogramForColumns(["B"]), HistogramForColumns(["A", "B"]), CompletenessOfColumns(["A", "B"]), CountDistinctOfColumns(["A"])]
    recorder = Recorder(wanted, track_code=False)
    frame = sources.literal_frame(spark, [("x", "p"), ("x", None), ("y", "p")], "A string, B string", recorder)
    found = evaluate(recorder, wanted, []).dag_node_to_inspection_results[frame.node]
    assert found == {
        wanted[0]: {"A": {"x": 2, "y": 1}}, wanted[1]: {"B": {"p": 2, None: 1}}, wanted[2]: {"A": {"x": 2, "y": 1}, "B": {"p": 2, None: 1}},
        wanted[3]: {"A": 1.0, "B": pytest.approx(2 / 3)}, wanted[4]: {"A": 2},
    }


def test_program_with_more_of_the_api(spark, sf):
    program = f"""
from pyspark.sql import functions as F
customer = spark.read.parquet("{sf}/customer.parquet").drop("c_name", "c_address").fillna("NONE").replace(["BUILDING", "MACHINERY"], "heavy", subset="c_mktsegment")
orders = spark.read.parquet("{sf}/orders.parquet").withColumnRenamed("o_custkey", "buyer")
both = orders.join(customer, (F.col("buyer") == F.col("c_custkey")) & (F.col("o_totalprice") > 1000))
more = both.withColumns({{"a": F.lit(1), "b": F.lit(2)}}).select("c_mktsegment", "a").distinct()
out = more.union(more).unionByName(more)
rich = customer.join(orders.select("buyer"), customer.c_custkey == F.col("buyer"), "left_anti")
"""
    result = PipelineInspector.on_pipeline_from_string(program).add_required_inspection(RowLineage(2)).execute(spark)
    kinds = [n.operator for n in result.dag.nodes]
    assert OperatorType.MISSING_OP not in kinds and kinds.count(OperatorType.JOIN) == 2 and kinds.count(OperatorType.CONCATENATION) == 2
    last = [f for n, f in result.frames.items() if n.details.description == "union of rows"][-1]
    segments = {r.c_mktsegment for r in last.df.collect()}
    assert last.df.count() == 3 * len(segments) and "heavy" in segments and "BUILDING" not in segments
    assert last.hidden.select("__ord").distinct().count() == last.df.count()
    assert "<svg" in figures.dag_figure(result.dag) and "Join" in figures.dag_figure(result.dag)


def test_figures_of_findings(spark, tmp_path):
    recorder = Recorder([HistogramForColumns(["A"])], track_code=False)
    sources.literal_frame(spark, [("a<b", 1), ("a<b", 2), ("c", 3), (None, 4)], "A string, B bigint", recorder).filter(F.col("B") > 1)
    result = InspectionResult(recorder.dag, recorder.frames)
    bias, removal = (c.evaluate(result).details[0] for c in (NoBiasIntroducedFor(["A"]), SimilarRemovalProbabilitiesFor(["A"])))
    drawn = [figures.ratio_figure(bias), figures.removal_figure(removal), figures.removal_figure(removal, True, 2.0)]
    assert all(d.startswith("<svg") and "a&lt;b" in d and "(none)" in d for d in drawn) and "stroke-dasharray" in drawn[2]
    figures.save_figure(drawn[0], tmp_path / "bias.svg")


def test_word_vectors_are_a_table(spark):
    words = sources.literal_frame(spark, [("a",), ("b",), ("a",), (None,), ("c",)], "A string", Recorder(track_code=False))
    out = ml.Word2Vec(3, min_count=2).fit_transform(words)
    assert [any(r.array) for r in out.hidden.orderBy("__ord").collect()] == [True, False, True, False, False]
    assert MissingEmbeddings(1).result(out) == {"missing": 3, "examples": ["b"]}
    assert inspections.MissingEmbeddings().result(ml.Word2Vec(3, min_count=9).fit_transform(words))["missing"] == 5


def test_discarded_tables_are_gone(spark):
    import os

    kept = staged(spark.range(3).toDF("x"), "test")
    path = kept._staged_at.removeprefix("file://")
    assert os.path.exists(path) and kept.count() == 3
    discard(kept, spark.range(1))
    assert not os.path.exists(path)
