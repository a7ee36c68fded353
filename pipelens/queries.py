"""A query for each operator, inspection and check, with the SQL that gives the same rows.

Row ids are primary keys, so that lineage can be written in SQL. The tables hold no nulls; queries on nulls make some.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens import functions as ml
from pipelens import sources
from pipelens.checks import (
    CheckResult, InspectionResult, NoBiasIntroducedFor, NoIllegalFeatures, NoMissingEmbeddings, SimilarRemovalProbabilitiesFor,
    before_and_after, check_results_frame, ratio_changes, removal_probabilities,
)
from pipelens.inspections import (
    ArgumentCapturing, ColumnPropagation, CompletenessOfColumns, CountDistinctOfColumns, HistogramForColumns, Inspection,
    IntersectionalHistogramForColumns, MaterializeFirstOutputRows, MissingEmbeddings, RowLineage,
)
from pipelens.operators.frame import ORD, InspectedFrame, concat
from pipelens.plans.recorder import Recorder
from pipelens.storage import place_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id"}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


class Run:
    """Frames of one recorded query."""

    def __init__(self, spark: SparkSession, sf_dir: str, *inspections: Inspection):
        self.spark, self.dir = spark, sf_dir
        self.recorder = Recorder(list(inspections), track_code=False)

    def scan(self, name: str, row_id: str | Column | None = None) -> InspectedFrame:
        if row_id is None:
            row_id = KEYS.get(name)  # of the others the row index
        # These tables hold no NaN; without the conversion comparisons of numbers are part of the scan.
        return sources.read_parquet(self.spark, f"{self.dir}/{name}.parquet", row_id, normalize=False, recorder=self.recorder)

    def customers(self) -> InspectedFrame:
        """Customers with some nulls: the segment of each seventh, the balance of each fifth."""
        df = self.spark.read.parquet(f"{self.dir}/customer.parquet").select(
            "c_custkey", "c_nationkey",
            F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("seg"),
            F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("bal"),
        )
        return InspectedFrame.from_source(df, F.col("c_custkey"), description="customer", recorder=self.recorder)

    def frame_of(self, inspection: Inspection, at: InspectedFrame) -> DataFrame:
        return inspection.frame(at)

    def result(self) -> InspectionResult:
        return InspectionResult(self.recorder.dag, self.recorder.frames)


#: The same customers in SQL.
CUST = "cust as (select c_custkey, c_nationkey, case when c_custkey % 7 <> 0 then c_mktsegment end as seg, case when c_custkey % 5 <> 0 then c_acctbal end as bal from customer)"


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long_form(frame: InspectedFrame) -> DataFrame:
    """Arrays of numbers as rows (row, pos, value)."""
    return frame.hidden.select(F.col(ORD)[0].alias("row"), F.posexplode("array").alias("pos", "value")).select("row", "pos", r6("value").alias("value"))


def lineage_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.explode("lineage").alias("l")).select("key", "l.operator_id", "l.row_id")


# --- sources ----------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def src_scan_parquet(spark, sf_dir):
    return Run(spark, sf_dir).scan("orders").select("o_orderkey", "o_custkey", "o_totalprice").df


@query("select n_nationkey, n_name, case when n_regionkey <> 3 then n_regionkey end as n_regionkey from nation")
def src_scan_csv(spark, sf_dir):
    """Writes nations as CSV, with ? for a missing value, and reads them back."""
    path = place_for(spark, "nation_csv")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 3, "?").otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey")).write.mode("overwrite").csv(path, header=True)
    run = Run(spark, sf_dir)
    return sources.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", na_values="?", row_id="n_nationkey", recorder=run.recorder).df


@query(
    "select sum(case when o_orderkey % 3 = 0 then 1 else 0 end)::bigint as missing, round(avg(case when o_orderkey % 3 <> 0 then o_totalprice end), 6) as mean, "
    "count(case when o_orderkey % 3 <> 0 and o_totalprice > 100000 then 1 end) as large from orders"
)
def src_scan_parquet_nan(spark, sf_dir):
    """NaN in Parquet is a missing value to everything that follows."""
    path = place_for(spark, "orders_nan")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price")).write.parquet(path)
    price = sources.read_parquet(spark, path, "o_orderkey", recorder=Run(spark, sf_dir).recorder).df
    return price.agg(F.count_if(F.col("price").isNull()).alias("missing"), r6(F.avg("price")).alias("mean"), F.count_if(F.col("price") > 100000).alias("large"))


@query("select * from (values ('cat_a', 1::bigint), ('cat_b', 2), (null, 4)) t(A, B)")
def src_literal_frame(spark, sf_dir):
    return sources.literal_frame(spark, [("cat_a", 1), ("cat_b", 2), (None, 4)], "A string, B bigint", Recorder(track_code=False)).df


@query("select * from (values (0::bigint), (2), (4), (8)) t(A)")
def src_literal_series(spark, sf_dir):
    return sources.literal_series(spark, [0, 2, 4, 8], "A", Recorder(track_code=False)).df


@query()
def src_random(spark, sf_dir):
    return sources.random_array(spark, 100, 2, 7, Recorder(track_code=False)).df


@query("select r_regionkey, r_name from region")
def src_named_dataset(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("pipelens_region")
    return sources.named_dataset(spark, "pipelens_region", "r_regionkey", Recorder(track_code=False)).df


@query("select c_custkey, c_acctbal from customer where c_acctbal > 0")
def src_missing_op(spark, sf_dir):
    run = Run(spark, sf_dir)
    outside = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return sources.adopt(outside, "c_custkey", run.recorder).filter(F.col("c_acctbal") > 0).df


# --- projections, selections, changes ---------------------------------------------------------------------------------


@query("select c_mktsegment from customer")
def proj_single(spark, sf_dir):
    return Run(spark, sf_dir).scan("customer")["c_mktsegment"].df


@query("select c_custkey, c_mktsegment from customer")
def proj_multi(spark, sf_dir):
    return Run(spark, sf_dir).scan("customer")[["c_custkey", "c_mktsegment"]].df


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def sel_predicate(spark, sf_dir):
    orders = Run(spark, sf_dir).scan("orders")
    return orders[F.col("o_totalprice") > 100000].select("o_orderkey", "o_totalprice").df


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def sel_isin(spark, sf_dir):
    return Run(spark, sf_dir).scan("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey").df


@query("select l_orderkey, l_linenumber from lineitem where l_quantity <= 30 and l_quantity >= 10 and l_returnflag <> 'N' and l_discount * 100 > 3")
def sel_conjunction(spark, sf_dir):
    c = F.col
    keep = (c("l_quantity") <= 30) & (c("l_quantity") >= 10) & (c("l_returnflag") != "N") & (c("l_discount") * 100 > 3)
    return Run(spark, sf_dir).scan("lineitem").filter(keep).select("l_orderkey", "l_linenumber").df


@query(f"with {CUST} select c_custkey, seg, bal from cust where seg is not null and bal is not null")
def sel_dropna(spark, sf_dir):
    return Run(spark, sf_dir).customers().select("c_custkey", "seg", "bal").dropna().df


@query(f"with {CUST} select c_custkey, seg, bal from cust where seg is not null")
def sel_dropna_subset(spark, sf_dir):
    return Run(spark, sf_dir).customers().select("c_custkey", "seg", "bal").dropna(subset=["seg"]).df


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) as revenue from lineitem")
def mod_with_column(spark, sf_dir):
    revenue = r6(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return Run(spark, sf_dir).scan("lineitem").with_column("revenue", revenue).select("l_orderkey", "l_linenumber", "revenue").df


@query("select o_orderkey, case when o_orderpriority = '3-MEDIUM' then '5-LOW' else o_orderpriority end as o_orderpriority from orders")
def mod_replace(spark, sf_dir):
    return Run(spark, sf_dir).scan("orders").select("o_orderkey", "o_orderpriority").replace("3-MEDIUM", "5-LOW").df


@query("select o_orderkey, case o_orderpriority when '3-MEDIUM' then 'middle' when '5-LOW' then 'low' else o_orderpriority end as o_orderpriority, o_orderstatus from orders")
def mod_replace_several(spark, sf_dir):
    orders = Run(spark, sf_dir).scan("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return orders.replace({"3-MEDIUM": "middle", "5-LOW": "low", "O": "open"}, subset=["o_orderpriority"]).df


@query(f"with {CUST} select c_custkey, coalesce(seg, 'NONE') as seg, bal from cust")
def mod_fillna(spark, sf_dir):
    return Run(spark, sf_dir).customers().select("c_custkey", "seg", "bal").fillna("NONE").df


@query("select c_custkey as key, c_acctbal from customer")
def mod_rename_drop(spark, sf_dir):
    return Run(spark, sf_dir).scan("customer").select("c_custkey", "c_acctbal", "c_mktsegment").rename("c_custkey", "key").drop("c_mktsegment").df


@query("select distinct o_orderstatus, o_orderpriority from orders")
def sel_distinct(spark, sf_dir):
    return Run(spark, sf_dir).scan("orders").select("o_orderstatus", "o_orderpriority").distinct().df


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 order by o_orderkey limit 20")
def sel_limit(spark, sf_dir):
    return Run(spark, sf_dir).scan("orders").select("o_orderkey", "o_totalprice").filter(F.col("o_totalprice") > 100000).limit(20).df


@query("select c_custkey as key, 'c' as kind from customer union all select s_suppkey, 's' from supplier")
def union_rows(spark, sf_dir):
    run = Run(spark, sf_dir)
    a = run.scan("customer").rename("c_custkey", "key").with_column("kind", F.lit("c")).select("key", "kind")
    return a.union(run.scan("supplier").rename("s_suppkey", "key").with_column("kind", F.lit("s")).select("key", "kind")).df


@query("select o_orderkey as row, 0 as pos, case when o_orderstatus = 'O' then 1.0::double else 0.0::double end as value from orders")
def mod_label_binarize(spark, sf_dir):
    return long_form(Run(spark, sf_dir).scan("orders").select("o_orderstatus").label_binarize(["F", "O"]))


@query("select o_orderkey as row, pos::int as pos, case when o_orderstatus = ['F', 'O', 'P'][pos + 1] then 1.0::double else 0.0::double end as value from orders, range(3) p(pos)")
def mod_label_binarize_multi(spark, sf_dir):
    return long_form(Run(spark, sf_dir).scan("orders").select("o_orderstatus").label_binarize(["F", "O", "P"]))


@query("select p_partkey as row, 0 as pos, 1.0::double as value from part union all select p_partkey, 1, p_size::double from part union all select p_partkey, 2, round(p_retailprice, 6) from part")
def mod_add_constant(spark, sf_dir):
    return long_form(Run(spark, sf_dir).scan("part").select("p_size", "p_retailprice").add_constant())


# --- joins ------------------------------------------------------------------------------------------------------------


def _nations(run: Run, odd_only: bool = False) -> InspectedFrame:
    nation = run.scan("nation")
    nation = nation.filter(F.col("n_nationkey") % 2 == 1) if odd_only else nation
    return nation.select("n_nationkey", "n_name")


def _small_customers(run: Run) -> InspectedFrame:
    df = run.spark.read.parquet(f"{run.dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey")).alias("n_nationkey"))
    return InspectedFrame.from_source(df, F.col("c_custkey"), recorder=run.recorder)


CN = "c as (select c_custkey, case when c_custkey % 6 <> 0 then c_nationkey end as n_nationkey from customer), n as (select n_nationkey, n_name from nation where n_nationkey % 2 = 1)"


@query("select o_orderkey, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    run = Run(spark, sf_dir)
    customer = run.scan("customer").with_column("o_custkey", F.col("c_custkey")).select("o_custkey", "c_mktsegment")
    return run.scan("orders").select("o_orderkey", "o_custkey").join(customer, on="o_custkey").df


@query("select o_orderkey, o_custkey, c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def join_left_right_on(spark, sf_dir):
    run = Run(spark, sf_dir)
    customer = run.scan("customer").select("c_custkey", "c_mktsegment")
    return run.scan("orders").select("o_orderkey", "o_custkey").join(customer, left_on="o_custkey", right_on="c_custkey").df


@query("select c_custkey, p_partkey, c_mktsegment, p_brand from customer full join part on c_custkey = p_partkey")
def join_index_outer(spark, sf_dir):
    run = Run(spark, sf_dir)
    part = run.scan("part").select("p_partkey", "p_brand")
    return run.scan("customer").select("c_custkey", "c_mktsegment").join(part, left_index=True, right_index=True, how="outer").df


@query(f"with {CN} select c_custkey, c.n_nationkey, n_name from c left join n on c.n_nationkey = n.n_nationkey")
def join_left(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _small_customers(run).join(_nations(run, True), on="n_nationkey", how="left").df


@query(f"with {CN} select c_custkey, n.n_nationkey, n_name from c right join n on c.n_nationkey = n.n_nationkey")
def join_right(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _small_customers(run).join(_nations(run, True), on="n_nationkey", how="right").df


@query(f"with {CN} select c_custkey, coalesce(c.n_nationkey, n.n_nationkey) as n_nationkey, n_name from c full join n on c.n_nationkey = n.n_nationkey")
def join_full(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _small_customers(run).join(_nations(run, True), on="n_nationkey", how="outer").df


@query("select n_name, r_name from nation cross join region")
def join_cross(spark, sf_dir):
    run = Run(spark, sf_dir)
    return run.scan("nation").select("n_name").join(run.scan("region").select("r_name"), how="cross").df


@query("select c_custkey, c_nationkey as n_nationkey, n_name from customer join nation on c_nationkey = n_nationkey order by n_nationkey")
def join_sorted(spark, sf_dir):
    run = Run(spark, sf_dir)
    customer = run.scan("customer").with_column("n_nationkey", F.col("c_nationkey")).select("c_custkey", "n_nationkey")
    return customer.join(_nations(run), on="n_nationkey", sort=True).df


@query("select o_orderkey, o_custkey, round(m, 6) as mean_price from orders join (select o_custkey, avg(o_totalprice) as m from orders group by 1) using (o_custkey)")
def join_back_aggregate(spark, sf_dir):
    orders = Run(spark, sf_dir).scan("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    means = orders.groupby("o_custkey").agg(m=("o_totalprice", "mean"))
    out = orders.join(means, on="o_custkey")
    return out.df.select("o_orderkey", "o_custkey", r6("m").alias("mean_price"))


@query("select a.r_regionkey as a, b.r_regionkey as b from (select r_regionkey, case when r_regionkey > 1 then r_name end as k from region) a join (select r_regionkey, case when r_regionkey <> 2 then r_name end as k from region) b on a.k is not distinct from b.k")
def join_null_safe(spark, sf_dir):
    run = Run(spark, sf_dir)
    a = run.scan("region").with_column("k", F.when(F.col("r_regionkey") > 1, F.col("r_name"))).with_column("a", F.col("r_regionkey")).select("a", "k")
    b = run.scan("region").with_column("k", F.when(F.col("r_regionkey") != 2, F.col("r_name"))).with_column("b", F.col("r_regionkey")).select("b", "k")
    return a.join(b, on="k").select("a", "b").df


@query("select o_orderkey, c_custkey, c_acctbal from orders join customer on o_custkey = c_custkey and o_totalprice > 20 * c_acctbal")
def join_condition(spark, sf_dir):
    run = Run(spark, sf_dir)
    customer, orders = run.scan("customer").select("c_custkey", "c_acctbal"), run.scan("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 20 * F.col("c_acctbal"))
    return orders.join(customer, on=on).select("o_orderkey", "c_custkey", "c_acctbal").df


@query("select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_semi(spark, sf_dir):
    run = Run(spark, sf_dir)
    large = run.scan("orders").filter(F.col("o_totalprice") > 300000).select("o_custkey")
    return run.scan("customer").select("c_custkey", "c_mktsegment").join(large, left_on="c_custkey", right_on="o_custkey", how="left_semi").df


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    run = Run(spark, sf_dir)
    return run.scan("customer").select("c_custkey", "c_mktsegment").join(run.scan("orders").select("o_custkey"), left_on="c_custkey", right_on="o_custkey", how="left_anti").df


# --- aggregation ------------------------------------------------------------------------------------------------------


@query(f"with {CUST} select seg, round(avg(bal), 6) as mean_bal from cust where seg is not null group by seg")
def agg_mean(spark, sf_dir):
    out = Run(spark, sf_dir).customers().groupby("seg").agg(mean_bal=("bal", "mean"))
    return out.df.select("seg", r6("mean_bal").alias("mean_bal"))


@query(
    f"with {CUST} select seg, round(sum(bal), 6) as s, min(bal) as lo, max(bal) as hi, count(bal) as n, round(stddev_samp(bal), 6) as sd, "
    "round(median(bal), 6) as med, count(distinct c_nationkey) as nations from cust where seg is not null group by seg"
)
def agg_multi(spark, sf_dir):
    out = Run(spark, sf_dir).customers().groupby("seg").agg(
        s=("bal", "sum"), lo=("bal", "min"), hi=("bal", "max"), n=("bal", "count"), sd=("bal", "std"), med=("bal", "median"), nations=("c_nationkey", "nunique")
    )
    return out.df.select("seg", r6("s").alias("s"), "lo", "hi", "n", r6("sd").alias("sd"), r6("med").alias("med"), "nations")


@query("select l_orderkey, round(sum(l_quantity), 6) as quantity, max(l_extendedprice) as price, round(median(l_discount), 6) as discount from lineitem group by 1")
def agg_many_groups(spark, sf_dir):
    """As many groups as there are orders; reading the ids of the groups must lose none."""
    out = Run(spark, sf_dir).scan("lineitem").groupby("l_orderkey").agg(quantity=("l_quantity", "sum"), price=("l_extendedprice", "max"), discount=("l_discount", "median"))
    return out.hidden.select("l_orderkey", r6("quantity").alias("quantity"), "price", r6("discount").alias("discount"))


# --- lineage ----------------------------------------------------------------------------------------------------------

ALL = RowLineage(RowLineage.ALL_ROWS)


@query("select r_regionkey::bigint as key, 0 as operator_id, r_regionkey::bigint as row_id from region")
def lineage_source(spark, sf_dir):
    at = Run(spark, sf_dir, ALL).scan("region")
    return lineage_rows(ALL.frame(at).withColumn("r_regionkey", F.col("r_regionkey").cast("long")), "r_regionkey")


@query("select o_orderkey as key, 0 as operator_id, o_orderkey as row_id from orders where o_totalprice > 100000")
def lineage_selection(spark, sf_dir):
    at = Run(spark, sf_dir, ALL).scan("orders").filter(F.col("o_totalprice") > 100000)
    return lineage_rows(ALL.frame(at), "o_orderkey")


@query("select o_orderkey as key, 0 as operator_id, o_orderkey as row_id from orders join customer on o_custkey = c_custkey union all select o_orderkey, 1, c_custkey from orders join customer on o_custkey = c_custkey")
def lineage_join(spark, sf_dir):
    run = Run(spark, sf_dir, ALL)
    at = run.scan("orders").join(run.scan("customer"), left_on="o_custkey", right_on="c_custkey")
    return lineage_rows(ALL.frame(at), "o_orderkey")


@query(
    f"with {CN} select coalesce(c_custkey, -1) as key, 0 as operator_id, c_custkey as row_id from c left join n on c.n_nationkey = n.n_nationkey "
    "union all select coalesce(c_custkey, -1), 1, n.n_nationkey::bigint from c right join n on c.n_nationkey = n.n_nationkey"
)
def lineage_join_outer(spark, sf_dir):
    run = Run(spark, sf_dir, ALL)
    at = _small_customers(run).join(_nations(run, True), on="n_nationkey", how="outer")
    return lineage_rows(ALL.frame(at).withColumn("key", F.coalesce("c_custkey", F.lit(-1).cast("long"))), "key")


@query("select p_partkey as key, 0 as operator_id, p_partkey as row_id from part")
def lineage_concat(spark, sf_dir):
    part = Run(spark, sf_dir, ALL).scan("part")
    a = ml.StandardScaler().fit_transform(part.select("p_size"))
    b = ml.StandardScaler().fit_transform(part.select("p_retailprice"))
    at = concat(a, b)
    return lineage_rows(ALL.frame(at).withColumn("lineage", F.col("lineage")).select(F.col("lineage"), F.col("lineage")[0]["row_id"].alias("p_partkey")), "p_partkey")


@query("with g as (select o_custkey as key, row_number() over (order by o_custkey) - 1 as row_id from (select distinct o_custkey from orders)) select key, 1 as operator_id, row_id::bigint as row_id from g")
def lineage_groupby(spark, sf_dir):
    at = Run(spark, sf_dir, ALL).scan("orders").groupby("o_custkey").agg(m=("o_totalprice", "mean"))
    return lineage_rows(ALL.frame(at), "o_custkey")


@query("with g as (select l_orderkey as key, row_number() over (order by l_orderkey) - 1 as row_id from (select distinct l_orderkey from lineitem)) select key, 1 as operator_id, row_id::bigint as row_id from g")
def lineage_groupby_many(spark, sf_dir):
    at = Run(spark, sf_dir, ALL).scan("lineitem").groupby("l_orderkey").agg(m=("l_quantity", "mean"))
    return lineage_rows(ALL.frame(at), "l_orderkey")


@query("select key, operator_id, key as row_id from (select c_custkey as key, 0 as operator_id from customer union all select s_suppkey, 2 from supplier)")
def lineage_union(spark, sf_dir):
    run = Run(spark, sf_dir, ALL)
    at = run.scan("customer").select("c_custkey").union(run.scan("supplier").select("s_suppkey"))
    return lineage_rows(ALL.frame(at), "c_custkey")


@query("select min(o_orderkey)::bigint as row_id, o_orderpriority as priority from orders group by 2")
def lineage_distinct(spark, sf_dir):
    at = Run(spark, sf_dir, ALL).scan("orders").select("o_orderpriority").distinct()
    return ALL.frame(at).select(F.col("lineage")[0]["row_id"].alias("row_id"), F.col("o_orderpriority").alias("priority"))


SPLIT = "s as (select *, row_number() over (order by md5('7-' || c_custkey)) as k, count(*) over () as n from customer)"


@query(f"with {SPLIT} select c_custkey as key, 0 as operator_id, c_custkey as row_id from s where k <= ceil(0.25 * n)")
def lineage_split(spark, sf_dir):
    _, test = Run(spark, sf_dir, ALL).scan("customer").train_test_split(0.25, seed=7)
    return lineage_rows(ALL.frame(test), "c_custkey")


@query(f"with {SPLIT} select c_custkey, c_mktsegment from s where k > ceil(0.25 * n)")
def split_train(spark, sf_dir):
    return Run(spark, sf_dir).scan("customer").train_test_split(0.25, seed=7)[0].select("c_custkey", "c_mktsegment").df


@query(f"with {SPLIT} select c_custkey, c_mktsegment from s where k <= ceil(0.25 * n)")
def split_test(spark, sf_dir):
    return Run(spark, sf_dir).scan("customer").train_test_split(0.25, seed=7)[1].select("c_custkey", "c_mktsegment").df


# --- other inspections ------------------------------------------------------------------------------------------------

SEG = HistogramForColumns(["c_mktsegment"])
BOTH = HistogramForColumns(["o_orderstatus", "o_orderpriority"])


@query("select 'o_orderstatus' as \"column\", o_orderstatus as value, count(*) as count from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2")
def hist_source(spark, sf_dir):
    return BOTH.frame(Run(spark, sf_dir, BOTH).scan("orders"))


@query("select 'o_orderstatus' as \"column\", o_orderstatus as value, count(*) as count from orders where o_totalprice > 150000 group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders where o_totalprice > 150000 group by 2")
def hist_selection(spark, sf_dir):
    return BOTH.frame(Run(spark, sf_dir, BOTH).scan("orders").filter(F.col("o_totalprice") > 150000))


@query("select 'c_mktsegment' as \"column\", c_mktsegment as value, count(*) as count from customer where c_acctbal > 0 group by 2")
def hist_projected_away(spark, sf_dir):
    at = Run(spark, sf_dir, SEG).scan("customer").select("c_custkey", "c_acctbal").filter(F.col("c_acctbal") > 0).select("c_custkey")
    return SEG.frame(at)


@query("select 'c_mktsegment' as \"column\", c_mktsegment as value, count(*) as count from customer group by 2")
def hist_modify(spark, sf_dir):
    """The node that replaces values counts those before the change."""
    return SEG.frame(Run(spark, sf_dir, SEG).scan("customer").replace("BUILDING", "OTHER"))


@query("select 'c_mktsegment' as \"column\", c_mktsegment as value, count(*) as count from orders join customer on o_custkey = c_custkey where o_totalprice > 100000 group by 2")
def hist_join(spark, sf_dir):
    run = Run(spark, sf_dir, SEG)
    customer = run.scan("customer").select("c_custkey")
    orders = run.scan("orders").filter(F.col("o_totalprice") > 100000)
    return SEG.frame(orders.join(customer, left_on="o_custkey", right_on="c_custkey"))


HIST_SEG = HistogramForColumns(["seg"])
MODE = "m as (select seg as best from cust where seg is not null group by seg order by count(*) desc, seg limit 1)"


@query(f"with {CUST}, {MODE} select 'seg' as \"column\", coalesce(seg, best) as value, count(*) as count from cust, m group by 2")
def hist_imputer(spark, sf_dir):
    at = ml.SimpleImputer("most_frequent").fit_transform(Run(spark, sf_dir, HIST_SEG).customers().select("seg"))
    return HIST_SEG.frame(at)


@query(f"with {SPLIT} select 'c_mktsegment' as \"column\", c_mktsegment as value, count(*) as count from s where k > ceil(0.25 * n) group by 2")
def hist_split(spark, sf_dir):
    return SEG.frame(Run(spark, sf_dir, SEG).scan("customer").train_test_split(0.25, seed=7)[0])


@query("select 'o_orderpriority' as \"column\", o_orderpriority as value, count(*) as count from orders group by 2")
def hist_score(spark, sf_dir):
    """The score node's groups are those of the test rows."""
    seen = HistogramForColumns(["o_orderpriority"])
    run = Run(spark, sf_dir, seen)
    model, x, y = _status_model(run, ml.DecisionTreeClassifier(max_depth=2))
    model.scored(x, y)
    return seen.frame(run.recorder.frames[run.recorder.dag.nodes[-1]])


@query("select o_orderstatus, o_orderpriority, count(*) as count from orders group by 1, 2")
def xhist_source(spark, sf_dir):
    seen = IntersectionalHistogramForColumns(["o_orderstatus", "o_orderpriority"])
    return seen.frame(Run(spark, sf_dir, seen).scan("orders"))


@query("select o_orderstatus, null::varchar as c_mktsegment, count(*) as count from orders join customer on o_custkey = c_custkey group by 1, 2")
def xhist_join(spark, sf_dir):
    """A column that the join's output lacks counts as null."""
    seen = IntersectionalHistogramForColumns(["o_orderstatus", "c_mktsegment"])
    run = Run(spark, sf_dir, seen)
    return seen.frame(run.scan("orders").join(run.scan("customer").select("c_custkey"), left_on="o_custkey", right_on="c_custkey"))


@query("select o_orderstatus, o_orderpriority, count(*) as count from orders where o_totalprice > 100000 group by 1, 2")
def xhist_projected_away(spark, sf_dir):
    seen = IntersectionalHistogramForColumns(["o_orderstatus", "o_orderpriority"])
    return seen.frame(Run(spark, sf_dir, seen).scan("orders").select("o_orderkey", "o_totalprice").filter(F.col("o_totalprice") > 100000))


COMPLETE = CompletenessOfColumns(["seg", "bal"])
DISTINCT = CountDistinctOfColumns(["seg", "bal", "c_nationkey"])


@query(f"with {CUST} select round(avg(case when seg is null then 0.0 else 1.0 end), 6)::double as seg, round(avg(case when bal is null then 0.0 else 1.0 end), 6)::double as bal from cust")
def completeness_source(spark, sf_dir):
    return COMPLETE.frame(Run(spark, sf_dir).customers()).select(r6("seg").alias("seg"), r6("bal").alias("bal"))


@query(f"with {CUST} select round(avg(case when seg is null then 0.0 else 1.0 end), 6)::double as seg, round(avg(case when bal is null then 0.0 else 1.0 end), 6)::double as bal from orders join cust on o_custkey = c_custkey")
def completeness_join(spark, sf_dir):
    run = Run(spark, sf_dir)
    at = run.scan("orders").join(run.customers(), left_on="o_custkey", right_on="c_custkey")
    return COMPLETE.frame(at).select(r6("seg").alias("seg"), r6("bal").alias("bal"))


DISTINCT_SQL = "count(distinct seg) + max((seg is null)::int)::bigint as seg, count(distinct bal) + max((bal is null)::int)::bigint as bal, count(distinct c_nationkey) + max((c_nationkey is null)::int)::bigint as c_nationkey"


@query(f"with {CUST} select {DISTINCT_SQL} from cust")
def count_distinct_source(spark, sf_dir):
    return DISTINCT.frame(Run(spark, sf_dir).customers())


@query(f"with {CUST} select {DISTINCT_SQL} from orders join cust on o_custkey = c_custkey")
def count_distinct_join(spark, sf_dir):
    run = Run(spark, sf_dir)
    return DISTINCT.frame(run.scan("orders").join(run.customers(), left_on="o_custkey", right_on="c_custkey"))


@query("select c_custkey, c_mktsegment as propagated_c_mktsegment from customer where c_acctbal > 0 order by c_custkey limit 10")
def propagate_selection(spark, sf_dir):
    seen = ColumnPropagation(["c_mktsegment"], 10)
    at = Run(spark, sf_dir, seen).scan("customer").filter(F.col("c_acctbal") > 0).select("c_custkey")
    return seen.frame(at)


@query("select o_orderkey, o_custkey, c_custkey, c_mktsegment as propagated_c_mktsegment from orders join customer on o_custkey = c_custkey order by o_orderkey limit 10")
def propagate_join(spark, sf_dir):
    seen = ColumnPropagation(["c_mktsegment"], 10)
    run = Run(spark, sf_dir, seen)
    customer = run.scan("customer").select("c_custkey")
    return seen.frame(run.scan("orders").select("o_orderkey", "o_custkey").join(customer, left_on="o_custkey", right_on="c_custkey"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 order by o_orderkey limit 10")
def first_rows_selection(spark, sf_dir):
    seen = MaterializeFirstOutputRows(10)
    return seen.frame(Run(spark, sf_dir, seen).scan("orders").select("o_orderkey", "o_totalprice").filter(F.col("o_totalprice") > 100000))


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey order by o_orderkey limit 10")
def first_rows_join(spark, sf_dir):
    seen = MaterializeFirstOutputRows(10)
    run = Run(spark, sf_dir, seen)
    at = run.scan("orders").join(run.scan("customer"), left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "c_mktsegment")
    return seen.frame(at)


@query("select * from (values ('with_mean', 'True'), ('with_std', 'False')) t(argument, value)")
def capture_args(spark, sf_dir):
    at = ml.StandardScaler(with_std=False).fit_transform(Run(spark, sf_dir).scan("part").select("p_size"))
    return ArgumentCapturing().frame(at)


#: Part types in fewer rows than this have no vector.
FEW = 14
MISSING = f"select p_type from part group by 1 having count(*) < {FEW}"


def _embedded(run: Run) -> InspectedFrame:
    return ml.Word2Vec(4, min_count=FEW, seed=1).fit_transform(run.scan("part").select("p_type"))


@query(f"select count(*) as missing, (select list(p_type order by p_type) from (select p_type from ({MISSING}) order by 1 limit 10)) as examples from part where p_type in ({MISSING})")
def missing_embeddings(spark, sf_dir):
    seen = MissingEmbeddings()
    found = seen.frame(_embedded(Run(spark, sf_dir, seen)))
    return found.select("missing", F.when(F.size("examples") > 0, F.col("examples")).alias("examples"))


# --- checks -----------------------------------------------------------------------------------------------------------


def _sql_before_after(before: str, after: str) -> str:
    return f"b as ({before}), a as ({after}), t as (select coalesce(b.value, a.value) as value, coalesce(b.n, 0)::bigint as count_before, coalesce(a.n, 0)::bigint as count_after from b full join a on b.value is not distinct from a.value)"


BIAS_SQL = (
    ", r as (select *, count_before::double / sum(count_before) over () as ratio_before, count_after::double / sum(count_after) over () as ratio_after from t) "
    "select value, count_before, count_after, round(ratio_before, 6) as ratio_before, round(ratio_after, 6) as ratio_after, "
    "round(case when ratio_before = 0 and ratio_after > 0 then 'inf'::double when ratio_before = 0 then null else (ratio_after - ratio_before) / ratio_before end, 6) as relative_ratio_change from r"
)
REMOVAL_SQL = (
    ", r as (select *, count_before - count_after as removed, case when count_before - count_after < 0 then 0.0::double when count_before = 0 then null else (count_before - count_after)::double / count_before end as p from t) "
    "select value, count_before, count_after, removed, round(p, 6) as removal_probability, round(case when removed < 0 then 0.0::double else p / min(case when p > 0 then p end) over () end, 6) as normalized_removal_probability from r"
)


def _count(table: str, value: str, where: str = "true") -> str:
    return f"select {value} as value, count(*) as n from {table} where {where} group by 1"


def _bias(run: Run, column: str) -> DataFrame:
    node = run.recorder.dag.nodes[-1]
    t = ratio_changes(before_and_after(run.recorder.dag, run.recorder.frames, node, column))
    return t.select("value", "count_before", "count_after", *[r6(c).alias(c) for c in ("ratio_before", "ratio_after", "relative_ratio_change")])


def _removal(run: Run, column: str) -> DataFrame:
    node = run.recorder.dag.nodes[-1]
    t = removal_probabilities(before_and_after(run.recorder.dag, run.recorder.frames, node, column))
    return t.select("value", "count_before", "count_after", "removed", *[r6(c).alias(c) for c in ("removal_probability", "normalized_removal_probability")])


JOINED = "orders join customer on o_custkey = c_custkey"


@query("with " + _sql_before_after(_count(JOINED, "c_mktsegment"), _count(JOINED, "c_mktsegment", "o_totalprice > 200000")) + BIAS_SQL)
def check_no_bias_selection(spark, sf_dir):
    run = Run(spark, sf_dir, SEG)
    run.scan("orders").join(run.scan("customer"), left_on="o_custkey", right_on="c_custkey").filter(F.col("o_totalprice") > 200000)
    return _bias(run, "c_mktsegment")


@query("with " + _sql_before_after(_count("customer", "c_mktsegment"), _count(f"{JOINED}", "c_mktsegment", "o_totalprice > 200000")) + BIAS_SQL)
def check_no_bias_join(spark, sf_dir):
    run = Run(spark, sf_dir, SEG)
    customer, orders = run.scan("customer"), sources.adopt(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 200000"), "o_orderkey", run.recorder)
    orders.join(customer, left_on="o_custkey", right_on="c_custkey")
    return _bias(run, "c_mktsegment")


@query(f"with {CUST}, {MODE}, " + _sql_before_after(_count("cust", "seg"), "select coalesce(seg, best) as value, count(*) as n from cust, m group by 1") + BIAS_SQL)
def check_no_bias_imputer(spark, sf_dir):
    run = Run(spark, sf_dir, HIST_SEG)
    ml.SimpleImputer("most_frequent").fit_transform(run.customers().select("seg"))
    return _bias(run, "seg")


@query("with " + _sql_before_after(_count("orders", "o_orderpriority"), _count("orders", "o_orderpriority", "o_totalprice > 200000 or o_orderpriority = '1-URGENT'")) + REMOVAL_SQL)
def check_removal_selection(spark, sf_dir):
    run = Run(spark, sf_dir, HistogramForColumns(["o_orderpriority"]))
    run.scan("orders").filter((F.col("o_totalprice") > 200000) | (F.col("o_orderpriority") == "1-URGENT"))
    return _removal(run, "o_orderpriority")


@query(f"with {CUST}, " + _sql_before_after(_count("cust", "seg"), _count("cust", "seg", "seg is not null and bal is not null")) + REMOVAL_SQL)
def check_removal_dropna(spark, sf_dir):
    run = Run(spark, sf_dir, HIST_SEG)
    run.customers().dropna()
    return _removal(run, "seg")


@query("with " + _sql_before_after(_count("customer", "c_mktsegment"), _count(JOINED, "c_mktsegment", "o_totalprice > 200000")) + REMOVAL_SQL)
def check_removal_join(spark, sf_dir):
    run = Run(spark, sf_dir, SEG)
    customer, orders = run.scan("customer"), sources.adopt(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 200000"), "o_orderkey", run.recorder)
    orders.join(customer, left_on="o_custkey", right_on="c_custkey")
    return _removal(run, "c_mktsegment")


@query(f"with {CUST}, {MODE}, " + _sql_before_after(_count("cust", "seg"), "select coalesce(seg, best) as value, count(*) as n from cust, m group by 1") + REMOVAL_SQL)
def check_removal_imputer(spark, sf_dir):
    run = Run(spark, sf_dir, HIST_SEG)
    ml.SimpleImputer("most_frequent").fit_transform(run.customers().select("seg"))
    return _removal(run, "seg")


@query("select * from (values ('Selection', 'urgent only', true)) t(operator_type, description, problem)")
def check_no_bias_overview(spark, sf_dir):
    run = Run(spark, sf_dir, HistogramForColumns(["o_orderpriority"]))
    run.scan("orders").filter(F.col("o_orderpriority") == "1-URGENT", "urgent only")
    found = NoBiasIntroducedFor(["o_orderpriority"]).evaluate(run.result())
    out = NoBiasIntroducedFor.overview(spark, found, "below the threshold")
    return out.select("operator_type", "description", F.col("`'o_orderpriority' below the threshold`").alias("problem"))


@query("select * from (values ('Selection', 'large', false)) t(operator_type, description, problem)")
def check_removal_overview(spark, sf_dir):
    run = Run(spark, sf_dir, HistogramForColumns(["o_orderpriority"]))
    run.scan("orders").filter(F.col("o_totalprice") > 200000, "large")
    found = SimilarRemovalProbabilitiesFor(["o_orderpriority"]).evaluate(run.result())
    out = SimilarRemovalProbabilitiesFor.overview(spark, found, "above the threshold")
    return out.select("operator_type", "description", F.col("`'o_orderpriority' above the threshold`").alias("problem"))


def _status_model(run: Run, model: ml.models.Model) -> tuple[ml.models.Model, InspectedFrame, InspectedFrame]:
    orders = run.scan("orders")
    x = orders.with_column("month", F.month("o_orderdate")).select("o_totalprice", "month")
    x = ml.StandardScaler().fit_transform(x)
    y = orders.select("o_orderstatus").label_binarize(["F", "O"])
    return model.fit(x, y), x, y


@query("select * from (values ('age'), ('c_mktsegment')) t(\"column\")")
def check_illegal_features(spark, sf_dir):
    run = Run(spark, sf_dir)
    customer = run.scan("customer").with_column("age", F.col("c_custkey") % 80)
    features = ml.ColumnTransformer([("n", ml.StandardScaler(), ["age", "c_acctbal"]), ("c", ml.OneHotEncoder(), ["c_mktsegment"])])
    x = features.fit_transform(customer.select("age", "c_acctbal", "c_mktsegment"))
    y = customer.with_column("rich", (F.col("c_acctbal") > 0).cast("int")).select("rich")
    ml.LogisticRegression(max_iter=2).fit(x, y)
    bad = NoIllegalFeatures(["c_mktsegment"]).used(run.recorder.dag)
    return spark.createDataFrame([(c,) for c in bad], "column string")


@query(f"select case when count(*) > 0 then 'Failure' else 'Success' end as status, count(*) as missing from part where p_type in ({MISSING})")
def check_missing_embeddings(spark, sf_dir):
    run = Run(spark, sf_dir, MissingEmbeddings())
    _embedded(run)
    found: CheckResult = NoMissingEmbeddings().evaluate(run.result())
    return spark.createDataFrame([(found.status.value, sum(x["missing"] for x in found.details.values()))], "status string, missing bigint")


@query("select * from (values ('NoBiasIntroducedFor((''o_orderpriority'', -0.3))', 'Failure'), ('NoIllegalFeatures(())', 'Success')) t(check_name, status)", name="check_results_frame")
def check_results_table(spark, sf_dir):
    run = Run(spark, sf_dir, HistogramForColumns(["o_orderpriority"]))
    run.scan("orders").filter(F.col("o_orderpriority") == "1-URGENT")
    checks = [NoBiasIntroducedFor(["o_orderpriority"]), NoIllegalFeatures()]
    return check_results_frame(spark, {c: c.evaluate(run.result()) for c in checks}).select("check_name", "status")


# --- features ---------------------------------------------------------------------------------------------------------

SCALED = "select p_partkey as row, 0 as pos, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6) as value from part union all select p_partkey, 1, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 6) from part"


@query(SCALED)
def tf_standard_scaler(spark, sf_dir):
    return long_form(ml.StandardScaler().fit_transform(Run(spark, sf_dir).scan("part").select("p_size", "p_retailprice")))


def _one_hot_sql(start: int = 0) -> str:
    return f"select c_custkey as row, ({start} + d.k)::int as pos, case when c_mktsegment = d.v then 1.0::double else 0.0::double end as value from customer, (select v, row_number() over (order by v) - 1 as k from (select distinct c_mktsegment as v from customer)) d"


@query(_one_hot_sql())
def tf_one_hot(spark, sf_dir):
    return long_form(ml.OneHotEncoder().fit_transform(Run(spark, sf_dir).scan("customer").select("c_mktsegment")))


@query(_one_hot_sql().replace("select distinct c_mktsegment as v from customer", "select distinct c_mktsegment as v from customer where c_mktsegment < 'F'"))
def tf_one_hot_unknown(spark, sf_dir):
    customer = Run(spark, sf_dir).scan("customer")
    encoder = ml.OneHotEncoder(handle_unknown="ignore").fit(customer.filter(F.col("c_mktsegment") < "F").select("c_mktsegment"))
    return long_form(encoder.transform(customer.select("c_mktsegment")))


def _imputed(spark, sf_dir, imputer: ml.SimpleImputer, column: str) -> DataFrame:
    out = imputer.fit_transform(Run(spark, sf_dir).customers().select(column))
    value = r6(column) if column == "bal" else F.col(column)
    return out.hidden.select(F.col(ORD)[0].alias("row"), value.alias("value"))


@query(f"with {CUST} select c_custkey as row, round(coalesce(bal, (select avg(bal) from cust)), 6) as value from cust")
def tf_impute_mean(spark, sf_dir):
    return _imputed(spark, sf_dir, ml.SimpleImputer("mean"), "bal")


@query(f"with {CUST} select c_custkey as row, round(coalesce(bal, (select median(bal) from cust)), 6) as value from cust")
def tf_impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir, ml.SimpleImputer("median"), "bal")


@query(f"with {CUST}, {MODE} select c_custkey as row, coalesce(seg, best) as value from cust, m")
def tf_impute_most_frequent(spark, sf_dir):
    return _imputed(spark, sf_dir, ml.SimpleImputer("most_frequent"), "seg")


@query(f"with {CUST} select c_custkey as row, coalesce(seg, 'NONE') as value from cust")
def tf_impute_constant(spark, sf_dir):
    return _imputed(spark, sf_dir, ml.SimpleImputer("constant", "NONE"), "seg")


UNIFORM = "e as (select min(p_size) + (max(p_size) - min(p_size)) * k / 4.0::double as edge, k from part, range(1, 4) r(k) group by k)"


@query(f"with {UNIFORM} select p_partkey as row, 0 as pos, (select count(*) from e where p_size >= edge)::double as value from part")
def tf_kbins_uniform(spark, sf_dir):
    return long_form(ml.KBinsDiscretizer(4).fit_transform(Run(spark, sf_dir).scan("part").select("p_size")))


@query("with e as (select unnest(quantile_cont(c_acctbal, [0.25, 0.5, 0.75])) as edge from customer) select c_custkey as row, 0 as pos, (select count(*) from e where c_acctbal >= edge)::double as value from customer")
def tf_kbins_quantile(spark, sf_dir):
    return long_form(ml.KBinsDiscretizer(4, strategy="quantile").fit_transform(Run(spark, sf_dir).scan("customer").select("c_acctbal")))


@query(f"with {UNIFORM} select p_partkey as row, b::int as pos, case when (select count(*) from e where p_size >= edge) = b then 1.0::double else 0.0::double end as value from part, range(4) x(b)")
def tf_kbins_onehot(spark, sf_dir):
    return long_form(ml.KBinsDiscretizer(4, encode="onehot").fit_transform(Run(spark, sf_dir).scan("part").select("p_size")))


KMEANS = (
    "recursive k(i, c0, c1, c2, c3) as (select 0, lo + w / 2, lo + 3 * w / 2, lo + 5 * w / 2, lo + 7 * w / 2 from (select min(p_size)::double as lo, (max(p_size) - min(p_size)) / 4.0::double as w from part) "
    "union all select i + 1, (select avg(p_size) from part where p_size < (c0 + c1) / 2), (select avg(p_size) from part where p_size >= (c0 + c1) / 2 and p_size < (c1 + c2) / 2), "
    "(select avg(p_size) from part where p_size >= (c1 + c2) / 2 and p_size < (c2 + c3) / 2), (select avg(p_size) from part where p_size >= (c2 + c3) / 2) from k where i < 60)"
)


@query(f"with {KMEANS}, e as (select * from k where i = 60) select p_partkey as row, 0 as pos, ((p_size >= (c0 + c1) / 2)::int + (p_size >= (c1 + c2) / 2)::int + (p_size >= (c2 + c3) / 2)::int)::double as value from part, e")
def tf_kbins_kmeans(spark, sf_dir):
    return long_form(ml.KBinsDiscretizer(4, strategy="kmeans").fit_transform(Run(spark, sf_dir).scan("part").select("p_size")))


@query("select o_orderkey as row, round(ln(o_totalprice + 1), 6) as value from orders")
def tf_function_log(spark, sf_dir):
    out = ml.FunctionTransformer(lambda c: F.log1p(c)).fit_transform(Run(spark, sf_dir).scan("orders").select("o_totalprice"))
    return out.hidden.select(F.col(ORD)[0].alias("row"), r6("o_totalprice").alias("value"))


@query("select o_orderkey as row, round(ln(o_totalprice + 1), 6) as value from orders")
def tf_function_udf(spark, sf_dir):
    import numpy as np

    out = ml.FunctionTransformer(np.log1p, vectorized=True).fit_transform(Run(spark, sf_dir).scan("orders").select("o_totalprice"))
    return out.hidden.select(F.col(ORD)[0].alias("row"), r6("o_totalprice").alias("value"))


@query(
    "with w as (select p_partkey as row, unnest(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9_]{2,}')) as t from part), "
    "h as (select row, (('0x' || substr(md5(t), 1, 8))::bigint % 16)::int as pos, sum(case when substr(md5(t), 9, 1) < '8' then 1.0 else -1.0 end)::double as s from w group by all), "
    "n as (select row, sqrt(sum(s * s)) as size from h group by row) "
    "select p_partkey as row, k::int as pos, round(case when size > 0 then coalesce(s, 0) / size else 0.0 end, 6)::double as value from part cross join range(16) g(k) left join n on n.row = p_partkey left join h on h.row = p_partkey and h.pos = k"
)
def tf_hashing_md5(spark, sf_dir):
    part = Run(spark, sf_dir).scan("part").with_column("text", F.concat_ws(" ", "p_type", "p_brand")).select("text")
    return long_form(ml.HashingVectorizer(16).fit_transform(part))


@query()
def tf_hashing_murmur(spark, sf_dir):
    docs = Run(spark, sf_dir).scan("documents").select("text")
    return ml.HashingVectorizer(64, ngram_range=(1, 2), hash="murmur3").fit_transform(docs).df


@query()
def tf_word2vec(spark, sf_dir):
    words = Run(spark, sf_dir).scan("part").select("p_type")
    return ml.Word2Vec(8, min_count=2, seed=1).fit_transform(words).df


CT = SCALED.replace("p_partkey", "c_custkey").split(" union all ")[0].replace("p_size", "c_acctbal").replace("part", "customer") + " union all " + _one_hot_sql(1)


def _features() -> ml.ColumnTransformer:
    return ml.ColumnTransformer([("n", ml.StandardScaler(), ["c_acctbal"]), ("c", ml.OneHotEncoder(), ["c_mktsegment"])])


@query(CT)
def ct_numeric_categorical(spark, sf_dir):
    return long_form(_features().fit_transform(Run(spark, sf_dir).scan("customer")))


@query(
    f"with {SPLIT}, f as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as d from s where k > ceil(0.25 * n)), t as (select * from s where k <= ceil(0.25 * n)) "
    "select c_custkey as row, 0 as pos, round((c_acctbal - m) / d, 6) as value from t, f union all "
    "select c_custkey, (1 + d.k)::int, case when c_mktsegment = d.v then 1.0::double else 0.0::double end from t, (select v, row_number() over (order by v) - 1 as k from (select distinct c_mktsegment as v from s where k > ceil(0.25 * n))) d"
)
def ct_transform_after_fit(spark, sf_dir):
    train, test = Run(spark, sf_dir).scan("customer").train_test_split(0.25, seed=7)
    features = _features()
    features.fit_transform(train)
    return long_form(features.transform(test))


@query(
    f"with {CUST}, {MODE}, i as (select c_custkey, coalesce(bal, (select avg(bal) from cust)) as bal, coalesce(seg, best) as seg from cust, m) "
    "select c_custkey as row, 0 as pos, round((bal - avg(bal) over ()) / stddev_pop(bal) over (), 6) as value from i union all "
    "select c_custkey, (1 + d.k)::int, case when seg = d.v then 1.0::double else 0.0::double end from i, (select v, row_number() over (order by v) - 1 as k from (select distinct seg as v from i)) d"
)
def ct_nested_pipeline(spark, sf_dir):
    features = ml.ColumnTransformer([
        ("n", ml.Pipeline([("i", ml.SimpleImputer("mean")), ("s", ml.StandardScaler())]), ["bal"]),
        ("c", ml.Pipeline([("i", ml.SimpleImputer("most_frequent")), ("o", ml.OneHotEncoder())]), ["seg"]),
    ])
    return long_form(features.fit_transform(Run(spark, sf_dir).customers()))


# --- models -----------------------------------------------------------------------------------------------------------


def _rich_model(run: Run, model: ml.models.Model) -> DataFrame:
    customer = run.scan("customer").with_column("rich", (F.col("c_acctbal") > 4000).cast("int"))
    train, test = customer.train_test_split(0.25, seed=3)
    features = _features()
    x = features.fit_transform(train)
    model.fit(x, train.select("rich"))
    found = model.score(features.transform(test), test.select("rich"))
    return run.spark.createDataFrame([(type(model).__name__, float(found), len(run.recorder.dag.nodes))], "model string, accuracy double, nodes int")


@query()
def est_decision_tree_score(spark, sf_dir):
    return _rich_model(Run(spark, sf_dir), ml.DecisionTreeClassifier(max_depth=4))


@query()
def est_sgd_score(spark, sf_dir):
    return _rich_model(Run(spark, sf_dir), ml.SGDClassifier(loss="log_loss"))


@query()
def est_logreg_score(spark, sf_dir):
    return _rich_model(Run(spark, sf_dir), ml.LogisticRegression())


@query()
def est_mlp_score(spark, sf_dir):
    return _rich_model(Run(spark, sf_dir), ml.MLPClassifier(epochs=30, hidden=[4]))


@query()
def est_grid_search(spark, sf_dir):
    return _rich_model(Run(spark, sf_dir), ml.GridSearch(ml.LogisticRegression(max_iter=20), {"penalty": ["l1", "l2"]}, cv=3))


@query("select round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem")
def est_ols_simple(spark, sf_dir):
    items = Run(spark, sf_dir).scan("lineitem")
    model = ml.OLS().fit(items.select("l_quantity").add_constant(), items.select("l_extendedprice"))
    return spark.createDataFrame([tuple(round(x, 4) for x in model.params)], "intercept double, slope double")


#: Each regressor without what the earlier ones explain, then the coefficients from the last to the first.
OLS_SQL = (
    "a as (select l_extendedprice as y, l_quantity as q, l_discount as d, l_tax as t from lineitem), "
    "b as (select *, d - (regr_slope(d, q) over () * q + regr_intercept(d, q) over ()) as d1, t - (regr_slope(t, q) over () * q + regr_intercept(t, q) over ()) as t1 from a), "
    "c as (select *, t1 - (regr_slope(t1, d1) over () * d1 + regr_intercept(t1, d1) over ()) as t2 from b), "
    "bt as (select regr_slope(y, t2) as v from c), bd as (select regr_slope(y - v * t, d1) as v from c, bt), "
    "bq as (select regr_slope(y - bt.v * t - bd.v * d, q) as v, regr_intercept(y - bt.v * t - bd.v * d, q) as k from c, bt, bd)"
)


@query(f"with {OLS_SQL} select 0 as pos, round(k, 3) as value from bq union all select 1, round(v, 3) from bq union all select 2, round(v, 3) from bd union all select 3, round(v, 3) from bt")
def est_ols_multi(spark, sf_dir):
    items = Run(spark, sf_dir).scan("lineitem")
    model = ml.OLS().fit(items.select("l_quantity", "l_discount", "l_tax").add_constant(), items.select("l_extendedprice"))
    return spark.createDataFrame([(i, round(x, 3)) for i, x in enumerate(model.params)], "pos int, value double")


@query("select round(avg(case when (o_totalprice > 150000) = (o_orderstatus = 'O') then 1.0 else 0.0 end)::double, 6) as accuracy from orders")
def metric_accuracy(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = orders.select((F.col("o_totalprice") > 150000).alias("prediction"), (F.col("o_orderstatus") == "O").alias("label"))
    return ml.accuracy(pairs).select(r6("accuracy").alias("accuracy"))


# --- recorded programs ------------------------------------------------------------------------------------------------


@query("select * from (values (0, 'Data Source'), (1, 'Data Source'), (2, 'Selection'), (3, 'Join'), (4, 'Projection')) t(node_id, operator)")
def dag_of_program(spark, sf_dir):
    """The DAG of a program in Spark's own API, as a table of nodes."""
    from pipelens.inspector import PipelineInspector

    program = f"""
from pyspark.sql import functions as F
orders = spark.read.parquet("{sf_dir}/orders.parquet")
customer = spark.createDataFrame([(1, "a"), (2, "b")], "o_custkey bigint, name string")
out = orders.filter(F.col("o_totalprice") > 100000).join(customer, on="o_custkey").select("o_orderkey", "name")
"""
    nodes, _ = PipelineInspector.on_pipeline_from_string(program).execute(spark).dag.to_frames(spark)
    return nodes.select("node_id", "operator")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders, a filter on price, and how it shifts the shares of market segments."""
    return check_no_bias_selection(spark, sf_dir)

