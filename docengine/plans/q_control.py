"""Queries: control-plane tables (prompt versions, providers, capabilities, artifacts) on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.plans.registry import query, table


@query("ctl1_prompt_versions", "SELECT conv_id, turn AS version, turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS active, 1 + max(turn) OVER (PARTITION BY conv_id) AS next_version FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def ctl1(spark, sf_dir):
    """The last activated version alone is active; the next number is one more than the greatest."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    rows = c.where(F.col("role").isin("user", "assistant")).join(c.where("role = 'user'").select("conv_id"), "conv_id", "left_semi")
    w = Window.partitionBy("conv_id")
    active = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    return rows.select("conv_id", F.col("turn").alias("version"), (F.col("turn") == active).alias("active"), (F.max("turn").over(w) + 1).alias("next_version"))


@query("jn10_ctl10_provider_of_capability", "SELECT n_regionkey, arg_min(s_suppkey, s_acctbal * 1000000 + s_suppkey) AS provider FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY n_regionkey")
def jn10(spark, sf_dir):
    """The enabled provider of least priority for each capability."""
    rows = table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey").agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("provider"))


@query("ctl2_guarded_delete", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def ctl2(spark, sf_dir):
    """Deletes every fifth supplier, but those that are bound stay."""
    bound = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    free = s.where("s_suppkey % 5 = 0").join(bound, "s_suppkey", "left_anti")
    return s.join(free, "s_suppkey", "left_anti")


@query("ctl4_batch_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def ctl4(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("ctl3_archive", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'ARCHIVED' ELSE o_orderstatus END AS status FROM orders")
def ctl3(spark, sf_dir):
    done = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(done, "ARCHIVED").otherwise(F.col("o_orderstatus")).alias("status"))


@query("cnt_total_with_page", "SELECT count(*) AS total, min(o_orderkey) AS first FROM orders WHERE o_orderpriority LIKE '1%'")
def cnt(spark, sf_dir):
    """The total that goes with a page (TOP-4)."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).agg(F.count("*").alias("total"), F.min("o_orderkey").alias("first"))


@query(
    "ctl9_ctl12_row_changes",
    """WITH t AS (SELECT p_partkey, p_name, p_size, p_size % 4 = 0 AS locked FROM part WHERE p_partkey % 10 <> 1)
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 2 AND NOT locked THEN 'changed' ELSE p_name END AS p_name, p_size, CASE p_partkey % 10 WHEN 4 THEN true WHEN 5 THEN false ELSE locked END AS locked FROM t WHERE NOT (p_partkey % 10 = 3 AND NOT locked)
    UNION ALL SELECT p_partkey, 'new', p_size, false FROM part WHERE p_partkey % 10 = 1""",
)
def ctl9(spark, sf_dir):
    """Templates created, updated, deleted, locked and unlocked; locked ones refuse updates and deletions."""
    from docengine.operators import relational as R

    p = table(spark, sf_dir, "part").withColumn("locked", F.col("p_size") % 4 == 0).select("p_partkey", "p_name", "p_size", "locked")
    k = F.col("p_partkey") % 10
    op = F.when(k.isin(0, 1), "create").when(k == 2, "update").when(k == 3, "delete").when(k == 4, "lock").when(k == 5, "unlock")
    name = F.when(k == 1, "new").when(k == 2, "changed")
    last = p.where(k < 6).select("p_partkey", name.alias("p_name"), F.when(k == 1, F.col("p_size")).alias("p_size"), F.lit(None).cast("boolean").alias("locked"), op.alias("op"), F.lit(2).alias("seq"))
    earlier = p.where(k < 6).select("p_partkey", F.lit("never").alias("p_name"), F.lit(-1).alias("p_size"), F.lit(True).alias("locked"), F.lit("update").alias("op"), F.lit(1).alias("seq"))
    return R.apply_changes(p.where(k != 1), last.unionByName(earlier), "p_partkey")
