"""Stand-in tables built from the driver tables (TPC-H-like star schema plus events, documents,
embeddings, conversations). Each is a pure DataFrame expression over the parquet inputs, so its
size grows with the inputs. Scores are integer arithmetic divided last, so any engine agrees.

The same definitions are written in SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_answer
from ..operators.ordered import row_index
from ..session import small_methods

# Five columns that are unique on lineitem at every scale ((orderkey, linenumber) is not).
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_methods(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, line key, label (R=1, A=0), good/bad probabilities with many ties, pred_label (NULL = miss)."""
    li = load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model"))
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    k = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + label * 200) % 1000
    return li.join(orders, "l_orderkey").select(
        "model",
        *LINE_KEY,
        label.alias("label"),
        ((F.lit(1000) - k) / F.lit(1000.0)).alias("good_prob"),
        (k / F.lit(1000.0)).alias("bad_prob"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("int")).when(k > 500, 1).otherwise(0).alias("pred_label"),
    )


def answer_text() -> Column:
    """Six answer shapes picked by (orderkey + linenumber) % 6."""
    v = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    flip = (F.col("l_partkey") % 4) == 0
    is_r = F.col("l_returnflag") == "R"
    word = F.when(is_r != flip, F.lit("bad")).otherwise(F.lit("good"))
    risk = _s("risk")
    return (
        F.when(v == 0, F.concat(F.lit("Reasoning about order "), _s("l_orderkey"), F.lit(".\n\nFinal assessment: "), word, F.lit("\nDefault risk: "), risk))
        .when(v == 1, F.concat(F.lit("Line "), _s("l_linenumber"), F.lit(" looks fine.\n\nFinal assessment: "), word, F.lit("\nDefault risk: "), risk, F.lit("\nThat is my answer.")))
        .when(v == 2, F.concat(F.lit("Checking part "), _s("l_partkey"), F.lit(".\n\n**Final assessment**: "), word))
        .when(v == 3, F.concat(F.lit("SUPPLIER "), _s("l_suppkey"), F.lit(" REVIEWED.\n\nFINAL ASSESSMENT: "), F.upper(word)))
        .when(v == 4, F.concat(F.lit("I cannot decide about order "), _s("l_orderkey"), F.lit(".")))
        .otherwise(F.concat(F.lit("<think>\nweigh order "), _s("l_orderkey"), F.lit("</think>\nFinal assessment: "), word, F.lit("\nDefault risk: "), risk))
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per line: line key, response text, expected word and label."""
    li = load(spark, sf_dir, "lineitem")
    return li.withColumn("risk", (F.col("l_partkey") % 100 + 1).cast("int")).select(
        *LINE_KEY,
        answer_text().alias("response"),
        F.when(F.col("l_returnflag") == "R", F.lit("bad")).otherwise(F.lit("good")).alias("expected"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N candidate answers per prompt (prompt = order, candidate = line), in a fixed position order."""
    a = answers(spark, sf_dir)
    a = row_index(a, LINE_KEY[1:], by=["l_orderkey"], name="pos")
    parsed = parse_answer("response")
    probs = F.array(
        ((F.col("l_partkey") * 7) % 100) / F.lit(100.0),
        ((F.col("l_suppkey") * 11 + F.col("l_linenumber")) % 100) / F.lit(100.0),
        ((F.col("l_orderkey") * 13 + F.col("l_partkey")) % 100) / F.lit(100.0),
    )
    return a.select(
        F.col("l_orderkey").alias("prompt_id"),
        F.col("pos").cast("int").alias("pos"),
        "response",
        parsed["pred_label"].alias("pred_label"),
        parsed["good_prob"].alias("good_prob"),
        parsed["bad_prob"].alias("bad_prob"),
        (F.col("l_orderkey") % 3 == 0).cast("int").alias("label"),
        probs.alias("step_good_probs"),
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged rollouts: one trajectory per user, steps in (ts, event_id) order.
    traj_id, step, reward, value, next_value (0 after the last step), done, log-probs, entropy."""
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = row_index(ev, ["ts", "event_id"], by=["user_id"], name="step")
    t = ev.select(
        F.col("user_id").alias("traj_id"),
        "step",
        "event_id",
        F.col("value").alias("reward"),
        ((F.col("event_id") * 37) % 100 / F.lit(100.0)).alias("v"),
        (F.col("event_type") == "error").alias("done"),
        (-((F.col("event_id") * 13) % 100 + 1) / F.lit(100.0)).alias("logp_old"),
        (-((F.col("event_id") * 17) % 100 + 1) / F.lit(100.0)).alias("logp_new"),
        ((F.col("event_id") % 50) / F.lit(100.0)).alias("entropy"),
    )
    nxt = t.select("traj_id", (F.col("step") - 1).alias("step"), F.col("v").alias("next_value"))
    return t.join(nxt, ["traj_id", "step"], "left").withColumn("next_value", F.coalesce("next_value", F.lit(0.0)))


def _whole(x: Column) -> Column:
    """``F.round`` of a double to a whole number, halves away from zero, without decimals: ``x - rint(x)`` is exact; negative zero becomes zero."""
    even = F.rint(x)
    return F.when(F.abs(x - even) == 0.5, x + F.signum(x) * F.lit(0.5)).otherwise(even) + F.lit(0.0)


def _key_string() -> Column:
    cents = _whole(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws(":", *[F.col(c).cast("string") for c in LINE_KEY[:4]], cents.cast("string"))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan table (the reference's 22 raw columns plus a unique string id) from
    lineitem, orders, customer, nation and part. Status: A -> Fully Paid, R -> Charged Off,
    N -> Current. emp_length is NULL on line 7."""
    li = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    p = load(spark, sf_dir, "part")
    # the orders get their customer first: lines are the largest table and are dealt out by part and by order only
    oc = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    j = li.join(p, li.l_partkey == p.p_partkey).join(oc, li.l_orderkey == oc.o_orderkey)
    dbl = lambda e: e.cast("double")
    return j.select(
        _key_string().alias("id"),
        (F.col("l_quantity") * 10).alias("installment"),
        F.col("p_brand").alias("purpose"),
        F.col("l_linestatus").alias("application_type"),
        _whole(F.col("l_discount") * 100).alias("int_rate"),
        _whole(F.col("l_tax") * 1000).alias("last_pymnt_amnt"),
        F.col("l_extendedprice").alias("loan_amnt"),
        F.col("o_totalprice").alias("revol_bal"),
        dbl(F.col("l_linenumber") - 1).alias("delinq_2yrs"),
        dbl(F.col("l_partkey") % 7).alias("inq_last_6mths"),
        dbl(F.col("c_nationkey") % 4).alias("mort_acc"),
        F.substring("o_orderpriority", 1, 1).alias("grade"),
        dbl(F.col("p_size")).alias("open_acc"),
        (dbl(F.col("l_partkey") % 1000) / 10).alias("revol_util"),
        F.col("l_quantity").alias("total_acc"),
        dbl(600 + F.col("l_suppkey") % 200).alias("fico_range_low"),
        dbl(604 + F.col("l_suppkey") % 200).alias("fico_range_high"),
        F.col("n_name").alias("addr_state"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .otherwise(F.concat((F.col("p_size") % 10).cast("string"), F.lit(" years")))
        .alias("emp_length"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.col("o_orderstatus").alias("verification_status"),
        (_whole(F.col("c_acctbal") * 100) / 10).alias("annual_inc"),
        _status().alias("loan_status"),
    )


def loan_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and status of every loan: what the sampling operators need, from one table."""
    return load(spark, sf_dir, "lineitem").select(_key_string().alias("id"), _status().alias("loan_status"))


def _status() -> Column:
    return F.when(F.col("l_returnflag") == "A", "Fully Paid").when(F.col("l_returnflag") == "R", "Charged Off").otherwise("Current")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged rollouts: question = order, rollout = line; node = position // 2 (two rollouts per
    node); correct = returnflag 'R'. Text is built from integer columns."""
    a = load(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag")
    a = row_index(a, LINE_KEY[1:], by=["l_orderkey"], name="pos")
    return a.select(
        F.col("l_orderkey").alias("question_id"),
        F.floor(F.col("pos") / 2).cast("long").alias("node_id"),
        F.col("pos").cast("int").alias("pos"),
        F.concat(F.lit("Check part "), _s("l_partkey"), F.lit(" from supplier "), _s("l_suppkey"), F.lit(".")).alias("rollout"),
        (F.col("l_returnflag") == "R").alias("correct"),
    )


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-tree nodes: one per (question, node) of ``rollouts``; parent = (node - 1) // 2;
    own step text; visits = rollouts of the node; seq = node id."""
    return nodes_of(rollouts(spark, sf_dir))


def nodes_of(r: DataFrame) -> DataFrame:
    """``tree_nodes`` from a rollout table that is there already."""
    nodes = r.groupBy("question_id", "node_id").agg(F.count(F.lit(1)).alias("visits"), F.min("rollout").alias("_first"))
    return nodes.select(
        "question_id",
        "node_id",
        F.when(F.col("node_id") == 0, F.lit(None).cast("long")).otherwise(F.floor((F.col("node_id") - 1) / 2)).cast("long").alias("parent_id"),
        F.col("node_id").alias("seq"),
        F.concat(F.lit("Step "), _s("node_id"), F.lit(": "), F.col("_first")).alias("text"),
        "visits",
    )


def doc_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solution prefixes from documents: question = first line, prefix = whole text, steps are
    lines (tag '\\n'); mc = (doc_id % 9) / 8."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("question"),
        F.col("text").alias("solution_prefix"),
        ((F.col("doc_id") % 9) / F.lit(8.0)).alias("mc_value"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning episodes: one per conversation, one action per turn in turn order; every fourth
    turn ends with a verdict line."""
    c = load(spark, sf_dir, "conversations")
    action = F.when(F.col("turn") % 4 == 3, F.concat(F.col("text"), F.lit("\nFinal assessment: good"))).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("step"), action.alias("action"))
