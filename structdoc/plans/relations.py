"""Queries that put the relational combinators to work on events, orders, line items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structdoc.operators import lookup
from structdoc.plans.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def event_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one type for each user, merged: count, sum, first and last event."""
    runs = lookup.islands(_events(spark, sf_dir), ["user_id"], "at", "event_type")
    return runs.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.min("event_id").alias("least_event"), F.max("event_id").alias("largest_event"))


def event_next_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that no click or purchase of the same user follows next."""
    w = Window.partitionBy("user_id").orderBy("at")
    following = _events(spark, sf_dir).withColumn("next_type", F.lead("event_type").over(w))
    return following.where((F.col("event_type") == "view") & ~F.coalesce(F.col("next_type").isin("click", "purchase"), F.lit(False))).select("event_id", "next_type")


def conv_fallback_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th answer to the n-th question of each conversation."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    answered = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"))
    return lookup.zip_join(asked, answered, ["conv_id"], "asked", "answered").select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "asked", "answered")


def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_by(table(spark, sf_dir, "events"), F.col("event_type")).withColumnRenamed("key", "event_type")


def count_by_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return lookup.count_by(docs, F.col("quality")).withColumnRenamed("key", "quality")


def top1_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_quantity") * 10 + F.when(F.col("l_returnflag") == "R", 100).otherwise(0)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return lookup.keep_best(lines, ["l_orderkey"], F.col("score"), "seq").drop("seq")


def topk_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lookup.top_k(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 4)


def first_wins_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def last_wins_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def media_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, by key, and then by nothing: those without keep their order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return orders.join(customers, "c_custkey", "left").select("o_orderkey", "c_custkey", "c_name")


def post_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


def fallback_coalesce_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality for each document: its own label, else its source's and language's mean, else its language's, with where it is from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    known = docs.join(labels, "doc_id")
    own = labels.select("doc_id", F.col("quality").cast("double").alias("value"))
    mean = lambda *keys: known.groupBy(*keys).agg(F.round(F.avg("quality"), 6).alias("value"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    return lookup.fallback_join(docs, [("own", own, ["doc_id"]), ("source", mean("lang", "source"), ["lang", "source"]), ("lang", mean("lang"), ["lang"])], "value").select("doc_id", "value", "origin")


def semi_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def anti_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def asof_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's latest view up to it and first click from it on."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "at")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "at")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "at")
    out = lookup.asof(lookup.asof(bought, views, ["user_id"], "at", "at", ["view_id"]), clicks, ["user_id"], "at", "at", ["click_id"], before=False)
    return out.select("event_id", "user_id", "view_id", "click_id")


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within an hour after a signup of the same user."""
    events = _events(spark, sf_dir)
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("at").alias("start"), (F.col("at") + 3_600_000_000).alias("end"))
    return lookup.within(events.select("user_id", "event_id", "at"), spans, ["user_id"], "at", "start", "end", bucket=3_600_000_000).where("event_id <> signup_id").select("signup_id", "event_id")


def union_keep_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation the account of the highest balance among customers and suppliers, customers first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("seq"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey"), F.col("s_name"), F.col("s_acctbal"), F.col("s_suppkey") + 1_000_000_000_000)
    return lookup.keep_best(c.union(s), ["nation"], F.col("balance"), "seq").select("nation", "name", "balance")


def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the events that a capture of at most 6 events and 240 units keeps."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.abs("value")).cast("long").alias("units"))
    return lookup.running_cap(events, ["user_id"], "event_id", F.col("units"), 6, 240).select("user_id", "event_id", "running_total")


def weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("discount"))


def min_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the order of a total nearest to 150000."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.round(F.abs(F.col("o_totalprice") - 150000), 2).alias("distance"))
    return lookup.keep_best(orders, ["o_custkey"], -F.col("distance"), "o_orderkey").select("o_custkey", "o_orderkey", "distance")


def separator_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each user are left when repeated errors are collapsed."""
    kept = lookup.collapse_repeats(_events(spark, sf_dir), ["user_id"], "at", "event_type", only="error")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(k > 0, k).alias("k"))


def request_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the user's purchases within a day after it, by the operator that streams of requests use too."""
    from structdoc.streaming.capture import correlate

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("received_at"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("finished_at"))
    return correlate(views, bought, "user_id", "1 day").select("view_id", "purchase_id")


def session_quiescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end after six quiet hours."""
    w = Window.partitionBy("user_id").orderBy("at")
    new = F.when((F.col("at") - F.lag("at").over(w)) <= 21_600_000_000, 0).otherwise(1)
    numbered = _events(spark, sf_dir).withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"), F.max("at").alias("end"))


def rolling_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a capture that replaces an item when a larger one comes: for each user and type the largest value."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return lookup.keep_best(events, ["user_id", "event_type"], F.col("value"), "event_id")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by the operator that streams use too."""
    from structdoc.streaming.capture import quiet_sessions

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return quiet_sessions(events, ["user_id"], "ts", "6 hours").select("user_id", F.unix_micros("start").alias("start"), "n")
