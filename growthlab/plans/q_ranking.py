"""Queries: top-k operators and ranking metrics (ST4-ST6, RM2-RM17)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from growthlab.functions.arrays import top_ids
from growthlab.functions.columns import arr_to_str, round_doubles
from growthlab.operators import ranking as RK
from growthlab.plans import params as P
from growthlab.plans.catalogue import query
from growthlab.sources import fixtures as X


def scores(spark, sf):
    return X.scores(spark, sf, P.SCORE_DAY)


def topk(spark, sf, ties="asc"):
    return RK.topk_long(scores(spark, sf), P.TOP_K, ties)


def actual(spark, sf):
    return RK.user_sales(X.banner_events(spark, sf, P.SALES_START, P.SALES_END))


def pred_lists(spark, sf, k=P.TOP_K, ties="asc"):
    return scores(spark, sf).select("customer_id", top_ids("category_trend_scores", k, ties).alias("pred"))


@query("top_n_stable")
def top_n_stable(spark, sf):
    return scores(spark, sf).select("customer_id", arr_to_str(top_ids("category_trend_scores", P.TOP_N, "stable"))
                                    .alias("topn"))


@query("topk_user_categories")
def topk_user_categories(spark, sf):
    return round_doubles(topk(spark, sf), 6)


@query("topk_desc_ties")
def topk_desc_ties(spark, sf):
    return scores(spark, sf).select("customer_id", arr_to_str(top_ids("category_trend_scores", P.TOP_K, "desc"))
                                    .alias("predicted_top_category"))


def _ranks(spark, sf, ties="asc"):
    return RK.sales_category_rank(actual(spark, sf), topk(spark, sf, ties))


@query("sales_category_rank")
def sales_category_rank(spark, sf):
    return _ranks(spark, sf)


def _hit(spark, sf, ties="asc"):
    tk = topk(spark, sf, ties)
    return RK.hit_recall_per_customer(RK.sales_category_rank(actual(spark, sf), tk), tk, P.TOP_K)


@query("hit_recall_per_customer")
def hit_recall_per_customer(spark, sf):
    return round_doubles(_hit(spark, sf), 6)


@query("hit_recall_at_k")
def hit_recall_at_k(spark, sf):
    return round_doubles(RK.mean_by_k(_hit(spark, sf), {"hit_rate": "hit_rate_at_k", "recall": "recall_at_k"}), 6)


@query("hit_recall_by_model")
def hit_recall_by_model(spark, sf):
    # both tie rules are two lists of the same score arrays: one pass, keyed by the model
    sc = scores(spark, sf)
    lists = F.array(*[F.struct(F.lit(t).alias("model"), top_ids("category_trend_scores", P.TOP_K, t).alias("ids")) for t in ("asc", "desc")])
    tk = (sc.select("customer_id", F.explode(lists).alias("l")).select("l.model", "customer_id", F.posexplode("l.ids").alias("pos", "cma_id"))
          .select("model", "customer_id", "cma_id", (F.col("pos") + 1).cast("int").alias("rank")))
    sold = actual(spark, sf).withColumn("model", F.explode(F.array(F.lit("asc"), F.lit("desc"))))
    keys = ("model", "customer_id")
    both = RK.hit_recall_per_customer(RK.sales_category_rank(sold, tk, keys=keys), tk, P.TOP_K, keys, servable_by=("model",))
    return round_doubles(RK.mean_by_k(both, {"hit_rate": "hit_rate_at_k", "recall": "recall_at_k"}, ["model"]), 6)


def _metrics(spark, sf):
    labels = RK.label_sets(actual(spark, sf))
    return RK.ranking_metrics_at_k(pred_lists(spark, sf), labels, [1, 2, 3, 4])


@query("precision_at_k_fixed")
def precision_at_k_fixed(spark, sf):
    return round_doubles(_metrics(spark, sf).select("k", "precision_at_k"), 6)


@query("ndcg_at_k")
def ndcg_at_k(spark, sf):
    return round_doubles(_metrics(spark, sf).select("k", "ndcg_at_k"), 6)


@query("mean_avg_precision")
def mean_avg_precision(spark, sf):
    labels = RK.label_sets(actual(spark, sf))
    return round_doubles(RK.mean_average_precision(pred_lists(spark, sf), labels), 6)


@query("ranking_metrics_at_k")
def ranking_metrics_at_k(spark, sf):
    return round_doubles(_metrics(spark, sf), 6)


@query("sales_label_set")
def sales_label_set(spark, sf):
    ls = RK.label_sets(actual(spark, sf))
    return ls.select("customer_id", arr_to_str("labels").alias("labels"), "relevant_cat_cnt")


def _per_user(spark, sf):
    sc = scores(spark, sf)
    sales = actual(spark, sf)
    rel = RK.relevant_customers(sales, RK.model_categories(sc))
    labels = RK.label_sets(sales.join(rel, "customer_id", "left_semi"))
    return RK.precision_recall_per_user_k(labels, pred_lists(spark, sf, ties="stable"), P.TOP_K)


@query("precision_recall_per_user_k")
def precision_recall_per_user_k(spark, sf):
    return round_doubles(_per_user(spark, sf).select("customer_id", "k", "cnt_pred_lab_k", "perc_pred_lab_k",
                                                      "recall_pred_lab_k"), 6)


@query("precision_recall_at_k")
def precision_recall_at_k(spark, sf):
    return round_doubles(RK.precision_recall_at_k(_per_user(spark, sf)), 6)


@query("relevant_customers")
def relevant_customers(spark, sf):
    return RK.relevant_customers(actual(spark, sf), RK.model_categories(scores(spark, sf)))


@query("removed_customer_count")
def removed_customer_count(spark, sf):
    return RK.removed_customer_count(actual(spark, sf), RK.model_categories(scores(spark, sf)))


@query("prediction_quality_check")
def prediction_quality_check(spark, sf):
    return RK.prediction_quality_check(RK.precision_recall_at_k(_per_user(spark, sf)))


@query("rolling_precision_recall")
def rolling_precision_recall(spark, sf):
    """Score day d vs sales of day d+1 for d = first … last, one job keyed by dt."""
    snaps = X.scores_by_day(spark, sf, P.ROLL_FIRST, P.ROLL_LAST)
    ev = X.banner_events(spark, sf, P.ROLL_FIRST + _dt.timedelta(days=1), P.ROLL_LAST + _dt.timedelta(days=1))
    sales = RK.user_sales(ev.withColumn("dt", F.date_sub("dt", 1)), distinct=False, keys=("dt", "customer_id"))
    rel = RK.relevant_customers(sales, RK.model_categories(snaps, ["dt"]), keys=("dt", "customer_id"))
    labels = RK.label_sets(sales.join(rel, ["dt", "customer_id"], "left_semi"), keys=("dt", "customer_id"))
    preds = snaps.select("dt", "customer_id", top_ids("category_trend_scores", P.TOP_K, "stable").alias("pred"))
    per = RK.precision_recall_per_user_k(labels, preds, P.TOP_K, keys=("dt", "customer_id"))
    daily = RK.precision_recall_at_k(per, keys=["dt"])
    return round_doubles(daily.groupBy("k").agg(F.avg("precision_at_k").alias("precision_at_k"),
                                                 F.avg("recall_at_k").alias("recall_at_k")), 6)


@query("restricted_label_set")
def restricted_label_set(spark, sf):
    """RM9 with RM1's sentinel: labels restricted to a fixed category list, ids read as text
    with null and ``"null"`` ids (every seventh customer's here) dropped, then cast."""
    raw = X.banner_events(spark, sf, P.SALES_START, P.SALES_END)
    raw = raw.withColumn("customer_id", F.when(F.col("customer_id") % 7 == 0, F.lit("null")).otherwise(F.col("customer_id").cast("string")))
    sold = RK.user_sales(raw, drop_null_string=True, id_type="bigint")
    listed = X.category_map(spark, sf).where(F.col("cma_id").cast("int") <= 8).select("cma_id")
    ls = RK.label_sets(RK.restrict_labels(sold, listed))
    return ls.select("customer_id", arr_to_str("labels").alias("labels"), "relevant_cat_cnt")
