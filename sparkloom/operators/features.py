"""Features of users, items and their pairs from reviews' side tables, as joins and aggregations. Schemas are those of sources.readers.SCHEMAS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import elite_years, last_elite_year, map_total, safe_divide, total_of

COMPLIMENTS = ("hot", "more", "plain", "cool", "funny", "writer")
#: Features of a pair, in the order of the model's input: the first list, and the later one.
V1 = ["u_reviews", "u_stars", "u_since", "u_fans", "u_useful", "u_votes", "u_elite", "u_compliments", "b_stars", "b_reviews", "b_checkins", "tip_likes", "photo_food", "photo_place"]
V2 = ["u_reviews", "u_stars", "u_years", "u_fans", "u_votes", "u_elite", "u_last_elite", "u_compliment_share", "b_stars", "b_reviews", "b_slots", "b_checkins", "tips", "photo_food", "photo_place"]


def user_features(user: DataFrame, now: int = 2019, first: int = 2004) -> DataFrame:
    """A row for each user. Years count from ``now`` and from ``first``; of a repeated id, any one row."""
    since = F.substring("yelping_since", 1, 4).cast("int")
    compliments = total_of(*[f"compliment_{c}" for c in COMPLIMENTS])
    last = last_elite_year(F.col("elite"))
    return user.select(
        "user_id",
        F.col("review_count").alias("u_reviews"),
        F.col("average_stars").alias("u_stars"),
        since.alias("u_since"),
        (now - since).alias("u_years"),
        F.col("fans").alias("u_fans"),
        F.col("useful").alias("u_useful"),
        total_of("useful", "funny", "cool").alias("u_votes"),
        elite_years(F.col("elite")).alias("u_elite"),
        F.when(last.isNull(), 0).otherwise(last - first).alias("u_last_elite"),
        compliments.alias("u_compliments"),
        safe_divide(compliments, F.col("review_count")).alias("u_compliment_share"),
    ).dropDuplicates(["user_id"])


def business_features(business: DataFrame, checkin: DataFrame, photo: DataFrame) -> DataFrame:
    """A row for each business, with its check-ins (slots and sum) and photos of food and of the place; zeros where there are none."""
    visits = checkin.groupBy("business_id").agg(F.sum(F.size("time")).alias("b_slots"), F.sum(map_total(F.col("time"))).alias("b_checkins"))
    photos = photo.groupBy("business_id").agg(F.count_if(F.col("label").isin("food", "drink", "menu")).alias("photo_food"), F.count_if(F.col("label").isin("inside", "outside")).alias("photo_place"))
    own = business.select("business_id", F.col("stars").alias("b_stars"), F.col("review_count").alias("b_reviews")).dropDuplicates(["business_id"])
    return own.join(visits, "business_id", "left").join(photos, "business_id", "left").fillna(0, ["b_slots", "b_checkins", "photo_food", "photo_place"])


def tip_features(tip: DataFrame, order: str | None = None) -> DataFrame:
    """(user_id, business_id, tips, tip_likes): how many, and the likes of the last by ``order`` (without it, the most)."""
    likes = F.max_by("likes", order) if order else F.max("likes")
    return tip.groupBy("user_id", "business_id").agg(F.count("*").alias("tips"), likes.alias("tip_likes"))


def pair_features(pairs: DataFrame, users: DataFrame, businesses: DataFrame, tips: DataFrame) -> DataFrame:
    """pairs (user_id, business_id, ...) with all features; unknown users and businesses have nulls, pairs without tips zeros. Side tables are joined by their keys, none is collected."""
    return pairs.join(users, "user_id", "left").join(businesses, "business_id", "left").join(tips, ["user_id", "business_id"], "left").fillna(0, ["tips", "tip_likes"])
