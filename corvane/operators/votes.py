"""Label votes of a community's training members; ties go to the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_vote(votes: DataFrame, weight: str | None = None) -> DataFrame:
    """``query, predicted``: the label with most votes (or weight)."""
    score = F.sum(weight) if weight else F.count("*")
    tally = votes.groupBy("query", "label").agg(score.alias("score"))
    return tally.groupBy("query").agg(F.min_by("label", F.struct((-F.col("score")).alias("s"), "label")).alias("predicted"))


def train_members(members: DataFrame, nodes: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Voters of each community: its training nodes but the query and the forbidden ones."""
    df = members.where("node <> query").join(nodes.where("train").select(F.col("node_id").alias("node"), "label"), "node")
    return df.join(forbidden, "node", "left_anti") if forbidden is not None else df


def global_majority(nodes: DataFrame) -> DataFrame:
    """The commonest training label, in one row."""
    return label_vote(nodes.where("train").select(F.lit(0).alias("query"), "label")).select(F.col("predicted").alias("majority"))


def distance_vote(voters: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """Votes weigh one over the distance; voters out of reach add nothing, and where all are, each counts one.

    Without ``distances``, voters have their ``distance``. Weights of a label are added as counts by distance, in order of distance, so that the sum does not depend on the order of rows.
    """
    near = voters if distances is None else voters.join(distances, ["query", "node"], "left")
    tally = near.groupBy("query", "label", "distance").agg(F.count("*").alias("c"))
    parts = F.array_sort(F.collect_list(F.when(F.col("distance") > 0, F.struct("distance", "c"))))
    score = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p.c.cast("double") / p.distance)
    scored = tally.groupBy("query", "label").agg(score.alias("w"), F.sum("c").alias("n"))
    most = F.max("w").over(Window.partitionBy("query"))  # a row for each label
    scored = scored.withColumn("most", most).withColumn("w", F.when(F.col("most") > 0, F.col("w")).otherwise(F.col("n").cast("double")))
    return label_vote(scored, "w")


def fallback_vote(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Majority of the nearest layer that has training nodes; without any, the global majority."""
    voters = nodes.where("train").select(F.col("node_id").alias("node"), "label", F.lit(True).alias("votes"))
    told = distances.join(voters, "node", "left").withColumn("distance", F.when(F.col("votes") & (F.col("distance") > 0), F.col("distance")))
    tally = told.groupBy("query", "distance", "label").agg(F.count("*").alias("c"))
    place = F.when(F.col("distance").isNotNull(), F.struct("distance", (-F.col("c")).alias("s"), "label"))
    found = tally.groupBy("query").agg(F.min_by("label", place).alias("predicted"))
    whole = global_majority(nodes)
    return found.crossJoin(F.broadcast(whole)).select("query", F.coalesce("predicted", "majority").alias("predicted"))  # one row


def hard_subset(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose training successors vote for another label than their own."""
    members = edges.select(F.col("source").alias("query"), F.col("target").alias("node")).distinct()
    voted = label_vote(train_members(members, nodes))
    return voted.join(nodes.select(F.col("node_id").alias("query"), "label"), "query").where("predicted <> label").select("query", "label", "predicted")
