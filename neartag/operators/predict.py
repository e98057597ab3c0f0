"""From neighbours to tags, and the text forms an outside linear learner reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.functions.tags import join_tags, parse_tags


def candidate_tags(neighbors: DataFrame, k: int) -> DataFrame:
    """id, tag: distinct tags of the first k neighbours of each query."""
    return (neighbors.filter(F.col("rank") <= k)
            .select(F.col("query_id").alias("id"), F.explode(parse_tags(F.col("tags"))).alias("tag"))
            .distinct())


def union_predict(neighbors: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """id, tags: the candidate tags as one string; empty for a query without neighbours.

    ``collect_set`` combines on the map side, and a query has at most k tag lists.
    """
    found = (candidate_tags(neighbors, k).groupBy("id")
             .agg(join_tags(F.collect_set("tag")).alias("tags")))
    return (queries.select(F.col("query_id").alias("id")).join(found, "id", "left")
            .select("id", F.coalesce("tags", F.lit("")).alias("tags")))


def tag_pairs(df: DataFrame, key: str = "id") -> DataFrame:
    """key, tag: one row per tag of a table with a tags string."""
    return df.select(key, F.explode(parse_tags(F.col("tags"))).alias("tag"))


def label_candidates(candidates: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Add ``label``: 1 for a true tag, -1 for any other, null when the truth is unknown."""
    if truth is None:
        return candidates.withColumn("label", F.lit(None).cast("int"))
    true = tag_pairs(truth).distinct().withColumn("label", F.lit(1))
    return (candidates.join(true, ["id", "tag"], "left")
            .withColumn("label", F.coalesce("label", F.lit(-1))))


def pack_bag(bag: DataFrame, key: str = "id") -> DataFrame:
    """key, features: the word bag (key, term, n) as a map from term to count."""
    entries = F.array_sort(F.collect_list(F.struct("term", F.col("n").cast("int"))))
    return bag.groupBy(key).agg(F.map_from_entries(entries).alias("features"))


def make_examples(candidates: DataFrame, bag: DataFrame) -> DataFrame:
    """id, tag, label, features for every candidate tag."""
    # Ids of a bag are unique once packed.
    return (candidates.join(pack_bag(bag), "id", "left")
            .select("id", "tag", "label", "features"))


def feature_text(features: Column) -> Column:
    """`` _word:n _word:n`` in word order; a colon in a word is spelled out."""
    entries = F.array_sort(F.map_entries(features))
    words = F.transform(entries, lambda e: F.concat(
        F.lit(" _"), F.regexp_replace(e.key, ":", "_COLON_"), F.lit(":"), e.value.cast("string")))
    return F.coalesce(F.array_join(words, ""), F.lit(""))


def format_examples(examples: DataFrame) -> DataFrame:
    """value: one learner line per example, ``label id^tag|tag  _word:n ...``.

    Without labels the line starts with the blank that separates them.
    """
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    return examples.select(F.concat(
        label, F.lit(" "), F.col("id").cast("string"), F.lit("^"), F.col("tag"), F.lit("|"),
        F.col("tag"), F.lit(" "), feature_text(F.col("features"))).alias("value"))


def predict_from_scores(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """id, tags: the tags that score above the threshold, else the single best one.

    NaN and null never win; an id that has nothing else gets empty tags.  Ties for the best
    go to the alphabetically first tag.  All parts are aggregates with a map-side combine.
    """
    real = F.col("score").isNotNull() & ~F.isnan("score") & F.col("tag").isNotNull()
    # min skips null, so rows without a real score do not compete.
    best = F.min(F.when(real, F.struct((-F.col("score")).alias("score"), F.col("tag")))).getField("tag")
    picked = scores.groupBy("id").agg(
        F.collect_set(F.when(real & (F.col("score") > threshold), F.col("tag"))).alias("above"),
        best.alias("best"))
    return picked.select("id", F.when(F.size("above") > 0, join_tags(F.col("above")))
                         .otherwise(F.coalesce("best", F.lit(""))).alias("tags"))
