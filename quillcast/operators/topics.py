"""Topic of an article by the words it uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import words


def topic_assign(
    articles: DataFrame, topic_words: dict[str, list[str]] = fixed.TOPIC_WORDS
) -> DataFrame:
    """Add ``topic_no`` (from 1) and ``topic``.

    An article belongs to the topic with the most of its words, the earlier one
    on a tie, and to the last topic where no word matches. The word lists are a
    parameter of the job, so they go into the plan as literals: no join and no
    shuffle.
    """
    topics = list(topic_words)
    text = words(F.concat_ws(" ", "title", "summary"))
    scored = articles.withColumn("_words", text)
    scored = scored.withColumn("_scores", F.array(*(_count_of(topic_words[t]) for t in topics)))
    best = F.array_max("_scores")
    number = F.when(best > 0, F.array_position("_scores", best)).otherwise(len(topics))
    names = F.array(*(F.lit(t) for t in topics))
    return (
        scored.withColumn("topic_no", number.cast("int"))
        .withColumn("topic", F.element_at(names, F.col("topic_no")))
        .drop("_words", "_scores")
    )


def _count_of(listed: list[str]) -> Column:
    return F.size(F.filter("_words", lambda w: w.isin(*listed)))


def topic_groups(assigned: DataFrame) -> DataFrame:
    """Articles per topic and digest; topics without any do not appear."""
    return assigned.groupBy("digest_id", "topic_no", "topic").agg(F.count("*").alias("n_articles"))
