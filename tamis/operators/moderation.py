"""What the decisions on media do to the documents that hold them: posts, comments, messages and profiles.

Verdicts are rows (doc_id, media_index, level, reason). Media are arrays of structs, so a document is one row before and
after, and the verdicts of one document meet it by an equi-join; a document's media are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
PROFILE_POSTS = ("avatar_update", "cover_update")
VIOLATION, ACTIVE = "policy_violation", "active"
MEDIA = "array<struct<url:string,mime:string,is_moderated:boolean,is_sensitive:boolean,reason:string>>"


def chat_clamped(level: Column, source: Column) -> Column:
    """Messages are blurred at most."""
    return F.when(source == "message", F.least(level, F.lit(1))).otherwise(level)


def video_level(verdict: Column) -> Column:
    """2 if the video's verdict says FLAGGED, else 0."""
    return F.when(F.contains(verdict, F.lit("FLAGGED")), 2).otherwise(0)


def by_document(verdicts: DataFrame) -> DataFrame:
    """(doc_id, verdicts): the verdicts of a document, in order of the media."""
    return verdicts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("media_index", "level", "reason"))).alias("verdicts"))


def flagged_media(media: Column, verdicts: Column) -> Column:
    """Media with a verdict are moderated; those above level 0 are sensitive and carry its reason. Of several verdicts
    on one medium the last in order counts; verdicts on media that don't exist have no effect."""

    def changed(m: Column, i: Column) -> Column:
        own = F.filter(verdicts, lambda v: v["media_index"] == i)
        hit = F.filter(own, lambda v: v["level"] > 0)
        reason = F.when(F.size(hit) > 0, F.try_element_at(hit, F.lit(-1))["reason"]).otherwise(m["reason"])
        return F.struct(
            m["url"].alias("url"),
            m["mime"].alias("mime"),
            (F.coalesce(m["is_moderated"], F.lit(False)) | (F.size(own) > 0)).alias("is_moderated"),
            (F.coalesce(m["is_sensitive"], F.lit(False)) | (F.size(hit) > 0)).alias("is_sensitive"),
            reason.alias("reason"),
        )

    return F.transform(media, changed)


def applied_to_posts(posts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`posts` (doc_id, type, author_id, media) with verdicts: new media, level, status, reason and notify.

    Posts that only show a new avatar or cover count level 1 as 2, and their authors aren't told. The reason is that of
    the first medium of the highest level.
    """
    met = posts.join(by_document(verdicts), "doc_id")
    profile = F.col("type").isin(*PROFILE_POSTS)
    valid = F.filter("verdicts", lambda v: (v["media_index"] >= 0) & (v["media_index"] < F.size("media")) & (v["level"] > 0))
    raised = F.transform(valid, lambda v: F.struct(F.when(profile & (v["level"] == 1), 2).otherwise(v["level"]).alias("level"), (-v["media_index"]).alias("place"), v["reason"].alias("reason")))
    top = F.array_max(raised)
    met = met.withColumn("_top", top).withColumn("media", flagged_media(F.col("media"), F.col("verdicts")))
    level = F.coalesce(F.col("_top.level"), F.lit(0))
    banned = level == 2
    return met.select(
        "doc_id",
        "type",
        "author_id",
        "media",
        level.cast("int").alias("level"),
        F.when(banned, VIOLATION).otherwise(ACTIVE).alias("status"),
        F.when(banned, F.col("_top.reason")).alias("reason"),
        (banned & F.col("author_id").isNotNull() & ~F.coalesce(profile, F.lit(False))).alias("notify"),
    )


def applied_to_comments(comments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`comments` (doc_id, author_id, post_id) with their verdict: status, sensitive, reason, notify."""
    met = comments.join(verdicts.groupBy("doc_id").agg(F.max(F.struct("level", "reason")).alias("v")), "doc_id")
    banned, hit = F.col("v.level") == 2, F.col("v.level") > 0
    return met.select(
        "doc_id",
        "author_id",
        "post_id",
        F.when(banned, VIOLATION).otherwise(ACTIVE).alias("status"),
        hit.alias("is_sensitive"),
        F.when(hit, F.col("v.reason")).alias("image_reason"),
        F.when(banned, F.col("v.reason")).alias("reason"),
        (banned & F.col("author_id").isNotNull()).alias("notify"),
    )


def applied_to_messages(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`messages` (doc_id, media) with verdicts: new media and whether one is above level 0. Messages have no status."""
    met = messages.join(by_document(verdicts), "doc_id")
    found = F.exists("verdicts", lambda v: (v["level"] > 0) & (v["media_index"] >= 0) & (v["media_index"] < F.size("media")))
    return met.select("doc_id", flagged_media(F.col("media"), F.col("verdicts")).alias("media"), found.alias("violation"))


def applied_to_profiles(profiles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`profiles` (doc_id, kind: avatar or cover, url) with their verdict: any level above 0 removes the image and tells
    its owner."""
    met = profiles.join(verdicts.groupBy("doc_id").agg(F.max(F.struct("level", "reason")).alias("v")), "doc_id")
    gone = F.col("v.level") > 0
    return met.select("doc_id", "kind", F.when(gone, "").otherwise(F.col("url")).alias("url"), F.lit(True).alias("is_moderated"), gone.alias("notify"), F.when(gone, F.col("v.reason")).alias("reason"))


def notifications(posts: DataFrame, comments: DataFrame, profiles: DataFrame) -> DataFrame:
    """(receiver_id, kind, doc_id, reason) of everybody who has to be told, from the three applied tables."""
    parts = [
        posts.filter("notify").select(F.col("author_id").alias("receiver_id"), F.lit("post").alias("kind"), "doc_id", "reason"),
        comments.filter("notify").select(F.col("author_id").alias("receiver_id"), F.lit("comment").alias("kind"), "doc_id", "reason"),
        profiles.filter("notify").select(F.col("doc_id").alias("receiver_id"), F.col("kind"), "doc_id", "reason"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
