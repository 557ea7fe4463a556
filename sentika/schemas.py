"""Declared schemas of the review table at each stage."""

from __future__ import annotations

from pyspark.sql import types as T


def columns(**types: str) -> T.StructType:
    """A schema of nullable columns with simple types."""
    schema = T.StructType()
    for name, kind in types.items():
        schema = schema.add(name, kind)
    return schema


# Source field names of the store feed and the columns they become.
SOURCE_COLUMNS = {
    "reviewId": "review_id",
    "userName": "username",
    "userImage": "user_image_url",
    "content": "review_text",
    "score": "rating",
    "thumbsUpCount": "helpful_count",
    "reviewCreatedVersion": "app_version",
    "at": "review_date",
    "replyContent": "dev_reply",
    "repliedAt": "dev_reply_date",
}

LANDING = columns(
    reviewId="string",
    userName="string",
    userImage="string",
    content="string",
    score="integer",
    thumbsUpCount="integer",
    reviewCreatedVersion="string",
    at="timestamp",
    replyContent="string",
    repliedAt="timestamp",
)

RAW = columns(
    review_id="string",
    username="string",
    user_image_url="string",
    review_text="string",
    rating="integer",
    helpful_count="integer",
    app_version="string",
    review_date="timestamp",
    dev_reply="string",
    dev_reply_date="timestamp",
)

LEXICON = columns(kind="string", label="string", term="string", ord="integer", replacement="string")

TRAINING_LOG = T.StructType().add(
    "training_log",
    T.ArrayType(
        columns(
            epoch="integer",
            train_loss="double",
            val_aspect_f1_macro="double",
            val_sentiment_f1_avg="double",
        )
    ),
)

ANNOTATION_INPUT = ["review_id", "review_text", "clean_text", "rating", "aspects", "sentiment_rule"]
ANNOTATION_BLANK = [
    "aspect_annotator_1",
    "sentiment_annotator_1",
    "aspect_annotator_2",
    "sentiment_annotator_2",
    "agreement",
    "notes",
]
