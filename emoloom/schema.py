"""Labels and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = ("anger", "disgust", "fear", "joy", "sadness", "surprise")
LABELS7 = ("anger", "disgust", "fear", "joy", "love", "sadness", "surprise")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """A schema from "name type, …", without a session."""
    fields = (part.strip().rsplit(" ", 1) for part in text.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in fields])


MULTI_LABEL = _schema("ID long, Data string, Love long, Joy long, Surprise long, Anger long, Sadness long, Fear long, Topic string, Domain string, is_admin boolean")
SINGLE_LABEL = _schema("text string, classes string")
MULTI_LABEL_7 = _schema("`Unnamed: 0` long, comment string, anger long, contempt long, disgust long, enjoyment long, fear long, sadness long, surprise long")
HARMONISED = _schema(
    "source_dataset string, source_split string, source_row_id long, text string, anger int, disgust int, fear int, joy int, sadness int, surprise int, "
    "emonoba_disgust_assumption boolean, f5_eligible boolean, original_love long, original_class string, original_contempt long, original_enjoyment long, domain string, topic string"
)
GROUPS = _schema("group_id string, group_type string, n_rows long, n_sources long, sources string, is_cross_source boolean, is_cross_split boolean, is_conflicting boolean, n_label_vectors long, action string")
