"""Column layouts of mappings and mapping sets."""

from pyspark.sql import types as T

STRINGS = """
uuid subject_id subject_id_curie predicate_id predicate_id_curie object_id object_id_curie
mapping_justification mapping_justification_curie subject_label subject_category predicate_label predicate_modifier
object_label object_category subject_type subject_source subject_source_version object_type object_source
object_source_version mapping_provider mapping_cardinality mapping_date other comment license mapping_tool
mapping_tool_version semantic_similarity_score semantic_similarity_measure
""".split()
ARRAYS = """
author_id author_label reviewer_id reviewer_label creator_id creator_label subject_match_field subject_preprocessing
object_match_field object_preprocessing match_string see_also
""".split()

#: 44 fields of a mapping, and the set that it belongs to.
MAPPING = T.StructType(
    [T.StructField(c, T.StringType(), c != "uuid") for c in STRINGS]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ARRAYS]
    + [T.StructField("mapping_set_id", T.StringType())]
)

MAPPING_SET = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("uuid", "mapping_provider", "mapping_set_description", "comment", "license")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("object_match_field", "mapping_set_source", "creator_label", "subject_match_field", "creator_id")]
    + [T.StructField("mappings", T.StructType([T.StructField("href", T.StringType())]))]
)

#: Facets offered by default; the last is an array.
FACETS = ("mapping_provider", "predicate_id_curie", "mapping_justification_curie", "subject_category", "object_category", "subject_match_field")
