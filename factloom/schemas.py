"""Schemas of the data model. Readers declare them, so no scan infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


TASK1_GOLD = _strings(
    "paper_id claim_id claim label caption evi_type evi_path context domain use_context operation paper_path detail_others "
    "license_name license_url claim_id_pair evi_path_original"
)
TASK1_INPUT = T.StructType([f for f in TASK1_GOLD if f.name not in ("label", "operation", "detail_others", "claim_id_pair")])
TASK2_GOLD = _strings(
    "sample_id question evidence_id_1 evidence_id_2 label claim context caption domain evi_type paper_id use_context operation "
    "paper_path detail_others license_name license_url"
)
TASK1_PRED = _strings("claim_id pred_label")
TASK2_PRED = _strings("sample_id pred_label")
ADVISOR_CACHE = _strings("image_path advisor evi_type text")
CANDIDATE = T.StructType(
    [*_strings("pmcid bucket title licence doi"), T.StructField("tables_in_body", T.IntegerType()), T.StructField("figures_in_body", T.IntegerType()), T.StructField("publication_date", T.StringType())]
)
CONTENT = T.StructType(
    [
        *_strings("tag text label caption xref_id"),
        T.StructField("graphics", T.ArrayType(T.StringType())),
        T.StructField("table_columns", T.ArrayType(T.StringType())),
        T.StructField("table_values", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
DOCUMENT = T.StructType(
    [
        *_strings("pmcid title licence"),
        T.StructField("tables_in_body", T.IntegerType()),
        T.StructField("figures_in_body", T.IntegerType()),
        T.StructField("body_sections", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("contents", T.ArrayType(CONTENT))]))),
    ]
)
OA_INDEX = T.StructType(
    [
        T.StructField("pmcid", T.StringType()),
        T.StructField("found", T.BooleanType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("files", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("size", T.LongType())]))),
    ]
)
FIGURE_CLASS = T.StructType([T.StructField("num_panels", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())])
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in "x0 y0 x1 y1".split()])
OCR_BOX = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in "conf x0 y0 x1 y1 w h cx cy".split()]])
