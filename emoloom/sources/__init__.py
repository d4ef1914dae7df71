"""Readers and writers beside Spark's own."""

from .readers import csv_inferred, csv_with_nullable_ids, encoding_probe, excel, json_config, polarity_lexicon, word_list
from .writers import csv_with_bom, json_report, markdown_table, once, parquet, saved_matrix

__all__ = [
    "csv_inferred", "csv_with_bom", "csv_with_nullable_ids", "encoding_probe", "excel", "json_config", "json_report", "markdown_table",
    "once", "parquet", "polarity_lexicon", "saved_matrix", "word_list",
]
