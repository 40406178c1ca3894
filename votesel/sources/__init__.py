"""Inputs: labelled tables derived from the parquet test tables, and the text (CSV) reader."""

from votesel.sources.fixtures import (  # noqa: F401
    band_lines,
    customer_segment,
    doc_quality,
    embedding_wide,
    lineitem_band,
    order_lines,
    order_status,
)
from votesel.sources.text import parse_lines, quarantine_lines, read_text_table  # noqa: F401
