"""The queries of this package and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op3_byte_bpe
from .line_dedup import ORACLE_SQL as LINES_SQL
from .line_dedup import op5_line_dedup
from .media_columns import op1_media_columns
from .mixing import op8_mixing
from .near_dedup import op7_near_dedup
from .neighbours import op10_neighbours
from .repeat_spans import op9_repeat_spans
from .secret_scans import op2_secret_scans
from .token_files import op4_token_files
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_secret_scans, op3_byte_bpe, op4_token_files, op5_line_dedup, op6_toxicity, op7_near_dedup, op8_mixing, op9_repeat_spans, op10_neighbours)}

ORACLES: dict[str, str] = {"op5_line_dedup": LINES_SQL}
