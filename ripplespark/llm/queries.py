"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_ann
from .binary import op10_binary
from .html import op1_html
from .langid import op2_langid
from .mixing import op7_mixing
from .packing import op8_packing
from .paragraphs import op5_paragraphs
from .quality import OP6_SQL, op6_quality
from .sharding import op9_sharding
from .simhash import op3_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html, op2_langid, op3_simhash, op4_ann, op5_paragraphs, op6_quality, op7_mixing, op8_packing, op9_sharding, op10_binary)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality": OP6_SQL}
