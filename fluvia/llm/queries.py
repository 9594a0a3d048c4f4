"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .simhash import op1_simhash
from .secrets import op9_secrets
from .toxicity import op3_toxicity
from .telephony import op5_telephony
from .language import op4_language
from .pii import op7_pii
from .html import op8_html
from .ann import op2_ann
from .packing import op10_packing
from .collocation import op13_collocations
from .collocation import SQL as COLLOCATIONS
from .dialogue import op11_dialogue
from .pieces import op12_pieces


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_ann": op2_ann,
        "op3_toxicity": op3_toxicity,
        "op4_language": op4_language,
        "op5_telephony": op5_telephony,
        "op6_bpe": op6_bpe,
        "op7_pii": op7_pii,
        "op8_html": op8_html,
        "op9_secrets": op9_secrets,
        "op10_packing": op10_packing,
        "op11_dialogue": op11_dialogue,
        "op12_pieces": op12_pieces,
        "op13_collocations": op13_collocations,
    }


def sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op13_collocations": COLLOCATIONS}
