"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .html import op1_html
from .kdtree import OP3_SQL, op3_kdtree
from .lines import op5_lines
from .mixing import op8_mix
from .onebit import op10_onebit
from .packing import op9_pack
from .pii import op7_surrogates
from .quality import op4_quality
from .simhash import op2_simhash
from .toxicity import op6_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_html, op2_simhash, op3_kdtree, op4_quality, op5_lines, op6_toxicity, op7_surrogates, op8_mix, op9_pack, op10_onebit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_kdtree": OP3_SQL}
