"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .decontamination import op6_decontamination
from .fingerprints import op1_fingerprints
from .katz import op8_katz
from .mixing import OP3_SQL, op3_mixing
from .neardup import op9_neardup
from .pii import op7_pii
from .simhash import op11_simhash
from .spelling import op13_spelling
from .substrings import OP10_SQL, op10_substrings
from .toxicity import op4_toxicity
from .urlfilter import OP2_SQL, op2_urlfilter
from .warc import OP5_SQL, op5_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_urlfilter, op3_mixing, op4_toxicity, op5_warc, op6_decontamination, op7_pii, op8_katz, op9_neardup, op10_substrings, op11_simhash, op12_alignment, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op2_urlfilter": OP2_SQL, "op3_mixing": OP3_SQL, "op5_warc": OP5_SQL, "op10_substrings": OP10_SQL}
