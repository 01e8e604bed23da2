"""The registered queries of this package and, where SQL can say it, the same in SQL."""

from .alignment import op12_alignment
from .decontaminate import OP1_SQL, op1_decontaminate
from .fill_middle import OP13_SQL, op13_fill_in_middle
from .html_extract import op2_html_extract
from .mixing import op10_mixing
from .near_duplicates import OP7_SQL, op7_near_duplicates
from .pieces import op11_sentencepiece
from .pii import op9_pii
from .quality_model import op5_quality_model
from .quality_rules import op6_quality_rules
from .secrets import op3_secrets
from .token_counts import op8_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extract": op2_html_extract,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_quality_model": op5_quality_model,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_alignment": op12_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op7_near_duplicates": OP7_SQL, "op13_fill_in_middle": OP13_SQL}
