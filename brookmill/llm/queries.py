"""The registered queries of the corpus operators, beside their SQL where SQL can express them."""

from __future__ import annotations

from brookmill.llm.query_decontamination import SQL as DECONTAMINATION_SQL
from brookmill.llm.query_decontamination import op12_decontamination
from brookmill.llm.query_importance import op13_importance
from brookmill.llm.query_language import op10_language
from brookmill.llm.query_licenses import op3_licenses
from brookmill.llm.query_minhash import op1_minhash
from brookmill.llm.query_mixing import SQL as MIXING_SQL
from brookmill.llm.query_mixing import op5_mixing
from brookmill.llm.query_packing import op2_packing
from brookmill.llm.query_quality import op6_quality
from brookmill.llm.query_revisits import SQL as REVISITS_SQL
from brookmill.llm.query_revisits import op8_revisits
from brookmill.llm.query_rules import SQL as RULES_SQL
from brookmill.llm.query_rules import op9_rules
from brookmill.llm.query_sequences import op4_sequences
from brookmill.llm.query_spelling import op11_spelling
from brookmill.llm.query_syncmers import op7_syncmers

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_sequences": op4_sequences,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_syncmers": op7_syncmers,
    "op8_revisits": op8_revisits,
    "op9_rules": op9_rules,
    "op10_language": op10_language,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_importance": op13_importance,
}
SQL = {"op5_mixing": MIXING_SQL, "op8_revisits": REVISITS_SQL, "op9_rules": RULES_SQL, "op12_decontamination": DECONTAMINATION_SQL}
