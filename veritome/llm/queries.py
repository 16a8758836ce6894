"""The queries of this subpackage, by name, and their SQL."""

from veritome.llm import oracles
from veritome.llm.alignment import op11_token_alignment
from veritome.llm.brown import op4_brown_classes
from veritome.llm.decontaminate import op10_decontaminate
from veritome.llm.jaccard import op5_jaccard_join
from veritome.llm.language import op2_language_codes
from veritome.llm.mixing import op6_soft_mixing
from veritome.llm.phrases import op12_collocations
from veritome.llm.quality import op3_neighbour_quality
from veritome.llm.revisits import op1_revisits
from veritome.llm.rules import CONFIDENCE, GRID, RISK, op7_risk_controlled
from veritome.llm.spans import op8_substring_dedup
from veritome.llm.superminhash import op13_superminhash
from veritome.llm.urlrules import RULES, op9_url_rules

QUERIES = {f.__name__: f for f in (op1_revisits, op2_language_codes, op3_neighbour_quality, op4_brown_classes, op5_jaccard_join, op6_soft_mixing, op7_risk_controlled, op8_substring_dedup, op9_url_rules, op10_decontaminate, op11_token_alignment, op12_collocations, op13_superminhash)}
ORACLES = {
    "op1_revisits": oracles.OP1,
    "op5_jaccard_join": oracles.OP5,
    "op7_risk_controlled": oracles.op7(GRID, RISK, CONFIDENCE),
    "op8_substring_dedup": oracles.OP8,
    "op9_url_rules": oracles.op9(RULES),
    "op10_decontaminate": oracles.OP10,
    "op12_collocations": oracles.OP12,
    "op13_superminhash": oracles.OP13,
}
