"""Queries of the text operators, and SQL for those that SQL can express."""

from kalkula.llm.context_tree import op3_context_tree
from kalkula.llm.divergence import OP11_SQL, op11_single_pass_index
from kalkula.llm.language import op2_language_bitmask
from kalkula.llm.licenses import OP1_SQL, op1_license_setjoin
from kalkula.llm.mixing import op5_pivotal_mix
from kalkula.llm.packing import op9_best_fit_packing
from kalkula.llm.pii import op10_information_content
from kalkula.llm.quality import op4_rule_ledger
from kalkula.llm.secrets import op6_secret_ledger
from kalkula.llm.simhash import op7_simhash_pigeonhole
from kalkula.llm.sketches import op8_bottom_k
from kalkula.llm.slack import op13_minimum_bin_slack
from kalkula.llm.turn_trie import OP12_SQL, op12_adaptive_radix

QUERIES = {f.__name__: f for f in (op1_license_setjoin, op2_language_bitmask, op3_context_tree, op4_rule_ledger, op5_pivotal_mix, op6_secret_ledger, op7_simhash_pigeonhole, op8_bottom_k, op9_best_fit_packing, op10_information_content, op11_single_pass_index, op12_adaptive_radix, op13_minimum_bin_slack)}
ORACLE_SQL: dict[str, str] = {"op1_license_setjoin": OP1_SQL, "op11_single_pass_index": OP11_SQL, "op12_adaptive_radix": OP12_SQL}
