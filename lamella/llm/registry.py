"""The queries of this subpackage, and the SQL of those that SQL can express."""

from lamella.llm.ann import op3_inverted_multi_index
from lamella.llm.chat import SQL as CHAT_SQL
from lamella.llm.chat import op8_chat_format
from lamella.llm.exact_dedup import SQL as EXACT_SQL
from lamella.llm.exact_dedup import op9_exact_dedup
from lamella.llm.line_dedup import SQL as LINE_SQL
from lamella.llm.line_dedup import op1_line_dedup
from lamella.llm.mixing import op6_source_mixing
from lamella.llm.packing import op10_best_fit_packing
from lamella.llm.sharding import op7_karmarkar_karp_shards
from lamella.llm.simhash import op4_simhash_near_dedup
from lamella.llm.suffix_dedup import op5_run_length_dedup
from lamella.llm.toxicity import op2_crf_toxicity

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_crf_toxicity, op3_inverted_multi_index, op4_simhash_near_dedup, op5_run_length_dedup, op6_source_mixing, op7_karmarkar_karp_shards, op8_chat_format, op9_exact_dedup, op10_best_fit_packing)}
ORACLE_SQL = {"op1_line_dedup": LINE_SQL, "op8_chat_format": CHAT_SQL, "op9_exact_dedup": EXACT_SQL}
