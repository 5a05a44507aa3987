"""Queries of this folder, and the DuckDB SQL of those that SQL can express."""

from sedimenta.llm.chat import OP7_SQL, op7_chat
from sedimenta.llm.mixing import op9_mixing
from sedimenta.llm.nn_descent import OP8_SQL, op8_nn_descent
from sedimenta.llm.packing import op6_packing
from sedimenta.llm.quality import op3_quality
from sedimenta.llm.simhash import op4_simhash
from sedimenta.llm.substring_dedup import op5_suffix_array
from sedimenta.llm.token_files import op1_token_files
from sedimenta.llm.toxicity import op2_toxicity
from sedimenta.llm.url_filter import op10_url_filter

QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_quality, op4_simhash, op5_suffix_array, op6_packing, op7_chat, op8_nn_descent, op9_mixing, op10_url_filter)}
ORACLES: dict[str, str] = {"op7_chat": OP7_SQL, "op8_nn_descent": OP8_SQL}
