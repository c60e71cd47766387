"""The operators' registered queries and the SQL that checks them."""

from wardline.llm.bpe import op4_bpe
from wardline.llm.decontaminate import OP5_SQL, op5_decontaminate
from wardline.llm.embedding import OP2_SQL, op2_embedding
from wardline.llm.language import op7_language
from wardline.llm.licenses import op9_licenses
from wardline.llm.minhash import OP6_SQL, op6_minhash
from wardline.llm.packing import op13_packing
from wardline.llm.ppm import op10_lm_score
from wardline.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from wardline.llm.ranked import OP12_SQL, op12_ranked
from wardline.llm.sharding import op3_sharding
from wardline.llm.substring import op1_substring
from wardline.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_substring": op1_substring,
    "op2_embedding": op2_embedding,
    "op3_sharding": op3_sharding,
    "op4_bpe": op4_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_lm_score": op10_lm_score,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked": op12_ranked,
    "op13_packing": op13_packing,
}
ORACLES = {
    "op2_embedding": OP2_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_minhash": OP6_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_ranked": OP12_SQL,
}
