"""The queries of this subpackage by name, and SQL for DuckDB where it can express them."""

from __future__ import annotations

from gridloom.llm import centroids, chat_rotation, divergence, quality_rules, warc
from gridloom.llm.bpe import op4_byte_bpe
from gridloom.llm.centroids import op12_lloyd_centroids
from gridloom.llm.chat_rotation import op3_perspective_rotation
from gridloom.llm.decontaminate import op2_greedy_tiling
from gridloom.llm.divergence import op13_source_divergence
from gridloom.llm.langid import op10_nearest_centroid
from gridloom.llm.pii import op9_pii_anchors
from gridloom.llm.quality_knn import op8_lsa_neighbours
from gridloom.llm.quality_rules import op5_quality_rules
from gridloom.llm.sharding import op7_byte_prefix_shards
from gridloom.llm.simhash import op6_simhash_pigeonring
from gridloom.llm.token_store import op1_rans_token_store
from gridloom.llm.warc import op11_warc_segments

_ALL = (op1_rans_token_store, op2_greedy_tiling, op3_perspective_rotation, op4_byte_bpe, op5_quality_rules, op6_simhash_pigeonring, op7_byte_prefix_shards, op8_lsa_neighbours, op9_pii_anchors, op10_nearest_centroid, op11_warc_segments)
QUERIES = {f.__name__: f for f in (*_ALL, op12_lloyd_centroids, op13_source_divergence)}
ORACLES = {
    "op3_perspective_rotation": chat_rotation.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op11_warc_segments": warc.ORACLE_SQL,
    "op12_lloyd_centroids": centroids.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
