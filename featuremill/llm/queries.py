"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe_stream import op9_bpe_stream
from .decontaminate import op8_decontaminate
from .langid import op4_langid
from .line_dedup import OP10_SQL, op10_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .pii import op7_personal_data
from .quality import OP2_SQL, op2_quality_rules
from .shards import OP5_SQL, op5_shards
from .signature_tree import op12_jaccard_join
from .simhash import op6_simhash
from .substring_dedup import op3_substring_dedup
from .token_files import op1_token_files
from .whitening import op13_whitening

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_langid": op4_langid,
    "op5_shards": op5_shards,
    "op6_simhash": op6_simhash,
    "op7_personal_data": op7_personal_data,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe_stream": op9_bpe_stream,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op5_shards": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
