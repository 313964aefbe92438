"""The corpus operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.llm.audio import op9_audio
from attestor.llm.context_tree import op13_context_tree
from attestor.llm.decontaminate import OP6_SQL, op6_decontaminate
from attestor.llm.importance import OP12_SQL, op12_importance
from attestor.llm.language_id import language_id_pages, op4_language_id
from attestor.llm.near_dup import op3_near_dup
from attestor.llm.packing import op10_best_two_fit
from attestor.llm.pii import op8_pii
from attestor.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from attestor.llm.secrets import op7_secrets
from attestor.llm.sharding import op2_sharding
from attestor.llm.sql import OP3_SQL
from attestor.llm.token_orc import op1_token_orc
from attestor.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_sharding": op2_sharding,
    "op3_near_dup": op3_near_dup,
    "op4_language_id": op4_language_id,
    "language_id_pages": language_id_pages,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_audio": op9_audio,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance": op12_importance,
    "op13_context_tree": op13_context_tree,
}

SQL: dict[str, str] = {
    "op3_near_dup": OP3_SQL,
    "op6_decontaminate": OP6_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_importance": OP12_SQL,
}
