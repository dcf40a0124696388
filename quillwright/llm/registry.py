"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, prefix_trie
from .langid import op3_language_id
from .line_dedup import op13_line_runs
from .lm import op2_lm_scoring
from .media import op8_media_archive
from .mixing import op7_soft_mixing
from .prefix_trie import op12_prefix_trie
from .resampling import op11_importance_resampling
from .search import op10_topk_search
from .secrets import op1_secret_scan
from .sentencepiece_tok import op9_sentencepiece
from .sharding import op5_two_pass_shuffle
from .simhash import op6_simhash
from .suffix_dedup import op4_suffix_dedup

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_two_pass_shuffle": op5_two_pass_shuffle,
    "op6_simhash": op6_simhash,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_media_archive": op8_media_archive,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_topk_search": op10_topk_search,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_runs": op13_line_runs,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_line_runs": line_dedup.ORACLE_SQL}
