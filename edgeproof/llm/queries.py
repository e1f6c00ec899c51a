"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fm_decontamination import OP4_SQL, op4_fm_decontamination
from .language_ranks import op12_language_ranks
from .lm_bloom import op7_lm_bloom
from .media_jpeg import op10_media_jpeg
from .merkle_manifest import OP11_SQL, op11_merkle_manifest
from .phrase_collocations import OP13_SQL, op13_phrase_collocations
from .quality_qda import op6_quality_qda
from .simhash_neardup import op9_simhash_neardup
from .source_mixing import op3_source_mixing
from .substring_countmin import OP2_SQL, op2_substring_countmin
from .suffix_rindex import op1_suffix_rindex
from .toxicity_crf import op5_toxicity_crf
from .warc_merkle import OP8_SQL, op8_warc_merkle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_rindex": op1_suffix_rindex,
    "op2_substring_countmin": op2_substring_countmin,
    "op3_source_mixing": op3_source_mixing,
    "op4_fm_decontamination": op4_fm_decontamination,
    "op5_toxicity_crf": op5_toxicity_crf,
    "op6_quality_qda": op6_quality_qda,
    "op7_lm_bloom": op7_lm_bloom,
    "op8_warc_merkle": op8_warc_merkle,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_media_jpeg": op10_media_jpeg,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_ranks": op12_language_ranks,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLE_SQL: dict[str, str] = {"op2_substring_countmin": OP2_SQL, "op4_fm_decontamination": OP4_SQL, "op8_warc_merkle": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
