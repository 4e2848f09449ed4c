"""Queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from semindex.llm import gif, gru, mixing, neardup, phrases, pieces, preference, quality, ranked_search, substring, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pfair_mix": mixing.op1_pfair_mix,
        "op2_piece_nbest": pieces.op2_piece_nbest,
        "op3_repeat_spans": substring.op3_repeat_spans,
        "op4_order_minhash": neardup.op4_order_minhash,
        "op5_gru_lm": gru.op5_gru_lm,
        "op6_quality_bands": quality.op6_quality_bands,
        "op7_pu_toxicity": toxicity.op7_pu_toxicity,
        "op8_warc_chunks": warc.op8_warc_chunks,
        "op9_gif_frames": gif.op9_gif_frames,
        "op10_token_files": token_files.op10_token_files,
        "op11_phrases": phrases.op11_phrases,
        "op12_quality_ranker": preference.op12_quality_ranker,
        "op13_ranked_search": ranked_search.op13_ranked_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pfair_mix": mixing.OP1_SQL, "op8_warc_chunks": warc.OP8_SQL, "op11_phrases": phrases.OP11_SQL, "op13_ranked_search": ranked_search.OP13_SQL}
