"""Queries of the numbered operators and the pipeline, with their SQL."""

import corpus_pipeline
from sieveline.llm import brown_lm, conversation_repair, decontaminate, exact_dedup, language_crf, licences, mixing, near_dedup, on_workers, pii, quality, sharding, suffix_dedup, vector_codes


def _query(run):
    def query(spark, sf_dir):
        on_workers(spark)
        return run(spark, sf_dir)

    query.__name__, query.__doc__ = run.__name__, run.__doc__
    return query


_RUNS = {
    "op1_language_crf": language_crf.op1_language_crf,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pii": pii.op3_pii,
    "op4_extendible_sharding": sharding.op4_extendible_sharding,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_brown_lm": brown_lm.op6_brown_lm,
    "op7_quality": quality.op7_quality,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_licence_scan": licences.op11_licence_scan,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: _query(run) for name, run in _RUNS.items()}
ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_extendible_sharding": sharding.SQL,
    "op5_source_mixing": mixing.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
