"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm.ann_mih import op1_nearest_multi_index
from plumbline.llm.bpe_lexicon import op7_bpe_lexicon
from plumbline.llm.decontam import op9_benchmark_spaced_seeds
from plumbline.llm.fim_boundaries import OP12_SQL, op12_fill_in_middle
from plumbline.llm.language_kn import op13_language_kneser_ney
from plumbline.llm.line_dedup import op5_line_dedup
from plumbline.llm.merkle import OP11_SQL, op11_merkle_manifest
from plumbline.llm.ngram_join import op4_ngram_jaccard_join
from plumbline.llm.quality_fm import op3_quality_factorisation_machine
from plumbline.llm.secrets_rf import op2_secret_scan
from plumbline.llm.sharding_kk import op6_sharding_karmarkar_karp
from plumbline.llm.toxicity_gbt import op10_toxicity_boosted_trees
from plumbline.llm.warc_io import OP8_SQL, op8_warc_round_trip

QUERIES = {
    "op1_nearest_multi_index": op1_nearest_multi_index,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_factorisation_machine": op3_quality_factorisation_machine,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding_karmarkar_karp": op6_sharding_karmarkar_karp,
    "op7_bpe_lexicon": op7_bpe_lexicon,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_benchmark_spaced_seeds": op9_benchmark_spaced_seeds,
    "op10_toxicity_boosted_trees": op10_toxicity_boosted_trees,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_kneser_ney": op13_language_kneser_ney,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc_round_trip": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
