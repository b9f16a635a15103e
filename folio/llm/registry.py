"""The corpus operators as named queries, with SQL for those that SQL can express."""

import corpus_pipeline
from folio.llm import clusters, jaccard, langid, mixing, neighbours, packing, phrases, pieces, pii, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_packing": packing.op4_packing,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_language_id": langid.op7_language_id,
    "op8_surrogates": pii.op8_surrogates,
    "op9_mixing": mixing.op9_mixing,
    "op10_approximate_nearest_neighbours": neighbours.op10_approximate_nearest_neighbours,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_centroid_clustering": clusters.op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op3_ngram_jaccard_join": jaccard.ORACLE,
    "op5_secret_scans": secrets.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "op13_centroid_clustering": clusters.ORACLE,
}
