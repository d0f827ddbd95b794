"""The queries of this subpackage and the SQL that checks them."""

from . import centroids, collocations, decontam, language_id, line_dedup, lm_score, media, mixing, ngram_join, packing, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_warc": warc.op2_warc,
    "op3_media": media.op3_media,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_packing": packing.op11_packing,
    "op12_collocations": collocations.op12_collocations,
    "op13_centroids": centroids.op13_centroids,
}
ORACLES = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontam.ORACLE,
    "op8_url_filters": url_filter.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
