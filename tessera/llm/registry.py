"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from tessera.llm import gif_media, html_extraction, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, suffix_dedup, vector_clusters, vector_codes, vector_search

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_mixing": mixing.op8_mixing,
    "op9_gif_media": gif_media.op9_gif_media,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_centroid_clustering": vector_clusters.op12_centroid_clustering,
    "op13_vector_search": vector_search.op13_vector_search,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op7_secret_scan": secret_scan.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_centroid_clustering": vector_clusters.ORACLE,
}
