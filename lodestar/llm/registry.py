"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestar.llm import centroids, decontaminate, html_extract, importance, language_id, license_scan, media, mixing, near_dedup, quality, toxicity, url_filters, warc

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_warc_records": warc.op3_warc_records,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_language_id": language_id.op5_language_id,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_media_columns": media.op8_media_columns,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_license_scans": license_scan.op10_license_scans,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroid_clusters": centroids.op13_centroid_clusters,
}

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op10_license_scans": license_scan.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op13_centroid_clusters": centroids.ORACLE,
}
