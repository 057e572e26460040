"""Schemas of the feature tables that image kernels would fill (see FIXTURES.md, section 3)."""

from __future__ import annotations

FEATURES = {
    "quality": "doc_id bigint, width int, height int, brightness double, contrast double, laplacian_variance double, skew_deg double, glare_ratio double, edge_density double",
    "synthetic": "doc_id bigint, lap_var double, edge_density double, texture_cv double, noise_cv double, texture_outlier_ratio double, ela_outlier_ratio double, ela_max_z double, ocr_conf double, text_len int",
    "blocks": "doc_id bigint, row int, col int, mean double, variance double",
    "files": "doc_id bigint, file_size bigint, width int, height int, software string, sha256 string",
    "security": "doc_id bigint, feature string, passed boolean",
    "faces": "doc_id bigint, corr double, grad double, hist double, orb double, sift double, orb_matches int, orb_inliers int, sift_matches int, sift_inliers int, zones int, coverage double",
    "boxes": "doc_id bigint, box_id bigint, x int, y int, w int, h int, conf double, text string",
    "tokens": "doc_id bigint, block int, par int, line int, left int, top int, width int, height int, conf double, text string",
}
