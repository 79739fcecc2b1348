"""The queries of the text operators."""

from pointframe.llm import language, lines, neardup, pages, pieces, quality, resampling, secrets, spots, tiling, topk, toxicity, whitening

QUERIES = {
    "op1_decontamination": tiling.op1_decontamination,
    "op2_secrets": secrets.op2_secrets,
    "op3_main_text": pages.op3_main_text,
    "op4_quality": quality.op4_quality,
    "op5_fingerprints": spots.op5_fingerprints,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_language_id": language.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_whitening": whitening.op11_whitening,
    "op12_resampling": resampling.op12_resampling,
    "op13_topk": topk.op13_topk,
    "spot_near_classes": spots.spot_near_classes,
}
ORACLES: dict[str, str] = {"op6_line_dedup": lines.OP6_SQL, "op13_topk": topk.OP13_SQL}
