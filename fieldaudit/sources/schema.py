"""Declared schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
TEXT_MAP = T.MapType(_s, _s)


def _struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RULE_DETAIL = _struct(format_check=_s, checksum_check=_s, category_check=_s, semantic_check=_s, semantic_strict=_s,
                      overall=_s, category=_s, reason=_s)
MANIFEST = _struct(
    image_id=_s, document_id=_s, person_id=_s, split=_s, doc_type=_s, forgery_category=_s, control_index=_i, label=_i,
    quality_tier=_s, template_variant=_i, naming_stratum=_s, pan_fifth_source=_s, honorific=_s, gender=_s, aadhaar_gt=_s,
    pan_gt=_s, printed_values=TEXT_MAP, boxes=T.MapType(_s, T.ArrayType(_i)), width=_i, height=_i, render_seed=_l,
    degrade_seed=_l, jpeg_q_capture=_i, bytes=_l, motion_blur=_i, phash=T.DecimalType(20, 0), rule_gt_verdict=_s,
    rule_gt_detail=RULE_DETAIL, expected_rule=_s, file=_s, forgery_field=_s, forgery_detail=_s, gt_value=_s,
    forged_value=_s, c1_op=_s, c1_field=_s, c1_region=T.ArrayType(_i), c1_detail=_s, ocr=TEXT_MAP, ocr_parsed=TEXT_MAP,
    rule_ocr_verdict=_s, rule_ocr_detail=RULE_DETAIL, ocr_exact=T.MapType(_s, _i), ocr_cer=T.MapType(_s, _d))
# Fixed value: columns of the flat manifest, in file order.
FLAT_COLUMNS = (
    "image_id document_id person_id split doc_type forgery_category control_index label quality_tier template_variant "
    "naming_stratum pan_fifth_source forgery_field forgery_detail c1_op c1_field rule_gt_verdict rule_ocr_verdict "
    "expected_rule width height jpeg_q_capture phash file").split()
FLAT_MANIFEST = T.StructType([T.StructField(c, MANIFEST[c].dataType) for c in FLAT_COLUMNS])
RECORD = _struct(
    person_id=_s, gender=_s, naming_stratum=_s, honorific=_s, name_latin=_s, name_devanagari=_s,
    name_tokens=T.ArrayType(_s), surname=_s, dob=_s, father_name_latin=_s, aadhaar=_s, pan=_s, pan_category=_s, pan_fifth=_s,
    pan_fifth_source=_s, photo_seed=_l, template_aadhaar=_i, template_pan=_i, extra=TEXT_MAP, split=_s)
SCORES = T.StructType(
    [T.StructField(c, t) for c, t in (("image_id", _s), ("split", _s), ("doc_type", _s), ("forgery_category", _s),
                                      ("label", _i), ("logit", _d), ("top_tile", _i))]
    + [T.StructField(f"tile{i}", _d) for i in range(15)])
RULE_DECISIONS = _struct(
    image_id=_s, split=_s, doc_type=_s, forgery_category=_s, label=_i, quality_tier=_s, expected_rule=_s, forgery_field=_s,
    eligible=_i, gt_decision=_i, gt_failed_checks=_s, gt_mechanism_match=_i, gt_reason=_s, ocr_decision=_i,
    ocr_failed_checks=_s, ocr_mechanism_match=_i, ocr_reason=_s)
EPOCHS = _struct(epoch=_i, train_loss=_d, val_pr_auc=_d, val_auroc=_d, lr_end=_d, sec=_d)
