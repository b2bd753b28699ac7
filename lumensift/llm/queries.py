"""The corpus operators as queries over the whole tables, and SQL for those that SQL can express."""

from . import cotraining, decontamination, license_scan, line_dedup, mixing, near_dedup, quality_rules, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_classifier": cotraining.op7_quality_classifier,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_warc": warc.op9_warc,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLES = {"op6_mixing": mixing.OP6_SQL, "op8_line_dedup": line_dedup.OP8_SQL}
