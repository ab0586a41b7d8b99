"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, lines, neardup, pii, quality, secrets, tokenfile, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        bpe.op2_bpe,
        pii.op3_pii,
        tokenfile.op4_token_ids,
        toxicity.op5_toxicity,
        fingerprint.op6_fingerprint,
        neardup.op7_near_dedup,
        decontaminate.op8_decontaminate,
        lines.op9_line_dedup,
        secrets.op10_secrets,
    )
}
ORACLE_SQL = {"op9_line_dedup": lines.ORACLE_SQL}
