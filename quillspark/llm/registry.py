"""The package's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, htmltext, linededup, packing, quality, sharding, simhash, substrings, topk, toxicity


def queries() -> dict:
    return {
        "op1_html": htmltext.op1_html,
        "op2_simhash": simhash.op2_simhash,
        "op3_topk": topk.op3_topk,
        "op4_suffix": substrings.op4_suffix,
        "op5_quality": quality.op5_quality,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_packing": packing.op7_packing,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.OP3_SQL, "op6_decontaminate": decontaminate.OP6_SQL}
