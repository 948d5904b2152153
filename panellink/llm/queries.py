"""The queries opN_<name> and their SQL, where SQL can express them."""

from __future__ import annotations

from panellink.llm import decontam, langid, media, mixing, pii, sharding, simhash, substring, toxicity, warc


def queries() -> dict:
    return {
        "op1_mix": mixing.op1_mix,
        "op2_warc": warc.op2_warc,
        "op3_language": langid.op3_language,
        "op4_decontaminate": decontam.op4_decontaminate,
        "op5_simhash": simhash.op5_simhash,
        "op6_pseudonyms": pii.op6_pseudonyms,
        "op7_shard": sharding.op7_shard,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_repeats": substring.op9_repeats,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.ORACLE_SQL, "op2_warc": warc.ORACLE_SQL, "op4_decontaminate": decontam.ORACLE_SQL}
