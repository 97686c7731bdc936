"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, licenses, media, oracles, packing, quality, repeats, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op4_audio_features": media.op4_audio_features,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_hypergeometric_sharding": sharding.op6_hypergeometric_sharding,
    "op7_warc_records": warc.op7_warc_records,
    "op8_toxicity_chain": toxicity.op8_toxicity_chain,
    "op9_golay_simhash": simhash.op9_golay_simhash,
    "op10_harmonic_packing": packing.op10_harmonic_packing,
}
ORACLES: dict[str, str] = {
    "op1_license_scans": oracles.LICENSES,
    "op3_suffix_array_dedup": oracles.REPEATS,
    "op5_benchmark_decontamination": oracles.CONTAMINATION,
    "op7_warc_records": oracles.WARC,
    "op9_golay_simhash": oracles.SIMHASH,
}
