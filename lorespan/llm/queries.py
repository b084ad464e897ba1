"""The registered queries of this package and the SQL that checks those SQL can express."""

from __future__ import annotations

from lorespan.llm import caps, decontaminate, langid, lexicon, licenses, lines, merkle, negatives, packing, pfor, simhash, tokencount, warc

QUERIES = {
    "op3_line_dedup": lines.op3_line_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op6_warc_archive": warc.op6_warc_archive,
    "op9_embedding_near_dedup": caps.op9_embedding_near_dedup,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op1_language_id": langid.op1_language_id,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_token_id_blocks": pfor.op5_token_id_blocks,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_bpe_transducer": lexicon.op13_bpe_transducer,
}

SQL: dict[str, str] = {"op6_warc_archive": warc.SQL, "op11_merkle_manifest": merkle.SQL, "op12_hard_negatives": negatives.SQL}
