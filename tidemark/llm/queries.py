"""The registered queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from . import bpe, convtrie, fertility, langid, manifest, media, packing, quotes, secretscan, simhash, tokencount, topk, toxicity


def queries() -> dict:
    return {
        "op1_quotation_linking": quotes.query,
        "llm_mail_threads": quotes.mail_query,
        "op2_digest_cache_counts": tokencount.query,
        "op3_ball_hashing": simhash.query,
        "op4_lexicon_automata": toxicity.query,
        "op5_trie_bpe": bpe.query,
        "op6_cover_tree_topk": topk.query,
        "op7_tar_media": media.query,
        "op8_blob_ledger": secretscan.query,
        "op9_crf_language": langid.query,
        "op10_window_packing": packing.query,
        "op11_merkle_climb": manifest.query,
        "op12_tokeniser_fertility": fertility.query,
        "op13_sequence_trie": convtrie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_linking": quotes.SQL, "op6_cover_tree_topk": topk.SQL, "llm_mail_threads": quotes.MAIL_SQL, "op11_merkle_climb": manifest.SQL, "op13_sequence_trie": convtrie.SQL}
