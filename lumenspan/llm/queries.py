"""The registered queries of this subpackage: name -> (callable, SQL or None)."""

from . import bpe, chat, contamination, divergence, langid, lm, neardup, repair, repeats, topk, toxicity, urls, whitening

QUERIES = {
    "op1_toxicity": (toxicity.op1_toxicity, None),
    "op2_minhash_neardup": (neardup.op2_minhash_neardup, None),
    "op3_exact_topk": (topk.op3_exact_topk, topk.SQL),
    "op4_chat_format": (chat.op4_chat_format, chat.SQL),
    "op5_lm_score": (lm.op5_lm_score, None),
    "op6_decontamination": (contamination.op6_decontamination, contamination.SQL),
    "op7_language_id": (langid.op7_language_id, None),
    "op8_token_shards": (repair.op8_token_shards, None),
    "op9_url_filter": (urls.op9_url_filter, None),
    "op10_byte_bpe": (bpe.op10_byte_bpe, None),
    "op11_whitening": (whitening.op11_whitening, None),
    "op12_suffix_dedup": (repeats.op12_suffix_dedup, None),
    "op13_divergence_audit": (divergence.op13_divergence_audit, divergence.SQL),
}
