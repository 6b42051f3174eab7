"""Queries of this subpackage and their SQL."""

from lodestone.llm import chat, decontaminate, licenses, minhash, mixing, negatives, pii, search, secrets, simhash, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_pii": pii.op2_pii,
    "op3_search": search.op3_search,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_mixing": mixing.op6_mixing,
    "op7_secrets": secrets.op7_secrets,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
    "op11_whitening": whitening.op11_whitening,
    "op12_minhash": minhash.op12_minhash,
    "op13_negatives": negatives.op13_negatives,
}

ORACLES = {
    "op1_chat": chat.SQL,
    "op3_search": search.SQL,
    "op5_licenses": licenses.sql(),
    "op6_mixing": mixing.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op12_minhash": minhash.SQL,
    "op13_negatives": negatives.SQL,
}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
