"""The queries of the numbered operators, and their SQL where there is one."""

from annolake.llm import centroids, chat_format, decontaminate, embedding_dedup, language_id, line_dedup, minhash, mixing, secrets, sharding, url_filter, vector_codes, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_warc": warc.op2_warc,
    "op3_minhash_dedup": minhash.op3_minhash_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_secrets": secrets.op7_secrets,
    "op8_language_id": language_id.op8_language_id,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_sharding": sharding.op12_sharding,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_warc": warc.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
