"""The subpackage's queries and their SQL."""

from lexweave.llm import byte_bpe, decontaminate, exact_dedup, kneser_ney, license_scan, line_dedup, minhash_dedup, prefix_trie, quality, ranked_search, toxicity, url_filter, warc_archive

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality": quality.op2_quality,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_warc_archive": warc_archive.op12_warc_archive,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_warc_archive": warc_archive.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
