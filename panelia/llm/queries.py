"""Queries of the thirteen operators, and SQL where SQL can express them."""

from panelia.llm.byte_bpe import op6_byte_bpe
from panelia.llm.centroids import OP12_SQL, op12_centroid_clustering
from panelia.llm.decontamination import op9_decontamination
from panelia.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from panelia.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from panelia.llm.html_extract import op3_html_extract
from panelia.llm.license_scan import OP4_SQL, op4_license_scan
from panelia.llm.secret_scan import op8_secret_scan
from panelia.llm.simhash import op10_simhash
from panelia.llm.substring_dedup import op7_substring_dedup
from panelia.llm.token_counts import op2_token_counts
from panelia.llm.toxicity import op1_toxicity
from panelia.llm.url_filter import op11_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_html_extract": op3_html_extract,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_url_filter": op11_url_filter,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL = {
    "op4_license_scan": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
