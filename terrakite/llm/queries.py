"""The queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from terrakite.llm import encode, nearest_time, packing, similar_vectors, stuffed_pages

QUERIES = {
    "p2_found": similar_vectors.p2_found,
    "p2_exact": similar_vectors.p2_exact,
    "p2_recall": similar_vectors.p2_recall,
    "p4_found": nearest_time.p4_found,
    "p6_ids": encode.p6_ids,
    "p6_decoded": encode.p6_decoded,
    "p7_packing": packing.p7_packing,
    "p7_fill": packing.p7_fill,
    "p7_check": packing.p7_check,
    "p8_found": stuffed_pages.p8_found,
}

SQL = {"p2_exact": similar_vectors.EXACT_SQL, "p2_recall": similar_vectors.RECALL_SQL, "p4_found": nearest_time.FOUND_SQL, "p6_decoded": encode.DECODED_SQL, "p7_check": packing.CHECK_SQL}
