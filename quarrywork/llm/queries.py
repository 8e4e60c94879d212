"""The registered queries of this subpackage and their SQL."""

from . import clustering, language, media, mixing, near_dup, neighbours, packing, part_enum, pii, prefix_trie, quality, toxicity, urls

QUERIES = {
    "op1_media": media.op1_media,
    "op2_personal_data": pii.op2_personal_data,
    "op3_mix": mixing.op3_mix,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_url_filter": urls.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pack": packing.op7_pack,
    "op8_language": language.op8_language,
    "op9_quality": quality.op9_quality,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_centroids": clustering.op11_centroids,
    "op12_jaccard_join": part_enum.op12_jaccard_join,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {"op3_mix": mixing.SQL, "op4_near_dup": near_dup.SQL, "op5_url_filter": urls.SQL, "op11_centroids": clustering.SQL, "op12_jaccard_join": part_enum.SQL, "op13_prefix_trie": prefix_trie.SQL}
