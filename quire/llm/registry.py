"""The queries of this package and their SQL."""

from quire.llm import clusters, collocations, decontaminate, disclosure, jaccard, language, lines, packing, paragraphs, quality, suffixes, tools, vectors

QUERIES = {
    "op1_disclosure": disclosure.op1_disclosure,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_tool_calls": tools.op3_tool_calls,
    "op4_language": language.op4_language,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_metric_join": vectors.op6_metric_join,
    "op7_quality": quality.op7_quality,
    "op8_paragraphs": paragraphs.op8_paragraphs,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_best_fit": packing.op10_best_fit,
    "op11_clusters": clusters.op11_clusters,
    "op12_collocations": collocations.op12_collocations,
    "op13_lines": lines.op13_lines,
}

ORACLE = {**jaccard.SQL, **tools.SQL, **suffixes.SQL, **vectors.SQL, **decontaminate.SQL, **clusters.SQL, **collocations.SQL, **lines.SQL}
