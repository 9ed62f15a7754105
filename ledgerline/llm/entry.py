"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from ledgerline.llm import chat, collocations, decontaminate, html_text, lines, mixing, near_duplicates, passages, pii, quality, spelling, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_near_duplicates": near_duplicates.op3_near_duplicates,
        "op4_warc": warc.op4_warc,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_chat": chat.op6_chat,
        "op7_mixing": mixing.op7_mixing,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_passages": passages.op9_passages,
        "op10_pii": pii.op10_pii,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_collocations": collocations.op12_collocations,
        "op13_html_text": html_text.op13_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.OP4_SQL, "op7_mixing": mixing.OP7_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_collocations": collocations.OP12_SQL}
