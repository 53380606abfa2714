"""Column layouts of the tables the engine reads and writes."""

from __future__ import annotations

LOCATOR = (
    "struct<source_type:string,section_path:string,char_start:int,char_end:int,quote:string,"
    "annex_id:string,table_id:int,row_idx:int,col_indices:array<int>,linearized_sentence:string>"
)

FACT_FIELDS = (
    "fact_id string, doc_id string, annotator string, guideline_version string, "
    "subject string, predicate string, object string, condition string, "
    "temporal_context string, group_id string, logic_group string, logic_op string, "
    f"natural_language string, source_locator {LOCATOR}, conflict_label string, "
    "extra struct<anchor_score:double,model_quote:string,triple_index:int>"
)
FACT_STRUCT = "struct<" + ", ".join(
    f"{f.split(' ', 1)[0]}:{f.split(' ', 1)[1]}" for f in [
        "fact_id string", "doc_id string", "annotator string", "guideline_version string",
        "subject string", "predicate string", "object string", "condition string",
        "temporal_context string", "group_id string", "logic_group string", "logic_op string",
        "natural_language string", f"source_locator {LOCATOR}", "conflict_label string",
        "extra struct<anchor_score:double,model_quote:string,triple_index:int>"]) + ">"

FACT_FILE = (
    "doc_id string, annotator string, guideline_version string, fact_count int, "
    f"facts array<{FACT_STRUCT}>"
)

TABLE_STRUCT = ("struct<annex_id:string,table_id:int,headers:array<string>,"
                "rows:array<array<string>>>")
DOCUMENT_STRUCT = (
    "struct<celex:string,title:string,citations:array<string>,"
    "recitals:array<struct<number:string,text:string,char_start:int,char_end:int>>,"
    "articles:array<struct<number:string,title:string,paragraphs:array<string>,"
    "char_start:int,char_end:int>>,"
    f"annexes:array<struct<annex_id:string,title:string,prose:string,tables:array<{TABLE_STRUCT}>>>,"
    "concluding_formulas:string,preamble_text:string,enacting_text:string>"
)

PAIR = (
    "guideline_version string, doc_id string, annotator_a string, annotator_b string, "
    "fact_a_id string, fact_b_id string, cosine double, status string, conflict_label string, "
    "layer1_reason string, layer2_reason string"
)

REVIEW = (
    "doc_id string, pair_key string, rules array<string>, note string, resolution string, "
    "label_at_review string, annotators array<string>, ts timestamp, deleted boolean"
)
VERIFICATION = "doc_id string, fact_id string, status string, note string, ts timestamp"
RUN = ("model string, doc_id string, status string, fact_count int, duration_s double, "
       "error string, started_at timestamp")
