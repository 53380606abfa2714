"""Facts for tests; a module of its own, as two folders have a conftest."""

FACT_COLUMNS = ("guideline_version doc_id annotator fact_id fact_pos subject predicate object natural_language condition "
                "temporal_context group_id logic_group logic_op conflict_label").split()


def fact(annotator, fact_id, s, p, o, nl=None, doc="d1", version="v1", pos=None, **extra):
    row = dict(guideline_version=version, doc_id=doc, annotator=annotator, fact_id=fact_id, fact_pos=pos if pos is not None else int("".join(ch for ch in fact_id if ch.isdigit()) or 0),
               subject=s, predicate=p, object=o, natural_language=nl if nl is not None else f"{s} {p} {o}.", condition="", temporal_context="",
               group_id="", logic_group="", logic_op="", conflict_label="unlabeled")
    span = extra.pop("span", (0, 10))
    section = extra.pop("section", "preamble.recitals[0]")
    row.update(extra)
    row["source_locator"] = dict(source_type="prose", section_path=section, char_start=span[0], char_end=span[1], quote=extra.get("quote", row["natural_language"]),
                                 annex_id=None, table_id=None, row_idx=None, col_indices=None, linearized_sentence=None)
    row.pop("quote", None)
    return row


FACT_DDL = ", ".join(f"{c} {'int' if c == 'fact_pos' else 'string'}" for c in FACT_COLUMNS) + (
    ", source_locator struct<source_type:string,section_path:string,char_start:int,char_end:int,quote:string,annex_id:string,"
    "table_id:int,row_idx:int,col_indices:array<int>,linearized_sentence:string>")
