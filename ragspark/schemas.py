"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_DDL: dict[str, str] = {}

DETECTIONS = "array<struct<entity_type:string,count:bigint>>"

# Raw document tree: block -> sourcebook -> chapter -> section.
_DDL["HANDBOOK_TREE"] = (
    "parts array<struct<entityId:string,parts:array<struct<entityId:string,parts:array<struct<entityId:string>>>>>>"
)
_DDL["RAW_PROVISIONS"] = (
    "chapter string, section string, provisionName string, entityId string, sectionName string, "
    "provisionType string, contentText string, contentType string, timeline string, ord bigint"
)
_DDL["PROVISIONS"] = (
    "provision_id string, entity_id string, module string, chapter string, section string, section_name string, "
    "provision_type string, text string, html string, cross_references array<string>, last_modified string, ord bigint"
)
_DDL["SCENARIOS"] = (
    "scenario_id string, complaint_type string, response_stage string, scenario_text string, "
    "expected_provisions array<string>, expected_provision_sections array<string>, "
    "required_response_elements array<string>, difficulty string, synthetic boolean"
)
_DDL["QA_PAIRS"] = (
    "question_id string, question string, answer string, source_sections array<string>, difficulty string, "
    "type string, difficulty_original string"
)
RUBRIC_BLOCK = (
    "struct<label:string,audience:string,definition:string,present_if:string,partial_if:string,missing_if:string,"
    "not_satisfied_by:string,regulatory_basis:string>"
)
_DDL["RUBRIC_FILE"] = (f"elements map<string,{RUBRIC_BLOCK}>")
_DDL["PII_CASES_FILE"] = (
    "cases array<struct<case_id:string,source:string,text:string,"
    "entities:array<struct<text:string,type:string,is_pii:boolean>>>>"
)
_DDL["AUDIT"] = (
    f"timestamp string, session_id string, input_hash string, input_detections {DETECTIONS}, "
    f"output_detections {DETECTIONS}, output string, model_id string, cited_provisions array<string>, "
    "retrieved_chunk_ids array<string>, human_review_required boolean, human_review_reason string, "
    "insufficient_context boolean, latency_ms double, retrieval_latency_ms double, generation_latency_ms double, "
    "input_tokens bigint, output_tokens bigint, total_tokens bigint"
)
_DDL["SCENARIO_METRICS"] = (
    "scenario_id string, config_label string, coverage double, present_count bigint, n_required bigint, "
    "section_precision double, section_recall double, citation_precision double, citation_recall double, "
    "retrieved_provision_recall double, drafting_gap double, grounded_pct double, grounded_pct_customer double, "
    "grounded_pct_handler double, ungrounded_pct double, inter_judge_agreement double, latency_ms double, "
    "total_cost double"
)


def __getattr__(name: str) -> T.StructType:
    """Schemas are parsed on use, because parsing needs a session."""
    if name in _DDL:
        return T.StructType.fromDDL(_DDL[name])
    raise AttributeError(name)
