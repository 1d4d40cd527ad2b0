"""Schemas of the canonical tables; reads outside tests declare these and infer nothing."""

from __future__ import annotations

ENTITIES = "id string, entity_text string, entity_type string, properties map<string,string>, confidence double, is_verified boolean, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz, source_document_id string, embedding array<float>"
RELATIONSHIPS = "id string, source_entity_id string, target_entity_id string, relationship_type string, properties map<string,string>, confidence double, is_verified boolean, is_active boolean, created_at timestamp_ntz"
CONFLICTS = "id string, entity_id string, conflicting_entity_id string, conflict_type string, severity string, similarity_score double, status string, assigned_to string, created_at timestamp_ntz, resolved_at timestamp_ntz"
ONTOLOGY_CLASSES = "id string, uri string, label string, description string, domain string, parent_class_id string, is_custom boolean"
ONTOLOGY_PROPERTIES = "id string, uri string, label string, description string, property_type string, domain_class_id string, range_class_id string"
MAPPINGS = "id string, entity_type string, class_uri string, confidence double, is_verified boolean, mapping_status string, auto_mapped boolean"
DOMAINS = "id int, name string, display_name string, description string"
TYPES = "id int, name string, display_name string, description string, is_active boolean"
RULES = "rule_id string, entity_types array<string>, field string, operator string, value string, severity string"
PIPELINE_STEPS = "step_id string, run_order int, inputs string, enabled boolean, step_type string"
CHUNKS = "doc_id long, chunk_index int, chunk string"
EXTRACTIONS = "doc_id long, chunk_index int, entity_text string, entity_type string, start_position int, end_position int, confidence double"
