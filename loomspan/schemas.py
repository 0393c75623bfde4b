"""Schemas of the engine's own tables, and the source labels."""

from __future__ import annotations

# The providers, in their stable order; codex is stored under three labels.
SOURCES = ["claude", "codex", "cursor", "opencode", "pi", "omp", "openclaw", "copilot", "grok", "jcode", "muse", "antigravity", "bob", "hermes"]
CODEX_LABELS = ["codex", "codex_session", "codex_history"]

LINKS = (
    "legacy_turn_id int, source_record_offset bigint, source_turn_id string, assistant_phase string, lifecycle_event string, source_record_type string, source_content string, "
    "tool_result_is_error boolean, event_id string, parent_event_id string, logical_parent_event_id string, parent_session_id string, thread_source string, conversation_kind string, "
    "parent_tool_use_id string, source_tool_use_id string, source_tool_assistant_uuid string"
)
RECORD = f"source string, doc_id bigint, ts bigint, project string, session_id string, source_path string, turn_id int, role string, text string, tool_name string, tool_input string, tool_output string, links struct<{LINKS.replace(' ', ':').replace(',:', ',')}>"
SESSION = (
    "source string, session_id string, source_path string, project string, cwd string, git_root string, git_common_dir string, repo_project string, started_at bigint, last_at bigint, "
    "message_count bigint, resolution_status string, label string, conversation_kind string"
)
USAGE = (
    "source string, source_path string, row_idx bigint, source_order bigint, ordinal bigint, timestamp_ms bigint, session_id string, project string, provider string, model string, "
    "source_record_id string, request_id string, message_id string, raw_input bigint, uncached_input bigint, cache_read bigint, cache_write bigint, cache_write_1h bigint, output bigint, "
    "reasoning bigint, source_cost_usd double, cost_authoritative boolean, conservative_undercount boolean, cache_chain_excluded boolean, sidechain boolean, permission_review boolean"
)


def stored_labels(source: str) -> list[str]:
    """The labels under which a source's rows are stored."""
    return CODEX_LABELS if source == "codex" else [source]
