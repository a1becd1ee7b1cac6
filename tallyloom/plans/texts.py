"""Labels and messages of the report. Codes identify; the wording is ours."""

from __future__ import annotations

# Display names of the harnesses, by id.
DISPLAY_NAMES = {
    "claude": "Claude Code", "codex": "Codex", "hermes": "Hermes Agent", "cursor": "Cursor",
    "copilot": "GitHub Copilot", "grok": "Grok", "antigravity": "Antigravity", "gemini": "Gemini CLI",
    "continue": "Continue", "cline": "Cline", "roo": "Roo Code", "aider": "Aider",
}

METHODOLOGY = (
    "Sessions are top-level records; child runs are counted apart.",
    "A day or hour belongs to the session's start or creation, in the configured time zone.",
    "Prompt sizes are words and code points; text is never stored.",
    "Tool calls, model turns and tokens stay per harness and are never added across harnesses.",
    "Coverage speaks of surviving histories, not of an account's lifetime.",
)

LIMITATIONS = {
    "claude": ("History rows of a session with detail are suppressed, which can hide older prompts.",
               "Child transcripts and desktop transcripts add no usage.",
               "A model event is one distinct response."),
    "codex": ("History rows of a session with a rollout are suppressed, which can hide older prompts.",
              "A model event is one turn context; token totals belong to the session, not to a model.",
              "Remote catalog rows are context only."),
    "hermes": ("Tool calls are the stored counter of the active transcript, not a lifetime total.",
               "Compaction copies of a prompt count once; rows live at the same time are never merged."),
    "cursor": ("Token totals and tool calls are not recorded in this schema.",
               "A model event is a human bubble with a recorded model."),
    "copilot": ("Models, tokens and tool calls are not recorded in this schema.",),
    "grok": ("Only prompts are recorded; replies, models and tokens are not.",
             "The span of a session is that of its prompts."),
    "antigravity": ("Without a step transcript only the last-modified time is known.",
                    "Prompt sizes come from the search index."),
    "gemini": ("Hash-named folders carry no project.", "Only recorded replies count towards tools and tokens."),
    "continue": ("Messages have no times; a session sits at its creation time.",
                 "The model is the configured title."),
    "cline": ("A task belongs to a model only when its metadata names exactly one.",),
    "roo": ("No model identity is recorded.",),
    "aider": ("Only prompts and session starts are recorded, without a time zone.",),
}

WARNING_MESSAGES = {
    "account_workspace_catalogs": "Catalog hosts of remote accounts were seen.",
    "aggregate_history_predates_detail": "The statistics cache reports activity before any surviving detail.",
    "ambiguous_history_chain_suppressed": "Rollouts of one id do not form a valid chain; one was kept.",
    "assistant_response_missing_id": "Responses without an id cannot be merged.",
    "assistant_update_model_conflict": "Updates of one response changed its model; the last one was kept.",
    "assistant_update_usage_conflict": "Updates of one response changed fixed usage fields; the last one was kept.",
    "assistant_updates_merged": "Repeated updates were merged by response id.",
    "assistant_usage_advanced": "Repeated updates raised the usage of a response; the last one was kept.",
    "assistant_usage_completed": "A repeated update added the first usage of a response.",
    "catalog_index_unavailable": "The catalog database could not be read.",
    "code_session_index_reconciled": "Desktop code references with surviving history.",
    "code_session_index_unmaterialized": "Desktop code references without surviving history.",
    "compact_summary_prompts_excluded": "Compaction summaries are not owner prompts.",
    "composer_metadata_unavailable": "Composer metadata could not be read.",
    "conflicting_copied_models": "Copied responses disagree on the model; the first one was kept.",
    "conflicting_usage": "Copied responses disagree on usage; the first one was kept.",
    "copied_history_prompt_records_reconciled": "History prompts that match copied detail were dropped.",
    "copied_prompts": "Copied prompts were counted once.",
    "copied_responses": "Copied responses were counted once; their tools were united.",
    "copied_session_files_coalesced": "Files of one logical session were combined.",
    "copied_session_model_conflict": "Copies of a session disagree on a model; the first one was kept.",
    "copied_session_prompt_records": "Prompts repeated in copies of a session were counted once.",
    "copied_session_response_records": "Responses repeated in copies of a session were combined.",
    "copied_session_usage_conflict": "Copies of a session disagree on usage; one record was kept.",
    "desktop_local_agent_sessions_excluded": "Desktop transcripts are listed but not counted.",
    "desktop_session_references_unmapped": "Desktop references of another identity space.",
    "discovery_failed": "The location of this history could not be inspected.",
    "duplicate_prompt_event": "Repeated prompt events were counted once.",
    "duplicate_stitched_prompt": "A prompt repeated across segments was counted once.",
    "duplicate_task_id": "A task id occurs under several roots; the first one was kept.",
    "duplicate_tool_call": "Repeated tool calls were counted once.",
    "duplicate_tool_use": "Repeated tool uses were counted once.",
    "duplicate_turn_context": "Repeated turn contexts were counted once.",
    "existing_state_rollouts_not_discovered": "Rollouts named by the state exist but were not read.",
    "external_import_source_references": "Source paths of imports, never opened.",
    "global_state_only_sessions": "Session ids known only from the global state.",
    "history_chain_inspection_failed": "The head of a rollout could not be read.",
    "history_only_sessions": "Sessions known only from the prompt history.",
    "history_records_reconciled": "History prompts of sessions with surviving detail were dropped.",
    "identical_rollout_copy_suppressed": "Identical rollout copies were counted once.",
    "index_only_sessions": "Sessions known only from the session index.",
    "invalid_record_timestamp": "Prompts or responses without a valid time.",
    "invalid_timestamp": "Records without a valid time.",
    "local_catalog_only_sessions": "Sessions known only from the local catalog.",
    "malformed_api_request_record": "A request record without readable counts was skipped.",
    "malformed_bubble": "Malformed messages were skipped.",
    "malformed_bubble_key": "Messages with an invalid key were skipped.",
    "malformed_code_session_index": "A desktop code index was not readable.",
    "malformed_composer": "Malformed composer metadata was skipped.",
    "malformed_external_imports": "The import index was not readable.",
    "malformed_global_state": "A global state file was not readable.",
    "malformed_history_record": "Malformed history rows were skipped.",
    "malformed_project_session_index": "A project index holds unusable entries.",
    "malformed_prompt_index": "A prompt index entry was malformed.",
    "malformed_prompt_record": "A malformed prompt row was skipped.",
    "malformed_record": "Malformed records were skipped.",
    "malformed_session": "A malformed session file was skipped.",
    "malformed_session_index_record": "Malformed index rows were skipped.",
    "malformed_stats_cache": "The statistics cache was not readable.",
    "malformed_task": "A malformed task was skipped.",
    "malformed_transcript_line": "A malformed transcript row was skipped.",
    "meta_prompts_excluded": "Metadata records are not owner prompts.",
    "mismatched_bubble_id": "Messages with two ids were skipped.",
    "mismatched_composer_id": "Composer records with two ids were skipped.",
    "missing_bubble_body": "Message headers without a stored body.",
    "missing_creation_time": "A session without a creation time in the index.",
    "missing_history_base": "A continuation whose base was not found.",
    "missing_or_invalid_session_meta": "A rollout without identity and time was left out.",
    "missing_session_id": "A prompt row without a session id was skipped.",
    "missing_state_rollout_paths": "Rollouts named by the state do not exist.",
    "model_usage_unavailable": "Usage per model could not be read.",
    "oversize_code_session_index": "A desktop code index was too large.",
    "oversize_external_imports": "The import index was too large.",
    "oversize_global_state": "A global state file was too large.",
    "oversize_history_line": "An oversize line was skipped.",
    "oversize_history_record": "Oversize history rows were skipped.",
    "oversize_index_chunk": "An oversize index chunk was skipped.",
    "oversize_project_session_index": "A project index was too large.",
    "oversize_prompt_record": "An oversize prompt row was skipped.",
    "oversize_record": "Oversize records were skipped.",
    "oversize_session": "An oversize session file was skipped.",
    "oversize_session_index_record": "Oversize index rows were skipped.",
    "oversize_stats_cache": "The statistics cache was too large.",
    "oversize_task": "An oversize task was skipped.",
    "oversize_transcript_line": "An oversize transcript row was skipped.",
    "owner_prompt_missing_id": "Prompts without an id cannot be matched across copies.",
    "owner_prompt_records_excluded": "User records that are not owner prompts; the detailed counts overlap.",
    "physical_session_time_unavailable": "A session whose own records carry no valid time.",
    "project_index_only_sessions": "Session ids known only from a project index.",
    "prompt_identity_unavailable": "Without activity flags copies of a prompt cannot be told apart.",
    "prompt_metrics_unavailable": "Prompts could not be read.",
    "prompt_text_slices_invalid": "Offsets do not fit the indexed text; prompts count without sizes.",
    "remote_catalog_sessions_excluded": "Remote catalog rows are not counted.",
    "sessions_index_unreadable": "The session index could not be read.",
    "source_tool_prompts_excluded": "Tool-made records are not owner prompts.",
    "sqlite_snapshot_failed": "The database snapshot could not be read.",
    "state_index_unavailable": "The state database could not be read.",
    "state_only_sessions": "Sessions known only from the state database.",
    "state_rollouts_outside_configured_roots": "Rollouts named outside the configured roots, never looked up.",
    "stitched_history_segments": "Segments with validated boundaries were joined.",
    "synthetic_model_records_excluded": "Synthetic turns are not a model; their usage still counts.",
    "tool_result_prompts_excluded": "Tool results are not owner prompts.",
    "tool_use_missing_id": "Tool uses without an id are counted one by one.",
    "transcript_only_prompts_excluded": "Transcript-only records are not owner prompts.",
    "unanchored_session": "A transcript without any record of its own session.",
    "unknown_history_mode": "An unknown history mode; its prompts were skipped.",
    "unknown_schema": "The database schema is not recognised.",
    "unmaterialized_import_sessions": "Imported sessions without a rollout.",
    "unparseable_assistant_content": "Response content that could not be read.",
    "unparseable_owner_prompt": "Prompt content that could not be read.",
    "unparsed_thread_history_database": "A thread-history database is listed but not interpreted.",
    "unreadable_file": "A file is damaged or breaks off; none of its lines is counted.",
    "unreadable_session_start": "A session start time could not be read.",
    "unvalidated_same_id_rollout_suppressed": "A further rollout of the same id was left out.",
}
