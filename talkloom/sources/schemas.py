"""Explicit schemas of the stored tables; nothing is ever inferred."""

TABLES = {
    "video_info": "video_id STRING, title STRING, channel STRING, url STRING, duration DOUBLE, description STRING, upload_date STRING",
    "speaker_diarization": "video_id STRING, detected_speakers BIGINT, unassigned_tokens_count BIGINT",
    "speech_tokens": "video_id STRING, token_index BIGINT, text STRING, start_ms BIGINT, end_ms BIGINT, speaker STRING, speaker_role STRING, language STRING",
    "speech_segments": "video_id STRING, seg BIGINT, segment_id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, speaker STRING, speaker_role STRING",
    "scenes": "video_id STRING, scene_index BIGINT, scene_id STRING, start_frame BIGINT, end_frame BIGINT, start_ms BIGINT, end_ms BIGINT",
    "frame_refs": "video_id STRING, scene_id STRING, path STRING, ts_ms BIGINT, frame_role STRING",
    "visual_events": "video_id STRING, scene_id STRING, visual_summary STRING, observations ARRAY<STRING>, items ARRAY<STRING>, style_topics ARRAY<STRING>, notes STRING",
    "timeline_events": "video_id STRING, event_id STRING, start_ms BIGINT, end_ms BIGINT, speech_text STRING, visual_summary STRING, topics ARRAY<STRING>",
    "chunks": "video_id STRING, chunk_id STRING, chunk_title STRING, start_ms BIGINT, end_ms BIGINT, combined_text STRING, topics ARRAY<STRING>",
    "chunk_plan": "video_id STRING, chunk_index BIGINT, speech_segment_ids ARRAY<STRING>, title STRING, boundary_reason STRING, topics ARRAY<STRING>, notes STRING",
    "style_claims": "video_id STRING, claim_pos BIGINT, claim_id STRING, chunk_id STRING, claim_type STRING, subject STRING, claim STRING, rationale STRING, "
    "conditions ARRAY<STRING>, applies_to ARRAY<STRING>, avoid ARRAY<STRING>, prefer ARRAY<STRING>, evidence ARRAY<STRING>, topics ARRAY<STRING>, confidence STRING",
    "pipeline_events": "run_id STRING, seq BIGINT, ts TIMESTAMP, event STRING, job_id STRING, stage STRING, attempt INT, status STRING, request_id STRING, data STRING",
    "jobs": "job_id STRING, video_id STRING, status STRING, current_stage STRING, created_at STRING, started_at STRING, finished_at STRING, error_code STRING",
    "stages": "job_id STRING, stage_name STRING, ordinal INT, status STRING, attempt INT, started_at STRING, finished_at STRING, input_files STRING, output_files STRING, metrics STRING",
}
