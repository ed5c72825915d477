"""Word lists, patterns and formats that must equal the published ones for
results to agree. Plain data only; the functions that use them live in talkloom.functions."""

# --- fixed values: enumerations -------------------------------------------------------------
STAGE_STATES = ["pending", "running", "completed", "failed", "skipped"]
JOB_STATES = ["pending", "running", "stopped", "completed", "failed"]
CONFIDENCE_LEVELS = ["low", "medium", "high"]
PRESENTER_RELEVANCES = ["none", "background", "brief", "primary_example"]
SPEAKER_ROLES = ["host", "offscreen_questioner", "unknown"]
CLAIM_TYPES = ["rule", "recommendation", "warning", "definition", "example", "exception"]
HOST = "host"
QUESTIONER = "offscreen_questioner"

# --- fixed values: sentence and clause punctuation, continuation words ----------------------
SENTENCE_END_CHARS = [".", "!", "?", "…"]
CLAUSE_END_CHARS = [";", ":"]
NON_TERMINAL_END_CHARS = [",", ";", ":"]
TRAILING_WRAPPER_CHARS = ['"', "'", "»", "”", ")", "]", "}"]
CONTINUATION_WORDS = [
    "а", "но", "и", "или", "либо", "потому", "поэтому", "соответственно", "также", "то", "пожалуйста",
]

# --- fixed values: labels of speakers in dialogue text --------------------------------------
HOST_LABEL = "Ведущий"
QUESTIONER_LABEL = "Закадровый вопрос"
UNKNOWN_VOICE_LABEL = "Голос"

# --- fixed values: wording of merged plan items ---------------------------------------------
MERGED_BOUNDARY_REASON = "Склейка вопрос-ответ через границу окна планировщика."
MERGED_BOUNDARY_NOTE = "Исходные причины границ: "
MERGED_NOTE = (
    "Склеено детерминированно: закадровый вопрос и ближайший ответ ведущего пересекли границу окна планировщика."
)
QA_SPLIT_NOTE = "QA split preserved because merging the question and answer chunks would exceed limits: "

# --- fixed values: technical labels and presentation noise in visual text --------------------
TECHNICAL_PATTERNS = [
    r"\bобразовательн\w*\s+формат\w*",
    r"\bформат\w*\s+(?:видео|контент\w*|подач\w*)",
    r"\bвизуальн\w*\s+подач\w*",
    r"\bподач\w*\s+на\s+экран\w*",
    r"\b(?:крупн\w*|средн\w*|общ\w*)\s+план\w*\b",
    r"\b(?:ракурс\w*|кадр\w*|камер\w*|съемк\w*|съёмк\w*|монтаж\w*)\b",
    r"\b(?:заставк\w*|оверле\w*|overlay|overlays|on\s+screen|screen)\b",
    r"\b(?:экран\w*|текстов\w*\s+вставк\w*|надпис\w*|слайд\w*|slide|slides)\b",
    r"\b(?:visual\s+aids?|instructional\s+aids?|presentation|presentational|formal\s+presentation)\b",
    r"\b(?:фон\w*|background|интерьер\w*|книжн\w*\s+полк\w*|полк\w*|стол\w*|камин\w*)\b",
    r"\b(?:микрофон\w*|петличк\w*|lapel\s+mic|microphone)\b",
]
PRESENTATION_PATTERNS = [
    r"\b(?:появлен\w*|появил\w*|появля\w*)\b",
    r"\b(?:справа|слева|сверху|снизу)\b",
    r"\b(?:прав\w+|лев\w+|верхн\w+|нижн\w+)\s+(?:сторон\w+|част\w+|угл\w+)\b",
    r"\b(?:дополнительн\w+|альтернативн\w+)\s+образ\w*\b",
    r"\bдемонстрируем\w*\s+как\s+отдельн\w+\s+элемент\w*\b",
    r"\b(?:в\s+кадр\w*|на\s+кадр\w*)\b",
    r"\b(?:леж\w*|расположен\w*|размещен\w*|размещён\w*)\s+(?:справа|слева|сверху|снизу)\b",
]
BARE_COLOURS = [
    "белый", "белая", "белое", "белые",
    "черный", "черная", "черное", "черные",
    "чёрный", "чёрная", "чёрное", "чёрные",
    "серый", "серая", "серое", "серые",
    "зеленый", "зеленая", "зеленое", "зеленые",
    "зелёный", "зелёная", "зелёное", "зелёные",
    "синий", "синяя", "синее", "синие",
    "красный", "красная", "красное", "красные",
    "коричневый", "коричневая", "коричневое", "коричневые",
    "бежевый", "бежевая", "бежевое", "бежевые",
    "оранжевый", "оранжевая", "оранжевое", "оранжевые",
    "желтый", "желтая", "желтое", "желтые",
    "жёлтый", "жёлтая", "жёлтое", "жёлтые",
    "white", "black", "gray", "grey", "green", "red", "blue", "brown", "beige", "orange", "yellow", "mustard",
]
GENERIC_BASELINE_MARKERS = [
    "образ", "общий вид", "деловой стиль", "формальный стиль", "классический стиль", "формальный деловой стиль",
]
GENERIC_BASELINE_PREFIX = "общий вид "
BASELINE_PHRASE_MIN_CHARS = 14
BASELINE_PHRASE_MIN_WORDS = 2

# --- fixed values: claim validation ----------------------------------------------------------
SERVICE_SUBJECTS = [
    "chunk id", "chunk_id", "event id", "event_id", "grounding", "grounding ids", "grounding_ids", "metadata",
    "provenance", "source", "source ref", "source refs", "sources", "timeline event ids", "timeline_event_ids",
]
SERVICE_TOPICS = [
    "event_id", "grounding", "metadata", "provenance", "source", "source_ref", "source_refs", "sources",
    "timeline", "timeline_event_ids",
]
TECHNICAL_CLAIM_MARKERS = [
    "chunk_id", "event_id", "timeline_event_ids", "source_ref", "source_refs", "timestamp_url", "video_id", "raw",
    "grounding", "provenance", "metadata", "schema", "fingerprint",
]
TECHNICAL_CLAIM_PHRASES = ["источник и временной диапазон", "связанные события таймлайна"]
EVIDENCE_PREFIX_PATTERN = (
    r"^\s*(?:(?:в\s+)?chunk|on[- ]screen|в\s+видео|в\s+кадре|ведущий|визуально)"
    r"\s*(?:[:：-]|\s+говорится\s*,?\s*(?:что\s*)?|\s+)?"
)
EVIDENCE_SAYS_PATTERN = r"^\s*говорится\s*,?\s*(?:что\s*)?"
HOMOGLYPH_LATIN = "AaEeOoPpCcXxYyKkMm"
HOMOGLYPH_CYRILLIC = "АаЕеОоРрСсХхУуКкМм"
DOMAIN_TERMS = [("слагсы", "слаксы"), ("серсакер", "seersucker"), ("тенсил", "тенсел")]
SOCK_TERM_STEM = "слитк"
SOCK_TERM_ENDINGS = "(?:и|ов|ам|ами|ах|а)?"
SOCK_TERM_REPLACEMENT = "следки"
SOCK_CONTEXT_PATTERN = r"\b(?:невидим\w*|носк\w*|носоч\w*|следк\w*|no\s*show|лоу\s*кат|лоукат)\b"
CLAIM_LIST_FIELDS = ["conditions", "applies_to", "avoid", "prefer", "evidence", "topics"]
CLAIM_TEXT_FIELDS = ["subject", "claim", "rationale"]
CLAIM_EDITABLE_FIELDS = [
    "claim_type", "subject", "claim", "rationale", "conditions", "applies_to", "avoid", "prefer", "evidence",
    "topics", "confidence",
]

# --- fixed values: redaction -----------------------------------------------------------------
REDACTED = "[redacted]"
SENSITIVE_KEYS = [
    "api_key", "apikey", "authorization", "cookie", "secret", "token", "access_token", "refresh_token",
    "bearer_token", "auth_token",
]
SENSITIVE_KEY_PARTS = ["api_key", "authorization", "cookie", "secret"]
SAFE_KEY_SUFFIXES = ["_present", "_fingerprint"]
SENSITIVE_TEXT_PATTERNS = [
    r"\b(authorization\s*[:=]\s*)(bearer\s+)?[^\s,;]+",
    r"\b((?:set-)?cookie\s*:\s*)[^\r\n]+",
    r"\b((?:api[_-]?key|token|secret|access[_-]?token|refresh[_-]?token|auth[_-]?token)\s*[:=]\s*)['\"]?[^'\"\s,;]+",
]
SECRET_KEY_PATTERNS = [r"\bsk-[A-Za-z0-9_-]{16,}\b", r"\bsk-proj-[A-Za-z0-9_-]{16,}\b"]

# --- fixed values: event log -----------------------------------------------------------------
MONITORED_EVENTS = [
    "stage_failed", "job_failed", "run_failed", "provider_request_failed", "stage_validation_failed", "warning",
    "subprocess_failed",
]
STAGE_NAMES = [
    "01_metadata", "02_download_audio", "03_download_video_proxy", "04_soniox_upload_audio",
    "05_soniox_create_transcription", "06_soniox_fetch_transcript", "07_build_speech_segments", "08_detect_scenes",
    "09_extract_keyframes", "10_describe_visuals", "11_merge_timeline", "12_build_chunks",
    "13_extract_style_claims", "14_export_jsonl", "15_export_obsidian", "16_quality_report", "17_cleanup",
]
VISUAL_STAGES = ["03_download_video_proxy", "08_detect_scenes", "09_extract_keyframes", "10_describe_visuals"]
FINAL_OUTPUT_KEYS = ["timeline_events", "chunks", "style_claims", "quality_report", "cleanup_report", "obsidian_index"]
ARTIFACT_KEYS = [
    "video_info", "speaker_diarization", "speech_segments", "scenes", "frame_refs", "frame_extraction_report",
    "visual_events", "presenter_profile", "timeline_events", "chunks", "chunk_plan", "chunk_plan_warnings",
    "style_claims", "style_claims_current", "style_claims_selected", "style_claims_manual_edits",
    "style_claims_errors", "quality_report", "partial_quality_report", "failure_report", "cleanup_report",
    "human_review", "pipeline_events", "pipeline_log", "obsidian_index",
]
EXPORT_TABLES = [
    "video_info", "speaker_diarization", "speech_tokens", "speech_segments", "scenes", "frame_refs",
    "visual_events", "timeline_events", "chunks", "chunk_plan", "style_claims",
]
VISUAL_EXPORT_TABLES = ["scenes", "frame_refs", "visual_events"]
KNOWLEDGE_EXPORT_TABLES = ["chunks", "style_claims"]
