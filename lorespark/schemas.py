"""Tables of the archive, as DDL, and how they lie on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "dialogs": "peer_id bigint, name string, kind string, useless boolean, total_msgs int, own_msgs int, own_share float, voice_total int, voice_own int, years array<int>, meta string",
    "messages": "id bigint, peer_id bigint, vk_msg_id bigint, sent_at timestamp, sender string, is_own boolean, text string, fwd_json string, page_file string",
    "attachments": "id bigint, message_id bigint, att_type string, kind string, url string, local_path string, download_ok boolean",
    "prompt_batches": "key string, peer_id bigint, batch_date string, context string, prompt string, prompt_source string, new_terms array<string>, created_at timestamp",
    "voice_transcripts": "attachment_id bigint, message_id bigint, duration_s float, transcript string, empty_audio boolean, whisper_prompt string, batch_key string, whisper_model string, wall_s float, settings string, max_repeat int, suspect boolean, boilerplate boolean, created_at timestamp",
    "photo_analysis": "attachment_id bigint, message_id bigint, status string, error string, url string, url_size string, bytes int, sha256 string, content_type string, headers string, width int, height int, ocr_text string, ocr_conf float, ocr_level string, labels string, n_faces smallint, kept_file boolean, analyzed_at timestamp",
    "vocab_terms": "peer_id bigint, term string, gloss string, source string, first_batch string, first_date string",
    "dialog_periods": "peer_id bigint, year_from int, description string, whisper_prompt string",
    "analyses": "id bigint, kind string, span struct<start: date, end: date>, content string, model string, meta string",
    "chunks": "id bigint, peer_id bigint, msg_from bigint, msg_to bigint, part smallint, ts_from timestamp, ts_to timestamp, n_messages int, text string, embedding array<float>, emb_model string, meta string, source string",
}

#: Unique keys, and values a column may take.
KEYS = {"dialogs": ["peer_id"], "messages": ["peer_id", "vk_msg_id"], "attachments": ["id"], "voice_transcripts": ["attachment_id"], "photo_analysis": ["attachment_id"],
        "vocab_terms": ["peer_id", "term"], "dialog_periods": ["peer_id", "year_from"], "chunks": ["peer_id", "msg_from", "msg_to", "part", "source"]}
ALLOWED = {("dialogs", "kind"): ("user", "chat", "community"), ("chunks", "source"): ("messages", "photo"), ("vocab_terms", "source"): ("manual", "sonnet")}

#: Columns that a table's folders are named after, and the column its files are hashed by: tables that are joined by message
#: share their buckets, so these joins need no shuffle; chunks of one source are replaced without touching the other.
PARTITIONED = {"chunks": "source"}
BUCKETED = {"messages": "id", "attachments": "message_id", "voice_transcripts": "message_id", "photo_analysis": "message_id", "chunks": "peer_id"}


def create_tables(spark: SparkSession, location: str, buckets: int, database: str = "default") -> None:
    """All tables, empty, under a folder.  ``buckets``: so many that one bucket of the messages fits a task, and the same for all."""
    for name, ddl in SCHEMAS.items():
        layout = f"PARTITIONED BY ({PARTITIONED[name]}) " if name in PARTITIONED else ""
        layout += f"CLUSTERED BY ({BUCKETED[name]}) SORTED BY ({BUCKETED[name]}) INTO {buckets} BUCKETS " if name in BUCKETED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet {layout}LOCATION '{location}/{name}'")


def fill(spark: SparkSession, name: str, df: DataFrame, database: str = "default") -> None:
    """Append rows to a table by column name."""
    df.select(*spark.table(f"{database}.{name}").columns).write.insertInto(f"{database}.{name}")
