"""Schemas of the tables, and their creation and removal in order of their references."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Names and types of the tables' columns; a table comes after those it refers to.
TABLES = {
    "photos": "id string, project_id string, s3_object_key string, filename string, width int, height int, position int, room_type string, metadata string, status int, loaded_at timestamp_ntz",
    "jobs": "id bigint, project_id string, status string, current_phase int, template_type string, target_length double, music_uri string, bpm int, beat_offset double, enable_beat_sync boolean, final_video_uri string, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "room_clusters": "id bigint, job_id bigint, room_type string, confidence_tier string, sfm_eligible boolean, image_count int, overlap_score double, depth_variance double, hero_photo_id bigint, recommended_motion string, allowed_motion_types string, recommended_duration double, loaded_at timestamp_ntz",
    "job_photos": "id bigint, job_id bigint, rails_photo_id string, s3_uri string, filename string, width int, height int, position int, room_label string, room_override string, room_cluster_id bigint, exclude boolean, manual_metadata string, sharpness double, exposure_score double, composition_score double, base_score double, final_score double, depth_variance double, depth_layers int, embedding array<float>, loaded_at timestamp_ntz",
    "clips": "id bigint, job_id bigint, room_cluster_id bigint, source_photo_ids array<bigint>, motion_type string, model_used string, is_3d boolean, duration double, s3_uri string, validation_score double, status string, loaded_at timestamp_ntz",
    "timelines": "id bigint, job_id bigint, version int, status string, beat_grid array<double>, total_duration double, loaded_at timestamp_ntz",
    "timeline_clips": "id bigint, timeline_id bigint, clip_id bigint, order_index int, in_time double, out_time double, transition_type string, audio_policy string, loaded_at timestamp_ntz",
}


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the tables that aren't there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop_tables(spark: SparkSession, database: str) -> None:
    """Drop them, referring tables first."""
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
