"""Fixed schemas of the catalog's tables; missing columns are added with their type, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FEATURES = "peak double, rms double, crest_factor double, silence_ratio double, zero_crossing_rate double, spectral_centroid double, spectral_bandwidth double, spectral_rolloff double, spectral_flatness double"

# Columns of each table, as DDL.
DDL = {
    "files": "id long, path string, filename string, stem string, extension string, size_bytes long, mtime double, md5 string, sample_rate int, bit_depth int, channels int, "
    "duration_s double, subtype string, has_bext int, has_ixml int, has_riff_info int, has_adm int, has_cue_markers int, has_sampler int, metadata_sources string, is_ucs int, "
    "scan_error string, hash_scanned_at timestamp_ntz, audio_scanned_at timestamp_ntz, metadata_scanned_at timestamp_ntz, scanned_at timestamp_ntz",
    "fn_issues": "id long, file_id long, component string, issue string, detail string",
    "scan_meta": "key string, value string",
    "analysis_runs": "id long, backend string, backend_version string, parameters_json string, parameters_hash string, segment_method string, root string, status string, "
    "max_duration_s double, total_files int, analyzed int, skipped int, errors int, started_at timestamp_ntz, finished_at timestamp_ntz",
    "audio_descriptors": f"file_id long, backend string, backend_version string, parameters_hash string, path string, size_bytes long, mtime double, md5 string, max_duration_s double, analyzed_duration_s double, "
    f"{_FEATURES}, clipping_count int, transient_density double, segment_count int, segment_method string, duration_bucket string, generated_at timestamp_ntz, error string",
    "audio_segments": f"id long, file_id long, segment_index int, start_s double, end_s double, duration_s double, {_FEATURES}, confidence double, method string",
    "audio_embeddings": "id long, file_id long, segment_id long, backend string, model_version string, parameters_hash string, dimensions int, vector_ref string",
    "similarity_feedback": "backend string, scope string, left_file_id long, left_segment_index int, right_file_id long, right_segment_index int, state string, note string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "accepted_tags": "id long, file_id long, field string, value string, source string, method string, confidence double, evidence string, plan_entry_id long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "metadata_fields": "file_id long, namespace string, key string, value string, source string, updated_at timestamp_ntz",
    "tag_apply_log": "plan_path string, db_path string, dry_run boolean, generated_at timestamp_ntz, result_json string",
    "artifacts": "id long, path string, kind string, feature string, category string, created_at timestamp_ntz, mtime double, size long, summary_json string, entry_count long, error_count long, status string",
    "jobs": "id long, action string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, progress string, output_artifact_id long, error string",
    "artifact_rows": "artifact_id long, row_index long, row_type string, action string, source string, target string, status string, detail string, search_text string",
    "ucs_entries": "cat_id string, cat_short string, category string, subcategory string, explanations string, synonyms array<string>",
}
PLAN_ENTRY = "struct<entry_id:bigint,path:string,field:string,value:string,source:string,status:string,action:string,confidence:double>"


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns: cast, missing ones NULL, extra ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
