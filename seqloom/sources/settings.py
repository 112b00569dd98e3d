"""Readers of JSON settings with defaults, metadata, analysis parameters, and lines of a training manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Section = dict[str, "bool | int | float | str | list[str] | Section"]

# The settings and their defaults.
DEFAULTS: Section = {
    "config_version": "1.0",
    "config_name": "default",
    "world_config": {"frame_period": 5.0, "f0_floor": 71.0, "f0_ceil": 800.0, "allowed_range": 0.1, "q1": -0.15, "threshold": 0.85},
    "scanner_config": {
        "recursive_search": True, "validate_audio_files": True, "validate_timing_parameters": True, "detect_encoding_issues": True,
        "analyze_audio_quality": False, "max_scan_depth": 5, "max_files_per_directory": 1000, "parallel_scanning": True,
        "min_audio_duration_ms": 100.0, "max_audio_duration_ms": 30000.0, "preferred_sample_rate": 44100, "preferred_bit_depth": 16,
        "supported_audio_formats": [".wav", ".flac", ".aiff", ".aif"], "excluded_directories": [".git", ".svn", "_cache", "backup", "temp"],
        "excluded_files": [".DS_Store", "Thumbs.db", "desktop.ini"],
    },
    "audio_config": {
        "target_sample_rate": 44100, "target_bit_depth": 16, "force_mono": True, "normalize_audio": True, "noise_threshold_db": -40.0,
        "silence_threshold_db": -30.0, "max_duration_seconds": 30.0, "min_duration_seconds": 0.1, "apply_preemphasis": False,
        "preemphasis_coefficient": 0.97, "apply_dc_removal": True,
    },
    "training_config": {
        "max_training_iterations": 100, "convergence_threshold": 0.001, "convergence_patience": 5, "min_gaussian_components": 1,
        "max_gaussian_components": 8, "auto_component_selection": True, "enable_pitch_augmentation": False, "pitch_shift_range_cents": 200.0,
        "enable_tempo_augmentation": False, "tempo_stretch_range": 0.2,
    },
    "batch_config": {
        "num_worker_threads": 0, "queue_size_limit": 1000, "batch_size": 10, "max_memory_usage_mb": 2048, "enable_memory_mapping": True,
        "cache_processed_files": False, "enable_progress_reporting": True, "progress_update_interval_ms": 100, "show_eta": True,
        "continue_on_error": True, "max_consecutive_errors": 10, "save_error_files": True, "preserve_directory_structure": True,
        "compress_output": True,
    },
    "output_config": {
        "output_directory": "./output", "metadata_file_extension": ".json", "custom_prefix": "", "create_subdirectories": False,
        "generate_index_file": True, "backup_original_files": False, "validate_output_files": True, "generate_quality_reports": True,
        "quality_report_format": "json",
    },
}

# The fields of a voice's metadata and their defaults.
METADATA: Section = {
    "name": "", "display_name": "", "author": "", "contact": "", "version": "1.0.0", "description": "", "language": "ja", "accent": "",
    "voice_type": "", "tags": [], "model_type": "hmm", "phoneme_set": "japanese-cv",
    "audio_format": {"sample_rate": 44100, "frame_period": 5.0, "bit_depth": 16, "channels": 1, "format": "PCM"},
}


def _type(default) -> str:
    if isinstance(default, dict):
        return "STRUCT<" + ", ".join(f"`{k}`: {_type(v)}" for k, v in default.items()) + ">"
    for kind, name in ((bool, "BOOLEAN"), (int, "BIGINT"), (float, "DOUBLE"), (str, "STRING")):
        if isinstance(default, kind):
            return name
    return "ARRAY<STRING>"


def _literal(default) -> Column:
    return F.array(*map(F.lit, default)).cast("array<string>") if isinstance(default, list) else F.lit(default)


def _filled(found: Column, defaults: Section) -> Column:
    parts = [(_filled(found[k], v) if isinstance(v, dict) else F.coalesce(found[k], _literal(v))).alias(k) for k, v in defaults.items()]
    return F.struct(*parts)


def with_defaults(text: Column, defaults: Section) -> Column:
    """A struct of all fields of ``defaults``, read from JSON text.

    A field that is absent, null or of another type takes its default, and so do all where the text is null, empty or no JSON object.
    Unknown fields are dropped."""
    return _filled(F.from_json(text, _type(defaults), {"mode": "PERMISSIVE"}), defaults)


def metadata(text: Column) -> Column:
    """A voice's metadata; a voice without a display name shows its name."""
    m = with_defaults(text, METADATA)
    return m.withField("display_name", F.when(F.length(m["display_name"]) > 0, m["display_name"]).otherwise(m["name"]))


def parameters(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, rate, frame_period, frame, time, f0) for each frame of analysis parameters in JSON.

    A time that is missing is the frame's number times its period; texts without f0 values give no rows."""
    p = F.from_json(text, "sample_rate INT, frame_period DOUBLE, fft_size INT, time_axis ARRAY<DOUBLE>, f0 ARRAY<DOUBLE>")
    x = df.select(*keys, p.alias("_p")).select(*keys, "_p", F.posexplode("_p.f0").alias("frame", "f0"))
    time = F.coalesce(F.try_element_at("_p.time_axis", F.col("frame") + 1), F.col("frame") * F.col("_p.frame_period") / 1000)
    return x.select(*keys, F.col("_p.sample_rate").alias("rate"), F.col("_p.frame_period").alias("frame_period"), "frame", time.alias("time"), "f0")


def manifest(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The seven fields of each line of a training manifest; empty lines and those that begin with # are left out, missing fields are null."""
    part = lambda i: F.try_element_at(F.split(line, ","), F.lit(i + 1))
    names = ["kind", "label", "new_label", "semitones", "stretch", "noise_db", "tilt_db"]
    fields = [(part(i) if i < 3 else part(i).try_cast("double")).alias(n) for i, n in enumerate(names)]
    return df.where((F.length(line) > 0) & ~F.startswith(F.col(line), F.lit("#"))).select(*keys, *fields)
