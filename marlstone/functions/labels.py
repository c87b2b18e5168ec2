"""Labels, ids and dataset names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ava_label(label: Column, positive: str = "SPEECH", negative: str = "NONSPEECH") -> Column:
    """Positive where the annotation names speech and does not deny it."""
    return F.when(label.contains("SPEECH") & ~label.contains("NO_SPEECH"), positive).otherwise(negative)


def ava_condition(label: Column) -> Column:
    return F.when(label.contains("CLEAN"), "clean").when(label.contains("MUSIC"), "music").when(label.contains("NOISE"), "noise").otherwise("none")


def canonical_label(label: Column) -> Column:
    """Upper case without hyphens and underscores."""
    return F.upper(F.translate(label, "-_", ""))


def filter_label(df: DataFrame, label: str, label_col: str = "label") -> DataFrame:
    return df.filter(F.col(label_col) == label)


def intervals_of(df: DataFrame, uri: str, label: str) -> DataFrame:
    return df.filter((F.col("uri") == uri) & (F.col("label") == label)).select("start_s", "end_s").orderBy("start_s", "end_s")


def base_clip_id(clip_id: Column, prefixes: tuple[str, ...] = ("voxconverse_",), marks: tuple[str, ...] = ("_1000ms_", "_200ms_")) -> Column:
    """The recording a clip was cut from: two leading parts below a listed prefix, else without the two last parts where a duration mark stands."""
    parts = F.split(clip_id, "_")
    listed, marked = F.lit(False), F.lit(False)
    for p in prefixes:
        listed = listed | clip_id.startswith(p)
    for m in marks:
        marked = marked | clip_id.contains(m)
    return (
        F.when(listed, F.concat_ws("_", F.slice(parts, 1, 2)))
        .when(marked & (F.size(parts) > 2), F.concat_ws("_", F.slice(parts, F.lit(1), F.size(parts) - 2)))
        .otherwise(clip_id)
    )


def dataset_of_clip(clip_id: Column, prefixes: dict[str, str] | None = None, default: str = "unknown") -> Column:
    """Dataset by the first matching id prefix."""
    out = F.lit(default)
    for prefix, name in reversed((prefixes or {"voxconverse_": "voxconverse", "1-": "esc50", "2-": "esc50", "3-": "esc50", "4-": "esc50", "5-": "esc50"}).items()):
        out = F.when(clip_id.startswith(prefix), name).otherwise(out)
    return out


def clip_id_of_path(path: Column) -> Column:
    """File name without folders and the last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
