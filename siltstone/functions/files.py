"""Paths, extensions and media kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media extensions.
IMAGE = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "ico", "tiff", "tif"]
VIDEO = ["mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "m4v", "3gp", "mpg", "mpeg"]
AUDIO = ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus"]
# File types of the classifier.
FILE_TYPES = {"json": ["json"], "csv": ["csv"], "excel": ["xlsx", "xls"], "xml": ["xml"], "html": ["html", "htm"], "text": ["txt"], "md": ["md"], "log": ["log"], "yaml": ["yaml", "yml"], "ini": ["ini", "cfg", "conf"], "pdf": ["pdf"], "docx": ["docx", "doc"]}
# MIME types by extension.
MIME = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "xml": "text/xml", "json": "application/json", "pdf": "application/pdf",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "tiff": "image/tiff", "tif": "image/tiff", "ico": "image/vnd.microsoft.icon",
    "mp4": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "webm": "video/webm", "mpg": "video/mpeg", "mpeg": "video/mpeg", "mkv": "video/x-matroska",
    "mp3": "audio/mpeg", "wav": "audio/x-wav", "flac": "audio/flac", "aac": "audio/aac", "ogg": "audio/ogg", "m4a": "audio/mp4", "opus": "audio/opus",
}
# Words that ask for media.
MEDIA_WORDS = ["video", "movie", "clip", "film", "audio", "sound", "music", "song"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/", -1), -1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension without its dot; '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), "[^.]\\.([^.]+)$", 1))


def is_media(path: Column | str) -> Column:
    return extension(path).isin(IMAGE + VIDEO + AUDIO)


def media_type(path: Column | str) -> Column:
    e = extension(path)
    return F.when(e.isin(IMAGE), "image").when(e.isin(VIDEO), "video").when(e.isin(AUDIO), "audio").otherwise("unknown")


def mime_type(path: Column | str) -> Column:
    """MIME type by extension, '' when unknown."""
    pairs = [F.lit(x) for kv in MIME.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[extension(path)], F.lit(""))


def modality(path: Column | str) -> Column:
    """By MIME type, then by extension; text when neither tells."""
    top = F.substring_index(mime_type(path), "/", 1)
    return F.when(top.isin("image", "video", "audio"), top).when(media_type(path) != "unknown", media_type(path)).otherwise("text")


def encoder_modality(path: Column | str) -> Column:
    """As modality, but files that are neither media nor text family are ``other``."""
    e = extension(path)
    kind = modality(path)
    return F.when(kind != "text", kind).when((F.substring_index(mime_type(path), "/", 1) == "text") | e.isin("txt", "md", "csv", "json", "html", "htm", "xml", "yaml", "yml", "log", "pdf", "doc", "docx"), "text").otherwise("other")


def file_type(path: Column | str) -> Column:
    e, out = extension(path), None
    for kind, exts in FILE_TYPES.items():
        out = F.when(e.isin(exts), kind) if out is None else out.when(e.isin(exts), kind)
    return out.otherwise("unknown")


def is_video_node(mime: Column | str, name: Column | str) -> Column:
    """Whether a tree node is a video, by its MIME type or extension."""
    return F.coalesce(_c(mime).startswith("video/"), F.lit(False)) | extension(name).isin(VIDEO)


def relative_path(path: Column | str, root: str) -> Column:
    """A path below the root relative to it; other paths as they are, '' as null."""
    p, r = _c(path), root.rstrip("/") + "/"
    return F.when(p.startswith(r), F.substring(p, len(r) + 1, 1_000_000)).otherwise(F.nullif(p, F.lit("")))


def normal_path(path: Column | str) -> Column:
    """Without empty and . segments; .. removes the segment before it."""
    parts = F.filter(F.split(_c(path), "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, s: F.when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))).otherwise(F.array_append(a, s)))
    return F.concat(F.when(_c(path).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def is_within(path: Column | str, root: str) -> Column:
    """Whether a path, dots resolved, lies under the root."""
    base = root.rstrip("/")
    full = normal_path(F.when(_c(path).startswith("/"), _c(path)).otherwise(F.concat(F.lit(base + "/"), _c(path))))
    return (full == base) | full.startswith(base + "/")


def collision_name(name: Column | str, number: Column | str) -> Column:
    """name, name_1, name_2 ... before the extension."""
    n, k = _c(name), _c(number)
    stem, ext = F.regexp_extract(n, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(n, "^(.*?)(\\.[^.]*)?$", 2)
    return F.when(k == 0, n).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext))


def frame_plan(frames: Column | str, fps: Column | str, cap: Column | str) -> Column:
    """Indices of sampled video frames: about 0.3 a second, at most ``cap``, evenly from first to last."""
    n_all, rate = _c(frames), _c(fps)
    seconds = n_all / F.when(rate > 0, rate).otherwise(30.0)
    n = F.least(F.greatest(F.lit(1), F.floor(seconds * 0.3)), _c(cap), n_all).cast("int")
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * (n_all - 1) / F.greatest(n - 1, F.lit(1))).cast("int"))
    return F.when(n > 0, some).otherwise(F.expr("cast(array() as array<int>)"))
