"""Text functions of document ingestion, native on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.binding import bind

# Topic rules, tested in this order as substrings of the lower-cased text.
TOPICS = [
    ("products", ["product", "price", "cost", "inventory", "stock"]),
    ("users", ["user", "customer", "client", "person", "employee"]),
    ("orders", ["order", "transaction", "purchase", "sale"]),
    ("documents", ["document", "report", "article", "paper"]),
    ("media", ["image", "photo", "picture", "jpg", "png"]),
    ("media", ["video", "mp4", "avi", "mov"]),
    ("media", ["audio", "sound", "mp3", "wav"]),
]
# Words that name no folder.
FOLDER_STOP_WORDS = ["a", "an", "the", "is", "are", "was", "were", "this", "that", "image", "video", "audio", "file", "picture", "photo"]
# Sizes of chunks, overlaps, previews and summaries.
CHUNK, OVERLAP, PREVIEW, SUMMARY_SENTENCES, SUMMARY_CHARS = 1000, 200, 500, 5, 200


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), "(?U)^\\s+|\\s+$", "")


def is_blank(text: Column | str) -> Column:
    """Whether a text is null or holds nothing but white space."""
    return ~F.coalesce(_c(text).rlike("(?U)\\S"), F.lit(False))


def character_chunks(text: Column | str, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; the last one ends the text. Null and empty texts have none."""
    t, step = _c(text), size - overlap
    n = F.char_length(t)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(size)))
    return F.when(n > 0, chunks).otherwise(F.expr("cast(array() as array<string>)"))


def sentences(text: Column | str) -> Column:
    """Split behind . ! ? followed by white space."""
    return F.split(strip(text), "(?U)(?<=[.!?])\\s+", -1)


def first_sentences(text: Column | str, fallback: Column | str, most: int = SUMMARY_SENTENCES) -> Column:
    """The first sentences joined by blanks; the fallback (a file name) for texts without content."""
    # Splitting stops behind the last sentence that is wanted; only what is kept is stripped at its end.
    parts = F.split(F.regexp_replace(_c(text), "(?U)^\\s+", ""), "(?U)(?<=[.!?])\\s+", most + 1)
    return F.when(is_blank(text), _c(fallback)).otherwise(F.regexp_replace(F.array_join(F.slice(parts, 1, most), " "), "(?U)\\s+$", ""))


def short_summary(text: Column | str, most: int = SUMMARY_CHARS) -> Column:
    """White space collapsed; short texts whole, else the whole sentences that fit, else a cut with dots."""
    return bind(F.coalesce(F.regexp_replace(strip(text), "(?U)\\s+", " "), F.lit("")), lambda t: _packed_sentences(t, most))


def _packed_sentences(t: Column, most: int) -> Column:
    parts = F.filter(F.split(t, "(?<=[.!?]) ", -1), lambda s: s != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("stop"))

    def add(a: Column, s: Column) -> Column:
        full = (a["stop"] == 1) | (a["n"] + F.char_length(s) > most)
        joined = F.when(a["n"] == 0, s).otherwise(F.concat(a["out"], F.lit(" "), s))
        return F.struct(F.when(full, a["out"]).otherwise(joined).alias("out"), F.when(full, a["n"]).otherwise(a["n"] + F.char_length(s) + 1).alias("n"), F.when(full, 1).otherwise(0).alias("stop"))

    packed = F.aggregate(parts, start, add, lambda a: a["out"])
    cut = F.concat(F.regexp_replace(F.substring(t, 1, most), "(?U)\\s+$", ""), F.lit("..."))
    return F.when(F.char_length(t) <= most, t).otherwise(F.coalesce(F.nullif(packed, F.lit("")), cut))


def preview(text: Column | str, most: int = PREVIEW) -> Column:
    return F.substring(_c(text), 1, most)


def topic(text: Column | str) -> Column:
    """The first topic one of whose words occurs anywhere in the text."""

    def first_hit(t: Column) -> Column:
        out = None
        for name, words in TOPICS:
            hit = t.rlike("|".join(words))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("general")

    return bind(F.lower(F.coalesce(_c(text), F.lit(""))), first_hit)


def title_case(text: Column | str) -> Column:
    """A capital at the start of each run of letters, lower case behind it."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def folder_name(text: Column | str, collection: Column | str, modality: Column | str) -> Column:
    """The first of the first three words that names something, in title case and at most 20 characters; else collection, modality or Other."""
    words = F.slice(F.split(strip(F.lower(_c(text))), "(?U)\\s+", 4), 1, 3)
    named = F.filter(words, lambda w: ~w.isin(FOLDER_STOP_WORDS) & (F.char_length(w) > 2))
    c, m = F.coalesce(_c(collection), F.lit("")), F.coalesce(_c(modality), F.lit(""))
    blank = F.coalesce(_c(text) == "", F.lit(True))
    no_text = F.when((c != "") & (c != "general"), title_case(c)).when(m != "", title_case(m)).otherwise("Other")
    no_word = F.when(c != "general", title_case(c)).otherwise("Other")
    return F.when(blank, no_text).otherwise(bind(F.get(named, F.lit(0)), lambda w: F.when(w.isNotNull(), F.substring(title_case(w), 1, 20)).otherwise(no_word)))


def human_size(size: Column | str) -> Column:
    """Bytes as B, KB, MB or GB; larger units with two decimals."""
    n = _c(size)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).when(n < 1024**2, F.format_string("%.2f KB", n / 1024)).when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))


def display_type(kind: Column | str, most: Column | str) -> Column:
    return F.when(_c(most).isNotNull(), F.concat(_c(kind), F.lit("("), _c(most).cast("string"), F.lit(")"))).otherwise(_c(kind))


def descriptive_text(*choices: Column | str) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in choices])


def similarity(distance: Column | str) -> Column:
    return F.greatest(F.lit(0.0), 1 - _c(distance))
