"""Numbers and limits: configuration values, image sizes, model generations, usage counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}
MAX_SIDE = 8000
BASE64_CAP = 5 * 1024 * 1024
LONG_EDGE, NEW_LONG_EDGE, NEW_GENERATION = 1568, 2576, (4, 7)
MAX_CONCURRENT_RUNS, MAX_CONCURRENCY = 32, 16


def number(text: Column) -> Column:
    """A finite number from text, or null."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def positive_int(text: Column, default: int, least: int | None = None, most: int | None = None) -> Column:
    """A whole number from configuration: unusable text is the default; below 1 the default, or ``least`` if that is given."""
    n = F.floor(number(text))
    low = F.lit(default) if least is None else F.lit(least)
    out = F.when(n.isNull(), F.lit(default)).when(n < 1, low).otherwise(n)
    return (F.least(out, F.lit(most)) if most is not None else out).cast("long")


def concurrent_runs(text: Column) -> Column:
    return positive_int(text, 2, 1, MAX_CONCURRENT_RUNS)


def concurrency(text: Column) -> Column:
    return positive_int(text, 5, 1, MAX_CONCURRENCY)


def review_iterations(text: Column) -> Column:
    return positive_int(text, 3, 1)


def max_tokens(text: Column) -> Column:
    return positive_int(text, 32_000)


def human_bytes(n: Column) -> Column:
    """Megabytes to a tenth, never rounded up, from one on; else whole kilobytes."""
    mb = F.regexp_replace((F.floor(n / 1048576 * 10) / 10).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    return F.when(n >= 1048576, F.concat(mb, F.lit(" MB"))).otherwise(F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB")))


def raw_cap(base64_cap: Column) -> Column:
    return (F.floor(base64_cap / 4) * 3).cast("long")


def model_generation(model: Column) -> Column:
    """struct<major, minor> of a model id; a missing minor is 0; null if the id has none."""
    pattern = r"claude-[a-z]+-([0-9]+)(?:[.-]([0-9]+))?"
    major = F.nullif(F.regexp_extract(model, pattern, 1), F.lit("")).try_cast("int")
    minor = F.coalesce(F.nullif(F.regexp_extract(model, pattern, 2), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(major.isNotNull(), F.struct(major.alias("major"), minor.alias("minor")))


def long_edge(model: Column) -> Column:
    g = model_generation(model)
    new = (g["major"] > NEW_GENERATION[0]) | ((g["major"] == NEW_GENERATION[0]) & (g["minor"] >= NEW_GENERATION[1]))
    return F.when(new, F.lit(NEW_LONG_EDGE)).otherwise(F.lit(LONG_EDGE))


def media_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ext), F.lit("image/png"))


def is_image_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1)).isin(*MEDIA_TYPES)


def image_rejection(n_bytes: Column, width: Column, height: Column, cap: Column) -> Column:
    """Why an image is refused: too many bytes, else too many pixels; unknown sides never refuse."""
    side = F.greatest(width, height)
    heavy = F.concat(F.lit("image is "), human_bytes(n_bytes), F.lit("; the limit is "), human_bytes(cap))
    wide = F.concat(F.lit("image side is "), side.cast("string"), F.lit(f" px; the limit is {MAX_SIDE} px"))
    return F.when(n_bytes > cap, heavy).when(side > MAX_SIDE, wide)


def png_size(content: Column) -> Column:
    """struct<width, height> from the header of a PNG, without Python."""
    word = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    good = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(good & (F.length(content) >= 24) & (word(17) > 0) & (word(21) > 0), F.struct(word(17).alias("width"), word(21).alias("height")))


def normal_usage(prompt: Column, cached: Column) -> Column:
    """Input tokens without those from the cache; absent stays absent."""
    return F.when(prompt.isNotNull(), F.greatest(F.lit(0), prompt - F.coalesce(cached, F.lit(0))))


def retry_delay_ms(attempt: Column) -> Column:
    return (400 * F.pow(F.lit(2), attempt - 1)).cast("long")


def is_retryable(http_status: Column, transient: Column, has_text: Column, attempt: Column) -> Column:
    """A failed attempt is tried again, three times in all, if its cause may pass and no text has come yet."""
    return (attempt < 3) & ~has_text & (http_status.isin(429, 500, 502, 503, 504) | F.coalesce(transient, F.lit(False)))


def usage_of(text: Column) -> Column:
    """Four token counts from a JSON object; what is no number is absent."""
    fields = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    raw = F.from_json(text, ", ".join(f"{f} string" for f in fields))
    return F.struct(*(number(raw[f]).cast("long").alias(f) for f in fields))
