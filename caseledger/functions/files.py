"""File-name and listing column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The noise file, the blanked extension and the view URL format.
NOISE_FILE = "desktop.ini"
BLANKED_EXT = ".ini"
VIEW_URL = "https://drive.google.com/file/d/%s/view"


def raw_ext(name: Column) -> Column:
    """The extension as ``os.path.splitext`` splits it (no regex): it starts at the last
    dot that is not one of the leading dots; else an empty text."""
    return F.when(F.instr(F.ltrim(name, F.lit(".")), ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))) \
        .otherwise(F.lit(""))


def stem_before(name: Column, raw: Column) -> Column:
    """``name`` without ``raw``, its ``raw_ext``."""
    return F.when(raw != "", name.substr(F.lit(1), F.length(name) - F.length(raw))).otherwise(name)


def ext_of(raw: Column) -> Column:
    """A ``raw_ext`` without its dot, case kept; ``.ini`` is blanked."""
    return F.when(F.lower(raw) == BLANKED_EXT, F.lit("")).otherwise(F.substring(raw, 2, 1 << 30))


def is_noise_file(name: Column) -> Column:
    return F.lower(name) == NOISE_FILE


def file_stem(name: Column) -> Column:
    """Name without its extension, as ``os.path.splitext`` splits it."""
    return stem_before(name, raw_ext(name))


def file_ext(name: Column) -> Column:
    """Extension without its dot, case kept; ``.ini`` is blanked."""
    return ext_of(raw_ext(name))


def file_extension(name: Column) -> Column:
    """Text after the last dot, lower-cased (``.hidden`` -> ``hidden``)."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def file_url(file_id: Column, source: Column) -> Column:
    return F.when((source == "drive") & F.coalesce(file_id != "", F.lit(False)),
                  F.format_string(VIEW_URL, file_id)).otherwise(F.lit(""))


def iso_utc(epoch_seconds: Column) -> Column:
    """Epoch seconds -> ISO-8601 with ``+00:00``; micros only when non-zero.

    Built on TIMESTAMP_NTZ (epoch + interval), so the text does not depend
    on the session time zone.
    """
    secs = epoch_seconds.cast("decimal(18,6)")
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), secs)
    whole = secs == F.floor(secs)
    return F.when(whole, F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) \
        .otherwise(F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
