"""Names, paths, sizes and dates as column expressions. Both / and \\ separate folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a stem that mark a copy, stems of screenshots, screen sizes.
COPY_WORDS = "copy|edited|resized|compressed|scaled|thumb|thumbnail|export|exported"
SCREENSHOT_NAMES = "screen[\\s_-]?shot|screen[\\s_-]?recording|screencap|capture d.écran|bildschirmfoto"
DESKTOP_SCREENS = ((1280, 720), (1280, 800), (1280, 1024), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1680, 1050), (1920, 1080), (1920, 1200), (2560, 1080), (2560, 1440), (2560, 1600), (2880, 1800), (3440, 1440), (3840, 2160))
PHONE_WIDTHS = (720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1440)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def folder(path: Column) -> Column:
    """What stands before the last separator; '' without one."""
    return F.regexp_extract(path, "^(.*)[/\\\\][^/\\\\]*$", 1)


def extension(path: Column) -> Column:
    """The last dot of the name and what follows it; '' where nothing does."""
    return F.regexp_extract(base_name(path), "(\\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """The name without its last dot and what follows it."""
    return F.regexp_replace(base_name(path), "\\.[^.]*$", "")


def format_key(path: Column) -> Column:
    """The extension in lower case, spellings of one format made one."""
    e = F.lower(extension(path))
    return F.when(e.isin(".jpeg", ".jpe"), ".jpg").when(e == ".tiff", ".tif").when(e == ".heif", ".heic").otherwise(e)


def format_name(path: Column) -> Column:
    e = F.upper(F.regexp_replace(format_key(path), "^\\.", ""))
    return F.when(e == "JPG", "JPEG").when(e == "TIF", "TIFF").when(e == "", "Unknown").otherwise(e)


def looks_like_copy(path: Column) -> Column:
    s = stem(path)
    return s.rlike(f"(?i)\\(\\d+\\)|(?<![a-z])({COPY_WORDS})(?![a-z])") | s.rlike("^[^.]*[^\\d.][^.]*\\.\\d$")


def looks_like_screenshot(path: Column) -> Column:
    return stem(path).rlike(f"(?iu){SCREENSHOT_NAMES}")


def is_screen_size(width: Column, height: Column) -> Column:
    """A known desktop size either way round, or a phone's width with a side ratio of 16:9 at least. Null or empty sizes: no."""
    long_, short = F.greatest(width, height), F.least(width, height)
    desktop = F.concat_ws("x", long_.cast("string"), short.cast("string")).isin(*[f"{a}x{b}" for a, b in DESKTOP_SCREENS])
    return F.coalesce((width > 0) & (height > 0) & (desktop | (short.isin(*PHONE_WIDTHS) & (long_ * 9 >= short * 16))), F.lit(False))


def is_burst_name(path: Column) -> Column:
    return stem(path).rlike("(?i)burst")


def is_numbered(path: Column) -> Column:
    return stem(path).rlike("^.+_\\d{3}$")


def sequence_stem(path: Column) -> Column:
    """The stem without a trailing _ and three digits."""
    return F.regexp_replace(stem(path), "(?<=.)_\\d{3}$", "")


def camera_name(make: Column, model: Column) -> Column:
    """The model alone where it starts with the make, whatever the case."""
    return F.when(model.isNull(), make).when(make.isNull() | F.startswith(F.upper(model), F.upper(make)), model).otherwise(F.concat(make, F.lit(" "), model))


def exif_text(raw: Column) -> Column:
    """Without blanks and NULs around it; empty: null."""
    return F.nullif(F.regexp_replace(raw, "^[\\s\\x00]+|[\\s\\x00]+$", ""), F.lit(""))


def exif_date(raw: Column) -> Column:
    """yyyy:MM:dd HH:mm:ss as a time without a zone; anything else: null."""
    t = exif_text(raw)
    return F.when(t.rlike("^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}$"), F.try_to_timestamp(F.regexp_replace(t, "^(\\d{4}):(\\d{2}):(\\d{2})", "$1-$2-$3")).cast("timestamp_ntz"))


def in_units(bytes_: Column, decimals: int, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """1,024-based. One decimal drops a trailing zero, more are kept."""
    out = F.concat(bytes_.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        # half away from zero, as round() has it
        shown = F.format_number(F.round(bytes_ / float(1024**i), decimals), decimals)
        shown = F.replace(shown, F.lit(","), F.lit(""))
        if decimals == 1:
            shown = F.regexp_replace(shown, "\\.0$", "")
        out = F.when(bytes_ >= 1024**i, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def size_text(bytes_: Column) -> Column:
    return in_units(bytes_, 1)


def sizes_text(a: Column, b: Column) -> Column:
    """'x vs y' with one to three decimals, until the two read differently; then exact bytes."""
    units = ("B", "KB", "MB", "GB")
    out = F.concat(F.format_number(a, 0), F.lit(" B vs "), F.format_number(b, 0), F.lit(" B"))
    for decimals in (3, 2, 1):
        x, y = in_units(a, decimals, units), in_units(b, decimals, units)
        out = F.when(x != y, F.concat(x, F.lit(" vs "), y)).otherwise(out)
    return out


def local_time(t: Column, zone: str) -> Column:
    """A UTC time without a zone as the clock of zone shows it, whatever the session's."""
    return t if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def dates_text(a: Column, b: Column, zone: str = "UTC") -> Column:
    """'x vs y': days of the zone, with the time of day where the days are the same."""
    a, b = local_time(a, zone), local_time(b, zone)
    form = lambda t: F.when(F.to_date(a) == F.to_date(b), F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    return F.concat(form(a), F.lit(" vs "), form(b))


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h >= 1, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def count_text(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def with_separator(root: Column) -> Column:
    return F.when(root.rlike("[/\\\\]$"), root).otherwise(F.concat(root, F.when(F.contains(root, F.lit("\\")), "\\").otherwise("/")))


def normalized(path: Column) -> Column:
    """Without separators at its end, unless it is nothing else."""
    return F.coalesce(F.nullif(F.regexp_replace(path, "[/\\\\]+$", ""), F.lit("")), path)


def is_inside(path: Column, root: Column) -> Column:
    return F.startswith(F.upper(path), F.upper(with_separator(root)))


def is_same_or_inside(path: Column, root: Column) -> Column:
    return (F.upper(normalized(path)) == F.upper(normalized(root))) | is_inside(path, normalized(root))


def is_directly_inside(path: Column, root: Column) -> Column:
    return F.upper(folder(path)) == F.upper(normalized(root))


def in_review_folder(path: Column, name: str) -> Column:
    return F.array_contains(F.split(F.upper(path), "[/\\\\]"), name.upper())


ONLINE_ONLY_BITS = 0x1000 | 0x40000 | 0x400000  # fixed value: attribute bits of a file whose bytes are elsewhere


def is_online_only(attributes: Column) -> Column:
    """Offline, recall on open or recall on data access."""
    return attributes.bitwiseAND(F.lit(ONLINE_ONLY_BITS)) != 0
