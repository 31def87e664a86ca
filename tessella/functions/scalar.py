"""Column functions of the catalog and preference model; all run inside Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signals of an analysis, in their fixed order; vibrancy repeats colorfulness.
SIGNALS = ("technical_quality", "aesthetic_quality", "colorfulness", "harmony", "pairing_affinity", "vibrancy")

# Suffixes that are decoded, those that go with an image, and raw formats that are listed but not decoded.
MEDIA = ("jpg", "jpeg", "png", "gif", "webp", "heic", "tiff", "tif")
SIDECARS = ("xmp", "json", "txt", "md")
RAW = ("raw", "cr2", "nef", "arw", "dng", "orf", "raf", "rw2", "pef", "srw", "x3f")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to a number of digits as SQL's ``round`` takes it: what is rounded is the product with a power
    of ten, as a floating-point number; Spark's own rounds the decimal digits that ``x`` is written with."""
    power = float(10**digits)
    found = F.round(x * power) / power
    return F.when(F.abs(found) < float("inf"), found).otherwise(x)


def saturate(x: Column, k: float) -> Column:
    """x / (x + k), 0 where the sum is not positive."""
    return F.when(x + k > 0, x / (x + k)).otherwise(0.0)


def usable_weight(x: Column) -> Column:
    """A weight that is finite and positive, else 0."""
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def filename_date(path: Column) -> Column:
    """Y-M-D from the first yyyy mm dd in a name, with optional separators; null without one."""
    p = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})"
    found = F.concat_ws("-", *[F.regexp_extract(path, p, i) for i in (1, 2, 3)])
    return F.when(path.rlike(p), found)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; null if either is."""

    def half(x: Column, start: int) -> Column:
        return F.conv(F.substring(x, start, 8), 16, 10).cast("long")

    return reduce(lambda x, y: x + y, [F.bit_count(half(a, s).bitwiseXOR(half(b, s))) for s in (1, 9)])


def aspect_ratio(w: Column, h: Column) -> Column:
    """Width by height; null where one is not known."""
    return F.when((w > 0) & (h > 0), w / h)


def ratios_compatible(x: Column, y: Column) -> Column:
    """Aspect ratios within a factor of two; unknown ones are compatible."""
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y) / F.least(x, y) <= 2.0), F.lit(True))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval; (0, 1) without trials."""
    p, zz = successes / n, z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(1.0)


def schedule_open(ts: Column, weekdays: list[int] | None, hours: tuple[int, int] | None, months: tuple[int, int] | None) -> Column:
    """Weekday set (Monday is 0), [start, end) hour, and months inclusive; no window wraps around."""
    out = F.lit(True)
    if weekdays is not None:
        out = out & F.weekday(ts).isin(*weekdays)
    if hours is not None:
        at = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600
        out = out & (at >= hours[0]) & (at < hours[1])
    if months is not None:
        out = out & F.month(ts).between(*months)
    return out


def verified(content: Column, checksum: Column) -> Column:
    """The content, or an error where its SHA-256 is not the checksum."""
    wrong = F.raise_error(F.concat(F.lit("checksum mismatch: expected "), F.coalesce(checksum, F.lit("none")))).cast("string")
    return F.when(F.sha2(content.cast("binary"), 256).eqNullSafe(checksum), content).otherwise(wrong)


def palette_distance_of(nearest: Column, share: Column) -> Column:
    """Share-weighted mean of nearest distances over the root of three, 1 at most; 1 without colours."""
    return F.coalesce(F.least(F.lit(1.0), F.sum(share * nearest / 3**0.5) / (F.sum(share) + 1e-9)), F.lit(1.0))


def palette_distance(x: Column, y: Column) -> Column:
    """The same of two palettes, arrays of colours with r, g, b and, in the first, share."""

    def nearest(c: Column) -> Column:
        return F.array_min(F.transform(y, lambda o: F.sqrt(sum(((c[k] - o[k]) * (c[k] - o[k]) for k in "rgb"), F.lit(0.0)))))

    total = F.aggregate(x, F.lit(0.0), lambda s, c: s + c["share"] * nearest(c) / 3**0.5)
    return F.coalesce(F.least(F.lit(1.0), total / (F.aggregate(x, F.lit(0.0), lambda s, c: s + c["share"]) + 1e-9)), F.lit(1.0))


def date_proximity(a: Column, b: Column) -> Column:
    """1 on the same moment, falling to 0 at thirty days; null if either is unknown."""
    gap = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86400e6
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), 1 - F.least(gap / 30, F.lit(1.0))))


def gutter(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.least(width, height) / 32)).cast("int")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def hue_saturation_value(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """HSV of channels in [0, 1]; the hue in [0, 1), 0 for greys."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    c = high - low
    six = F.when(c == 0, 0.0).when(high == r, F.pmod((g - b) / c, F.lit(6.0))).when(high == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    return F.pmod(six / 6, F.lit(1.0)), F.when(high > 0, c / high).otherwise(0.0), high


def rectangles_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])
