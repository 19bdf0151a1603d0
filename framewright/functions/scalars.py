"""Scalar expressions: names, clamping, rounding, padding, bytes. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of each modality.
IMAGE_EXTS = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff"]
AUDIO_EXTS = [".mp3", ".wav", ".flac", ".ogg", ".aac", ".m4a"]
VIDEO_EXTS = [".mp4", ".mov", ".avi", ".mkv", ".webm"]
ALL_EXTS = IMAGE_EXTS + AUDIO_EXTS + VIDEO_EXTS
#: Words that mark a file name as speech or as music; plain substrings.
SPEECH_WORDS = ["talk", "speech", "voice", "vocal", "speak", "chat", "convers", "interview", "podcast", "narrat", "dialog", "lecture"]
MUSIC_WORDS = ["song", "music", "instrumental", "beat", "melody", "rhythm", "acoustic", "orchestra", "symphony", "jazz", "rock", "hip-hop", "edm", "remix", "track", "album", "playlist", "studio"]
#: Latent bits by quality, quality by latent channels.
QUALITY_BITS = {1: 4, 2: 4, 3: 4, 4: 5, 5: 6, 6: 7, 7: 8, 8: 8}
CHANNEL_QUALITY = {128: 1, 192: 3, 320: 5}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a name inside an expression, so that it is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot; a leading dot alone starts no suffix. Empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(\.*[^.].*?)\.[^.]*$", "$1")


def modality(path: Column) -> Column:
    """video, then audio, then image; null for other files."""
    e = extension(path)
    return F.when(e.isin(VIDEO_EXTS), "video").when(e.isin(AUDIO_EXTS), "audio").when(e.isin(IMAGE_EXTS), "image")


def has_any(path: Column, words: list[str]) -> Column:
    name = F.lower(basename(path))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w))


def is_speech(path: Column) -> Column:
    return has_any(path, SPEECH_WORDS)


def is_music(path: Column) -> Column:
    return has_any(path, MUSIC_WORDS)


def clamp(x: Column, low: float, high: float) -> Column:
    """Limits x; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def half_even(x: Column) -> Column:
    """Rounds half to even, as an integer (so that there is no negative zero)."""
    return F.rint(x).cast("bigint")


def to_u8(x: Column) -> Column:
    """[0, 1] to 0..255 by truncation."""
    return F.floor(clamp(x, 0.0, 1.0) * 255).cast("int")


def to_i16(x: Column) -> Column:
    """[-1, 1] to 16 bits by truncation toward zero."""
    return (clamp(x, -1.0, 1.0) * 32767).cast("smallint")


def from_i16(x: Column) -> Column:
    return x / 32767.0


def fit_within(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Sizes whose longer edge is at most `most`; half-even rounding, at least 1."""
    longest = F.greatest(w, h)
    one = lambda x: F.when(longest > most, F.greatest(F.lit(1), half_even(x * F.lit(float(most)) / longest))).otherwise(x).cast("bigint")
    return one(w), one(h)


def pad_to(x: Column, multiple: int) -> Column:
    return (F.ceil(x / multiple) * multiple).cast("bigint")


def mirror(i: Column, n: Column) -> Column:
    """The source position of position i when n positions are padded by reflection on the right."""
    return F.when(i < n, i).otherwise(2 * (n - 1) - i)


def crop(pixels: Column, width: Column | int, to_width: Column | int, to_height: Column | int) -> Column:
    """The upper left part of a row-major array of `width` columns."""
    n = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.flatten(F.transform(F.sequence(F.lit(0), n(to_height) - 1), lambda y: F.slice(pixels, y * n(width) + 1, n(to_width))))


def reflect_pad(pixels: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """A row-major array enlarged to the right and below by reflection."""
    at = lambda y, x: F.get(pixels, mirror(y, F.lit(height)) * width + mirror(x, F.lit(width)))
    cells = F.sequence(F.lit(0), F.lit(to_width * to_height - 1))
    return F.transform(cells, lambda i: at(F.floor(i / to_width).cast("int"), i % to_width))


def samples(seconds: Column, rate: Column) -> Column:
    """How many samples a signal of that length has; null if the length or the rate is."""
    n = F.floor(seconds * rate)
    return F.when(n.isNotNull(), F.greatest(F.lit(0), n)).cast("int")


def silence(seconds: Column, rate: Column) -> Column:
    """As many zeros as a signal of that length has samples: what stands in where there is no text or no voice."""
    return F.array_repeat(F.lit(0.0), samples(seconds, rate))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two non-negative integers, by division with remainder."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(F.try_mod(s["a"], s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])  # longs take 91 steps at most


def rate_ratio(source: Column, target: Column) -> Column:
    """up and down: the smallest integers in the ratio of two sample rates."""
    return let(gcd(source, target), lambda g: F.struct((target / g).cast("bigint").alias("up"), (source / g).cast("bigint").alias("down")))


def sorted_map(m: Column) -> Column:
    """A map with its keys in order."""
    return F.map_from_entries(F.sort_array(F.map_entries(m)))


def is_container(content: Column) -> Column:
    """Whether bytes begin with the container's mark and a version that can be read."""
    version = F.conv(F.hex(F.substring(content, 5, 1)), 16, 10).cast("int")
    return F.coalesce((F.substring(content, 1, 4) == F.lit(b"TINY")) & version.between(1, 8), F.lit(False))


def from_map(table: dict[int, int], key: Column, default: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def bits_for_quality(q: Column) -> Column:
    return from_map(QUALITY_BITS, q, 4)


def quality_for_channels(n: Column) -> Column:
    return from_map(CHANNEL_QUALITY, n, 1)


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * F.lit((high - low) / (n - 1)))


def le_hex(x: Column, size: int) -> Column:
    """The little-endian bytes of a non-negative integer, as hexadecimal digits."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(x.cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0")
    return F.concat(*[byte(k) for k in range(size)])


def from_le_hex(digits: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")),
        F.lit(0).cast("bigint"),
        lambda a, k: a + F.call_function("shiftleft", F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint"), 8 * k),
    )


def name_seed(name: Column) -> Column:
    """A 32-bit seed for a name that is the same in every process."""
    return F.crc32(name.cast("binary"))


def sha12(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def thousands(n: Column) -> Column:
    """An integer with commas between thousands."""
    return F.format_number(n, 0)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def words_per_minute(n: Column, seconds: Column) -> Column:
    """Words a minute limited to 50..350; 150 without a duration."""
    return F.least(F.greatest(F.when(seconds > 0, n / seconds * 60).otherwise(F.lit(150.0)), F.lit(50.0)), F.lit(350.0))


def output_name(path: Column, kind: Column) -> Column:
    """What a decoded entry is called: the base name without folders, with the kind's suffix."""
    return F.when(kind == "video", F.concat(stem(path), F.lit("_recovered.mp4"))).when(kind == "semantic", F.concat(stem(path), F.lit("_semantic.wav"))).when(
        kind == "audio", F.concat(stem(path), F.lit(".wav"))
    ).otherwise(basename(path))
