"""Strings, numbers, times and colours as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_bool(text: Column) -> Column:
    """true and false in lower case; null otherwise."""
    return F.when(text == "true", True).when(text == "false", False)


def to_number(text: Column, kind: str = "long") -> Column:
    """The whole text as a plain number (sign, digits, for double also a fraction and an exponent); null otherwise."""
    form = r"^[+-]?\d+$" if kind in ("int", "long") else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(F.regexp_like(text, F.lit(form)), text.try_cast(kind))


def digits_of(number: Column) -> Column:
    """How many digits a number has without its sign."""
    return F.length(F.abs(number).cast("string"))


def split_at_space(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def split_list(text: Column, separator: str, most: int = -1) -> Column:
    """Parts between separators. Empty parts stay, but a separator at the end opens none, and an empty text has none; with most, what follows that many parts is dropped."""
    quoted = "\\Q" + separator + "\\E"
    parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, quoted, -1))
    parts = F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.slice(parts, 1, most) if most >= 0 else parts


def split_pair(text: Column, separator: str) -> Column:
    """struct<head, tail> around the first separator; null if there is none."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.struct(F.substr(text, F.lit(1), at - 1).alias("head"), F.substr(text, at + len(separator)).alias("tail")))


def first_in_list(text: Column, dividers: str) -> Column:
    """What stands before the first of several one-character dividers."""
    return F.regexp_extract(text, "^[^" + "".join("\\" + c for c in dividers) + "]*", 0)


def tokens(text: Column) -> Column:
    """Parts between white space and commas."""
    return F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")


def glued_tokens(parts: Column) -> Column:
    """Tokens where one that begins in lower case follows one that begins in upper case as one text."""

    def add(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))
        glue = F.regexp_like(last, F.lit("^[A-Z]")) & F.regexp_like(x, F.lit("^[a-z]"))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, x)))
        return F.when(glue, longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def first_tokens(parts: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), count), " ")


def last_tokens(parts: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, F.size(parts) - count + 1, count), " ")


def groupings(parts: Column, n: int) -> Column:
    """Every way to group tokens into n texts in order, as an array of arrays; the first text shortest first."""
    start = F.array(F.struct(F.array().cast("array<string>").alias("done"), parts.alias("rest")))
    state = start
    for left in range(n, 0, -1):
        state = F.flatten(F.transform(state, _taker(left)))
    return F.transform(F.filter(state, lambda s: F.size(s["rest"]) == 0), lambda s: s["done"])


def _taker(left: int):
    """A function of one state, as transform gives a second argument of a lambda the index."""
    return lambda s: _one_more(s, left)


def _one_more(s: Column, left: int) -> Column:
    rest, done = s["rest"], s["done"]
    size = F.size(rest)
    low, high = (size, size) if left == 1 else (F.lit(1), size - left + 1)
    take = lambda k: F.struct(F.concat(done, F.array(F.array_join(F.slice(rest, F.lit(1), k), " "))).alias("done"), F.slice(rest, k + 1, F.greatest(size - k, F.lit(0))).alias("rest"))
    none = F.array().cast("array<struct<done:array<string>,rest:array<string>>>")
    return F.when((size >= left) & (size > 0), F.transform(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1))), take)).otherwise(none)


def trimmed(text: Column, char: str = " ") -> Column:
    return F.btrim(text, F.lit(char))


def count_words(text: Column) -> Column:
    return F.size(split_at_space(text))


def byte_size(number: Column, largest: str = "TiB") -> Column:
    """Such as 1.5 MiB, in units up to the largest; halves go to the even digit. Steps of 1024 and their names."""
    found, units = None, ("TiB", "GiB", "MiB", "KiB")
    for unit, power in list(zip(units, (4, 3, 2, 1), strict=True))[units.index(largest) :]:
        text = F.concat(F.format_string("%.1f", F.bround(number / 1024.0**power, 1)), F.lit(f" {unit}"))
        found = F.when(number >= 1024**power, text) if found is None else found.when(number >= 1024**power, text)
    return found.otherwise(F.concat(number.cast("string"), F.lit(" B")))


def duration_text(seconds: Column) -> Column:
    """'n s' below a minute, hh:mm:ss from there on."""
    s = F.floor(seconds)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).otherwise(F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60)))


def grouped_number(number: Column, separator: str = ",") -> Column:
    """Digits of a whole number in groups of three; none for an empty separator."""
    plain = number.cast("string")
    return F.regexp_replace(plain, r"(?<=\d)(?=(\d{3})+$)", separator) if separator else plain


# ---- Unicode


@lru_cache(maxsize=65536)
def plain_letter(c: str) -> str:
    """A character without its marks: decomposed, marks dropped; a few letters that do not decompose have names of their own."""
    #: What letters without a decomposition are written as.
    own = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}
    if c in own:
        return own[c]
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@F.pandas_udf(T.StringType())
def transliterated(texts: pd.Series) -> pd.Series:
    """Letters without marks. ASCII texts come back as they are."""
    return texts.map(lambda t: t if t is None or t.isascii() else "".join(map(plain_letter, t)))


def lookup_form(text: Column) -> Column:
    """The form in which names are compared: lower case, white space in single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def match_quality(text: Column, pattern: Column) -> Column:
    """match for the same text in upper case, candidate if it holds the pattern, null otherwise. An empty pattern is held by every text."""
    u, p = F.upper(text), F.upper(pattern)
    return F.when(u == p, "match").when(F.contains(u, p), "candidate")


def match_quality_plain(text: Column, plain_text: Column, pattern: Column, plain_pattern: Column) -> Column:
    """match_quality, then the same for the transliterated forms, given as columns of their own."""
    u, p = F.upper(plain_text), F.upper(plain_pattern)
    return F.coalesce(match_quality(text, pattern), F.when(p != "", F.when(u == p, "match").when(F.contains(u, p), "candidate")))


# ---- times


def iso_time(text: Column) -> Column:
    """Timestamp of 2024-01-02T03:04:05Z with or without a fraction in milliseconds; null otherwise. The session's zone should be UTC."""
    form = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,3}))?Z?$"
    part = lambda k: F.regexp_extract(text, form, k).try_cast("int")
    base = F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"))
    return F.when(F.regexp_like(text, F.lit(form)), F.timestamp_millis(F.unix_millis(base) + F.coalesce(part(7), F.lit(0))))


def iso_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---- colours

#: Colour names.
COLOURS = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "grey": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080",
    "fuchsia": "#ff00ff", "magenta": "#ff00ff", "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff",
    "teal": "#008080", "aqua": "#00ffff", "cyan": "#00ffff", "lightgray": "#d3d3d3", "lightgrey": "#d3d3d3", "darkgray": "#a9a9a9", "darkgrey": "#a9a9a9",
    "darkred": "#8b0000", "darkgreen": "#006400", "darkyellow": "#ffd700", "darkblue": "#00008b", "darkfuchsia": "#8b008b", "darkmagenta": "#8b008b", "darkaqua": "#008b8b", "darkcyan": "#008b8b",
}


def colour(text: Column) -> Column:
    """struct<r, g, b, a> from 0 to 1 of #rrggbb, #rrggbbaa (lower case) or a colour's name; null otherwise."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), text), text)
    byte = lambda k: F.conv(F.substring(named, k, 2), 16, 10).try_cast("int") / 255
    ok = F.regexp_like(named, F.lit("^#[0-9a-f]{6}([0-9a-f]{2})?$"))
    return F.when(ok, F.struct(byte(2).alias("r"), byte(4).alias("g"), byte(6).alias("b"), F.when(F.length(named) == 9, byte(8)).otherwise(1.0).alias("a")))


def _rgb(c: Column, f) -> Column:
    return F.struct(f(c["r"]).alias("r"), f(c["g"]).alias("g"), f(c["b"]).alias("b"), c["a"].alias("a"))


def lightened(c: Column, factor: float) -> Column:
    return _rgb(c, lambda x: x + (1 - x) * factor)


def darkened(c: Column, factor: float) -> Column:
    return _rgb(c, lambda x: x - x * factor)


def greyed(c: Column) -> Column:
    return _rgb(c, lambda x: (c["r"] + c["g"] + c["b"]) / 3)


def colour_hex(c: Column) -> Column:
    two = lambda x: F.lpad(F.lower(F.conv(F.floor(x * 255 + 1e-9).cast("string"), 10, 16)), 2, "0")
    return F.concat(F.lit("#"), two(c["r"]), two(c["g"]), two(c["b"]))


# ---- lanes

#: Turns of a lane, by name.
LANE_TURNS = (
    "none", "left", "merge_to_left", "slight_left", "sharp_left", "through;left", "through;slight_left", "through;sharp_left", "through",
    "through;right", "through;slight_right", "through;sharp_right", "right", "merge_to_right", "slight_right", "sharp_right",
)


def lane_turns(text: Column) -> Column:
    """The turns of lanes between bars, left to right. Alternatives in one lane may stand in either order; an empty lane is none, anything not known is unknown."""

    def one(lane: Column) -> Column:
        flipped = F.concat_ws(";", F.reverse(F.split(lane, ";")))
        return F.when((lane == "") | (lane == "none"), "none").when(lane.isin(*LANE_TURNS), lane).when(flipped.isin(*LANE_TURNS), flipped).otherwise("unknown")

    return F.transform(split_list(text, "|"), one)
