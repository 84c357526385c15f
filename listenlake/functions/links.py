"""Streaming links: extraction from pages, ids from urls, urls from ids, and the preference among search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: markup classes, id formats, url formats and search preference words. ------------------------
VIDEO_LINK_CLASS, VIDEO_LINK_ATTRIBUTE = "play-this-track-playlink--youtube", "data-youtube-url"
AUDIO_LINK_CLASS, AUDIO_LINK_ATTRIBUTE = "play-this-track-playlink--spotify", "data-spotify-url"
VIDEO_ID_PATTERNS = (r"(?:v=|/)([0-9A-Za-z_-]{11})", r"youtu\.be/([0-9A-Za-z_-]{11})")
TRACK_ID_PATTERNS = (r"spotify\.com/track/([a-zA-Z0-9]{22})", r"spotify:track:([a-zA-Z0-9]{22})")
VIDEO_URL_PREFIX = "https://www.youtube.com/watch?v="
TRACK_URL_PREFIX = "https://open.spotify.com/track/"
TOPIC_CHANNEL = "- Topic"
VIDEO_WORDS = (
    "official video",
    "music video",
    " mv ",
    "[mv]",
    "(mv)",
    "official music video",
    "videoclip",
    "live",
    "concert",
    "performance",
)
AUDIO_WORDS = ("audio", "lyric", "lyrics", "topic")
# ---- End of fixed values. --------------------------------------------------------------------------------------

HIDDEN_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script>"
NAMED_ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
NUMERIC_ENTITY = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"

# An attribute value is in double quotes, in single quotes or bare; a quoted one may hold anything but its quote.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
ATTRIBUTE = r"""[^\s"'>/=]++(?:\s*+=\s*+""" + VALUE + ")?+"
ANCHOR = r"(?is)<a(?:[\s/]++" + ATTRIBUTE + r")*+[\s/]*+>"


def attribute_pattern(name: str) -> str:
    """The value of an attribute of a whole tag, in one of three groups by its quotes."""
    before = r"(?:[\s/]++(?!" + name + r"\s*+=)" + ATTRIBUTE + ")*+"
    return r"(?is)^<a" + before + r"[\s/]++" + name + r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))"""


def _non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _unescape(value: Column) -> Column:
    """Character references by number, then those by name; ``&amp;`` last, as it may stand for the sign itself."""
    code = lambda c: F.when(F.lower(c).startswith("x"), F.conv(F.substr(c, F.lit(2)), 16, 10)).otherwise(c).cast("bigint")
    sign = lambda c: F.decode(F.unhex(F.lpad(F.hex(code(c)), 8, "0")), "UTF-32")
    parts = F.split(value, NUMERIC_ENTITY, -1)
    signs = F.transform(F.regexp_extract_all(value, F.lit(NUMERIC_ENTITY), F.lit(1)), sign)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), signs.alias("s")), lambda x: F.array(x["p"], F.coalesce(x["s"], F.lit(""))))), "")
    plain = F.when(value.rlike(NUMERIC_ENTITY), joined).otherwise(value)
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), NAMED_ENTITIES, plain)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, NULL if it is missing or empty."""
    pattern = attribute_pattern(name)
    return F.coalesce(*[_non_empty(F.regexp_extract(tag, pattern, group)) for group in (1, 2, 3)])


def extract_link(html: Column | str, css_class: str, name: str) -> Column:
    """Url of the first anchor with the class: its data attribute, else its href, else NULL. Comments and scripts do
    not count."""
    source = F.col(html) if isinstance(html, str) else html
    anchors = F.regexp_extract_all(F.regexp_replace(source, HIDDEN_MARKUP, ""), F.lit(ANCHOR), F.lit(0))
    has_class = lambda tag: F.coalesce(F.array_contains(F.split(attribute(tag, "class"), r"\s+"), css_class), F.lit(False))
    tag = F.get(F.filter(anchors, has_class), F.lit(0))
    return _unescape(F.coalesce(attribute(tag, name), attribute(tag, "href")))


def video_link(html: Column | str) -> Column:
    return extract_link(html, VIDEO_LINK_CLASS, VIDEO_LINK_ATTRIBUTE)


def audio_link(html: Column | str) -> Column:
    return extract_link(html, AUDIO_LINK_CLASS, AUDIO_LINK_ATTRIBUTE)


def _first_match(url: Column | str, patterns: tuple[str, ...]) -> Column:
    source = F.col(url) if isinstance(url, str) else url
    return F.coalesce(*[_non_empty(F.regexp_extract(source, p, 1)) for p in patterns])


def video_id(url: Column | str) -> Column:
    return _first_match(url, VIDEO_ID_PATTERNS)


def track_id(url: Column | str) -> Column:
    return _first_match(url, TRACK_ID_PATTERNS)


def video_url(identifier: Column) -> Column:
    return F.concat(F.lit(VIDEO_URL_PREFIX), identifier)


def track_url(identifier: Column) -> Column:
    return F.concat(F.lit(TRACK_URL_PREFIX), identifier)


def _has_word(title: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(title).contains(w) for w in words])


def search_preference(search: Column, result_type: Column, title: Column, channel: Column, pos: Column) -> Column:
    """Preference class of one search result, 1 is best, NULL is never taken.

    ``search`` names the query that gave the result. Videos: ``songs`` (its first result only), then ``general``
    (songs before anything else), then ``api`` (topic channel, audio title, not a video title, anything).
    Tracks: first result of ``strict``, then of ``relaxed``.
    """
    filmed = F.coalesce(_has_word(title, VIDEO_WORDS), F.lit(False))
    audio = F.coalesce(_has_word(title, AUDIO_WORDS), F.lit(False))
    topic = F.coalesce(channel.contains(TOPIC_CHANNEL), F.lit(False))
    return (
        F.when((search == "songs") & (pos == 1), 1)
        .when((search == "general") & (result_type == "song"), 2)
        .when(search == "general", 3)
        .when((search == "api") & topic, 4)
        .when((search == "api") & audio & ~filmed, 5)
        .when((search == "api") & ~filmed, 6)
        .when(search == "api", 7)
        .when((search == "strict") & (pos == 1), 1)
        .when((search == "relaxed") & (pos == 1), 2)
    )
