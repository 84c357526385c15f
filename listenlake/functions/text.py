"""Name canonicalisation: free-text track and artist names become join keys.

Everything is a ``Column`` expression. Patterns are written once with the plain classes ``\\w \\s \\d`` and ``$``;
``java_regex`` turns them into the dialect Spark runs. The flags matter: ``U`` keeps accented letters as letters,
``d`` lets the dot stop at a line feed only, and ``\\z`` is the very end of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: version markers removed from names, in this order. ------------------------------------------
# Repeated groups such as (\w+\s+)* are written as [\w\s]* runs: the Java matcher recurses on repeated groups and
# overflows its stack on names of some thousand words.
DASH_SUFFIX = (
    r"\s+-\s+("
    r"\d{4}\s+(remaster(ed)?(\s+edition)?|mix|version)|"
    r"remaster(ed)?(\s+\d{4}|\s+edition)?|re-master(ed)?|"
    r"radio\s+edit|remix|extended|single|"
    r"(early\s+)?demo|early\s+take|take\s+\d+|"
    r"(\w[\w\s]*\s)?(instrumental|demo|take|rehearsal|rough)|"
    r"(studio\s+)?(guide\s+vocal\s+)?(instrumental\s+)?rough|"
    r"sessions?(\s[\w\s]*\w)?\s*((&|and)\s*)?outtakes?|outtakes?|"
    r"alternate\s+mix|"
    r"\w[\w\s]*\smix|"
    r"live(\s+at\s+\w+.*)?|at\s+\w+.*|"
    r"mono(\s*/\s*remastered.*)?|stereo|"
    r"instrumental|acoustic(\s[\w\s]*\w)?|"
    r"official\s+(music\s+)?video|music\s+video|"
    r"official\s+(hd|4k|animated)?\s*video|"
    r"(official\s+)?lyric\s+video|"
    r"(hd|4k)\s+video|visuali[sz]er|official\s+audio|"
    r"shortened\s+edit|vocal\s+version|"
    r"from\s+.+"
    r").*$"
)
REMASTER = r"\s*[\(\[](remaster(ed)?|re-master(ed)?|\d{4}\s+remaster(ed)?|remaster(ed)?\s+\d{4})[\)\]]"
LIVE = r"\s*[\(\[]((live|live\s+(at|from|in|on)|live\s+\d{4}|live\s+(version|recording)).*?)[\)\]]"
VERSION = (
    r"\s*[\(\[](.*?\s+(version|mix|edit|remix|take)|single\s+version|album\s+version|radio\s+edit|"
    r"extended(\s+(version|mix|edit))?|remix)[\)\]]"
)
EXPLICIT = r"\s*[\(\[](explicit|clean|censored)[\)\]]"
AUDIO_FORMAT = (
    r"\s*[\(\[]((stereo|mono)(\s+(mix|version))?|original\s+(stereo|mono)|true\s+stereo|simulated\s+stereo)[\)\]]"
)
DEMO_TAKE = (
    r"\s*[\(\[]("
    r"demo|early\s+demo|"
    r"take\s+\d+|early\s+take|"
    r"instrumental|acoustic|"
    r"(.*\s*-\s*)?(official\s+)?(music\s+)?video|"
    r"(.*\s*-\s*)?(official\s+)?(hd|4k|animated(\s+music)?|animated)?\s*video|"
    r"(.*\s*-\s*)?(official\s+)?lyric\s+video|"
    r"(.*\s*-\s*)?visuali[sz]er|"
    r"(.*\s*-\s*)?official\s+audio|"
    r"outtakes?|sessions?|"
    r"alternate|"
    r"dub"
    r")[\)\]]"
)
FEATURED = r"\s*[\(\[]?(feat\.?|ft\.?|featuring|with|vs\.?|versus).*?[\)\]]?$"
YEAR = r"\s*[\(\[]?\d{4}[\)\]]?\s*"
TRAILING = (
    r"\s+("
    r"demo|"
    r"take\s+\d+|"
    r"instrumental|"
    r"official\s+(music\s+)?video|"
    r"(official\s+)?(hd|4k|animated)\s+video|"
    r"(official\s+)?lyric\s+video|"
    r"(official\s+)?visuali[sz]er|"
    r"official\s+audio|"
    r"at\s+\w([\w\s]*\w)?|"
    r"mono|stereo|"
    r"excerpt\s+\d+|"
    r"dub"
    r")$"
)
PUNCTUATION = r"[^\w\s-]"
WHITESPACE = r"\s+"
EDGE_SPACE = r"^\s+|\s+$"
MUSIC_VIDEO = r"(music\s+video|official\s+video|video\s+clip|visuali[sz]er|lyric\s+video|official\s+audio)"

# The order is part of the result: a year goes after the suffixes that contain one.
STEPS = (
    (EDGE_SPACE, ""),
    (DASH_SUFFIX, ""),
    (REMASTER, ""),
    (LIVE, ""),
    (VERSION, ""),
    (EXPLICIT, ""),
    (AUDIO_FORMAT, ""),
    (DEMO_TAKE, ""),
    (FEATURED, ""),
    (YEAR, ""),
    (TRAILING, ""),
    (PUNCTUATION, ""),
    (DASH_SUFFIX, ""),
    (WHITESPACE, " "),
    (EDGE_SPACE, ""),
)
# ---- End of fixed values. --------------------------------------------------------------------------------------

# The steps that need a bracket; a name without one skips them.
BRACKETED = slice(2, 8)

# FEATURED with word borders around its words.
FEATURED_WORDS = r"\s*[\(\[]?\b(feat\.?|ft\.?|featuring|with|vs\.?|versus)\b.*?[\)\]]?$"

# Anything a step before PUNCTUATION could remove shows one of these; all other names take the short way.
MARKER = (
    r"[\(\[-]|\d{4}|feat|ft|with|vs|versus|"
    r"\s(demo|take|instrumental|official|hd|4k|animated|lyric|visuali|at|mono|stereo|excerpt|dub)"
)
SHORT_STEPS = ((EDGE_SPACE, ""), (PUNCTUATION, ""), (WHITESPACE, " "), (EDGE_SPACE, ""))


def java_regex(pattern: str) -> str:
    """Spark dialect: ``$`` would also match before a last line feed, so the end is ``\\z``."""
    return "(?idU)" + pattern.replace("$", r"\z")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove all white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(_column(value), java_regex(EDGE_SPACE), "")


def normalize_text(value: Column | str, *, null_as_empty: bool = False, strict_words: bool = False) -> Column:
    """Canonical form of a name.

    ``null_as_empty`` gives ``""`` for NULL. ``strict_words`` asks for word borders around ``with``, ``ft`` and the
    like; the default has none, so ``left behind`` becomes ``le``, which stored ids depend on.
    """
    steps = tuple((FEATURED_WORDS if strict_words and p is FEATURED else p, r) for p, r in STEPS)
    lowered = F.lower(_column(value))
    marked = lowered.rlike(java_regex(MARKER))
    first, last = BRACKETED.start, BRACKETED.stop
    before = _replace_all(lowered, steps[:first])
    within = F.transform(  # a lambda, so that what comes before is worked out once
        F.array(before), lambda x: F.when(x.rlike(r"[(\[]"), _replace_all(x, steps[first:last])).otherwise(x)
    )
    out = F.when(marked, _replace_all(within[0], steps[last:])).otherwise(_replace_all(lowered, SHORT_STEPS))
    return F.coalesce(out, F.lit("")) if null_as_empty else out


def _replace_all(value: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, java_regex(step[0]), step[1]), steps, value)


def _or_raw(normalised: Column, raw: Column | str) -> Column:
    return F.when(normalised == "", strip(F.lower(_column(raw)))).otherwise(normalised)


def canonical_track_id(
    track: Column | str, artist: Column | str, *, fallback: bool = False, strict_words: bool = False
) -> Column:
    """``track|artist`` in canonical form; NULL if either is NULL. ``fallback`` keeps the lowered raw name where
    nothing is left of it; stored ids use the default."""
    t = normalize_text(track, strict_words=strict_words)
    a = normalize_text(artist, strict_words=strict_words)
    if fallback:
        t, a = _or_raw(t, track), _or_raw(a, artist)
    return F.concat(t, F.lit("|"), a)


def canonical_artist_id(artist: Column | str, *, fallback: bool = False, strict_words: bool = False) -> Column:
    a = normalize_text(artist, strict_words=strict_words)
    return _or_raw(a, artist) if fallback else a


def is_music_video(name: Column | str) -> Column:
    return _column(name).rlike(java_regex(MUSIC_VIDEO))


def label_from_id(identifier: Column | str) -> Column:
    """Readable label for an id without a dimension row: ``_`` is a blank, every word starts in upper case."""
    words = F.split(F.translate(_column(identifier), "_", " "), "-")
    return F.array_join(F.transform(words, F.initcap), "-")


def track_label(track: Column | str, artist: Column | str) -> Column:
    return F.concat_ws(" - ", F.coalesce(_column(track), F.lit("Unknown")), F.coalesce(_column(artist), F.lit("Unknown")))


def split_tags(tags: Column | str) -> Column:
    """``"rock, indie"`` -> ``["rock", "indie"]``, blanks at the borders removed."""
    return F.transform(F.split(_column(tags), ","), strip)
