"""Names in canonical form, as SQL for DuckDB.

The patterns are written out here a second time, so that a change of one in the library shows. RE2 knows ``\\w \\s \\d`` for
ASCII only and has no word borders; ``re2`` puts Unicode classes in their place.
"""

from __future__ import annotations

WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# ---- Fixed values: version markers removed from names. -----------------------------------------------------------
EDGE_SPACE = r"^\s+|\s+$"
DASH_SUFFIX = (
    r"\s+-\s+(\d{4}\s+(remaster(ed)?(\s+edition)?|mix|version)|remaster(ed)?(\s+\d{4}|\s+edition)?|"
    r"re-master(ed)?|radio\s+edit|remix|extended|single|(early\s+)?demo|early\s+take|take\s+\d+|"
    r"(\w[\w\s]*\s)?(instrumental|demo|take|rehearsal|rough)|"
    r"(studio\s+)?(guide\s+vocal\s+)?(instrumental\s+)?rough|sessions?(\s[\w\s]*\w)?\s*((&|"
    r"and)\s*)?outtakes?|outtakes?|alternate\s+mix|\w[\w\s]*\smix|live(\s+at\s+\w+.*)?|at\s+\w+.*|"
    r"mono(\s*/\s*remastered.*)?|stereo|instrumental|acoustic(\s[\w\s]*\w)?|official\s+(music\s+)?video|"
    r"music\s+video|official\s+(hd|4k|animated)?\s*video|(official\s+)?lyric\s+video|(hd|4k)\s+video|"
    r"visuali[sz]er|official\s+audio|shortened\s+edit|vocal\s+version|from\s+.+).*$"
)
REMASTER = r"\s*[\(\[](remaster(ed)?|re-master(ed)?|\d{4}\s+remaster(ed)?|remaster(ed)?\s+\d{4})[\)\]]"
LIVE = r"\s*[\(\[]((live|live\s+(at|from|in|on)|live\s+\d{4}|live\s+(version|recording)).*?)[\)\]]"
VERSION = (
    r"\s*[\(\[](.*?\s+(version|mix|edit|remix|take)|single\s+version|album\s+version|radio\s+edit|"
    r"extended(\s+(version|mix|edit))?|remix)[\)\]]"
)
EXPLICIT = r"\s*[\(\[](explicit|clean|censored)[\)\]]"
AUDIO_FORMAT = (
    r"\s*[\(\[]((stereo|mono)(\s+(mix|version))?|original\s+(stereo|mono)|true\s+stereo|"
    r"simulated\s+stereo)[\)\]]"
)
DEMO_TAKE = (
    r"\s*[\(\[](demo|early\s+demo|take\s+\d+|early\s+take|instrumental|acoustic|"
    r"(.*\s*-\s*)?(official\s+)?(music\s+)?video|(.*\s*-\s*)?(official\s+)?(hd|4k|animated(\s+music)?|"
    r"animated)?\s*video|(.*\s*-\s*)?(official\s+)?lyric\s+video|(.*\s*-\s*)?visuali[sz]er|"
    r"(.*\s*-\s*)?official\s+audio|outtakes?|sessions?|alternate|dub)[\)\]]"
)
FEATURED = r"\s*[\(\[]?(feat\.?|ft\.?|featuring|with|vs\.?|versus).*?[\)\]]?$"
YEAR = r"\s*[\(\[]?\d{4}[\)\]]?\s*"
TRAILING = (
    r"\s+(demo|take\s+\d+|instrumental|official\s+(music\s+)?video|(official\s+)?(hd|4k|animated)\s+video|"
    r"(official\s+)?lyric\s+video|(official\s+)?visuali[sz]er|official\s+audio|at\s+\w([\w\s]*\w)?|mono|"
    r"stereo|excerpt\s+\d+|dub)$"
)
PUNCTUATION = r"[^\w\s-]"
WHITESPACE = r"\s+"
MUSIC_VIDEO = r"(music\s+video|official\s+video|video\s+clip|visuali[sz]er|lyric\s+video|official\s+audio)"
# ---- End of fixed values. ----------------------------------------------------------------------------------------


def re2(pattern: str) -> str:
    out = pattern.replace(r"[^\w\s-]", f"[^{WORD}{SPACE}-]").replace(r"[\w\s]", f"[{WORD}{SPACE}]")
    out = out.replace(r"\w", f"[{WORD}]").replace(r"\s", f"[{SPACE}]").replace(r"\d", r"\p{Nd}")
    return "(?i)" + out.replace("'", "''")


# A word border in front is white space or a bracket that goes too, or a sign that stays; behind it is a sign or the end.
STRICT = (
    rf"(?i)(?:[{SPACE}]*[\(\[]|[{SPACE}]+|(^|[^{WORD}{SPACE}\(\[]))"
    rf"(?:feat|ft|featuring|with|vs|versus)(?:[^{WORD}\n].*)?$"
)


def normalised(name: str, strict: bool = False) -> str:
    """SQL for the canonical form of a column: all steps in order."""
    sql = f"lower({name})"

    def step(pattern: str, by: str = "") -> None:
        nonlocal sql
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"

    for pattern in (EDGE_SPACE, DASH_SUFFIX, REMASTER, LIVE, VERSION, EXPLICIT, AUDIO_FORMAT, DEMO_TAKE):
        step(re2(pattern))
    step(STRICT, r"\1") if strict else step(re2(FEATURED))
    for pattern in (YEAR, TRAILING, PUNCTUATION, DASH_SUFFIX):
        step(re2(pattern))
    step(re2(WHITESPACE), " ")
    step(re2(EDGE_SPACE))
    return sql


def video_regex() -> str:
    return re2(MUSIC_VIDEO)
