from __future__ import annotations

from conftest import rows

from listenlake.functions import links as L
from listenlake.operators import linking as LK

CSS = "play-this-track-playlink play-this-track-playlink--"


def test_extract(spark):
    pages = [
        (1, f'<a class="{CSS}youtube"\n data-youtube-url="https://y/1?a=1&amp;b=2">x</a><a class="{CSS}spotify" data-spotify-url="https://s/1">'),
        (2, f'<a href="https://y/2" class="{CSS}youtube" data-youtube-url="">x</a>'),
        (3, f'<!-- <a class="{CSS}youtube" href="https://y/3">x</a> --><p>none</p>'),
        (5, f'<a title="a > b" class="{CSS}youtube" data-youtube-url="https://y/5">x</a>'),
        (6, f"<A title='say \"x\"' data-youtube-url = 'https://y/6?q=\"a\"' CLASS='{CSS}youtube'>x</a>"),
        (7, "<a/class=play-this-track-playlink--youtube data-youtube-url=https://y/7?v=1&#x26;t=&#128512;>x</a>"),
        (8, f'<a data-x="class=\'{CSS}youtube\'" href="https://y/8">x</a><a class="{CSS}youtube" data-youtube-url="&amp;#65;">x</a>'),
        (9, '<a class="' + "b " * 5000 + f'{CSS}youtube" href="https://y/9" ' + "x=1 " * 2000 + ">x</a>"),
        (4, '<a class="play-this-track-playlink--youtube-old" href="https://y/4">x</a>'),
    ]
    df = spark.createDataFrame(pages, "i int, html string").select("i", L.video_link("html"), L.audio_link("html"))
    assert rows(df) == [(1, "https://y/1?a=1&b=2", "https://s/1"), (2, "https://y/2", None), (3, None, None), (4, None, None), (5, "https://y/5", None), (6, 'https://y/6?q="a"', None), (7, "https://y/7?v=1&t=😀", None), (8, "&#65;", None), (9, "https://y/9", None)]


def test_ids(spark):
    urls = ["https://www.youtube.com/watch?v=aB3-_xYz019", "https://youtu.be/aB3-_xYz019", "https://music.youtube.com/watch?v=aB3-_xYz019&x", "nothing", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(L.video_id("u")).collect()
    assert [r[0] for r in got] == ["aB3-_xYz019"] * 3 + [None, None]
    urls = ["https://open.spotify.com/track/0a1B2c3D4e5F6g7H8i9J0k?si=1", "spotify:track:0a1B2c3D4e5F6g7H8i9J0k", "spotify:album:0a1B2c3D4e5F6g7H8i9J0k"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(L.track_id("u")).collect()
    assert [r[0] for r in got] == ["0a1B2c3D4e5F6g7H8i9J0k"] * 2 + [None]


def test_best_links(spark):
    found = [
        ("a", "youtube", "general", "video", "g1", "t", "c", 1),
        ("a", "youtube", "general", "song", "g2", "t", "c", 2),
        ("b", "youtube", "songs", "song", None, "t", "c", 1),
        ("b", "youtube", "songs", "song", "s2", "t", "c", 2),
        ("b", "youtube", "general", "video", "g3", "t", "c", 3),
        ("c", "youtube", "api", None, "v1", "Song (Official Video)", "Label", 1),
        ("c", "youtube", "api", None, "v2", "Song", "Label", 2),
        ("c", "youtube", "api", None, "v3", "Song lyrics", "Label", 3),
        ("d", "youtube", "api", None, "v4", "Song lyrics", "Label", 1),
        ("d", "youtube", "api", None, "v5", "Song live", "Artist - Topic", 2),
        ("e", "spotify", "relaxed", None, "r1", None, None, 1),
        ("e", "spotify", "strict", None, "s1", None, None, 1),
        ("f", "youtube", "api", None, "v6", "Song concert", "Label", 1),
    ]
    schema = "track_id string, platform string, search string, result_type string, result_id string, title string, channel string, pos int"
    best = LK.best_links(spark.createDataFrame(found, schema))
    assert rows(best, "track_id", "result_id") == [("a", "g2"), ("b", "g3"), ("c", "v3"), ("d", "v5"), ("e", "s1"), ("f", "v6")]
