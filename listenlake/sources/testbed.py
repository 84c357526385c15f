"""The test tables seen as listening history.

An order line is a play: the customer listens, the part is the track, its brand the artist, the line number the
minute. Names get version markers by line number, so canonicalisation has work to do. All views are derived from
whole tables by Spark.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenlake import schemas
from listenlake.functions.links import TRACK_URL_PREFIX, VIDEO_URL_PREFIX
from listenlake.functions.text import canonical_track_id
from listenlake.operators.dimensions import dedup_artists, dedup_tracks, dim_users, known_artists
from listenlake.operators.keyed import by_user, user_tasks
from listenlake.operators.recommend import recommend
from listenlake.operators.statistics import artist_play_counts, track_play_counts
from listenlake.plans import candidates as C
from listenlake.plans.merge import merge_candidates
from listenlake.sources.lake import Files, Lake
from listenlake.sources.shared import release_shuffles, shared_dir
from listenlake.streaming import plays as SP

# Fixed values of this mapping.
AS_OF = "2001-08-02 00:00:00"
PLAY_MARKERS = ("", " - Remastered 2012", " (Live at Wembley)", " feat. Guest", " [Explicit]", " 1999", " (Official Video)")
LISTING_MARKERS = ("", " (Official Video)", " - 2004 Remaster", " (Live)")
NEIGHBOURS = 20
SIMILAR = {"min_listeners": 20, "similarity_threshold": 0.55}
DEEP_CUT = {"min_listeners": 20}
LIST_LENGTH = 30
TRACK_PAGE = "https://music.example/track/"


_STAGED: set[str] = set()


class Testbed:
    """Views over one directory of test tables; nothing is read before an action."""

    __test__ = False

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A silver or gold table of the test lake, written to the shared folder once per session and input.

        Jobs read stored tables, not each other's plans; the table is written by its own operator over the whole
        input the first time one of its readers runs.
        """
        root = f"{shared_dir(self.spark)}/testbed/{self.spark.sparkContext.applicationId}"
        seen = repr((self.directory, Files(self.spark).state(self.directory)))  # other files, other copy
        path = f"{root}/{zlib.crc32(seen.encode()):08x}/{name}"
        if path not in _STAGED:
            build().write.mode("overwrite").parquet(path)
            _STAGED.add(path)
            release_shuffles(self.spark)
        return self.spark.read.parquet(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    # ---- facts

    def names(self) -> DataFrame:
        """Spelled name and canonical id per part and line number. Names repeat in the plays, so ids are made here."""
        markers = F.array(*[F.lit(m) for m in PLAY_MARKERS])
        spelled = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"),
            "p_name",
            F.col("p_brand").alias("artist_name"),
            F.posexplode(markers).alias("place", "marker"),
        )
        # A small dimension is one split; patterns are the cost here, so its rows are spread over all tasks first.
        return spelled.repartition("l_partkey").select(
            "l_partkey",
            (F.col("place") + 1).alias("l_linenumber"),
            F.concat("p_name", "marker").alias("track_name"),
            "artist_name",
            canonical_track_id(F.concat("p_name", "marker"), "artist_name").alias("track_id"),
        )

    def order_lines(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
        started = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        return lines.join(orders, "l_orderkey").select(
            F.col("o_custkey").cast("string").alias("username"),
            (started + F.col("l_linenumber") * 60).alias("scrobbled_at"),
            F.concat(F.lit(TRACK_PAGE), "l_partkey").alias("track_url"),
            (F.col("l_returnflag") == "R").alias("is_loved"),
            "l_partkey",
            "l_linenumber",
        )

    def named(self, lines: DataFrame) -> DataFrame:
        """Lines with the names of their parts. The names are a multiple of the part table, which Spark takes for small by
        the size of its compressed file, and a broadcast once planned stays; so both sides are sorted and merged."""
        return lines.join(self.names().hint("merge"), ["l_partkey", "l_linenumber"])

    def plays(self) -> DataFrame:
        return self.staged("silver/plays", self.build_plays)

    def build_plays(self) -> DataFrame:
        named = self.named(self.order_lines())
        return named.withColumn("scrobbled_at_utc", F.timestamp_seconds("scrobbled_at")).select(*schemas.PLAYS.names)

    def history_pages(self) -> DataFrame:
        """Landed pages: a single play as bare object, or a list that starts with a "now playing" row."""
        named = self.named(self.order_lines())
        artist = F.struct(F.col("artist_name").alias("name"))
        loved = F.when(F.col("is_loved"), "1").otherwise("0")
        play = F.struct(
            F.col("track_name").alias("name"),
            F.col("track_url").alias("url"),
            loved.alias("loved"),
            F.struct(F.col("scrobbled_at").cast("string").alias("uts")).alias("date"),
            artist.alias("artist"),
        )
        playing = F.struct(F.col("track_name").alias("name"), artist.alias("artist"))
        single = F.concat(F.lit('{"recenttracks":{"track":'), F.to_json(play), F.lit("}}"))
        several = F.concat(
            F.lit('{"recenttracks":{"track":['), F.to_json(playing), F.lit(","), F.to_json(play), F.lit("]}}")
        )
        return named.select("username", F.when(F.col("is_loved"), single).otherwise(several).alias("value"))

    def event_plays(self, events: DataFrame | None = None) -> DataFrame:
        """Events, batch or stream, as plays: the JSON key is the track, the event type the artist."""
        events = self.table("events") if events is None else events
        ts = F.col("ts").cast("timestamp")
        track = F.concat(F.lit("track "), F.get_json_object("props", "$.k"))
        return events.select(
            F.col("user_id").cast("string").alias("username"),
            F.unix_micros(ts).alias("scrobbled_at"),
            ts.alias("scrobbled_at_utc"),
            track.alias("track_name"),
            F.lit(None).cast("string").alias("track_url"),
            F.col("event_type").alias("artist_name"),
            F.lit(None).cast("boolean").alias("is_loved"),
            F.concat(track, F.lit("|"), "event_type").alias("track_id"),
        )

    def event_stream(self) -> DataFrame:
        """The same from a file stream."""
        path = f"{self.directory}/events*.parquet"  # a stream reads directories or patterns
        return self.event_plays(SP.landed_files(self.spark, path, self.table("events").schema))

    def scratch_lake(self) -> Lake:
        """An empty lake in the shared folder."""
        return Lake(self.spark, f"{shared_dir(self.spark)}/lakes/{uuid.uuid4().hex}")

    # ---- dimensions

    def part_counts(self) -> DataFrame:
        counts = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
            .agg(F.count("*").alias("n"))
            .groupBy("p_partkey")
            .agg(F.count("*").alias("listeners"), F.sum("n").alias("playcount"))
        )
        return self.table("part").join(counts, "p_partkey", "left")

    def listing(self) -> DataFrame:
        return self.staged("bronze/listing", self.build_listing)

    def build_listing(self) -> DataFrame:
        """Track metadata, several versions per track."""
        markers = F.array(*[F.lit(m) for m in LISTING_MARKERS])
        video = F.concat(F.lit(VIDEO_URL_PREFIX), F.lpad(F.floor(F.col("p_partkey") / 3).cast("string"), 11, "0"))
        audio = F.concat(F.lit(TRACK_URL_PREFIX), F.lpad(F.col("p_partkey").cast("string"), 22, "0"))
        return self.part_counts().select(
            F.concat("p_name", F.element_at(markers, F.pmod("p_size", F.lit(4)) + 1)).alias("track_name"),
            F.col("p_brand").alias("artist_name"),
            (F.col("p_size") * 10000).cast("bigint").alias("duration_ms"),
            "listeners",
            "playcount",
            F.concat_ws(", ", F.lower("p_type"), F.translate("p_name", " ", "-")).alias("tags"),
            F.concat(F.lit(TRACK_PAGE), "p_partkey").alias("track_url"),
            F.when(F.col("p_size") > 10, video).alias("youtube_url"),
            F.when(F.col("p_size") < 40, audio).alias("spotify_url"),
        )

    def raw_tracks(self) -> DataFrame:
        """The listing as nested metadata records, through JSON text; a part without numbers has no such fields."""
        tag = F.struct(F.transform(F.split("tags", ", "), lambda t: F.struct(t.alias("name"))).alias("tag"))
        record = F.struct(
            F.col("track_name").alias("name"),
            F.col("track_url").alias("url"),
            F.col("duration_ms").cast("string").alias("duration"),
            F.col("listeners").cast("string").alias("listeners"),
            F.col("playcount").alias("playcount"),
            F.struct(F.col("artist_name").alias("name")).alias("artist"),
            tag.alias("toptags"),
            "youtube_url",
            "spotify_url",
        )
        parsed = F.from_json(F.to_json(record), schemas.RAW_TRACK)
        return self.listing().select(parsed.alias("r")).select("r.*")

    def raw_artists(self) -> DataFrame:
        tag = F.struct(F.transform(F.split("tags", ", "), lambda t: F.struct(t.alias("name"))).alias("tag"))
        record = F.struct(
            F.col("artist_name").alias("name"),
            F.col("artist_url").alias("url"),
            F.struct("listeners", "playcount").alias("stats"),
            tag.alias("tags"),
            F.struct(F.col("bio_summary").alias("summary")).alias("bio"),
        )
        parsed = F.from_json(F.to_json(record), schemas.RAW_ARTIST)
        return self.artist_entries().select(parsed.alias("r")).select("r.*")

    def tracks(self) -> DataFrame:
        return self.staged("silver/tracks", self.build_tracks)

    def build_tracks(self) -> DataFrame:
        return dedup_tracks(self.listing())

    def artist_entries(self) -> DataFrame:
        """Artist metadata, spelled differently per part type."""
        spelled = (
            F.when(F.col("p_type") == "PROMO", F.upper("p_brand"))
            .when(F.col("p_type") == "LARGE", F.concat("p_brand", F.lit(" (Live)")))
            .otherwise(F.col("p_brand"))
        )
        per_type = self.part_counts().groupBy("p_brand", "p_type").agg(
            F.count("*").alias("parts"), F.sum("listeners").alias("listeners"), F.sum("playcount").alias("playcount")
        )
        tags = per_type.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.lower("p_type"))), ", ").alias("tags"))
        return per_type.join(tags, "p_brand").select(
            spelled.alias("artist_name"),
            "listeners",
            "playcount",
            "tags",
            F.concat(F.lit("About "), "p_brand", F.lit(" / "), "p_type").alias("bio_summary"),
            F.concat(F.lit("https://music.example/artist/"), "p_brand").alias("artist_url"),
        )

    def artists(self) -> DataFrame:
        return self.staged("silver/artists", self.build_artists)

    def build_artists(self) -> DataFrame:
        return known_artists(dedup_artists(self.artist_entries()), 1)

    def users(self) -> DataFrame:
        return self.staged("silver/dim_users", self.build_users)

    def build_users(self) -> DataFrame:
        return dim_users(self.plays())

    def track_counts(self) -> DataFrame:
        return self.staged("gold/track_play_count", self.build_track_counts)

    def build_track_counts(self) -> DataFrame:
        return track_play_counts(self.plays(), self.users(), AS_OF)

    def artist_counts(self) -> DataFrame:
        return self.staged("gold/artist_play_count", self.build_artist_counts)

    def build_artist_counts(self) -> DataFrame:
        return artist_play_counts(self.plays(), self.users(), self.tracks(), self.artists(), AS_OF)

    # ---- landed answers of the music service

    def similar_artists(self) -> DataFrame:
        """The next artists by number, as many as a service answers, matched by the angle between their vectors."""
        number = F.substring_index("p_brand", "#", -1).cast("bigint")
        vectors = (
            self.table("part").select(number.alias("vec_id"), "p_brand").distinct()
            .join(self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
        )
        # Brands are few (a column of the small part table), so their places are one small sort.
        everyone = Window.partitionBy(F.lit(0))
        vectors = vectors.withColumn("place", F.row_number().over(everyone.orderBy("vec_id")) - 1)
        vectors = vectors.withColumn("brands", F.count("*").over(everyone))
        step = F.explode(F.sequence(F.lit(1), F.least(F.lit(NEIGHBOURS), F.greatest(F.col("brands") - 1, F.lit(1)).cast("int"))))
        left = vectors.select(F.col("p_brand").alias("artist_name"), F.col("v").alias("a"), "place", "brands", step.alias("step"))
        left = left.withColumn("other", F.pmod(F.col("place") + F.col("step"), F.col("brands")).cast("int"))
        right = vectors.select(F.col("place").alias("other"), F.col("p_brand").alias("similar_name"), F.col("v").alias("b"))
        cosine = _dot("a", "b") / (F.sqrt(_dot("a", "a")) * F.sqrt(_dot("b", "b")))
        pairs = left.join(right, "other").select(
            "artist_name", "similar_name", F.round((cosine + 1) / 2, 6).alias("match")
        )
        w = Window.partitionBy("artist_name").orderBy(F.col("match").desc(), "similar_name")
        return pairs.withColumn("pos", F.row_number().over(w))

    def _answer(self, df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
        """All entries per request with their places; how many are used is up to the operators."""
        return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    def artist_top_tracks(self) -> DataFrame:
        rows = self.listing().select(
            "artist_name", "track_name", F.col("artist_name").alias("track_artist"), "listeners", "playcount", "track_url"
        )
        order = [F.col("playcount").desc_nulls_last(), F.col("track_url")]
        return self._answer(rows, ["artist_name"], order).drop("track_url")

    def tag_top_tracks(self) -> DataFrame:
        rows = self.listing().select(
            F.explode(F.split("tags", ", ")).alias("tag"), "track_name", "artist_name", "playcount", "track_url"
        )
        order = [F.col("playcount").desc_nulls_last(), F.col("track_url")]
        return self._answer(rows, ["tag"], order).drop("playcount", "track_url")

    def _albums(self) -> DataFrame:
        return self.part_counts().select(
            F.col("p_brand").alias("artist_name"),
            F.concat(F.lit("Album "), "p_size").alias("album_name"),
            F.col("p_name").alias("track_name"),
            "playcount",
            "p_partkey",
        )

    def artist_top_albums(self) -> DataFrame:
        albums = self._albums().groupBy("artist_name", "album_name").agg(F.sum("playcount").alias("playcount"))
        return self._answer(albums, ["artist_name"], [F.col("playcount").desc_nulls_last(), F.col("album_name")])

    def album_tracks(self) -> DataFrame:
        return self._albums().select("album_name", "artist_name", "track_name", F.col("p_partkey").alias("pos"))

    def link_search(self) -> DataFrame:
        """Search results per track, one per order line."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
        )
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
        rows = self.named(lines).join(suppliers, "l_suppkey")
        video = F.col("l_linestatus") == "O"
        key = F.col("l_orderkey").cast("string")
        found = F.when(video, F.lpad(key, 11, "0")).otherwise(F.lpad(key, 22, "0"))
        search = (
            F.when(video & (F.col("l_linenumber") == 1), "songs")
            .when(video & (F.col("l_linenumber") <= 3), "general")
            .when(video, "api")
            .when(F.col("l_linenumber") <= 3, "strict")
            .otherwise("relaxed")
        )
        kind = F.when(F.col("l_returnflag") == "R", "song").when(F.col("l_returnflag") == "A", "video").otherwise("artist")
        return rows.select(
            "track_id",
            F.when(video, "youtube").otherwise("spotify").alias("platform"),
            search.alias("search"),
            kind.alias("result_type"),
            F.when(F.col("l_quantity") <= 45, found).alias("result_id"),
            F.col("track_name").alias("title"),
            F.concat("s_name", F.when(F.col("l_returnflag") == "N", " - Topic").otherwise("")).alias("channel"),
            (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int").alias("pos"),
        )

    def track_pages(self) -> DataFrame:
        """Landed pages with a player block in front of the text; which links it has depends on the page."""
        key = F.col("page_id").cast("string")
        css = "play-this-track-playlink play-this-track-playlink--"
        video = F.concat(F.lit(f'<a class="{css}youtube" data-youtube-url="{VIDEO_URL_PREFIX}'), F.lpad(key, 11, "0"), F.lit('&amp;t=1">play</a>'))
        video_href = F.concat(F.lit(f'<a href="{VIDEO_URL_PREFIX}'), F.lpad(key, 11, "0"), F.lit(f'" class="{css}youtube">play</a>'))
        audio = F.concat(F.lit(f'<a class="{css}spotify" data-spotify-url="{TRACK_URL_PREFIX}'), F.lpad(key, 22, "0"), F.lit('">play</a>'))
        hidden = F.lit(f'<!-- <a class="{css}youtube" href="https://hidden.example/">old</a> -->')
        above = F.concat(F.lit(f'<a title="a > b" class="{css}youtube" data-youtube-url="{VIDEO_URL_PREFIX}'), F.lpad(key, 11, "0"), F.lit('">play</a>'))
        single = F.concat(F.lit(f"<a class='{css}spotify' title='say \"x\"' data-spotify-url='{TRACK_URL_PREFIX}"), F.lpad(key, 22, "0"), F.lit("'>play</a>"))
        bare = F.concat(F.lit(f"<a class=play-this-track-playlink--youtube data-youtube-url={VIDEO_URL_PREFIX}"), F.lpad(key, 11, "0"), F.lit(">play</a>"))
        numbers = F.concat(F.lit(f'<a class="{css}youtube" data-youtube-url="{VIDEO_URL_PREFIX}'), F.lpad(key, 11, "0"), F.lit('&#x26;t=1&#38;u=&#233;">play</a>'))
        kind = F.pmod("page_id", F.lit(8))
        block = (
            F.when(kind == 0, F.concat(hidden, video, audio))
            .when(kind == 1, video_href)
            .when(kind == 2, F.concat(hidden, audio))
            .when(kind == 4, above)
            .when(kind == 5, single)
            .when(kind == 6, bare)
            .when(kind == 7, numbers)
            .otherwise(F.lit(""))
        )
        return self.table("pages").select(
            "page_id",
            F.concat(F.lit(TRACK_PAGE), key).alias("url"),
            F.concat(block, F.col("html")).alias("html"),
        )

    def track_search(self) -> DataFrame:
        """Search answers by track: each version of a track, in the order of plays."""
        rows = self.listing().select(
            canonical_track_id("track_name", "artist_name").alias("track_id"), F.col("track_url").alias("url"), "playcount"
        )
        order = [F.col("playcount").desc_nulls_last(), F.col("url")]
        return self._answer(rows, ["track_id"], order).drop("playcount")

    # ---- candidates, with thresholds that suit the size of the test tables

    def similar_sources(self) -> DataFrame:
        played = C.user_artists(self.plays(), self.tracks(), self.artists())
        return C.similar_artist_sources(played)

    def build_candidate_similar_artist(self) -> DataFrame:
        return C.similar_artist_candidates(
            self.track_counts(), self.similar_sources(), self.similar_artists(), self.artist_top_tracks(), **SIMILAR
        )

    def tag_profile(self) -> DataFrame:
        return C.tag_profile(self.plays(), self.tracks(), self.artists())

    def build_candidate_similar_tag(self) -> DataFrame:
        return C.similar_tag_candidates(self.track_counts(), self.tag_profile(), self.tag_top_tracks())

    def deep_cut_sources(self) -> DataFrame:
        played = C.user_artists(self.plays(), self.tracks(), self.artists())
        return C.deep_cut_sources(played)

    def build_candidate_deep_cut(self) -> DataFrame:
        catalogue = C.album_catalogue(self.artist_top_albums(), self.album_tracks(), **DEEP_CUT)
        return C.deep_cut_candidates(self.track_counts(), self.deep_cut_sources(), catalogue)

    def candidate_old_favorites(self) -> DataFrame:
        return self.staged("silver/candidate_old_favorites", self.build_candidate_old_favorites)

    def build_candidate_old_favorites(self) -> DataFrame:
        return C.old_favorites(self.plays(), AS_OF, self.users())

    def candidates(self) -> DataFrame:
        """What a catalogue makes of users, and what is merged of it, is many times the plays, so it is not stored for one
        reader: the reader's plan makes it in the partition of the user."""
        rows = self.build_candidates()
        release_shuffles(self.spark, wait=1.5)
        return rows

    def build_candidates(self, **settings) -> DataFrame:
        return merge_candidates(
            self.track_counts(),
            self.build_candidate_similar_artist(),
            self.build_candidate_similar_tag(),
            self.build_candidate_deep_cut(),
            self.candidate_old_favorites(),
            self.tracks(),
            self.artists(),
            **settings,
        )

    def recommended(self) -> DataFrame:
        return self.staged("gold/recommended", self.build_recommended)

    def build_recommended(self) -> DataFrame:
        tasks = user_tasks(self.track_counts())  # as the candidates lie
        tracks, artists = by_user(self.excluded_tracks(), tasks), by_user(self.excluded_artists(), tasks)
        return recommend(self.candidates(), tracks, artists, n=LIST_LENGTH)

    # ---- feedback

    def excluded_tracks(self) -> DataFrame:
        """Urgent orders: the customer excludes the track whose part has the number of the order."""
        orders = self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
        parts = self.table("part").select(
            F.col("p_partkey").alias("o_orderkey"), canonical_track_id("p_name", "p_brand").alias("track_id")
        )
        picked = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(parts.hint("merge"), "o_orderkey")
        names = self.tracks().select("track_id", "track_name", "artist_name")
        return picked.join(names, "track_id").groupBy(
            F.col("o_custkey").cast("string").alias("username"), "track_id", "track_name", "artist_name"
        ).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("excluded_at"))

    def excluded_artists(self) -> DataFrame:
        """Artists of whom a customer returned at least two order lines."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        lines = self.table("lineitem").filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_partkey")
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("artist_name"))
        back = lines.join(orders, "l_orderkey").join(parts.hint("merge"), "l_partkey")
        counts = back.groupBy(F.col("o_custkey").cast("string").alias("username"), "artist_name").agg(
            F.count("*").alias("n"), F.max(F.col("o_orderdate").cast("timestamp")).alias("excluded_at")
        )
        return counts.filter(F.col("n") >= 2).drop("n")

    def messy_names(self) -> DataFrame:
        """Every line of every document, and every spelled part name, as a name."""
        lines = self.table("documents").select(
            F.concat(F.lit("document "), "doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("place", "name")
        ).repartition("source", "place")
        spelled = self.names().select(
            F.concat(F.lit("part "), "l_partkey").alias("source"),
            F.col("l_linenumber").alias("place"),
            F.concat_ws(" / ", "track_name", "artist_name").alias("name"),
        )
        return lines.unionByName(spelled)


def _dot(left: str, right: str) -> Column:
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
