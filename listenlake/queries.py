"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampType

from listenlake import schemas
from listenlake.functions import links as L
from listenlake.functions import text as T
from listenlake.operators import dimensions as D
from listenlake.operators import feedback as FB
from listenlake.operators import history as H
from listenlake.operators import ingest as I
from listenlake.operators import keyed as K
from listenlake.operators import linking as LK
from listenlake.operators import ranking as R
from listenlake.operators import recommend as RC
from listenlake.operators import statistics as ST
from listenlake.plans import candidates as C
from listenlake.plans.jobs import EXCLUDED_TRACKS, Jobs
from listenlake.session import tune
from listenlake.sources.lake import with_user_bucket
from listenlake.sources.testbed import AS_OF, DEEP_CUT, SIMILAR, Testbed
from listenlake.streaming import plays as SP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, small ones to six or more digits (sums depend on their order), instants without a zone. The
    rounding is spelled out so that any engine with IEEE doubles gives the same digits."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            rounded = [F.floor(c * scale + 0.5) / scale for scale in (1e6, 1e15, 1e24)]
            large, small = F.abs(c) >= 1e-3, F.abs(c) >= 1e-9
            c = F.when(large | (c == 0), rounded[0]).when(small, rounded[1]).otherwise(rounded[2])
        elif isinstance(field.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(fn: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return comparable(fn(Testbed(tune(spark), directory)))

    QUERIES[fn.__name__] = run
    return fn


# ---- names


@query
def normalize_names(t):
    return t.messy_names().select("source", "place", T.normalize_text("name").alias("normalized"))


@query
def normalize_names_strict(t):
    names = t.messy_names()
    return names.select("source", "place", T.normalize_text("name", strict_words=True).alias("normalized"))


@query
def normalize_null_as_empty(t):
    """Every third name is missing: it becomes the empty form."""
    name = F.when(F.col("place") % 3 != 0, F.col("name"))
    return t.messy_names().select("source", "place", T.normalize_text(name, null_as_empty=True).alias("normalized"))


@query
def canonical_ids(t):
    """Ids of spelled part names, with and without the raw fallback."""
    spelled = t.names().select("l_partkey", "l_linenumber", "track_name", "artist_name")
    return spelled.select(
        "l_partkey",
        "l_linenumber",
        T.canonical_track_id("track_name", "artist_name").alias("track_id"),
        T.canonical_track_id("track_name", "artist_name", fallback=True).alias("track_id_or_raw"),
        T.canonical_artist_id("artist_name").alias("artist_id"),
        T.track_label("track_name", "artist_name").alias("label"),
    )


@query
def music_video_flag(t):
    return t.messy_names().select("source", "place", F.coalesce(T.is_music_video("name"), F.lit(False)).alias("is_video"))


@query
def id_labels(t):
    return t.table("part").select("p_partkey", T.label_from_id(F.translate("p_name", " ", "_")).alias("label"))


# ---- ingest


@query
def raw_plays_flatten(t):
    return I.plays_from_raw(I.flatten_pages(t.history_pages()))


@query
def raw_tracks_structured(t):
    return I.tracks_from_raw(t.raw_tracks())


@query
def raw_artists_structured(t):
    return I.artists_from_raw(t.raw_artists())


@query
def slice_plays(t):
    return I.slice_plays(t.plays(), "1998-01-01", "1998-02-01").select("username", "scrobbled_at", "track_id", "date")


@query
def backfill_days(t):
    return I.backfill_days(t.plays(), "1998-01-01", "1998-01-31")


@query
def backfill_summary(t):
    return I.backfill_summary(t.plays(), "1998-01-01", "1998-01-31")


# ---- dimensions


@query
def dedup_tracks(t):
    return D.dedup_tracks(t.listing())


@query
def dedup_artists(t):
    return D.dedup_artists(t.artist_entries())


@query
def dim_users(t):
    return D.dim_users(t.plays())


@query
def new_members(t):
    """Tracks played or excluded that are not among the tracks with a video."""
    linked = t.tracks().filter(F.col("youtube_url").isNotNull())
    return D.new_tracks(t.plays(), linked, t.excluded_tracks())


@query
def new_artist_members(t):
    """Artists played that no user has excluded."""
    known = t.excluded_artists()
    return D.new_artists(t.plays(), known.select(T.canonical_artist_id("artist_name").alias("artist_id")))


@query
def active_users(t):
    return K.active_users(t.plays())


# ---- play statistics


@query
def track_play_count(t):
    return t.build_track_counts()


@query
def artist_play_count(t):
    return t.build_artist_counts()


@query
def bootstrap_track_play_count(t):
    """Without a user dimension everyone has the shortest half-life."""
    return ST.track_play_counts(t.plays(), D.default_half_lives(t.plays()), AS_OF)


@query
def lookback_counts(t):
    return ST.track_play_counts(ST.look_back(t.plays(), AS_OF, 365), t.users(), AS_OF)


@query
def plays_per_artist(t):
    return ST.plays_per_artist(t.plays(), t.tracks())


@query
def user_stats(t):
    return ST.user_stats(t.track_counts(), t.artist_counts())


@query
def event_play_count(t):
    plays = t.event_plays()
    return ST.track_play_counts(plays, D.dim_users(plays), "2024-02-01 00:00:00")


# ---- candidates


@query
def similar_artist_candidates(t):
    return t.build_candidate_similar_artist()


@query
def similar_artist_incremental(t):
    """Second run: artists that stored candidates came from are not read again."""
    played = C.user_artists(t.plays(), t.tracks(), t.artists(), t.artist_counts().drop("artist_name"))
    stored = t.excluded_artists().select("username", T.canonical_artist_id("artist_name").alias("source_artist_id"))
    sources = C.similar_artist_sources(played, previous=stored)
    return C.similar_artist_candidates(t.plays(), sources, t.similar_artists(), t.artist_top_tracks(), **SIMILAR)


@query
def funnel_counts(t):
    return C.similar_artist_funnel(t.plays(), t.similar_sources(), t.similar_artists(), t.artist_top_tracks(), **SIMILAR)


@query
def tag_funnel(t):
    return C.similar_tag_funnel(t.track_counts(), t.tag_profile(), t.tag_top_tracks())


@query
def deep_cut_funnel(t):
    catalogue = C.album_catalogue(t.artist_top_albums(), t.album_tracks(), **DEEP_CUT)
    return C.deep_cut_funnel(t.track_counts(), t.deep_cut_sources(), catalogue)


@query
def sampled_artists(t):
    played = C.user_artists(t.plays(), t.tracks(), t.artists())
    return R.sample_large(played.select("username", "artist_id", "play_count"), "artist_id", above=15, rate=0.2)


@query
def tag_profile(t):
    return t.tag_profile()


@query
def tag_profile_gate(t):
    stored = t.excluded_tracks().join(t.tracks().select("track_id", F.replace("tags", F.lit(", "), F.lit(",")).alias("source_tags")), "track_id")
    return C.tag_gate(t.tag_profile(), stored.select("username", "source_tags"))


@query
def similar_tag_candidates(t):
    return t.build_candidate_similar_tag()


@query
def deep_cut_candidates(t):
    return t.build_candidate_deep_cut()


@query
def album_catalogue(t):
    return C.album_catalogue(t.artist_top_albums(), t.album_tracks(), **DEEP_CUT)


@query
def old_favorites(t):
    return t.build_candidate_old_favorites()


@query
def played_cleanup(t):
    """Stored candidates that were played since are dropped, counted per user."""
    cut = F.lit("1999-01-01").cast("timestamp")
    stored = C.played_tracks(t.plays().filter(F.col("scrobbled_at_utc") < cut))
    since = C.played_tracks(t.plays().filter(F.col("scrobbled_at_utc") >= cut))
    keys = ["username", "track_id"]
    kept = K.delete_frame(stored, since, keys).groupBy("username").agg(F.count("*").alias("kept"))
    gone = K.matched(stored, since, keys).groupBy("username").agg(F.count("*").alias("removed"))
    both = kept.join(gone, "username", "full_outer")
    return both.select("username", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("removed", F.lit(0)).alias("removed"))


# ---- merge and recommendation


@query
def rank_normalise(t):
    scored = t.track_counts().select("username", "track_id", F.col("play_count").cast("double").alias("score"))
    return R.rank_normalised(scored)


@query
def rank_normalise_top(t):
    scored = t.track_counts().select("username", "track_id", F.col("play_count").cast("double").alias("score"))
    return R.top_rank_normalised(scored, 10)


@query
def merge_candidates(t):
    return t.build_candidates()


@query
def merge_candidates_on_id(t):
    return t.build_candidates(group_on_id=True)


@query
def artist_cap(t):
    return RC.artist_cap(t.track_counts().withColumnRenamed("recency_score", "weighted_score"), 2)


@query
def exclusions_by_name(t):
    named = t.tracks().select("track_id", "track_name", "artist_name")
    played = C.played_tracks(t.plays()).join(named, "track_id")
    return RC.without_excluded(played, t.excluded_tracks(), t.excluded_artists())


@query
def filter_candidates(t):
    """Tags and deep cuts only, toward discoveries."""
    rows = RC.filter_candidates(t.candidates(), use_similar_artists=False, discovery_weight=0.8)
    return rows.select("username", "track_id", "score", "weighted_score")


@query
def recommend(t):
    columns = ["username", "track_id", "track_name", "artist_name", "weighted_score", "rank", "shown", "score_pct"]
    return t.build_recommended().select(*columns)


@query
def recommend_old_favorites(t):
    rows = RC.recommend(
        t.candidates(), use_similar_tags=False, use_similar_artists=False, use_deep_cuts=False, use_old_favorites=True, discovery_weight=0.0, n=10
    )
    return rows.select("username", "track_id", "weighted_score", "rank", "shown", "score_pct")


@query
def why_record(t):
    r = RC.why_recommended(t.candidates())
    return r.select(
        "username",
        "track_id",
        F.col("reasons.similar_artist.source_artist").alias("similar_source"),
        F.col("reasons.similar_artist.similarity").alias("similarity"),
        F.array_join("reasons.similar_tag.tags", "|").alias("tags"),
        F.col("reasons.similar_tag.match_count").alias("match_count"),
        F.col("reasons.deep_cut.source_artist").alias("cut_source"),
    )


@query
def display_page(t):
    return RC.display_page(t.recommended().filter("shown"))


@query
def page_counts(t):
    return RC.page_counts(t.recommended().filter("shown"))


@query
def replacements(t):
    """Every user blocks the artist of the first row and excludes the track of the second."""
    pool = t.recommended()
    blocked = pool.filter("rank = 1").select("username", "artist_name")
    excluded = pool.filter("rank = 2").select("username", "track_name", "artist_name")
    return FB.exclude_and_refill(pool, excluded, blocked).select("username", "track_id", "rank", "replacement")


@query
def serving_candidates(t):
    """Best rows of every user's serving table."""
    return R.cap(t.candidates(), ["username"], 20).select("username", "track_id", "score")


@query
def top_artists(t):
    """Ten most played artists; rows without a name go after the cut."""
    best = R.cap(t.artist_counts(), ["username"], 10, "play_count", "artist_id")
    return best.filter(F.col("artist_name").isNotNull()).select("username", "artist_id", "artist_name", "play_count")


# ---- links


@query
def link_extract(t):
    return LK.page_links(t.track_pages())


@query
def link_ids(t):
    pages = LK.page_links(t.track_pages())
    video, audio = L.video_id("youtube_url"), L.track_id("spotify_url")
    return pages.select(
        "url",
        video.alias("video_id"),
        audio.alias("track_id"),
        L.video_url(video).alias("video_url"),
        L.track_url(audio).alias("track_url"),
    )


@query
def best_link(t):
    return LK.best_links(t.link_search())


@query
def fill_links(t):
    searched = LK.link_urls(LK.best_links(t.link_search()))
    popular = t.track_search().select("track_id", "url", "pos")
    filled = LK.fill_links(t.tracks(), searched, LK.popular_version(popular), LK.page_links(t.track_pages()))
    return filled.select("track_id", "youtube_url", "spotify_url")


@query
def link_coverage(t):
    return LK.link_coverage(t.tracks(), "artist_id")


@query
def export_list(t):
    """Thirty entries; customers with a number below 100 are owners and get a hundred."""
    owners = F.col("username").cast("bigint") < 100
    return LK.export_list(t.recommended(), owners)


@query
def export_list_searched(t):
    searched = LK.best_links(t.link_search()).filter("platform = 'spotify'")
    return LK.export_list(t.recommended(), url="spotify_url", identify=L.track_id, searched=searched)


@query
def export_summary(t):
    return LK.export_summary(LK.export_list(t.recommended()))


# ---- keyed tables


@query
def upsert_plays(t):
    """Loved plays arrive again with a new url, next to plays of a new user per old one."""
    plays = K.one_per_key(t.plays(), ["username", "scrobbled_at"])
    again = plays.filter("is_loved").withColumn("track_url", F.concat("track_url", F.lit("?again")))
    moved = plays.filter("NOT is_loved").withColumn("username", F.concat(F.lit("copy "), "username"))
    merged = K.upsert_frame(plays, again.unionByName(moved), ["username", "scrobbled_at"], action="action")
    return merged.select("username", "scrobbled_at", "track_url", "track_id", "action")


@query
def exclusion_store(t):
    """The same exclusions put again a day later: rows stay, times move."""
    stored = t.excluded_tracks()
    later = stored.withColumn("excluded_at", F.col("excluded_at") + F.expr("INTERVAL 1 DAY"))
    return FB.put_exclusions(stored, later, ["username", "track_id"])


# ---- stored tables (written to a lake of their own in the shared folder)

BUCKET = ["user_bucket"]


@query
def json_landing(t):
    """Raw plays landed as JSON Lines, read back with a schema, structured."""
    lake = t.scratch_lake()
    lake.land_json(I.flatten_pages(t.history_pages()), "bronze/plays")
    raw = lake.read_json("bronze/plays", schemas.StructType(schemas.RAW_PLAY.fields + schemas.table("username string").fields))
    return I.plays_from_raw(raw)


def _awkward(number, text):
    """A name that looks like a number, a date or a path, for each number."""
    return (
        F.when(number % 5 == 0, F.concat(F.lit("00"), text))
        .when(number % 5 == 1, text)
        .when(number % 5 == 2, F.concat(F.lit("user "), text))
        .when(number % 5 == 3, F.concat(F.lit("2024-01-"), text))
        .otherwise(F.concat(text, F.lit("/x=é")))
    )


@query
def upsert_named_users(t):
    """Plays of users whose names look like numbers, dates or paths, upserted twice into partitions of such names."""
    lake = t.scratch_lake()
    number = F.col("username").cast("bigint")
    place = _awkward(number % 100, (number % 100).cast("string")).alias("place")
    rest = [c for c in t.plays().columns if c != "username"]
    named = t.plays().select(_awkward(number, F.col("username")).alias("username"), place, *rest)
    for _ in range(2):
        lake.upsert(named, "silver/plays", ["username", "scrobbled_at"], ["place"])
    return lake.read("silver/plays").select("username", "place", "scrobbled_at", "track_id")


@query
def restored_exclusions(t):
    """All exclusions stored, then those of tracks of the first brands taken back."""
    jobs = Jobs(t.scratch_lake())
    jobs.exclude_tracks(t.excluded_tracks())
    jobs.restore_tracks(t.excluded_tracks().filter(F.col("artist_name") < "Brand#2"))
    return jobs.lake.read(EXCLUDED_TRACKS).select("username", "track_id", "excluded_at")


@query
def top_stored_candidates(t):
    """Best rows of one user from a stored table."""
    lake = t.scratch_lake()
    lake.write(with_user_bucket(t.candidates()), "gold/track_candidates", "error", BUCKET)
    return lake.top_candidates("gold/track_candidates", "7", 50).select("username", "track_id", "score")


@query
def table_modes(t):
    """Partitioned write, then an append of the loved plays: rows per user."""
    lake = t.scratch_lake()
    plays = with_user_bucket(t.plays(), 16)
    lake.write(plays, "silver/plays", "error", BUCKET)
    lake.write(plays.filter("is_loved"), "silver/plays", "append", BUCKET)
    return lake.read("silver/plays").groupBy("username").agg(F.count("*").alias("plays"))


@query
def upsert_table(t):
    """Every play written once, then the loved ones again with a new url next to plays of new users."""
    lake = t.scratch_lake()
    key = ["username", "scrobbled_at"]
    lake.upsert(with_user_bucket(t.plays(), 16), "silver/plays", key, BUCKET)
    plays = K.one_per_key(t.plays(), key)
    again = plays.filter("is_loved").withColumn("track_url", F.concat("track_url", F.lit("?again")))
    moved = plays.filter("NOT is_loved").withColumn("username", F.concat(F.lit("copy "), "username"))
    lake.upsert(with_user_bucket(again.unionByName(moved), 16), "silver/plays", key, BUCKET)
    return lake.read("silver/plays").select("username", "scrobbled_at", "track_url", "track_id")


@query
def delete_played(t):
    """A stored candidate table without what was played since 1999."""
    lake = t.scratch_lake()
    cut = F.lit("1999-01-01").cast("timestamp")
    stored = C.played_tracks(t.plays().filter(F.col("scrobbled_at_utc") < cut))
    lake.write(with_user_bucket(stored, 16), "silver/stored", "error", BUCKET)
    since = C.played_tracks(t.plays().filter(F.col("scrobbled_at_utc") >= cut))
    lake.delete(with_user_bucket(since, 16), "silver/stored", ["username", "track_id"])
    return lake.read("silver/stored").select("username", "track_id")


@query
def replace_users(t):
    """Users with an excluded track get a new list (their loved tracks), the others keep theirs."""
    lake = t.scratch_lake()
    lake.write(with_user_bucket(C.played_tracks(t.plays()), 16), "gold/lists", "error", BUCKET)
    users = t.excluded_tracks().select("username").distinct()
    loved = C.played_tracks(t.plays().filter("is_loved")).join(users, "username", "left_semi")
    lake.replace_users(with_user_bucket(loved, 16), "gold/lists", with_user_bucket(users, 16), BUCKET)
    return lake.read("gold/lists").select("username", "track_id")


# ---- streams (what has landed is processed, then the stream stops)


@query
def stream_ingest(t):
    lake = t.scratch_lake()
    SP.ingest(t.event_stream(), lake, "silver/plays", lake.path("_ingest"), BUCKET).awaitTermination()
    return lake.read("silver/plays").select("username", "scrobbled_at", "track_id", "artist_name")


@query
def stream_without_repeats(t):
    lake = t.scratch_lake()
    SP.store_first_copies(t.event_stream(), lake, "silver/fresh", lake.path("_fresh"), BUCKET).awaitTermination()
    return lake.read("silver/fresh").select("username", "scrobbled_at", "track_id", "artist_name")


@query
def daily_play_windows(t):
    lake = t.scratch_lake()
    SP.store_daily_counts(t.event_stream(), lake, "gold/days", lake.path("_days")).awaitTermination()
    return lake.read("gold/days")


@query
def stream_refresh(t):
    lake = t.scratch_lake()
    stream = t.event_stream()
    run = SP.refresh_statistics(stream, lake, "silver/plays", "gold/counts", "2024-02-01 00:00:00", lake.path("_refresh"), BUCKET)
    run.awaitTermination()
    return lake.read("gold/counts").drop("user_bucket")


def _history(t):
    """Day histograms of the event stream."""
    lake = t.scratch_lake()
    SP.keep_history(t.event_stream(), lake, "silver/plays", "gold/play_days", lake.path("_history"), BUCKET).awaitTermination()
    return lake.read("gold/play_days")


@query
def stream_history_tracks(t):
    days = _history(t)
    return ST.track_counts_by_age(H.aged(days, "2024-02-01 00:00:00"), H.users_of_days(days), "2024-02-01 00:00:00")


@query
def stream_history_artists(t):
    """Artists of the events' tracks by their canonical names."""
    days = _history(t)
    artists = t.event_plays().select("track_id", "artist_name").distinct()
    artists = artists.withColumn("artist_id", T.canonical_artist_id("artist_name"))
    by_age = H.aged(days, "2024-02-01 00:00:00")
    return ST.artist_counts_by_age(by_age, H.users_of_days(days), artists, artists, "2024-02-01 00:00:00")


@query
def stream_history_users(t):
    return H.users_of_days(_history(t))
