"""Candidate generators: similar artists, shared tags, deep cuts, forgotten favourites.

Each is one plan over all users. Answers of the music service are landed tables; what belongs to the catalogue
(canonical ids, best album per track, quality filters) is done once on those tables before users are joined, and stored.

What a catalogue makes of a user is many times what the user brings. So users' sources and played tracks are dealt by user,
the catalogue comes to them, and the rows it makes stay in that partition up to the result: they are not exchanged.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake import schemas
from listenlake import settings as S
from listenlake.functions.recency import MIN_HALF_LIFE_DAYS, decay_2, instant, whole_days
from listenlake.functions.text import canonical_track_id, split_tags
from listenlake.operators.keyed import best_per_key, by_user, catalogue_join, delete_frame, expanded, join_spread, told, user_tasks, without_by_user
from listenlake.operators.ranking import cap, sample_large
from listenlake.operators.statistics import plays_per_artist
from listenlake.sources.shared import stored


def played_tracks(plays: DataFrame) -> DataFrame:
    """User and track of what was played. ``plays`` may be the facts or the gold track counts, which are shorter."""
    return plays.select("username", "track_id").distinct()


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    """Entries of a service's answer up to a place."""
    return df if limit is None else df.filter(F.col("pos") <= limit)


def user_artists(
    plays: DataFrame, tracks: DataFrame, artists: DataFrame, artist_counts: DataFrame | None = None
) -> DataFrame:
    """Artists a user has played, with name, tags and play count. Counts come from the gold table when there is one."""
    counts = plays_per_artist(plays, tracks) if artist_counts is None else artist_counts
    counts = counts.filter(F.col("artist_id").isNotNull()).select("username", "artist_id", "play_count")
    names = artists.filter(F.col("artist_name").isNotNull()).select("artist_id", "artist_name", "tags")
    return counts.join(names, "artist_id")


def _numbered(catalogue: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue, stored, with a number for each track in place of its long id, and the stored tracks and numbers;
    ``listings`` tells under how many values of ``key`` a track stands."""
    listed = stored(catalogue)
    tracks = listed.groupBy("track_id").agg(F.count_distinct(key).alias("listings"))
    tracks = stored(tracks.withColumn("number", F.monotonically_increasing_id()))
    return stored(listed.join(tracks.select("track_id", "number"), listed["track_id"].eqNullSafe(tracks["track_id"])).drop(tracks["track_id"])), tracks


def _played_numbers(plays: DataFrame, numbers: DataFrame, tasks: int) -> DataFrame:
    """User and number of the tracks of a catalogue that were played, in the partition of the user. Other tracks can't match."""
    known = numbers.filter(F.col("track_id").isNotNull()).select("track_id", "number")
    return by_user(plays.select("username", "track_id").join(told(known), "track_id").select("username", "number"), tasks)


def _not_processed(sources: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Sources (user, artist) that no stored candidate came from yet."""
    if previous is None:
        return sources
    done = previous.select("username", F.col("source_artist_id").alias("artist_id")).distinct()
    return sources.join(done, ["username", "artist_id"], "left_anti")


# ---- similar artists -------------------------------------------------------------------------------------------


def similar_artist_sources(
    artists_played: DataFrame,
    previous: DataFrame | None = None,
    sample_above: int | None = None,
    artist_sample_rate: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Played artists that no stored candidate came from. Nothing is sampled unless ``sample_above`` asks for it."""
    todo = _not_processed(artists_played.select("username", "artist_id", "artist_name", "play_count"), previous)
    return todo if sample_above is None else sample_large(todo, "artist_id", sample_above, artist_sample_rate, seed)


def similar_artist_paths(
    sources: DataFrame,
    similar_artists: DataFrame,
    similarity_threshold: float = S.SIMILARITY_THRESHOLD,
    similar_per_artist: int | None = S.SIMILAR_ARTISTS_PER_ARTIST,
    tasks: int | None = None,
) -> DataFrame:
    """Best source per user and similar artist, in the partition of the user.

    The score of a track is ``match * user plays * track plays``. The first two factors do not depend on the track,
    so the best source of a similar artist is chosen before the tracks are joined; ``paths`` keeps how many there
    were. This makes the expansion as large as (users x similar artists x 50) instead of 20 times that.
    """
    tasks = user_tasks(sources) if tasks is None else tasks
    edges = _first(similar_artists, similar_per_artist).filter(
        (F.col("match") <= similarity_threshold)
        & F.col("similar_name").isNotNull()
        & (F.col("similar_name") != "")
    ).select("artist_name", "similar_name", "match")
    paths = expanded(by_user(sources, tasks), stored(edges), "artist_name", tasks).withColumn("weight", F.col("match") * F.col("play_count"))
    best = F.min_by(F.struct("match", "weight", "artist_id"), F.struct(-F.col("weight"), F.col("artist_id")))
    return (
        paths.groupBy("username", "similar_name")
        .agg(best.alias("best"), F.count("*").alias("paths"))
        .select(
            "username",
            "similar_name",
            F.col("best.match").alias("similarity"),
            F.col("best.weight").alias("weight"),
            F.col("best.artist_id").alias("source_artist_id"),
            "paths",
        )
    )


def _artist_top_tracks(artist_top_tracks: DataFrame, top_tracks_per_artist: int | None) -> DataFrame:
    artist = F.coalesce("track_artist", "artist_name")
    return _first(artist_top_tracks, top_tracks_per_artist).select(
        F.col("artist_name").alias("similar_name"),
        "track_name",
        artist.alias("artist_name"),
        F.coalesce("listeners", F.lit(0)).alias("listeners"),
        F.coalesce("playcount", F.lit(0)).alias("playcount"),
        canonical_track_id("track_name", artist).alias("track_id"),
    )


def _best_versions(top_tracks: DataFrame) -> DataFrame:
    """One row per similar artist and track: of several versions the one with most plays scores best for everyone."""
    order = F.struct(-F.col("playcount"), F.col("track_name"), F.col("artist_name"))
    best = F.min_by(F.struct("track_name", "artist_name", "playcount"), order)
    return top_tracks.groupBy("similar_name", "track_id").agg(best.alias("v")).select("similar_name", "track_id", "v.*")


def similar_artist_candidates(
    plays: DataFrame,
    sources: DataFrame,
    similar_artists: DataFrame,
    artist_top_tracks: DataFrame,
    min_listeners: int = S.MIN_LISTENERS,
    similarity_threshold: float = S.SIMILARITY_THRESHOLD,
    similar_per_artist: int | None = S.SIMILAR_ARTISTS_PER_ARTIST,
    top_tracks_per_artist: int | None = S.TOP_TRACKS_PER_ARTIST,
) -> DataFrame:
    """Unplayed top tracks of artists similar to the played ones; per user and track the best score.

    Where each track of the catalogue stands under one similar artist, a user meets it once and there is nothing to choose.
    """
    tasks = user_tasks(plays)
    paths = similar_artist_paths(sources, similar_artists, similarity_threshold, similar_per_artist, tasks)
    tracks = _artist_top_tracks(artist_top_tracks, top_tracks_per_artist).filter(F.col("listeners") >= min_listeners)
    versions, numbers = _numbered(_best_versions(tracks), "similar_name")
    found = expanded(paths, versions, "similar_name", tasks).withColumn("score", F.col("weight") * F.col("playcount"))
    fresh = without_by_user(found, _played_numbers(plays, numbers, tasks), ["username", "number"])
    if not numbers.filter("listings > 1").isEmpty():
        order = [F.col("score").desc(), F.col("source_artist_id"), F.col("track_name"), F.col("artist_name")]
        fresh = best_per_key(fresh, ["username", "track_id"], order)
    return fresh.select(*schemas.CANDIDATE_SIMILAR_ARTIST.names)


def similar_artist_funnel(
    plays: DataFrame,
    sources: DataFrame,
    similar_artists: DataFrame,
    artist_top_tracks: DataFrame,
    min_listeners: int = S.MIN_LISTENERS,
    similarity_threshold: float = S.SIMILARITY_THRESHOLD,
    similar_per_artist: int | None = S.SIMILAR_ARTISTS_PER_ARTIST,
    top_tracks_per_artist: int | None = S.TOP_TRACKS_PER_ARTIST,
) -> DataFrame:
    """Per user: answers examined, dropped for few listeners, dropped as played, kept (before the dedup).

    An answer counts alike for everyone but for having been played. So what a similar artist brings is added up once for
    the catalogue, and only a user's played tracks are looked up among the answers.
    """
    tasks = user_tasks(plays)
    paths = similar_artist_paths(sources, similar_artists, similarity_threshold, similar_per_artist, tasks)
    few = F.col("listeners") < min_listeners
    answers = _artist_top_tracks(artist_top_tracks, top_tracks_per_artist).groupBy("similar_name", "track_id").agg(
        F.count("*").alias("n"), F.count_if(few).alias("few")
    )
    return _user_funnel(plays, paths.select("username", "similar_name", "paths"), answers, "similar_name", tasks).withColumnRenamed(
        "below_threshold", "few_listeners"
    )


# ---- shared tags -----------------------------------------------------------------------------------------------


def tag_profile(plays: DataFrame, tracks: DataFrame, artists: DataFrame, top: int = S.TOP_TAGS) -> DataFrame:
    """Most frequent tags per user, counted once per played track.

    Tracks are counted per user and artist before tags are unfolded, and from there on all is in the partition of the user.
    """
    artist_ids = played_tracks(plays).join(tracks.select("track_id", "artist_id"), "track_id").select("username", "artist_id")
    per_artist = by_user(artist_ids, user_tasks(plays)).groupBy("username", "artist_id").agg(F.count("*").alias("n"))
    tagged = artists.filter(F.col("tags").isNotNull() & (F.col("tags") != ""))
    tags = tagged.select("artist_id", F.explode(split_tags("tags")).alias("tag"))
    counts = per_artist.join(tags, "artist_id").groupBy("username", "tag").agg(F.sum("n").alias("tag_count"))
    return cap(counts, ["username"], top, "tag_count", "tag")


def tag_gate(profile: DataFrame, previous: DataFrame, min_share: float = S.MIN_NEW_TAG_SHARE) -> DataFrame:
    """Per user: tags in the profile, tags no stored candidate was made from, and whether that share asks for a new
    run. A user without stored candidates has only new tags; a user without a profile does not occur."""
    done = previous.select("username", F.explode(split_tags("source_tags")).alias("tag")).distinct()
    marked = profile.join(done.withColumn("done", F.lit(True)), ["username", "tag"], "left")
    fresh = F.count_if(F.col("done").isNull())
    return marked.groupBy("username").agg(
        F.count("*").alias("tags"),
        fresh.alias("new_tags"),
        (fresh / F.count("*") >= min_share).alias("run"),
    )


TAGS_PER_WORD = 62
#: So many entries (a track under a tag) are told to every task, 8 bytes each; a longer catalogue is joined by tag.
TAG_ENTRIES = 20_000_000
PLAYED = -1  # the place among a user's tags at which the played tracks stand


def tag_catalogue(tag_top_tracks: DataFrame, tracks_per_tag: int | None, min_tag_matches: int) -> DataFrame:
    """One row per listed track: track_id, names, tags. A track under fewer tags than must match can't qualify for anyone."""
    artist = F.coalesce("artist_name", F.lit(""))
    named = _first(tag_top_tracks, tracks_per_tag).select("tag", "track_name", artist.alias("artist_name"))
    spelled = named.groupBy("track_name", "artist_name").agg(F.collect_set("tag").alias("tags"))
    spelled = spelled.withColumn("track_id", canonical_track_id("track_name", "artist_name"))
    listed = spelled.groupBy("track_id").agg(
        F.min(F.struct("track_name", "artist_name")).alias("names"),
        F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"),
    )
    return listed.filter(F.size("tags") >= min_tag_matches)


def _word_columns(words: list[str]) -> list[Column]:
    bit = F.expr(f"shiftleft(1L, place % {TAGS_PER_WORD})")
    in_word = F.floor(F.col("place") / TAGS_PER_WORD)
    return [F.bit_or(F.when(in_word == i, bit).otherwise(F.lit(0))).alias(w) for i, w in enumerate(words)]


def _matches_by_user(user_tags: DataFrame, plays: DataFrame, listed: DataFrame, words: list[str], least: int, tasks: int) -> DataFrame:
    """Matches where the catalogue is told to every task: a user's tags are unfolded, looked up and counted in the partition
    of the user, so no row of the expansion is exchanged. The tracks a user has played stand among the tags as one more
    list; a track that is on it is dropped by the same count. A user has at most the profile's tags and, of the played
    tracks, those of the catalogue, so no user is too large for a partition; ``tasks`` says how many partitions there are."""
    heard = _played_numbers(plays, listed, tasks).groupBy("username").agg(F.collect_set("number").alias("heard"))
    users = user_tags.join(heard.hint("shuffle_hash"), "username", "left")
    lists = F.transform("user_tags", lambda t, i: F.struct(i.alias("place"), t.alias("tag"), F.lit(None).cast("array<bigint>").alias("heard")))
    own = F.struct(F.lit(PLAYED).alias("place"), F.lit(None).cast("string").alias("tag"), F.col("heard"))
    rows = users.select("username", F.inline(F.concat(lists, F.array(own))))
    entries = listed.select(F.explode("tags").alias("tag"), "number").groupBy("tag").agg(F.collect_list("number").alias("listed"))
    rows = rows.join(F.broadcast(entries), "tag", "left").select("username", "place", F.explode(F.coalesce("listed", "heard")).alias("number"))
    matches = rows.groupBy("username", "number").agg(
        *_word_columns(words), F.count("*").alias("tag_match_count"), F.min("place").alias("first_place")
    )
    matches = matches.filter((F.col("tag_match_count") >= least) & (F.col("first_place") != PLAYED)).drop("first_place")
    named = matches.join(user_tags.hint("shuffle_hash"), "username")
    return named.join(told(listed.select("number", "track_id", "names")), "number")


def _matches_by_tag(user_tags: DataFrame, plays: DataFrame, listed: DataFrame, words: list[str], least: int, tasks: int) -> DataFrame:
    """Matches by a salted join on the tag and an exchange of all it makes, for catalogues of any size. Spark deals the rows."""
    numbered = user_tags.select("username", F.posexplode("user_tags").alias("place", "tag"))
    found = catalogue_join(numbered, listed.select("track_id", F.explode("tags").alias("tag")), "tag")
    matches = found.groupBy("username", "track_id").agg(*_word_columns(words), F.count("*").alias("tag_match_count"))
    fresh = delete_frame(matches.filter(F.col("tag_match_count") >= least), played_tracks(plays), ["username", "track_id"])
    # Nothing is grouped by user after this join, so Spark may split a hot user's rows, or broadcast the tag lists.
    return fresh.join(user_tags, "username").join(listed.select("track_id", "names"), "track_id")


def similar_tag_candidates(
    plays: DataFrame,
    profile: DataFrame,
    tag_top_tracks: DataFrame,
    tracks_per_tag: int = S.TRACKS_PER_TAG,
    min_tag_matches: int = S.MIN_TAG_MATCHES,
    previous: DataFrame | None = None,
    top_tags_count: int = S.TOP_TAGS,
    most_entries: int = TAG_ENTRIES,
) -> DataFrame:
    """Unplayed tracks listed under at least ``min_tag_matches`` tags of the user; the score is that number.

    A track listed twice under one tag counts once. With ``previous`` candidates, users whose profile has hardly
    changed are left out.

    The catalogue is stored once with a number for each track and its entries are counted; up to ``most_entries`` it goes to
    every task, and the count of matches takes place where the user's tags are. The tags of a user are numbered, and the
    tags a track matched are or-ed into bit words, so the large aggregate holds a few integers instead of lists of text.
    Names and tags are put back on what is left.
    """
    if previous is not None:
        run = tag_gate(profile, previous).filter("run").select("username")
        profile = profile.join(run, "username", "left_semi")
    # The sorted tags of a user serve twice: their places number the tags, and they put the matched tags back. They are one
    # short row a user, stored so that the profile is made once.
    tasks = user_tasks(plays)
    profile = cap(profile, ["username"], top_tags_count, "tag_count", "tag")
    user_tags = by_user(stored(profile.groupBy("username").agg(F.sort_array(F.collect_list("tag")).alias("user_tags"))), tasks)

    listed = stored(tag_catalogue(tag_top_tracks, tracks_per_tag, min_tag_matches).withColumn("number", F.monotonically_increasing_id()))
    entries = listed.agg(F.sum(F.size("tags"))).first()[0] or 0
    words = [f"word{i}" for i in range(-(-top_tags_count // TAGS_PER_WORD))]
    make = _matches_by_user if entries <= most_entries else _matches_by_tag
    labelled = make(user_tags, plays, listed, words, min_tag_matches, tasks)
    matched_tags = F.expr(
        f"filter(user_tags, (t, i) -> getbit(array({', '.join(words)})[CAST(i DIV {TAGS_PER_WORD} AS INT)], i % {TAGS_PER_WORD}) = 1)"
    )
    return labelled.select(
        "username",
        "track_id",
        "names.track_name",
        "names.artist_name",
        "tag_match_count",
        F.col("tag_match_count").cast("double").alias("score"),
        F.array_join(matched_tags, ",").alias("source_tags"),
    )


def _user_funnel(plays: DataFrame, paths: DataFrame, answers: DataFrame, key: str, tasks: int) -> DataFrame:
    """Per user: how many answers were examined, dropped by a threshold, dropped as played, kept. ``paths`` are the keys of a
    user, in the partition of the user, and how often each counts; ``answers`` are rows of the catalogue with the number of
    answers (``n``) and how many of them are below the threshold (``few``).

    All but the played ones follow from the sums of a key; a user's rows are not unfolded into the catalogue.
    """
    answers, numbers = _numbered(answers, key)
    sums = stored(answers.groupBy(key).agg(F.sum("n").alias("n"), F.sum("few").alias("few")))
    enough = answers.filter("n > few").select("number", F.col(key), (F.col("n") - F.col("few")).alias("enough"))
    heard = _played_numbers(plays, numbers, tasks).distinct()
    heard = expanded(heard, stored(enough), "number", tasks).groupBy("username", key).agg(F.sum("enough").alias("heard"))
    rows = expanded(paths, sums, key, tasks).join(heard.hint("shuffle_hash"), ["username", key], "left")
    times = F.col("paths")
    seen = F.coalesce("heard", F.lit(0))
    return rows.groupBy("username").agg(
        F.sum(times * F.col("n")).alias("examined"),
        F.sum(times * F.col("few")).alias("below_threshold"),
        F.sum(times * seen).alias("already_played"),
        F.sum(times * (F.col("n") - F.col("few") - seen)).alias("kept"),
    )


def similar_tag_funnel(
    plays: DataFrame,
    profile: DataFrame,
    tag_top_tracks: DataFrame,
    tracks_per_tag: int | None = S.TRACKS_PER_TAG,
    min_tag_matches: int = S.MIN_TAG_MATCHES,
) -> DataFrame:
    """Per user: tracks listed under a tag of the profile, dropped for few tags, dropped as played, kept."""
    tasks = user_tasks(plays)
    artist = F.coalesce("artist_name", F.lit(""))
    listed = _first(tag_top_tracks, tracks_per_tag).select("tag", canonical_track_id("track_name", artist).alias("track_id"))
    answers, numbers = _numbered(listed.distinct(), "tag")
    found = expanded(by_user(profile.select("username", "tag"), tasks), answers.select("tag", "number"), "tag", tasks)
    matches = found.groupBy("username", "number").agg(F.count("*").alias("tags"))
    played = _played_numbers(plays, numbers, tasks).distinct().withColumn("played", F.lit(True))
    marked = matches.join(played.hint("shuffle_hash"), ["username", "number"], "left")
    few, seen = F.col("tags") < min_tag_matches, F.coalesce("played", F.lit(False))
    return marked.groupBy("username").agg(
        F.count("*").alias("examined"),
        F.count_if(few).alias("below_threshold"),
        F.count_if(~few & seen).alias("already_played"),
        F.count_if(~few & ~seen).alias("kept"),
    )


# ---- deep cuts -------------------------------------------------------------------------------------------------


def deep_cut_sources(
    artists_played: DataFrame,
    previous: DataFrame | None = None,
    top_artists_count: int = S.DEEP_CUT_TOP_ARTISTS,
    sample_above: int | None = None,
    sample_rate: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """A user's most played artists that no stored candidate came from. Sampled only if ``sample_above`` asks for it."""
    top = cap(
        artists_played.select("username", "artist_id", "artist_name", "play_count"),
        ["username"],
        top_artists_count,
        "play_count",
        "artist_id",
    )
    todo = _not_processed(top, previous)
    return todo if sample_above is None else sample_large(todo, "artist_id", sample_above, sample_rate, seed)


def album_catalogue(
    artist_top_albums: DataFrame,
    album_tracks: DataFrame,
    min_listeners: int = S.DEEP_CUT_MIN_LISTENERS,
    albums_per_artist: int | None = S.ALBUMS_PER_ARTIST,
    albums_kept: int | None = S.ALBUMS_KEPT,
) -> DataFrame:
    """Tracks on the kept albums of each artist, with the plays of the best album a track is on.

    The score is ``user plays * album plays``, so the best album of a track is the same for every user and is chosen
    here, once.
    """
    kept = _first(artist_top_albums, albums_per_artist).filter(
        (F.coalesce("playcount", F.lit(0)) >= min_listeners)
        & F.col("album_name").isNotNull()
        & (F.col("album_name") != "")
    )
    if albums_kept is not None:
        kept = best_per_key(kept, ["artist_name"], [F.col("pos"), F.col("album_name")], albums_kept)
    # The catalogue's names are many times the file they come from, which Spark would broadcast by its size.
    entries = album_tracks.select("artist_name", "album_name", "track_name").hint("merge")
    listed = kept.select("artist_name", "album_name", "playcount").join(entries, ["artist_name", "album_name"])
    listed = listed.withColumn("track_id", canonical_track_id("track_name", "artist_name"))
    return listed.groupBy("artist_name", "track_id").agg(
        F.max("playcount").alias("album_playcount"),
        F.max_by("track_name", F.struct("playcount", "track_name")).alias("track_name"),
        F.count("*").alias("listings"),
    )


def deep_cut_candidates(plays: DataFrame, sources: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Unplayed album tracks of the user's top artists.

    Where each track stands under one artist and albums have plays, the best source of a track is the best one of its
    artist's name, which is chosen before the tracks are joined; then a user meets a track once.
    """
    tasks = user_tasks(plays)
    catalogue, numbers = _numbered(catalogue, "artist_name")
    sources = by_user(sources, tasks)
    once = numbers.filter("listings > 1").isEmpty() and catalogue.filter("album_playcount IS NULL OR album_playcount <= 0").isEmpty()
    if once:
        sources = best_per_key(sources, ["username", "artist_name"], [F.col("play_count").desc(), F.col("artist_id")])
    found = expanded(sources, catalogue, "artist_name", tasks).withColumn(
        "score", (F.col("play_count") * F.col("album_playcount")).cast("double")
    )
    fresh = without_by_user(found, _played_numbers(plays, numbers, tasks), ["username", "number"])
    fresh = fresh.withColumnRenamed("artist_id", "source_artist_id")
    if not once:
        order = [F.col("score").desc(), F.col("source_artist_id"), F.col("track_name"), F.col("artist_name")]
        fresh = best_per_key(fresh, ["username", "track_id"], order)
    return fresh.select(*schemas.CANDIDATE_DEEP_CUT.names)


def deep_cut_funnel(plays: DataFrame, sources: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per user: album listings examined, dropped as played, kept (before the dedup)."""
    tasks = user_tasks(plays)
    paths = by_user(sources.select("username", "artist_name"), tasks).groupBy("username", "artist_name").agg(F.count("*").alias("paths"))
    answers = catalogue.select("artist_name", "track_id", F.col("listings").alias("n"), F.lit(0).cast("bigint").alias("few"))
    return _user_funnel(plays, paths, answers, "artist_name", tasks).drop("below_threshold")


# ---- forgotten favourites --------------------------------------------------------------------------------------


def old_favorites(
    plays: DataFrame,
    as_of: datetime | str | Column,
    half_lives: DataFrame | None = None,
    min_days_since_last_play: int = S.MIN_DAYS_SINCE_LAST_PLAY,
    max_candidates: int = S.MAX_OLD_FAVORITES,
) -> DataFrame:
    """Tracks not played for a while: ``plays * 2^(-days/half-life)``, best ones per user."""
    now = instant(as_of)
    stats = plays.groupBy("username", "track_id").agg(
        F.count("*").alias("play_count"), F.max("scrobbled_at_utc").alias("last_played_at")
    )
    stats = stats.withColumn("days_since_last_play", whole_days(F.col("last_played_at"), now))
    stats = stats.filter(F.col("days_since_last_play") >= min_days_since_last_play)
    half_life = F.lit(MIN_HALF_LIFE_DAYS)
    if half_lives is not None:
        users = half_lives.select("username", "user_half_life_days")
        stats = join_spread(stats, users, "username", F.col("track_id"), "left")
        half_life = F.coalesce("user_half_life_days", half_life)
    scored = stats.withColumn("score", F.col("play_count") * decay_2(F.col("days_since_last_play"), half_life))
    return cap(scored, ["username"], max_candidates).select(*schemas.CANDIDATE_OLD_FAVORITES.names)
