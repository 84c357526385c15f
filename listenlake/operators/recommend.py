"""From merged candidates to a list: source choice, exclusions, discovery weight, artist cap, pool, reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.text import split_tags
from listenlake.operators.keyed import best_per_key
from listenlake.operators.ranking import cap, share_of_best
from listenlake.settings import POOL_FACTOR, RECOMMENDATIONS, SONGS_PER_ARTIST


def chosen_sources(similar_tags: bool, similar_artists: bool, deep_cuts: bool, old_favorites: bool = False) -> Column:
    """Row is of a chosen source; without a choice no row is."""
    flags = {
        "similar_tag": similar_tags,
        "similar_artist": similar_artists,
        "deep_cut_same_artist": deep_cuts,
        "old_favorite": old_favorites,
    }
    return reduce(lambda a, b: a | b, [F.col(c) for c, on in flags.items() if on], F.lit(False))


def without_excluded(
    candidates: DataFrame, excluded_tracks: DataFrame | None = None, excluded_artists: DataFrame | None = None
) -> DataFrame:
    """Drop what the user has excluded: artists by name, tracks by track and artist name. Ids play no part, so another
    spelling with the same id stays. Only the user's own exclusions count; they are few and are looked up, so that candidates
    are not sorted for it, nor exchanged where both lie by user."""
    if excluded_artists is not None:
        artist_keys = ["username", "artist_name"]
        candidates = candidates.join(excluded_artists.select(artist_keys).distinct().hint("shuffle_hash"), artist_keys, "left_anti")
    if excluded_tracks is not None:
        track_keys = ["username", "track_name", "artist_name"]
        candidates = candidates.join(excluded_tracks.select(track_keys).distinct().hint("shuffle_hash"), track_keys, "left_anti")
    return candidates


def discovery_weighted(candidates: DataFrame, discovery_weight: float) -> DataFrame:
    """0 favours old favourites, 1 favours discoveries."""
    factor = F.when(F.col("old_favorite"), F.lit(1.1) - F.lit(float(discovery_weight))).otherwise(
        F.lit(0.1) + F.lit(float(discovery_weight))
    )
    return candidates.withColumn("weighted_score", F.col("score") * factor)


def filter_candidates(
    candidates: DataFrame,
    use_similar_tags: bool = True,
    use_similar_artists: bool = True,
    use_deep_cuts: bool = True,
    discovery_weight: float = 0.5,
    excluded_tracks: DataFrame | None = None,
    excluded_artists: DataFrame | None = None,
    use_old_favorites: bool = False,
) -> DataFrame:
    """Candidates of the chosen sources without exclusions, with ``weighted_score``."""
    rows = candidates.filter(chosen_sources(use_similar_tags, use_similar_artists, use_deep_cuts, use_old_favorites))
    return discovery_weighted(without_excluded(rows, excluded_tracks, excluded_artists), discovery_weight)


def artist_cap(candidates: DataFrame, max_songs_per_artist: int = SONGS_PER_ARTIST) -> DataFrame:
    """Best rows per user and artist."""
    return cap(candidates, ["username", "artist_name"], max_songs_per_artist, "weighted_score")


def ranked_pool(candidates: DataFrame, n: int = RECOMMENDATIONS, pool_factor: int = POOL_FACTOR) -> DataFrame:
    """Best ``n * pool_factor`` rows per user with ``rank``; ranks up to ``n`` are the list, the rest is the pool
    replacements come from. One plan serves both."""
    best = cap(candidates, ["username"], n * pool_factor, "weighted_score")
    w = Window.partitionBy("username").orderBy(F.col("weighted_score").desc_nulls_last(), F.col("track_id"))
    return best.withColumn("rank", F.row_number().over(w)).withColumn("shown", F.col("rank") <= n)


def recommend(
    candidates: DataFrame,
    excluded_tracks: DataFrame | None = None,
    excluded_artists: DataFrame | None = None,
    *,
    use_similar_tags: bool = True,
    use_similar_artists: bool = True,
    use_deep_cuts: bool = True,
    use_old_favorites: bool = False,
    discovery_weight: float = 0.5,
    max_songs_per_artist: int = SONGS_PER_ARTIST,
    n: int = RECOMMENDATIONS,
    pool_factor: int = POOL_FACTOR,
) -> DataFrame:
    """List and replacement pool per user, with the score as percentage of the user's best."""
    rows = filter_candidates(
        candidates,
        use_similar_tags,
        use_similar_artists,
        use_deep_cuts,
        discovery_weight,
        excluded_tracks,
        excluded_artists,
        use_old_favorites,
    )
    return share_of_best(ranked_pool(artist_cap(rows, max_songs_per_artist), n, pool_factor))


def why_recommended(candidates: DataFrame) -> DataFrame:
    """Struct per source that names a reason, NULL otherwise; first five distinct tags in their order."""

    def present(column: str) -> Column:
        return F.col(column).isNotNull() & (F.col(column) != "")

    artist = F.struct(
        F.col("why_similar_artist_name").alias("source_artist"),
        F.coalesce("why_similar_artist_pct", F.lit(0.0)).alias("similarity"),
    )
    tags = F.slice(F.array_distinct(split_tags("why_similar_tags")), 1, 5)
    tag = F.struct(tags.alias("tags"), F.coalesce("why_tag_match_count", F.lit(0)).alias("match_count"))
    cut = F.struct(F.col("why_deep_cut_artist").alias("source_artist"))
    reasons = F.struct(
        F.when(present("why_similar_artist_name"), artist).alias("similar_artist"),
        F.when(present("why_similar_tags"), tag).alias("similar_tag"),
        F.when(present("why_deep_cut_artist"), cut).alias("deep_cut"),
    )
    return candidates.withColumn("reasons", reasons)


def display_page(shown: DataFrame) -> DataFrame:
    """One line per spelled track and artist, the best score of it."""
    columns = ["username", "track_name", "artist_name"]
    order = [F.col("weighted_score").desc_nulls_last(), F.col("track_id")]
    return best_per_key(shown, columns, order).select(
        *columns, "score_pct", "old_favorite", "similar_artist", "similar_tag", "deep_cut_same_artist"
    )


def page_counts(shown: DataFrame) -> DataFrame:
    """Tracks, new discoveries and old favourites on a user's page."""
    return shown.groupBy("username").agg(
        F.count("*").alias("tracks"),
        F.count_if(~F.col("old_favorite")).alias("discoveries"),
        F.count_if("old_favorite").alias("old_favorites"),
    )
