"""The jobs of the lake in their order: ingest, dimensions, statistics, candidates, merge, recommendation.

Each job reads stored tables, runs one plan for all users and writes one table. A job without input reports
``skipped`` instead of failing.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake import schemas
from listenlake.operators import dimensions as D
from listenlake.operators import ingest as I
from listenlake.operators import linking as LK
from listenlake.operators import statistics as ST
from listenlake.operators.recommend import recommend
from listenlake.plans import candidates as C
from listenlake.plans.merge import merge_candidates
from listenlake.sources.lake import Lake, WriteReport
from listenlake.streaming.plays import placed

PLAYS, TRACKS, ARTISTS, USERS = "silver/plays", "silver/tracks", "silver/artists", "silver/dim_users"
TRACK_COUNTS, ARTIST_COUNTS, STATS = "gold/track_play_count", "gold/artist_play_count", "gold/user_stats"
SIMILAR_ARTIST, SIMILAR_TAG = "silver/candidate_similar_artist", "silver/candidate_similar_tag"
DEEP_CUT, OLD_FAVORITES = "silver/candidate_deep_cut", "silver/candidate_old_favorites"
CANDIDATES = "gold/track_candidates"
EXCLUDED_TRACKS, EXCLUDED_ARTISTS = "gold/excluded_tracks", "gold/excluded_artists"
REJECTED_PAGES = "bronze/pages__rejects"
MEMBER_BUCKETS = 64


class Jobs:
    """Tables of users are partitioned by ``partition_by``, by default the bucket of the user; with few users by
    ``username``."""

    def __init__(self, lake: Lake, partition_by: Sequence[str] = ("user_bucket",)):
        self.lake, self.partition_by = lake, list(partition_by)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return placed(rows, self.partition_by)

    def _write(self, rows: DataFrame, name: str) -> WriteReport:
        return self.lake.write(self._placed(rows), name, partition_by=self.partition_by)

    def _upsert(self, rows: DataFrame, name: str, keys: Sequence[str]) -> WriteReport:
        return self.lake.upsert(self._placed(rows), name, keys, self.partition_by)

    def _upsert_member(self, rows: DataFrame, name: str, key: str) -> WriteReport:
        """Dimension rows, in buckets of their key, so that a few new members rewrite a few buckets."""
        bucket = F.pmod(F.xxhash64(key), F.lit(MEMBER_BUCKETS)).cast("int")
        return self.lake.upsert(rows.withColumn("member_bucket", bucket), name, [key], ["member_bucket"])

    def _skipped(self, name: str, reason: str) -> WriteReport:
        return WriteReport(self.lake.path(name), skipped=True, reason=reason)

    def _table(self, name: str, schema) -> DataFrame:
        return self.lake.read_or_empty(name, schema)

    # ---- silver

    def ingest_plays(self, raw: DataFrame, username: str | None = None) -> WriteReport:
        report = self._upsert(I.plays_from_raw(raw, username), PLAYS, ["username", "scrobbled_at"])
        if report.rows == 0:
            report.skipped, report.reason = True, "no plays in the time range"
        return report

    def land_day(self, plays: DataFrame, username: str, day: str) -> WriteReport:
        """One user's raw plays of one day as a landed partition; a day without plays is skipped and leaves no file."""
        name = f"bronze/plays/username={username}/date={day}"
        if plays.isEmpty():
            return self._skipped(name, "no plays in the time range")
        return self.lake.land_json(plays, name)

    def ingest_pages(self, pages: DataFrame, username: str | None = None) -> WriteReport:
        """Landed history pages: what can be read is ingested, pages that can't are kept in a table of rejects."""
        broken = I.malformed_pages(pages)
        count = broken.count()
        if count:
            self.lake.write(broken, REJECTED_PAGES, "append")
        report = self.ingest_plays(I.flatten_pages(pages), username)
        report.rejected += count
        return report

    def backfill(self, raw: DataFrame, start: str, end: str, username: str | None = None) -> tuple[WriteReport, DataFrame]:
        """Ingests the raw plays of a range of days, both ends included; the report and the summary per user."""
        plays = I.plays_from_raw(raw, username)
        last = F.date_add(F.lit(str(end)).cast("date"), 1)
        inside = plays.filter(
            (F.col("scrobbled_at_utc") >= F.lit(str(start)).cast("date")) & (F.col("scrobbled_at_utc") < last)
        )
        report = self._upsert(inside, PLAYS, ["username", "scrobbled_at"])
        if report.rows == 0:
            report.skipped, report.reason = True, "no plays in the time range"
        return report, I.backfill_summary(self._table(PLAYS, schemas.PLAYS), start, end)

    def refresh_users(self, users: DataFrame, as_of: datetime | str) -> None:
        """Recomputes dimension, track counts and artist counts of some users from the stored plays."""
        users = self._placed(users.select("username").distinct())
        theirs = self.lake.read_partitions(PLAYS, users).join(users.select("username"), "username", "left_semi")
        who = D.dim_users(theirs)
        tables = {USERS: who, TRACK_COUNTS: ST.track_play_counts(theirs, who, as_of)}
        if self.lake.exists(TRACKS) and self.lake.exists(ARTISTS):
            tables[ARTIST_COUNTS] = ST.artist_play_counts(theirs, who, self.lake.read(TRACKS), self.lake.read(ARTISTS), as_of)
        for name, rows in tables.items():
            self.lake.replace_users(self._placed(rows), name, users, self.partition_by)

    def enrich_links(self, searched: DataFrame, track_search: DataFrame, pages: DataFrame) -> WriteReport:
        """Puts links found by search and on landed pages into the tracks table; known links stay where none is found."""
        if not self.lake.exists(TRACKS):
            return self._skipped(TRACKS, "no tracks yet")
        tracks = self.lake.read(TRACKS)
        found = LK.link_urls(LK.best_links(searched))
        filled = LK.fill_links(tracks, found, LK.popular_version(track_search), LK.page_links(pages))
        changed = filled.select(*tracks.columns).exceptAll(tracks)
        return self.lake.upsert(changed, TRACKS, ["track_id"], self.lake.table(TRACKS).partition_by)

    def upsert_tracks(self, raw: DataFrame) -> WriteReport:
        return self._upsert_member(D.dedup_tracks(I.tracks_from_raw(raw)), TRACKS, "track_id")

    def upsert_artists(self, raw: DataFrame, **limits) -> WriteReport:
        rows = D.known_artists(D.dedup_artists(I.artists_from_raw(raw)), **limits)
        return self._upsert_member(rows, ARTISTS, "artist_id")

    def missing_tracks(self) -> DataFrame:
        candidates = self._table(CANDIDATES, schemas.TRACK_CANDIDATES) if self.lake.exists(CANDIDATES) else None
        return D.new_tracks(self._table(PLAYS, schemas.PLAYS), self._table(TRACKS, schemas.TRACKS), candidates)

    def missing_artists(self) -> DataFrame:
        return D.new_artists(self._table(PLAYS, schemas.PLAYS), self._table(ARTISTS, schemas.ARTISTS))

    def compute_users(self) -> WriteReport:
        if not self.lake.exists(PLAYS):
            return self._skipped(USERS, "no plays yet")
        return self._write(D.dim_users(self.lake.read(PLAYS)), USERS)

    # ---- gold statistics

    def _half_lives(self, plays: DataFrame) -> DataFrame:
        return self.lake.read(USERS) if self.lake.exists(USERS) else D.default_half_lives(plays)

    def compute_track_counts(self, as_of: datetime | str) -> WriteReport:
        if not self.lake.exists(PLAYS):
            return self._skipped(TRACK_COUNTS, "no plays yet")
        plays = self.lake.read(PLAYS)
        return self._write(ST.track_play_counts(plays, self._half_lives(plays), as_of), TRACK_COUNTS)

    def compute_artist_counts(self, as_of: datetime | str) -> WriteReport:
        if not (self.lake.exists(PLAYS) and self.lake.exists(TRACKS) and self.lake.exists(ARTISTS)):
            return self._skipped(ARTIST_COUNTS, "plays or dimensions missing")
        plays = self.lake.read(PLAYS)
        counts = ST.artist_play_counts(plays, self._half_lives(plays), self.lake.read(TRACKS), self.lake.read(ARTISTS), as_of)
        return self._write(counts.withColumn("serving_key", ST.serving_key()), ARTIST_COUNTS)

    def compute_stats(self) -> WriteReport:
        if not self.lake.exists(TRACK_COUNTS):
            return self._skipped(STATS, "no track counts yet")
        artists = self._table(ARTIST_COUNTS, schemas.ARTIST_PLAY_COUNT)
        return self._upsert(ST.user_stats(self.lake.read(TRACK_COUNTS), artists), STATS, ["username"])

    # ---- candidates

    def _artists_played(self) -> DataFrame:
        plays, tracks = self._table(PLAYS, schemas.PLAYS), self._table(TRACKS, schemas.TRACKS)
        counts = self.lake.read(ARTIST_COUNTS).drop("artist_name") if self.lake.exists(ARTIST_COUNTS) else None
        return C.user_artists(plays, tracks, self._table(ARTISTS, schemas.ARTISTS), counts)

    def _store(self, rows: DataFrame, name: str) -> WriteReport:
        """Upsert new candidates, then drop stored ones that have been played since."""
        key = ["username", "track_id"]
        report = self._upsert(rows, name, key)
        played = C.played_tracks(self._table(PLAYS, schemas.PLAYS))
        report.deleted = self.lake.delete(self._placed(played), name, key).deleted
        return report

    def _previous(self, name: str) -> DataFrame | None:
        return self.lake.read(name) if self.lake.exists(name) else None

    def similar_artists(self, similar: DataFrame, top_tracks: DataFrame, seed: int = 0, **limits) -> WriteReport:
        sources = C.similar_artist_sources(self._artists_played(), self._previous(SIMILAR_ARTIST), seed=seed)
        plays = self._table(PLAYS, schemas.PLAYS)
        return self._store(C.similar_artist_candidates(plays, sources, similar, top_tracks, **limits), SIMILAR_ARTIST)

    def similar_tags(self, tag_tracks: DataFrame, **limits) -> WriteReport:
        plays = self._table(PLAYS, schemas.PLAYS)
        profile = C.tag_profile(plays, self._table(TRACKS, schemas.TRACKS), self._table(ARTISTS, schemas.ARTISTS))
        rows = C.similar_tag_candidates(plays, profile, tag_tracks, previous=self._previous(SIMILAR_TAG), **limits)
        return self._store(rows, SIMILAR_TAG)

    def deep_cuts(self, albums: DataFrame, album_tracks: DataFrame, **limits) -> WriteReport:
        sources = C.deep_cut_sources(self._artists_played(), self._previous(DEEP_CUT))
        catalogue = C.album_catalogue(albums, album_tracks, **limits)
        return self._store(C.deep_cut_candidates(self._table(PLAYS, schemas.PLAYS), sources, catalogue), DEEP_CUT)

    def old_favorites(self, as_of: datetime | str, **limits) -> WriteReport:
        """Computed anew for every user in every run."""
        plays = self._table(PLAYS, schemas.PLAYS)
        users = self.lake.read(USERS) if self.lake.exists(USERS) else None
        return self._write(C.old_favorites(plays, as_of, users, **limits), OLD_FAVORITES)

    def merge(self, users: DataFrame | None = None, **settings) -> WriteReport:
        """The serving table of all users, or only of some, whose old rows it replaces."""
        rows = merge_candidates(
            self._table(PLAYS, schemas.PLAYS),
            self._table(SIMILAR_ARTIST, schemas.CANDIDATE_SIMILAR_ARTIST),
            self._table(SIMILAR_TAG, schemas.CANDIDATE_SIMILAR_TAG),
            self._table(DEEP_CUT, schemas.CANDIDATE_DEEP_CUT),
            self._table(OLD_FAVORITES, schemas.CANDIDATE_OLD_FAVORITES),
            self._table(TRACKS, schemas.TRACKS),
            self._table(ARTISTS, schemas.ARTISTS),
            **settings,
        )
        if users is None:
            return self._write(rows, CANDIDATES)
        rows = rows.join(users.select("username").distinct(), "username", "left_semi")
        return self.lake.replace_users(self._placed(rows), CANDIDATES, self._placed(users.select("username")), self.partition_by)

    def merge_summary(self) -> DataFrame:
        rows = self._table(CANDIDATES, schemas.TRACK_CANDIDATES)
        return rows.agg(F.count("*").alias("total_candidates"), F.count_distinct("username").alias("num_users"))

    # ---- serving

    def recommend(self, username: str | None = None, **settings) -> DataFrame:
        rows = self._table(CANDIDATES, schemas.TRACK_CANDIDATES)
        if username is not None:
            rows = rows.filter(F.col("username") == username)
        tracks = self._table(EXCLUDED_TRACKS, schemas.EXCLUDED_TRACKS)
        return recommend(rows, tracks, self._table(EXCLUDED_ARTISTS, schemas.EXCLUDED_ARTISTS), **settings)

    def exclude_tracks(self, rows: DataFrame) -> WriteReport:
        return self._upsert(rows, EXCLUDED_TRACKS, ["username", "track_id"])

    def exclude_artists(self, rows: DataFrame) -> WriteReport:
        return self._upsert(rows, EXCLUDED_ARTISTS, ["username", "artist_name"])

    def restore_tracks(self, rows: DataFrame) -> WriteReport:
        return self.lake.delete(self._placed(rows), EXCLUDED_TRACKS, ["username", "track_id"])

    def restore_artists(self, rows: DataFrame) -> WriteReport:
        return self.lake.delete(self._placed(rows), EXCLUDED_ARTISTS, ["username", "artist_name"])
