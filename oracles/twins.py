"""One SQL statement per query."""

from __future__ import annotations

from oracles import _allowed, merged, oracle, rank_share, recommended, similar_candidates, top_share, track_counts
from oracles.regex import normalised, video_regex

# ---- names
oracle("normalize_names", f"SELECT source, place, {normalised('name')} AS normalized FROM v_messy_names")
oracle("normalize_names_strict", f"SELECT source, place, {normalised('name', True)} AS normalized FROM v_messy_names")
oracle(
    "normalize_null_as_empty",
    f"""SELECT source, place, coalesce({normalised('CASE WHEN place % 3 <> 0 THEN name END')}, '') AS normalized
        FROM v_messy_names""",
)
oracle(
    "canonical_ids",
    """SELECT p_partkey AS l_partkey, l_linenumber, track_id, track_id AS track_id_or_raw,
              replace(lower(artist_name), '#', '') AS artist_id, track_name || ' - ' || artist_name AS label FROM v_names""",
)
oracle("music_video_flag", f"SELECT source, place, regexp_matches(name, '{video_regex()}') AS is_video FROM v_messy_names")
oracle(
    "id_labels",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
              lambda w: upper(w[1]) || substr(w, 2)), ' ') AS label FROM part""",
)

# ---- ingest
oracle("raw_plays_flatten", "SELECT * FROM v_plays")
oracle(
    "raw_tracks_structured",
    """SELECT track_name, artist_name, duration_ms, listeners, playcount, tags, track_url, youtube_url, spotify_url
       FROM v_listing""",
)
oracle(
    "raw_artists_structured",
    """SELECT artist_name, listeners, playcount, array_to_string(list_slice(string_split(tags, ', '), 1, 5), ', ') AS tags,
              bio_summary, artist_url FROM v_artist_entries""",
)
oracle(
    "slice_plays",
    """SELECT username, scrobbled_at, track_id, CAST(scrobbled_at_utc AS DATE) AS date FROM v_plays
       WHERE scrobbled_at_utc >= '1998-01-01' AND scrobbled_at_utc < '1998-02-01'""",
)
_days = """
SELECT u.username, CAST(d AS DATE) AS date, count(p.username) AS rows, count(p.username) = 0 AS skipped
FROM (SELECT DISTINCT username FROM v_plays) u
CROSS JOIN range(TIMESTAMP '1998-01-01', TIMESTAMP '1998-02-01', INTERVAL 1 DAY) r(d)
LEFT JOIN v_plays p ON p.username = u.username AND CAST(p.scrobbled_at_utc AS DATE) = CAST(d AS DATE) GROUP BY ALL"""
oracle("backfill_days", _days)
oracle(
    "backfill_summary",
    f"""SELECT username, CAST(sum(rows) AS BIGINT) AS total_rows, count_if(NOT skipped) AS days_processed,
               count_if(skipped) AS days_skipped, min(date) AS start_date, max(date) AS end_date
        FROM ({_days}) GROUP BY 1""",
)

# ---- dimensions
oracle("dedup_tracks", "SELECT * FROM v_tracks")
oracle("dedup_artists", "SELECT * FROM v_artists_all")
oracle("dim_users", "SELECT * FROM v_users", ("user_half_life_days",))
oracle(
    "new_members",
    """WITH seen AS (
         SELECT track_id, track_name, artist_name FROM v_plays
         UNION ALL SELECT track_id, track_name, artist_name FROM v_excluded_tracks)
       SELECT track_id, min((track_name, artist_name))[1] AS track_name, min((track_name, artist_name))[2] AS artist_name
       FROM seen WHERE track_id NOT IN (SELECT track_id FROM v_tracks WHERE youtube_url IS NOT NULL) GROUP BY 1""",
)
oracle(
    "new_artist_members",
    """SELECT DISTINCT artist_name, replace(lower(artist_name), '#', '') AS artist_id FROM v_plays
       WHERE artist_name NOT IN (SELECT artist_name FROM v_excluded_artists)""",
)
oracle("active_users", "SELECT DISTINCT username FROM v_plays")

# ---- play statistics
oracle("track_play_count", "SELECT * FROM v_track_counts", ("recency_score",))
oracle("artist_play_count", "SELECT * FROM v_artist_counts", ("recency_score",))
oracle("bootstrap_track_play_count", track_counts("v_plays", "30.0"), ("recency_score",))
oracle(
    "lookback_counts",
    track_counts(
        "(SELECT * FROM v_plays WHERE scrobbled_at_utc >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY)", "user_half_life_days"
    ),
    ("recency_score",),
)
oracle("plays_per_artist", "SELECT username, artist_id, play_count FROM v_artist_counts WHERE artist_id IS NOT NULL")
oracle(
    "user_stats",
    """SELECT p.username, count(*) AS total_plays, count(DISTINCT p.track_id) AS total_tracks_played,
              count(DISTINCT t.artist_id) AS total_artists_played
       FROM v_plays p JOIN v_tracks t ON t.track_id = p.track_id GROUP BY 1""",
)
oracle(
    "event_play_count",
    track_counts("v_event_plays", "user_half_life_days", "2024-02-01", "v_event_users"),
    ("recency_score",),
)

# ---- candidates
oracle("similar_artist_candidates", "SELECT * FROM v_cand_artist", ("similarity", "score"))
oracle(
    "similar_artist_incremental",
    similar_candidates(
        """(SELECT * FROM v_similar_paths p WHERE NOT EXISTS (
              SELECT 1 FROM v_excluded_artists e
              WHERE e.username = p.username AND replace(lower(e.artist_name), '#', '') = p.source_artist_id))"""
    ),
    ("similarity", "score"),
)
oracle(
    "funnel_counts",
    """SELECT p.username, count(*) AS examined, count_if(listeners < 20) AS few_listeners,
              count_if(listeners >= 20 AND x.track_id IS NOT NULL) AS already_played,
              count_if(listeners >= 20 AND x.track_id IS NULL) AS kept
       FROM v_similar_paths p LEFT JOIN v_played x ON x.username = p.username AND x.track_id = p.track_id GROUP BY 1""",
)
oracle(
    "tag_funnel",
    """WITH found AS (
         SELECT username, track_id, count(DISTINCT tag) AS tags FROM v_tag_profile JOIN v_tag_top_tracks USING (tag) GROUP BY 1, 2)
       SELECT f.username, count(*) AS examined, count_if(tags < 2) AS below_threshold,
              count_if(tags >= 2 AND x.track_id IS NOT NULL) AS already_played,
              count_if(tags >= 2 AND x.track_id IS NULL) AS kept
       FROM found f LEFT JOIN v_played x ON x.username = f.username AND x.track_id = f.track_id GROUP BY 1""",
)
oracle(
    "deep_cut_funnel",
    """WITH sources AS (
         SELECT * FROM v_user_artists QUALIFY row_number() OVER (PARTITION BY username ORDER BY play_count DESC, artist_id) <= 30)
       SELECT s.username, count(*) AS examined, count_if(x.track_id IS NOT NULL) AS already_played,
              count_if(x.track_id IS NULL) AS kept
       FROM sources s JOIN v_album_tracks a ON a.artist_name = s.artist_name
       LEFT JOIN v_played x ON x.username = s.username AND x.track_id = a.track_id GROUP BY 1""",
)
oracle(
    "sampled_artists",
    """SELECT username, artist_id, play_count FROM (
         SELECT *, count(*) OVER (PARTITION BY username) AS n FROM v_user_artists)
       WHERE n <= 15 OR CAST('0x' || substr(md5(username || '|' || artist_id || '|0'), 1, 7) AS BIGINT) % 10000 < 2000""",
)
oracle("tag_profile", "SELECT * FROM v_tag_profile")
oracle(
    "tag_profile_gate",
    """WITH done AS (
         SELECT DISTINCT username, trim(unnest(string_split(tags, ','))) AS tag
         FROM v_excluded_tracks JOIN (SELECT track_id, tags FROM v_tracks) USING (track_id))
       SELECT p.username, count(*) AS tags, count_if(d.tag IS NULL) AS new_tags,
              count_if(d.tag IS NULL) / count(*) >= 0.2 AS run
       FROM v_tag_profile p LEFT JOIN done d ON d.username = p.username AND d.tag = p.tag GROUP BY 1""",
)
oracle("similar_tag_candidates", "SELECT * FROM v_cand_tag", ("score",))
oracle("deep_cut_candidates", "SELECT * FROM v_cand_cut", ("score",))
oracle(
    "album_catalogue",
    """SELECT artist_name, track_id, max(playcount) AS album_playcount, arg_max(track_name, (playcount, track_name)) AS track_name,
              count(*) AS listings FROM v_album_tracks GROUP BY 1, 2""",
)
oracle("old_favorites", "SELECT * FROM v_cand_old", ("score",))
oracle(
    "played_cleanup",
    """WITH stored AS (SELECT DISTINCT username, track_id FROM v_plays WHERE scrobbled_at_utc < '1999-01-01'),
       since AS (SELECT DISTINCT username, track_id, true AS hit FROM v_plays WHERE scrobbled_at_utc >= '1999-01-01')
       SELECT username, count_if(hit IS NULL) AS kept, count_if(hit IS NOT NULL) AS removed
       FROM stored LEFT JOIN since USING (username, track_id) GROUP BY 1""",
)

# ---- merge and recommendation
_scored = "(SELECT username, track_id, CAST(play_count AS DOUBLE) AS score FROM v_track_counts)"
_share = "SELECT username, score, track_id, normalized_score FROM"
oracle("rank_normalise", f"{_share} ({rank_share(_scored)})", ("score", "normalized_score"))
oracle("rank_normalise_top", f"{_share} ({top_share(_scored, 10)})", ("score", "normalized_score"))
oracle("merge_candidates", "SELECT * FROM v_candidates", ("score", "why_similar_artist_pct"))
oracle("merge_candidates_on_id", merged(True), ("score", "why_similar_artist_pct"))
oracle(
    "artist_cap",
    """SELECT * RENAME (recency_score AS weighted_score) FROM v_track_counts
       QUALIFY row_number() OVER (PARTITION BY username, artist_name ORDER BY recency_score DESC, track_id) <= 2""",
    ("weighted_score",),
)
oracle(
    "exclusions_by_name",
    f"""SELECT track_id, username, track_name, artist_name
        FROM v_played JOIN (SELECT track_id, track_name, artist_name FROM v_tracks) USING (track_id)""".replace(
        "SELECT track_id, username", "SELECT * FROM (SELECT track_id, username", 1
    )
    + f") c WHERE {_allowed}",
)
oracle(
    "filter_candidates",
    """SELECT username, track_id, score,
              score * CASE WHEN old_favorite THEN 1.1::DOUBLE - 0.8::DOUBLE ELSE 0.1::DOUBLE + 0.8::DOUBLE END AS weighted_score
       FROM v_candidates WHERE similar_tag OR deep_cut_same_artist""",
    ("score", "weighted_score"),
)
oracle(
    "recommend",
    "SELECT username, track_id, track_name, artist_name, weighted_score, rank, shown, score_pct FROM v_recommended",
    ("weighted_score", "score_pct"),
)
oracle(
    "recommend_old_favorites",
    f"SELECT username, track_id, weighted_score, rank, shown, score_pct FROM ({recommended('old_favorite', 0.0, 10)})",
    ("weighted_score", "score_pct"),
)
oracle(
    "why_record",
    """SELECT username, track_id, why_similar_artist_name AS similar_source,
              CASE WHEN why_similar_artist_name <> '' THEN coalesce(why_similar_artist_pct, 0) END AS similarity,
              array_to_string(list_slice(string_split(why_similar_tags, ','), 1, 5), '|') AS tags,
              why_tag_match_count AS match_count, why_deep_cut_artist AS cut_source FROM v_candidates""",
    ("similarity",),
)
oracle(
    "display_page",
    """SELECT username, track_name, artist_name, score_pct, old_favorite, similar_artist, similar_tag, deep_cut_same_artist
       FROM v_recommended WHERE shown
       QUALIFY row_number() OVER (PARTITION BY username, track_name, artist_name ORDER BY weighted_score DESC, track_id) = 1""",
    ("score_pct",),
)
oracle(
    "page_counts",
    """SELECT username, count(*) AS tracks, count_if(NOT old_favorite) AS discoveries, count_if(old_favorite) AS old_favorites
       FROM v_recommended WHERE shown GROUP BY 1""",
)
oracle(
    "replacements",
    """WITH blocked AS (SELECT username, artist_name FROM v_recommended WHERE rank = 1),
       excluded AS (SELECT username, track_name, artist_name FROM v_recommended WHERE rank = 2),
       allowed AS (
         SELECT r.* FROM v_recommended r
         WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.username = r.username AND b.artist_name = r.artist_name)
           AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.username = r.username AND e.track_name = r.track_name
                                                      AND e.artist_name = r.artist_name)),
       once AS (SELECT * FROM allowed QUALIFY row_number() OVER (
         PARTITION BY username, track_name, artist_name ORDER BY rank) = 1),
       filled AS (SELECT a.*, row_number() OVER (PARTITION BY username ORDER BY rank) AS place FROM once a),
       wanted AS (SELECT username, count(*) AS n FROM v_recommended WHERE shown GROUP BY 1)
       SELECT username, track_id, rank, NOT shown AS replacement FROM filled JOIN wanted USING (username) WHERE place <= n""",
)
oracle(
    "serving_candidates",
    """SELECT username, track_id, score FROM v_candidates
       QUALIFY row_number() OVER (PARTITION BY username ORDER BY score DESC, track_id) <= 20""",
    ("score",),
)
oracle(
    "top_artists",
    """SELECT username, artist_id, artist_name, play_count FROM (
         SELECT *, row_number() OVER (PARTITION BY username ORDER BY play_count DESC, artist_id NULLS FIRST) AS rn
         FROM v_artist_counts) WHERE rn <= 10 AND artist_name IS NOT NULL""",
)

# ---- links
oracle("link_extract", "SELECT url, youtube_url, spotify_url FROM v_page_links")
oracle(
    "link_ids",
    """SELECT url, CASE WHEN youtube_url IS NOT NULL THEN lpad(CAST(page_id AS VARCHAR), 11, '0') END AS video_id,
              CASE WHEN spotify_url IS NOT NULL THEN lpad(CAST(page_id AS VARCHAR), 22, '0') END AS track_id,
              regexp_replace(youtube_url, '&t=1.*$', '') AS video_url, spotify_url AS track_url FROM v_page_links""",
)
oracle("best_link", "SELECT * FROM v_best_links")
oracle(
    "fill_links",
    """WITH popular AS (
         SELECT track_id, track_url FROM v_listing
         QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY playcount DESC NULLS LAST, track_url) = 1)
       SELECT t.track_id,
              coalesce('https://www.youtube.com/watch?v=' || y.result_id, p.youtube_url, t.youtube_url) AS youtube_url,
              coalesce('https://open.spotify.com/track/' || s.result_id, p.spotify_url, t.spotify_url) AS spotify_url
       FROM v_tracks t LEFT JOIN popular l ON l.track_id = t.track_id
       LEFT JOIN v_page_links p ON p.url = coalesce(l.track_url, t.track_url)
       LEFT JOIN v_best_links y ON y.track_id = t.track_id AND y.platform = 'youtube'
       LEFT JOIN v_best_links s ON s.track_id = t.track_id AND s.platform = 'spotify'""",
)
oracle(
    "link_coverage",
    """SELECT artist_id, count(*) AS tracks, count(youtube_url) AS with_youtube, count(spotify_url) AS with_spotify
       FROM v_tracks GROUP BY 1""",
)
oracle(
    "export_list",
    """SELECT username, position, track_id, video_id AS platform_id, label, video_id IS NULL AS missing_url,
              video_id IS NULL AS not_found FROM v_export WHERE position <= allowed""",
)
oracle(
    "export_list_searched",
    """SELECT username, position, e.track_id, coalesce(audio_id, b.result_id) AS platform_id, label,
              audio_id IS NULL AS missing_url, coalesce(audio_id, b.result_id) IS NULL AS not_found
       FROM v_export e LEFT JOIN v_best_links b ON b.track_id = e.track_id AND b.platform = 'spotify'
       WHERE position <= 30""",
)
oracle(
    "export_summary",
    """SELECT username, count(video_id) AS to_add, count(*) - count(video_id) AS missing_url,
              count(*) - count(video_id) AS not_found FROM v_export WHERE position <= 30 GROUP BY 1""",
)

# ---- keyed tables
_once = """
SELECT * FROM v_plays QUALIFY row_number() OVER (
  PARTITION BY username, scrobbled_at
  ORDER BY artist_name DESC, is_loved DESC, scrobbled_at_utc DESC, track_id DESC, track_name DESC, track_url DESC) = 1"""
oracle(
    "upsert_plays",
    f"""WITH once AS ({_once})
        SELECT username, scrobbled_at, CASE WHEN is_loved THEN track_url || '?again' ELSE track_url END AS track_url, track_id,
               CASE WHEN is_loved THEN 'updated' ELSE 'copied' END AS action FROM once
        UNION ALL
        SELECT 'copy ' || username, scrobbled_at, track_url, track_id, 'inserted' FROM once WHERE NOT is_loved""",
)
oracle("exclusion_store", "SELECT * REPLACE (excluded_at + INTERVAL 1 DAY AS excluded_at) FROM v_excluded_tracks")

# ---- stored tables
oracle("json_landing", "SELECT * FROM v_plays")
_awkward = (
    "CASE CAST({0} AS BIGINT) % 5 WHEN 0 THEN '00' || {0} WHEN 1 THEN CAST({0} AS VARCHAR) WHEN 2 THEN 'user ' || {0} "
    "WHEN 3 THEN '2024-01-' || {0} ELSE {0} || '/x=é' END"
)
oracle(
    "upsert_named_users",
    f"""SELECT {_awkward.format('username')} AS username, {_awkward.format('(CAST(username AS BIGINT) % 100)')} AS place,
               scrobbled_at, track_id FROM ({_once})""",
)
oracle(
    "restored_exclusions",
    "SELECT username, track_id, excluded_at FROM v_excluded_tracks WHERE artist_name >= 'Brand#2'",
)
oracle(
    "top_stored_candidates",
    """SELECT username, track_id, score FROM v_candidates WHERE username = '7'
       ORDER BY score DESC, track_id LIMIT 50""",
    ("score",),
)
oracle("table_modes", "SELECT username, count(*) + count_if(is_loved) AS plays FROM v_plays GROUP BY 1")
oracle(
    "upsert_table",
    f"""WITH once AS ({_once})
        SELECT username, scrobbled_at, CASE WHEN is_loved THEN track_url || '?again' ELSE track_url END AS track_url, track_id
        FROM once
        UNION ALL
        SELECT 'copy ' || username, scrobbled_at, track_url, track_id FROM once WHERE NOT is_loved""",
)
oracle(
    "delete_played",
    """SELECT DISTINCT username, track_id FROM v_plays p WHERE scrobbled_at_utc < '1999-01-01'
       AND NOT EXISTS (SELECT 1 FROM v_plays x WHERE x.username = p.username AND x.track_id = p.track_id
                       AND x.scrobbled_at_utc >= '1999-01-01')""",
)
oracle(
    "replace_users",
    """SELECT DISTINCT username, track_id FROM v_plays
       WHERE is_loved OR username NOT IN (SELECT username FROM v_excluded_tracks)""",
)

# ---- streams
_event_once = """SELECT username, epoch_us(scrobbled_at_utc) AS scrobbled_at, track_id, artist_name FROM v_event_plays
  QUALIFY row_number() OVER (PARTITION BY username, scrobbled_at_utc ORDER BY artist_name DESC, track_id DESC) = 1"""
oracle("stream_ingest", _event_once)
oracle("stream_without_repeats", _event_once)
oracle(
    "daily_play_windows",
    """SELECT username, day, count(*) AS plays FROM (
         SELECT username, date_trunc('day', scrobbled_at_utc)::TIMESTAMP AS day FROM v_event_plays) GROUP BY 1, 2""",
)
oracle(
    "stream_refresh",
    track_counts("v_event_plays", "user_half_life_days", "2024-02-01", "v_event_users"),
    ("recency_score",),
)
oracle(
    "stream_history_tracks",
    track_counts("v_event_plays", "user_half_life_days", "2024-02-01", "v_event_users"),
    ("recency_score",),
)
oracle(
    "stream_history_artists",
    """SELECT p.username, lower(artist_name) AS artist_id, artist_name, count(*) AS play_count,
              min(scrobbled_at_utc) AS first_played_on, max(scrobbled_at_utc) AS last_played_on,
              avg(exp(-date_sub('day', scrobbled_at_utc, TIMESTAMP '2024-02-01') / user_half_life_days)) AS recency_score,
              CAST(date_sub('day', max(scrobbled_at_utc), TIMESTAMP '2024-02-01') AS INTEGER) AS days_since_last_play
       FROM v_event_plays p JOIN v_event_users u ON u.username = p.username GROUP BY p.username, artist_name""",
    ("recency_score",),
)
oracle(
    "stream_history_users",
    """SELECT *, greatest(listening_span_days / 3.0, 30.0) AS user_half_life_days FROM (
         SELECT username, min(scrobbled_at_utc) AS first_play_date, max(scrobbled_at_utc) AS last_play_date,
                count(*) AS total_plays, date_sub('day', min(scrobbled_at_utc), max(scrobbled_at_utc)) AS listening_span_days
         FROM v_event_plays GROUP BY 1)""",
)
