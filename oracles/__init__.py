"""DuckDB twins of the queries, written from the definition of each result and not from the Spark plans."""

from __future__ import annotations

import re

# ---- building blocks: named relations, included on demand ------------------------------------------------------

PARTS: dict[str, str] = {}

MARKERS = ["", " - Remastered 2012", " (Live at Wembley)", " feat. Guest", " [Explicit]", " 1999", " (Official Video)"]
_marker = "CASE n " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(MARKERS)) + " END"

PARTS["v_names"] = f"""
SELECT p_partkey, n AS l_linenumber, p_name || {_marker} AS track_name, p_brand AS artist_name,
       p_name || '|' || replace(lower(p_brand), '#', '') AS track_id
FROM part, range(1, 8) r(n)"""

PARTS["v_plays"] = """
SELECT CAST(o_custkey AS VARCHAR) AS username,
       CAST(epoch(o_orderdate) AS BIGINT) + l.l_linenumber * 60 AS scrobbled_at,
       o_orderdate + to_minutes(CAST(l.l_linenumber AS BIGINT)) AS scrobbled_at_utc,
       track_name, 'https://music.example/track/' || l_partkey AS track_url, artist_name,
       l_returnflag = 'R' AS is_loved, track_id
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
JOIN v_names v ON v.p_partkey = l_partkey AND v.l_linenumber = l.l_linenumber"""

PARTS["v_part_counts"] = """
SELECT p.*, listeners, playcount FROM part p LEFT JOIN (
  SELECT l_partkey, count(DISTINCT l_orderkey) AS listeners, count(*) AS playcount FROM lineitem GROUP BY 1
) ON l_partkey = p_partkey"""

PARTS["v_listing"] = """
SELECT p_name || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' (Official Video)' WHEN 2 THEN ' - 2004 Remaster'
                 ELSE ' (Live)' END AS track_name,
       p_brand AS artist_name, CAST(p_size AS BIGINT) * 10000 AS duration_ms, listeners, playcount,
       lower(p_type) || ', ' || replace(p_name, ' ', '-') AS tags,
       'https://music.example/track/' || p_partkey AS track_url,
       CASE WHEN p_size > 10 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(p_partkey // 3 AS VARCHAR), 11, '0') END
         AS youtube_url,
       CASE WHEN p_size < 40 THEN 'https://open.spotify.com/track/' || lpad(CAST(p_partkey AS VARCHAR), 22, '0') END
         AS spotify_url,
       p_name || '|' || replace(lower(p_brand), '#', '') AS track_id
FROM v_part_counts"""

PARTS["v_tracks"] = """
SELECT track_id, track_name, artist_name, duration_ms, track_url, tags, top_listeners AS listeners,
       top_plays AS playcount, youtube_url, spotify_url, replace(lower(artist_name), '#', '') AS artist_id
FROM (
  SELECT *, max(listeners) OVER (PARTITION BY track_id) AS top_listeners,
         max(playcount) OVER (PARTITION BY track_id) AS top_plays,
         row_number() OVER (PARTITION BY track_id ORDER BY contains(track_name, 'Official Video'),
                            coalesce(playcount, 0) DESC, track_name, artist_name, track_url) AS rn
  FROM v_listing) WHERE rn = 1"""

PARTS["v_artist_entries"] = """
WITH per_type AS (
  SELECT p_brand, p_type, count(*) AS parts, CAST(sum(listeners) AS BIGINT) AS listeners,
         CAST(sum(playcount) AS BIGINT) AS playcount
  FROM v_part_counts GROUP BY ALL),
top AS (SELECT p_brand, string_agg(lower(p_type), ', ' ORDER BY lower(p_type)) AS tags FROM per_type GROUP BY 1)
SELECT CASE p_type WHEN 'PROMO' THEN upper(p_brand) WHEN 'LARGE' THEN p_brand || ' (Live)' ELSE p_brand END AS artist_name,
       listeners, playcount, tags, 'About ' || p_brand || ' / ' || p_type AS bio_summary,
       'https://music.example/artist/' || p_brand AS artist_url,
       replace(lower(p_brand), '#', '') AS artist_id
FROM per_type JOIN top USING (p_brand)"""

PARTS["v_artists_all"] = """
SELECT artist_id, artist_name, artist_url, tags, bio_summary, top_listeners AS listeners, top_plays AS playcount FROM (
  SELECT *, max(listeners) OVER (PARTITION BY artist_id) AS top_listeners,
         max(playcount) OVER (PARTITION BY artist_id) AS top_plays,
         row_number() OVER (PARTITION BY artist_id
                            ORDER BY playcount DESC NULLS LAST, artist_name, artist_url, tags, bio_summary) AS rn
  FROM v_artist_entries) WHERE rn = 1"""
PARTS["v_artists"] = "SELECT * FROM v_artists_all WHERE listeners >= 1"

PARTS["v_users"] = """
SELECT *, greatest(listening_span_days / 3.0, 30.0) AS user_half_life_days FROM (
  SELECT username, min(scrobbled_at_utc) AS first_play_date, max(scrobbled_at_utc) AS last_play_date,
         count(*) AS total_plays,
         date_sub('day', min(scrobbled_at_utc), max(scrobbled_at_utc)) AS listening_span_days
  FROM v_plays GROUP BY 1)"""


def track_counts(plays: str, half_life: str, as_of: str = "2001-08-02", users: str = "v_users") -> str:
    return f"""
SELECT username, track_id, track_name, artist_name, play_count, first_played_on, last_played_on, recency_score,
       CAST(date_sub('day', last_played_on, TIMESTAMP '{as_of}') AS INTEGER) AS days_since_last_play
FROM (
  SELECT p.username, track_id, arg_min(track_name, (track_name, artist_name)) AS track_name,
         arg_min(artist_name, (track_name, artist_name)) AS artist_name, count(*) AS play_count,
         min(scrobbled_at_utc) AS first_played_on, max(scrobbled_at_utc) AS last_played_on,
         avg(exp(-date_sub('day', scrobbled_at_utc, TIMESTAMP '{as_of}') / {half_life})) AS recency_score
  FROM {plays} p JOIN {users} u ON u.username = p.username GROUP BY p.username, track_id)"""


PARTS["v_track_counts"] = track_counts("v_plays", "user_half_life_days")

PARTS["v_artist_counts"] = """
SELECT c.username, c.artist_id, a.artist_name, play_count, first_played_on, last_played_on, recency_score,
       CAST(date_sub('day', last_played_on, TIMESTAMP '2001-08-02') AS INTEGER) AS days_since_last_play
FROM (
  SELECT p.username, t.artist_id, count(*) AS play_count, min(scrobbled_at_utc) AS first_played_on,
         max(scrobbled_at_utc) AS last_played_on,
         avg(exp(-date_sub('day', scrobbled_at_utc, TIMESTAMP '2001-08-02') / user_half_life_days)) AS recency_score
  FROM v_plays p LEFT JOIN v_tracks t USING (track_id) JOIN v_users u ON u.username = p.username
  GROUP BY p.username, t.artist_id) c LEFT JOIN v_artists a USING (artist_id)"""

PARTS["v_played"] = "SELECT DISTINCT username, track_id FROM v_plays"

PARTS["v_user_artists"] = """
SELECT p.username, a.artist_id, a.artist_name, a.tags, count(*) AS play_count
FROM v_plays p JOIN v_tracks t ON t.track_id = p.track_id JOIN v_artists a ON a.artist_id = t.artist_id GROUP BY ALL"""

PARTS["v_similar_artists"] = """
WITH brands AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS vec_id FROM part),
v AS (SELECT p_brand, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS brands,
             CAST(embedding AS DOUBLE[]) AS e FROM brands JOIN embeddings USING (vec_id)),
pairs AS (
  SELECT a.p_brand AS artist_name, b.p_brand AS similar_name,
         round((1 + list_dot_product(a.e, b.e) /
                (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))) / 2, 6) AS match
  FROM v a, range(1, 21) s(i), v b WHERE i <= greatest(a.brands - 1, 1) AND b.place = (a.place + i) % a.brands)
SELECT *, row_number() OVER (PARTITION BY artist_name ORDER BY match DESC, similar_name) AS pos FROM pairs"""

PARTS["v_artist_top_tracks"] = """
SELECT artist_name, track_name, track_id, coalesce(listeners, 0) AS listeners, coalesce(playcount, 0) AS playcount FROM (
  SELECT *, row_number() OVER (PARTITION BY artist_name ORDER BY playcount DESC NULLS LAST, track_url) AS pos
  FROM v_listing) WHERE pos <= 50"""

# All ways from a played artist over a similar one to a track.
PARTS["v_similar_paths"] = """
SELECT s.username, t.track_id, t.track_name, t.artist_name, e.match AS similarity,
       e.match * s.play_count * t.playcount AS score, s.artist_id AS source_artist_id, listeners
FROM v_user_artists s JOIN v_similar_artists e ON e.artist_name = s.artist_name AND pos <= 20 AND match <= 0.55
JOIN v_artist_top_tracks t ON t.artist_name = e.similar_name"""


def similar_candidates(paths: str) -> str:
    return f"""
SELECT username, track_id, track_name, artist_name, similarity, score, source_artist_id FROM (
  SELECT *, row_number() OVER (PARTITION BY username, track_id
                               ORDER BY score DESC, source_artist_id, track_name, artist_name) AS rn
  FROM {paths} p WHERE listeners >= 20
    AND NOT EXISTS (SELECT 1 FROM v_played x WHERE x.username = p.username AND x.track_id = p.track_id)) WHERE rn = 1"""


PARTS["v_cand_artist"] = similar_candidates("v_similar_paths")

PARTS["v_tag_profile"] = """
SELECT username, tag, tag_count FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY tag_count DESC, tag) AS rn
  FROM (SELECT username, tag, count(*) AS tag_count FROM (SELECT p.username, trim(unnest(string_split(a.tags, ','))) AS tag
        FROM v_played p JOIN v_tracks t ON t.track_id = p.track_id JOIN v_artists a ON a.artist_id = t.artist_id
        WHERE a.tags <> '')
  GROUP BY ALL)) WHERE rn <= 100"""

PARTS["v_tag_top_tracks"] = """
SELECT tag, track_id, track_name, artist_name FROM (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY playcount DESC NULLS LAST, track_url) AS pos
  FROM (SELECT *, unnest(string_split(tags, ', ')) AS tag FROM v_listing)) WHERE pos <= 500"""

PARTS["v_cand_tag"] = """
SELECT username, track_id, any_value(n.track_name) AS track_name, any_value(n.artist_name) AS artist_name,
       count(DISTINCT tag) AS tag_match_count, CAST(count(DISTINCT tag) AS DOUBLE) AS score,
       string_agg(DISTINCT tag, ',' ORDER BY tag) AS source_tags
FROM v_tag_profile p JOIN v_tag_top_tracks USING (tag)
JOIN (SELECT track_id, min((track_name, artist_name))[1] AS track_name, min((track_name, artist_name))[2] AS artist_name
      FROM v_tag_top_tracks GROUP BY 1) n USING (track_id)
WHERE NOT EXISTS (SELECT 1 FROM v_played x WHERE x.username = p.username AND x.track_id = v_tag_top_tracks.track_id)
GROUP BY username, track_id HAVING count(DISTINCT tag) >= 2"""

PARTS["v_album_tracks"] = """
WITH albums AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY playcount DESC NULLS LAST, 'Album ' || p_size) AS pos
  FROM (SELECT p_brand, p_size, CAST(sum(playcount) AS BIGINT) AS playcount FROM v_part_counts GROUP BY ALL)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS place
  FROM albums WHERE pos <= 15 AND coalesce(playcount, 0) >= 20)
SELECT k.p_brand AS artist_name, p_name || '|' || replace(lower(k.p_brand), '#', '') AS track_id, p_name AS track_name,
       k.playcount
FROM kept k JOIN part p ON p.p_brand = k.p_brand AND p.p_size = k.p_size WHERE place <= 10"""

PARTS["v_cand_cut"] = """
WITH sources AS (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY play_count DESC, artist_id) AS place FROM v_user_artists),
found AS (
  SELECT s.username, a.track_id, a.track_name, a.artist_name, CAST(s.play_count * a.playcount AS DOUBLE) AS score,
         s.artist_id AS source_artist_id
  FROM sources s JOIN v_album_tracks a ON a.artist_name = s.artist_name WHERE place <= 30)
SELECT username, track_id, track_name, artist_name, score, source_artist_id FROM (
  SELECT *, row_number() OVER (PARTITION BY username, track_id
                               ORDER BY score DESC, source_artist_id, track_name, artist_name) AS rn
  FROM found f WHERE NOT EXISTS (SELECT 1 FROM v_played x WHERE x.username = f.username AND x.track_id = f.track_id))
WHERE rn = 1"""

PARTS["v_cand_old"] = """
SELECT username, track_id, score, play_count, days_since_last_play FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY score DESC, track_id) AS rn FROM (
    SELECT p.username, track_id, count(*) AS play_count,
           date_sub('day', max(scrobbled_at_utc), TIMESTAMP '2001-08-02') AS days_since_last_play,
           count(*) * pow(2.0, -date_sub('day', max(scrobbled_at_utc), TIMESTAMP '2001-08-02') / any_value(user_half_life_days))
             AS score
    FROM v_plays p JOIN v_users u ON u.username = p.username GROUP BY p.username, track_id)
  WHERE days_since_last_play >= 90) WHERE rn <= 500"""


def rank_share(source: str) -> str:
    """Average ascending rank over greatest rank, all rows."""
    return f"""
SELECT *, avg_rank / max(avg_rank) OVER (PARTITION BY username) AS normalized_score FROM (
  SELECT *, rank() OVER (PARTITION BY username ORDER BY score) + (count(*) OVER (PARTITION BY username, score) - 1) / 2.0
    AS avg_rank FROM {source})"""


def top_share(source: str, n: int) -> str:
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY score DESC, track_id) AS place
  FROM ({rank_share(source)})) WHERE place <= {n}"""


def merged(on_id: bool) -> str:
    keys = "username, track_id" if on_id else "username, track_id, track_name, artist_name"
    names = (
        "min((track_name, artist_name))[1] AS track_name, min((track_name, artist_name))[2] AS artist_name," if on_id else ""
    )
    return f"""
WITH sa AS ({top_share('v_cand_artist', 500)}), st AS ({top_share('v_cand_tag', 500)}),
dc AS ({top_share('v_cand_cut', 500)}), old_f AS ({top_share('v_cand_old', 500)}),
sources AS (
  SELECT username, track_id, sa.track_name, sa.artist_name, normalized_score AS score, true AS similar_artist,
         false AS similar_tag, false AS deep_cut_same_artist, false AS old_favorite,
         coalesce(a.artist_name, source_artist_id) AS why_similar_artist_name,
         round_even(similarity * 100, 1) AS why_similar_artist_pct, NULL AS why_similar_tags, NULL AS why_tag_match_count,
         NULL AS why_deep_cut_artist
  FROM sa LEFT JOIN v_artists a ON a.artist_id = source_artist_id
  UNION ALL
  SELECT username, track_id, track_name, artist_name, normalized_score, false, true, false, false, NULL, NULL,
         source_tags, tag_match_count, NULL FROM st
  UNION ALL
  SELECT username, track_id, dc.track_name, dc.artist_name, normalized_score, false, false, true, false, NULL, NULL,
         NULL, NULL, coalesce(a.artist_name, source_artist_id)
  FROM dc LEFT JOIN v_artists a ON a.artist_id = source_artist_id
  UNION ALL
  SELECT o.username, o.track_id, t.track_name, t.artist_name, normalized_score, false, false, false, true, NULL, NULL,
         NULL, NULL, NULL FROM old_f o LEFT JOIN v_tracks t ON t.track_id = o.track_id),
grouped AS (
  SELECT {keys}, {names} coalesce(max(score) FILTER (similar_artist), 0) + coalesce(max(score) FILTER (similar_tag), 0)
         + coalesce(max(score) FILTER (deep_cut_same_artist), 0) + coalesce(max(score) FILTER (old_favorite), 0) AS score, bool_or(similar_artist) AS similar_artist, bool_or(similar_tag) AS similar_tag,
         bool_or(deep_cut_same_artist) AS deep_cut_same_artist, bool_or(old_favorite) AS old_favorite,
         max(why_similar_artist_name) AS why_similar_artist_name, max(why_similar_artist_pct) AS why_similar_artist_pct,
         max(why_similar_tags) AS why_similar_tags, max(why_tag_match_count) AS why_tag_match_count,
         max(why_deep_cut_artist) AS why_deep_cut_artist
  FROM sources GROUP BY {keys}),
enriched AS (
  SELECT g.username, g.track_id, coalesce(t.track_name, g.track_name) AS track_name,
         coalesce(t.artist_name, g.artist_name) AS artist_name, score, similar_artist, similar_tag, deep_cut_same_artist,
         old_favorite, why_similar_artist_name, why_similar_artist_pct, why_similar_tags, why_tag_match_count,
         why_deep_cut_artist, duration_ms, tags, youtube_url, spotify_url
  FROM grouped g LEFT JOIN v_tracks t ON t.track_id = g.track_id),
once AS (
  SELECT * FROM enriched QUALIFY row_number() OVER (
    PARTITION BY username, track_id
    ORDER BY score DESC, similar_artist DESC, similar_tag DESC, deep_cut_same_artist DESC, old_favorite DESC) = 1)
SELECT * FROM once QUALIFY row_number() OVER (
  PARTITION BY username, coalesce(youtube_url, track_id) ORDER BY score DESC, track_id) = 1"""


PARTS["v_candidates"] = merged(False)

PARTS["v_excluded_tracks"] = """
SELECT CAST(o_custkey AS VARCHAR) AS username, t.track_id, t.track_name, t.artist_name, max(o_orderdate) AS excluded_at
FROM orders JOIN part ON p_partkey = o_orderkey
JOIN v_tracks t ON t.track_id = p_name || '|' || replace(lower(p_brand), '#', '')
WHERE o_orderpriority = '1-URGENT' GROUP BY ALL"""

PARTS["v_excluded_artists"] = """
SELECT CAST(o_custkey AS VARCHAR) AS username, p_brand AS artist_name, max(o_orderdate) AS excluded_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE l_returnflag = 'R' GROUP BY o_custkey, p_brand HAVING count(*) >= 2"""

_allowed = """
NOT EXISTS (SELECT 1 FROM v_excluded_artists e WHERE e.username = c.username AND e.artist_name = c.artist_name)
AND NOT EXISTS (SELECT 1 FROM v_excluded_tracks e
                WHERE e.username = c.username AND e.track_name = c.track_name AND e.artist_name = c.artist_name)"""


def recommended(where: str, weight: float, n: int) -> str:
    return f"""
WITH weighted AS (
  SELECT *, score * CASE WHEN old_favorite THEN 1.1::DOUBLE - {weight}::DOUBLE ELSE 0.1::DOUBLE + {weight}::DOUBLE END
    AS weighted_score
  FROM v_candidates c WHERE {where}),
capped AS (
  SELECT * FROM weighted QUALIFY row_number() OVER (
    PARTITION BY username, artist_name ORDER BY weighted_score DESC, track_id) <= 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY weighted_score DESC, track_id) AS rank FROM capped)
SELECT *, rank <= {n} AS shown,
       round_even(weighted_score / max(weighted_score) OVER (PARTITION BY username) * 100, 1) AS score_pct
FROM ranked WHERE rank <= {3 * n}"""


PARTS["v_recommended"] = recommended(
    f"(similar_tag OR similar_artist OR deep_cut_same_artist) AND {_allowed}", 0.5, 30
)

PARTS["v_messy_names"] = """
SELECT 'document ' || doc_id AS source, unnest(range(len(lines))) AS place, unnest(lines) AS name
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
UNION ALL
SELECT 'part ' || p_partkey, l_linenumber, track_name || ' / ' || artist_name FROM v_names"""

PARTS["v_link_search"] = """
SELECT track_id, CASE WHEN l_linestatus = 'O' THEN 'youtube' ELSE 'spotify' END AS platform,
       CASE WHEN l_linestatus = 'O' AND l.l_linenumber = 1 THEN 'songs'
            WHEN l_linestatus = 'O' AND l.l_linenumber <= 3 THEN 'general'
            WHEN l_linestatus = 'O' THEN 'api' WHEN l.l_linenumber <= 3 THEN 'strict' ELSE 'relaxed' END AS search,
       CASE l_returnflag WHEN 'R' THEN 'song' WHEN 'A' THEN 'video' ELSE 'artist' END AS result_type,
       CASE WHEN l_quantity <= 45 THEN lpad(CAST(l_orderkey AS VARCHAR), CASE WHEN l_linestatus = 'O' THEN 11 ELSE 22 END, '0')
       END AS result_id,
       track_name AS title, s_name || CASE WHEN l_returnflag = 'N' THEN ' - Topic' ELSE '' END AS channel,
       l_suppkey % 3 + 1 AS pos
FROM lineitem l JOIN v_names v ON v.p_partkey = l_partkey AND v.l_linenumber = l.l_linenumber
JOIN supplier ON s_suppkey = l_suppkey"""

_filmed = r"regexp_matches(lower(title), 'official video|music video| mv |\[mv\]|\(mv\)|videoclip|live|concert|performance')"
_audio = "regexp_matches(lower(title), 'audio|lyric|topic')"
PARTS["v_best_links"] = f"""
SELECT track_id, platform, arg_min(result_id, (class, pos, result_id)) AS result_id, CAST(min(class) AS INTEGER) AS class FROM (
  SELECT *, CASE
    WHEN search = 'songs' THEN CASE WHEN pos = 1 THEN 1 END
    WHEN search = 'general' THEN CASE WHEN result_type = 'song' THEN 2 ELSE 3 END
    WHEN search = 'api' THEN CASE WHEN contains(channel, '- Topic') THEN 4 WHEN {_audio} AND NOT {_filmed} THEN 5
                                  WHEN NOT {_filmed} THEN 6 ELSE 7 END
    WHEN pos = 1 THEN CASE search WHEN 'strict' THEN 1 ELSE 2 END END AS class
  FROM v_link_search)
WHERE class IS NOT NULL AND result_id IS NOT NULL GROUP BY track_id, platform"""

# What the player block of a page says, by construction of the page.
PARTS["v_page_links"] = """
SELECT page_id, 'https://music.example/track/' || page_id AS url,
       CASE WHEN page_id % 8 IN (0, 1, 4, 6, 7)
            THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, '0')
                 || CASE page_id % 8 WHEN 0 THEN '&t=1' WHEN 7 THEN '&t=1&u=é' ELSE '' END END AS youtube_url,
       CASE WHEN page_id % 8 IN (0, 2, 5) THEN 'https://open.spotify.com/track/' || lpad(CAST(page_id AS VARCHAR), 22, '0') END
         AS spotify_url
FROM pages"""

PARTS["v_event_plays"] = """
SELECT CAST(user_id AS VARCHAR) AS username, ts AS scrobbled_at_utc, 'track ' || json_extract_string(props, '$.k') AS track_name,
       event_type AS artist_name, 'track ' || json_extract_string(props, '$.k') || '|' || event_type AS track_id
FROM events"""
PARTS["v_event_users"] = """
SELECT username, greatest(date_sub('day', min(scrobbled_at_utc), max(scrobbled_at_utc)) / 3.0, 30.0) AS user_half_life_days
FROM v_event_plays GROUP BY 1"""

PARTS["v_export"] = """
SELECT *, CASE WHEN CAST(username AS BIGINT) < 100 THEN 100 ELSE 30 END AS allowed,
       row_number() OVER (PARTITION BY username ORDER BY rank, track_id) AS position,
       nullif(regexp_extract(youtube_url, '(?:v=|/)([0-9A-Za-z_-]{11})', 1), '') AS video_id,
       nullif(regexp_extract(spotify_url, 'spotify\\.com/track/([a-zA-Z0-9]{22})', 1), '') AS audio_id,
       track_name || ' - ' || artist_name AS label
FROM v_recommended"""


def relation(body: str) -> str:
    """Body with all relations it needs, directly or not, in front of it; doubles rounded like the Spark side."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", sql):
            if name in PARTS and name not in needed:
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in needed)
    return f"WITH {ctes},\nresult AS ({body})\nSELECT * FROM result" if ctes else f"WITH result AS ({body})\nSELECT * FROM result"


BODIES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, doubles: tuple[str, ...] = ()) -> None:
    """Register a twin; ``doubles`` are rounded on both sides, small ones to more decimals."""
    BODIES[name] = body
    sql = relation(body)
    if doubles:
        cut = "floor(CAST({c} AS DOUBLE) * {s}::DOUBLE + 0.5::DOUBLE) / {s}::DOUBLE"
        by_size = "CASE WHEN abs({c}) >= 1e-3::DOUBLE OR {c} = 0 THEN %s WHEN abs({c}) >= 1e-9::DOUBLE THEN %s ELSE %s END AS {c}"
        by_size %= tuple(cut.replace("{s}", s) for s in ("1e6", "1e15", "1e24"))
        rounded = ", ".join(by_size.replace("{c}", c) for c in doubles)
        sql = sql.replace("SELECT * FROM result", f"SELECT * REPLACE ({rounded}) FROM result")
    ORACLES[name] = sql


from oracles import twins  # noqa: E402,F401
