"""Defaults of the jobs, stated as fixed values; every operator takes them as keyword arguments (None: no limit)."""

# Candidate generation.
MIN_LISTENERS = 1000
SIMILARITY_THRESHOLD = 0.9
SIMILAR_ARTISTS_PER_ARTIST = 20
TOP_TRACKS_PER_ARTIST = 50
TOP_TAGS, TRACKS_PER_TAG, MIN_TAG_MATCHES = 100, 500, 2
MIN_NEW_TAG_SHARE = 0.2
DEEP_CUT_MIN_LISTENERS, DEEP_CUT_TOP_ARTISTS = 100, 30
ALBUMS_PER_ARTIST, ALBUMS_KEPT = 15, 10
MIN_DAYS_SINCE_LAST_PLAY, MAX_OLD_FAVORITES = 90, 500

# Merge, recommendation and export.
TRACKS_PER_SOURCE = 500
SONGS_PER_ARTIST, RECOMMENDATIONS, POOL_FACTOR = 3, 30, 3
EXPORT_LIMIT, EXPORT_LIMIT_OWNER = 30, 100

# Dimensions.
TAGS_PER_ITEM = 5
MIN_ARTIST_LISTENERS = 1000
