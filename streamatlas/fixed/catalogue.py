"""Fixed values of the catalogue build, the reports and the serving view."""

# Query parameters that never identify a page.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")

# Sources in build order. The position is the source rank of `ord`.
SOURCE_ORDER = (
    "youtube-api", "worldcams", "cxtvlive", "skyline", "camscape", "earthcam", "camsecure", "explore", "wildlife-trusts",
    "livespotting", "livefromiceland", "beachcam", "resortcams", "hdontap", "ozolio", "feratel", "whatsupcams", "viewsurf",
    "webcamerapl", "airportwebcams", "shareju", "tomarigi", "windy",
)

# Rank of a source when two rows of one stream disagree; a source not listed has rank -1.
MERGE_RANK = {"cxtvlive": 2, "worldcams": 1, "youtube-api": 0}
# Fixed value: the source whose title is the official one.
OFFICIAL_TITLE_SOURCE = "youtube-api"
UNTITLED = "(untitled)"

# Drop labels.
NO_EXTRACTOR = "no-extractor"
RESOLVE_FAILED = "resolve-failed"
DEAD_MANIFEST = "dead-manifest"
YT_OFFLINE = "yt-offline"
DETAIL_CHARS = 80

# Fetch outcome labels.
OK = "ok"
BAD_SCHEME = "bad-scheme"
DNS_ERROR = "dns-error"
BLOCKED_IP = "blocked-ip"
TIMEOUT = "timeout"
CONN_ERROR = "conn-error"
TOO_LARGE = "too-large"
TOO_MANY_REDIRECTS = "too-many-redirects"
REDIRECT_NO_LOCATION = "redirect-no-location"
UNEXPECTED_REDIRECT = "unexpected-redirect"
HOST_BACKOFF = "host-backoff"
SHEDDING_OUTCOMES = ("http-429", "http-503")
MAX_HOSTS = 500
QUIET_GAP = "30 seconds"

# The per-source guard.
DROP_THRESHOLD = 0.5
AGREE_TO_ACCEPT = 2

# Resolve cache lifetimes, in seconds.
TTL_FACTOR = 0.8
NEGATIVE_TTL = 60.0
DEFAULT_TTL = 600.0

# Hosts. The first serve no video at all; the second bind a session to the fetching address; the third need
# their segments relayed.
NEVER_A_STREAM_HOSTS = ("googletagmanager.com",)
DIRECT_PLAYBACK_HOSTS = ("pixelcaster.com",)
RELAY_SEGMENT_HOSTS = (
    "balticlivecam.com", "enhd.es", "skylinewebcams.com", "earthcam.com", "wetmet.net", "video-auth1.iol.pt",
    "live.hdontap.com", "nginx.hdontap.com", "ozolio.com", "webcamera.pl",
)
VIDEO_CDN_HOST = "googlevideo.com"

# Live-edge trim.
LIVE_WINDOW_SECONDS = 120.0
TRIM_ABOVE = 200
MIN_KEEP = 6
PLAYLIST_TAGS = (
    "#EXTM3U", "#EXT-X-VERSION", "#EXT-X-TARGETDURATION", "#EXT-X-MEDIA-SEQUENCE", "#EXT-X-DISCONTINUITY-SEQUENCE",
    "#EXT-X-PLAYLIST-TYPE", "#EXT-X-ALLOW-CACHE", "#EXT-X-START", "#EXT-X-SERVER-CONTROL", "#EXT-X-PART-INF", "#EXT-X-MAP",
    "#EXT-X-I-FRAMES-ONLY",
)

# Limits of the enumerations.
SEARCH_MAX_IDS = 1000
LIST_PAGES_MAX = 80
PROBE_BUDGET = 9000
ENUM_MAX_REQUESTS = 7000
CIRCLE_CAP = 4500
PAGE_SIZE = 25
GRID_STEP = 3.15
GRID_LAT_MIN = -60.0
GRID_LAT_MAX = 72.0
ENUM_EVERY = 40
MIN_STREAM_PAGE = 300

# Text patterns.
CREDENTIAL = r"(?i)(?<![a-z0-9])((?:developer_?key|api_?key|key)=)[^&\s\"']+"
URL_QUERY = r"(https?://[^\s?\"']+)\?\S*"
