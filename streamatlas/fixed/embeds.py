"""The patterns that find a stream in a page, and the routing rules of resolvers."""

# Extraction patterns of the shared ladder.
YT_VIDEO = r"youtube(?:-nocookie)?\.com/(?:embed/|watch\?v=|live/)([A-Za-z0-9_-]{11})"
YT_PLAYLIST = r"youtube(?:-nocookie)?\.com/embed\?list=([A-Za-z0-9_-]+)"
YT_CHANNEL = r"youtube\.com/(channel/[A-Za-z0-9_-]+|@[A-Za-z0-9_.-]+)(?:/live)?"
M3U8 = r"https?:[\\/]+[^\"'\s\\]+\.m3u8[^\"'\s\\]*"
STREAM_ARRAY = r"""streams\[(\d+)\]\s*=\s*(["'])((?:\\.|(?!\2).)*)\2"""
WRAPPED_PLAYER = r"worldcams\.tv\\?/player\?url=([^\"'\s\\]+)"
IFRAME_SRC = r'src=\\?"([^"\\]+)'
IFRAME_TAG = r"""<iframe[^>]+src=["']([^"']+)["']"""
STILL_IMAGE = r"\.(?:jpe?g|png|gif|webp|bmp)$"
FERATEL_CAM = r"webtv(?:fc)?\.feratel\.com/webtv/\?[^\"'\s]*?\bcam=(\d+)"
ATTRIBUTION = r"Source:\s*(?:&nbsp;\s*)?<a\b[^>]*>.*?</a>"
TOKEN_PARAMS = r"[?&](token|expire|hdnts)=[^&]*"

# Formats of canonical targets.
WATCH_URL = "https://www.youtube.com/watch?v="
PLAYLIST_URL = "https://www.youtube.com/embed?list="
WRAPPED_URL = "https://worldcams.tv/player?url="
CHANNEL_URL = "https://www.youtube.com/"

# Resolver patterns and formats.
UNWRAP = r"[?&]url=(.+)$"
META_VIDEO = r"""<meta[^>]+(?:property|name)=["'](?:og:video|twitter:player)["'][^>]+content=["']([^"']+)["']"""
IPCAM_ADDRESS = r"""var\s+address\s*=\s*["']([^"']+)["']"""
IPCAM_STREAM = r"""var\s+streamid\s*=\s*["']([^"']+)["']"""
IPCAM_ALIAS = r"^https?://(?:www\.)?ipcamlive\.com/([A-Za-z0-9_-]+)/?$"
IPCAM_PLAYER = "https://g0.ipcamlive.com/player/player.php?alias="
SKYLINE_TOKEN = r"source:'livee?\.m3u8\?a=([a-z0-9]+)'"
SKYLINE_MANIFEST = "https://hd-auth.skylinewebcams.com/live.m3u8?a="
EARTHCAM_HLS = r"https:(?:\\?/){2}videos-\d+\.earthcam\.com[^\"'\s]+?\.m3u8[^\"'\s]*"
WETMET_HLS = r"""https?://[^"'\s<>]+\.m3u8[^"'\s<>]*"""
PLAYER_DATA = r'<script[^>]+id="player-data"[^>]*>(.*?)</script>'
OZOLIO_ID = r"ozolio\.com/explore/(?:CID_)?([A-Z0-9]+)"
OZOLIO_SESSION = r"^SID_[A-Z0-9]+\z"
OZOLIO_RELAY = "https://relay.ozolio.com"
VIEWSURF_UUID = r"[?&]uuid=([0-9a-f-]+)"
VIEWSURF_HOSTS = ("https://platforms8.joada.net", "https://platforms9.joada.net")
BALTIC_AJAX = "https://balticlivecam.com/wp-admin/admin-ajax.php"
BALTIC_ID = r"auth_token['\"][^}]*?\bid:\s*(\d+)"
BALTIC_HLS = r"https?://[^\"'\s\\]+\.m3u8[^\"'\s\\]*"
BALTIC_EPOCH = r":(\d{13})"
YTDLP_EXPIRE = r"expire[/=](\d+)"

# Lifetimes in seconds of a resolved URL per resolver; a resolver not listed gives none or computes it.
RESOLVE_TTL = {"skyline": 60, "earthcam": 120, "wetmet": 300, "hdontap": 3600, "ozolio": 180, "viewsurf": 1800}

# Error messages of the resolvers.
ERR_FETCH = "resolver fetch failed"
ERR_POST = "resolver post failed"
ERR_META = "no og:video"
ERR_IPCAM = "ipcamlive: no address/streamid (offline?)"
ERR_SKYLINE = "skyline: no stream token (offline?)"
ERR_EARTHCAM = "earthcam: no live HLS (offline?)"
ERR_WETMET = "wetmet: no m3u8 in widget frame"
ERR_HDONTAP = "hdontap: no player-data stream (offline?)"
ERR_OZOLIO_ID = "ozolio: no camera id in target"
ERR_OZOLIO_JSON = "ozolio: relay returned non-JSON"
ERR_OZOLIO_SESSION = "ozolio: no relay session (offline?)"
ERR_OZOLIO_STREAM = "ozolio: no stream in open response (offline?)"
ERR_OZOLIO_LOOP = "ozolio: canned loop, not a live camera"
ERR_VIEWSURF_UUID = "viewsurf: no uuid in embed url"
ERR_VIEWSURF_HOSTS = "viewsurf: no manifest from any api host"
ERR_VIEWSURF_HLS = "viewsurf: no m3u8 in manifest api response"
ERR_BALTIC_ID = "baltic: no camera id in target"
ERR_BALTIC_HLS = "baltic: no m3u8 in auth_token response for id "
ERR_YTDLP = "yt-dlp failed: "
ERR_YTDLP_SPLIT = "yt-dlp returned a split format, not a muxed stream"
