"""Addresses, link patterns, title patterns and category tables of the source sites."""

# --- airportwebcams
AIRPORT_INDEX = "https://airportwebcams.net/airport-webcams-by-webcam-speed/"
AIRPORT_SECTION = "<strong>Streaming</strong>"
AIRPORT_SECTION_END = "<strong>"
AIRPORT_LINK = r'href="(https://airportwebcams\.net/[^"]+)"'
AIRPORT_CHANNEL = r"youtube\.com/(channel/[A-Za-z0-9_-]+|@[A-Za-z0-9_.-]+)"
AIRPORT_OCCASIONAL = "Live streamers with regular broadcasts"
AIRPORT_TITLE = r'rel="bookmark"[^>]*>([^<]+)'
AIRPORT_TAIL = r"\s*Webcams?\s*$"

# --- beachcam
BEACH_INDEX = "https://beachcam.meo.pt/livecams/"
BEACH_LINK = r'href="https?://beachcam\.meo\.pt/livecams/([^"/#?]+)/"'
BEACH_VIDEO = r'data-video-url="(https?://[^"]+\.m3u8)"'
BEACH_TOKEN_API = "https://services.iol.pt/matrix?userId="
BEACH_TOKEN_SHAPE = r"^[A-Za-z0-9+/=_-]{20,}$"
BEACH_TOKEN_PARAM = "?wmsAuthSign="
BEACH_TITLE = r'liveCamsHeader__title">([^<]*)<'
BEACH_REGION = r'liveCamsHeader__label">LIVECAMS\s*/\s*([^<]*)<'

# --- camscape; a slug with no category is known but stays uncategorised
CAMSCAPE_INDEX = "https://www.camscape.com/showing/"
CAMSCAPE_CATEGORY = {
    "alpacas": "Animals", "bats": "Animals", "beaches": "Beaches", "bears": "Animals", "bees": "Animals",
    "big-cats": "Animals", "big-dogs": "Animals", "birds": "Birds", "boats": "Ships", "bovines": "Animals",
    "buildings": "Buildings", "business-miscellaneous": None, "christmas": "Christmas", "cityscapes": "Cities",
    "critters": "Animals", "culture": None, "deer": "Animals", "domestic-animals": "Animals", "elephants": "Animals",
    "entertainment": "Entertainment", "giraffes": "Animals", "goats": "Animals", "horses": "Animals",
    "landscapes": "Parks", "monsters": None, "nature": "Parks", "nightlife": "Bars", "pigs": "Animals",
    "planes-airports": "Airports", "primates": "Animals", "religion": "Religion", "rivers-seas-lakes": "Rivers Lakes",
    "roads": "Traffic", "sealife": "Animals", "shopping-district": None, "ski-resorts": "Ski Resorts",
    "space-astronomy": "Space", "squirrels": "Animals", "tortoises": "Animals", "tourist-attractions": "Sights",
    "trains-railways": "Trains", "urban-spaces": "Cities", "zebras": "Animals",
}
CAMSCAPE_CATEGORY_PAGE = r'href="(https://www\.camscape\.com/showing/[a-z0-9-]+/)"'
CAMSCAPE_PAGE = r'href="(https://www\.camscape\.com/showing/[a-z0-9-]+/page/\d+/)"'
CAMSCAPE_CAM = r'href="(https://www\.camscape\.com/webcam/[a-z0-9-]+/)"'
CAMSCAPE_TAG = r'/showing/([a-z0-9-]+)/"'
CAMSCAPE_PLACE = r'/location/([a-z0-9-]+)/"'
TWITCH_PLAYER = "player.twitch.tv"
TWITCH_CHANNEL = r"[?&]channel=([A-Za-z0-9_]+)"
TWITCH_URL = "https://www.twitch.tv/"
CAMSECURE_EMBED = r"^https?://(?:[a-z0-9-]+\.)*camsecure\.[a-z.]+/"

# --- camsecure
CAMSECURE_SITEMAP = "https://www.camsecure.co.uk/sitemap.xml"
CAMSECURE_DOMAIN = "camsecure.co.uk"
CAMSECURE_SKIP = (
    "hosting", "features", "faq", "drivers", "ipnetwork", "map", "camsecure_webcam", "webcam_live_clock", "live_demo",
    "/index.html", "site_information", "/players/", "cctv", "software",
)
CAMSECURE_PLAYER = r'<iframe[^>]+src="(https?://camsecure\.[a-z.]+/httpswebcam/[^"]+)"'
CAMSECURE_HLS = r'<source[^>]+src="([^"]+\.m3u8[^"]*)"'
CAMSECURE_STUB = "rtsp.me"
CAMSECURE_TITLE = r"<title>([^<]+)</title>"
CAMSECURE_BOILER = r"\s*\b(?:live\s+)?(?:streaming\s+)?web\s?cam\b.*$"
CAMSECURE_LEADING = r"^(?:live|streaming|coastal)\b"
CAMSECURE_FROM = r"\bfrom\s+(.+?)\s*$"
CAMSECURE_SLUG_TAIL = r"[_\- ]*(?:large|webcam|cam)\d*$"

# --- cxtvlive
CXTV_SITEMAP = "https://www.cxtvlive.com/sitemap.xml"
CXTV_PAGE = "https://www.cxtvlive.com/live-camera/"
CXTV_SLUG = r"live-camera/([^<\s]+)"
CXTV_CATEGORY = r"cameras/category/([a-z0-9-]+)"

# --- shared by several sites
ANY_LOC = r"<loc>([^<]+)</loc>"
SHORT_H1 = r"<h1[^>]*>([^<]{1,120})</h1>"
WHOLE_TITLE = r"<title>(.*?)</title>"
LD_JSON = r'<script type="application/ld\+json"[^>]*>(.*?)</script>'

# --- earthcam
EARTHCAM_NETWORK = "https://www.earthcam.com/api/mapsearch/get_locations_network.php?r=ecn&a=fetch"
EARTHCAM_GLOBAL = (
    "https://www.earthcam.com/api/mapsearch/get_locations.php?nwx=85&nwy=-180&nex=85&ney=180"
    "&sex=-85&sey=180&swx=-85&swy=-180&zoom=3"
)
EARTHCAM_VIDEO = r"(?:youtube\.com/(?:watch\?v=|embed/|live/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})"
EARTHCAM_HOSTS = ("www.earthcam.com", "earthcam.com")
EARTHCAM_SECTIONS = ("usa", "world")
EARTHCAM_PARTNER = ("balticlivecam.com",)

# --- explore
EXPLORE_API = "https://d11gsgd2hj8qxd.cloudfront.net/streams.json"

# --- feratel
FERATEL_SITEMAP = "https://www.feratel.com/sitemap-0.xml"
FERATEL_LOC = r"<loc>(https://www\.feratel\.com/en/webcams/[^/<]+/[^/<]+/[^/<]+)</loc>"
FERATEL_PLAYER = r'<iframe[^>]+data-src="[^"]*?\bcam=(\d+)[^"]*"'
FERATEL_TITLE = r"<title>Webcams in ([^<]*?)\s*-\s*Livecams[^<]*</title>"
FERATEL_URL = "https://webtv.feratel.com/webtv/?cam="

# --- hdontap
HDONTAP_SITEMAP = "https://hdontap.com/sitemap.xml"
HDONTAP_LOC = r"<loc>(https://hdontap\.com/stream/(\d+)/[^<]*)</loc>"
HDONTAP_TITLE = r"<title>([^<]*)</title>"
HDONTAP_SUFFIX = r"\s*[-|]\s*HDOnTap\s*$"
HDONTAP_BOILER = r"\s*\b(?:live\s+)?(?:streaming\s+|beach\s+)?(?:web\s?cam|cam)\s*$"

# --- livefromiceland
ICELAND_INDEX = "https://livefromiceland.is/wp-json/wp/v2/webcam?per_page=100"
ICELAND_PREFIX = "https://livefromiceland.is/webcam/"
ICELAND_PLAYER = r"https://g0\.ipcamlive\.com/player/player\.php\?alias=[A-Za-z0-9_-]+"
ICELAND_TAIL = r"\s*[–-]\s*Live From Iceland\s*$"

# --- livespotting
LIVESPOTTING_BASE = "https://www.livespotting.tv"
LIVESPOTTING_COUNTRIES = ("/deutschland", "/griechenland", "/kroatien", "/oesterreich", "/schweiz")
LIVESPOTTING_LINK = r'href="(/[a-z-]+/[a-z0-9-]+/([a-z0-9]{8}))"'
LIVESPOTTING_API = "https://player.livespotting.com/v2/livesource/"
LIVESPOTTING_API_TAIL = "?type=hub"

# --- ozolio
OZOLIO_SITEMAP = "https://www.ozolio.com/cameras-sitemap.xml"
OZOLIO_PAGE = r"^https?://www\.ozolio\.com/explore/[A-Z0-9]+$"
OZOLIO_TITLE = r"<title>([^<]+?)\s*-\s*Webcam\s*-\s*Ozolio\s*</title>"

# --- resortcams
RESORT_SITEMAP = "https://www.resortcams.com/webcams-sitemap1.xml"
RESORT_LOC = r"<loc>(https://www\.resortcams\.com/webcams/[^<]+)</loc>"
RESORT_TAIL = r"\s*[–-]\s*Resort Cams\s*$"

# --- shareju
SHAREJU_INDEX = "https://its-i.com/camera"
SHAREJU_LD_JSON = r'<script type="application/ld\+json">(.*?)</script>'
SHAREJU_PREFIX = r"^【[^】]*】"
SHAREJU_SUFFIX = r"【Share-Ju】.*$"
SHAREJU_TAGS = r"このカメラに付されているタグ（([^）]*)）"
SHAREJU_CATEGORY = {
    "河川": "Rivers Lakes", "水害監視カメラ": "Rivers Lakes", "交通情報": "Traffic", "交通状況": "Traffic", "道路": "Traffic",
    "渋滞": "Traffic", "交通": "Traffic", "鉄道": "Trains", "新幹線": "Trains", "駅": "Trains", "空港": "Airports",
    "飛行機": "Airports", "港": "Ports", "海": "Beaches", "海岸": "Beaches", "ビーチ": "Beaches", "スキー": "Ski Resorts",
    "スノーボード": "Ski Resorts", "スキー場": "Ski Resorts", "ゲレンデ": "Ski Resorts", "富士山": "Mountains", "山": "Mountains",
    "城": "Castles", "神社": "Churches", "寺": "Churches",
}

# --- skyline; a slug with no category is known but stays uncategorised
SKYLINE_BASE = "https://www.skylinewebcams.com"
SKYLINE_INDEX = "https://www.skylinewebcams.com/en/live-cams.html"
SKYLINE_CATEGORY = {
    "beach": "Beaches", "city": "Cities", "nature-mountain": "Mountains", "seaport": "Ports", "ski": "Ski Resorts",
    "lake": "Rivers Lakes", "animals": "Animals", "unesco": "Sights", "volcanoes": "Volcanoes", "live-web": None,
}
SKYLINE_SLUG = r"/en/live-cams-category/([a-z0-9-]+)-cams\.html"
SKYLINE_CAM = r'href="(en/webcam/[a-z0-9/-]+\.html)"'
SKYLINE_COUNTRY = r'href="(/en/webcam/[a-z-]+\.html)"'
SKYLINE_SUBREGION = r'href="(/en/webcam/[a-z0-9/-]+\.html)" class="btn[^"]*tag"'
SKYLINE_NAME_TAIL = r"\s*live cam\s*$"
SKYLINE_BREADCRUMB = r'<ol class="breadcrumb".*?</ol>'
SKYLINE_CRUMB = r'<span itemprop="name">([^<]+)</span>'
SKYLINE_TOKEN = r"source:'livee?\.m3u8\?a=[a-z0-9]+'"
SKYLINE_VIDEO = r"videoId:'([A-Za-z0-9_-]{11})'"

# --- tomarigi
TOMARIGI_SITEMAP = "https://tomarigi.me/sitemap.xml"
TOMARIGI_LOC = r"<loc>(https://tomarigi\.me/spot/[0-9a-f-]{36})</loc>"
TOMARIGI_SENTENCE = r"。([^」。]{1,8})のライブカメラ"
TOMARIGI_CATEGORY = {
    "海": "Beaches", "自然": "Parks", "街": "Cities", "名所": "Sights", "鉄道": "Trains", "空港": "Airports", "動物": "Animals",
    "その他": "Other",
}
TOMARIGI_UNCATEGORISED = ("河川・道路",)

# --- viewsurf
VIEWSURF_SITEMAP = "https://www.viewsurf.com/sitemap.xml"
VIEWSURF_CATEGORY = {"montagne": "Mountains", "plage": "Beaches", "surf": "Beaches", "trafic": "Traffic", "ville": "Cities"}
VIEWSURF_LOC = r"<loc>(https://(?:www\.)?viewsurf\.com/univers/([a-z0-9-]+)/vue/(\d+)-[a-z0-9-]+)</loc>"
VIEWSURF_UNIVERS = r"/univers/([a-z0-9-]+)/vue/"
VIEWSURF_COUNTRY = r"/vue/\d+-([a-z0-9]+)"
VIEWSURF_EMBED = r"platforms\d+\.joada\.net/embeded/embeded\.html\?uuid=([0-9a-f-]+)&(?:amp;)?type=(live|vod)"
VIEWSURF_URL = "https://platforms5.joada.net/embeded/embeded.html?uuid="
ANY_H1 = r"<h1[^>]*>(.*?)</h1>"

# --- webcamerapl
WEBCAMERA_BASE = "https://www.webcamera.pl"
WEBCAMERA_MAP = "https://www.webcamera.pl/mapa"
WEBCAMERA_MARKERS = "var MAP_MARKERS"
WEBCAMERA_LISTINGS = (
    ("plaze-i-morze", "Beaches"), ("mazury", "Rivers Lakes"), ("miasta", "Cities"), ("stacje-narciarskie", "Ski Resorts"),
    ("gory", "Mountains"),
)
WEBCAMERA_LISTING_START = 'id="inline-camera-listing"'
WEBCAMERA_LISTING_END = "searchbox-cams"
WEBCAMERA_LINK = r'href="(https://[a-z0-9.-]+\.webcamera\.pl/[^"]*)"'
WEBCAMERA_VIDEO = r'"video_src":"((?:[^"\\]|\\.)*)"'
WEBCAMERA_H1 = r'<h1 id="cam-description-toggler">([^<]*)'
WEBCAMERA_BADGE = r"(?:\s*[-–]?\s*(?:nowość|nowosc|kup dostęp))+\s*$"
WEBCAMERA_SKIP = r"playlist|premium"
WEBCAMERA_NOT_CAMS = ("static", "b2b", "pogoda", "imageserver")

# --- whatsupcams
WHATSUP_INDEX = "https://www.whatsupcams.com/en/sitemap_index.xml"
WHATSUP_DOMAIN = "whatsupcams.com"
WHATSUP_MAP = r"/webcams-sitemap\d*\.xml$"
WHATSUP_ID = r"services\.whatsupcams\.com/wgt/([A-Za-z0-9_]+)"
WHATSUP_TITLE = r'property="og:title" content="([^"]+)"'
WHATSUP_API = "https://www.whatsupcams.com/cdn-api/streams/"
WHATSUP_DEPTH = 6

# --- wildlife-trusts
WILDLIFE_INDEX = "https://www.wildlifetrusts.org/webcams"
WILDLIFE_LINK = r'<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>'
WILDLIFE_IS_CAM = r"(webcam|-cam|/cam|camera|live[- ])"
WILDLIFE_NOT_CAM = (
    r"facebook|twitter|linkedin|wa\.me|sharer|instagram|whatsapp|googletag|/files/"
    r"|\.(jpg|png|css|js)|wildlifetrusts\.org/(webcams|get-)"
)
WILDLIFE_APOSTROPHE = r"&#0?39;|&apos;|&rsquo;"
WILDLIFE_ENTITY = r"&[a-z]+;|&#\d+;"
WILDLIFE_PREFIX = r"^.*?Wildlife Trust\s+"
WILDLIFE_TAIL = r"\s+(Watch|See|View|Live\b|Click)\b.*$"
WILDLIFE_TITLE_CHARS = 60

# --- windy
WINDY_LIST = "https://node.windy.com/webcams/v2.0/list?nearby="
WINDY_STREAM = "https://webcams.windy.com/webcams/stream/"
WINDY_IFRAME = r'<iframe[^>]+src="([^"]+)"'

# --- worldcams
WORLDCAMS_BASE = "https://worldcams.tv"
WORLDCAMS_LIST = "https://worldcams.tv/list/?page="
WORLDCAMS_LINK = r'class="cam-promo__title"[^>]*>\s*<a href="([^"]+)"'
WORLDCAMS_CATEGORY = r'Category:\s*(?:&nbsp;)?<a href="/([^/]+)/">([^<]+)</a>'
WORLDCAMS_NAME = r'id="streams__item_(\d+)"[^>]*>\s*([^<]+?)\s*</a>'

# --- youtube-api: landed responses, one document per search window and per lookup of ids
YT_SEARCH = "https://www.googleapis.com/youtube/v3/search"
YT_VIDEOS = "https://www.googleapis.com/youtube/v3/videos"
