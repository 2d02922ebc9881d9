"""The category taxonomy. They decide the published category, so they are data, not choices of this code."""

OTHER = "Other"
UNMAPPED = "Unmapped Category"
GEO_CATEGORY = "Travel & Events"

# Raw category of a source -> published category.
CATEGORY_MAP = {
    "Animals": "Animals",
    "Birds": "Animals",
    "Pets & Animals": "Animals",
    "Aquariums": "Aquariums",
    "Beaches": "Beaches",
    "Water": "Water & Waterways",
    "Rivers Lakes": "Water & Waterways",
    "Pools": "Water & Waterways",
    "Ships": "Ports & Ships",
    "Ports": "Ports & Ships",
    "Mountains": "Mountains",
    "Ski Resorts": "Mountains",
    "Volcanoes": "Mountains",
    "Parks": "Nature & Parks",
    "Cities": "Cities",
    "Sights": "Landmarks",
    "Bridges": "Landmarks",
    "Buildings": "Landmarks",
    "Castles": "Landmarks",
    "Monuments": "Landmarks",
    "Religion": "Religion",
    "Churches": "Religion",
    "Vatican": "Religion",
    "Airports": "Airports",
    "Traffic": "Traffic",
    "Autos & Vehicles": "Traffic",
    "Trains": "Trains & Railways",
    "Railway Stations": "Trains & Railways",
    "Bars": "Bars & Nightlife",
    "Bars Clubs Restaurants": "Bars & Nightlife",
    "Sports": "Sports",
    "Stadiums": "Sports",
    "Hotels": "Hotels",
    "Schools Universities": "Education",
    "Education": "Education",
    "Music": "Music",
    "Space": "Space",
    "Christmas": "Seasonal",
    "Radio Studios": "Studios",
    "Weather": "Weather",
    "Sports Live": "Sports",
    "Watch Soccer Live": "Sports",
    "High Definition Hd": "Other",
    "Other": "Other",
}

# Video-platform category names that are published as they are.
PASS_THROUGH = (
    "Entertainment",
    "Travel & Events",
    "People & Blogs",
    "News & Politics",
    "Science & Technology",
    "Nonprofits & Activism",
    "Gaming",
    "Film & Animation",
    "Howto & Style",
    "Comedy",
)

TAXONOMY = tuple(sorted(set(CATEGORY_MAP.values()) | set(PASS_THROUGH) | {OTHER, UNMAPPED}))

# Category id of the video platform -> category name.
VIDEO_CATEGORY_IDS = {
    "1": "Film & Animation",
    "2": "Autos & Vehicles",
    "10": "Music",
    "15": "Pets & Animals",
    "17": "Sports",
    "19": "Travel & Events",
    "20": "Gaming",
    "22": "People & Blogs",
    "23": "Comedy",
    "24": "Entertainment",
    "25": "News & Politics",
    "26": "Howto & Style",
    "27": "Education",
    "28": "Science & Technology",
    "29": "Nonprofits & Activism",
}

# The title rules, in order, first match wins, matched without regard to case on the part before " — ".
TITLE_RULES = (
    ("Animals",
     r"\b(bear|eagle|osprey|falcon|peregrine|hawk|owl|heron|egret|stork|puffin|gannet|kittiwake|\btern\b|penguin|manatee"
     r"|otter|\bseal\b|sea ?lion|walrus|dolphin|whale|orca|shark|panda|tiger|\blion\b|elephant|giraffe|gorilla|lemur|sloth"
     r"|monkey|bison|buffalo|\bdeer\b|moose|\belk\b|\bfox\b|\bwolf|\bbat\b|\bbee\b|alpaca|llama|sheep|\bgoat|\bpig\b|horse"
     r"|pony|cattle|\bcow\b|alligator|crocodile|tortoise|turtle|kitten|pupp|\bcat cam|\bdog\b|guide dogs|\bbird|wildlife"
     r"|\bzoo\b|aquarium|reef|coral|salmon|hummingbird|feeder|\bnest(s|ing)?\b|aviary|sanctuary|\bgull|\bswan|\bduck\b|goose"
     r"|flamingo|parrot|condor|vulture|badger|hedgehog|squirrel|raccoon|toucan|rhino|\bmares?\b|foal|musk ox|guillemot|roller"
     r"|canine|safari|africam|\bmara\b|kalahari|savanna|pasture|fishing hole)"
     r"|動物園|水族館|野鳥|野生動物|コウノトリ"),
    ("Weather", r"\b(weather|northern lights|aurora)\b|天気|気象"),
    ("Religion",
     r"\b(church(es)?|mosque|temple|chapel|basilica|cathedral|minster|abbey|shrine|synagogue)\b"
     r"|神社|神宮|大社|寺院|参道|教会|大仏"),
    ("Music", r"\b(philharmon|concert|opera|theatre|theater|orchestra|symphony|bandstand|amphitheat)"),
    ("Entertainment", r"\b(aquapark|waterpark|amusement|theme park|funfair|casino|fairground|karaoke)"),
    ("Sports",
     r"\b(sailing club|\bgolf\b|gliding|\bregatta|stadium|\btennis|football|cricket|\bgolf(klubb|club|platz|baan|bana|park))"
     r"|競技場|スタジアム|ゴルフ場|野球場"),
    ("Space", r"\b(observatory|\biss\b|telescope|starry|space station|cosmodrome)"),
    ("Airports", r"\b(airport|airfield|runway|aerodrome)\b|空港|飛行場"),
    ("Trains & Railways", r"\b(railway|railroad|\btrain|locomotive|\brail\b)|(?<!道の)駅|鉄道|新幹線|電車|踏切"),
    ("Ports & Ships",
     r"\b(harbou?r|marina|\bpier\b|wharf|\bquay|lifeboat|\byacht|\bdocks?\b|seaport|\bport\b|\bferry\b|shipping|\bhafen\b)"
     r"|漁港|港湾|埠頭|マリーナ|フェリー"),
    ("Bars & Nightlife", r"\b(\bpub\b|tavern|nightclub|\bbar\b|brewery|cocktail)"),
    ("Mountains",
     r"\b(\bski\b|\balps\b|alpine|glacier|volcano|\bpiste|\bsummit|\bmount\b|mountain|\bpeak\b|dolomite|\bdome\b|\bbutte\b"
     r"|\bmesa\b|\bgorge\b|narciarsk|montagn[ae]\b|bergbahn|gondelbahn|seilbahn|bergstation)"
     r"|スキー場|ゲレンデ|山頂|富士山|登山"),
    ("Education", r"\b(universit|college|campus|schule)|大学|学校|キャンパス"),
    ("Hotels", r"\b(hotell?|gasthof|guest ?house|pension)\b|旅館|温泉宿"),
    ("Landmarks",
     r"\b(\bbridge|castle|\btowers?\b|\bfort\b|fortress|monument|palace|lighthouse|statue|memorial|\barch\b|citadel|obelisk"
     r"|granar|windmill)|puente|brücke|お城|城跡|天守|タワー|灯台|展望台"),
    ("Beaches",
     r"\b(beach|\bsurf|seafront|esplanade|\bplaya|\bpraia|\bsands?\b|\bshore|boardwalk|promenade|\bcove\b|\bdunes?\b|\bcoast"
     r"|(?<!the )\bstrand|spiaggia|\bplage\b|pla[żž])|海岸|砂浜|ビーチ|海水浴場"),
    ("Water & Waterways",
     r"\b(\blake|\briver|\bfalls\b|waterfall|\bcanal|lagoon|\bpond|\bloch\b|reservoir|estuary|\bcreek|\bweir\b|fjord|\bdam\b"
     r"|rapids|\bbay\b|\bcaverns?\b|\bcaves?\b|\bfirth\b|\bsound\b|jezior|jezero)"
     r"|河川|水害|水位|映像監視局|用水|ダム|運河|合流|支流"
     r"|[川湖滝](?:(?=映像|カメラ|ライブ|合流|上流|下流|水位|畔)|(?![ぁ-んァ-ヶ一-龥A-Za-z0-9]))"),
    ("Traffic",
     r"\b(\btraffic|highway|motorway|interstate|freeway|roundabout|expressway|\bhwy\b|I-\d{1,3}\b)"
     r"|国道|県道|道道|市道|道の駅|交差点|高速|自動車道|バイパス|街道|渋滞|道路|トンネル|ラウンドアバウト|インターチェンジ"),
    ("Nature & Parks",
     r"\b(national park|\bpark\b|nature reserve|\bgarden|\bforest|\bmeadow|\bvalley|\bcanyon|botanic|\bmoor\b|\bheath\b"
     r"|\bwoods?\b|wetland)|公園|森林|渓谷|湿原"),
    ("Cities",
     r"\b(skyline|cityscape|\bsquare\b|downtown|\bplaza|boulevard|\bcity\b|old town|piazza|\bstreet\b|panorama|\btown\b"
     r"|village|\bcentre\b|\bcenter\b|centar|altstadt|innenstadt|\brynek\b)|市街地|商店街|繁華街|歩行者天国"),
)
# A title that names a place ("City, Region", " - Country", a geo suffix).
GEO_HINT = r" — |,\s+[A-Z]| - [A-Z][a-z]+\s*\.?\s*$"
