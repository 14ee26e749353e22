"""Word lists, suffixes, thresholds and priorities that results depend on."""

# Letters folded to ASCII before lower-casing, in pairs.
FOLD_FROM, FOLD_TO = "çğıöşüÇĞİIÖŞÜ", "cgiosucgiiosu"

# Words of legal forms, and joining words ignored in legal names.
LEGAL_WORDS = ("ltd", "sti", "san", "sanayi", "tic", "ticaret", "anonim", "limited", "as", "co", "inc", "gmbh")
JOINING_WORDS = ("ve", "and", "sirket", "sirketi")

# Sector words, then words of trades, then corporate words, none of which is a brand.
SECTOR_WORDS = ("demir", "celik", "metal", "kimya", "kimyasal", "boya", "profil", "sac", "hadde", "haddecilik", "endustri", "makine")
BUSINESS_WORDS = (
    "endustriyel", "mineraller", "kimyasal", "maddeler", "tekstil", "hizmetleri", "servis", "satis", "ambalaj", "barkod",
    "dijital", "baski", "sistemleri", "elektronik", "dahili", "ve",
)
BRAND_GENERIC_WORDS = (
    "group", "grup", "global", "kozmetik", "gida", "food", "dried", "kagit", "seluloz", "lojistik", "ic", "dis", "sirket",
    "sirketi", "urun", "urunleri",
)

# Public suffixes of two labels.
MULTI_PART_SUFFIXES = (
    "com.tr", "net.tr", "org.tr", "biz.tr", "info.tr", "web.tr", "gen.tr", "av.tr", "bel.tr", "gov.tr", "edu.tr", "k12.tr",
    "pol.tr", "tsk.tr", "co.uk", "org.uk", "gov.uk", "ac.uk",
)
PUBLIC_BODY_SUFFIXES = (".gov.tr", ".bel.tr", ".k12.tr", ".edu.tr", ".pol.tr", ".tsk.tr", ".gov", ".edu")
FOREIGN_TLDS = (
    "ae", "at", "au", "be", "bg", "br", "ca", "ch", "cn", "cz", "de", "dk", "es", "fi", "fr", "gr", "hu", "ie", "il", "in",
    "ir", "it", "jp", "kr", "nl", "no", "pl", "pt", "qa", "ro", "ru", "sa", "se", "sg", "sk", "uk", "us",
)
MIRROR_DOMAINS = ("siteindices.com",)

# Hosts that are never a company's own site.
EXCLUDED_DOMAINS = (
    "linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "pinterest.com", "yelp.com",
    "wikipedia.org", "eksisozluk.com", "trendyol.com", "hepsiburada.com", "n11.com", "amazon.com.tr", "yemeksepeti.com",
    "tripadvisor.com", "tripadvisor.com.tr", "sikayetvar.com", "yandex.com", "yandex.com.tr", "maps.google.com", "google.com",
    "google.com.tr", "apps.apple.com", "play.google.com", "webfactory.com.tr", "wa.me", "t.me", "era.az", "icaevents.com.tr",
    "bbc.com", "turkishexporter.com.tr", "turkishexporter.net", "turkish-manufacturers.com", "ito.org.tr", "gulfood.com",
    "gso.org.tr", "find.com.tr", "mukellef.info", "europages.com.tr", "yellowpages.com", "kompass.com", "europages.com",
    "indeed.com", "glassdoor.com", "kariyer.net", "isinolsun.com", "idef.com.tr", "ifco.com.tr", "beautyeurasia.com",
    "crm.idos.events", "masterchef.com.tr", "fashionunited.com.tr", "sistemglobal.com.tr", "royalcert.com", "demircelik.com.tr",
    "metalmedya.com", "heyzine.com", "issuu.com", "fliphtml5.com", "anyflip.com", "publuu.com", "flipsnack.com", "scribd.com",
    "docs.google.com", "drive.google.com", "all.biz", "tradekey.com", "tradeindia.com", "tradeatlas.com", "exportersindia.com",
    "go4worldbusiness.com", "made-in-china.com", "ec21.com", "exporthub.com", "company-list.org", "alibaba.com",
    "alibaba.com.tr", "alibabagroup.com", "ecocert.com", "emis.com", "tendata.com", "rocketreach.co",
)

# E-mail prefixes in order of preference, prefixes never published, placeholder domains.
EMAIL_PREFIXES = ("sales", "export", "office", "info", "marketing")
BLOCKED_EMAIL_PREFIXES = (
    "privacy", "dataprotection", "data-protection", "dpo", "kvkk", "webmaster", "postmaster", "abuse", "noreply", "no-reply",
    "donotreply", "do-not-reply", "global", "globalinfo",
)
BAD_EMAIL_DOMAINS = ("example.com", "mail.com", "sentry.io")

# Scores and limits.
MIN_ACCEPT, REVIEW_SCORE, MEDIUM_SCORE, HIGH_SCORE = 65, 60, 75, 90
POLICY_MIN_SAFETY, SCORE_GAP, MAX_CANDIDATES, AMBIGUITY_MARGIN = 75, 24, 8, 5
SCORE_CAP, RANK_BONUS = 92, 8
RATE_PER_SECOND, CIRCUIT_FAILURES, CIRCUIT_COOLDOWN_S = 3, 3, 300
WILSON_Z = 1.959963984540054

# Topic words by context.
CONTEXTS = {
    "kozmetik": (
        "kozmetik", "cosmetic", "cosmetics", "beauty", "dermokozmetik", "dermocosmetic", "personal care", "kisisel bakim",
        "skin care", "cilt bakim", "makeup", "makyaj",
    ),
    "temizlik": ("temizlik", "cleaning", "hijyen", "hygiene", "detergent", "disinfectant", "wet wipe", "wet wipes", "diaper"),
    "gida": (
        "gida", "food", "beverage", "drink", "chocolate", "biscuit", "cake", "bakery", "confectionery", "candy", "halva",
        "turkish delight", "sauce", "olive", "olives", "olive oil", "pickle", "pickles", "pepper paste", "pulp", "puree",
        "tomato paste", "hazelnut", "pistachio", "kadayif", "frozen food", "meat", "mineral water", "carbonated", "fruit",
        "juice", "snack", "fmcg", "fish", "seafood", "balik", "su urunleri",
    ),
    "ambalaj": ("ambalaj", "packaging", "label", "shrink sleeve", "carton", "box", "etiket", "matbaa", "printing"),
    "tekstil": ("tekstil", "giyim", "moda", "fashion", "clothing", "apparel", "garment", "ready to wear", "hazir giyim", "triko"),
    "ev_mutfak": (
        "ev ve mutfak esyalari", "ev mutfak", "zuccaciye", "home and kitchen", "homeware", "housewares", "kitchenware",
        "cookware", "tableware", "dinnerware", "glassware", "porcelain", "ceramic", "cutlery", "flatware", "kitchen appliances",
        "small domestic appliances", "sofra", "mutfak", "porselen", "seramik", "cam esya", "catal bicak", "tencere", "tava",
        "pisirme gerecleri",
    ),
    "makine": ("makine", "machine", "machinery", "equipment", "manufacturing line"),
    "kimya": ("kimya", "chemical", "chemicals"),
    "plastik": ("plastik", "plastic"),
    "baski": ("baski", "printing", "print"),
    "elektronik": ("elektronik", "electronic", "electronics"),
    "laboratuvar": ("laboratuvar", "laboratory", "laboratory services"),
    "otomotiv": (
        "otomotiv", "automotive", "automotive aftermarket", "aftermarket", "auto parts", "vehicle parts", "yedek parca",
        "spare parts", "driveshaft", "drive shaft", "suspension", "suspansiyon", "egzoz", "exhaust", "friction", "gasket",
        "connecting rod", "motor oil", "lubricant",
    ),
}

# Activity words that a site of the company should show, words of hosts that are no company's, words of directories.
CONTEXT_WORDS = (
    "kozmetik", "cosmetic", "cosmetics", "gida", "food", "temizlik", "cleaning", "kimya", "boya", "tekstil", "ambalaj", "barkod",
    "baski", "elektronik", "mineraller", "plastik", "plastic", "otomotiv", "automotive",
)
NON_COMPANY_KEYWORDS = (
    "spor", "sport", "kulubu", "belediye", "municipality", "universite", "university", "edu", "project", "github", "gitlab",
    "sourceforge", "docs", "wiki", "blogspot", "wordpress",
)
GENERIC_KEYWORDS = (
    "alibaba", "amazon", "marketplace", "directory", "firma", "firmalar", "metalmarket", "trade", "b2b", "exporters", "portal",
    "haber", "news", "medya", "fair", "expo", "ihracat", "katalog", "rehber", "sanayirehber", "ticaretrehber", "sirketler",
    "kobirehber", "ihracatci", "sektor",
)

# Words that translate each other in brands and in domains.
BRAND_EQUIVALENTS = {
    "ileri": ("advanced",), "advanced": ("ileri",), "malzeme": ("material", "materials"), "malzemeler": ("material", "materials"),
    "material": ("malzeme", "malzemeler"), "materials": ("malzeme", "malzemeler"), "teknoloji": ("technology", "technologies"),
    "teknolojileri": ("technology", "technologies"), "technology": ("teknoloji", "teknolojileri"),
    "technologies": ("teknoloji", "teknolojileri"), "saglik": ("health", "healthcare"), "health": ("saglik",),
    "healthcare": ("saglik",), "tibbi": ("medical",), "medikal": ("medical",), "medical": ("tibbi", "medikal"),
    "tekstil": ("textile",), "textile": ("tekstil",), "makine": ("machine", "machinery"), "makina": ("machine", "machinery"),
    "machine": ("makine", "makina"), "machinery": ("makine", "makina"),
}
DOMAIN_EQUIVALENTS = {"chocolate": ("cikolata",), "cikolata": ("chocolate",), "candy": ("seker", "sekerleme"), "seker": ("candy",), "sekerleme": ("candy",)}

# Activities by word, words that are none, and what joins no two names.
ACTIVITIES = {
    "tarim": "agriculture", "agriculture": "agriculture", "agricultural": "agriculture", "agro": "agriculture", "tekstil": "textile",
    "textile": "textile", "makine": "machinery", "makina": "machinery", "machine": "machinery", "machinery": "machinery",
    "medikal": "medical", "tibbi": "medical", "medical": "medical", "saglik": "health", "health": "health", "healthcare": "health",
}
NO_ACTIVITIES = ("ve", "dahili", "hizmetleri", "servis", "satis", "sistemleri", "endustri", "endustriyel", "maddeler")
BRIDGE_NOISE = ("ic", "dis", "paz", "pazarlama", "tic", "ticaret", "ith", "ihr", "ithalat", "ihracat", "san", "sanayi")
OWNERSHIP_MARKERS = (
    "ait bir marka", "markasidir", "markasi", "bunyesinde", "ticari unvani", "resmi unvani", "bir markadir", "brand of", "a brand of",
    "owned by", "belongs to", "operated by", "trading name of", "part of",
)

# Words that make a short name ambiguous, words that place a site in the country.
AMBIGUOUS_WORDS = ("fashion", "white", "stone", "master", "cook", "royal", "global", "look", "keep", "euro", "la")
COUNTRY_WORDS = ("turkiye", "turkey", "istanbul", "ankara", "izmir", "bursa", "kocaeli", "konya", "gaziantep")
SAFE_OK_MIN_SCORE = 85

# Kinds of business by their words, and kinds that exclude each other.
TAXONOMY = {
    "metal_industry": (
        "celik", "steel", "metal", "demir", "dokum", "foundry", "hadde", "profil", "sac", "paslanmaz", "ferro", "metalurji", "metallurgy",
    ),
    "machinery": ("makine", "machinery", "machine", "otomasyon", "automation", "robotik", "robotics", "endustriyel ekipman"),
    "finance": ("banka", "bank", "banking", "finans", "finance", "kredi", "yatirim hizmetleri", "investment services"),
    "hospitality_travel": (
        "otel", "hotel", "resort", "konaklama", "hospitality", "turizm", "travel agency", "seyahat acentesi",
    ),
    "education": ("universite", "university", "okul", "school", "akademi", "academy", "egitim kurumu"),
    "government": ("belediye", "bakanlik", "ministry", "municipality", "kamu kurumu", "valilik"),
    "media": ("gazete", "newspaper", "haber", "news media", "televizyon", "radio", "yayincilik"),
    "retail_marketplace": ("marketplace", "pazaryeri", "online magaza", "e ticaret", "perakende", "retail store"),
    "construction": ("insaat", "construction", "mimarlik", "architecture", "muteahhit", "yapi malzemeleri"),
    "chemicals": ("kimya", "chemical", "chemicals", "boya", "paint", "polimer", "polymer"),
    "logistics": ("lojistik", "logistics", "nakliye", "transportation", "freight", "depolama"),
}
INCOMPATIBLE = {
    "metal_industry": ("finance", "hospitality_travel", "education", "government", "media"),
    "machinery": ("finance", "hospitality_travel", "education", "government"),
}
