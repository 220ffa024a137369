"""Default lexicons: our own entries; every operator takes others as a parameter."""

from __future__ import annotations

#: (pattern, canonical name, category); patterns of one name are combined, so a hit counts once.
PRODUCTS = (
    (r"nyati\s?max", "Nyati Max", "pickup"), (r"tembo\s?4x4", "Tembo 4x4", "suv"), (r"mbogo hauler", "Mbogo Hauler", "lorry"),
    (r"swala mini", "Swala Mini", "van"), (r"tai cargo", "Tai Cargo", "van"), (r"kifaru\s?300", "Kifaru 300", "lorry"),
    (r"pundi shuttle", "Pundi Shuttle", "bus"), (r"duma gt", "Duma GT", "coupe"),
)
PARTNERS = (
    (r"cooperative|ushirika", "Cooperative", "lender"), (r"savings group|akiba ya kikundi", "Savings group", "lender"),
    (r"county clinic|kliniki ya kaunti", "County clinic", "health"), (r"tribunal|mahakama", "Tribunal", "court"),
    (r"airport shuttle|lake ferry", "Transfers", "travel"),
)
#: Spellings of one brand: (pattern, spelling); the first is the canonical one.
BRAND = ((r"karani motors", "karani motors"), (r"#karanimotors", "#karanimotors"), (r"karani\.motors", "karani.motors"))
INTENT = {
    "high": ("price", "bei ni", "le prix", "der preis", "order ref", "send the quote", "for the full package", "call or whatsapp"),
    "medium": ("recommend", "details", "is worth the detour", "back in stock", "i would bet"),
    "low": ("questions", "surprised", "what do you think", "let us know", "who should see"),
}
TOPICS = (
    ("repair", ("gearbox", "brake", "garage", "spare tyre", "radiator", "mechanic", "karakana")),
    ("money", ("loan", "salary", "insurance", "exchange rate", "budget", "riba", "shilling")),
    ("matches", ("goal", "referee", "championship", "penalty", "stadium", "bao", "mechi")),
    ("apps", ("server", "login", "update", "database", "password", "kompyuta")),
    ("courts", ("court", "contract", "magistrate", "appeal", "clause", "hakimu")),
    ("fields", ("harvest", "maize", "goat", "coffee", "tomato", "mbolea")),
    ("clinics", ("clinic", "nurse", "vaccine", "malaria", "dentist", "daktari")),
    ("trips", ("hotel", "resort", "ferry", "ticket", "hostel", "watalii")),
)
#: (id, name, type, hashtags, slogans, mentions)
CAMPAIGNS = (
    ("c1", "Road ready", "product", ("#roadready", "#trucklife"), ("built for the road ahead",), ("@roadready.ke",)),
    ("c2", "Fan zone", "sponsorship", ("#fanzone",), ("open all week",), ("@the_pit_crew",)),
    ("c3", "Field day", "community", ("#fieldday", "#mashinani"), (), ("@mashinani_news",)),
    ("c4", "Deals", "promotion", ("#deals", "#newdrop"), ("only this week",), ("@dealwatch",)),
)
#: Emoji and their polarity.
EMOJI = {
    "😂": 1, "❤️": 1, "❤": 1, "🔥": 1, "🎉": 1, "💯": 1, "🙏": 1, "👏": 1, "😡": -1, "🤷": 0, "👀": 0, "🚚": 0, "🛠": 0,
}
POSITIVE = {
    "english": ("improved", "cured", "recommend", "smooth", "smoothly", "free", "best", "ripened", "relieved", "worth it"),
    "swahili": ("imeshinda", "tumefurahi", "bure", "imerekebishwa", "kwenye soko"),
    "sheng": ("poa", "fiti", "noma", "imebamba"),
}
NEGATIVE = {
    "english": ("bounced", "leaks", "crashes", "overheated", "dismissed", "delayed", "cancelled", "grinding noise", "bad", "lost"),
    "swahili": ("ilichelewa", "inavuja", "imetupiliwa", "mbovu", "kodi ya asilimia"),
    "sheng": ("imehang", "inacrash", "imebounce", "stress"),
}
MARKERS = {
    "sheng": ("wasee", "msee", "manze", "buda", "mbogi", "doo", "bana", "juu", "noma", "poa", "rada", "niaje"),
    "swahili": ("na", "ya", "wa", "kwa", "hii", "kama", "baada", "kabla", "wote", "sana", "lakini", "huku"),
    "english": ("the", "and", "of", "was", "with", "for", "is", "to", "this", "that"),
    "french": ("le", "la", "les", "et", "des", "pour", "est", "une", "dans", "du"),
    "german": ("der", "die", "das", "und", "ist", "mit", "für", "den", "ein", "auf"),
}
#: (pattern of a user name, class, confidence), first match wins.
ACCOUNT_CLASSES = (
    (r"deals|market|soko|duka", "sales", 0.80), (r"news|voice|watch|diaries|daily|story", "media", 0.75), (r"official|motors|works|desk", "brand", 0.85),
)
#: (least followers, tier, confidence)
TIERS = ((100_000, "macro", 0.85), (10_000, "micro", 0.75), (5_000, "nano", 0.65), (0, "individual", 0.60))
# Evidence source -> weight; sources of the same family share the part before the
# underscore.  The last row is that of sources which come with landed posts.
WEIGHTS = {
    "image_exif_gps": 3.0, "profile_business_address": 2.5, "visual_content_best_guess": 2.0, "visual_content_recognition": 1.5,
    "profile_bio_city": 1.8, "caption_text_city": 1.5, "caption_text_preposition": 1.4, "profile_bio_pattern": 1.3, "hashtag_analysis": 1.2,
    "username_city": 1.1, "username_slang": 1.0, "username_country": 0.95, "username_region": 0.9, "username_code": 0.8, "username_substring": 0.9,
    "profile_bio_flag": 1.0, "profile_bio_country": 0.9, "caption_text_country": 0.8, "profile_link_tld": 0.6, "caption_text_language": 0.5,
    "post_timing_peak": 0.3, "post_timing_active": 0.15,
    "hashtag": 1.2, "caption_city": 1.1, "comment_city": 0.8, "bio": 1.0, "posting_time": 0.3,
}
#: (country, code) that texts, tags, names and flags are looked up in.
COUNTRIES = (
    ("Kenya", "KE"), ("Uganda", "UG"), ("Tanzania", "TZ"), ("Rwanda", "RW"), ("Ethiopia", "ET"), ("Nigeria", "NG"), ("Ghana", "GH"), ("Egypt", "EG"),
    ("South Africa", "ZA"), ("Germany", "DE"), ("France", "FR"), ("United Kingdom", "GB"), ("India", "IN"), ("Japan", "JP"), ("Brazil", "BR"),
)
# Fixed values: (confidence, prepositions before a place).
PLACE_PHRASES = (
    (0.75, ("in", "from", "at", "near", "visiting", "based in", "located in", "live in", "living in")),
    (0.65, ("shipped from", "made in", "built in", "crafted in", "manufactured in")),
    (0.50, ("available in", "coming to", "now in", "launching in")),
)
# Fixed values: (phrase before a place in a self-description, confidence).
BIO_PHRASES = (("📍", 0.85), ("based in", 0.80), ("located in", 0.80), ("from", 0.60), ("living in", 0.75))
#: Tags that name a place in a part of them.
PLACE_TAG_PATTERNS = (r"visit(\w+)", r"explore(\w+)", r"(\w+)life$", r"(\w+)city$", r"(\w+)gram$", r"madein(\w+)", r"(\w+)kenya$", r"kenya(\w+)")
#: (script, region, confidence).
SCRIPT_REGIONS = (
    ("kana", "Japan", 0.3), ("han", "East Asia", 0.3), ("hangul", "Korea", 0.35), ("arabic", "Middle East and North Africa", 0.25), ("thai", "Thailand", 0.35),
    ("devanagari", "India", 0.3), ("cyrillic", "Eastern Europe", 0.25),
)
#: (keyword in a user name, place, confidence, type); a code begins with an underscore and stands at the end.
NAME_KEYWORDS = (
    ("_ke", "Kenya", 0.60, "code"), ("_ug", "Uganda", 0.60, "code"), ("_tz", "Tanzania", 0.60, "code"), ("kenyan", "Kenya", 0.65, "country"), ("mashinani", "Kenya", 0.40, "slang"),
    ("eastafrica", "East Africa", 0.50, "region"), ("simba", "East Africa", 0.30, "slang"), ("coast", "Coast", 0.35, "region"), ("kahawa", "Kenya", 0.30, "slang"), ("twiga", "East Africa", 0.30, "slang"),
)
# What a reaction counts in the ranking of posts, by dialect.
ENGAGEMENT = {
    "x": {"engagement.likes": 1, "engagement.shares": 2, "engagement.comments": 1}, "tiktok": {"engagement.likes": 1, "engagement.shares": 3, "engagement.views": 0.01},
}
