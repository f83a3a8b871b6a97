"""Word lists, patterns, maps and constants on which results depend."""

# ---- Fixed values: hard filters ----

NON_RESIDENTIAL = ("Gewerbeobjekt", "Parkplatz", "Parkplatz, Garage", "Tiefgarage", "Einzelgarage", "Bastelraum", "Wohnnebenraeume", "Gastgewerbe", "Grundstück", "Ferienimmobilie")
EXCHANGE_TITLES = ("tausch", "swap")
SUBLET_TITLES = ("untermiete", "sublet", "sous-loc", "subaffitto")
FEATURES = ("balcony", "elevator", "parking", "garage", "fireplace", "child_friendly", "pets_allowed", "temporary", "new_build", "wheelchair_accessible", "private_laundry", "minergie_certified")
MIN_RESULTS = 5
CANDIDATE_CAP = 200
AREA_SHARE = 0.97

# ---- Fixed values: raw listings ----

RAW_COLUMNS = (
    "id", "platform_url", "platform_id", "title", "status", "time_of_creation", "last_scraped", "object_type_text", "price", "location_address", "partner_name", "remarks",
    "orig_data", "images", "price_type", "area", "object_category", "object_type", "offer_type", "number_of_rooms", "available_from", "object_description", "rent_net",
    "rent_extra", "distance_public_transport", "agency_name", "agency_phone", "agency_email", "floor", "year_built", "prop_balcony", "prop_elevator", "prop_parking", "prop_garage",
    "prop_fireplace", "prop_child_friendly", "geo_lat", "geo_lng", "scrape_source", "distance_shop", "distance_kindergarten", "distance_school_1", "distance_school_2",
    "animal_allowed", "object_street", "object_zip", "object_city", "object_state", "rent_gross", "maybe_temporary", "is_new_building", "supermarket_name",
)
ROOMS_IN_TITLE = r"(\d+(?:[.,]5)?)\s*[-‑]?\s*(?:Zimmer|Zi\.|pi[eè]ces?|locali?|rooms?)"

# ---- Fixed values: listing-type patterns of the filter path ----

EXCHANGE = r"\btausch(?:wohnung)?\b|\bzum\s+tausch\b|\[tauschwohnung\]|\bwohnung(?:en)?\s+tauschen\b|\bswap\s+apartment\b"
WANTED_TITLE = r"(?:^|\b)cherche\s+(?:sous-?location|appartement|logement|reprise|bail|studio|maison)|\bwohnung\s+gesucht\b|\bcerco\s+(?:appartamento|monolocale|stanza|camera)\b"
COLIVING = r"\bco-?living\b"
TEMPORARY_LISTING = r"\bbefristet\b|\btemporäre?\b|\btemporaire\b|\btemporaneo\b|\bfixed.term\b|\bkurzfristig\b|\bbis\s+\d{2}\.\d{2}\.\d{4}\b"
WANTS_TEMPORARY = r"\b\d+\s*(?:monat(?:e|en)?|month[s]?|mois|mes[ei])\b|\bvorübergehend\b|\btemporär\b|\btemporairement\b|\btemporaneamente\b|\bkurzfristig\b|\bauf\s+zeit\b|\bfor\s+a\s+(?:few|couple|short)\b"
WG_ROOM = r"\bwg[-\s]?zimmer\b|\bzimmer\s+in\s+(?:einer\s+)?wg\b|\bcamera\s+in\s+appartamento\s+condiviso\b|\broom\s+in\s+shared\s+(?:flat|apartment)\b|\bchambre\s+en\s+colocation\b"
SHARED_WORDS = ("wg", "coliving", "co-living", "shared flat", "colocation")

# ---- Fixed values: quality patterns of the ranked path ----

SWAP = r"\btauschwohnung\b|\btausch\s*gegen\b|\bzum\s+tausch\b|\bwohnungstausch\b|\bapartment\s+swap\b|\b[ée]change\s+(?:d['a]|contre)\b|\bappartement\s+[ée]change\b|\bscambio\s+(?:di\s+)?appartament"
WANTED = (
    r"\bsuche\s+(?:wohnung|\d[\.,]?\d?\s*[-\s]?zimmer|appartement|studio)\b|\bich\s+suche\b|\bwir\s+suchen\b|\bcherche\s+(?:appartement|studio|\d\s*pièces|sous[\s-]?location)\b"
    r"|\ba\s+la\s+recherche\s+d['a]\s*(?:un\s+)?appartement|\breprise\s+de\s+bail|\bcerco\s+(?:appartament|monolocale|bilocale|\d[\.,]?\d?\s*local)|\bwanted\b\s*(?::|-|apartment)|\blooking\s+for\s+(?:an?\s+)?(?:apartment|flat|studio)"
)
NON_SWISS_TITLE = r"\bFR[- ](?:Ferney|Gaillard|Annemasse|Thonon|St[\s-]?Julien|Annecy)|\bDE[- ](?:Weil|Lörrach|Freiburg|Konstanz|Singen|Waldshut)|\bIT[- ](?:Como|Varese|Chiasso|Milano|Bergamo)|\b(?:France|Germany|Italy)\b|\bFerney[\s-]?Voltaire\b|\bGaillard\b"
SHORT_TERM = (
    r"\bbefristet\b|\btemporäre?\b|\btemporar(?:y|ily)\b|\btemporair(?:e|ement)\b|\btemporan(?:e|ea|eamente)\b|\bzwischenmiete\b|\buntervermietung\b|\bsous[\s-]?location\b|\bsublet\b|\babriss\b|\bdemoli(?:r|tion|zione)"
    r"|\bbis\s+(?:zum\s+)?\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\bbis\s+\w+\s+\d{4}\b|\bjusqu['\s]*(?:au|en)\s+\w+\s*\d{2,4}\b|\bfino\s+al\s+\d"
)
LONG_TERM_QUERY = r"\bfamil(?:y|ie|le|ia)|\bkids?\b|\bchildren\b|\benfants?\b|\bkinder\b|\bbambin|\brelocat(?:e|ing|ion)\b|\bumzug\b|\bziehen\s+nach\b|\bstable\s+(?:housing|home|rental)|\blong[\s-]?term\b|\bpermanent\b|\bdauerhaft\b|\brentner|\bretired?\b|\bretrait[ée]|\bpension(?:ier|é)"
SHORT_TERM_QUERY = r"\btempor[äae]r|\btemporair|\bshort[\s-]?term\b|\bfew\s+months\b|\bfor\s+\d+\s+months?\b|\bpour\s+\d+\s+mois\b|\bbefristet\b|\bzwischenmiete\b|\buntervermietung\b|\bsous[\s-]?location\b|\bsublet\b|\bmöbl?iert\b|\bfurnished\b|\bmeubl[ée]\b|\barredat"

# ---- Fixed values: query understanding ----

#: name that a query may hold: city
CITY_HINTS = {
    "zürich": "Zürich", "zurich": "Zürich", "winterthur": "Winterthur", "basel": "Basel", "bern": "Bern", "genève": "Genève", "geneva": "Genève", "lausanne": "Lausanne",
    "luzern": "Luzern", "lucerne": "Luzern", "st. gallen": "St. Gallen", "st gallen": "St. Gallen", "lugano": "Lugano", "fribourg": "Fribourg",
}
CITY_CANTONS = {"zurich": "ZH", "zürich": "ZH", "bern": "BE", "basel": "BS", "geneva": "GE", "genève": "GE", "lausanne": "VD", "luzern": "LU", "lucerne": "LU", "winterthur": "ZH"}
CITY_ALIASES = {"genf": "Genève", "geneva": "Genève", "zurich": "Zürich", "zuerich": "Zürich", "lucerne": "Luzern", "biel": "Biel/Bienne", "bienne": "Biel/Bienne"}
#: district: parent city and postal codes
DISTRICTS = {
    "seefeld": ("Zürich", ["8008"]), "riesbach": ("Zürich", ["8008"]), "kreis 8": ("Zürich", ["8008"]), "wiedikon": ("Zürich", ["8003"]), "kreis 3": ("Zürich", ["8003", "8036"]), "aussersihl": ("Zürich", ["8004"]), "langstrasse": ("Zürich", ["8004"]), "kreis 4": ("Zürich", ["8004"]),
    "kreis 5": ("Zürich", ["8005"]), "escher wyss": ("Zürich", ["8005"]), "unterstrass": ("Zürich", ["8006"]), "oberstrass": ("Zürich", ["8006"]), "kreis 6": ("Zürich", ["8006"]), "fluntern": ("Zürich", ["8044"]), "hottingen": ("Zürich", ["8032"]), "hirslanden": ("Zürich", ["8032"]),
    "witikon": ("Zürich", ["8053"]), "kreis 7": ("Zürich", ["8032", "8053"]), "enge": ("Zürich", ["8002"]), "wollishofen": ("Zürich", ["8038"]), "leimbach": ("Zürich", ["8041"]), "kreis 2": ("Zürich", ["8002", "8038"]), "albisrieden": ("Zürich", ["8047"]), "altstetten": ("Zürich", ["8048"]),
    "kreis 9": ("Zürich", ["8047", "8048"]), "höngg": ("Zürich", ["8049"]), "höng": ("Zürich", ["8049"]), "wipkingen": ("Zürich", ["8037"]), "kreis 10": ("Zürich", ["8037", "8049"]), "affoltern": ("Zürich", ["8046"]), "oerlikon": ("Zürich", ["8050"]), "seebach": ("Zürich", ["8052"]),
    "kreis 11": ("Zürich", ["8046", "8050", "8052"]), "schwamendingen": ("Zürich", ["8051", "8052"]), "hirzenbach": ("Zürich", ["8051"]), "kreis 12": ("Zürich", ["8051", "8053"]), "kreis 1": ("Zürich", ["8001"]), "city": ("Zürich", ["8001"]), "sihlfeld": ("Zürich", ["8003"]), "friesenberg": ("Zürich", ["8055"]),
    "gundeldingen": ("Basel", ["4053"]), "iselin": ("Basel", ["4053"]), "st. johann": ("Basel", ["4056"]), "st johann": ("Basel", ["4056"]), "bruderholz": ("Basel", ["4059"]), "breite": ("Basel", ["4054"]), "matthäus": ("Basel", ["4058"]), "mattheus": ("Basel", ["4058"]), "kleinbasel": ("Basel", ["4057", "4058"]),
    "champel": ("Genève", ["1206"]), "eaux-vives": ("Genève", ["1207"]), "eaux vives": ("Genève", ["1207"]), "jonction": ("Genève", ["1205"]), "plainpalais": ("Genève", ["1205"]), "pâquis": ("Genève", ["1201"]), "paquis": ("Genève", ["1201"]), "grottes": ("Genève", ["1201"]), "carouge": ("Genève", ["1227"]), "lancy": ("Genève", ["1212"]),
    "flon": ("Lausanne", ["1004"]), "sous-gare": ("Lausanne", ["1004"]), "ouchy": ("Lausanne", ["1006"]), "centre": ("Lausanne", ["1003"]),
}
FEATURE_KEYWORDS = {
    "balcony": ("balcony", "balkon", "balcon"),
    "parking": ("parking", "parkplatz", "parcheggio", "stationnement"),
    "garage": ("garage", "tiefgarage"),
    "elevator": ("elevator", "lift", "aufzug", "ascenseur"),
    "fireplace": ("fireplace", "cheminée", "cheminee", "kamin"),
    "pets_allowed": ("pets allowed", "pet-friendly", "haustiere"),
    "new_build": ("new build", "neubau", "newly built"),
    "minergie_certified": ("minergie",),
    "wheelchair_accessible": ("wheelchair", "barrierefrei"),
    "private_laundry": ("in-unit laundry", "private laundry", "waschmaschine"),
    "child_friendly": ("kinderfreundlich", "family-friendly", "familienfreundlich"),
}
SOFTENERS = ("ideally", "maybe", "if possible", "nice to have", "hätte gern")
SOFT_KEYWORDS = {
    "bright": ("bright", "hell", "lumineux", "lichtdurchflutet", "luminoso"),
    "modern": ("modern", "modernisiert", "moderne"),
    "quiet": ("quiet", "ruhig", "calme", "silenzioso", "tranquil"),
    "family_friendly": ("family", "familie", "famille", "kids", "kinder"),
    "pet_friendly": ("pet", "dog", "cat", "hund", "katze", "animaux"),
    "student_friendly": ("student", "studentin", "wg"),
    "near_public_transport": ("public transport", "transit", "tram", "bus", "bahnhof", "station", "öv", "transports"),
    "near_schools": ("school", "schule", "école", "scuola"),
    "nice_views": ("view", "aussicht", "vue", "vista"),
    "balcony_or_terrace": ("terrace", "terrasse", "balcony", "balkon"),
    "parking": ("parking", "parkplatz"),
    "new_build": ("new build", "neubau"),
    "furnished": ("furnished", "möbliert", "meublé"),
    "spacious": ("spacious", "geräumig", "spacieux"),
}
PRICE_INTENTS = {"cheap": ("cheap", "affordable", "budget", "günstig", "bon marché"), "premium": ("premium", "luxury", "luxurious", "luxus", "high-end")}
NEAR = r"(?:close to|near|nearby|by|beside|next to|in der nähe von|nahe|proche de)\s+([A-Z][\wÀ-ɏ\s\-\.']{2,40})"
PRICE_LIMIT = r"(?:under|below|less than|bis|max(?:imum)?|<=?|up to)\s*(?:chf\s*)?([0-9]{3,5})"
ROOMS_WANTED = r"(\d(?:[.,]\d)?)\s*[- ]?\s*(?:room|rooms|zimmer|zi\.?|pièces|locali)"
MIN_AREA = r"(?:mindestens|at least|minimum|min(?:imo)?|au moins|almeno|ab|von)\s+(\d{2,3})\s*(?:m[²2]|sqm|m2|mq)"
MAX_AREA = r"(?:h[öo]chstens|at most|maximum|max(?:imo)?|au plus|al massimo|bis zu|jusqu['’]à)\s+(\d{2,3})\s*(?:m[²2]|sqm|m2|mq)"
EN_BEDROOMS = r"(\d(?:[.,]\d)?)\s*[- ]?\s*bedroom"
#: feature: its names in four languages
FEATURE_SYNONYMS = {
    "balcony": ("balcony", "balkon", "balcon", "terrasse", "balcone", "terrazza"),
    "elevator": ("elevator", "aufzug", "lift", "ascenseur", "ascensore"),
    "parking": ("parking", "parkplatz", "aussenparkplatz", "parking extérieur", "parcheggio", "posto auto"),
    "garage": ("garage", "tiefgarage", "garage souterrain", "garage sotterraneo", "autorimessa"),
    "fireplace": ("fireplace", "kamin", "cheminée", "camino", "caminetto"),
    "child_friendly": ("child_friendly", "kinderfreundlich", "familienfreundlich", "adapté aux enfants", "adatto ai bambini", "per famiglie"),
    "pets_allowed": ("pets_allowed", "haustiere erlaubt", "tiere erlaubt", "animaux admis", "animali ammessi", "animali consentiti"),
    "new_build": ("new_build", "neubau", "erstbezug", "construction neuve", "nuova costruzione", "prima occupazione"),
    "wheelchair_accessible": ("wheelchair_accessible", "rollstuhlgängig", "barrierefrei", "accès handicapés", "accessibile in sedia a rotelle", "senza barriere"),
    "private_laundry": ("private_laundry", "waschmaschine", "tumbler", "machine à laver privée", "lavatrice privata", "lavatrice"),
    "minergie_certified": ("minergie_certified", "minergie", "certifié minergie", "certificato minergie"),
    "temporary": ("temporary", "temporär", "befristet", "temporaire", "temporaneo", "a termine"),
    "furnished": ("furnished", "möbliert", "meublé", "arredato"),
    "unfurnished": ("unfurnished", "unmöbliert", "non meublé", "non arredato"),
}

# ---- Fixed values: text retrieval ----

STOPWORDS = tuple(
    dict.fromkeys(
        (
            "der die das den dem des ein eine einer eines einem einen und oder aber auch als am im in an auf bei mit für zu von aus über unter vor nach "
            "ist sind war waren wird werden wurde wurden sein haben hat hatte nicht kein keine mehr sehr noch schon nur ganz sowie sowie. "
            "le la les un une des du de au aux et ou mais donc car dans sur sous pour par avec sans chez est sont était étaient sera seront ne pas plus très bien aussi encore déjà "
            "il lo la i gli le un uno una e o ma perché che di da in su per con senza presso è sono era erano sarà saranno non più molto bene anche "
            "the a an and or but if for to from of at in on with without by is are was were be been being this that these those it its"
        ).split()
    )
)
TOKEN = r"[\wÀ-ɏ]+"
LANGUAGE_WORDS = {
    "de": ("der", "die", "das", "und", "mit", "ist", "eine", "nicht", "für", "bei", "im", "am", "zum"),
    "fr": ("les", "des", "pour", "dans", "avec", "est", "qui", "une", "sur", "pas", "par", "du", "au"),
    "it": ("con", "nel", "per", "del", "della", "sono", "una", "gli", "che", "dal", "alle", "dei", "si"),
    "en": ("the", "and", "for", "with", "this", "that", "are", "not", "from", "have", "apartment", "rent"),
}
LANGUAGE_CHARS = {"de": "äöüß", "fr": "éèêëàâùûîôçœ", "it": "àèìîòùú", "en": ""}
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# ---- Fixed values: ranking ----

SIGNALS = {"dense": 0.35, "bm25": 0.20, "vlm": 0.20, "geo_transit": 0.10, "geo_school": 0.05, "geo_anchor": 0.15, "price_band": 0.10, "lang_match": 0.05}
ALWAYS_ON = ("dense", "bm25")
TAU = {"geo_transit": 500.0, "geo_school": 1000.0, "geo_anchor": 800.0}
WEIGHT_KEYS = {"dense": ("dense_text",), "bm25": ("bm25",), "vlm": ("clip_image", "brightness", "modernity"), "geo_transit": ("transit",), "geo_school": (), "geo_anchor": ("geo_anchor",), "price_band": ("price_band",), "lang_match": ("lang_match",)}
VISUAL_WORDS = (
    "bright", "hell", "clair", "luminoso", "luminosa", "modern", "moderne", "moderno", "dark", "dunkel", "sombre", "scuro", "cozy", "gemütlich", "confortable", "spacious", "geräumig", "spacieux", "spazioso", "view", "aussicht", "vue", "vista",
    "kitchen", "küche", "cuisine", "cucina", "bathroom", "bad", "salle de bain", "bagno", "garden", "garten", "jardin", "giardino", "balcony", "balkon", "balcon", "balcone", "terrace", "terrasse", "terrazza", "waschmaschine", "laundry", "lessive",
    "ruhig", "quiet", "calme", "tranquillo", "helle", "heller",
)
ROOM_SHARE_FACTOR = 0.4
FEEDBACK_SHARE = 0.2

# ---- Fixed values: geography ----

EARTH_KM = 6371.0
ANCHORS = {
    "ETH Zurich": (47.3763, 8.5483), "EPFL Lausanne": (46.5191, 6.5668), "University of Zurich": (47.3743, 8.5490), "University of Bern": (46.9499, 7.4380), "University of Basel": (47.5596, 7.5806), "University of Geneva": (46.2044, 6.1432), "ETH Hönggerberg": (47.4065, 8.5072),
    "HSG St. Gallen": (47.4310, 9.3800), "ZHAW Winterthur": (47.4900, 8.7227), "Université de Lausanne": (46.5226, 6.5818), "University of Fribourg": (46.8065, 7.1571), "University of Neuchâtel": (47.0020, 6.9414), "USI Lugano": (46.0037, 8.9511),
}
PLACE_CITIES = {
    "zuerich": "Zürich", "zurich": "Zürich", "geneve": "Genève", "genf": "Genève", "bern": "Bern", "berne": "Bern", "basel": "Basel", "lausanne": "Lausanne", "winterthur": "Winterthur", "lucerne": "Luzern", "luzern": "Luzern", "lugano": "Lugano", "st. gallen": "St. Gallen", "st gallen": "St. Gallen",
    "biel": "Biel/Bienne", "bienne": "Biel/Bienne", "thun": "Thun", "schaffhausen": "Schaffhausen", "fribourg": "Fribourg", "freiburg": "Freiburg im Breisgau", "chur": "Chur", "neuchatel": "Neuchâtel", "neuchâtel": "Neuchâtel", "sion": "Sion", "aarau": "Aarau", "zug": "Zug", "solothurn": "Solothurn",
    "frauenfeld": "Frauenfeld", "liestal": "Liestal", "herisau": "Herisau", "appenzell": "Appenzell", "glarus": "Glarus", "altdorf": "Altdorf", "sarnen": "Sarnen", "stans": "Stans", "schwyz": "Schwyz", "bellinzona": "Bellinzona", "delémont": "Delémont", "porrentruy": "Porrentruy",
}
PLACE_CANTONS = {
    "Aargau": "AG", "Appenzell Ausserrhoden": "AR", "Appenzell Inner-Rhoden": "AI", "Appenzell Innerrhoden": "AI", "Basel-Landschaft": "BL", "Basel-City": "BS", "Basel-Stadt": "BS", "Bern": "BE", "Berne": "BE", "Fribourg": "FR", "Geneva": "GE", "Genève": "GE", "Genf": "GE", "Glarus": "GL",
    "Graubünden": "GR", "Graubuenden": "GR", "Grischun": "GR", "Jura": "JU", "Lucerne": "LU", "Luzern": "LU", "Neuchâtel": "NE", "Neuchatel": "NE", "Nidwalden": "NW", "Obwalden": "OW", "Schaffhausen": "SH", "Schwyz": "SZ", "Solothurn": "SO", "St. Gallen": "SG", "Sankt Gallen": "SG", "Thurgau": "TG",
    "Ticino": "TI", "Uri": "UR", "Valais": "VS", "Wallis": "VS", "Vaud": "VD", "Zug": "ZG", "Zurich": "ZH", "Zürich": "ZH",
}
