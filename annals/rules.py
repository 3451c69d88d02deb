"""Rule tables, in the order in which they are tried. The first rule that fits decides."""

# Cue and verb lists, labels and families must be these for right results.
ANECDOTE_CUES = [
    "anecdote", "according to legend", "legend has it", "the story goes", "popular story", "apocryphal", "once told", "is said to have",
    "it is said that", "reputed to have", "tradition holds", "an apocryphal", "learned about", "learnt about", "learned of", "learnt of",
    "from a newspaper", "newspaper that he read", "newspaper that she read", "read in a café", "read in a cafe",
]
COMMEMORATIVE = [
    (["statue", "monument", "bust of"], "statue", "statue unveiled"),
    (["museum"], "museum", "museum opened"),
    (["street named", "avenue named", "boulevard named", "square named", "renamed", "named after"], "street_naming", "named"),
    (["memorial"], "memorial", "memorial dedicated"),
    (["plaque"], "memorial", "plaque unveiled"),
]
#: (whole words of the verb, event type, label, family)
VERBS = [
    (["born", "birth"], "birth", "born", "bio"),
    (["died", "death", "deceased", "killed"], "death", "died", "bio"),
    (["grieved"], "life_event", "grieved", "bio"),
    (["married", "marriage", "wed"], "marriage", "married", "bio"),
    (["divorced", "divorce", "annulled"], "divorce", "divorced", "bio"),
    (["studied", "graduated", "enrolled", "educated"], "education", "studied", "bio"),
    (["worked", "employed", "served", "appointed"], "employment", "worked", "bio"),
    (["moved", "relocated", "emigrated", "immigrated", "settled", "arrived"], "relocation", "moved", "bio"),
    (["visited", "travelled", "traveled", "toured", "journeyed"], "travel", "visited", "bio"),
    (["lived", "resided", "stayed"], "residence", "lived", "bio"),
    (["exiled", "fled", "abdicated"], "exile", "exiled", "bio"),
    (["imprisoned", "arrested", "jailed"], "imprisonment", "imprisoned", "bio"),
    (["fought", "defeated", "besieged", "invaded", "commanded"], "battle", "fought", "bio"),
    (["associated"], "life_event", "associated", "other"),
    (["signed", "negotiated", "treaty", "alliance", "concordat"], "diplomatic", "signed", "bio"),
    (["met", "received", "audience", "congress"], "meeting", "met", "bio"),
    (["crowned", "elected", "proclaimed", "reigned"], "office", "took office", "bio"),
    (["spoke", "speech", "addressed", "lectured"], "speech", "spoke", "bio"),
    (["published", "wrote", "authored"], "publication", "published", "work"),
    (["painted", "composed", "sculpted", "filmed", "directed"], "creation", "created", "work"),
    (["discovered", "invented", "proved", "demonstrated"], "discovery", "discovered", "work"),
    (["awarded", "received", "won", "nobel"], "award", "awarded", "bio"),
    (["unveiled"], "statue", "statue unveiled", "legacy"),
]
#: (parts of the sentence, event type, label, family)
SENTENCE_CUES = [
    (["was born", "were born"], "birth", "born", "bio"),
    (["died in", " died ", "was killed"], "death", "died", "bio"),
    (["married"], "marriage", "married", "bio"),
    (["studied at", "graduated from", "educated at"], "education", "studied", "bio"),
    (["lived in exile", "went into exile", "was exiled"], "exile", "exiled", "bio"),
    (["was crowned", "became emperor", "became king", "became president"], "office", "took office", "bio"),
    (["battle of", "fought at", "defeated at"], "battle", "fought", "bio"),
    (["published", "principia", "wrote "], "publication", "published", "work"),
    (["discovered", "invented"], "discovery", "discovered", "work"),
    (["moved to", "settled in", "emigrated to", "returned to", "arrived in"], "relocation", "moved", "bio"),
    (["visited", "travelled to", "traveled to"], "travel", "visited", "bio"),
    (["lived in", "resided in"], "residence", "lived", "bio"),
    (["worked at", "worked in", "served as"], "employment", "worked", "bio"),
    (["imprisoned", "arrested in"], "imprisonment", "imprisoned", "bio"),
    (["awarded", "nobel prize", "received the"], "award", "awarded", "bio"),
    (["signed the", "treaty of", "concordat", "alliance with"], "diplomatic", "signed", "bio"),
    (["divorced", "annulled"], "divorce", "divorced", "bio"),
    (["met with", "congress of"], "meeting", "met", "bio"),
]
# A death in the sentence is somebody else's with one of these words and one of these cues.
RELATIVES = ["daughter", "son", "wife", "husband", "father", "mother", "sister", "brother", "child", "infant", "fiancée", "fiancee"]
DEATH_CUES = [" died", "drowned", "was buried", "funeral", "'s death", "death of"]
RUMOR = ["allegedly", "reportedly", "rumor", "rumour", "supposedly", "purportedly", "it is said", "some claim", "unconfirmed"]
THEORY = ["according to legend", "legend has it", "historians debate", "it has been theorized", "one theory", "hypothesized", "possibly", "perhaps", "may have", "might have"]
UNCERTAIN = ["around ", "circa ", "c. ", "approximately", "about the year", "uncertain", "unknown date", "date unknown"]

#: (parts of the text, kind, epistemic status, relation to the subject, confidence in hundredths)
CLAIM_KINDS = [
    (["controversial", "disputed", "scandal", "accused of", "allegation", "denied that"], "controversy", "disputed", "direct", 55),
    (
        [
            "legend has it", "according to legend", "anecdote", "once told", "is said to have", "it is said that", "it is said ", "reportedly", "apocryphal",
            "the story goes", "popular story", "reputed to have", "tradition holds", "folklore", "according to a popular",
        ],
        "anecdote", "attested", "direct", 50,
    ),
    (["historians debate", "critics argue", "supporters claim", "on the other hand", "however, some"], "debate_stance", "contested", "historiography", 50),
    (["theory", "hypothes", "believed that", "argued that", "proposed that", "suggested that"], "theory", "hypothesized", "indirect", 55),
    ([" wrote ", " said ", " according to ", " quoted ", " remarked "], "attribution", "attested", "direct", 60),
]
LIFE_VERBS = [
    "was born", "born in", "died", "married", "crowned", "elected", "appointed", "abdicated", "graduated", "founded", "published", "moved to", "fled", "executed", "assassinated",
]
CONTEXT_CUES = ["during", "while", "at the time", "in this period", "meanwhile"]

#: Fixed values: (parts of a clause, event type, predicate)
PREDICATES = [
    (["was born", "born in", "born at"], "birth", "born_in"),
    (["died", "death of", "passed away"], "death", "died_in"),
    (["married", "wedding"], "marriage", "married"),
    (["divorced"], "divorce", "divorced"),
    (["fought", "battle of", "defeated", "victory at"], "battle", "fought_at"),
    (["exiled", "exile to"], "exile", "exiled_to"),
    (["crowned", "abdicated"], "office", "held_office"),
    (["signed", "treaty"], "diplomatic", "signed"),
    (["met with", "meeting"], "meeting", "met"),
]

#: Fixed values: (event types, least age, greatest age); other types: 0 to 120
AGES = [
    (["death"], 0, 120),
    (["marriage", "divorce"], 12, 100),
    (["battle", "office", "diplomatic", "employment", "exile", "imprisonment"], 10, 100),
    (["education"], 3, 90),
]

#: Fixed values: (names, latitude, longitude), in the order that decides between names of equal length.
#: Names with accents are also known without them (functions.place.gazetteer adds those).
GAZETTEER = [
    ("london", 51.5074, -0.1278), ("paris", 48.8566, 2.3522), ("berlin", 52.52, 13.405), ("cambridge", 52.2053, 0.1218), ("oxford", 51.752, -1.2577),
    ("new york", 40.7128, -74.006), ("washington", 38.9072, -77.0369), ("boston", 42.3601, -71.0589), ("vienna", 48.2082, 16.3738), ("rome", 41.9028, 12.4964),
    ("madrid", 40.4168, -3.7038), ("moscow", 55.7558, 37.6173), ("beijing", 39.9042, 116.4074), ("tokyo", 35.6762, 139.6503), ("sydney", -33.8688, 151.2093),
    ("bletchley park", 51.9973, -0.7406), ("ajaccio", 41.9267, 8.7369), ("brienne|brienne-le-chateau", 48.3933, 4.5228), ("toulon", 43.1242, 5.928),
    ("austerlitz", 49.1533, 16.875), ("waterloo", 50.6794, 4.4047), ("elba", 42.777, 10.192), ("saint helena|st helena", -15.965, -5.712), ("milan", 45.4642, 9.19),
    ("cairo", 30.0444, 31.2357), ("marengo", 44.888, 8.679), ("jena", 50.9272, 11.586), ("wagram", 48.25, 16.5667), ("leipzig", 51.3397, 12.3731),
    ("corsica", 42.0396, 9.0129), ("fontainebleau", 48.4047, 2.7016), ("malmaison", 48.8706, 2.1681), ("notre-dame|notre dame", 48.853, 2.3499),
    ("borodino", 55.526, 35.821), ("smolensk", 54.7826, 32.0853), ("friedland", 54.443, 21.011), ("tilsit", 55.0833, 21.8833), ("amiens", 49.8943, 2.2957),
    ("lille", 50.6292, 3.0573), ("honfleur", 49.4197, 0.2328), ("colombey|colombey-les-deux-églises", 48.217, 4.883), ("strasbourg", 48.5734, 7.7521),
    ("ulm", 48.4011, 9.9876), ("auerstedt", 51.1, 11.583), ("jena–auerstedt", 50.9272, 11.586), ("the pyramids|pyramids", 29.9792, 31.1342),
    ("eylau|preussisch eylau", 54.4, 20.633), ("aspern", 48.216, 16.466), ("essling", 48.21, 16.48), ("warsaw", 52.2297, 21.0122), ("dresden", 51.0504, 13.7373),
    ("prague", 50.0755, 14.4378), ("munich", 48.1351, 11.582), ("erfurt", 50.9848, 11.0299), ("berezina", 54.48, 28.5), ("vilna|vilnius", 54.6872, 25.2797),
    ("liggy|ligny", 50.512, 4.266), ("wavre", 50.717, 4.611), ("brussels", 50.8503, 4.3517), ("lisbon", 38.7223, -9.1393), ("alexandria", 31.2001, 29.9187),
    ("acre", 32.9281, 35.082), ("jaffa", 32.0504, 34.7522), ("genoa", 44.4056, 8.9463), ("turin", 45.0703, 7.6869), ("venice", 45.4408, 12.3155),
    ("florence", 43.7696, 11.2558), ("naples", 40.8518, 14.2681), ("arcola", 45.35, 11.283), ("lodi", 45.314, 9.503), ("rivoli", 45.566, 10.833),
    ("mantua", 45.1564, 10.7914), ("portoferraio", 42.812, 10.316), ("longwood", -15.95, -5.72), ("tuileries", 48.8636, 2.3272),
    ("saint-cloud|saint cloud", 48.844, 2.219), ("boulogne|boulogne-sur-mer", 50.7264, 1.6147), ("lyon", 45.764, 4.8357), ("grenoble", 45.1885, 5.7245),
    ("nice", 43.7102, 7.262), ("antibes", 43.5804, 7.1251), ("auxonne", 47.193, 5.388), ("valence", 44.9334, 4.892), ("avignon", 43.9493, 4.8055),
    ("campo formio", 45.95, 13.3), ("lunéville", 48.592, 6.489), ("pressburg", 48.1486, 17.1077), ("schönbrunn", 48.1845, 16.3122),
    ("ratisbon|regensburg", 49.0134, 12.1016), ("lützen", 51.258, 12.141), ("bautzen", 51.1814, 14.427), ("hanau", 50.1333, 8.9167), ("kulm", 50.7, 13.85),
    ("quatre bras", 50.571, 4.453), ("plancenoit", 50.666, 4.417), ("charleroi", 50.4108, 4.4446), ("arcis-sur-aube", 48.536, 4.14), ("craonne", 49.44, 3.72),
    ("montereau", 48.387, 2.957), ("montmirail", 48.875, 3.54), ("champaubert", 48.88, 3.775), ("vauchamps", 48.88, 3.62), ("maloyaroslavets", 55.014, 36.478),
    ("vyazma", 55.21, 34.285), ("krasnoi", 54.556, 31.43), ("minsk", 53.9, 27.5667), ("compiègne", 49.4179, 2.8261), ("18 brumaire", 48.8566, 2.3522),
    ("besançon", 47.2378, 6.0241), ("hauteville house", 49.457, -2.536), ("saint peter port", 49.4557, -2.535), ("guernsey", 49.4657, -2.5853),
    ("jersey", 49.2138, -2.1358), ("vianden", 49.935, 6.208), ("clos lucé", 47.4103, 0.9922), ("amboise", 47.4131, 0.9827), ("vinci", 43.7869, 10.9237),
    ("cesena", 44.1391, 12.2431), ("palos de la frontera|palos", 37.2278, -6.8933), ("san salvador island|san salvador", 24.077, -74.478),
    ("hispaniola", 19.0, -70.6667), ("santo domingo", 18.4861, -69.9312), ("cuba", 23.1136, -82.3666), ("jamaica", 18.1096, -77.2975), ("valladolid", 41.6523, -4.7245),
    ("barcelona", 41.3851, 2.1734), ("canary islands", 28.2916, -16.6291), ("madeira", 32.7607, -16.9595), ("stockholm", 59.3293, 18.0686), ("sceaux", 48.778, 2.295),
    ("passy", 48.8575, 2.2764), ("sorbonne", 48.849, 2.343), ("maida vale", 51.5274, -0.1899), ("sherborne", 50.949, -2.518), ("princeton", 40.3573, -74.6672),
    ("manchester", 53.4808, -2.2426), ("wilmslow", 53.328, -2.232), ("hampton", 51.415, -0.367), ("bletchley", 51.9973, -0.7406), ("tarsus", 36.9165, 34.8951),
    ("actium", 38.933, 20.733), ("pelusium", 31.042, 32.548), ("antioch", 36.202, 36.16), ("thebes", 25.7206, 32.6105), ("philae", 24.025, 32.884),
    ("cyrene", 32.825, 21.858), ("kraków|cracow", 50.0647, 19.945), ("zakopane", 49.2992, 19.9496), ("oslo", 59.9139, 10.7522), ("cádiz", 36.5271, -6.2886),
    ("seville|sevilla", 37.3891, -5.9845), ("la gomera|gomera", 28.0916, -17.1133), ("la navidad", 19.75, -72.0), ("azores", 37.7412, -25.6756),
    ("anchiano", 43.802, 10.936), ("panthéon", 48.8462, 2.3464), ("institut curie", 48.844, 2.345), ("espci", 48.8413, 2.3478), ("collège de france", 48.8493, 2.3456),
    ("place des vosges", 48.8556, 2.3655), ("école normale", 48.8417, 2.3445), ("invalides", 48.8583, 2.3126), ("vatican", 41.9029, 12.4534), ("pisa", 43.7228, 10.4017),
    ("bologna", 44.4949, 11.3426), ("urbino", 43.7262, 12.6366), ("padua", 45.4064, 11.8768), ("siena", 43.3188, 11.3308), ("ferrara", 44.8378, 11.6196),
    ("granada", 37.1773, -3.5986), ("córdoba", 37.8882, -4.7794), ("toledo", 39.8628, -4.0273), ("bordeaux", 44.8378, -0.5792), ("nantes", 47.2184, -1.5536),
    ("dijon", 47.322, 5.0415), ("laon", 49.564, 3.62), ("reims", 49.2583, 4.0317), ("trafalgar", 36.043, -6.287), ("aboukir", 31.316, 30.061),
    ("gibraltar", 36.1408, -5.3536), ("hut 8", 51.9973, -0.7406), ("teddington", 51.427, -0.332), ("trinidad", 10.6918, -61.2225), ("puerto rico", 18.2208, -66.5901),
    ("venezuela", 10.4806, -66.9036), ("panama", 8.9824, -79.5199), ("cyprus", 35.1856, 33.3823), ("rhodes", 36.4349, 28.2176), ("athens", 37.9838, 23.7275),
    ("memphis", 29.8496, 31.2535), ("tours", 47.3941, 0.6848), ("saché", 47.247, 0.545), ("vendôme", 47.793, 1.066), ("château de saché", 47.247, 0.545),
    ("geneva", 46.2044, 6.1432), ("berdychiv|berdichev", 49.907, 28.591), ("villequier", 49.5126, 0.6714), ("sardinia|sardegna", 40.12, 9.01),
]
#: Countries and realms; localities in a text come before them.
REALMS = [
    ("russia", 55.7558, 37.6173), ("egypt", 30.0444, 31.2357), ("belgium", 50.8503, 4.3517), ("spain", 40.4168, -3.7038), ("portugal", 38.7223, -9.1393), ("italy", 41.9028, 12.4964), ("austria", 48.2082, 16.3738), ("prussia", 52.52, 13.405), ("germany", 52.52, 13.405), ("france", 48.8566, 2.3522), ("england", 51.5074, -0.1278), ("britain", 51.5074, -0.1278), ("malta", 35.8989, 14.5146),
]

# Words and parts of descriptions.
PERSON_WORDS = [
    "human", "person", "politician", "military", "emperor", "empress", "king", "queen", "monarch", "writer", "composer", "scientist", "philosopher",
    "explorer", "physician", "physicist", "chemist", "mathematician", "president", "journalist", "poet", "novelist", "historian", "general", "admiral",
    "officer", "artist", "painter", "architect", "actor", "actress", "singer", "duke", "prince", "princess", "cardinal", "pope", "saint", "pharaoh",
]
PERSON_PARTS = ["prime minister", "computer scientist"]
THING_PARTS = [
    "sculpture", "statue", "painting", "artwork", "bust", "wikimedia category", "fictional character", "asteroid", "taxon", "species of",
    "chemical compound", "video game", "album", "film", "ship named",
]
PLACE_PARTS = ["located in", "depicts", "work by", "statue of", "œuvre de"]
# A period after these ends no sentence.
ABBREVIATIONS = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "Jr.", "Sr.", "vs.", "etc.", "e.g.", "i.e.", "U.S.", "U.K.", "b.", "d.", "c.", "fl.", "ca.", "approx."]

# Fixed values of the sentence miner: subjects in the order in which they are tried, cues and their verbs.
#: (title, aliases, parts of page titles, first year, last year)
SUBJECTS = [
    (
        "Napoleon",
        ["napoleon bonaparte", "napoléon bonaparte", "napoleon i", "emperor napoleon", "general bonaparte", "bonaparte", "napoleon", "napoléon"],
        [
            "napoleon", "napoléon", "french consulate", "first french empire", "hundred days", "peninsular war", "continental system", "napoleonic", "brumaire", "waterloo", "austerlitz",
            "borodino", "jena", "wagram", "tilsit", "amiens", "marengo", "eylau", "friedland", "leipzig", "malmaison", "campo formio", "concordat", "toulon", "pyramids", "ligny",
        ],
        1765, 1865,
    ),
    (
        "Marie Curie",
        ["marie skłodowska-curie", "marie sklodowska-curie", "marie skłodowska", "marie curie", "madame curie"],
        ["curie", "radium", "polonium", "institut curie", "espci", "skłodowska", "sklodowska"],
        1865, 1935,
    ),
    (
        "Victor Hugo",
        ["victor hugo", "hugo"],
        ["victor hugo", "les misérables", "les miserables", "notre-dame de paris", "hauteville", "hernani", "ruy blas", "toilers of the sea", "the man who laughs"],
        1800, 1885,
    ),
    (
        "Leonardo da Vinci",
        ["leonardo da vinci", "leonardo"],
        ["leonardo", "mona lisa", "last supper", "vitruvian", "codex atlanticus", "clos lucé", "clos luce"],
        1450, 1520,
    ),
    (
        "Christopher Columbus",
        ["christopher columbus", "columbus", "cristoforo colombo"],
        ["columbus", "voyages of christopher", "palos de la frontera", "santa maría", "santa maria (ship)", "la niña", "la pinta", "hispaniola"],
        1440, 1510,
    ),
    ("Alan Turing", ["alan turing", "turing"], ["turing", "bletchley", "enigma", "hut 8", "manchester mark", "automatic computing engine"], 1910, 1960),
    ("Cleopatra", ["cleopatra vii", "cleopatra"], ["cleopatra", "ptolemaic", "actium", "caesarion", "donations of alexandria"], -80, 30),
    (
        "Honoré de Balzac",
        ["honoré de balzac", "honore de balzac", "honoré balzac", "honore balzac", "de balzac", "balzac"],
        [
            "balzac", "comédie humaine", "comedie humaine", "père goriot", "pere goriot", "eugénie grandet", "eugenie grandet", "illusions perdues", "lost illusions",
            "cousine bette", "cousin bette", "château de saché", "chateau de sache",
        ],
        1795, 1860,
    ),
]
MINED_ANECDOTES = [
    "anecdote", "according to legend", "legend has it", "the story goes", "popular story", "apocryphal", "once told", "is said to have", "it is said that", "it is said ", "reputed to have",
    "tradition holds", "according to a popular", "famous anecdote", "an apocryphal", "folklore", "learned about", "learnt about", "learned of", "learnt of", "from a newspaper",
    "newspaper that he read", "newspaper that she read", "read in a café", "read in a cafe",
]
MINED_MEMORY = ["statue", "museum", "memorial", "plaque", "was unveiled", "street named", "named after"]
MINED_VERBS = [
    ("was born", "born"), ("born in", "born"), (" died", "died"), ("death of", "died"), ("married", "married"), ("studied", "studied"), ("educated", "studied"), ("to study", "studied"),
    ("study in", "studied"), ("study at", "studied"), ("enrolled", "studied"), ("matriculat", "studied"), ("fought", "fought"), ("battle of", "fought"), ("defeated", "fought"),
    ("captured", "fought"), ("campaign", "fought"), ("retreat", "fought"), ("signed", "signed"), ("treaty of", "signed"), ("crowned", "crowned"), ("exiled", "exiled"), ("fled", "exiled"),
    ("lived in", "lived"), ("resided", "lived"), ("settled in", "lived"), ("moved to", "moved"), ("returned to", "moved"), ("arrived in", "moved"), ("arrived at", "moved"), ("left for", "moved"),
    ("departed", "moved"), ("visited", "visited"), ("travelled", "visited"), ("traveled", "visited"), (" met ", "met"), ("published", "published"), ("wrote ", "published"), ("painted", "painted"),
    ("painting", "painted"), ("discovered", "discovered"), ("isolated", "discovered"), ("research at", "discovered"), ("awarded", "awarded"), ("nobel", "awarded"), ("received the", "awarded"),
    ("sailed", "sailed"), ("set sail", "sailed"), ("embarked", "sailed"), ("landed", "sailed"), ("voyage", "sailed"), ("expedition", "sailed"), ("founded", "founded"), ("worked at", "worked"),
    ("worked in", "worked"), ("worked as", "worked"), ("laboratory", "worked"), ("taught", "taught"), ("teaching at", "taught"), ("joined", "joined"), ("appointed", "appointed"),
    ("elected", "appointed"), ("commissioned", "appointed"), ("imprisoned", "imprisoned"), ("invented", "invented"), ("designed", "invented"), ("decoded", "worked"), ("buried", "died"),
]
PRONOUNS = ["she", "he", "they", "herself", "himself"]
PLACE_TITLES = ["Battle of ", "Treaty of ", "Treaties of ", "Congress of ", "Siege of ", "Coup of "]

#: Fixed values: (class, event types to expect, parts of titles that speak for a page, parts that speak against it).
PROFILES = [
    (
        "scientist", ["discovery", "publication", "award", "education", "office"],
        ["university", "université", "laboratory", "laboratoire", "nobel", "prix", "publication", "discovery", "découverte", "academy", "académie", "institute"],
        ["battle of", "bataille de", "guerre_", "campagne_", "siege of", "ordre de bataille", "coalition"],
    ),
    ("inventor_engineer", ["invention", "patent", "publication", "office"], ["invention", "patent", "brevet", "laboratory", "prototype"], ["battle of", "bataille de", "guerre_"]),
    (
        "artist_writer", ["publication", "exile", "office", "residence"],
        ["œuvre", "oeuvres", "bibliography", "bibliographie", "poem", "publication", "correspondence", "correspondance"],
        ["battle of", "bataille de", "coalition", "campagne_", "guerres_"],
    ),
    (
        "artist_visual", ["publication", "residence", "office"],
        ["œuvre", "oeuvres", "exhibition", "exposition", "museum", "musée", "atelier", "commission", "collection"],
        ["battle of", "bataille de", "guerres_", "campagne_"],
    ),
    ("musician_composer", ["publication", "office"], ["œuvre", "oeuvres", "opera", "opéra", "symphony", "concert", "conservatoire"], ["battle of", "bataille de", "guerres_"]),
    ("philosopher", ["publication", "education"], ["œuvre", "oeuvres", "concept", "school", "école", "doctrine"], ["battle of", "bataille de", "guerre_"]),
    (
        "explorer", ["arrival", "departure", "voyage", "historical_fact"],
        ["voyage", "expedition", "expédition", "navigation", "route", "discovery", "découverte"],
        ["première guerre mondiale", "seconde guerre mondiale", "world war"],
    ),
    (
        "ruler", ["office", "diplomatic", "treaty", "residence"],
        ["règne", "regne", "treaty", "traité", "traite", "reform", "réforme", "cour", "presidency", "président", "president", "office"],
        ["comics", "fictional"],
    ),
    (
        "military_leader", ["battle", "siege", "treaty", "exile", "office"],
        [
            "battle of", "bataille", "siege", "siège", "campaign", "campagne", "treaty", "traité", "guerre", "président", "president", "présidence", "presidence", "gouvernement",
            "résistance", "resistance", "ministre", "discours", "rpf", "élysée", "elysee",
        ],
        ["comics", "fictional"],
    ),
    ("religious_leader", ["office", "residence"], ["doctrine", "canonisation", "pèlerinage", "pelerinage", "sermon"], ["battle of", "bataille de", "comics"]),
    ("athlete", ["office"], ["career", "carrière", "championnat", "record", "club"], ["liste des", "calendrier_"]),
    ("reformer", ["office", "diplomatic", "publication"], ["révolution", "revolution", "réforme", "reforme", "manifeste", "parti"], ["comics"]),
    ("unknown", ["birth", "death", "residence"], ["early life", "biography", "timeline"], ["comics", "fictional character"]),
]
#: Titles about battles, and about the wars after 1900.
BATTLE_TITLES = ["battle of", "bataille de", "siege of", "siège de", "siege de"]
LATE_WARS = ["world war", "guerre mondiale", "1914", "1939"]

#: Places that a clause is searched for when no cue names one; the longest decides, of equal ones the first.
CLAUSE_PLACES = [
    "paris", "london", "ajaccio", "waterloo", "leipzig", "austerlitz", "elba", "saint helena", "st helena", "corsica", "moscow", "vienna", "rome", "milan", "toulon", "fontainebleau", "malmaison",
    "brienne", "egypt", "cairo", "jena", "wagram", "borodino", "smolensk", "tilsit", "notre-dame", "notre dame", "amiens",
]

# Titles of sections that may hold debates; those to skip, unless they have a part of the third list.
DEBATE_SECTIONS = [
    "historiograph", "legacy", "reputation", "controvers", "death", "mort", "myth", "legend", "légende", "legende", "poison", "postérité", "posterite", "reception", "réception", "memory", "mémoire", "memoire",
    "assessment", "débat", "debat", "cause of death", "cause de la mort", "origin", "origine", "identity", "identité", "identite", "birthplace", "correspondance", "correspondence",
]
SKIPPED_SECTIONS = ["early life", "enfance", "campaign", "campagne", "see also", "references", "notes", "external links", "bibliography", "bibliographie"]
KEPT_SECTIONS = ["death", "mort", "origin", "identit"]

# What is said of origins, and where it is contested.
ORIGINS = [
    "origines", "origine véritable", "véritables origines", "veritables origines", "true origin", "true origins", "origin theor", "origin of", "origins of", "birthplace", "lieu de naissance", "nationalité",
    "nationalite", "nationality", "was he genoese", "était-il génois", "etait-il genois",
]
PEOPLES = ["génois", "genois", "genovese", "genoese", "catalan", "portugais", "portuguese", "convers", "juif", "jewish", "suisse", "swiss", "espagnol", "spanish", "français", "francais", "french"]
PEOPLE_THEORY = ["origin", "origine", "théorie", "theorie", "theory", "national"]
CONTESTED = ["disput", "theor", "théorie", "unknown", "on ne sait", "plusieurs", "several", "uncertain", "question", "débat", "debat", "controvers"]

# Fixed values, the first rule that fits decides: lists that must each have a part in the sentence, debate, layer of evidence, kind of claim, status.
DEBATES = [
    (
        [["no contemporary source", "archives destroyed", "lack of evidence", "insufficient evidence", "documentation is scarce", "sources are silent", "aucune source contemporaine", "lacune", "manque de preuves", "mal document"]],
        "archival_gap", "evidence_gap", "controversy", "uncertain",
    ),
    (
        [
            ["correspondance", "correspondence", "his letters", "ses lettres", "langue de ses lettres", "language of his letters"],
            ["langue", "language", "plusieurs langues", "several languages", "castilian", "castillan", "latin", "voyage", "traveled", "travelled", "beaucoup voyagé", "beaucoup voyage"],
        ],
        "identity_origin_dispute", "evidence_gap", "controversy", "uncertain",
    ),
    ([ORIGINS, CONTESTED], "identity_origin_dispute", "theory_or_legend", "theory", "hypothesized"),
    ([PEOPLES, PEOPLE_THEORY, CONTESTED], "identity_origin_dispute", "theory_or_legend", "theory", "hypothesized"),
    (
        [
            ["poison", "arsenic", "cause of death", "cause de la mort", "stomach cancer", "cancer de l'estomac", "assassinat"],
            ["theor", "hypothes", "disput", "controvers", "alleged", " allegedly", "debate", "débat", "selon certains"],
        ],
        "cause_of_death_dispute", "theory_or_legend", "theory", "hypothesized",
    ),
    ([["legend has it", "according to legend", "apocryphal", "myth", "légende", "legende", "is said to have"]], "legend_or_myth", "theory_or_legend", "theory", "hypothesized"),
    ([["conspiracy", "complot", "secret plot", "cover-up", "cover up"]], "conspiracy_or_speculative", "theory_or_legend", "theory", "hypothesized"),
    (
        [["historians debate", "historians disagree", "no consensus", "remain disputed", "remains controversial", "les historiens débattent", "les historiens discutent", "controverse historiographique", "revisionist", "orthodox view"]],
        "interpretation_dispute", "interpretation", "debate_stance", "contested",
    ),
    (
        [["legitimacy", "légitimité", "usurp", "coup d'état", "coup d'etat", "rightful"], ["disput", "controvers", "debate", "débat", "question"]],
        "legitimacy_dispute", "interpretation", "debate_stance", "contested",
    ),
    ([["motive", "intention", "why he", "pourquoi il"], ["disput", "unclear", "debate", "débat", "hypothes"]], "motive_dispute", "interpretation", "debate_stance", "contested"),
    (
        [["date is disputed", "year is disputed", "chronology", "dating remains", "date controvers", "birth-date", "birth date", "date de naissance", "real birth"]],
        "chronology_dispute", "competing_reading", "controversy", "disputed",
    ),
    ([["some say", "others argue", "on the other hand", "however, some", "alternative account", "selon d'autres", "d'autres historiens"]], "factual_dispute", "competing_reading", "controversy", "disputed"),
    ([["controversial", "disputed", "contested", "controverse", "débattu", "debattu"]], "factual_dispute", "competing_reading", "controversy", "disputed"),
]

# The kind of event that a debated sentence is about, tried in order.
DEBATED_EVENTS = [
    ([ORIGINS, CONTESTED], "birth"), ([PEOPLES, PEOPLE_THEORY, CONTESTED], "birth"), ([["origines", "nationalité", "nationalite", "birthplace"]], "birth"),
    ([["died", "death", "mort", "poison", "arsenic", "saint helena", "sainte-hélène", "sainte-helene"]], "death"), ([["born", "birth", "naissance"]], "birth"),
    ([["battle", "bataille", "waterloo", "austerlitz"]], "battle"), ([["exile", "exil", "elba", "elbe"]], "exile"), ([["crowned", "emperor", "empereur", "consul"]], "office"),
]

# The same for titles of works; the last value is the kind of event.
DEBATED_TITLES = [
    (
        [["birth-date", "birth date", "date de naissance", "birthplace", "lieu de naissance", "real birth", "vraie date", "vrai lieu", "dating remains", "chronology of", "chronologie de"]],
        "chronology_dispute", "competing_reading", "controversy", "disputed", "birth",
    ),
    (
        [[
            "nationality", "nationalité", "nationalite", "origines de", "origins of", "origin of", "origin theor", "identité de", "identity of", "was he genoese", "génois", "genoese", "catalan",
            "portugais", "portuguese",
        ]],
        "identity_origin_dispute", "theory_or_legend", "theory", "hypothesized", "birth",
    ),
    (
        [[
            "hero or villain", "héros ou", "heros ou", "revisionist", "révisionniste", "revisionniste", "relecture", "historiograph", "controverse", "controversy", "débat", "debat", "myth", "légende",
            "legende", "memory of", "mémoire de", "memoire de", "reception of", "postérité", "posterite", "modern controvers",
        ]],
        "interpretation_dispute", "interpretation", "debate_stance", "contested", None,
    ),
]

# Sources of a person's plan, priority, documents at most, who gets it (all, scholars, french or scholars, military), reason.
PLANNED_SOURCES = [
    ("wikidata", 10, 20, "all", "identity + structured statements for {class}"),
    ("wikipedia", 20, 40, "all", "biography pages ranked for {class} ({facets})"),
    ("wikipedia", 25, 40, "military", "military subject: expand battle/campaign/treaty linked pages"),
    ("wikisource", 40, 15, "all", "transcriptions / correspondence ({class})"),
    ("wikimedia_commons", 50, 10, "all", "media captions/geotags ({class})"),
    ("open_alex", 55, 25, "scholars", "scholarly works query for {class}"),
    ("bnf", 60, 15, "all", "BnF catalogue ({class})"),
    ("open_alex", 62, 25, "all", "scholarly works query for {class}"),
    ("theses_fr", 65, 25, "french", "French theses about {class}"),
    ("hal", 68, 15, "french", "French open archive scholarly works"),
    ("gallica", 70, 15, "french", "digitized books, press, correspondence"),
    ("europeana", 72, 15, "all", "Europeana heritage ({class})"),
    ("open_library", 80, 10, "all", "bibliographic editions ({class})"),
    ("internet_archive", 85, 10, "all", "Internet Archive texts ({class})"),
    ("persee", 90, 10, "french", "historiographic articles"),
]
SCHOLARS = ["scientist", "inventor_engineer", "philosopher", "artist_writer", "artist_visual", "musician_composer"]

# Parts of titles of sections that go with an event; other types take the last list.
EVENT_SECTIONS = [
    ("birth", ["naissance", "birth", "early", "enfance", "jeunesse"]), ("death", ["mort", "death", "décès", "deces"]), (None, ["career", "carrière", "carriere", "reign", "military", "life"]),
]

# Words of a sentence that go with an event, beside its place and year; other types take the last list.
EVENT_WORDS = [
    ("birth", ["naît", "nait", "born", "birth", "bapt", "ondoy", "mère", "mother", "father", "père", "famille", "family", "ajaccio", "buonaparte"]),
    ("death", ["mort", "died", "death", "décès", "expire", "sainte-hélène", "st helena"]),
    ("battle", ["bataille", "battle", "fought", "combat", "victoire", "defeat"]),
    ("education", ["étudi", "school", "école", "studied", "formation", "brienne"]),
    (None, ["en ", "à ", "in ", "at "]),
]

# Language, type (None: others), the sentence that frames an event.
FRAMES = [
    ("fr", "birth", "{person} — naissance : les sources situent l’événement à {place} en {year}."),
    ("fr", "death", "{person} — mort : les sources situent l’événement à {place} en {year}."),
    ("fr", "battle", "{person} — bataille : les sources décrivent l’affrontement à {place} en {year}."),
    ("fr", None, "{person} — les sources situent cet épisode à {place} en {year}."),
    ("en", "birth", "{person} — birth: sources place the event in {place} in {year}."),
    ("en", "death", "{person} — death: sources place the event in {place} in {year}."),
    ("en", None, "{person} — sources situate this episode in {place} in {year}."),
]
BIOGRAPHIC_SECTIONS = ["naissance", "mort", "enfance", "jeunesse", "early", "birth", "death"]
LEFTOVER_HEADINGS = ["Naissance", "Birth", "Early life", "Mort", "Death"]
FRAMED_WORDS = ["naît", "nait", "born", "mort", "died"]

# Fixed values of the phrase extractor.
#: (person, aliases in the text, first year, last year)
PHRASE_PERSONS = [
    ("Napoleon", ["napoleon bonaparte", "napoléon bonaparte", "napoleon i", "emperor napoleon", "general bonaparte", "bonaparte", "napoleon", "napoléon"], 1765, 1865),
    ("Marie Curie", ["marie skłodowska-curie", "marie sklodowska-curie", "marie curie", "madame curie"], 1865, 1935),
    ("Victor Hugo", ["victor hugo"], 1800, 1885),
    ("Leonardo da Vinci", ["leonardo da vinci"], 1450, 1520),
    ("Christopher Columbus", ["christopher columbus"], 1440, 1510),
    ("Alan Turing", ["alan turing"], 1910, 1960),
    ("Cleopatra", ["cleopatra vii", "cleopatra"], -80, 30),
    ("Honoré de Balzac", ["honoré de balzac", "honore de balzac", "de balzac", "balzac"], 1795, 1860),
]
#: (person, parts of page titles), in the order in which they are tried
PHRASE_PAGES = [
    ("Napoleon", ["napoleon", "napoléon"]),
    ("Marie Curie", ["marie curie", "curie"]),
    ("Victor Hugo", ["victor hugo"]),
    ("Leonardo da Vinci", ["leonardo"]),
    ("Christopher Columbus", ["columbus"]),
    ("Alan Turing", ["turing", "bletchley"]),
    ("Cleopatra", ["cleopatra"]),
    ("Honoré de Balzac", [
        "balzac", "comédie humaine", "comedie humaine", "père goriot", "pere goriot", "eugénie grandet", "lost illusions", "illusions perdues", "cousin bette",
    ]),
    ("Napoleon", [
        "french consulate", "first french empire", "hundred days", "peninsular war", "continental system", "napoleonic", "waterloo", "austerlitz", "tilsit", "borodino", "jena", "wagram",
        "marengo", "eylau", "friedland", "leipzig", "toulon", "ligny",
    ]),
    ("Victor Hugo", ["les misérables", "les miserables", "notre-dame de paris", "hauteville", "hernani", "ruy blas", "toilers of the sea", "the man who laughs"]),
    ("Leonardo da Vinci", ["mona lisa", "last supper", "vitruvian", "codex atlanticus", "clos lucé", "clos luce"]),
    ("Christopher Columbus", ["voyages of christopher", "palos de la frontera", "hispaniola"]),
    ("Alan Turing", ["hut 8", "enigma", "manchester mark", "automatic computing engine"]),
    ("Cleopatra", ["ptolemaic", "actium", "caesarion", "donations of alexandria"]),
    ("Marie Curie", ["radium", "polonium", "institut curie", "espci"]),
]
#: (cue, verb, layout of what follows it), in the order in which they are tried
PHRASE_LAYOUTS = [
    (" was born in ", "born", "year in place"), (" died in ", "died", "year in place"), (" studied at ", "studied", "place in year"), (" fought at ", "fought", "place in year"),
    (" was crowned in ", "crowned", "year in place"), (" married ", "married", "object in year in place"), (" divorced ", "divorced", "object in year in place"),
    (" was exiled to ", "exiled", "place in year"), (" was exiled in ", "exiled", "year in place"), (" lived in ", "lived", "place in year"), (" resided in ", "lived", "place in year"),
    (" moved to ", "moved", "place in year"), (" returned to ", "moved", "place in year"), (" arrived in ", "moved", "place in year"), (" visited ", "visited", "place in year"),
    (" signed ", "signed", "object in year in place"), (" negotiated ", "signed", "object in year in place"), (" met ", "met", "object in year in place"), (" invaded ", "fought", "place in year"),
    (" was unveiled in ", "unveiled", "year in place"), (" enrolled at ", "studied", "place in year"), (" studied in ", "studied", "place in year"), (" sailed from ", "sailed", "place in year"),
    (" landed at ", "sailed", "place in year"), (" founded ", "founded", "place in year"),
]
#: (verb, its cues), in the order in which they are tried
PHRASE_VERBS = [
    ("born", ["was born", "born in", "birth of"]),
    ("died", ["died", "death of", "passed away"]),
    ("married", ["married", "wedding", "marriage to", "marriage with"]),
    ("divorced", ["divorced", "divorce", "annulled", "anulled"]),
    ("studied", ["studied", "educated", "enrolled", "school at", "to study", "study in", "study at", "matriculat"]),
    ("fought", ["fought", "defeated", "victory at", "won at", "battle of", "besieged", "invaded", "captured", "commanded", "siege of"]),
    ("signed", ["signed", "treaty of", "negotiated", "peace of", "concordat", "alliance with", "diplomacy"]),
    ("crowned", ["crowned", "coronation", "proclaimed emperor", "became emperor", "became consul", "first consul"]),
    ("exiled", ["exiled", "exile to", "banished", "abdicated", "abdication"]),
    ("lived", ["lived", "resided", "residence", "stayed", "settled", "moved to", "returned to", "arrived in", "arrived at", "left for", "departed"]),
    ("visited", ["visited", "travelled", "traveled", "toured", "went to"]),
    ("met", ["met", "received", "audience", "congress of"]),
    ("imprisoned", ["imprisoned", "detained", "confined", "captive"]),
    ("published", ["published", "napoleonic code", "code civil", "wrote"]),
    ("appointed", ["appointed", "promoted", "commissioned", "named general", "elected"]),
    ("sailed", ["set sail", "sailed", "embarked", "voyage", "expedition", "landed"]),
    ("founded", ["founded", "founding"]),
    ("worked", ["worked at", "worked in", "laboratory"]),
    ("awarded", ["awarded", "nobel", "received the"]),
    ("painted", ["painted", "painting"]),
    ("discovered", ["discovered", "isolated", "research at"]),
    ("taught", ["taught", "teaching at"]),
    ("exiled", ["fled", "escaped"]),
    ("invented", ["invented", "designed", "decoded"]),
]
PHRASE_MEMORY = ["statue", "museum", "was unveiled", "memorial"]
PHRASE_NO_PLACE = [" and ", " was ", " were ", " the french", " commissioned", " officer"]

#: Fixed values: (spelling, latitude, longitude, precision) of places that labels are resolved to.
ALIASES = [
    ("ajaccio", 41.9267, 8.7369, "exact"), ("paris", 48.8566, 2.3522, "exact"), ("waterloo", 50.6794, 4.4047, "exact"), ("austerlitz", 49.1533, 16.875, "exact"),
    ("slavkov u brna", 49.1533, 16.875, "exact"), ("waterloo battlefield", 50.6794, 4.4047, "exact"), ("leipzig", 51.3397, 12.3731, "exact"), ("borodino", 55.526, 35.821, "exact"),
    ("moscow", 55.7558, 37.6173, "exact"), ("elba", 42.777, 10.192, "exact"), ("saint helena", -15.965, -5.712, "exact"), ("st helena", -15.965, -5.712, "exact"),
    ("sainte-hélène", -15.965, -5.712, "exact"), ("fontainebleau", 48.4047, 2.7016, "exact"), ("malmaison", 48.8706, 2.1681, "exact"), ("toulon", 43.1242, 5.928, "exact"),
    ("brienne", 48.3933, 4.5228, "exact"), ("marengo", 44.888, 8.679, "exact"), ("jena", 50.9272, 11.586, "exact"), ("wagram", 48.25, 16.5667, "exact"),
    ("friedland", 54.443, 21.011, "exact"), ("tilsit", 55.0833, 21.8833, "exact"), ("cairo", 30.0444, 31.2357, "exact"), ("egypt", 30.0444, 31.2357, "centroid"),
    ("vienna", 48.2082, 16.3738, "exact"), ("schönbrunn", 48.1845, 16.3122, "exact"), ("madrid", 40.4168, -3.7038, "exact"), ("berlin", 52.52, 13.405, "exact"),
    ("milan", 45.4642, 9.19, "exact"), ("rome", 41.9028, 12.4964, "exact"), ("ulm", 48.4011, 9.9876, "exact"), ("eylau", 54.4, 20.6333, "exact"), ("smolensk", 54.7826, 32.0853, "exact"),
    ("dresden", 51.0504, 13.7373, "exact"), ("lüetzen", 51.2583, 12.1417, "exact"), ("lutzen", 51.2583, 12.1417, "exact"), ("bautzen", 51.1803, 14.4347, "exact"),
    ("ligny", 50.512, 4.574, "exact"), ("quatre bras", 50.571, 4.638, "exact"), ("arcole", 45.358, 11.278, "exact"), ("rivoli", 45.571, 10.837, "exact"), ("lodi", 45.314, 9.503, "exact"),
    ("mantua", 45.1564, 10.7914, "exact"), ("acre", 32.926, 35.083, "exact"), ("aboukir", 31.3167, 30.0667, "exact"), ("amiens", 49.8941, 2.2958, "exact"),
    ("lille", 50.6292, 3.0573, "exact"), ("honfleur", 49.4197, 0.2328, "exact"), ("colombey", 48.217, 4.883, "exact"), ("colombey-les-deux-eglises", 48.217, 4.883, "exact"),
    ("colombey-les-deux-églises", 48.217, 4.883, "exact"), ("strasbourg", 48.5734, 7.7521, "exact"), ("erfurt", 50.9787, 11.0328, "exact"), ("bayonne", 43.4929, -1.4748, "exact"),
    ("vitoria", 42.8499, -2.6729, "exact"), ("cannes", 43.5528, 7.0174, "exact"), ("grenoble", 45.1885, 5.7245, "exact"), ("lyon", 45.764, 4.8357, "exact"),
    ("auxerre", 47.7982, 3.5733, "exact"), ("boulogne", 50.7264, 1.6147, "exact"), ("corsica", 42.0396, 9.0129, "centroid"), ("trafalgar", 36.183, -6.0, "approximate"),
    ("copenhagen", 55.6761, 12.5683, "exact"), ("valmy", 49.0667, 4.7667, "exact"), ("fleurus", 50.4833, 4.55, "exact"), ("zurich", 47.3769, 8.5417, "exact"),
    ("hohenlinden", 48.15, 11.9833, "exact"), ("jena–auerstedt", 50.9272, 11.586, "exact"), ("jena-auerstedt", 50.9272, 11.586, "exact"), ("aspern-essling", 48.2167, 16.4667, "exact"),
    ("aspern–essling", 48.2167, 16.4667, "exact"), ("berezina", 54.4833, 28.3167, "approximate"), ("salamanca", 40.97, -5.663, "exact"), ("talavera", 39.963, -4.83, "exact"),
    ("albuera", 38.7167, -6.8167, "exact"), ("busaco", 40.3333, -8.3333, "exact"), ("bussaco", 40.3333, -8.3333, "exact"), ("fuentes de oñoro", 40.5833, -6.8167, "exact"),
    ("ciudad rodrigo", 40.6, -6.5333, "exact"), ("badajoz", 38.879, -6.97, "exact"), ("zaragoza", 41.6488, -0.8891, "exact"), ("saragossa", 41.6488, -0.8891, "exact"),
    ("gerona", 41.9794, 2.8214, "exact"), ("girona", 41.9794, 2.8214, "exact"), ("toulouse", 43.6047, 1.4442, "exact"), ("orthez", 43.488, -0.772, "exact"),
    ("nive", 43.4, -1.45, "approximate"), ("nivelle", 43.35, -1.6, "approximate"), ("san sebastián", 43.3183, -1.9812, "exact"), ("san sebastian", 43.3183, -1.9812, "exact"),
    ("pymont", 50.3755, -4.1427, "exact"), ("plymouth", 50.3755, -4.1427, "exact"), ("rochefort", 45.942, -0.9588, "exact"), ("longwood", -15.95, -5.35, "exact"),
    ("notre-dame", 48.853, 2.3499, "exact"), ("tuileries", 48.863, 2.327, "exact"), ("invalides", 48.856, 2.312, "exact"), ("montenotte", 44.3667, 8.3, "exact"),
    ("millesimo", 44.3667, 8.2, "exact"), ("dego", 44.4167, 8.3167, "exact"), ("mondovì", 44.3833, 7.8167, "exact"), ("mondovi", 44.3833, 7.8167, "exact"),
    ("castiglione", 45.3833, 10.4833, "exact"), ("bassano", 45.7667, 11.7333, "exact"), ("caldiero", 45.4167, 11.1833, "exact"), ("novi", 44.7667, 8.7833, "exact"),
    ("trebbia", 45.0, 9.65, "approximate"), ("cassano", 45.5167, 9.5167, "exact"), ("magnano", 45.35, 11.0667, "exact"), ("pozzolo", 45.2, 10.8, "exact"),
    ("montebello", 44.9833, 9.0, "exact"), ("raab", 47.6833, 17.6333, "exact"), ("győr", 47.6833, 17.6333, "exact"), ("znaim", 48.855, 16.049, "exact"), ("znojmo", 48.855, 16.049, "exact"),
    ("hanau", 50.1333, 8.9167, "exact"), ("kulm", 50.7, 13.9, "approximate"), ("champaubert", 48.8833, 3.7667, "exact"), ("montmirail", 48.8667, 3.5333, "exact"),
    ("vauchamps", 48.8667, 3.6167, "exact"), ("craonne", 49.4333, 3.7167, "exact"), ("laon", 49.5667, 3.6167, "exact"), ("arcis-sur-aube", 48.5333, 4.1333, "exact"),
    ("la rothière", 48.35, 4.55, "exact"), ("fère-champenoise", 48.75, 4.0, "exact"), ("reims", 49.2583, 4.0317, "exact"), ("wavre", 50.7167, 4.6, "exact"),
    ("valençay", 47.15, 1.55, "exact"), ("valence", 44.9334, 4.8924, "exact"), ("compiègne", 49.417, 2.826, "exact"), ("saint-cloud", 48.845, 2.216, "exact"),
    ("rambouillet", 48.644, 1.83, "exact"), ("versailles", 48.8049, 2.1204, "exact"), ("bladensburg", 38.939, -76.934, "exact"), ("halifax", 44.6488, -63.5752, "exact"),
    ("raszyn", 52.158, 20.926, "exact"), ("lyngør", 58.633, 9.133, "exact"), ("lyngor", 58.633, 9.133, "exact"), ("suvodol", 43.15, 21.35, "approximate"),
    ("castalla", 38.596, -0.671, "exact"), ("saorgio", 43.983, 7.55, "exact"), ("tarvis", 46.505, 13.578, "exact"), ("tarvisio", 46.505, 13.578, "exact"),
    ("la suffel", 48.65, 7.75, "approximate"), ("issy", 48.824, 2.273, "exact"), ("portoferraio", 42.813, 10.315, "exact"), ("ormea", 44.15, 7.916, "exact"),
    ("hoenheim", 48.622, 7.755, "exact"), ("souffelweyersheim", 48.635, 7.74, "exact"), ("catalonia", 41.591, 1.52, "centroid"), ("belgium", 50.5039, 4.4699, "centroid"),
    ("vitebsk", 55.1904, 30.2049, "exact"), ("abukir", 31.3167, 30.0667, "exact"), ("abu qir", 31.3167, 30.0667, "exact"), ("ostroleka", 53.083, 21.566, "exact"),
    ("ostrołęka", 53.083, 21.566, "exact"), ("lubeck", 53.8655, 10.6866, "exact"), ("lübeck", 53.8655, 10.6866, "exact"), ("corunna", 43.3623, -8.4115, "exact"),
    ("a coruña", 43.3623, -8.4115, "exact"), ("vimeiro", 39.178, -9.318, "exact"), ("warsaw", 52.2297, 21.0122, "exact"), ("stockholm", 59.3293, 18.0686, "exact"),
    ("besançon", 47.2378, 6.0241, "exact"), ("besancon", 47.2378, 6.0241, "exact"), ("guernsey", 49.4657, -2.5853, "centroid"), ("jersey", 49.2138, -2.1358, "centroid"),
    ("vinci", 43.7869, 10.9237, "exact"), ("amboise", 47.4131, 0.9827, "exact"), ("palos", 37.2278, -6.8933, "exact"), ("san salvador", 24.077, -74.478, "approximate"),
    ("hispaniola", 19.0, -70.6667, "centroid"), ("valladolid", 41.6523, -4.7245, "exact"), ("barcelona", 41.3851, 2.1734, "exact"), ("manchester", 53.4808, -2.2426, "exact"),
    ("wilmslow", 53.328, -2.232, "exact"), ("princeton", 40.3573, -74.6672, "exact"), ("bletchley", 51.9973, -0.7406, "exact"), ("actium", 38.933, 20.733, "approximate"),
    ("tarsus", 36.9165, 34.8951, "exact"), ("alexandria", 31.2001, 29.9187, "exact"), ("sceaux", 48.778, 2.295, "exact"), ("passy", 48.8575, 2.2764, "exact"),
]
