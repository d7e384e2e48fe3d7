"""Place names: countries by word and segment, India's cities, and renamed or re-spelt cities.

Callers with a fuller gazetteer pass their own rows; these cover the common spellings.
"""

# The postal codes and names of the states of the US and of the provinces of Canada.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware",
    "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
    "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico",
    "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island",
    "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington",
    "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
CANADIAN_PROVINCES = {
    "ab": "alberta", "bc": "british columbia", "mb": "manitoba", "nb": "new brunswick", "nl": "newfoundland", "ns": "nova scotia", "on": "ontario",
    "pe": "prince edward island", "qc": "quebec", "sk": "saskatchewan",
}

# Per country code: its English name, and words that name it unless another country is stated (own and former names, large
# cities). Codes that no state of the US or province of Canada has also name it as a part
# of their own; `_country` adds them.
_NAMES = {
    "AE": ("United Arab Emirates", "uae u.a.e dubai abu_dhabi sharjah ajman"),
    "AF": ("Afghanistan", "kabul"),
    "AL": ("Albania", "tirana"),
    "AM": ("Armenia", "yerevan"),
    "AO": ("Angola", "luanda"),
    "AR": ("Argentina", "buenos_aires rosario mendoza"),
    "AT": ("Austria", "österreich vienna wien graz linz salzburg innsbruck"),
    "AZ": ("Azerbaijan", "baku"),
    "BA": ("Bosnia and Herzegovina", "bosnia sarajevo banja_luka"),
    "BB": ("Barbados", "bridgetown"),
    "BD": ("Bangladesh", "dhaka chittagong"),
    "BE": ("Belgium", "belgique belgië brussels bruxelles antwerp antwerpen ghent leuven"),
    "BG": ("Bulgaria", "sofia plovdiv varna"),
    "BH": ("Bahrain", "manama"),
    "BO": ("Bolivia", "la_paz santa_cruz_de_la_sierra cochabamba"),
    "BR": ("Brazil", "brasil são_paulo sao_paulo rio_de_janeiro belo_horizonte curitiba brasília porto_alegre recife florianópolis campinas"),
    "BW": ("Botswana", "gaborone"),
    "BY": ("Belarus", "minsk"),
    "CD": ("Democratic Republic of the Congo", "kinshasa"),
    "CI": ("Ivory Coast", "côte_d'ivoire abidjan"),
    "CL": ("Chile", "santiago_de_chile valparaíso"),
    "CM": ("Cameroon", "yaoundé douala"),
    "CN": ("China", "beijing shanghai shenzhen guangzhou hangzhou chengdu suzhou nanjing wuhan xi'an tianjin"),
    "CO": ("Colombia", "bogotá bogota medellín medellin cali barranquilla"),
    "CR": ("Costa Rica", "heredia"),
    "CU": ("Cuba", "havana"),
    "CY": ("Cyprus", "nicosia limassol"),
    "CZ": ("Czech Republic", "czechia prague praha brno ostrava plzeň"),
    "DK": ("Denmark", "danmark copenhagen københavn aarhus odense"),
    "DO": ("Dominican Republic", "santo_domingo"),
    "DZ": ("Algeria", "algiers oran"),
    "EC": ("Ecuador", "quito guayaquil"),
    "EE": ("Estonia", "eesti tallinn tartu"),
    "EG": ("Egypt", "cairo giza"),
    "ET": ("Ethiopia", "addis_ababa"),
    "FI": ("Finland", "suomi helsinki espoo tampere oulu turku"),
    "GE": ("Georgia (country)", "tbilisi batumi"),
    "GH": ("Ghana", "accra kumasi"),
    "GR": ("Greece", "thessaloniki"),
    "GT": ("Guatemala", ""),
    "HK": ("Hong Kong", "kowloon"),
    "HN": ("Honduras", "tegucigalpa san_pedro_sula"),
    "HR": ("Croatia", "hrvatska zagreb"),
    "HU": ("Hungary", "magyarország budapest debrecen szeged"),
    "ID": ("Indonesia", "jakarta bandung surabaya"),
    "IL": ("Israel", "tel_aviv haifa jerusalem herzliya ramat_gan petah_tikva"),
    "IQ": ("Iraq", "baghdad erbil"),
    "IR": ("Iran", "tehran"),
    "IS": ("Iceland", "reykjavik reykjavík"),
    "IT": ("Italy", "italia milan milano turin torino bologna naples napoli"),
    "JM": ("Jamaica", ""),
    "JO": ("Jordan", "amman"),
    "KE": ("Kenya", "nairobi mombasa"),
    "KH": ("Cambodia", "phnom_penh"),
    "KR": ("South Korea", "republic_of_korea seoul busan incheon"),
    "KW": ("Kuwait", ""),
    "KZ": ("Kazakhstan", "almaty astana"),
    "LA": ("Laos", "vientiane"),
    "LB": ("Lebanon", "beirut"),
    "LK": ("Sri Lanka", "colombo"),
    "LT": ("Lithuania", "lietuva vilnius kaunas"),
    "LU": ("Luxembourg", ""),
    "LV": ("Latvia", "latvija riga"),
    "LY": ("Libya", ""),
    "MA": ("Morocco", "casablanca rabat marrakech marrakesh tangier"),
    "MD": ("Moldova", "chișinău chisinau"),
    "ME": ("Montenegro", "podgorica"),
    "MG": ("Madagascar", "antananarivo"),
    "MK": ("North Macedonia", "macedonia skopje"),
    "MM": ("Myanmar", "yangon"),
    "MN": ("Mongolia", "ulaanbaatar"),
    "MT": ("Malta", "sliema"),
    "MU": ("Mauritius", "port_louis"),
    "MX": ("Mexico", "méxico mexico_city ciudad_de_méxico guadalajara monterrey tijuana querétaro"),
    "MY": ("Malaysia", "kuala_lumpur penang selangor johor_bahru"),
    "MZ": ("Mozambique", "maputo"),
    "NA": ("Namibia", "windhoek"),
    "NG": ("Nigeria", "lagos abuja ibadan"),
    "NI": ("Nicaragua", "managua"),
    "NO": ("Norway", "norge oslo bergen trondheim stavanger"),
    "NP": ("Nepal", "kathmandu"),
    "NZ": ("New Zealand", "aotearoa auckland christchurch"),
    "OM": ("Oman", "muscat"),
    "PA": ("Panama", "panamá panama_city_panama"),
    "PE": ("Peru", "perú arequipa"),
    "PH": ("Philippines", "manila makati cebu taguig quezon_city"),
    "PK": ("Pakistan", "karachi lahore islamabad rawalpindi"),
    "PL": ("Poland", "polska warsaw warszawa kraków krakow wrocław wroclaw gdańsk gdansk poznań poznan łódź katowice"),
    "PR": ("Puerto Rico", ""),
    "PT": ("Portugal", "lisbon lisboa braga aveiro coimbra"),
    "PY": ("Paraguay", "asunción asuncion"),
    "QA": ("Qatar", "doha"),
    "RO": ("Romania", "românia bucharest bucurești bucuresti cluj-napoca cluj timișoara timisoara iași iasi brașov"),
    "RS": ("Serbia", "srbija belgrade beograd novi_sad"),
    "RU": ("Russia", "russian_federation moscow_russia saint_petersburg novosibirsk"),
    "RW": ("Rwanda", "kigali"),
    "SA": ("Saudi Arabia", "ksa riyadh jeddah dammam al_khobar"),
    "SE": ("Sweden", "sverige stockholm gothenburg göteborg malmö malmo uppsala"),
    "SI": ("Slovenia", "ljubljana maribor"),
    "SK": ("Slovakia", "slovensko bratislava košice kosice"),
    "SN": ("Senegal", "dakar"),
    "SV": ("El Salvador", "san_salvador"),
    "TH": ("Thailand", "bangkok chiang_mai phuket"),
    "TN": ("Tunisia", "tunis"),
    "TR": ("Turkey", "türkiye turkiye istanbul i̇stanbul ankara izmir"),
    "TT": ("Trinidad and Tobago", "port_of_spain"),
    "TW": ("Taiwan", "taipei hsinchu taichung kaohsiung"),
    "TZ": ("Tanzania", "dar_es_salaam"),
    "UA": ("Ukraine", "kyiv kiev lviv kharkiv odesa"),
    "UG": ("Uganda", "kampala"),
    "UY": ("Uruguay", "montevideo"),
    "UZ": ("Uzbekistan", "tashkent"),
    "VE": ("Venezuela", "caracas"),
    "VN": ("Vietnam", "viet_nam hanoi ha_noi ho_chi_minh_city ho_chi_minh da_nang saigon"),
    "ZA": ("South Africa", "johannesburg cape_town pretoria durban"),
    "ZM": ("Zambia", "lusaka"),
    "ZW": ("Zimbabwe", "harare"),
}
#: Words that more than one country's places bear, and that yield to a place named for sure.
_SHARED_WORDS = {
    "AR": "córdoba", "CL": "santiago", "CR": "san_jose", "GE": "georgia", "GR": "athens", "IT": "rome roma florence", "KR": "korea", "MX": "mexico", "NZ": "wellington hamilton", "PE": "lima", "PT": "porto",
    "RU": "moscow", "JM": "kingston", "JO": "jordan", "LB": "lebanon", "LY": "tripoli", "PA": "panama_city"
}


def _words(listed: str) -> tuple[str, ...]:
    return tuple(w.replace("_", " ") for w in listed.split())


def _country(code: str, name: str, words: str) -> dict:
    """A country's row. Its name is a sure word unless other places bear it."""
    shared = _words(_SHARED_WORDS.get(code, ""))
    plain = name.lower()
    row = {"name": name, "words": tuple(w for w in (plain,) if w not in shared and "(" not in w), "city_words": _words(words), "shared_words": shared}
    if code.lower() not in US_STATES and code.lower() not in CANADIAN_PROVINCES:
        row["shared_segments"] = (code.lower(),)
    return row


# Fixed values. `words` name a country anywhere in a location; `segments` name it as a whole part between separators;
# `shared_segments` and `shared_words` also name another place and yield to it; `city_words` count unless another country is
# stated.
COUNTRIES = {
    "US": {
        "name": "United States",
        "words": ("united states", "united states of america", "usa", "u.s.a", "san francisco", "austin", "seattle", "chicago", "los angeles", "houston", "atlanta", "denver", "philadelphia",
                  "san diego", "las vegas", "minneapolis", "detroit", "brooklyn", "silicon valley", *[n for n in US_STATES.values() if n not in ("georgia", "washington")], "washington dc", "washington d.c"),
        "segments": ("us", "u.s."),
        "shared_segments": tuple(US_STATES),
        "shared_words": ("georgia", "washington", "boston", "dallas", "miami", "phoenix", "portland", "columbus", "san jose"),
    },
    "GB": {
        "name": "United Kingdom",
        "words": ("united kingdom", "great britain", "england", "scotland", "northern ireland", "manchester", "edinburgh", "glasgow", "belfast", "leeds", "cardiff"),
        "segments": ("uk", "u.k."),
        "shared_segments": ("gb", "wales"),
        "shared_words": ("london", "cambridge", "oxford", "birmingham", "bristol"),
    },
    "DE": {
        "name": "Germany",
        "words": ("germany", "deutschland", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "düsseldorf", "leipzig", "dresden", "nuremberg", "nürnberg"),
        "shared_segments": ("de",),
        "city_words": ("berlin",),
    },
    "FR": {"name": "France", "words": ("france", "lyon", "toulouse", "marseille", "bordeaux", "lille", "nantes", "strasbourg", "grenoble"), "shared_segments": ("fr",), "city_words": ("paris",)},
    "CH": {"name": "Switzerland", "words": ("switzerland", "schweiz", "suisse", "zürich", "zurich", "geneva", "genève", "basel", "lausanne", "bern"), "shared_segments": ("ch",)},
    "CA": {
        "name": "Canada",
        "words": ("canada", "toronto", "vancouver", "montreal", "montréal", "calgary", "edmonton", "winnipeg", "québec", *[n for n in CANADIAN_PROVINCES.values() if n != "ontario"]),
        "shared_segments": ("ca", *CANADIAN_PROVINCES),
        "shared_words": ("ontario", "ottawa", "waterloo", "london ontario"),
    },
    "JP": {"name": "Japan", "words": ("japan", "tokyo", "osaka", "kyoto", "yokohama", "fukuoka", "nagoya"), "shared_segments": ("jp",)},
    "IE": {"name": "Ireland", "words": ("republic of ireland", "galway", "limerick"), "shared_segments": ("ie",), "shared_words": ("ireland", "dublin", "cork")},
    "NL": {"name": "Netherlands", "words": ("netherlands", "the netherlands", "nederland", "holland", "amsterdam", "rotterdam", "utrecht", "eindhoven", "the hague", "den haag"), "shared_segments": ("nl",)},
    "ES": {"name": "Spain", "words": ("spain", "españa", "madrid", "barcelona", "sevilla", "seville", "málaga", "bilbao"), "shared_segments": ("es",), "shared_words": ("valencia",)},
    "AU": {"name": "Australia", "words": ("australia", "sydney", "melbourne", "brisbane", "adelaide", "canberra", "new south wales", "queensland"), "shared_segments": ("au", "nsw", "vic", "qld"), "shared_words": ("perth",)},
    "SG": {"name": "Singapore", "words": ("singapore",), "shared_segments": ("sg",)},
    "IN": {
        "name": "India",
        "words": ("india", "bengaluru", "bangalore", "mumbai", "pune", "chennai", "new delhi", "gurugram", "gurgaon", "noida", "kolkata", "ahmedabad", "jaipur", "kochi", "coimbatore", "indore",
                  "hyderabad", "karnataka", "telangana", "maharashtra", "tamil nadu", "haryana", "uttar pradesh", "west bengal", "kerala", "gujarat"),
        "shared_segments": ("in",),
    },
}
COUNTRIES |= {code: _country(code, name, words) for code, (name, words) in _NAMES.items()}

# Other names a caller may type for a country.
COUNTRY_ALIASES = {
    "uk": "GB", "usa": "US", "unitedstatesofamerica": "US", "britain": "GB", "greatbritain": "GB", "england": "GB", "uae": "AE", "emirates": "AE", "türkiye": "TR", "turkiye": "TR", "czechia": "CZ",
    "korea": "KR", "georgia": "GE", "holland": "NL", "cotedivoire": "CI", "bosnia": "BA", "russianfederation": "RU", "vietnam": "VN", "ksa": "SA",
}

# One country's places. A guarded alias is read only where its guard word is absent.
INDIA_PLACES = {
    "bengaluru": {"state": "karnataka", "aliases": ("bengaluru", "bangalore", "blr")},
    "mysuru": {"state": "karnataka", "aliases": ("mysuru", "mysore")},
    "mangaluru": {"state": "karnataka", "aliases": ("mangaluru", "mangalore")},
    "hyderabad": {"state": "telangana", "aliases": ("hyderabad", "secunderabad"), "unless": ("pakistan", "sindh")},
    "mumbai": {"state": "maharashtra", "aliases": ("mumbai", "bombay", "navi mumbai", "thane")},
    "pune": {"state": "maharashtra", "aliases": ("pune",)},
    "nagpur": {"state": "maharashtra", "aliases": ("nagpur",)},
    "nashik": {"state": "maharashtra", "aliases": ("nashik",)},
    "chennai": {"state": "tamil nadu", "aliases": ("chennai", "madras")},
    "coimbatore": {"state": "tamil nadu", "aliases": ("coimbatore",)},
    "madurai": {"state": "tamil nadu", "aliases": ("madurai",)},
    "delhi": {"state": "delhi", "aliases": ("new delhi", "delhi"), "unless": ("ontario", "ny", "louisiana")},
    "gurugram": {"state": "haryana", "aliases": ("gurugram", "gurgaon")},
    "faridabad": {"state": "haryana", "aliases": ("faridabad",)},
    "noida": {"state": "uttar pradesh", "aliases": ("noida", "greater noida")},
    "lucknow": {"state": "uttar pradesh", "aliases": ("lucknow",), "unless": ("ontario", "mn")},
    "kanpur": {"state": "uttar pradesh", "aliases": ("kanpur",)},
    "ghaziabad": {"state": "uttar pradesh", "aliases": ("ghaziabad",)},
    "kolkata": {"state": "west bengal", "aliases": ("kolkata", "calcutta"), "unless": ("ohio", "oh")},
    "ahmedabad": {"state": "gujarat", "aliases": ("ahmedabad", "amdavad")},
    "vadodara": {"state": "gujarat", "aliases": ("vadodara", "baroda"), "unless": ("mi", "michigan")},
    "surat": {"state": "gujarat", "aliases": ("surat",)},
    "gandhinagar": {"state": "gujarat", "aliases": ("gandhinagar", "gift city")},
    "jaipur": {"state": "rajasthan", "aliases": ("jaipur",)},
    "udaipur": {"state": "rajasthan", "aliases": ("udaipur",)},
    "kochi": {"state": "kerala", "aliases": ("kochi", "cochin"), "unless": ("japan",)},
    "thiruvananthapuram": {"state": "kerala", "aliases": ("thiruvananthapuram", "trivandrum")},
    "kozhikode": {"state": "kerala", "aliases": ("kozhikode", "calicut")},
    "indore": {"state": "madhya pradesh", "aliases": ("indore",)},
    "bhopal": {"state": "madhya pradesh", "aliases": ("bhopal",)},
    "chandigarh": {"state": "chandigarh", "aliases": ("chandigarh",)},
    "mohali": {"state": "punjab", "aliases": ("mohali",)},
    "ludhiana": {"state": "punjab", "aliases": ("ludhiana",)},
    "visakhapatnam": {"state": "andhra pradesh", "aliases": ("visakhapatnam", "vizag")},
    "vijayawada": {"state": "andhra pradesh", "aliases": ("vijayawada",)},
    "bhubaneswar": {"state": "odisha", "aliases": ("bhubaneswar",)},
    "patna": {"state": "bihar", "aliases": ("patna",)},
    "ranchi": {"state": "jharkhand", "aliases": ("ranchi",)},
    "raipur": {"state": "chhattisgarh", "aliases": ("raipur",)},
    "guwahati": {"state": "assam", "aliases": ("guwahati",)},
    "dehradun": {"state": "uttarakhand", "aliases": ("dehradun",)},
}
INDIA_STATES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur",
    "meghalaya", "mizoram", "nagaland", "odisha", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "jammu and kashmir", "ladakh", "puducherry",
)

# Spellings of one city, the name it is counted under first.
CITY_GROUPS = (
    ("bengaluru", "bangalore"), ("mumbai", "bombay"), ("chennai", "madras"), ("kolkata", "calcutta"),
    ("gurugram", "gurgaon"), ("munich", "munchen", "muenchen"), ("cologne", "koln", "koeln"),
    ("vienna", "wien"), ("prague", "praha"), ("warsaw", "warszawa"), ("lisbon", "lisboa"),
    ("zurich", "zuerich"), ("geneva", "geneve"), ("kyiv", "kiev"), ("milan", "milano"), ("rome", "roma"),
)
