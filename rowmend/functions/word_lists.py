"""Word lists the name rules compare against."""

# Words typical of postal addresses.
ADDRESS_WORDS = (
    "floor", "flr", "road", "rd", "street", "st", "cross", "lane", "colony", "building", "bldg", "apartment",
    "apt", "flat", "house", "sector", "plot", "near", "behind", "opp", "opposite", "phase", "block", "area",
    "district", "village", "post", "taluk", "tehsil", "pincode", "pin", "door", "no", "doorno",
)

# Words typical of business names.
BUSINESS_WORDS = (
    "school", "college", "hospital", "clinic", "medical", "pharmacy", "store", "mart", "wear", "menswear",
    "fashion", "boutique", "cleaning", "solution", "enterprises", "enterprise", "agency", "agencies",
    "traders", "trading", "hardware", "software", "boarding", "international", "club", "restaurant", "hotel",
    "lodge", "saloon", "salon", "shop", "services", "service", "finance", "bank", "automobiles", "automobile",
    "motors", "stationery", "xerox", "mobiles", "mobile", "electronics", "jewellers", "jeweler", "jewellery",
    "bakery", "foods", "food", "cafe", "centre", "center", "academy",
)

# Placeholders that stand where a name should be.
GENERIC_WORDS = (
    "guest", "customer", "unknown", "test", "demo", "sample", "null", "none", "na", "n/a", "dummy",
)

# Titles removed wherever they occur.
HONORIFICS = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "shri", "smt",
)

# Defaults of our own for pairwise name matching; both lists are parameters there.
# The trailing blank makes a prefix end at a word boundary.
NAME_PREFIXES = ("MR ", "MRS ", "MS ", "MISS ", "DR ", "PROF ", "SIR ", "MADAM ", "SHRI ", "SMT ")
NAME_STOP_WORDS = ("JR", "SR", "JUNIOR", "SENIOR", "II", "III", "ESQ")
