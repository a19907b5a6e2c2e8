"""Word lists, patterns and constants as plain data; no logic lives here."""

# --- Fixed values: domains ---------------------------------------------------------------

PAYMENT_METHODS = ["cash", "credit", "debit", "apple_pay", "google_pay", "other"]

CATEGORIES = [
    "groceries", "restaurant", "fast_food", "coffee_shop",
    "electronics", "pharmacy", "treats", "other",
]

CHUNK_TYPES = ["receipt_summary", "item_detail", "category_group", "merchant_info", "payment_method"]

# --- Fixed values: receipt text ----------------------------------------------------------

STORE_TYPE_WORDS = ["STORE", "SHOP", "MARKET", "PHARMACY", "CAFE", "RESTAURANT"]

NAME_SUFFIXES = [
    "inc", "corp", "llc", "store", "shop", "market",
    "pharmacy", "cafe", "coffee", "restaurant", "ltd",
]

# Label, pattern, and the words of which any find of the pattern holds one.
PAYMENT_RULES = [
    ("cash", r"\bcash\b", ["cash"]),
    ("credit", r"\b(?:credit|visa|mastercard|amex|discover)\b", ["credit", "visa", "mastercard", "amex", "discover"]),
    ("debit", r"\bdebit\b", ["debit"]),
    ("apple_pay", r"apple\s+pay", ["apple"]),
    ("google_pay", r"google\s+pay", ["google"]),
]

# A line holding any of these is not an item; every one is a literal, rulers included.
NON_ITEM_WORDS = [
    "total", "subtotal", "tax", "tip", "discount", "cash",
    "credit", "debit", "change", "thank you", "receipt",
    "---", "===", "***", "...",
    "date:", "time:", "cashier:", "register:", "order:",
    "payment", "server", "associate", "phone:", "address:",
    "sku:", "transaction id:", "approval code:",
]

# Wallet tender lines and delivery charges carry an amount and would otherwise read as items.
TENDER_WORDS = ["apple pay", "google pay", "delivery fee", "delivery charge"]

STREET_WORDS = [
    "Street", r"St\.", "Avenue", r"Ave\.", "Road", r"Rd\.", "Boulevard", r"Blvd\.",
    "Drive", r"Dr\.", "Lane", r"Ln\.", "Way", "Court", r"Ct\.",
]

RETURN_WORDS = r"\b(?:refund|refunded|return|returned|credit memo|credit\s+transaction)\b"

CARD_PATTERN = r"\b(visa|mastercard|amex|american express|discover)\b.*?(\*{2,}|\bending\b)[ \t]*(\d{4})\b"

# --- Fixed values: categories ------------------------------------------------------------

ITEM_KEYWORDS = [
    ("groceries", [
        "milk", "bread", "eggs", "cheese", "meat", "vegetables", "fruits",
        "cereal", "pasta", "rice", "beans", "yogurt", "butter", "oil",
    ]),
    ("electronics", [
        "phone", "laptop", "computer", "tablet", "headphones", "cable",
        "charger", "battery", "tv", "camera", "gaming", "console",
        "mouse", "keyboard", "monitor", "printer", "software", "hardware",
        "memory", "drive", "ssd", "usb", "case", "adapter",
    ]),
    ("fast_food", [
        "burger", "fries", "nuggets", "sandwich", "wrap", "taco", "burrito",
        "bowl", "chipotle", "mcdonald", "subway", "kfc", "wendy", "taco bell",
        "pizza", "domino", "papa john", "chicken", "wings", "combo", "meal",
        "soda", "drink", "shake", "smoothie", "cookie", "apple pie",
    ]),
    ("coffee_shop", [
        "coffee", "latte", "espresso", "cappuccino", "mocha",
        "drip", "americano", "tea", "pastry", "croissant", "muffin",
    ]),
    ("pharmacy", [
        "medicine", "prescription", "vitamin", "supplement", "pain",
        "cold", "flu", "allergy", "first aid", "bandage",
    ]),
    ("treats", [
        "candy", "chocolate", "ice cream", "cake", "cookie", "donut",
        "pie", "dessert", "sweet", "candy bar", "pastry",
    ]),
    ("restaurant", [
        "steak", "salad", "soup", "pasta", "appetizer", "entree",
        "dine in", "table service", "gratuity",
    ]),
]

MERCHANT_KEYWORDS = [
    ("coffee_shop", ["starbucks", "peet", "coffee", "dunkin", "philz"]),
    ("fast_food", [
        "mcdonald", "chipotle", "subway", "taco bell", "burger palace",
        "panera", "kfc", "wendy", "pizza", "taco", "burrito",
    ]),
    ("pharmacy", ["cvs", "walgreens", "rite aid", "pharmacy"]),
    ("electronics", ["best buy", "apple", "micro center", "b&h", "amazon"]),
    ("groceries", ["whole foods", "trader joe", "safeway", "kroger", "market"]),
]

# --- Fixed values: calendar --------------------------------------------------------------

MONTHS = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]

# Accepted spellings in month order; each alternation lists the long form first.
MONTH_WORDS = [
    "january|jan", "february|feb", "march|mar", "april|apr", "may", "june|jun", "july|jul",
    "august|aug", "september|sept|sep", "october|oct", "november|nov", "december|dec",
]

# Name, month and day counted from, weekday that follows it (None: the day itself), days after that.
HOLIDAY_CALENDAR = [
    ("thanksgiving", 10, 31, "Thu", 21),
    ("christmas", 12, 25, None, 0),
    ("new years", 1, 1, None, 0),
    ("new year", 1, 1, None, 0),
    ("black friday", 10, 31, "Thu", 22),
    ("cyber monday", 10, 31, "Thu", 25),
    ("memorial day", 5, 24, "Mon", 0),
    ("labor day", 8, 31, "Mon", 0),
    ("fourth of july", 7, 4, None, 0),
    ("halloween", 10, 31, None, 0),
]

HOLIDAYS = [name for name, *_ in HOLIDAY_CALENDAR]

# --- Fixed values: time phrases ----------------------------------------------------------

ANY_MONTH = "(" + "|".join(MONTH_WORDS) + ")"
STATED_YEAR = r"(20\d{2})"
ISO_DAY = r"\b(20\d{2})-(\d{2})-(\d{2})\b"
SLASH_DAY = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
TEXTUAL_DAY = rf"\b{ANY_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s*(20\d{{2}})?\b"
DAYS_BACK = r"(?:last|past)\s+(\d+)\s+days?"
QUARTER = r"q([1-4])\s*(20\d{2})?"
SINCE = r"(?s)since(.*)$"
BETWEEN = r"(?s)between\s+(.+?)\s+and\s+(.+)$"

# --- Fixed values: questions -------------------------------------------------------------

_ALL_MONTHS = "|".join(MONTHS)

INTENT_RULES = [
    ("temporal", [
        rf"how much.* (?:in|during|for) (?:{_ALL_MONTHS})",
        r"how much.* (?:last|this|past) (?:week|month|year)",
        rf"show me.* (?:{_ALL_MONTHS})",
        r"what did i buy (?:last|this|past) (?:week|month|year)",
        r"(?:in|during) (?:20\d{2})",
    ]),
    ("merchant", [
        r"show me.* (?:from|at) .*",
        r"find all.* receipts? (?:from|at) .*",
        r"how much.* (?:at|from) .*",
    ]),
    ("category", [
        r"how much.* (?:coffee shops|restaurants|groceries|electronics)",
        r"show me.* (?:electronics|groceries|pharmacy|health)",
        r"what's.* (?:total|total spending) (?:at|in) (?:restaurants|coffee shops)",
        r"list all.* (?:groceries|electronics)",
    ]),
    ("amount", [
        r"over \$\d+",
        r"under \$\d+",
        r"between \$\d+ and \$\d+",
        r"more than \$\d+",
        r"less than \$\d+",
    ]),
    ("item_specific", [
        r"find.* with warranty",
        r"show me.* (?:phone|laptop|tv|tablet)",
        r"list all.* (?:vitamins|medicine|supplements)",
    ]),
    ("aggregation", [
        r"how much.* (?:total|sum)",
        r"what's my total",
        r"average",
        r"count",
    ]),
]

METRIC_WORDS = [
    r"\btotal\b", r"\bsum\b", r"\bspent\b", r"\bcost\b", r"\bprice\b",
    r"\bamount\b", r"\bhow much\b", r"\btaxes\b", r"\btax\b", r"\btips?\b",
]

AGGREGATION_RULES = [
    ("sum", [r"\bsum\b", r"\btotal\b", r"\badd up\b", r"\ball\b", r"\bhow much\b", r"\bspent\b"]),
    ("average", [r"\baverage\b", r"\bavg\b", r"\bmean\b"]),
    ("count", [r"\bcount\b", r"\bhow many\b", r"\bnumber of\b"]),
]

QUESTION_CATEGORIES = [
    (["coffee shop"], ["coffee_shop", "fast_food"]),
    (["restaurant"], ["restaurant", "fast_food"]),
    (["groceries", "grocery"], ["groceries"]),
    (["electronics"], ["electronics"]),
    (["pharmacy", "health"], ["pharmacy"]),
]

# Later entries win.
QUESTION_PAYMENTS = [
    ("apple pay", "apple_pay"),
    ("google pay", "google_pay"),
    ("cash", "cash"),
    ("debit", "debit"),
    ("credit", "credit"),
]

CARD_NETWORKS = ["visa", "mastercard", "amex", "discover"]

FEATURE_WORDS = [
    ("has_warranty", r"warranty"),
    ("is_return", r"\b(?:return|refund|returned)\b"),
    ("has_discounts", r"discount"),
    ("has_delivery_fee", r"delivery"),
    ("has_tip", r"tip"),
]

LOWER_BOUND_WORDS = ["over", "more", "above"]
UPPER_BOUND_WORDS = ["under", "less", "below"]

SEMANTIC_TERMS = [
    ("health related", ["pharmacy", "health", "medicine", "vitamin", "supplement"]),
    ("treats", [
        "candy", "chocolate", "ice cream", "cake", "cookie", "donut", "dessert", "sweet",
        "pastry", "croissant", "muffin", "brownie", "snack",
    ]),
    ("coffee shops", ["coffee", "starbucks", "dunkin", "cafe", "latte", "espresso"]),
    ("restaurants", ["restaurant", "burger", "pizza", "sandwich", "salad", "pasta", "steak"]),
]

# Labels that a concept's items carry, for questions that name no category.
CONCEPT_CATEGORIES = [
    ("health related", ["pharmacy"]),
    ("treats", ["treats"]),
    ("coffee shops", ["coffee_shop", "fast_food"]),
    ("restaurants", ["restaurant", "fast_food"]),
]

ITEM_BASIS_WORDS = ["items", "buy", "bought", "purchase"]

# --- Fixed values: merchants in questions --------------------------------------------------

PREPOSITIONS = [
    "at", "from", "to", "in", "spent at", "bought at", "visited",
    "shopped at", "ordered from", "purchased from",
]

NAME_CUT_WORDS = [
    "in", "during", "for", "last", "this", "past", "yesterday", "on", "over", "under", "before", "after",
]

ARTICLES = ["the", "a", "an"]

TIME_WORDS = [
    "january", "jan", "february", "feb", "march", "mar", "april", "apr",
    "may", "june", "jun", "july", "jul", "august", "aug", "september",
    "sep", "sept", "october", "oct", "november", "nov", "december", "dec",
    "today", "yesterday", "tomorrow", "week", "month", "year",
]

CATEGORY_WORDS = [
    "coffee shops", "coffee shop", "restaurants", "restaurant",
    "groceries", "grocery", "grocery store", "electronics", "electronic",
    "pharmacy", "pharmacies", "treats", "desserts", "fast food", "health",
    "shopping", "store",
]

MIN_TOKEN_LENGTH = 3
MIN_SIMILARITY = 0.75
CONTAINMENT_SCORE = 0.9

# --- Fixed values: answers, chunks and checks ----------------------------------------------

TOP_K = 10
HISTORY_KEEP = 5
TOP_MERCHANTS = 8
HISTOGRAM_BINS = 10
SUMMARY_ITEMS = 5
CONTENT_LIMIT = 24000
STORED_CONTENT_LIMIT = 1000
MIN_CONTENT = 10
TOTAL_TOLERANCE = 1.00
ITEM_SUM_TOLERANCE = 5.00
CONFIDENCE_VERIFIED = 0.85
CONFIDENCE_DEFAULT = 0.7
EMPTY_ANSWER = "I couldn't find any receipts matching those criteria."
