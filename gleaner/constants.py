"""Results depend on each of them, so they are stated plainly here.

Words that name a retailer or its ranges are not part of the library. Callers add them through
``brand_terms`` (stop words), ``extra_keywords`` (search plan) and their own event table.
"""

from __future__ import annotations

# --- fixed values: analysis window, both ends inclusive, UTC -----------------------------------
WINDOW_START = "2023-01-01 00:00:00"
WINDOW_END = "2026-04-23 00:00:00"

# --- fixed values: thresholds -------------------------------------------------------------------
SHORT_TEXT_CHARS = 20
SAMPLES_PER_STAR = 1000
SEED = 42
SAMPLE_MONTH_MIN = 20
MONTH_MIN_REVIEWS = 100
EVENT_WINDOW_DAYS = 30
EVENT_MIN_REVIEWS = 30
PIVOT_MIN_SHARE = 0.6
CONFIDENCE_THRESHOLD = 0.80
MIN_TOKENS = 5
VOCAB_MIN_DF = 10
VOCAB_MAX_DF_SHARE = 0.5
K_VALUES = [5, 7, 10, 12]
LDA_PASSES = 10
TOP_WORDS = 15
COHERENCE_TOP_WORDS = 20
COHERENCE_WINDOW = 110
COHERENCE_EPSILON = 1e-12
RELEVANT_TERMS = 30
#: Weight below which the viewer shows no cell of a term and topic.
TOKEN_MIN_COUNT = 0.5
SEARCH_PAGE_SIZE = 60
SEARCH_MAX_PAGES = 2
MAX_REVIEWS_PER_PRODUCT = 50
MIN_REVIEWS_PER_PRODUCT = 5
REVIEW_REQUEST_SIZE = 100
PRODUCT_SUFFIX = "-P"
SCORE_BATCH = 32
SAMPLE_BATCH = 16
MAX_MODEL_TOKENS = 256

# --- fixed values: class labels in index order, and their score ----------------------------------
LABELS = ["negative", "neutral", "positive"]
LABEL_SCORES = {"negative": -1, "neutral": 0, "positive": 1}

# --- fixed values: search keywords ----------------------------------------------------------------
CATEGORY_KEYWORDS = [
    "milk", "bread", "eggs", "chicken", "beef", "salmon", "bananas", "apples",
    "pasta", "cereal", "biscuits", "coffee", "tea",
    "ready meal", "pizza", "sandwich",
    "ice cream", "frozen vegetables",
    "wine", "beer", "juice",
    "washing powder", "toilet paper", "shampoo",
]

# --- fixed values: CSV cells that mean "missing" ----------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: English stop words, then review stop words ---------------------------------------
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
REVIEW_STOPWORDS = [
    "product", "item", "bought", "buy", "buying", "purchase", "purchased",
    "would", "could", "should", "get", "got", "use", "used", "using",
    "one", "two", "say", "said", "really", "quite", "also",
    "like", "good", "bad", "nice", "great", "lovely", "amazing",
    "taste", "flavour",
    "not", "no", "nothing", "none",
    "review", "reviewing", "star", "rating",
    "day", "week", "month", "year", "today", "yesterday",
]

# --- fixed values: noun plurals that the suffix rules would get wrong --------------------------------
IRREGULAR_NOUNS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "geese": "goose", "mice": "mouse", "leaves": "leaf", "loaves": "loaf", "knives": "knife",
    "halves": "half", "shelves": "shelf", "calves": "calf", "buses": "bus", "gases": "gas",
    "cookies": "cookie", "brownies": "brownie", "smoothies": "smoothie", "calories": "calorie",
    "movies": "movie", "pies": "pie", "ties": "tie", "series": "series", "species": "species",
}

# --- fixed values: noun suffix rules of the lexicon lemmatiser, tried in this order -------------------
NOUN_SUFFIX_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]


def stopword_set(brand_terms=()) -> list[str]:
    """English list united with the review list and the caller's brand words."""
    return sorted(set(ENGLISH_STOPWORDS) | set(REVIEW_STOPWORDS) | set(brand_terms))
