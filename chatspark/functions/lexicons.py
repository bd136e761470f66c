"""Small fixed dimension data (label names and mappings).

Fixed values: these must equal the published label scheme for results to
match, so they are stated plainly, in their natural order.
"""

# --- Fixed values -------------------------------------------------------
# The 28 emotion columns of the one-hot emotion table, in table order.
EMOTIONS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
]

# Emotion name -> 3-way sentiment (used by emotion_to_sentiment; unknown -> neu).
EMOTION_TO_SENTIMENT = {
    "admiration": "pos", "amusement": "pos", "anger": "neg", "annoyance": "neg",
    "approval": "pos", "caring": "pos", "confusion": "neu", "curiosity": "pos",
    "desire": "pos", "disappointment": "neg", "disapproval": "neg", "disgust": "neg",
    "embarrassment": "neg", "excitement": "pos", "fear": "neg", "gratitude": "pos",
    "grief": "neg", "joy": "pos", "love": "pos", "nervousness": "neg", "optimism": "pos",
    "pride": "pos", "realization": "pos", "relief": "pos", "remorse": "neg",
    "sadness": "neg", "surprise": "pos", "neutral": "neu",
}

# Flag lists used when collapsing a multi-hot row (collapse_multihot).
# desire, nervousness and confusion are in neither list there.
POSITIVE_FLAGS = [
    "admiration", "amusement", "approval", "caring", "curiosity", "excitement",
    "gratitude", "joy", "love", "optimism", "pride", "realization", "relief", "surprise",
]
NEGATIVE_FLAGS = [
    "anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment",
    "fear", "grief", "remorse", "sadness",
]
NEUTRAL_FLAG = "neutral"

# The six basic emotions kept by basic_emotions (one order for names and argmax).
BASIC_EMOTIONS = ["anger", "fear", "joy", "sadness", "surprise", "disgust"]

# 3-way label ids: neg 0, neu 1, pos 2.
SENTIMENT_IDS = {"neg": 0, "neu": 1, "pos": 2}
ID_LABELS = ["neg", "neu", "pos"]
# --- end of fixed values --------------------------------------------------

# --- Fixed values: topic-word filters ---------------------------------------
# English stop words (the common public NLTK list, natural order).
ENGLISH_STOP_WORDS = [
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
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]
# Words containing any of these are dropped; the exact word "com" too.
DENY_SUBSTRINGS = ["smiling", "eyes", "face", "https", "grinning", "clyde", "unclyde"]
DENY_EXACT = ["com"]
# --- end of fixed values ------------------------------------------------------
