"""Column contracts shared by all operators.

The lists under "fixed values" must hold exactly these names, because data
sets and fitted states are exchanged by column name.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------

NUMERIC_FEATURES = [
    "nb_imgs", "nb_links_int", "nb_links_ext", "nb_links_tel", "nb_links_email", "nb_input_txt",
    "nb_button", "nb_meta_desc", "nb_meta_keyw", "nb_numerical_strings", "nb_tags",
    "nb_letters", "nb_distinct_hosts_in_urls", "nb_facebook_deep_links",
    "nb_facebook_shallow_links", "nb_linkedin_deep_links", "nb_linkedin_shallow_links",
    "nb_twitter_deep_links", "nb_twitter_shallow_links", "nb_currency_names",
    "nb_distinct_currencies", "distance_title_final_dn", "longest_subsequence_title_final_dn",
    "nb_youtube_deep_links", "nb_youtube_shallow_links", "nb_vimeo_deep_links",
    "nb_vimeo_shallow_links", "fraction_words_title_initial_dn",
    "fraction_words_title_final_dn", "nb_distinct_words_in_title", "distance_title_initial_dn",
    "longest_subsequence_title_initial_dn",
]

# Columns that must be nullable 64-bit integers in every stored data set.
INTEGER_COLUMNS = [
    "nb_facebook_deep_links", "nb_facebook_shallow_links", "nb_linkedin_deep_links",
    "nb_linkedin_shallow_links", "nb_twitter_deep_links", "nb_twitter_shallow_links",
    "nb_currency_names", "nb_distinct_currencies", "nb_youtube_deep_links",
    "nb_youtube_shallow_links", "nb_vimeo_deep_links", "nb_vimeo_shallow_links",
    "nb_distinct_words_in_title", "distance_title_initial_dn", "longest_subsequence_title_initial_dn",
    "distance_title_final_dn", "longest_subsequence_title_final_dn",
]

# List-like columns of the page feature table that are never stored.
DROPPED_COLUMNS = [
    "converted_domain_names", "facebook_links", "vimeo_links", "twitter_links", "youtube_links",
    "linkedin_links",
]

# Labels taken out of test sets unless the caller says otherwise.
IGNORED_TEST_LABELS = ["Low Content", "Not enough info", "Skip", "Mining and Drilling"]

HOST_COMPONENTS = 70
WINDOW_SIZE = 512
TOKEN_START, TOKEN_PAD, TOKEN_END, TOKEN_UNKNOWN = 0, 1, 2, 3
FIRST_WORD_ID = 4
# Most tokens that are looked up from a broadcast table; a larger vocabulary is joined.
VOCABULARY_BROADCAST = 250_000
VALIDATION_FRACTION = 0.15
SPLIT_SEED = 42

# Word segmentation: token total behind the gram counts, longest word tried,
# piece length, and how many words are carried over to the next piece.
GRAM_TOTAL = 1024908267229.0
LONGEST_WORD = 24
PIECE_LENGTH = 250
CARRIED_WORDS = 5
SENTENCE_START = "<s>"

# --- schemas --------------------------------------------------------------

_FRACTIONS = {"fraction_words_title_initial_dn", "fraction_words_title_final_dn"}

PAGES = T.StructType(
    [
        T.StructField("visit_id", T.StringType()),
        T.StructField("domain_name", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("meta_text", T.StringType()),
        T.StructField("external_hosts", T.ArrayType(T.StringType())),
    ]
    + [
        T.StructField(name, T.DoubleType() if name in _FRACTIONS else T.LongType())
        for name in NUMERIC_FEATURES
    ]
)

VOTES = "visit_id string, vote_ord bigint, label string"
VOTE_LISTS = "visit_id string, labels array<string>"
GRAMS = "gram string, n double"

REQUESTS = (
    "model string, job_id string, visit_id array<string>, domain_name array<string>, "
    "body_text array<string>, meta_text array<string>, external_hosts array<string>"
)
