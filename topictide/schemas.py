"""Column layouts of the feeds and of the tables the library hands on.

Raw feeds are text; every field stays a STRING until a typed view casts it.
"""

# Field names and positions of the feed formats.
POST_FIELDS = [
    "weibo_id", "user_id", "time_stamp", "is_retweet", "zhuan", "ping", "zhan",
    "weibo_content", "r_weibo_content",
]
POST_POSITIONS = {
    "is_retweet": 3, "user_id": 4, "weibo_id": 8, "weibo_content": 9, "zhuan": 10,
    "ping": 11, "zhan": 12, "time_stamp": 17, "r_weibo_content": 22,
}
POST_MIN_FIELDS = 24
SNAPSHOT_OUTER = (
    "crawler_time_stamp STRING, type STRING, bangdan STRING"
)
SNAPSHOT_INNER = (
    "cards ARRAY<STRUCT<card_type: STRING, card_group: ARRAY<STRUCT<"
    "card_type: STRING, desc: STRING, desc_extr: STRING>>>>"
)

# A schema with only the used fields is the column pruning of JSON parsing.
POST_JSON = ", ".join(f"{name} STRING" for name in POST_FIELDS)

# One extracted post. ``keyword_id`` names the term or topic that was hit.
POST_COLUMNS = [
    "weibo_id", "user_id", "time_stamp", "is_retweet", "zhuan", "ping", "zhan",
    "weibo_content",
]
EXTRACTED_COLUMNS = ["keyword_id", *POST_COLUMNS]

TOPIC_COLUMNS = ["timestamp", "date", "text", "hot", "flag"]
TOPIC_CSV = "timestamp STRING, date STRING, text STRING, hot STRING, flag STRING"

DICTIONARY_JSON = (
    "MAP<STRING, STRUCT<keyword: STRING, synonyms: ARRAY<STRING>, "
    "antonyms: ARRAY<STRING>>>"
)
LINE_COUNTS = "dt DATE, total_count LONG"
