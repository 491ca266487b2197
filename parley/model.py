"""Constants, fixed word lists and schemas of the dialogue data model.

Times are integer milliseconds everywhere.
"""

from pyspark.sql import types as T

# Dialogue thresholds (ms unless said otherwise).
SWITCH_GAP = 700
RESUME_WINDOW = 1500
PAUSE_THRESHOLD = 300
SILENCE_THRESHOLD = 1500
BC_MAX_DURATION = 1000
BC_MAX_TOKENS = 8
UTTERANCE_GAP = 1000

CHUNK_MS = 2000
SAMPLE_RATE = 16000
STREAMING_CONT = " ..."
IGNORE_INDEX = -100

# Special tokens, in the order they follow a tagged utterance where that matters.
SPECIAL_TOKENS = ["<ts>", "<te>", "<bc>", "<silence>", "<pause>"]
KIND_TOKEN = {
    "ts": "<ts>",
    "te": "<te>",
    "bc": "<bc>",
    "pause": "<pause>",
    "silence": "<silence>",
}
SPEAKERS = ["A", "B"]
PLACEHOLDER_IDS = {"<A>": -201, "<B>": -202, "<audio>": -203}
GENERATION_MARKS = ["<|im_end|>", "<|endoftext|>"]
NOISE_MARKS = ["●", "〓"]
FINAL_PUNCTUATION = ["。", "？", "！", "，", "、", "；", "："]

# Japanese turn-completion cues.
FINAL_SUFFIXES = [
    "です", "ます", "でした", "ました",
    "ですね", "ですよ", "ですよね", "だよね",
    "ですか", "ますか", "でしょうか",
    "と思います", "ということです",
    "わかりました", "そうです", "はい",
]
NONFINAL_SUFFIXES = [
    "で", "けど", "けども", "から", "ので",
    "が", "を", "に", "と", "は",
    "その", "あの", "えっと", "なんか",
]
SHORT_REPLIES = ["はい", "うん", "ええ", "そう", "そうです", "なるほど", "わかりました", "了解です"]
SHORT_REPLY_CHARS = 8

# Listener-response lexicon.
BC_LEXICON = [
    "うん", "うーん", "うんうん",
    "はい", "はいはい",
    "え", "ええ", "へえ",
    "あ", "ああ", "あー",
    "ほう", "ふーん",
    "そう", "そうそう",
    "なるほど", "そっか",
]
REPEATABLE = ["うん", "そう", "はい"]

LABELS = ["continuer", "assessment", "non_backchannel"]
DEFAULT_LABEL = "non_backchannel"
LABEL_SEARCH_ORDER = ["non_backchannel", "assessment", "continuer"]

# One aligned line of a channel file: the time triple mixes numbers and text, so it is read as
# strings and cast afterwards.
ALIGNED_LINE = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField(
                "content",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("type", T.StringType()),
                            T.StructField("audio", T.StringType()),
                            T.StructField("text", T.StringType()),
                            T.StructField(
                                "text_stream", T.ArrayType(T.ArrayType(T.StringType()))
                            ),
                            T.StructField("backchannel_label", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    )
)

UTTERANCE_RECORD = T.StructType(
    [
        T.StructField("speaker", T.StringType()),
        T.StructField("audio", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_turn_taking", T.BooleanType()),
        T.StructField("is_pause", T.BooleanType()),
        T.StructField("is_silence", T.BooleanType()),
        T.StructField("is_back_channel", T.BooleanType()),
        T.StructField("is_turn_ending", T.BooleanType()),
    ]
)

STREAM_EVENT = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)

# One line of a dialogue-record file: [user message, assistant message].
DIALOGUE_RECORD = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField(
                "content",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("type", T.StringType()),
                            T.StructField("utterances", T.ArrayType(UTTERANCE_RECORD)),
                            T.StructField("id", T.StringType()),
                            T.StructField("text_stream", T.ArrayType(STREAM_EVENT)),
                        ]
                    )
                ),
            ),
        ]
    )
)

SEGMENT = T.StructType(
    [
        T.StructField("audio_path", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)

EVAL_RESULT = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("turn_id", T.LongType()),
        T.StructField("rank", T.LongType()),
        T.StructField("pred", T.StringType()),
        T.StructField("ref", T.StringType()),
    ]
)
