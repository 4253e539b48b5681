"""Table shapes and the small fixed dimensions (languages, pairs, speech models)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

UNKNOWN_SPEAKER = "unknown"
MICROPHONE = "microphone"
SYSTEM_AUDIO = "systemAudio"

#: Newest document version this engine reads.
SCHEMA_VERSION = 1

WORD = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
    ]
)

SPAN_FILE = T.StructType(
    [
        T.StructField(
            "texts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", T.StringType()),
                        T.StructField("start", T.DoubleType()),
                        T.StructField("end", T.DoubleType()),
                        T.StructField("speaker", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

EXPORT_FILE = T.StructType(
    [
        T.StructField("degraded", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("fastTranscribed", T.BooleanType()),
        T.StructField("importedAt", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField(
            "speakers",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("named", T.BooleanType()),
                        T.StructField("side", T.StringType()),
                        T.StructField("totalDuration", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("title", T.StringType()),
        T.StructField(
            "transcript",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("end", T.DoubleType()),
                        T.StructField("isEdited", T.BooleanType()),
                        T.StructField("speaker", T.StringType()),
                        T.StructField("speakerId", T.StringType()),
                        T.StructField("start", T.DoubleType()),
                        T.StructField("text", T.StringType()),
                        T.StructField("translatedText", T.StringType()),
                        T.StructField("words", T.ArrayType(WORD)),
                    ]
                )
            ),
        ),
        T.StructField(
            "translation",
            T.StructType(
                [
                    T.StructField("from", T.StringType()),
                    T.StructField("to", T.StringType()),
                    T.StructField("translatedAt", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "trimmedTo",
            T.StructType(
                [T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]
            ),
        ),
    ]
)

# Language, display name, code, home region, default model.
LANGUAGES = [
    ("english", "English", "en", "US", "apple-speech"),
    ("swedish", "Swedish", "sv", "SE", "kb-whisper-large"),
    ("danish", "Danish", "da", "DK", "whisper-large-v3"),
    ("dutch", "Dutch", "nl", "NL", "whisper-large-v3"),
    ("polish", "Polish", "pl", "PL", "whisper-large-v3"),
    ("german", "German", "de", "DE", "apple-speech"),
    ("spanish", "Spanish", "es", "ES", "apple-speech"),
    ("french", "French", "fr", "FR", "apple-speech"),
    ("italian", "Italian", "it", "IT", "apple-speech"),
    ("portuguese", "Portuguese", "pt", "PT", "apple-speech"),
]
DEFAULT_LANGUAGE = "swedish"

# Directions in which no translation exists.
REFUSED_PAIRS = [
    ("swedish", "polish"),
    ("polish", "swedish"),
    ("danish", "polish"),
    ("polish", "danish"),
]

# Model, minutes of work per hour of audio, whether it is a download.
MODELS = [
    ("apple-speech", 1.0, False),
    ("whisper-large-v3", 9.0, True),
    ("kb-whisper-small", 2.0, False),
    ("kb-whisper-large", 9.0, True),
    ("pianissimo-sv", 0.5, True),
    ("roest-whisper", 9.0, False),
]
# Fixed value: the model every transcription needs.
ALWAYS_NEEDED_MODEL = "diarization"

# Second choice offered beside the default model.
SECOND_CHOICE = {
    "apple-speech": "whisper-large-v3",
    "kb-whisper-large": "pianissimo-sv",
}


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(LANGUAGES)]
    return spark.createDataFrame(
        rows,
        "ord int, language string, display_name string, code string, "
        "home_region string, default_model string",
    )


def language_pairs(spark: SparkSession) -> DataFrame:
    """All ordered pairs of different languages (90 rows) with their availability."""
    rows = [
        (source[0], target[0], order, (source[0], target[0]) not in REFUSED_PAIRS)
        for source in LANGUAGES
        for order, target in enumerate(LANGUAGES)
        if source != target
    ]
    return spark.createDataFrame(
        rows, "source string, target string, target_ord int, available boolean"
    )


def model_choices(spark: SparkSession) -> DataFrame:
    """Models offered per language, the default first (16 rows)."""
    rows = []
    for language, _, _, _, default in LANGUAGES:
        offered = [default] + [m for d, m in SECOND_CHOICE.items() if d == default]
        rows += [(language, position, model) for position, model in enumerate(offered)]
    return spark.createDataFrame(rows, "language string, choice_pos int, model string")


def model_support(spark: SparkSession) -> DataFrame:
    """Every model against every language (60 rows)."""
    swedish_only = {"kb-whisper-small", "kb-whisper-large", "pianissimo-sv"}
    rows = []
    for model, minutes, download in MODELS:
        for language, _, _, _, default in LANGUAGES:
            supported = (
                model == "whisper-large-v3"
                or (model == "apple-speech" and default == "apple-speech")
                or (model in swedish_only and language == "swedish")
            )
            rows.append((model, language, supported, minutes, download))
    return spark.createDataFrame(
        rows,
        "model string, language string, supported boolean, "
        "minutes_per_hour double, is_download boolean",
    )
