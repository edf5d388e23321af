"""Language ID by compression (operator 4).

Per language a zstandard raw-content dictionary is cut from a bounded sample of
labelled rows.  A text is normalised, split into blocks, and every block is
encoded on its own with each language's dictionary, so that the evidence of a
long text does not fade as the encoder learns the text itself.  Short texts are
encoded in several rotations of their words.  The language with the smallest
total wins; a narrow margin to the second is a rejection.

Defined results: null text, or text without a letter -> ``und``, score 0,
rejected.  No labelled row at all -> ``und`` for every row.  One language only
-> that language with score 1.  Equal sizes -> the language with more labelled
texts, score 0, rejected.  Repeated rows are judged one by one, each alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_arrow_batches

#: Bounds of the training sample: passages per language and their length.
PASSAGES = 600
PASSAGE_CHARS = 400
BLOCK_CHARS = 3000
#: Encoder settings: matches from three bytes on, a window that holds a whole
#: dictionary (2^18 bytes) beside the block.
ENCODER = {"compression_level": 6, "min_match": 3, "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4}
#: Below this length a text is encoded in this many rotations of its words, as
#: whole bytes are too coarse a measure for one encoding of a short text.
SHORT_CHARS, ROTATIONS = 400, 8
#: Relative difference of the two smallest encodings below which a row is rejected.
MIN_MARGIN = 0.005
UND = "und"
RESULT = "lang_pred string, score double, second string, rejected boolean"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> str:
    """Lower case, everything but letters one blank; empty without a letter."""
    if not text:
        return ""
    t = _NO_LETTERS.sub(" ", text.lower()).strip()
    return t if any(map(str.isalpha, t)) else ""


def fit(
    docs: DataFrame,
    trainable,
    text_col: str = "text",
    lang_col: str = "lang",
    passages: int = PASSAGES,
    passage_chars: int = PASSAGE_CHARS,
) -> dict[str, bytes]:
    """Raw-content dictionaries from the rows where ``trainable`` holds, the
    language with the most distinct texts first.

    Of each language, the ``passages`` distinct texts with the smallest hashes
    give one passage each, at a place that the hash chooses.  What reaches the
    driver is bounded: languages x passages x passage_chars.
    """
    rows = docs.filter(trainable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")
    )
    order = Window.partitionBy("lang").orderBy("h")
    texts = rows.select("lang", "h").distinct()
    chosen = texts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= passages)
    last = [(r["lang"], r["h"]) for r in chosen.groupBy("lang").agg(F.max("h").alias("h")).collect()]
    seen = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not last:
        return {}
    take = F.lit(False)
    for lang, h in last:
        take = take | ((F.col("lang") == lang) & (F.col("h") <= h))
    start = F.pmod(F.col("h"), F.greatest(F.char_length("t") - passage_chars + 1, F.lit(1))).cast("int") + 1
    found = rows.filter(take).select("lang", "h", F.substring(F.col("t"), start, F.lit(passage_chars)).alias("p")).groupBy("lang", "h").agg(F.min("p").alias("p"))
    parts: dict[str, list[str]] = {}
    for r in found.orderBy("lang", "h").collect():
        parts.setdefault(r["lang"], []).append(normalise(r["p"]))
    return {k: " ".join(parts[k]).encode() for k in sorted(parts, key=lambda k: (-seen[k], k))}


def encoders(dictionaries: dict[str, bytes]) -> list[tuple[str, object]]:
    import zstandard as zs

    out = []
    for lang, raw in dictionaries.items():
        d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        params = zs.ZstdCompressionParameters(
            strategy=zs.STRATEGY_LAZY, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **ENCODER
        )
        d.precompute_compress(compression_params=params)
        out.append((lang, zs.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def classify_text(text: str | None, coders: list, min_margin: float, block: int = BLOCK_CHARS) -> tuple[str, float, str | None, bool]:
    t = normalise(text)
    if not t or not coders:
        return UND, 0.0, None, True
    if len(t) < SHORT_CHARS:
        w = t.split()
        parts = [" ".join(w[i:] + w[:i]) for i in sorted({k * len(w) // ROTATIONS for k in range(ROTATIONS)})]
    else:
        parts = [t[i : i + block] for i in range(0, len(t), block)]
    blocks = [p.encode() for p in parts]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), rank, lang) for rank, (lang, c) in enumerate(coders))
    if len(sizes) == 1:
        return sizes[0][2], 1.0, None, False
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][2], margin, sizes[1][2], margin < min_margin


def detect(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", out: str = "lid", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` and one struct column ``out``: lang_pred, score (the margin, 0 to
    1), second, rejected.  Only the text is looked at, whole."""
    limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = encoders(shared.value)
        for texts in batches:
            yield pd.DataFrame([classify_text(t, coders, min_margin) for t in texts], columns=["lang_pred", "score", "second", "rejected"])

    return docs.withColumn(out, judge(F.col(text_col)))


def in_training(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


def filter_languages(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is told with a sufficient margin; columns as given."""
    import uuid

    out = f"lid_{uuid.uuid4().hex}"
    return detect(docs, dictionaries, out=out, min_margin=min_margin).filter(~F.col(f"{out}.rejected")).drop(out)
