"""Language identification by compression (operator 7).

For every language, excerpts of labelled documents form a raw-content
zstandard dictionary; case is folded.  A text is compressed with each dictionary and gets
the language whose result is smallest.  Long texts are compressed in pieces, each
with a fresh dictionary, so that the whole text is weighed and not only its
beginning.  The relative lead over the second-best language is the score; a
text whose lead is narrow is rejected.

Bounds of what is learned: at most DOCS_PER_LANGUAGE labelled documents a
language, EXCERPT characters of each, MAX_LANGUAGES languages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialsift.llm.common import in_parts, release_memory, table

DOCS_PER_LANGUAGE = 400
EXCERPT = 400
MAX_LANGUAGES = 256
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES = 4096
#: Matches from four bytes on, searched lazily: short texts and short words count.
CODER = {
    "window_log": 18,
    "chain_log": 17,
    "hash_log": 17,
    "search_log": 3,
    "min_match": 4,
    "target_length": 16,
    "strategy": zstandard.STRATEGY_LAZY,
}
#: Relative lead below which a text is rejected.
MARGIN = 0.002
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


def held_out(modulus: int, remainder: int):
    """Fold of a row by crc32 of its id as text; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """language -> dictionary content, the language of most documents first, from (doc_id, text, lang); rows without text, id or language teach nothing."""
    rows = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    span = F.greatest(F.char_length("text") - EXCERPT, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("doc_id", F.lit(7)), span) + 1
    excerpts = rows.select(
        "lang",
        "doc_id",
        F.xxhash64("text").alias("_print"),
        F.substring("text", begin.cast("int"), F.lit(EXCERPT)).alias("excerpt"),
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_print")
    taken = excerpts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= DOCS_PER_LANGUAGE)
    taken = taken.select("lang", "_rank", "excerpt")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1)
    names = [r[0] for r in sizes.collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    parts: dict[str, list[tuple[int, str]]] = {}
    for lang, rank, excerpt in taken.collect():  # at most MAX_LANGUAGES * DOCS_PER_LANGUAGE excerpts
        parts.setdefault(lang, []).append((rank, excerpt))
    whole = {lang: "\n".join(x.lower() for _, x in sorted(parts[lang])) for lang in names}
    return {lang: text.encode()[-DICTIONARY_BYTES:] for lang, text in whole.items()}


def classify(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected.

    A null text or one without letters is `und`, score 0, rejected.  Equal
    sizes go to the language with more labelled documents.  Without any learned
    language everything is `und`.
    """
    names = list(learned)
    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def guess(batches):
        coders = [_coder(learned[name]) for name in names]
        for batch in in_parts(batches):
            langs, scores, out = [], [], []
            for text in batch.column("text").to_pylist():
                if not names or text is None or not _LETTER.search(text):
                    langs.append(UNDETERMINED), scores.append(0.0), out.append(True)
                    continue
                raw = text.lower().encode()
                pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in coders])
                best = int(sizes.argmin())
                second = int(np.delete(sizes, best).min()) if len(sizes) > 1 else int(sizes[best])
                lead = 1.0 - sizes[best] / second if len(sizes) > 1 else 1.0
                langs.append(names[best]), scores.append(float(lead)), out.append(bool(lead < margin))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"],
            )
        coders.clear()
        release_memory()

    return docs.mapInArrow(guess, schema)


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **CODER)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=own)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=own)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the rows outside the held-out fold."""
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return dictionaries(known.select("doc_id", "text", "lang"))


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of `docs` whose language is clear, with their own columns."""
    learned = learn(docs)
    slim = docs.select(*docs.columns)
    found = classify(slim.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c != "text"}), learned, margin)
    return found.where("NOT rejected").select(*[F.col(c if c == "text" else f"in_{c}").alias(c) for c in docs.columns])


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")
