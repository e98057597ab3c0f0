"""Language identification by compression (operator 7).

Each language gets a zstandard dictionary of raw text.  A text is encoded with every
dictionary, in independent pieces, and belongs to the language whose output is smallest over
all pieces.  If the runner-up is hardly larger, the decision is rejected.  A dictionary saves
about the same in every piece, so the margin of a long text does not fall with its length.

Fitting takes, per language, at most ``DOCS_PER_LANGUAGE`` texts (smallest hash of the id)
and at most ``DICTIONARY_BYTES`` bytes of them; scoring reads every text whole.  A text that
is null or has no letter is ``und`` with score 0 and rejected, as is every text if nothing
could be learned (an empty table too).  Ties go to the alphabetically first language.  Rows are independent, so
repeated rows and ids and null ids need no rule; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neartag.llm.common import slices

DOCS_PER_LANGUAGE = 64
DICTIONARY_BYTES = 64 * 1024
PIECE_BYTES = 32 * 1024  # a longer text is encoded in nearly equal pieces of at most so many bytes
LEVEL = 6
MARGIN = 0.005  # the runner-up must be larger by this share
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, learn_from: Column, docs_per_language: int = DOCS_PER_LANGUAGE,
        dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary text of each language, from rows (doc_id, text, lang) where ``learn_from`` holds.

    The rank filter runs before the shuffle too, so a language that most rows have sends
    few rows per task.  The driver gets the bounded sample only.
    """
    each = max(1, dictionary_bytes // 16)
    # A piece of each sampled text is enough for a dictionary; its middle avoids headings.
    piece = F.substring("text", F.greatest(F.lit(1), (F.length("text") - each) / 2).cast("int"), F.lit(each))
    rows = (docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"),
                    F.xxhash64("text").alias("t"), piece.alias("piece")))
    place = Window.partitionBy("lang").orderBy("h", "t")
    sample = rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= docs_per_language)
    texts: dict[str, list[bytes]] = {}
    for row in sample.select("lang", "rank", "piece").orderBy("lang", "rank").collect():
        texts.setdefault(row.lang, []).append(prepared(row.piece))
    model = {}
    for lang, parts in texts.items():
        # Equal texts of several documents teach nothing more.
        model[lang] = b" ".join(dict.fromkeys(parts))[:dictionary_bytes]
    return model


def prepared(text: str) -> bytes:
    """Case and line ends do not tell languages apart; the space lets the first word match."""
    return f" {text.lower()} ".replace("\n", " ").encode("utf-8", "surrogatepass")


def pieces_of(data: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """Nearly equal pieces of at most ``size`` bytes that together are the text."""
    n = max(1, -(-len(data) // size))
    return [data[len(data) * i // n:len(data) * (i + 1) // n] for i in range(n)]


class Compressors:
    """One compressor per language, in alphabetical order."""

    def __init__(self, model: tuple[tuple[str, bytes], ...], level: int) -> None:
        self.languages = [lang for lang, _ in model]
        self.compress = []
        for _, text in model:
            parameters = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            words = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=parameters)
            self.compress.append(zstandard.ZstdCompressor(dict_data=words, compression_params=parameters).compress)

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, score and margin: by how much the runner-up is larger."""
        if not self.languages or LETTER.search(text) is None:
            return UNKNOWN, 0.0, 0.0
        pieces = pieces_of(prepared(text))
        sizes = sorted((sum(len(f(piece)) for piece in pieces), lang) for f, lang in zip(self.compress, self.languages))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = sizes[1][0] / sizes[0][0] - 1
        return sizes[0][1], min(1.0, 0.5 + margin * 5), margin


@lru_cache(maxsize=2)
def compressors(model: tuple[tuple[str, bytes], ...], level: int) -> Compressors:
    return Compressors(model, level)


def predict(docs: DataFrame, model: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns to keep, lang_pred, score (0 to 1), rejected of every row.

    Only the text is judged.
    """
    fixed = tuple(sorted(model.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compressors(fixed, level)
        for batch in slices(batches):
            judged = [own.judge(t.as_py() or "") for t in batch["text"]]
            made = {"lang_pred": pa.array([x[0] for x in judged], pa.string()), "score": pa.array([x[1] for x in judged], pa.float64()),
                    "rejected": pa.array([x[0] == UNKNOWN or x[2] < margin for x in judged], pa.bool_())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{given}, lang_pred string, score double, rejected boolean")
