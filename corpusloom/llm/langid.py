"""Language identification by compression.

Each language has a raw-content dictionary of training text. A text is compressed with every dictionary, and the
language whose dictionary makes it smallest is the prediction; a narrow margin marks the prediction as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import steps

#: Bounds of the training sample: bytes of all dictionaries together and of one at most, and characters of a passage.
ALL_BYTES, DICTIONARY_BYTES, PASSAGE = 1 << 25, 1 << 17, 400
LEVEL = 3
#: A prediction is rejected when the runner-up's size is within this share of the winner's.
MARGIN = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: A blank for every ASCII byte but the lower-case letters; bytes of other characters stay.
PROSE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def prose(text: str) -> bytes:
    """What is compressed: lower case, without ASCII digits and signs, words one blank apart."""
    return b" ".join(text.lower().encode().translate(PROSE).split())


def learn(docs: DataFrame, all_bytes: int = ALL_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary of each non-null lang in docs, from a bounded sample: the passages of the lowest hashes.

    Texts are cut into passages from beginning to end, so that every place of every text may be in the sample; ties of
    the hash follow the passage. The more languages, the smaller each dictionary, so that all stay within all_bytes.
    Languages without a letter in their sample are left out. An empty table teaches nothing.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"))
    langs = rows.select("lang").distinct().count()
    size = min(dictionary_bytes, all_bytes // max(1, langs))
    passages = rows.select("lang", "id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))).alias("at", "passage"))
    passages = passages.select("lang", "passage", F.xxhash64("id", "at").alias("hash"))
    # the limit is applied in every task before anything is shuffled
    first = passages.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "passage"))).where(F.col("k") <= size // PASSAGE + 1)
    held: dict[str, list[tuple[int, str]]] = {}
    for r in first.select("lang", "hash", "passage").toLocalIterator():
        held.setdefault(r["lang"], []).append((r["hash"], r["passage"]))
    made = {lang: prose("\n".join(t for _, t in sorted(taken, reverse=True)))[-size:] for lang, taken in held.items()}
    return {lang: x for lang, x in sorted(made.items()) if LETTER.search(x.decode(errors="ignore"))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs, from its whole text.

    lang_pred is `und` with score 0 and rejected set where text is null or has no letter, or nothing was learned.
    score is the runner-up's distance as a share of its size, 0 to 1 (1 with one language). Equal sizes go to the
    first language in order. Only doc_id and text are read, so other columns can't clash.
    """

    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        dictionaries = shared.value
        langs = sorted(dictionaries)
        packers = []
        for lang in langs:
            known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False))
        for batch in steps(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if not packers or text is None or not LETTER.search(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                data = prose(text)
                sizes = sorted((len(p.compress(data)), k) for k, p in enumerate(packers))
                best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else 0
                score = 1 - best / second if second else 1.0
                out.append((langs[sizes[0][1]], score, score < margin))
            pred, score, rejected = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
