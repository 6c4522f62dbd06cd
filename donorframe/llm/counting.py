"""Token counts of whole texts.

Method: overlap resynchronisation. A text longer than `chunk` characters is cut into chunks that overlap; the library
encodes each on its own and gives the offsets of its tokens. Two neighbouring chunks are spliced at the first stable
boundary at which a token of both begins: a single space between two characters that are neither white space nor the
model's space mark. No piece of the model holds its space mark after another character (checked when it is loaded), so no
token of the whole text crosses such a space, and what stands on either side is encoded the same in the chunks as in the
whole. Where neighbours have no such token in common the overlap is doubled, up to the rest of the text, so the count
always equals that of encoding the text in one go. Shorter texts are one chunk; their counts are sums over the parts
between stable boundaries, which a bounded cache keeps.

Defined cases: texts of any length count whole; a null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept as they are; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import PieceCounter, piece_counter, stable_boundaries
from .workspace import prepare

CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096


class Chunk:
    """text[a:b] encoded on its own: its number of tokens, and those before each stable boundary at which one begins."""

    def __init__(self, counter: PieceCounter, text: str, a: int, b: int):
        begins = counter.begins(text[a:b])
        self.size = len(begins)
        first = {p: i for i, p in reversed(list(enumerate(begins)))}  # several tokens of one character begin together
        self.before = {p: first[p - a] for p in stable_boundaries(text, a, b) if p - a in first}


def count_spliced(counter: PieceCounter, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text, from overlapping chunks."""
    n, total, a, skip = len(text), 0, 0, 0
    b = min(n, chunk + overlap)
    now = Chunk(counter, text, 0, b)
    while b < n:
        start = a + chunk
        following = Chunk(counter, text, start, min(n, start + chunk + overlap))
        common = next((p for p in following.before if p < b and p in now.before), None)
        if common is None:
            wider = max(2 * (b - start), overlap)
            b = min(n, start + wider)
            now = Chunk(counter, text, a, b)
            if b > start + chunk:  # wider than the later chunk: start that one further on
                chunk = b - a
            continue
        total += now.before[common] - skip
        skip = following.before[common]
        a, now, b = start, following, min(n, start + chunk + overlap)
    return total + now.size - skip


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token counts of documents (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [0 if not t else counter.count(t) if len(t) <= chunk else count_spliced(counter, t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
