"""Token counts: whole texts encoded in Arrow batches of even bytes, of which only lengths come back.

Rows: every document once per input row. A null text is empty and has 0 tokens. Repeated rows
stay. Other columns are ignored. Long texts are cut where no piece of the vocabulary can span the
cut, so that the counts of the parts add up to the count of the whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from grantlens.llm.batches import id_and_text, map_slices

# Texts longer than this are cut into parts of about this many characters.
PART_CHARS = 8_192

# Bytes handed to the tokenizer in one call.
CALL_BYTES = 500_000

# A single space after something that is no space, with more text behind it. The space becomes the
# dummy prefix that the tokenizer puts before a text, so that the part reads as it did in the whole.
_CUT = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL)


@lru_cache(maxsize=2)
def _processor(model_file: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return processor, _cuts_are_safe(processor)


def _cuts_are_safe(processor) -> bool:
    """Whether parts add up: a text gets a dummy prefix, no space is dropped, no piece has a space inside."""
    spanning = re.compile("[^▁]▁")
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(spanning.search(piece) for piece in pieces):
        return False
    probe = processor.encode(["a b", "a", "b", " a", "a  b", " b"])
    n = [len(ids) for ids in probe]
    return probe[0] == probe[1] + probe[2] and n[4] == n[1] + n[5] and probe[3] != probe[1]


def cut_text(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """Cut a long text at safe boundaries into parts of ``part_chars`` or a little more."""
    parts = []
    start = 0
    while len(text) - start > part_chars:
        cut = _CUT.search(text, start + part_chars)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def _calls(parts: list[str]):
    """Lists of parts with even bytes, short of ``CALL_BYTES`` unless one part is longer."""
    call: list[str] = []
    size = 0
    for part in parts:
        n_bytes = len(part.encode())
        if call and size + n_bytes > CALL_BYTES:
            yield call
            call, size = [], 0
        call.append(part)
        size += n_bytes
    if call:
        yield call


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens passes ``limit``, for every document."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        processor, safe = _processor(model_file)
        parts: list[str] = []
        owner: list[int] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            cut = cut_text(text) if safe and len(text) > PART_CHARS else [text]
            parts.extend(cut)
            owner.extend([row] * len(cut))
        tokens = [0] * batch.num_rows
        done = 0
        for call in _calls(parts):
            for ids in processor.encode(call, num_threads=1):
                tokens[owner[done]] += len(ids)
                done += 1
        n_tokens = pa.array(tokens, pa.int64())
        n_bytes = pc.binary_length(batch.column("text").cast(pa.large_binary())).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return map_slices(id_and_text(docs), count, schema)
