"""Token counts with a public tokenizer, without keeping any token."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepath.llm.common import per_slice, utf8

# Pieces whose counts a worker remembers before it starts afresh, and the
# longest piece worth remembering.
MEMO_PIECES = 400_000
MEMO_BYTES = 64
# Pieces are handed to the tokenizer in batches of about so many bytes.
BATCH_BYTES = 256_000


def load_lengths(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts: tokenizers for .json, sentencepiece for .model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        return lambda texts: [
            len(found) for found in encoder.encode_batch(texts, add_special_tokens=False)
        ]
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(found) for found in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer library for {path}")


def in_batches(pieces: list[bytes], size: int = BATCH_BYTES) -> list[list[bytes]]:
    """Pieces of similar length together, each batch with about `size` bytes."""
    batches: list[list[bytes]] = []
    held = size
    for piece in sorted(pieces, key=len):
        if held + len(piece) > size:
            batches.append([])
            held = 0
        batches[-1].append(piece)
        held += len(piece)
    return batches


class PieceCounter:
    """Counts tokens of texts by their pieces between white space.

    White space is a safe boundary only for tokenizers that drop it and never
    join what it parts (`split=True`); others get the whole text at once.
    """

    def __init__(self, lengths: Callable[[list[str]], list[int]], split: bool):
        self.lengths, self.split = lengths, split
        self.memo: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        parts = [text.split() if self.split else [text] for text in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo = {}
        known = self.memo
        fresh = {piece for some in parts for piece in some if piece not in known}
        long = {}
        for batch in in_batches(list(fresh)):
            for piece, n in zip(batch, self.lengths([piece.decode() for piece in batch])):
                (known if self.split and len(piece) <= MEMO_BYTES else long)[piece] = n
        if not long:
            return [sum(map(known.__getitem__, some)) for some in parts]
        return [sum(long[p] if p in long else known[p] for p in some) for some in parts]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, split: bool = True
) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for every row of `docs`.

    Counts are those of the whole text: without begin, end or added special
    tokens, with special strings inside a text as the library takes them, and
    without truncation. Only lengths leave the tasks, and nothing is shuffled.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted
    each on its own; a null id stays null; other columns are left out. An empty
    table gives an empty result.
    """
    rows = docs.select("doc_id", "text")

    def work():
        count = PieceCounter(load_lengths(tokenizer_path), split)

        def step(batch: pa.RecordBatch) -> dict:
            texts = utf8(batch, 1)
            tokens = count(texts)
            return {
                "doc_id": batch.column(0),
                "n_bytes": [len(text) for text in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_slice(
        rows, "text", f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", work
    )
