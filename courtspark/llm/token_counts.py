"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Counts kept per Python worker for pieces that come again; the store is emptied when full.
KEPT, KEPT_CHARS = 1_000_000, 40

SPACE = "▁"


def load_ranks(path: str) -> dict[str, int]:
    """Merge ranks of a byte-pair model: ordinary pieces by the negative of their score; lower merges first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return {model.id_to_piece(i): -int(model.get_score(i)) for i in ordinary}


def count_piece(piece: str, ranks: dict[str, int], alphabet: frozenset[str] = frozenset()) -> int:
    """Tokens of one piece: its initial symbols minus its merges.

    The symbols are the piece's characters in a linked list: a symbol is known by its start, ``end`` has where it
    ends and so where its right neighbour starts (0: merged away), ``left`` its left neighbour. A heap holds adjacent
    pairs whose concatenation is in the vocabulary, as one number of rank, start and end; the lowest rank, then the
    leftmost, is popped and merged, and pairs that no longer stand side by side are passed over. A symbol outside
    the vocabulary falls back to its UTF-8 bytes; a piece of ``alphabet`` (characters in the vocabulary) has none.
    """
    n = len(piece)
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    bits = n.bit_length()
    mask = (1 << bits) - 1
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [((r << bits | i) << bits) | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        pair = pop(heap)
        i, stop = pair >> bits & mask, pair & mask
        j = end[i]
        if not 0 < j < n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        merges += 1
        if stop < n:
            left[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                push(heap, ((r << bits | i) << bits) | end[stop])
        k = left[i]
        if k >= 0 and (r := get(piece[k:stop])) is not None:
            push(heap, ((r << bits | k) << bits) | stop)
    total = n - merges
    if alphabet.issuperset(piece):
        return total
    for i, stop in enumerate(end):
        if stop and (symbol := piece[i:stop]) not in ranks:
            total += len(symbol.encode()) - 1
    return total


@cache
def _counter(path: str) -> Callable[[str], int]:
    ranks = load_ranks(path)
    crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ranks)
    if crossing:
        raise ValueError("a piece of this vocabulary spans words; texts cannot be counted word by word")
    alphabet = frozenset(p for p in ranks if len(p) == 1)
    split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
    known: dict[str, int] = {}

    def count(text: str) -> int:
        if not text:
            return 0
        total = 0
        pieces = split(SPACE + text.replace(" ", SPACE))
        for piece, got in zip(pieces, map(known.get, pieces), strict=True):
            if got is None:
                got = count_piece(piece, ranks, alphabet)
                if len(piece) <= KEPT_CHARS:
                    if len(known) >= KEPT:
                        known.clear()
                    known[piece] = got
            total += got
        return total

    return count


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Whole texts are counted, without begin, end or added tokens. No piece of the vocabulary spans a word, so words
    are counted apart and each worker keeps the counts of words it has met; a text of any length is read once. A
    null or empty text has no tokens, and repeated rows are counted each; an empty table gives no rows; other columns
    of ``docs`` play no part. ``path`` is a model file that all executors have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            n = pa.array([count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the query's vocabulary."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


QUERIES = {"op5_token_counts": op5_token_counts}
SQL: dict[str, str] = {}
