"""BPE encoding and decoding as streams.

Encoding is a transducer with bounded lookahead. The merge list gives the bytes after which nothing
that follows can change a token boundary (``Vocabulary.lookahead``); a piece is read through a window
little longer than that, the tokens that lie far enough from the window's end are final and leave at
once, and the rest stays for the next window. Short pieces, which come again and again, are remembered (up
to twice the memo's size). Ids leave in runs of at most a stretch of text (64 Ki characters) or 4,096 of a
long piece. Decoding walks a byte-to-text state machine over the tokens' bytes: bytes of an unfinished
character stay in it, and bytes that can start none become U+FFFD. The digests take both streams as they
come, so beyond the text itself the state has a fixed size, however long the text or a piece of it.

NULL text is encoded as empty: 0 tokens, empty ids, empty decoded text. Rows are independent, so
repeated rows give repeated results and an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.byte_bpe import AT_ONCE, Memo, Vocabulary, parsed, parts, read_vocabulary
from weekpulse.llm.tables import by_batch

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>, decoded string"
LONG_PIECE = 4096
NO_MERGE = (1 << 60, 0)


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """All merges by rank, leftmost first, over a short run of symbols; changes the list."""
    found = [merges.get(pair, NO_MERGE) for pair in zip(symbols, symbols[1:])]
    while found:
        best = min(found)
        if best is NO_MERGE:
            break
        at = found.index(best)
        symbols[at] = new = best[1]
        del symbols[at + 1], found[at]
        if at < len(found):
            found[at] = merges.get((new, symbols[at + 1]), NO_MERGE)
        if at:
            found[at - 1] = merges.get((symbols[at - 1], new), NO_MERGE)
    return symbols


def transduce(piece: bytes, vocabulary: Vocabulary, window: int | None = None) -> Iterator[int]:
    """The ids of a piece; no more than ``window`` bytes of it are held at a time."""
    ids, merges, lookahead = vocabulary.ids, vocabulary.merges, vocabulary.lookahead
    if lookahead is None:
        yield from merged([ids[b] for b in piece], merges)
        return
    window = max(window or 0, 2 * lookahead)
    start = 0
    while True:
        tokens = merged([ids[b] for b in piece[start : start + window]], merges)
        if start + window >= len(piece):
            yield from tokens
            return
        final = start + window - lookahead
        for token in tokens:
            end = start + len(vocabulary.bytes_of[token])
            if end > final:
                break
            yield token
            start = end


def packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


@functools.lru_cache(maxsize=4)
def encoder(content: bytes) -> Memo:
    vocabulary = parsed(content)
    return Memo(lambda piece: packed(transduce(piece.encode(), vocabulary)))


def encoded(text: str, content: bytes) -> Iterator[bytes]:
    """The ids, 32 bits each, as they become final: those of a stretch of text, or ``AT_ONCE`` of a long piece."""
    vocabulary, ids = parsed(content), encoder(content)
    for part in parts(text, vocabulary):
        if isinstance(part, int):
            yield packed([part])
        elif max(map(len, part), default=0) <= LONG_PIECE:
            yield b"".join(map(ids.__getitem__, part))
        else:
            for piece in part:
                if len(piece) <= LONG_PIECE:
                    yield ids[piece]
                    continue
                stream = transduce(piece.encode(), vocabulary)
                while some := packed(islice(stream, AT_ONCE)):
                    yield some


def decoded(ids: Iterable[bytes], vocabulary: Vocabulary) -> Iterator[str]:
    """The text in parts, as soon as their characters are complete."""
    machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
    of = vocabulary.bytes_of.__getitem__
    for some in ids:
        yield machine.decode(b"".join(map(of, unpacked(some))))
    yield machine.decode(b"", final=True)


def unpacked(ids: bytes) -> array:
    return array("i", ids)


def encode(text: str, content: bytes) -> Iterator[int]:
    for some in encoded(text, content):
        yield from unpacked(some)


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> Iterator[str]:
    ids = iter(ids)
    yield from decoded(iter(lambda: packed(islice(ids, AT_ONCE)), b""), vocabulary)


@functools.lru_cache(maxsize=4)
def as_text(content: bytes) -> dict[int, str]:
    return {i: str(i) for i in parsed(content).bytes_of}


def digested(text: str, content: bytes) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and of the decoded text; neither is ever held as a whole."""
    vocabulary, text_of = parsed(content), as_text(content).__getitem__
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def passing() -> Iterator[bytes]:
        nonlocal n
        for some in encoded(text, content):
            if some:
                listed = ",".join(map(text_of, unpacked(some)))
                of_ids.update((f",{listed}" if n else listed).encode())
                n += len(some) // 4
                yield some

    for part in decoded(passing(), vocabulary):
        of_text.update(part.encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def bpe_codec(
    docs: DataFrame, vocabulary_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each text's ids and the text decoded from them, or their number and digests."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = [], []
        for text in batch.column(1):
            some = list(encoded(text.as_py(), content.value))
            ids.append(unpacked(b"".join(some)))
            texts.append("".join(decoded(some, parsed(content.value))))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
            ["doc_id", "ids", "decoded"],
        )

    def shortened(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [digested(text.as_py(), content.value) for text in batch.column(1)]
        columns = [pa.array(c, t) for c, t in zip(zip(*digests), (pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")))
    forget = lambda: encoder(content.value).forget()
    return by_batch(rows, shortened if digests else both, DIGESTS if digests else IDS, at_end=forget)
