"""A byte-level BPE vocabulary file: its pieces of text, its merges and how far a merge can reach.

The file is read on the driver and broadcast as it is (``MOST_BYTES`` at most); each Python worker
parses it once.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import islice

import regex

MOST_BYTES = 64_000_000
# Fixed value: how byte-level vocabularies of this kind cut text into pieces.
PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Over ASCII, Latin letters and common punctuation the same pieces come from plainer classes, which
# take less than half the time. A text with any other character (ODD) is cut by PIECE.
ODD = re.compile(r"[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u2010-\u2027]")
PLAIN_PIECE = re.compile(
    r" ?[a-zA-Z\u00c0-\u024f]+| ?[0-9]+|'(?:[sdmt]|re|ve|ll)"
    r"| ?[^\sa-zA-Z0-9\u00c0-\u024f]+|\s+(?!\S)|\s+"
)
# No piece goes on from a visible character into white space, so text may be cut there.
SAFE_CUT = regex.compile(r"\S(?=\s)")
STRETCH = 1 << 16
AT_ONCE = 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """ids: of the 256 bytes; merges: (left id, right id) to (rank, merged id)."""

    def __init__(self, content: bytes):
        model = json.loads(content)
        merges, vocabulary = model["model"]["merges"], model["model"]["vocab"]
        letters = byte_letters()
        to_byte = {letter: byte for byte, letter in enumerate(letters)}
        self.bytes_of = {
            i: bytes(map(to_byte.__getitem__, token)) for token, i in vocabulary.items()
        }
        self.ids = [vocabulary[letter] for letter in letters]
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.specials.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.special = (
            regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
            if self.specials
            else None
        )

    @functools.cached_property
    def lookahead(self) -> int | None:
        """Bytes after which no following text changes a token boundary; None: no such bound.

        Merges run by rank. Read a text and the same text with more behind it: their tokens agree
        up to a front that begins at the text's end. A merge (u, v) moves it only if u ends at the
        front, and then by the length of u. The token that starts at the new front begins, however
        it grows, with u; so the next merge that moves the front has a higher rank and a right part
        that has u on its left edge. The longest such chain, in bytes, bounds the way of the front.
        """
        formed: dict[int, int] = {}
        edge: dict[int, tuple[int, ...]] = {i: (i,) for i in self.ids}
        reach: dict[int, int] = {}
        for (left, right), (_, merged) in self.merges.items():
            if left not in edge or right not in edge or merged in formed or merged in edge:
                return None
            formed[merged] = left
            edge[merged] = (merged, *edge[left])
            way = len(self.bytes_of[left]) + max(reach.get(x, 0) for x in edge[right])
            reach[left] = max(reach.get(left, 0), way)
        return max([*reach.values(), *map(len, self.bytes_of.values()), 1])


@functools.lru_cache(maxsize=4)
def parsed(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return content


def stretches(text: str) -> Iterator[str]:
    """The text in parts that have the same pieces; one part where there is no white space."""
    start = 0
    while len(text) - start > STRETCH:
        cut = SAFE_CUT.search(text, start + STRETCH)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


def pieces(text: str) -> list[str]:
    return PIECE.findall(text) if ODD.search(text) else PLAIN_PIECE.findall(text)


def in_lists(stretch: str) -> Iterator[list[str]]:
    """The pieces of a stretch, some at a time if it is one that could not be cut."""
    if len(stretch) <= 2 * STRETCH:
        yield pieces(stretch)
        return
    found = (match[0] for match in PIECE.finditer(stretch))
    while part := list(islice(found, AT_ONCE)):
        yield part


def parts(text: str, vocabulary: Vocabulary) -> Iterator[list[str] | int]:
    """Lists of pieces, and the id of each special token that stands in the text."""
    start = 0
    for found in vocabulary.special.finditer(text) if vocabulary.special else ():
        for stretch in stretches(text[start : found.start()]):
            yield from in_lists(stretch)
        yield vocabulary.specials[found[0]]
        start = found.end()
    for stretch in stretches(text[start:] if start else text):
        yield from in_lists(stretch)


class Memo(dict):
    """What was worked out for short pieces, in two generations.

    A full generation becomes the old one and the former old one goes; a piece met again comes back
    from it. So pieces that are frequent stay, and no more than twice ``most`` are held.
    """

    def __init__(self, work, most: int = 200_000, longest: int = 40):
        self.work, self.most, self.longest, self.old = work, most, longest, {}

    def __missing__(self, piece: str):
        result = self.old.get(piece)
        if result is None:
            result = self.work(piece)
            if len(piece) > self.longest:
                return result
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = result
        return result

    def forget(self) -> None:
        """When a task ends: its worker may go on to others."""
        self.old = {}
        self.clear()
