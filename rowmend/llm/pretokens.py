"""Where byte-level tokenizers cut texts into words, found for many texts at once.

The usual pattern of such vocabularies is local: whether a word starts at a character is told
by the classes of few characters around it. So a slice of texts is one array of code points, its
word starts are array comparisons, and the words are an Arrow array over the bytes of the slice
whose distinct values Arrow itself finds.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Regex, pre_tokenizers

# Fixed value: the pattern this module cuts by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, WHITE = range(4)
# A word start is settled by characters at most this far away.
REACH = 4


def rank_file_matches(pattern: str, text: str) -> str:
    """What the library for rank files finds of a pattern, joined."""
    single = {bytes([b]): b for b in range(256)}
    library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
    return bytes(library.encode_ordinary(text)).decode()


def json_file_matches(pattern: str, text: str) -> str:
    """What the library for JSON files finds of a pattern, joined."""
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return "".join(piece for piece, _ in split.pre_tokenize_str(text))


def character_classes(matches: Callable[[str, str], str]) -> np.ndarray:
    """Class of every character as a library sees it, whatever its Unicode version.

    Characters beyond the table are of class OTHER, as is its last entry.
    """
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    table = np.zeros(sys.maxunicode + 2, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = np.frombuffer(matches(pattern, every).encode("utf-32-le"), np.uint32)
        table[found] = kind
    return table[:np.flatnonzero(table)[-1] + 2]


def kinds(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[np.minimum(points, len(classes) - 1)]


def is_white(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return kinds(points, classes) == WHITE


def word_starts(points: np.ndarray, begins: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; `begins` and `ends` are those of the texts that are not empty."""
    kind = kinds(points, classes)
    start = np.ones(len(points), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    fresh = start & (kind != WHITE)
    fresh[begins] = False
    start[begins] = True
    # The last white character before another goes with it if it is a space, else stands alone.
    after = np.flatnonzero(fresh)
    after = after[kind[after - 1] == WHITE]
    start[after - 1] = True
    start[after[points[after - 1] == ord(" ")]] = False
    quote = np.flatnonzero((points == ord("'")) & start)
    if len(quote):
        end = ends[np.searchsorted(begins, quote, "right") - 1]
        last = len(points) - 1
        one = np.where(quote + 1 < end, points[np.minimum(quote + 1, last)], 0)
        two = np.where(quote + 2 < end, points[np.minimum(quote + 2, last)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        ending = short | long
        start[quote[ending] + 1] = False
        rest = (quote + 2 + long)[ending]
        start[rest[rest < end[ending]]] = True
    return start


@dataclass(frozen=True)
class Words:
    """Distinct words of a slice, the word at each place, and where each text's words end."""

    distinct: list[bytes]
    index: np.ndarray
    ends: np.ndarray


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def byte_places(points: np.ndarray) -> np.ndarray:
    """Byte offset of every code point in UTF-8, and of the end."""
    size = np.ones(len(points) + 1, np.int64)
    for least in (0x80, 0x800, 0x10000):
        size[1:] += points >= least
    size[0] = 0
    return np.cumsum(size)


def distinct_values(data: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct stretches of some bytes, and which of them each stretch is."""
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    encoded = column.dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy()


def starts_of(texts: list[str], classes: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts joined, their code points, where each text ends, word starts)."""
    joined = "".join(texts)
    points = code_points(joined)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = begins < ends
    return joined, points, ends, word_starts(points, begins[full], ends[full], classes)


def cut_words(texts: list[str], classes: np.ndarray) -> Words:
    """Cut some texts into words; they should be some megabytes together."""
    joined, points, ends, start = starts_of(texts, classes)
    places = np.flatnonzero(start)
    data = joined.encode()
    edges = np.append(places, len(points))
    if len(data) > len(points):
        edges = byte_places(points)[edges]
    distinct, index = distinct_values(data, edges)
    return Words(distinct, index, np.searchsorted(places, ends))


def gathered(parts: list[bytes], index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts at `index` one after another, and the end of each text in that; parts are bytes of 32-bit ids."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    flat = np.frombuffer(b"".join(parts), np.int32)
    return spread_out(flat, np.cumsum(size) - size, size, index, ends)


def spread_out(flat: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray,
               ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like `gathered` for parts that lie in one array already."""
    sizes = size[index]
    after = np.cumsum(sizes)
    place = np.repeat(start[index] - after + sizes, sizes)
    place += np.arange(len(place))
    return flat[place], np.concatenate([[0], after])[ends]


def list_column(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of lists that end at the given places of one array."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def bounded_pieces(text: str, limit: int) -> list[str]:
    """Consecutive parts of a text, cut where a word surely starts and not much longer than `limit` if that can be."""
    parts, at = [], 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        # A lone space between two others starts a word, wherever it stands.
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]
