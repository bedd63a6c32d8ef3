"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of every prefix determines its whole encoding: the encoding of p ends in the
one token t for which the encoding of p without t ends in a token that stays apart from t.
The distinct words of a slice of texts, which Arrow finds, form a trie. It is held as its depth-first order, that
is the sorted words with the length each shares with the one before, and walked with a stack
of last tokens by depth: the state of a shared prefix is computed once for all its words, and
an encoding is read off the stack backwards.
"""

from __future__ import annotations

import json
import re
from array import array as pack
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named
from rowmend.llm.common import appended, slices
from rowmend.llm.pretokens import (
    bounded_pieces, character_classes, cut_words, gathered, json_file_matches, list_column, spread_out,
)

# Words whose encodings a task remembers; forgetting costs time only.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 300_000, 200_000
SLICE = 3 << 18
# Longer texts are encoded in parts.
LONG = 1 << 21
# Words of up to so many bytes lie in one matrix when merged together, and how many words do; longer ones are walked.
WIDTHS, MATRIX_WORDS = (4, 6, 8, 10, 12, 16, 24, 48), 1 << 13


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairRanks:
    """Ranks of pairs of ids, looked up for many pairs at once: an open hash table in arrays."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        ordered = sorted((rank, a, b, made) for (a, b), (rank, made) in merges.items())
        _, a, b, made = np.array(ordered, np.uint64).reshape(-1, 4).T
        self.none, self.made = len(ordered), made.astype(np.int32)
        # No id reaches the last entry, which stands for an empty place.
        self.keys = np.append(a << np.uint64(32) | b, np.uint64(2**64 - 1))
        self.bits = max(4, self.none.bit_length() + 2)
        self.table = np.full(1 << self.bits, self.none, np.int32)
        left, place = np.arange(self.none), self.places(self.keys[:-1])
        while len(left):
            free = left[self.table[place[left]] == self.none]
            self.table[place[free]] = free
            left = left[self.table[place[left]] != left]
            place[left] = self.after(place[left])

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, places: np.ndarray) -> np.ndarray:
        return places + 1 & (1 << self.bits) - 1

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` where it is not merged; a negative id is in no pair."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        place = self.places(keys)
        found = self.table[place]
        left = np.flatnonzero((self.keys[found] != keys) & (found != self.none))
        while len(left):
            place[left] = self.after(place[left])
            found[left] = self.table[place[left]]
            left = left[(self.keys[found[left]] != keys[left]) & (found[left] != self.none)]
        return found


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file, with its trie walk."""

    def __init__(self, definition: str, classes: np.ndarray | None = None):
        self.definition, self.classes = definition, classes

    @cached_property
    def spec(self) -> dict:
        spec = json.loads(self.definition)
        splitter = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        supported = (
            spec.get("normalizer") is None and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
            and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not supported:
            raise ValueError("only plain byte-level BPE tokenizers are supported")
        return spec

    def prepared(self) -> Bpe:
        """With all tables built, and the parsed file, several times their size, let go."""
        _ = (self.reachable, self.made_of, self.flat_pieces, self.special)
        self.__dict__.pop("spec", None)
        return self

    def merging(self) -> Bpe:
        """With the tables of `merged_words` built, and the parsed file let go; longer words build the walk's."""
        _ = self.pieces, self.single, self.ranks
        self.__dict__.pop("spec", None)
        return self

    @cached_property
    def pieces(self) -> list[bytes]:
        """Bytes of every token id."""
        letters = byte_letters()
        vocabulary = self.spec["model"]["vocab"]
        found = [b""] * (max([*vocabulary.values(), *(t["id"] for t in self.spec["added_tokens"])]) + 1)
        for text, number in vocabulary.items():
            found[number] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        for token in self.spec["added_tokens"]:
            found[token["id"]] = token["content"].encode()
        return found

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, merged)."""
        vocabulary = self.spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in self.spec["model"]["merges"])
        return {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}

    @cached_property
    def single(self) -> list[int]:
        vocabulary, letters = self.spec["model"]["vocab"], byte_letters()
        numbers = [0] * 256
        for letter, byte in letters.items():
            numbers[byte] = vocabulary[letter]
        return numbers

    def merged(self, text: bytes) -> list[int]:
        """Encoding by the merge rule itself; used to tell which tokens are reachable."""
        ids, merges = [self.single[b] for b in text], self.merges
        while len(ids) > 1:
            best = min((merges[p] for p in zip(ids, ids[1:]) if p in merges), default=None)
            if best is None:
                break
            out, at = [], 0
            while at < len(ids):
                if at + 1 < len(ids) and merges.get((ids[at], ids[at + 1])) == best:
                    out.append(best[1])
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    @cached_property
    def reachable(self) -> dict[bytes, int]:
        """Tokens that are the encoding of their own bytes, by bytes."""
        made = {pair_id for _, pair_id in self.merges.values()} | set(self.single)
        pieces = self.pieces
        return {pieces[t]: t for t in sorted(made) if self.merged(pieces[t]) == [t]}

    @cached_property
    def known_pairs(self) -> dict[int, bool]:
        return {}

    @cached_property
    def made_of(self) -> dict[int, tuple[int, int, int]]:
        """Merged token -> (rank, left, right)."""
        return {made: (rank, a, b) for (a, b), (rank, made) in self.merges.items()}

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay two tokens.

        Their merges are undone from the last one made. Across the border, a merge would have
        come first if its rank is below that of the undone one, or equal and further left.
        """
        left, right, made_of, known = a, b, self.made_of, self.known_pairs
        limit, stay = len(self.merges), True
        while True:
            across = self.merges.get((left, right))
            if across is not None and across[0] < limit:
                stay = False
                break
            one, two = made_of.get(left), made_of.get(right)
            if one is None and two is None:
                break
            if two is None or one is not None and one[0] > two[0]:
                limit, left = one[0], one[2]
            else:
                limit, right = two[0] + 1, two[1]
        if len(known) >= REMEMBERED_PAIRS:
            known.clear()
        known[a << 32 | b] = stay
        return stay

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of the words of a trie in depth-first order; `words` are sorted and not empty."""
        find, apart, seen = self.reachable.get, self.apart, self.known_pairs.get
        last, size, before = [-1], [0], b""
        for word in words:
            shared = len(commonprefix((word, before)))
            del last[shared + 1:], size[shared + 1:]
            for depth in range(shared + 1, len(word) + 1):
                at = depth
                while at:
                    at -= 1
                    token = find(word[at:depth])
                    if token is not None:
                        if not at:
                            break
                        fits = seen(last[at] << 32 | token)
                        if fits or fits is None and apart(last[at], token):
                            break
                last.append(token)
                size.append(depth - at)
            ids, depth = [], len(word)
            while depth:
                ids.append(last[depth])
                depth -= size[depth]
            ids.reverse()
            yield word, ids
            before = word

    @cached_property
    def ranks(self) -> PairRanks:
        return PairRanks(self.merges)

    def merged_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their merged ids) of a matrix with a word's bytes in each row, filled up with -1.

        In every round each row merges its pair of the lowest rank, the leftmost of equal ones,
        and so loses a column; rows without such a pair are done.
        """
        ranks, rows = self.ranks, np.arange(len(ids))
        rank = ranks.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            live = np.flatnonzero(best < ranks.none)
            if len(live) < len(rows):
                done = best == ranks.none
                yield rows[done], ids[done]
                rows, at, best = rows[live], at[live], best[live]
            if not len(live):
                return
            # All that is right of the pair moves one to the left.
            width = ids.shape[1]
            column = np.arange(width - 1)
            moved = column + (column > at[:, None])
            moved += live[:, None] * width
            ids = ids.ravel()[moved]
            every = np.arange(len(rows))
            ids[every, at] = ranks.made[best]
            if width == 2:
                break
            moved = moved[:, :-1]
            moved -= live[:, None]
            rank = rank.ravel()[moved]
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = ranks.of(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at)
            rank[left, at[left] - 1] = ranks.of(ids[left, at[left] - 1], ids[left, at[left]])
        yield rows, ids

    def merged_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end of each word in them) by the merge rule, on many words at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        single = np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for least, most in zip((0, *WIDTHS), WIDTHS):
            fitting = np.flatnonzero((size > least) & (size <= most))
            column = np.arange(most)
            for cut in range(0, len(fitting), MATRIX_WORDS):
                own = fitting[cut:cut + MATRIX_WORDS]
                place = np.minimum(start[own][:, None] + column, len(single) - 1)
                ids = np.where(column < size[own][:, None], single[place], np.int32(-1))
                parts += [(own[rows], merged) for rows, merged in self.merged_rows(ids)]
        long = np.flatnonzero(size > WIDTHS[-1]).tolist()
        for n, (_, ids) in zip(sorted(long, key=words.__getitem__), self.walk(sorted(words[n] for n in long))):
            parts.append((np.array([n]), np.array([ids], np.int32)))
        count = np.zeros(len(words), np.int64)
        for rows, ids in parts:
            count[rows] = (ids >= 0).sum(axis=1)
        ends = np.cumsum(count)
        flat = np.empty(int(count.sum()), np.int32)
        for rows, ids in parts:
            row, column = np.nonzero(ids >= 0)
            flat[(ends - count)[rows][row] + column] = ids[row, column]
        return flat, ends

    def merged_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like `plain`, for texts of which few words repeat: nothing is remembered."""
        words = cut_words(texts, self.classes)
        flat, ends = self.merged_words(words.distinct)
        count = np.diff(ends, prepend=0)
        return spread_out(flat, ends - count, count, words.index, words.ends)

    @cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self.spec["added_tokens"]}

    @cached_property
    def splitter(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @cached_property
    def words(self) -> dict[bytes, bytes]:
        """Ids of words met before."""
        return {}

    def learn(self, words: list[bytes]) -> None:
        for word, ids in self.walk(sorted(w for w in words if w not in self.words)):
            self.words[word] = pack("i", ids).tobytes()

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them) of texts without special tokens."""
        words = cut_words(texts, self.classes)
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        self.learn(words.distinct)
        return gathered([*map(self.words.__getitem__, words.distinct)], words.index, words.ends)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them)."""
        parts: list[str | int] = []
        owner: list[int] = []
        for n, text in enumerate(texts):
            split = self.splitter.split(text) if any(s in text for s in self.special) else [text]
            for m, piece in enumerate(split):
                own = [self.special[piece]] if m % 2 else bounded_pieces(piece, LONG)
                parts += own
                owner += [n] * len(own)
        found = []
        for some in slices((p for p in parts if isinstance(p, str)), LONG):
            found.append(self.plain(some))
        flat = np.concatenate([np.empty(0, np.int32), *(ids for ids, _ in found)])
        size = np.concatenate([np.empty(0, np.int64), *(np.diff(ends, prepend=0) for _, ends in found)])
        is_special = np.array([isinstance(p, int) for p in parts], bool)
        if is_special.any():
            before = np.concatenate([[0], np.cumsum(size)])[np.cumsum(~is_special)[is_special]]
            flat = np.insert(flat, before, [p for p in parts if isinstance(p, int)])
            whole = np.ones(len(parts), np.int64)
            whole[~is_special] = size
            size = whole
        count = np.zeros(len(texts), np.int64)
        np.add.at(count, np.array(owner, np.int64), size)
        return flat, np.cumsum(count)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        flat, ends = self.encoded(texts)
        return np.split(flat, ends[:-1]) if texts else []

    @cached_property
    def flat_pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all tokens, where each starts, its size); one empty token stands for unknown ids."""
        pieces = [*self.pieces, b""]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids of which each ends as given; unknown ids are skipped, broken UTF-8 becomes U+FFFD."""
        flat, start, size = self.flat_pieces
        known = np.where((ids < 0) | (ids >= len(size)), len(size) - 1, ids)
        data, places = spread_out(flat, start, size, known, ends)
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *places.tolist()], places.tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """Text of an array of ids."""
        return self.decoded(ids, np.array([len(ids)]))[0]


def load_bpe(path: str) -> Bpe:
    """Read a tokenizer file on the driver; its size is the vocabulary's, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return Bpe(file.read(), character_classes(json_file_matches))


def to_workers(spark: SparkSession, bpe: Bpe) -> Callable[[], Bpe]:
    """Ship the definition once per worker; tables and memory built there outlive the task."""
    shared = spark.sparkContext.broadcast({"definition": bpe.definition, "classes": bpe.classes})

    def own() -> Bpe:
        held = shared.value
        if "built" not in held:
            held["built"] = Bpe(held["definition"], held["classes"]).prepared()
        return held["built"]

    return own


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def encode_column(df: DataFrame, bpe: Bpe, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Append the token ids of a text column; null and empty texts have no ids.

    A column that already has the name of the result is replaced. Rows are otherwise kept as
    they are, repeated ones too; an empty table stays empty. Texts are encoded whole, some
    megabytes at a time.
    """
    built = to_workers(df.sparkSession, bpe)

    def work(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for texts in slices((t.as_py() for t in column), SLICE):
            yield len(texts), [list_column(*built().encoded(texts))]

    return appended(df, text_col, {ids_col: IDS}, work)


def decode_column(df: DataFrame, bpe: Bpe, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Append the text of a column of token ids; null ids give null, no ids the empty text.

    Ids outside the vocabulary and null ids in a list are skipped. A column that already has
    the name of the result is replaced.
    """
    built = to_workers(df.sparkSession, bpe)

    def work(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for ids in column:
            text = None if ids.as_py() is None else built().decode(ids.values.fill_null(-1).to_numpy(zero_copy_only=False))
            yield 1, [pa.array([text], pa.string())]

    return appended(df, ids_col, {text_col: TEXT}, work)


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`token_ids` and their `decoded` text beside the `keep` columns (all by default), in one pass.

    Null and empty texts have no ids and decode to the empty text.
    """
    built = to_workers(df.sparkSession, load_bpe(path))
    keep = df.columns if keep is None else keep
    rows = df.select(*[named(c) for c in keep if c != "__text"], named(text_col).alias("__text"))

    def work(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for texts in slices((t.as_py() for t in column), SLICE):
            ids, ends = built().encoded(texts)
            yield len(texts), [list_column(ids, ends), pa.array(built().decoded(ids, ends), pa.string())]

    return appended(rows, "__text", {"token_ids": IDS, "decoded": TEXT}, work)


def ids_digest(ids: str = "token_ids"):
    """SHA-256 of decimal ids joined by commas, in lower-case hex."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
