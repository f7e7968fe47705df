"""Encoding texts with a public byte-level BPE vocabulary, by a finite-state transducer.

The encoding of a prefix of a text has exactly one last token, and a sequence of tokens
is the encoding of its text if and only if each two neighbours are the encoding of theirs.
The transducer therefore reads a pre-token byte by byte; its nondeterministic
configurations are (trie node of the bytes since a boundary, token that ends at this
boundary).  Sets of them are determinised when first met and kept, so that common text
costs one table look-up a byte.  Each step emits the last token of the prefix; the tokens
before the point where all live boundaries agree are final and leave the transducer,
which bounds its look-ahead by the longest token.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_DIRECTORY = "/opt/tokenizers"
#: Fixed value: how the vocabulary's byte-level pre-tokenizer splits a text.  White space is the Unicode property, not Python's wider \s.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
COMMIT = 256
STATES, WORDS = 100_000, 100_000


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes and merge ranks; ``merge`` is the plain algorithm that defines an encoding."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        else:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            letters = _byte_letters()
            own = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
            merged = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}
            self.ids = {bytes(letters[c] for c in t): i for t, i in own.items() if len(t) == 1 or t in merged}
        self.bytes = {i: t for t, i in self.ids.items()}

    def merge(self, text: bytes) -> list[int]:
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]


class Transducer:
    """The lazily determinised transducer of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in vocabulary.ids.items():
            node = 0
            for b in text:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.length = {i: len(t) for i, t in vocabulary.bytes.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {((0, -1),): 0}
        self.sets: list[tuple] = [((0, -1),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _neighbours(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * STATES:
                self.fits.clear()
            both = [b] if a < 0 else [a, b]
            known = self.fits[key] = self.v.merge(b"".join(self.v.bytes[x] for x in both)) == both
        return known

    def _determinise(self, state: int, byte: int) -> tuple[int, int]:
        live, last = [], -1
        for node, before in self.sets[state]:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            live.append((nxt, before))
            token = self.token[nxt]
            if last < 0 and token >= 0 and self._neighbours(before, token):
                last = token
        live.append((0, last))
        key = tuple(live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        self.moves[state][byte] = (to, last)
        return to, last

    def feed(self, text: bytes) -> Iterator[int]:
        """Token ids of one pre-token, streamed."""
        if len(self.sets) > STATES:
            self._forget()
        state, start, last = 0, 0, []
        moves = self.moves
        for at, byte in enumerate(text):
            step = moves[state].get(byte)
            state, token = step if step is not None else self._determinise(state, byte)
            last.append(token)
            if len(last) >= COMMIT and at % COMMIT == 0:
                done = self._agreed(state, last)
                yield from done
                cut = sum(map(self.length.__getitem__, done))
                last, start = last[cut:], start + cut
        yield from self._back(last, len(last))

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at - 1])
            at -= self.length[last[at - 1]]
        return out[::-1]

    def _agreed(self, state: int, last: list[int]) -> list[int]:
        """Tokens that the encodings up to all live boundaries begin with."""
        depth = self._depths()
        ways = [self._back(last, len(last) - depth[node]) for node, _ in self.sets[state] if depth[node] <= len(last)]
        shared = []
        for column in zip(*ways):
            if len(set(column)) > 1:
                break
            shared.append(column[0])
        return shared

    def _depths(self) -> list[int]:
        if not hasattr(self, "_depth"):
            self._depth = [0] * len(self.child)
            for node, kids in enumerate(self.child):
                for k in kids.values():
                    self._depth[k] = self._depth[node] + 1
        return self._depth


class Encoder:
    """Ids of whole texts; pre-tokens met before come from a bounded cache."""

    def __init__(self, path: str):
        self.transducer = Transducer(Vocabulary(path))
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for piece in self.find(text):
            ids = words.get(piece)
            if ids is None:
                ids = list(self.transducer.feed(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(words) >= WORDS:
                        words.clear()
                    words[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Utf8Stream:
    """Incremental UTF-8 decoding as a state machine: bytes in, characters out.

    The state is (continuation bytes still due, code point so far, range of the next
    byte).  A byte that does not fit gives U+FFFD for what was begun and is read anew.
    """

    def __init__(self) -> None:
        self.due, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.point, self.due, self.low, self.high = self.point << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.point = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.due, self.point = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        rest, self.due = "�" * bool(self.due), 0
        return rest


def decode(path: str, ids: Iterable[int]) -> Iterator[str]:
    """Text of a stream of ids, piece by piece; a piece may be empty while a character is incomplete."""
    stream, known = Utf8Stream(), vocabulary(path).bytes
    for i in ids:
        yield stream.feed(known[i])
    yield stream.end()


def encode_column(text: Column, path: str) -> Column:
    """``array<int>`` of token ids; the empty list for a null or empty text.

    Special tokens' strings in a text are ordinary text.  Whole texts of any length are
    encoded; equal texts have equal ids.
    """

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        run = encoder(path).encode
        return pd.Series([run(t) for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of token ids; an empty or null list gives the empty text."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        return pd.Series(["".join(decode(path, x)) if x is not None else "" for x in lists], dtype=object)

    return text(ids)


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document, one row a row; no shuffle."""
    return documents.select(documents["doc_id"], encode_column(documents["text"], path).alias("ids"))
