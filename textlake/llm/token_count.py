"""Token counts by a compiled finite-state transducer of a byte-pair tokenizer.

The merge table is compiled, on demand, into a deterministic transducer over bytes whose transitions carry
the number of tokens they emit. A chunk of text is a map over the transducer's states: a piece that is open at
the chunk's start goes on from whatever state it is in, all pieces after it begin in the start state, so any
entry state leads to the chunk's own exit state, and only what the open piece emits depends on it. Where a chunk
lies inside one piece, the map is that of its bytes; an entry state is followed until it meets the path from
the start state. Maps compose associatively, and a text's count is the prefix scan of its chunks' maps.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textlake.llm.runtime import drop_extra

#: Characters of one chunk; entries that the lazily filled tables hold before they start anew.
CHUNK = 1 << 16
#: Characters that are looked back for a place between pieces where a chunk may end.
LOOK_BACK = 64
WORDS_KEPT = 700_000
STATES_KEPT = 300_000

# The tokenizer's word pattern and its white space (that of its regular expressions)
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile(r"[\x1c-\x1f]")
#: Characters beyond those that this Python, its regular expressions and the tokenizer's library are known to treat
#: alike (tests compare all of them); texts that have any are normalised, and their words split, by the library.
RARE = re.compile(r"[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u2122]")
LETTER, NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
LAST = 256  # added to a byte that ends a word


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by their rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        letters[chr(256 + k)] = b
    return letters


class Transducer:
    """States are found when first reached. A state is what the tokenization of an open word can still depend
    on: the longest suffix that begins some token, and the last token and token count at each of its cuts.

    Of all tokens that end at a place exactly one can follow the token before it in the tokenizer's output
    (their joint text splits into just these two), so the last token at each place is known from the state.
    """

    def __init__(self, merges: list[tuple[str, str]], alphabet: dict[str, int]):
        self.ranks: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        ids: dict[str, int] = {}

        def token(text: str) -> int:
            if text not in ids:
                ids[text] = len(ids) + 1
                open_text = text.removesuffix("</w>")
                code = [alphabet[c] for c in open_text]
                if open_text != text:
                    code[-1] += LAST
                self.symbols[ids[text]] = tuple(code)
            return ids[text]

        for letter in alphabet:
            token(letter), token(letter + "</w>")
        # letters come first, then tokens in the order of their merges: a lower number is made earlier
        for a, b in merges:
            pair = (token(a), token(b))
            self.ranks[pair] = token(a + b)
            self.halves.setdefault(self.ranks[pair], pair)
        self._automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _automaton(self) -> None:
        """Suffix automaton of all tokens (goto, fail, depth) and the tokens that end at each node."""
        self.goto: list[dict[int, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.depth = [0]
        for t, code in self.symbols.items():
            at = 0
            for s in code:
                if s not in self.goto[at]:
                    self.goto[at][s] = len(self.goto)
                    self.goto.append({})
                    self.ends.append([])
                    self.depth.append(self.depth[at] + 1)
                at = self.goto[at][s]
            self.ends[at].append((t, len(code)))
        self.fail = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for at in queue:
            for s, to in self.goto[at].items():
                back = self.fail[at]
                while back and s not in self.goto[back]:
                    back = self.fail[back]
                self.fail[to] = self.goto[back].get(s, 0)
                queue.append(to)
            self.ends[at] += self.ends[self.fail[at]]

    def _forget(self) -> None:
        """A state is a dictionary from symbol to (next state, tokens emitted); its meaning is kept beside it."""
        self.start: dict = {None: (0, ((0, 0),))}
        self.known = {self.start[None]: self.start}

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart: undo their merges from the latest on; at no time may the
        two parts that touch have a merge that comes before those still undone."""
        limit = 1 << 60
        while True:
            if self.ranks.get((a, b), limit) < limit:
                return False
            if a > b and a in self.halves:
                limit, a = a, self.halves[a][1]
            elif b in self.halves:
                limit, b = b + 1, self.halves[b][0]
            elif a in self.halves:
                limit, a = a, self.halves[a][1]
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * STATES_KEPT:
                self.fits.clear()
            known = self.fits[a, b] = not a or self._apart(a, b)
        return known

    def move(self, state: dict, symbol: int) -> tuple[dict, int]:
        """(next state, tokens that this transition emits); a symbol with LAST closes the word."""
        node, lasts = state[None]
        while node and symbol not in self.goto[node]:
            node = self.fail[node]
        node = self.goto[node].get(symbol, 0)
        for token, n in self.ends[node]:
            if n <= len(lasts) and self.follows(lasts[-n][0], token):
                emitted = lasts[-n][1] + 1
                break
        if symbol >= LAST:
            step = (self.start, emitted)
        else:
            kept = (*[(t, n - emitted) for t, n in lasts], (token, 0))[-self.depth[node] - 1 :]
            to = self.known.get((node, kept))
            if to is None:
                to = self.known[node, kept] = {None: (node, kept)}
            step = (to, emitted)
        state[symbol] = step
        return step

    def walk(self, state: dict, code: bytes) -> tuple[dict, int]:
        """(state, tokens emitted) after ``code``, the piece staying open."""
        total = 0
        for symbol in code:
            state, emitted = state.get(symbol) or self.move(state, symbol)
            total += emitted
        return state, total

    def close(self, state: dict, code: bytes) -> int:
        """Tokens that ``code`` emits from ``state`` on when the piece ends with it."""
        state, total = self.walk(state, code[:-1])
        symbol = code[-1] | LAST
        return total + (state.get(symbol) or self.move(state, symbol))[1]

    def count(self, code: bytes) -> int:
        """Tokens of one piece: the sum of what its path through the transducer emits."""
        if len(self.known) > STATES_KEPT:
            self._forget()
        return self.close(self.start, code)


class Inside:
    """The map of a chunk inside one piece: the path of its bytes from the start state, which any other entry
    state is followed to until they meet."""

    def __init__(self, machine: Transducer, code: bytes):
        self.machine, self.code = machine, code
        state, self.states, self.sums = machine.start, [machine.start], [0]
        for symbol in code:
            state, emitted = state.get(symbol) or machine.move(state, symbol)
            self.states.append(state)
            self.sums.append(self.sums[-1] + emitted)

    def apply(self, state: dict) -> tuple[dict, int]:
        total = 0
        for i, symbol in enumerate(self.code):
            if state is self.states[i]:
                return self.states[-1], total + self.sums[-1] - self.sums[i]
            state, emitted = state.get(symbol) or self.machine.move(state, symbol)
            total += emitted
        return state, total


@dataclass
class Map:
    """What a stretch of text does to the transducer: a piece open at its start first passes ``inside``, then ends
    with ``head`` (None: it doesn't end here); the pieces that begin and end here emit ``count`` tokens; a piece
    that is open at the end has brought the transducer from its start into ``tail``."""

    inside: tuple[Inside, ...]
    head: bytes | None
    count: int
    tail: dict | None

    def enter(self, machine: Transducer, state: dict) -> tuple[dict | None, int]:
        """(exit state, or None where no piece is open; all tokens emitted) for an entry ``state``."""
        total = 0
        for part in self.inside:
            state, emitted = part.apply(state)
            total += emitted
        if self.head is None:
            return state, total
        return self.tail, total + self.count + (machine.close(state, self.head) if self.head else 0)


class Counter:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not a word-level byte-pair tokenizer")
        self.machine = Transducer([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]], byte_letters())
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.kinds: dict[str, str] = {}
        self.words: dict[str, int] = {}

    def pieces(self, word: str) -> list[str]:
        if RARE.search(word):
            return [word[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(word)]
        return PIECES.findall(word)

    def word(self, text: str) -> int:
        """Tokens of text without white space; a path taken before is remembered whole."""
        known = self.words.get(text)
        if known is None:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            pieces = [text] if text.isalpha() and text.isascii() else self.pieces(text)
            known = sum([self.machine.count(piece.encode()) for piece in pieces])
            if len(text) <= LOOK_BACK:
                self.words[text] = known
        return known

    def kind(self, char: str) -> str:
        """space, letter, number or other: a run of letters or of others is one piece."""
        known = self.kinds.get(char)
        if known is None:
            if RARE.match(char):
                beside = [span for _, span in self.splitter.pre_tokenize_str(f"a{char}a")]
                twice = self.splitter.pre_tokenize_str(char + char)
                known = "letter" if beside == [(0, 3)] else "space" if not twice else "number" if len(twice) == 2 else "other"
            else:
                known = "space" if SPACE.match(char) else "letter" if LETTER.match(char) else "number" if NUMBER.match(char) else "other"
            self.kinds[char] = known
        return known

    def apart(self, text: str, at: int) -> bool:
        """Whether a piece surely ends before ``text[at]``. Not after an apostrophe: it may lead a short ending."""
        a, b = self.kind(text[at - 1]), self.kind(text[at])
        return text[at - 1] != "'" and (a != b or a in ("space", "number"))

    def cuts(self, text: str) -> list[tuple[int, bool]]:
        """Ends of chunks, and whether a piece is open there: some characters before are all one run then."""
        out, at = [], CHUNK
        back = min(LOOK_BACK, CHUNK // 2)
        while at < len(text):
            near = next((i for i in range(at, at - back - 1, -1) if self.apart(text, i)), None)
            if near is None and back < 8:  # too short to tell a run from a short ending: on to the next sure place
                near = next((i for i in range(at, len(text)) if self.apart(text, i)), len(text))
            if near != len(text):
                out.append((at if near is None else near, near is None))
            at = (at if near is None else near) + CHUNK
        return [*out, (len(text), False)]

    def chunk_map(self, chunk: str, open_left: bool, open_right: bool, rare: bool = True) -> Map:
        head = 0
        if open_left:
            kind = self.kind(chunk[0])
            head = next((i for i, c in enumerate(chunk) if self.kind(c) != kind), len(chunk))
            if head == len(chunk) and open_right:
                return Map((Inside(self.machine, chunk.encode()),), None, 0, None)
        rest, tail, total = chunk[head:], None, 0
        if open_right:
            kind = self.kind(rest[-1])
            run = next((i + 1 for i in range(len(rest) - 1, -1, -1) if self.kind(rest[i]) != kind), 0)
            # what a run begins with may belong to the piece before it, so its word is split as a whole
            begin = next((i + 1 for i in range(run - 1, -1, -1) if self.kind(rest[i]) == "space"), 0)
            *closed, last = self.pieces(rest[begin:])
            tail, emitted = self.machine.walk(self.machine.start, last.encode())
            total = emitted + sum([self.machine.count(p.encode()) for p in closed])
            rest = rest[:begin]
        words = SPACE.split(rest) if rare or ODD_SPACE.search(rest) else rest.split()
        known, word = self.words, self.word
        total += sum([known[w] if w in known else word(w) for w in words if w])
        return Map((), chunk[:head].encode(), total, tail)

    def compose(self, a: Map, b: Map) -> Map:
        if a.head is None:
            return Map(a.inside + b.inside, b.head, b.count, b.tail)
        if a.tail is None:
            return Map(a.inside, a.head, a.count + b.count, b.tail)
        state, emitted = b.enter(self.machine, a.tail)
        return Map(a.inside, a.head, a.count + emitted, state)

    def _plain(self, text: str) -> int:
        rare = not text.isascii() and RARE.search(text) is not None
        if rare:
            text = self.normalizer.normalize_str(text)
        else:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()
        maps, at, open_left = [], 0, False
        for end, open_right in self.cuts(text):
            if end > at:
                maps.append(self.chunk_map(text[at:end], open_left, open_right, rare))
            at, open_left = end, open_right
        while len(maps) > 1:  # the scan's up-sweep: neighbours join, level by level
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].count if maps else 0

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, over whole texts.

    ``tokenizer_path``: a tokenizer file that is in place on every machine. No shuffle: each text is counted
    where it is read. Null text counts as empty: 0 bytes, 0 tokens. A text of any length is handled in chunks.
    Repeated rows: each counted. Empty table: no rows. Extra columns of any name are left alone. Tables of words and
    states are bounded, in number and in length of words, and start anew when full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(2).to_pylist()]
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), tokens, pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    d = drop_extra(docs, "doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
