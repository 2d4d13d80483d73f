"""Token counts by compiled finite-state transducers.

A tokenizer file (byte pairs with word ends, as the ``tokenizers`` library writes
it) is compiled to two deterministic machines:

* :class:`Words` reads classes of characters and marks where words begin, as the
  file's split pattern matches them. It has seven states, so a chunk of text is a
  map of seven states to seven. Chunk maps compose in a parallel prefix scan,
  which gives every chunk its true entry state.
* :class:`Pairs` reads the bytes of words and annotates each transition with the
  number of tokens by which the encoding of the word so far grows (it may shrink:
  a byte can join earlier tokens). Its states are built when they are first met:
  a state holds, for every suffix of the word that begins a token, the place of
  that suffix in the tree of tokens, the last token before it and the tokens since.
  Of all tokens that end at a byte exactly one goes with the last token before
  it, that is, no merge crosses the seam of the two; it ends the encoding there.
  Chunks run side by side from the start state. The scan then hands each chunk its
  true entry; a chunk is run again from it only until its state is what it was
  from the start state, which is the end of the first word at the latest. Chunks
  inside one very long word may not meet their old states: these are run in order.

A batch of documents is one sequence to both machines; a document's count is a
difference of two running sums.

Edge cases: a null or empty text has no tokens; texts of any length are read
whole; repeated rows repeat their results; an empty table gives an empty result;
a null ``doc_id`` stays null; extra columns pass through :func:`token_counts`
whatever their names. Control strings of the file inside a text are one token
each, as the library takes them by default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pactlake.llm.common import byte_letters, fresh

#: The split pattern that :class:`Words` is the automaton of: the fixed value of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _NUMBER, _OTHER, _QUOTE, _LETTER, _ENDS, _R, _V, _L, _E = range(10)  # classes of characters
_OPEN, _IN_LETTERS, _IN_OTHER, _QUOTED, _QUOTED_R, _QUOTED_V, _QUOTED_L = range(7)  # states
_BEFORE, _EARLIER = 1, 2  # a word begins before this character; one began before the character before
_BATCH = 1 << 20  # characters of a batch
_STATES = 1 << 18  # states of pairs that are kept from batch to batch
_PADDING = 1023  # no symbol
_SPREAD = 0x9E3779B97F4A7C15  # odd, near 2**64 over the golden ratio


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """``next[state, class]`` and ``marks[state, class]`` of the split pattern."""
    letters = {_LETTER, _ENDS, _R, _V, _L, _E}
    to, marks = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    begins = {_SPACE: _OPEN, _NUMBER: _OPEN, _OTHER: _IN_OTHER, _QUOTE: _QUOTED} | {c: _IN_LETTERS for c in letters}
    for c in range(10):
        new = 0 if c == _SPACE else _BEFORE
        for state in range(7):
            to[state, c], marks[state, c] = begins[c], new
        if c in letters:
            to[_IN_LETTERS, c], marks[_IN_LETTERS, c] = _IN_LETTERS, 0
        if c in (_OTHER, _QUOTE):
            for state in (_IN_OTHER, _QUOTED):
                to[state, c], marks[state, c] = _IN_OTHER, 0
        # A quote with its letter so far: unless the ending is completed, the letter was a word's first.
        for state in (_QUOTED_R, _QUOTED_V, _QUOTED_L):
            to[state, c], marks[state, c] = to[_IN_LETTERS, c], marks[_IN_LETTERS, c] | _EARLIER
    for c, state in ((_ENDS, _OPEN), (_R, _QUOTED_R), (_V, _QUOTED_V), (_L, _QUOTED_L)):
        to[_QUOTED, c], marks[_QUOTED, c] = state, 0
    for state, c in ((_QUOTED_R, _E), (_QUOTED_V, _E), (_QUOTED_L, _L)):
        to[state, c], marks[state, c] = _OPEN, 0
    return to, marks


class Words:
    """Marks the first character of every word of the split pattern."""

    def __init__(self, splitter):
        self._splitter = splitter
        self._class = np.full(0x110000, 255, np.uint8)  # of a code point, when it has been met
        for chars, kind in (("'", _QUOTE), ("stmd", _ENDS), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
            self._class[[ord(c) for c in chars]] = kind
        self._to, self._marks = _split_tables()

    def _ask(self, char: str) -> int:
        """The class of a character, as the library's own splitter treats it."""
        pieces = [piece for piece, _ in self._splitter.pre_tokenize_str(f"a{char}{char}")]
        if len(pieces) == 1:
            return _SPACE if len(pieces[0]) == 1 else _LETTER
        return _NUMBER if len(pieces) == 3 else _OTHER

    def classes(self, codes: np.ndarray) -> np.ndarray:
        found = self._class[codes]
        if found.max(initial=0) == 255:
            for code in np.unique(codes[found == 255]).tolist():
                self._class[code] = self._ask(chr(code))
            found = self._class[codes]
        return found

    def begins(self, classes: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Whether each character is the first of a word. The last class must be a space."""
        width = -(-len(classes) // chunk)
        padded = np.full(width * chunk, _SPACE, np.uint8)
        padded[: len(classes)] = classes
        lanes = np.ascontiguousarray(padded.reshape(width, chunk).T)
        # Every chunk's map of states, one row an entry state.
        maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], width, axis=1)
        flat = self._to.ravel()
        for step in lanes:
            maps = flat[maps * np.uint8(10) + step]
        # Inclusive scan by doubling: composition of a chunk's map with those before it.
        far = 1
        while far < width:
            later = np.take_along_axis(maps[:, far:], maps[:, :-far].astype(np.intp), axis=0)
            maps = np.concatenate([maps[:, :far], later], axis=1)
            far *= 2
        state = np.concatenate([[_OPEN], maps[_OPEN, :-1]]).astype(np.uint8)
        marks = np.empty((chunk, width), np.uint8)
        flat_marks = self._marks.ravel()
        for k, step in enumerate(lanes):
            at = state * np.uint8(10) + step
            marks[k] = flat_marks[at]
            state = flat[at]
        marks = marks.T.ravel()[: len(classes)]
        begins = (marks & _BEFORE).astype(bool)
        begins[:-1] |= (marks[1:] & _EARLIER).astype(bool)
        return begins


class Pairs:
    """Counts tokens of words. A symbol is a byte of a word, plus 256 if it is the last one."""

    def __init__(self, tokens: dict[tuple[int, ...], int], merges: dict[tuple[int, int], tuple[int, int]]):
        self._merges = merges  # pair of ids: (rank, id)
        self._symbols = [tokens[(s,)] for s in range(512)]
        self._spelt = {token: spelling for spelling, token in tokens.items()}
        self._tree: list[tuple[dict[int, int], list[int]]] = [({}, [-1])]  # node: children by symbol, token
        for spelling, token in tokens.items():
            node = 0
            for symbol in spelling:
                below = self._tree[node][0]
                if symbol not in below:
                    below[symbol] = len(self._tree)
                    self._tree.append(({}, [-1]))
                node = below[symbol]
            self._tree[node][1][0] = token
        self._whole: dict[tuple[int | None, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._places: list[tuple] = [((0, None, 0),)]  # state: (node, last token before, tokens since) of each live suffix
        self._state_of = {self._places[0]: 0}
        self._resize(1 << 16)

    def _resize(self, slots: int) -> None:
        """An open-addressed table of transitions: key (state and symbol), next state, growth."""
        old = getattr(self, "_key", np.zeros(0, np.int64)), getattr(self, "_to", None), getattr(self, "_grow", None)
        self._key, self._to, self._grow = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int8)
        self._shift, self._used = np.uint64(65 - slots.bit_length()), 0
        if len(self._places) > 1:
            held = np.flatnonzero(old[0] >= 0)
            for key, to, grow in zip(*(column[held].tolist() for column in old)):
                self._put(key, to, grow)

    def _put(self, key: int, to: int, grow: int) -> None:
        if 2 * self._used > len(self._key):
            self._resize(4 * len(self._key))
        slot = key * _SPREAD % (1 << 64) >> int(self._shift)
        while self._key[slot] >= 0:
            slot = (slot + 1) % len(self._key)
        self._key[slot], self._to[slot], self._grow[slot] = key, to, grow
        self._used += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot that shows that it is not there."""
        slots = ((keys.view(np.uint64) * np.uint64(_SPREAD)) >> self._shift).astype(np.int64)
        held = self._key[slots]
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            slots[other] = (slots[other] + 1) % len(self._key)
            held = self._key[slots[other]]
            other = other[(held != keys[other]) & (held >= 0)]
        return slots

    def goes(self, last: int | None, token: int) -> bool:
        """Whether ``token`` after ``last`` stays as it is: no merge crosses their seam, and both come about."""
        known = self._whole.get((last, token))
        if known is None:
            if len(self._whole) >= 1 << 20:
                self._whole.clear()
            known = self._whole[last, token] = self._try(last, token)
        return known

    def _try(self, last: int | None, token: int) -> bool:
        ids = [self._symbols[s] for s in (self._spelt[last] if last is not None else ())]
        left = len(ids)  # ids before the seam
        ids += [self._symbols[s] for s in self._spelt[token]]
        merges = self._merges
        while True:
            rank, at, made = min(((*merges[p], i)[::2] + (merges[p][1],) for i, p in enumerate(zip(ids, ids[1:])) if p in merges), default=(None, 0, 0))
            if rank is None:
                return ids == ([token] if last is None else [last, token])
            if at == left - 1:
                return False
            ids[at : at + 2] = [made]
            left -= at < left

    def _step(self, state: int, symbol: int) -> None:
        """Build one transition."""
        live, last_token, growth = [], None, 0
        for node, last, since in self._places[state]:
            child = self._tree[node][0].get(symbol)
            if child is None:
                continue
            live.append((child, last, since))
            token = self._tree[child][1][0]
            if last_token is None and token >= 0 and self.goes(last, token):
                last_token, growth = token, since + 1
        target = 0
        if symbol < 256:
            # Tokens since each suffix, as of now.
            place = tuple((node, last, since - growth) for node, last, since in live if self._tree[node][0]) + ((0, last_token, 0),)
            target = self._state_of.get(place)
            if target is None:
                target = self._state_of[place] = len(self._places)
                self._places.append(place)
        self._put(state << 10 | symbol, target, growth)

    def _next(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Growth and next state of each transition; padding leads nowhere."""
        keys = state.astype(np.int64) << 10 | symbols
        slots = self._slots(keys)
        missing = (self._key[slots] < 0) & (symbols != _PADDING)
        if missing.any():
            for key in np.unique(keys[missing]).tolist():
                self._step(key >> 10, key & 1023)
            slots = self._slots(keys)
        there = symbols != _PADDING
        return np.where(there, self._grow[slots], 0), np.where(there, self._to[slots], state)

    def growth(self, symbols: np.ndarray, chunk: int = 128) -> np.ndarray:
        """Tokens by which each symbol lengthens the encoding of its word."""
        if len(self._places) > _STATES:
            self._forget()
        lanes = -(-len(symbols) // chunk)
        padded = np.full(lanes * chunk, _PADDING, np.int64)
        padded[: len(symbols)] = symbols
        steps = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
        grown = np.empty((chunk, lanes), np.int8)
        after = np.empty((chunk, lanes), np.int32)  # states
        state = np.zeros(lanes, np.int32)
        for k in range(chunk):
            grown[k], after[k] = self._next(state, steps[k])
            state = after[k]
        # The scan: true entries, from which the chunks' first steps are taken again.
        open_ = 1 + np.flatnonzero(after[-1, :-1])
        state = after[-1, open_ - 1]
        for k in range(chunk):
            if not len(open_):
                break
            grown[k, open_], state = self._next(state, steps[k, open_])
            apart = state != after[k, open_]
            after[k, open_] = state
            open_, state = open_[apart], state[apart]
        # Chunks that never met their old states: the next one was run from another entry than it has.
        waiting = [int(lane) + 1 for lane in open_ if lane + 1 < lanes]
        while waiting:
            lane = heappop(waiting)
            state = after[-1, [lane - 1]]
            for k in range(chunk):
                grown[k, [lane]], state = self._next(state, steps[k, [lane]])
                if state[0] == after[k, lane]:
                    break
                after[k, lane] = state[0]
            else:
                if lane + 1 < lanes and lane + 1 not in waiting[:1]:
                    heappush(waiting, lane + 1)
        return grown.T.ravel()[: len(symbols)]


class Counter:
    """The compiled tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, suffix = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], spec["model"]["end_of_word_suffix"]
        if split != SPLIT or not suffix or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: no vocabulary of byte pairs with word ends and the known split pattern")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]

        def spelling(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix)
            symbols = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            return (*symbols[:-1], symbols[-1] + 256) if ends else tuple(symbols)

        special = [token["content"] for token in spec["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        library = Tokenizer.from_file(path)
        self._normalizer = library.normalizer
        self._words = Words(library.pre_tokenizer)
        self._pairs = Pairs({spelling(token): n for token, n in vocab.items() if token not in special}, merges)
        self._plain: dict[str, bool] = {}

    def _normal(self, text: str) -> str:
        """The file's normaliser: NFC, white space to spaces, lower case by character."""
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and all(self._is_plain(c) for c in set(text))):
            return text.replace("Σ", "σ").lower()
        return self._normalizer.normalize_str(text)

    def _is_plain(self, char: str) -> bool:
        """Whether the library lowers a character as Python does."""
        known = self._plain.get(char)
        if known is None:
            known = self._plain[char] = char.isspace() or self._normalizer.normalize_str(char) == char.replace("Σ", "σ").lower()
        return known

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        specials = np.zeros(len(texts), np.int64)
        pieces = []
        for i, text in enumerate(texts):
            if self._special.search(text):
                parts = self._special.split(text)
                specials[i] = len(parts) - 1
                text = " ".join(map(self._normal, parts))
            else:
                text = self._normal(text)
            pieces.append(text)
        ends = np.cumsum([len(p) + 1 for p in pieces], dtype=np.int64)  # a space after every text
        joined = "".join([p + " " for p in pieces])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = self._words.classes(codes)
        begins, in_word = self._words.begins(classes), classes != _SPACE
        # From characters to bytes. A word's last byte is the one before a word or before space.
        last = in_word & np.concatenate([begins[1:] | ~in_word[1:], [True]])
        length = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        stops = np.cumsum(length, dtype=np.int64)
        symbols = data.astype(np.int32)
        symbols[stops[last] - 1] += 256
        kept = np.repeat(in_word, length) if len(data) > len(codes) else in_word
        sums = np.zeros(len(data) + 1, np.int64)
        sums[1:][kept] = self._pairs.growth(symbols[kept])
        sums = np.cumsum(sums)
        edges = np.concatenate([[0], stops[ends - 1]]) if len(texts) else np.zeros(1, np.int64)
        return np.diff(sums[edges]) + specials


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the number of tokens of each whole text, as a last column ``n_tokens`` (or ``_n_tokens``, where taken).

    ``path`` names the vocabulary file, which every executor must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            at = 0
            while at < batch.num_rows:  # so many rows as fill a batch of characters; a longer text is alone
                held, first = [], at
                size = 0
                while at < batch.num_rows and (size < _BATCH or at == first):
                    held.append(texts[at].as_py() or "")
                    size += len(held[-1])
                    at += 1
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.counts(held), pa.int64())], names=[*batch.schema.names, name])

    name = fresh("n_tokens", docs.columns)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {name} long")
