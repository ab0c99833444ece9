"""BPE as a deterministic automaton whose arcs are tokens, compiled merge by merge.

Compilation walks the merges in rank order. The gadget of a merge ``u v -> w`` looks at the states that
an arc ``u`` enters and an arc ``v`` leaves: there the arc ``v`` is forbidden and an arc ``w`` is laid
from the source of ``u`` to the target of ``v``. A state is thus known by the arc that entered it, and
what a gadget forbids is kept as two short chains for each token: the arcs on its right edge and on its
left edge, each with the rank of the merge that consumed it. A chain goes from an arc to the one that it was made
from, so one link an arc holds them all. Two arcs may follow one another unless a
merge joins an arc of the first chain to one of the second while both exist. Where the merge's own path
is already forbidden, its gadget adds no arc.

Words are read by a transition table over (state, symbol). What may end the tokenization of a longer
prefix depends only on the longest end of the text that some token begins with, and on the arcs that end
at each place in it: that is a state. A state names the arc that ends the prefix's tokenization, so walking
back by arc lengths gives the tokens, and walking on gives the exact token count at every prefix. States
and transitions are made when they are first met and dropped when there are too many; reading a word of
any length takes linear time and memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Bounds of the tables in a Python worker; a full table is emptied, which costs time, not exactness.
MAX_STATES, MAX_PAIRS, MAX_WORDS, LONG_WORD = 180_000, 450_000, 450_000, 40
START = -1


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "", tables: float = 1.0):
        self.most_states, self.most_pairs = int(MAX_STATES * tables), int(MAX_PAIRS * tables)
        self.end = end
        made = {u + v for u, v in merges}
        #: What ends a chain; the rank at which an arc at a chain's head is consumed: never.
        self.never = len(merges) + 1
        most = max(vocab.values(), default=-1) + 1
        #: Of each arc the two arcs it was made from (START: of none) and the rank of the merge that consumed them.
        self.left, self.right, self.rank = (array("i", [START]) * most for _ in range(3))
        self.arcs: dict[str, int] = {text: i for text, i in vocab.items() if text not in made}
        self.pair: dict[int, int] = {}
        for r, (u, v) in enumerate(merges):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if self.arcs.get(u) == a and self.arcs.get(v) == b and self._open(a, b):
                self.arcs[u + v] = w
                self.left[w], self.right[w], self.rank[w] = a, b, r
            self.pair.setdefault(a << 32 | b, r)
        #: What a token may begin with, without the word-end symbol: the texts of the states.
        self.begins = {""}
        for t in self.arcs:
            body = t.removesuffix(end) if end else t
            self.begins.update(body[:i] for i in range(1, len(body) + 1))
        self.size = array("i", [0]) * most
        for text, t in self.arcs.items():
            self.size[t] = len(text.removesuffix(end) if end else text)
        self.follow: dict[int, bool] = {}
        self._clear()

    def _open(self, x: int, y: int) -> bool:
        """Whether arc y may follow arc x under the merges compiled so far."""
        pair, left, right, rank = self.pair, self.left, self.right, self.rank
        a, until_a = x, self.never
        while a != START:
            b, until_b = y, self.never
            while b != START:
                r = pair.get(a << 32 | b)
                if r is not None and r < until_a and r <= until_b:
                    return False
                b, until_b = left[b], rank[b]
            a, until_a = right[a], rank[a]
        return True

    def _follows(self, x: int, y: int) -> bool:
        key = x << 32 | y
        found = self.follow.get(key)
        if found is None:
            if len(self.follow) >= self.most_pairs:
                self.follow.clear()
            found = self.follow[key] = self._open(x, y)
        return found

    def _clear(self) -> None:
        self.start = State(self, "", (START,), START, 0)
        self.known: dict[tuple[str, tuple[int, ...]], State] = {}

    def last_arc(self, text: str, before: tuple[int, ...]) -> int:
        """The arc that ends the tokenization of ``text``, given the arcs that end before each of its symbols."""
        for k, x in enumerate(before):
            t = self.arcs.get(text[k:])
            if t is not None and (x == START or self._follows(x, t)):
                return t
        raise KeyError(f"no token ends {text!r}")

    def state(self, text: str, before: tuple[int, ...]) -> State:
        """The state that the longest end of ``text`` with which a token may begin stands for."""
        k = 0
        while text[k:] not in self.begins:
            k += 1
        key = text[k:], before[k:]
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.most_states:  # a word that is being read goes on; its old states fall away
                self._clear()
            found = self.known[key] = State(self, *key, before[-1], self.size[before[-1]])
        return found

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, written in the byte alphabet."""
        if not word:
            return []
        state = self.start
        if self.end:
            arcs = [(state := state[c]).arc for c in word[:-1]]
            arcs.append(state[word[-1] + self.end])
        else:
            arcs = [(state := state[c]).arc for c in word]
        i, out, size = len(word), [], self.size
        while i:
            t = arcs[i - 1]
            out.append(t)
            i -= size[t]
        return out[::-1]

    def prefix_counts(self, word: str) -> list[int]:
        """Exact token count of every prefix of ``word``, from the empty one on (no word-end symbol)."""
        counts, state = [0], self.start
        for c in word:
            state = state[c]
            counts.append(counts[-state.size] + 1)
        return counts

    def count(self, word: str) -> int:
        """The last of the prefix counts; with a word-end symbol, the number of tokens."""
        return len(self.encode(word)) if self.end else self.prefix_counts(word)[-1]


class State(dict):
    """A row of the transition table: symbol -> next state; last symbol with the word-end symbol -> last arc.

    ``text`` and ``before``: the longest end of the text read with which a token may begin, and the arcs
    that end before each of its symbols and at its end (START where none does).
    """

    __slots__ = ("table", "text", "before", "arc", "size")

    def __init__(self, table: MergeAutomaton, text: str, before: tuple[int, ...], arc: int, size: int):
        self.table, self.text, self.before, self.arc, self.size = table, text, before, arc, size

    def __missing__(self, symbol: str) -> State | int:
        text = self.text + symbol
        last = self.table.last_arc(text, self.before)
        after = self[symbol] = self.table.state(text, (*self.before, last)) if len(symbol) == 1 else last
        return after


class Memo(dict):
    """Values of a function, up to ``most`` of them for short words."""

    def __init__(self, of, most: int):
        self.of, self.most = of, most

    def __missing__(self, word):
        value = self.of(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class Codec:
    """Reads a ``tokenizers`` JSON file; encodes whole texts as that library does, by the automaton."""

    def __init__(self, path: str, tables: float = 1.0):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        self.automaton = MergeAutomaton(model["vocab"], merges, self.end, tables)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"]
        own = [p for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
        #: The split of byte-level vocabularies is fixed by their format.
        fixed = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.split = regex.compile(own[0]["pattern"]["Regex"] if own else fixed)
        self.spaced = spec["decoder"] is None
        self.bytes = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        most = int(MAX_WORDS * tables**2)  # a word met again saves less than a state: small tables hold few words
        self.word_ids, self.word_count = Memo(self._word_ids, most), Memo(self._word_count, most)
        #: What stands between blanks is encoded by itself; words of one text often repeat as a whole.
        self.chunk_ids, self.chunk_count = Memo(self._chunk_ids, most), Memo(self._chunk_count, most)

    def normalize(self, text: str) -> str:
        if "NFC" in self.steps:
            text = unicodedata.normalize("NFC", text)
        # white space only parts words here: replacing it changes no word
        if "Lowercase" in self.steps:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return text

    def spell(self, word: str) -> str:
        return "".join(map(self.bytes.__getitem__, word.encode("utf-8")))

    def _word_ids(self, word: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.automaton.encode(self.spell(word))])

    def _word_count(self, word: str) -> int:
        return self.automaton.count(self.spell(word))

    def _chunk_ids(self, chunk: str) -> bytes:
        words = self.split.findall(chunk)
        # a chunk that is one word is kept as a chunk only, not once more as a word
        return self._word_ids(chunk) if words == [chunk] else b"".join(map(self.word_ids.__getitem__, words))

    def _chunk_count(self, chunk: str) -> int:
        return sum(map(self.word_count.__getitem__, self.split.findall(chunk if self.end else " " + chunk)))

    def parts(self, text: str):
        """(special id or None, text between special strings) in order: special strings stand for themselves."""
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                yield self.special[part], ""
            elif part:
                yield None, self.normalize(part)

    def words(self, part: str) -> list[str]:
        return self.split.findall(part)

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for special, part in self.parts(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
            elif self.spaced and not _SEPARATORS(part):  # white space only parts words
                out.append(b"".join(map(self.chunk_ids.__getitem__, part.split())))
            else:
                out.append(b"".join(map(self.word_ids.__getitem__, self.words(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs ``ids``: joined by blanks, or as bytes where the format decodes bytes."""
        labels = self.names[np.frombuffer(ids, "<u4")].tolist()
        if self.spaced:
            return " ".join(labels)
        raw = b"".join(
            t.encode("utf-8") if t in self.special else bytes(self.byte_of[c] for c in t) for t in labels
        )
        return raw.decode("utf-8", errors="replace")

    def count(self, text: str) -> int:
        """Number of tokens of a whole text."""
        n = 0
        for special, part in self.parts(text):
            if special is not None:
                n += 1
            elif self.spaced:
                n += sum(map(self.word_count.__getitem__, self.words(part)))
            elif _UNEVEN(part):
                n += sum(map(self.word_count.__getitem__, self.words(part)))
            else:  # every blank stands alone between two words and begins the second
                first, *rest = part.split(" ")
                n += sum(map(self.word_count.__getitem__, self.words(first)))
                n += sum(map(self.chunk_count.__getitem__, rest))
        return n


#: Characters that Python's split() takes for white space and the vocabularies' patterns do not.
_SEPARATORS = re.compile("[\x1c-\x1f]").search
#: White space other than single blanks and line ends, or a blank that doesn't stand between two words.
_UNEVEN = re.compile(r"[^\S \n]|  | \n|\n |^ | $").search


@lru_cache(maxsize=2)
def codec(path: str, tables: float = 1.0) -> Codec:
    """A codec that a worker keeps between tasks."""
    return Codec(path, tables)
