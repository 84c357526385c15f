"""Token ids of the public word-level BPE vocabulary, exactly as the tokenizers library gives them, for whole corpora.

No token spans a space or a line end, so a text's ids are those of its words one after another. Texts are cut on their
bytes, a block at a time: letters, digits, signs and white space are told apart by a table, and where a part of a word
begins follows from neighbouring bytes. A part of up to 16 bytes is two integers, by which its ids are found in a table of
open addressing; new parts are merged together by bpe.Merges, and all ids are gathered at once. Words with bytes beyond
printable ASCII and the letters of Latin-1, or with what may be an added token, are looked up as strings: those made of
Latin letters and common signs are merged as well, all others go through the library. Each worker keeps the ids of what it has met (at most KEPT parts
and words, then it starts anew).
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

KEPT = 400_000
BLOCK = 1_000_000
END = 0

#: Fixed value: the pattern that cuts a word before the merges, as in the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


WHITE, LETTER, DIGIT, SIGN, ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte, lower-cased."""
    out = np.full(256, ODD, np.uint8)
    out[33:127] = SIGN
    out[[10, 32]] = WHITE
    out[97:123] = LETTER
    out[48:58] = DIGIT
    return out


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of a little-endian integer of eight bytes, the first so many.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _contractions(lower: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the contraction that begins at each of these apostrophes, 0 if none does."""
    padded = np.append(lower, np.zeros(2, np.uint8))
    x, y = padded[at + 1], padded[at + 2]
    two = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    three = np.zeros(len(at), bool)
    for a, b in (b"re", b"ve", b"ll"):
        three |= (x == a) & (y == b)
    return np.where(two, 2, np.where(three, 3, 0))


def _cut(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of the words of a block: the lower-cased bytes, begin and end of each part, and whether it is a word that must
    be looked up as a string."""
    lower = LOWER[np.frombuffer(raw, np.uint8)]
    kind = CLASS[lower]
    # U+00C0 to U+00FF, letters but for two signs: 0xC3 and a second byte, which is 32 less for the capital one.
    lead = np.flatnonzero(lower == 0xC3)
    lead = lead[(lower[lead + 1] != 0x97) & (lower[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    lower[lead[lower[lead + 1] <= 0x9E] + 1] += 0x20
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    begins = ((kind != before) | (kind == DIGIT)) & (kind != WHITE)
    # An apostrophe inside a run of signs belongs to that run.
    quote = np.flatnonzero((lower == ord("'")) & (before != SIGN))
    if len(quote):
        size = _contractions(lower, quote)
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        after = (quote + size)[quote + size < len(lower)]
        begins[after] |= kind[after] == LETTER
    odd = kind == ODD
    odd[:-1] |= (lower[:-1] == ord("<")) & (lower[1:] == ord("|"))
    whole = None
    if odd.any():
        opens = (kind != WHITE) & (before == WHITE)
        word = np.cumsum(opens, dtype=np.int32) - 1
        of_odd = np.zeros(int(word[-1]) + 1, bool)
        of_odd[word[odd]] = True
        whole = of_odd[word] if len(of_odd) else None
        begins = np.where(whole & (kind != WHITE), opens, begins)
    last = np.append(begins[1:] | (kind[1:] == WHITE), True) & (kind != WHITE)
    begin, end = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return lower, begin, end, np.zeros(len(begin), bool) if whole is None else whole[begin]


class _Table:
    """Ids of parts and words by number, and numbers of short parts by two integers: open addressing, linear probing."""

    def __init__(self):
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.slots = np.full(1 << 16, -1, np.int32)
        self.short = np.zeros(0, np.int32)  # numbers of the parts that have a slot
        self.words: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.at)

    def add(self, ids: np.ndarray, size: np.ndarray, low=None, high=None) -> np.ndarray:
        """Numbers of new entries."""
        numbers = np.arange(len(self.at), len(self.at) + len(size), dtype=np.int32)
        self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids.astype(np.int32))
        none = np.zeros(len(size), np.uint64)
        self.low, self.high = np.append(self.low, none if low is None else low), np.append(self.high, none if high is None else high)
        if low is not None:
            self.short = np.append(self.short, numbers)
            if 2 * len(self.short) > len(self.slots):
                while 2 * len(self.short) > len(self.slots):
                    self.slots = np.full(2 * len(self.slots), -1, np.int32)
                self._place(self.short)
            else:
                self._place(numbers)
        return numbers

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * MIX[0] ^ high * MIX[1]
        return ((mixed ^ (mixed >> np.uint64(29))) * MIX[0] >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)

    def _place(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            waits = self.slots[slot] != numbers
            numbers, slot = numbers[waits], (slot[waits] + 1) & (len(self.slots) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each part, -1 for those not met yet."""
        out = np.full(len(low), -1, np.int32)
        slot, rest = self._slot(low, high), None
        while True:
            number = self.slots[slot]
            same = (number >= 0) & (self.low[number] == low) & (self.high[number] == high) if len(self) else np.zeros(len(low), bool)
            if rest is None:
                out[same] = number[same]
                rest = np.arange(len(low))
            else:
                out[rest[same]] = number[same]
            other = (number >= 0) & ~same
            if not other.any():
                return out
            rest, low, high = rest[other], low[other], high[other]
            slot = (slot[other] + 1) & (len(self.slots) - 1)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow
    from 256 on in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return letters


class WordTokenizer:
    def __init__(self, path: str):
        import regex

        from listenlake.llm.bpe import Merges

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], [t["id"] for t in told["added_tokens"]]
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.merges = Merges(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2], max(vocab.values()) + 1)
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.cut = regex.compile(PATTERN).findall
        # Plain: no white space beside the split ones, nothing that normalisation or case folding may change in length.
        self.plain = regex.compile(r"[\x21-\x7E¡-įı-ɏ]*").fullmatch
        self.path = path
        self.highest = max([*vocab.values(), *added])
        self.table = _Table()

    @cached_property
    def library(self):
        """Loaded where a text asks for it: it takes as much memory as all the rest."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _parts(self, w: str) -> list[str] | None:
        """What the merges see of a word; None if the library must say."""
        if w.isalpha() and (w.isascii() or self.plain(w)):
            return [w.lower()]
        body = w[:-1]
        if w[-1:] in ",.!?;:" and body.isalpha() and (body.isascii() or self.plain(body)):
            return [body.lower(), w[-1]]
        return self.cut(w.lower()) if "<|" not in w and self.plain(w) else None

    def _merged(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that lie one after another in flat, and how many each has."""
        symbols = self.inner[flat]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[flat[ends]]
        return self.merges.merge(symbols, size)

    def _learn_words(self, words: list[bytes]) -> None:
        """Ids of words that are looked up as strings. Words share parts, which are merged once."""
        number: dict[str, int] = {}
        made_of: list[tuple[bytes, list[int]]] = []
        other: list[bytes] = []
        for w in words:
            parts = self._parts(w.decode())
            if parts is None:
                other.append(w)
            else:
                made_of.append((w, [number.setdefault(p, len(number)) for p in parts]))
        ids: list[np.ndarray] = []
        if number:
            raw = [p.encode() for p in number]
            size = np.array([len(r) for r in raw], np.int64)
            made, length = self._merged(np.frombuffer(b"".join(raw), np.uint8), size)
            ends = np.cumsum(length).tolist()
            of = [made[a:b] for a, b in zip([0, *ends], ends)]
            ids += [np.concatenate([of[k] for k in parts]) for _, parts in made_of]
        if other:
            texts = [w.decode() for w in other]
            ids += [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        numbers = self.table.add(np.concatenate(ids), np.array([len(x) for x in ids], np.int64))
        self.table.words.update(zip([w for w, _ in made_of] + other, numbers.tolist()))

    def _short(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of parts of up to 16 bytes."""
        found = self.table.find(low, high)
        new = found < 0
        if new.any():
            keys = np.unique(np.stack([low[new], high[new]], axis=1), axis=0)
            chars = keys.astype("<u8").view(np.uint8)
            made, length = self._merged(chars[chars != 0], (chars != 0).sum(axis=1))
            self.table.add(made, length, keys[:, 0], keys[:, 1])
            found[new] = self.table.find(low[new], high[new])
        return found

    def _block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin of each part of a block, number of its ids, and all ids."""
        lower, begin, end, whole = _cut(raw)
        size = end - begin
        short = ~whole & (size <= 16)
        padded = np.append(lower, np.zeros(24, np.uint8))
        eight = np.ndarray(len(lower) + 16, "<u8", padded, strides=(1,))
        at, n = begin[short], size[short]
        number = np.empty(len(begin), np.int32)
        number[short] = self._short(eight[at] & FIRST[np.minimum(n, 8)], eight[at + 8] & FIRST[np.maximum(n - 8, 0)])
        rest = np.flatnonzero(~short)
        if len(rest):
            words = [raw[a:b] for a, b in zip(begin[rest].tolist(), end[rest].tolist())]
            known = self.table.words
            new = list(dict.fromkeys(w for w in words if w not in known))
            if new:
                self._learn_words(new)
            number[rest] = [known[w] for w in words]
        count = self.table.size[number]
        shift = self.table.at[number] - (np.cumsum(count) - count)
        return begin, count, self.table.ids[np.repeat(shift, count) + np.arange(int(count.sum()))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        raws = [(t or "").encode() for t in texts]
        bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])  # a line end behind each
        joined = b"\n".join(raws) + b"\n"
        before = np.zeros(len(bounds), np.int64)  # ids before each bound
        made, total, at = [], 0, 0
        while at < len(joined):
            stop = at + BLOCK
            if stop < len(joined):
                # Behind white space, so that no word is cut.
                ends = [k for k in (joined.find(b" ", stop), joined.find(b"\n", stop)) if k >= 0]
                stop = min(ends) + 1 if ends else len(joined)
            if len(self.table) > KEPT:
                self.table = _Table()
            begin, count, ids = self._block(joined[at:stop])
            own = slice(*np.searchsorted(bounds, [at, min(stop, len(joined))]))
            ahead = np.append(0, np.cumsum(count))
            before[own] = total + ahead[np.searchsorted(begin, bounds[own] - at)]
            made.append(ids.astype("<u4").tobytes())
            total += len(ids)
            at = stop
        before[-1] = total
        data, ends = b"".join(made), (4 * before).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker."""
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def in_groups(texts: list[str], most: int = 2_000_000):
    """Runs of consecutive texts of about `most` characters: (place of the first, texts)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]
