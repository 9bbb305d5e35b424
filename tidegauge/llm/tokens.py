"""Whole-text tokenisation with the tokenizers library, many texts at a time.

The byte-level pre-tokeniser never joins a character to white space after it,
so a text may be cut before every space or line end that follows no white
space.  The pieces of a portion of texts are cut and made distinct by Arrow,
each distinct piece that is not remembered is encoded once, and numpy lays the
ids of all pieces out in order.  A text that holds an added token
such as ``<|endoftext|>``, or other white space than single spaces and line
ends, is encoded as a whole.  The result equals the encoding of the whole text;
``encode_whole`` is that encoding.

Pieces are remembered per Python worker, in two generations of ``GENERATION``
pieces and one portion's each, the older of which is forgotten when the newer is
full: with about 200 bytes a piece, some 200 MB at most, and a quarter of it
unless a caller has that room.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION = 480_000
#: UTF-8 bytes of texts that are cut at a time; a longer text is a portion of its own.  Of texts to be encoded,
#: whose pieces and ids take many times their room, a quarter unless a caller has that room.
PORTION = 4_000_000
#: Latin letters, perhaps after a mark, then ASCII punctuation without apostrophes: pre-tokens without context.
PLAIN = re.compile(r"([\0\n]?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: That punctuation.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Texts with other white space than single spaces and line ends, or with NUL.
UNEVEN = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\x{b}\x{c}\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Of the C library, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


class PieceMemory:
    """Ids of pieces as packed unsigned 32-bit integers.

    A key that starts with a line end or a NUL stands for itself (without the
    NUL); any other key stands for itself after a space.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = [chr(b if b in shown else next(others)) for b in range(256)]
        self.space = self.letters[32]

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def pre_token(self, text: str) -> bytes:
        """Ids of a text that is one pre-token."""
        shown = "".join(map(self.letters.__getitem__, text.encode()))  # in the byte-level alphabet, where ASCII letters stand for themselves
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def known(self, key: str) -> bytes | None:
        ids = self.new.get(key)
        return self.old.get(key) if ids is None else ids

    def part(self, key: str, learn) -> bytes:
        """Ids of what may be known as a part of other keys, or as a key itself."""
        ids = self.known(key)
        if ids is None:
            ids = self.new[key] = learn(key)
        return ids

    def learn(self, key: str) -> bytes:
        """Ids of a key met for the first time; what is plainly a word and punctuation needs no pre-tokeniser."""
        word = key.rstrip(MARKS)
        if not (word.isascii() and word.isalpha()):
            return self.learn_other(key)
        # most new keys come this way: no calls but the model's
        ids = None if len(word) == len(key) else self.known(word)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(self.space + word)]).tobytes()
            if len(word) == len(key):
                return ids
            self.new[word] = ids
        after = key[len(word) :]
        return ids + self.part("\0" + after, lambda _: self.pre_token(after))

    def learn_other(self, key: str) -> bytes:
        """The same for keys that are not of ASCII letters, or that do not follow a space."""
        m = PLAIN.fullmatch(key)
        if m is None:
            return self.encode(key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key)
        lead, word, after = m.groups()
        if after:  # the word may be known without what follows it, and so may that
            return self.part(lead + word, self.learn) + self.part("\0" + after, lambda _: self.pre_token(after))
        if lead == "\n":
            return self.pre_token(lead) + self.pre_token(word)
        return self.pre_token(word if lead else " " + word)

    def of(self, keys: list[str], share: int = 1) -> list[bytes]:
        """Ids of distinct keys; a generation is ``GENERATION / share`` of them."""
        if len(self.new) > GENERATION // share:
            self.old, self.new = self.new, {}
        new, old, learn = self.new, self.old.get, self.learn
        got = list(map(new.get, keys))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            key = keys[i]
            ids = old(key)
            got[i] = new[key] = learn(key) if ids is None else ids
        return got


@lru_cache(maxsize=1)
def _memory(path: str) -> PieceMemory:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return PieceMemory(Tokenizer.from_file(path))


def forget() -> None:
    """Pieces that this worker remembers go, when it turns to other work."""
    if _memory.cache_info().currsize:
        _memory.cache_clear()


def id_type(path: str) -> str:
    """The narrowest little-endian unsigned integers that hold every id."""
    return "<u2" if _memory(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _lay_out(pieces: pa.Array, memory: PieceMemory, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in order, and how many each piece has."""
    coded = pieces.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    each = memory.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), share)
    known = np.frombuffer(b"".join(each), dtype="<u4")
    size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
    lengths = size[code]
    begin = (np.cumsum(size) - size)[code]
    ends = np.cumsum(lengths)
    narrow = np.int32 if len(ends) and max(int(ends[-1]), len(known)) < 1 << 31 else np.int64
    place = np.repeat((begin - ends + lengths).astype(narrow), lengths)
    place += np.arange(len(place), dtype=narrow)
    return known[place], lengths


def _portion(texts: pa.Array, path: str, end_id: int | None, share: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, each followed by ``end_id`` if there is one, and their offsets."""
    memory = _memory(path)
    odd = pc.match_substring_regex(texts, UNEVEN)
    for a in memory.added:
        odd = pc.or_(odd, pc.match_substring(texts, a))
    odd = odd.to_numpy(zero_copy_only=False).astype(bool)
    # the first piece has no space before it: it is marked by a NUL
    even = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0", texts.type), texts.filter(pa.array(~odd)), pa.scalar("", texts.type)), "\n", " \n"), " ")
    ids, lengths = _lay_out(even.flatten(), memory, share)
    counts = np.zeros(len(texts), dtype=np.int64)
    ends = np.r_[0, np.cumsum(lengths)][even.offsets.to_numpy() - even.offsets[0].as_py()] if len(even) else np.zeros(1, np.int64)
    counts[~odd] = np.diff(ends)
    if odd.any():
        slow = {i: np.frombuffer(memory.encode(texts[i].as_py()), dtype="<u4") for i in np.flatnonzero(odd).tolist()}
        parts = np.split(ids, ends[1:-1]) if (~odd).any() else []
        fast = iter(parts)
        ids = np.concatenate([slow[i] if i in slow else next(fast) for i in range(len(texts))])
        for i, x in slow.items():
            counts[i] = len(x)
    if end_id is not None:
        ids = np.insert(ids, np.cumsum(counts), end_id)
        counts += 1
    return ids, np.r_[0, np.cumsum(counts)]


def give_back() -> None:
    """Memory that this worker no longer needs goes back to the machine: Spark reuses workers, and an idle one would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def portions(texts: pa.Array, share: int = 1) -> Iterator[tuple[int, pa.Array]]:
    """Slices of ``texts`` (null: empty) of about ``PORTION / share`` bytes, with the row each begins at."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PORTION // share, "right")))
        yield at, pc.fill_null(texts.slice(at, upto - at).cast(pa.large_string()), "")
        at = upto
    give_back()


def encode_texts(texts: pa.Array, path: str, end_id: int | None = None, share: int = 4) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Portions of ``texts`` (null: empty) as (first row, ids of all its texts, offsets of each text's ids).

    With a smaller ``share`` portions are larger and more pieces are remembered: a word is looked up and learned less often, and takes more room.
    """
    for at, part in portions(texts, share):
        yield at, *_portion(part, path, end_id, share)


def encode_whole(text: str, path: str) -> list[int]:
    """The tokenizers library's own encoding of the whole text."""
    return _memory(path).tokenizer.encode(text, add_special_tokens=False).ids
