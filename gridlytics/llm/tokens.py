"""Token ids of whole texts by a tokenizer file of the `tokenizers` library.

A text is cut where its tokenizer always cuts too (before a space that follows a non-space; at ASCII white space if the
tokenizer drops that), each distinct piece is encoded once, and the ids are put together by index. The model of the
library makes the ids of every pretoken; pieces with anything unusual go through the whole library, as do texts in which
white space meets a space. So the ids are those of `Tokenizer.encode(text, add_special_tokens=False)`.

A worker remembers the ids of pieces and pretokens by the 64-bit hash of their text, in arrays, so that a million of them take some
forty megabytes. When a generation is full it becomes the old one; what is found there moves on into the new one.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a generation of a Python worker's memory holds; there are two. A worker keeps them from stage to stage, some forty
#: megabytes a generation of half a million with what sorting them in takes.
REMEMBERED = 500_000

# The two pretokenizer patterns that are cut by piece.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space before a space, in RE2.
BEFORE_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
#: Signs that end a word and are a pretoken of their own there.
PLAIN_ENDS = frozenset(".,;:!?")
UNUSUAL = {"byte": "[^\n\t\r\x20-\x7e\xa1-ɏ]", "word": "[^\x21-\x7e\xa1-įı-ɏ]"}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


def _hashes(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, object), categorize=False) if strings else np.zeros(0, np.uint64)


def gathered(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of an array, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return blob[:0]
    return blob[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class Generation:
    """Stretches of ids by hash: one array of ids, and hashes in a large sorted level and a small one that is merged into it."""

    def __init__(self):
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.levels, self.blob, self.used = [empty, empty], np.zeros(1 << 16, np.int32), 0

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each stretch; a start of -1 where there is none."""
        starts, lengths = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int32)
        for known, begins, sizes in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                starts[hit], lengths[hit] = begins[at[hit]], sizes[at[hit]]
        return starts, lengths

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """`hashes`: distinct, and none of them known."""
        if self.used + len(ids) > len(self.blob):
            larger = np.zeros(max(2 * len(self.blob), self.used + len(ids)), np.int32)
            larger[: self.used] = self.blob[: self.used]
            self.blob = larger
        self.blob[self.used : self.used + len(ids)] = ids
        begins = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        large, small = self.levels
        small = self._merged(small, (hashes, begins.astype(np.int64), lengths.astype(np.int32)))
        if len(small[0]) > 50_000 + len(large[0]) // 8:
            large, small = self._merged(large, small), tuple(x[:0] for x in small)
        self.levels = [large, small]

    @staticmethod
    def _merged(one: tuple, two: tuple) -> tuple:
        hashes = np.concatenate([one[0], two[0]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], *(np.concatenate([a, b])[order] for a, b in zip(one[1:], two[1:]))


class Memory:
    """Two generations; what is asked for is in the young one afterwards."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, Generation(), Generation()

    def make_room(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = Generation(), self.young

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As in a generation, for distinct hashes; starts are those of the young one."""
        starts, lengths = self.young.find(hashes)
        missing = np.flatnonzero(starts < 0)
        if len(missing) and len(self.old):
            begins, sizes = self.old.find(hashes[missing])
            hit = begins >= 0
            if hit.any():
                self.young.add(hashes[missing[hit]], gathered(self.old.blob, begins[hit], sizes[hit]), sizes[hit])
                starts[missing[hit]], lengths[missing[hit]] = self.young.find(hashes[missing[hit]])
        return starts, lengths


class Encoder:
    """Encodes the texts of Arrow arrays; `kind` is byte, word or whole (no cutting)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        if not os.path.exists(path):  # a machine that has the package of public tokenizers somewhere else
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(path))
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        special = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers", [])
        self.kind = "whole"
        if any(x.get("normalized") or x.get("lstrip") or x.get("rstrip") or " " in x["content"] for x in spec.get("added_tokens", [])):
            pass
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            self.kind, self.pattern = "byte", regex.compile(BYTE_PATTERN)
        elif (
            [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == WORD_PATTERN
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1].get("use_regex", True)
            and not steps[1].get("add_prefix_space") and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.kind, self.pattern = "word", regex.compile(WORD_PATTERN)
        if self.kind != "whole":
            self.unusual = re.compile("|".join([UNUSUAL[self.kind], *special]))
        self.memory = Memory(REMEMBERED)

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, text: str) -> list[int]:
        if text.isascii() and text.isprintable() and " " not in text[1:]:
            if text[0] == " ":
                text = "Ġ" + text[1:]
        else:
            text = (text if text.isascii() else text.encode().decode("latin-1")).translate(self.letters)
        return [x.id for x in self.model.tokenize(text)]

    def _pretokens(self, piece: str) -> list[str] | None:
        """What the tokenizer's own cutting makes of a piece; None if the piece has anything unusual."""
        if not piece:
            return []
        if not piece.isascii() and self.unusual.search(piece):
            return None
        if self.kind == "word":
            lower = piece.lower()
            if lower.isalpha():
                return [lower]
            if lower[:-1].isalpha() and lower[-1] in PLAIN_ENDS:
                return [lower[:-1], lower[-1]]
            return None if self.unusual.search(piece) else self.pattern.findall(lower)
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return [piece]
        if word[:-1].isalpha() and word[-1] in PLAIN_ENDS:
            return [piece[:-1], piece[-1]]
        return None if self.unusual.search(piece) else self.pattern.findall(piece)

    def _known(self, strings: list[str], hashes: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in the young generation of the ids of distinct strings; `make` gives those of the ones not known. A piece
        that is one pretoken has its ids, so both are remembered under one hash."""
        starts, lengths = self.memory.find(hashes)
        missing = np.flatnonzero(starts < 0)
        if len(missing):
            ids, sizes = make([strings[k] for k in missing.tolist()])
            young = self.memory.young
            new = young.find(hashes[missing])[0] < 0
            young.add(hashes[missing[new]], ids[np.repeat(new, sizes)], sizes[new])
            starts[missing], lengths[missing] = young.find(hashes[missing])
        return starts, lengths

    def _by_pretoken(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, put together from those of their distinct pretokens."""
        cut = [self._pretokens(piece) for piece in pieces]
        counts = np.fromiter((len(parts) if parts else 0 for parts in cut), np.int64, len(cut))
        flat = [*chain.from_iterable(filter(None, cut))]
        hashes, first, codes = np.unique(_hashes(flat), return_index=True, return_inverse=True)
        starts, lengths = self._known([flat[k] for k in first.tolist()], hashes, self._by_model)
        starts, lengths = starts[codes], lengths.astype(np.int64)[codes]
        ids = gathered(self.memory.young.blob, starts, lengths)
        sizes = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])])
        odd = [k for k, parts in enumerate(cut) if parts is None]
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in odd:
                parts[k] = np.frombuffer(self.whole(pieces[k]), np.int32)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes

    def _by_model(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self._pretoken(x) for x in pretokens]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter((i for ids in made for i in ids), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one end more than texts)."""
        n = len(texts)
        odd = np.ones(n, bool)
        if self.kind != "whole" and n:
            odd[:] = False
            if self.kind == "byte":
                odd = pc.match_substring_regex(texts, BEFORE_SPACE).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        ids, offsets = self._cut(plain) if n else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        if odd.any():
            parts = np.split(ids, offsets[1:-1])
            for k in np.flatnonzero(odd):
                parts[k] = np.frombuffer(self.whole(texts[int(k)].as_py()), np.int32)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lists = pc.split_pattern(texts, " ") if self.kind == "byte" else pc.ascii_split_whitespace(texts)
        begins = lists.offsets.to_numpy().astype(np.int64)
        begins = begins - begins[0]
        encoded = lists.flatten().dictionary_encode()
        codes, distinct = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "byte":  # all pieces but a text's first begin with the space they were cut at
            first = begins[:-1]
            firsts, which = np.unique(codes[first], return_inverse=True)
            codes[first] = len(distinct) + which
            distinct = [" " + x for x in distinct] + [distinct[k] for k in firsts]
        self.memory.make_room()
        starts, lengths = self._known(distinct, _hashes(distinct), self._by_pretoken)
        lengths = lengths.astype(np.int64)[codes]
        return gathered(self.memory.young.blob, starts[codes], lengths), np.concatenate([[0], np.cumsum(lengths)])[begins]


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker. It hangs on the library's module, as functions that travel with the
    tasks get new globals each time."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
