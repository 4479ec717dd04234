"""Token ids of whole texts by the tokenizers library, through a bounded cache of text pieces.

Pre-tokenisation cuts a text into parts that are merged independently, so equal pieces between safe
cuts always give equal ids. Each distinct piece is encoded once by the library and its ids are kept
as little-endian unsigned 32-bit integers; a text's ids are the joined bytes of its pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that are kept, the latest used first; bounds a worker's memory (about 50 bytes each).
CACHE_ENTRIES = 500_000
#: Texts in an Arrow batch: the more, the more often a piece is met twice in it and looked up once.
ENCODED_ROWS = 1024
#: Pieces longer than this are encoded without being kept.
CACHE_CHARS = 64

#: White space in the widest sense of any library; a space after it is no safe cut.
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎           ​‌‍    ⁠　﻿"
#: Begins the key of a piece without a leading space or line break.
_BARE = "\0"


def byte_level_keys(text: str) -> list[str]:
    """Pieces cut before each space or line break that follows a character that isn't white space.

    A byte-level pre-token holds white space only as a space at its beginning or in a run of white
    space, so such a cut is always a border between pre-tokens. A piece is named by what follows its
    leading space, by itself if it begins with a line break, else by _BARE and its text. Texts that
    hold _BARE are one piece.
    """
    if _BARE in text:
        return [_BARE + text]
    out = [""]
    for part in re.split("(?=[ \n])", text):
        if not out[-1] or out[-1][-1] in _SPACES:
            out[-1] += part
        else:
            out.append(part)
    return [p[1:] if p[0] == " " and len(p) > 1 and p[1] != "\n" else p if p[0] == "\n" else _BARE + p for p in out if p]


#: What a key begins with, plain letters (one pre-token), and marks (another). U+0130 is no plain letter: in lower case it has a mark.
_SIMPLE = "^(?P<lead>[\\x00\n]?)(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]*)$"


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` file; one per worker and file."""

    _kept: dict[tuple[str, bool], PieceEncoder] = {}

    def __init__(self, path: str, words: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = words
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.marks: dict[str, bytes] = {"": b""}
        # a byte-level vocabulary writes every byte as one character
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.last = np.zeros(len(self.lengths), dtype=bool)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)
            self.last[k] = token.endswith("</w>")
        # the same model and byte alphabet, for pieces that need no pattern to be cut
        self.plain = Tokenizer(self.tokenizer.model)
        if words:
            self.plain.normalizer = normalizers.Lowercase()
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed" if words else "merged_with_next"), bytes_only])
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), bytes_only])

    @classmethod
    def of(cls, path: str, words: bool) -> PieceEncoder:
        """words: the tokenizer drops white space and ends each word."""
        if (path, words) not in cls._kept:
            cls._kept[path, words] = cls(path, words)
        return cls._kept[path, words]

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _letters(self, words: pa.Array, bare: bool) -> pa.Array:
        """Ids of distinct words of plain letters, encoded in one call and cut apart again.

        With words: each ends with an id that ends a word. Otherwise each follows a space (or, bare,
        stands alone), and ids stand for a known number of bytes.
        """
        if not len(words):
            return pa.array([], pa.large_binary())
        gap = "\n" if bare and not self.words else " "
        joined = ("" if self.words or bare else " ") + gap.join(words.to_pylist())
        plain = self.bare if bare and not self.words else self.plain
        [encoded] = plain.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(encoded.ids, dtype="<u4")
        if self.words:
            ends = np.flatnonzero(self.last[ids]) + 1
        else:
            sizes = np.asarray(pc.binary_length(words)).astype(np.int64) + (0 if bare else 1)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
        bounds = np.append(0, 4 * ends).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.tobytes())])

    def _encode(self, keys: pa.Array) -> pa.Array:
        """Ids of distinct keys. Letters are one pre-token, marks after them another, a line break before them one too."""
        parts = pc.extract_regex(keys, _SIMPLE)
        simple = np.asarray(parts.is_valid())
        leads = pc.struct_field(parts, "lead")
        order, out, rest = [], [], np.ones(len(keys), bool)
        for lead in ("",) if self.words else ("", _BARE, "\n"):
            mine = simple & np.asarray(pc.fill_null(pc.equal(leads, lead), False))
            if not mine.any():
                continue
            found = parts.filter(pa.array(mine))
            words, marks = (pc.struct_field(found, f).dictionary_encode() for f in ("word", "marks"))
            own = self._letters(words.dictionary, bool(lead)).take(words.indices)
            for m in ("\n", *marks.dictionary.to_pylist()):
                if m not in self.marks:
                    self.marks[m] = self._whole([m])[0]
            after = pa.array([self.marks[m] for m in marks.dictionary.to_pylist()], pa.large_binary()).take(marks.indices)
            before = pa.scalar(self.marks["\n"] if lead == "\n" else b"", pa.large_binary())
            out.append(pc.binary_join_element_wise(before, own, after, pa.scalar(b"", pa.large_binary())))
            order.append(np.flatnonzero(mine))
            rest &= ~mine
        if rest.any():
            names = keys.filter(pa.array(rest)).to_pylist()
            texts = names if self.words else [k[1:] if k[:1] == _BARE else k if k[:1] == "\n" else " " + k for k in names]
            out.append(pa.array(self._whole(texts), pa.large_binary()))
            order.append(np.flatnonzero(rest))
        if not out:
            return pa.array([], pa.large_binary())
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))

    def _known(self, keys: pa.Array, entries: int) -> pa.Array:
        """Ids of keys, in their order. Those not in the cache are encoded; what is used stays longest."""
        every = keys.dictionary_encode()
        distinct = every.dictionary
        at = pc.index_in(distinct, value_set=self.keys)
        missing = np.asarray(at.is_null())
        new = distinct.filter(pa.array(missing))
        made = self._encode(new)
        place = np.asarray(pc.fill_null(at, 0)).astype(np.int64)
        place[missing] = len(self.keys) + np.arange(len(new))
        values = pa.concat_arrays([self.values, made]).take(pa.array(place))
        short = pc.less_equal(pc.utf8_length(distinct), CACHE_CHARS)
        unused = np.ones(len(self.keys), bool)
        unused[place[~missing]] = False
        old = pa.array(np.flatnonzero(unused)[: max(0, entries - len(distinct))])
        self.keys = pa.concat_arrays([distinct.filter(short), self.keys.take(old)])
        self.values = pa.concat_arrays([values.filter(short), self.values.take(old)])
        return values.take(every.indices)

    def ids(self, texts: pa.Array | list[str | None], entries: int = CACHE_ENTRIES) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers.

        Texts are cut, and equal pieces of a batch found, by Arrow; Python sees each distinct piece once,
        and Arrow puts the ids of all pieces together again.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return []
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if self.words:
            lists = pc.ascii_split_whitespace(column)
        else:  # a line break begins a piece, like a space
            lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        pieces = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        at, names = np.asarray(pieces.indices).astype(np.int64), pieces.dictionary
        rows = len(column)
        slow: dict[int, list[str]] = {}
        if not self.words:
            # after a piece that is empty or ends in white space the next cut isn't safe; such texts are cut one by one
            ending = pc.is_in(pc.utf8_slice_codeunits(names, -1), pa.array([*_SPACES, ""], pa.large_string()))
            odd = np.asarray(pc.or_(ending, pc.match_substring(names, _BARE)))
            if odd.any():
                for i in np.unique(np.repeat(np.arange(rows), np.diff(bounds))[odd[at]]).tolist():
                    slow[i] = byte_level_keys(text) if (text := column[i].as_py()) else []
            # the first piece of a text has no space before it
            first = names.take(pa.array(at[bounds[:-1]]))
            bare = pc.if_else(pc.starts_with(first, "\n"), first, pc.binary_join_element_wise(pa.scalar(_BARE, pa.large_string()), first, pa.scalar("", pa.large_string())))
            at[bounds[:-1]] = len(names) + np.arange(rows)
            names = pa.concat_arrays([names, bare])
        after = len(names)
        if slow:
            names = pa.concat_arrays([names, pa.array([k for ks in slow.values() for k in ks], pa.large_string())])
        known = self._known(names, entries)
        joined = known.take(pa.array(at))
        _, ends, data = joined.buffers()
        ends_of = np.frombuffer(ends, np.int64, len(at) + 1, 8 * joined.offset)[bounds].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        out = [bytes(view[i:j]) for i, j in zip(ends_of, ends_of[1:], strict=False)]
        for i, ks in slow.items():
            out[i] = b"".join(known.slice(after, len(ks)).to_pylist())
            after += len(ks)
        del column, lists, pieces, names, known, joined, ends, data, view
        pa.default_memory_pool().release_unused()
        return out
