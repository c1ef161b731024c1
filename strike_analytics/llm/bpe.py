"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

The library's model works on characters, so every byte stands for one
printable character (the byte-to-character map below). The encoder is built
from a file of byte ranks: each rank's bytes become a vocabulary entry in that
alphabet, and its merge is found by merging its bytes under the lower ranks.
Decoding looks every id's bytes up in the reversed map and joins them before
any character is formed, so a character split over several tokens comes back.

Texts are encoded in Arrow batches. Without offsets a text is cut at single
spaces between two other characters; the split pattern never looks to the left
and always begins a match at such a space, so the pieces encode as the text
does (tested). A piece is split into its pre-tokens, each is spelled in the
model's alphabet, and the library's model tokenizes it. Pieces are remembered,
by worker, in two tables of bounded size: a full one becomes the older one,
and what is asked for again moves back. Encoding cost follows the number of
different pieces. With offsets the library gets whole texts.

Scale: one pass, no shuffle; memory follows ``common.slices``, not the batch
or the longest text.

Defined results: null and empty texts have no tokens; repeated rows are each
encoded; the ranks know no special tokens, so their strings are ordinary text;
a tokenizer's file may have some, whose strings in a text become their ids, as
the library has it; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strike_analytics.llm.common import map_texts, read_table

RANKS = "byte_bpe_50k.tiktoken"

#: Different pieces, and pre-tokens, that a worker remembers, and the longest one (characters).
REMEMBERED, PIECE = 500_000, 64


def byte_characters() -> list[str]:
    """The character for each byte: itself if printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge gives ``token``; None if lower ranks don't lead to two."""
    parts, limit = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= limit:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def tokenizer_from_ranks(path: str, pattern: str):
    """A ``tokenizers.Tokenizer`` that gives the ranks as ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core only
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    spelled = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(spelled[m[0]], spelled[m[1]]) for t in sorted(ranks, key=ranks.get) if (m := merge_of(t, ranks))]
    made = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=4)
def tokenizer_from_file(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id, by the reversed byte map from the vocabulary's spelling."""
    ranks, chars = read_ranks(path), byte_characters()
    back = {c: b for b, c in enumerate(chars)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelled = "".join(chars[b] for b in token)
        table[rank] = bytes(back[c] for c in spelled)
    return table


def decode(ids: np.ndarray | list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


#: White space other than space and line feed.
_RARE = [chr(c) for c in (*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680,
                          *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_MARKS = frozenset(".,;:!?")
#: A space that no pre-token spans: other characters, not white space, on both sides.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """``text`` cut at single spaces, which are left out."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RARE):
        return _CUT.split(text)
    return text.split(" ")


class PieceEncoder:
    """Encodes texts by their pieces; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, pattern: str):
        self.tokenizer, self.tokenize, self.split = tokenizer, tokenizer.model.tokenize, regex.compile(pattern).findall
        self.spell = dict(enumerate(byte_characters()))
        self.space = self.spell[0x20]
        self.known: dict[str, bytes] = {}  # pieces behind a space
        self.before: dict[str, bytes] = {}  # the table before this one
        self.tokens: dict[str, bytes] = {}  # pre-tokens that are no word behind a space
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _pretoken(self, text: str) -> bytes:
        made = self._ids(text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spell))
        if len(text) <= PIECE:
            if len(self.tokens) >= REMEMBERED:
                self.tokens.clear()
            self.tokens[text] = made
        return made

    def _piece(self, text: str) -> bytes:
        get = self.tokens.get
        return b"".join([get(p) or self._pretoken(p) for p in self.split(text)])

    def _word(self, word: str) -> bytes:
        """A space and a word of letters."""
        if word.isascii():
            return self._ids(self.space + word)
        return self._ids(self.space + word.encode().decode("latin-1").translate(self.spell))

    def _new(self, piece: str) -> bytes:
        """A space and ``piece``. Most are a word, a word and one mark, or such a
        one before a new line; those need no pattern."""
        made = self.before.get(piece)
        if made is None:
            get = self.tokens.get
            line, new, rest = piece.partition("\n")
            if piece.isalpha():
                made = self._word(piece)
            elif piece[-1] in _MARKS and piece[:-1].isalpha():
                made = (self.known.get(piece[:-1]) or self._new(piece[:-1])) + (get(piece[-1]) or self._pretoken(piece[-1]))
            elif line[-1:] in _MARKS and line[:-1].isalpha() and rest and not rest[0].isspace():
                made = (self.known.get(line) or self._new(line)) + (get(new) or self._pretoken(new)) + self._piece(rest)
            else:
                made = self._piece(" " + piece)
        if len(piece) <= PIECE:
            if len(self.known) >= REMEMBERED:
                self.before, self.known = self.known, {}
            self.known[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):  # the library looks for these before anything else
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        first, *rest = pieces(text)
        get = self.known.get
        found = list(map(get, rest))
        if None in found:
            found = [made or self.known.get(piece) or self._new(piece) for piece, made in zip(rest, found)]
        return self._piece(first) + b"".join(found)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


@lru_cache(maxsize=4)
def encoder_from_ranks(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(tokenizer_from_ranks(path, pattern), pattern)


@lru_cache(maxsize=4)
def encoder_from_file(path: str) -> Callable[[list[str]], list[bytes]]:
    """By pieces if the file's tokenizer is plain byte-level BPE, else by whole texts."""
    tokenizer = tokenizer_from_file(path)
    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    plain = (made["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"]
             and before["use_regex"] and made["model"]["type"] == "BPE" and not made["model"]["dropout"])
    if plain:
        return PieceEncoder(tokenizer, public_tokenizers.PATTERN)
    return lambda texts: [np.array(e.ids, "<u4").tobytes()
                          for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str], offsets: bool = False) -> DataFrame:
    """``carry`` and ``ids`` (array of int); with ``offsets`` also ``starts``
    and ``ends``, the characters each token covers (a token inside a character
    covers that character)."""
    def rows(texts: list[str]) -> dict[str, list]:
        if not offsets:
            return {"ids": [np.frombuffer(b, "<u4").astype(np.int32)
                            for b in encoder_from_ranks(ranks_path, pattern)(texts)]}
        made = tokenizer_from_ranks(ranks_path, pattern).encode_batch(texts, add_special_tokens=False)
        return {"ids": [e.ids for e in made], "starts": [[a for a, _ in e.offsets] for e in made],
                "ends": [[b for _, b in e.offsets] for e in made]}

    ints = ("array<int>", pa.list_(pa.int32()))
    return map_texts(docs, carry, rows, {"ids": ints} | ({"starts": ints, "ends": ints} if offsets else {}), 1 << 18)


def decode_ids(df: DataFrame, ranks_path: str) -> DataFrame:
    """``df`` with ``text``, decoded from its column ``ids``, in place of any
    column of that name; bytes that form no character become U+FFFD. A null list stays null."""
    df = df.drop(*(c for c in df.columns if c.lower() == "text"))

    def run(batches):
        table = byte_table(ranks_path)
        for batch in batches:
            made = [None if ids is None else decode(ids, table).decode("utf-8", "replace")
                    for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             schema=batch.schema.append(pa.field("text", pa.string())))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes every text and decodes its ids: doc_id, n_tokens, the SHA-256 of
    the ids as little-endian unsigned 32-bit integers and of the decoded bytes."""
    def rows(texts: list[str]) -> dict[str, list]:
        table = byte_table(ranks_path)
        encoded = encoder_from_ranks(ranks_path, pattern)(texts)
        return {"n_tokens": [len(b) // 4 for b in encoded],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in encoded],
                "decoded_sha256": [hashlib.sha256(decode(np.frombuffer(b, "<u4"), table)).hexdigest() for b in encoded]}

    text = ("string", pa.string())
    return map_texts(docs, ["doc_id"], rows,
                     {"n_tokens": ("long", pa.int64()), "ids_sha256": text, "decoded_sha256": text})


def op3_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Every document's text, encoded and decoded."""
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)
