"""Token ids of whole documents, as pieces of bounded length.

The vocabulary file is a parameter. Where its own normaliser and splitter work word by word (white
space is dropped and no rule looks across it: ``_BY_WORDS``), texts are split and their words
counted into distinct ones by Arrow, a chunk of bounded bytes at a time; distinct words are
tokenised once and kept in a bounded table of the Python worker, and ids are gathered with NumPy.
Other vocabularies encode each text whole. Tests hold both against ``Tokenizer.encode``.

Defined cases: null text counts as empty and gives the single id 1. A text is never cut
except into pieces of ``max_len`` ids, the last of which may be shorter.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, free_memory

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAX_LEN = 4096
TABLE_WORDS = 400_000
CHUNK_BYTES = 4_000_000

# The normaliser and splitter of a vocabulary that works word by word.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
# Signs that, after a letter or digit, form one part with no rule of their own.
_TAIL = ".,!?;:#*$%&|()\"-"


def _byte_signs() -> list[str]:
    """Byte-level alphabet: printable Latin-1 signs stand for themselves, the other bytes for
    the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_SIGNS = _byte_signs()
_ENCODERS: dict[str, "Encoder"] = {}


def _cores_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word without the signs of ``_TAIL`` at its end, and those signs; a word whose rest does
    not end in a letter or digit of ASCII stays whole, with no tail."""
    cores = pc.ascii_rtrim(words, characters=_TAIL)
    cut = pc.and_(pc.not_equal(cores, words), pc.match_substring_regex(cores, "[0-9A-Za-z]$"))
    tails = pc.replace_substring_regex(pc.filter(words, cut), "(?s)^.*[0-9A-Za-z]", "")
    none = pa.array([""], words.type).take(pa.array(np.zeros(len(words), np.int32)))
    return pc.if_else(cut, cores, words), pc.replace_with_mask(none, cut, tails)


class Encoder:
    """Texts -> ids. Words are kept as places in one growing array of ids."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_words = all(parts.get(k) == v for k, v in _BY_WORDS.items())
        self.tokenize = self.tokenizer.model.tokenize
        self.forget()

    @classmethod
    def get(cls, vocabulary: str) -> "Encoder":
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def forget(self) -> None:
        """Empties the table of words."""
        self.words: dict[bytes, int] = {b"": 0}
        self.ids, self.ends = array("I"), array("q", [0])

    def _part(self, part: str) -> list[int]:
        return [t.id for t in self.tokenize(part)]

    def _core(self, core: bytes) -> list[int]:
        """Ids of a word in lower case A-Z."""
        if core.isalpha():  # of bytes: a-z only
            return self._part(core.decode())
        text = core.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            return self._part("".join([_SIGNS[b] for b in text.lower().encode()]))
        t = self.tokenizer
        parts = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        return [i for p, _ in parts for i in self._part(p)]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of the ids of each word; words not met before are tokenised."""
        coded, table = words.dictionary_encode(), self.words
        found = []
        for word in coded.dictionary.cast(pa.binary()).to_pylist():
            place = table.get(word)
            if place is None:
                self.ids.extend(self._core(word))
                self.ends.append(len(self.ids))
                place = table[word] = len(self.ends) - 1
            found.append(place)
        return np.array(found, dtype=np.int64)[np.asarray(coded.indices)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the place after the last id of each text
        (with a leading 0). Null counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = np.ones(len(texts), dtype=bool)
        if self.by_words:  # a special token may stand in any word
            whole = np.asarray(pc.match_substring(texts, "<|"), dtype=bool)
        if whole.any():
            each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4")
                    if w else None for t, w in zip(texts.to_pylist(), whole, strict=True)]
            rest, at = self._by_words(texts.filter(pa.array(~whole)))
            found = iter(range(len(at) - 1))
            each = [rest[at[i]:at[i + 1]] if x is None and (i := next(found)) >= 0 else x for x in each]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        return self._by_words(texts)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if len(self.words) >= TABLE_WORDS:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        cores, tails = _cores_and_tails(coded.dictionary)
        parts = np.stack([self._places(cores), self._places(tails)], axis=1)
        ends = np.array(self.ends, dtype=np.int64)
        ids = np.array(self.ids, dtype="<u4")
        place = parts[np.asarray(coded.indices)].ravel()
        low = np.concatenate([[0], ends[:-1]])[place]
        size = ends[place] - low
        after = np.cumsum(size)
        take = np.arange(int(after[-1]) if len(after) else 0)
        take += np.repeat(low - (after - size), size)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        return ids[take], np.concatenate([[0], after[1::2]])[offsets - offsets[0]]

    def encode(self, text: str) -> bytes:
        ids, _ = self.encode_column(pa.array([text], pa.string()))
        return ids.tobytes()


def encoded_texts(texts: pa.Array, vocabulary: str, end_id: int | None):
    """Ids of each text, with the end id, as little-endian unsigned 32-bit bytes, in order."""
    encoder = Encoder.get(vocabulary)
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    for chunk in byte_chunks(texts, CHUNK_BYTES):
        ids, at = encoder.encode_column(chunk)
        for i in range(len(chunk)):
            yield ids[at[i]:at[i + 1]].tobytes() + end


def _pieces(batches, vocabulary: str, end_id: int | None, max_len: int, schema: pa.Schema):
    width = 4 * max_len
    for batch in batches:
        ids = batch.column(0)
        at, piece, start, length, out = [], [], [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(out, pa.binary())], schema=schema)

        held = 0
        for row, data in enumerate(encoded_texts(batch.column(1), vocabulary, end_id)):
            for p in range(-(-len(data) // width)):
                part = data[p * width:(p + 1) * width]
                at.append(row), piece.append(p), start.append(p * max_len)
                length.append(len(part) // 4), out.append(part)
                held += len(part)
            if held > CHUNK_BYTES:
                yield flush()
                at, piece, start, length, out, held = [], [], [], [], [], 0
        yield flush()
    Encoder.get(vocabulary).forget()
    free_memory()


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: str = VOCABULARY, end_id: int | None = END_ID,
                     max_len: int = MAX_LEN) -> DataFrame:
    """Rows ``id, piece, start, length, ids`` (ids: little-endian unsigned 32-bit)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    out = StructType([narrow.schema["id"], StructField("piece", IntegerType()),
                      StructField("start", LongType()), StructField("length", LongType()),
                      StructField("ids", BinaryType())])
    arrow = to_arrow_schema(out)
    return narrow.mapInArrow(lambda it: _pieces(it, vocabulary, end_id, max_len, arrow), out)
