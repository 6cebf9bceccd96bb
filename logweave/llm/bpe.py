"""Exact BPE encoding by a dynamic program over prefixes, and decoding.

For every prefix of a pre-token the program stores its unique last token. An automaton over the
vocabulary yields all tokens that end at a prefix; a token is the last one if its pair with the last
token of the shorter prefix is compatible, that is, if the merges turn the two tokens' joined text into
just these two. Following the stored tokens back from the whole pre-token emits the ids. Work is linear
in the text, however long a pre-token is.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import fresh, give_back, table
from logweave.llm.token_counts import pieces, tokenizer_path, word_splitter

KNOWN_ENTRIES, KNOWN_PIECE, KNOWN_LETTERED = 700_000, 64, 200_000
#: Rows whose ids are held together in a worker.
ROWS = 500


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class PrefixEncoder:
    """Encoder and decoder of one byte-level BPE file. Texts are handled as their UTF-8 bytes, read as Latin-1."""

    def __init__(self, name: str):
        import ahocorasick

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import pre_tokenizers

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.code = {ord(c): b for b, c in enumerate(byte_letters())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(a.translate(self.code), b.translate(self.code)) for a, b in merges]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.tokens = {i: t.translate(self.code) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw = {i: t.encode("latin-1") for i, t in self.tokens.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.split, self.library_split = word_splitter(), pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        # A token that no merge makes never stands in an encoding.
        made = {a + b for a, b in merges}
        self.automaton = ahocorasick.Automaton()
        for i, token in self.tokens.items():
            if len(token) == 1 or token in made:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.lettered: dict[str, bytes] = {}  # by the letters of the library's cut
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges applied to a short text, lowest rank first, leftmost on ties."""
        parts, rank, none = list(text), self.rank, len(self.rank)
        while len(parts) > 1:
            best = min(rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False))
            if best == none:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, key: int) -> bool:
        """Whether the merges leave two tokens as they are, side by side. The key holds the left one's id plus 1 (0: none) and the right one's."""
        if len(self.fits) > 1_500_000:
            self.fits.clear()
        left, right = divmod(key, 1 << 20)
        pair = [self.tokens[left - 1], self.tokens[right]] if left else [self.tokens[right]]
        fits = self.fits[key] = self.merged("".join(pair)) == pair
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        last = [0] * (len(word) + 1)  # by end: the last token's id plus 1, shifted; at -1, the empty prefix
        size = [0] * len(word)
        fits, compatible, done = self.fits, self.compatible, -1
        for end, (n, token) in self.automaton.iter(word):  # at each end, the longest token first
            if end != done:
                key = last[end - n] | token
                if (ok := fits.get(key)) is None:
                    ok = compatible(key)
                if ok:
                    last[end], size[end], done = (token + 1) << 20, n, end
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append((last[at] >> 20) - 1)
            at -= size[at]
        ids.reverse()
        return ids

    def encode_words(self, piece: str) -> bytes:
        split = self.split(piece)
        if split is None:  # as the library cuts it
            out, lettered = [], self.lettered
            for word, _ in self.library_split(piece):
                ids = lettered.get(word)
                if ids is None:
                    ids = pack(self.encode_word(word.translate(self.code)))
                    if len(word) <= KNOWN_PIECE:
                        if len(lettered) >= KNOWN_LETTERED:
                            lettered.clear()
                        lettered[word] = ids
                out.append(ids)
            return b"".join(out)
        if len(split) == 1:  # known as a piece
            return pack(self.encode_word(piece.encode().decode("latin-1")))
        out, words = [], self.words
        for word in split:
            ids = words.get(word)
            if ids is None:
                ids = pack(self.encode_word(word.encode().decode("latin-1")))
                if len(word) <= KNOWN_PIECE:
                    if len(words) >= KNOWN_ENTRIES:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode_piece(self, piece: str) -> bytes:
        if "<|" not in piece:
            return self.encode_words(piece)
        parts: list = [piece]
        for special, i in self.special.items():
            after = []
            for x in parts:
                if isinstance(x, bytes):
                    after.append(x)
                    continue
                for k, part in enumerate(x.split(special)):
                    after += [pack([i])] * (k > 0) + [part] * bool(part)
            parts = after
        return b"".join(x if isinstance(x, bytes) else self.encode_words(x) for x in parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for piece in pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= KNOWN_PIECE:
                    if len(known) >= KNOWN_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with its token ids (array of long) and the text decoded from them as the last two columns.

    Where ``docs`` has a column of such a name, underscores go before the new one. A null text is encoded as
    the empty text. All rows and columns stay, repeated rows and null ids too; empty tables give empty results.
    """
    ids_name, decoded_name = fresh(docs, ids_col, decoded_col)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # a worker's rows can't have dots in their names
    old = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*old, T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PrefixEncoder(tokenizer)
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                ids = [encoder.encode(t.as_py() or "") for t in rows.column(at)]
                offsets = np.r_[0, np.cumsum([len(i) // 4 for i in ids])].astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
                arrays = [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([encoder.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "ids", "decoded"])
        del encoder
        give_back()

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, ids_name, decoded_name)


def encode_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, for every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PrefixEncoder(tokenizer)
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
