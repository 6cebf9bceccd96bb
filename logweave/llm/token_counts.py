"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, encoded once for each distinct piece, and only lengths leave the
worker. A boundary is safe before an ASCII space that follows a character other than white space: no
pre-token of the byte-level pattern spans it and no special token contains a space, so the tokens of
the pieces are the tokens of the text. Distinct new pieces go to the library in batches of at most
``BATCH_BYTES``; lengths of earlier pieces come from a bounded table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import table

BATCH_BYTES = 1 << 20
#: Entries and bytes of the table of known pieces, in one worker.
KNOWN_ENTRIES, KNOWN_PIECE = 400_000, 64
#: Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> list[str]:
    """The text, cut before each ASCII space that follows a character other than white space."""
    if not text:
        return []
    if text[0] != " " and not _AFTER_SPACE.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    return [x for x in _CUT.split(text) if x]


def word_splitter():
    """A function that cuts a piece into pre-tokens; none where that isn't known to be safe.

    Characters from U+0250 on may have another class in another Unicode version, and special tokens must stay whole.
    """
    import regex

    plain, split = re.compile(r"[\x00-\u024f]*").fullmatch, regex.compile(PRE_TOKENS).findall
    return lambda piece: split(piece) if plain(piece) and "<|" not in piece else None


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: a path as given, or the name of a public file on this machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class LengthEncoder:
    """Token counts of texts, with bounded tables of known pieces and pre-tokens."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(tokenizer_path(name))
        self.encode.no_truncation()
        self.encode.no_padding()
        self.split = word_splitter()
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _encode(self, words: list[str]) -> None:
        """Add the lengths of new pre-tokens, in batches of about equal bytes."""
        batch, size = [], 0
        for i, word in enumerate(words, 1):
            batch.append(word)
            size += len(word.encode())
            if size >= BATCH_BYTES or i == len(words):
                self.words.update(zip(batch, map(len, self.encode.encode_batch(batch, add_special_tokens=False)), strict=True))
                batch, size = [], 0

    def lengths(self, texts: list[str | None], sizes: list[int] | None = None) -> list[int]:
        """Token counts of texts; ``sizes`` are their bytes."""
        sizes = sizes or [len((t or "").encode()) for t in texts]
        out: list[int] = []
        at = 0
        while at < len(texts):  # groups of texts of about equal bytes
            group, size = [], 0
            while at < len(texts) and (not group or size < 4 * BATCH_BYTES):
                group.append(pieces(texts[at] or ""))
                size += sizes[at]
                at += 1
            for table_ in (self.known, self.words):
                if len(table_) > KNOWN_ENTRIES:
                    table_.clear()
            known, words = self.known, self.words
            new = {p: self.split(p) or [p] for p in set().union(*group) if p not in known}
            self._encode(list({w for ws in new.values() for w in ws if w not in words}))
            known.update((p, sum(map(words.__getitem__, ws))) for p, ws in new.items())
            out.extend(sum(map(known.__getitem__, g)) for g in group)
            for p in new:  # long pieces aren't worth their memory
                if len(p) > KNOWN_PIECE:
                    del known[p]
                    for w in new[p]:
                        if len(w) > KNOWN_PIECE:
                            words.pop(w, None)
        return out


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, in the rows' own partitions.

    A null text counts as empty (0 tokens); null ids and repeated rows are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or LengthEncoder(tokenizer)
            n = pa.array(encoder.lengths(batch.column(2).to_pylist(), batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
