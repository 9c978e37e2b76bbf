"""Token counts with a whole-token shortcut.

The vocabulary strings that the library itself encodes alone to exactly one token are found once
per worker process.  A pre-token among them costs one token; only other pre-tokens go through the
merges, and their counts are remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counts(dict):
    """Tokens of a pre-token.  Proven strings stay; merged ones are kept up to ``most`` strings."""

    def __init__(self, proven: dict[str, int], merge, most: int = 400_000):
        super().__init__(proven)
        self.proven, self.merge, self.most = proven, merge, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most + len(self.proven):
            self.clear()
            self.update(self.proven)
        n = self[piece] = self.merge(piece)
        return n


class WholeTokens:
    """Counts equal to ``len(tokenizer.encode(text, add_special_tokens=False))``.

    Texts within Latin-1 are cut by an equivalent pattern (checked against the library for every
    such character in the tests).  Other texts use the library's own normaliser and pre-tokeniser.
    Strings of special tokens are one token each, as the library matches them in raw text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.table = {b: c for b, c in letters.items() if chr(b) != c}
        proven = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token.endswith(WORD_END):
                try:
                    proven[bytes(back[c] for c in token.removesuffix(WORD_END)).decode()] = i
                except (KeyError, UnicodeDecodeError):
                    continue
        alone = self.tokenizer.encode_batch(list(proven), add_special_tokens=False)
        # A string that the normaliser changes or drops is not itself a pre-token.
        whole = {s: 1 for (s, i), e in zip(proven.items(), alone) if e.ids == [i]}
        self.plain = Counts(whole, self._merge)
        self.mapped = Counts({self._letters(s): 1 for s in whole}, self._merge_mapped)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        letter = "".join(c for c in map(chr, range(256)) if c.isalpha())
        number = "".join(c for c in map(chr, range(256)) if c.isnumeric())
        space = "\t\n\x0b\x0c\r \x85\xa0"
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{re.escape(space + number)}{letter}]+"
        ).findall

    def _letters(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.table)

    def _merge_mapped(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize(piece))

    def _merge(self, piece: str) -> int:
        return self._merge_mapped(self._letters(piece))

    def _part(self, text: str) -> int:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.tokenizer.normalizer.normalize_str(text)
            return sum(self.mapped[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return sum(map(self.plain.__getitem__, self.cut(text.lower())))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._part(text)
        return sum(map(self._part, self.special.split(text))) + len(self.special.findall(text))


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    limit: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, whole texts, no shuffle.

    ``tokenizer`` is a byte-level BPE file with word ends of the public tokenizer folder, which
    each worker opens itself.  Null and empty texts have 0 bytes and 0 tokens; a null id stays
    null; repeated rows give repeated rows; other columns are not read, so their names can't
    clash; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = whole_tokens(public_tokenizers.path(tokenizer)).count
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = np.fromiter((count(x.as_py()) for x in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
