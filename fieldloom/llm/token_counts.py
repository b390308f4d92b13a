"""Operator 1: token counts by a map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text's token count is the sum
of its pre-tokens' lengths.  Tier one is a broadcast hash table of the lengths of
frequent pre-tokens: the vocabulary's own whole pre-tokens, which are the frequent
ones of the corpus that the merges come from.  It has at most as many entries as the
vocabulary, whatever the data's size.  Tier two is a bounded cache in each Python
worker, filled by encoding misses in batches.  No row leaves its task: there is no
shuffle, no pre-token is ever exchanged, and a lost executor costs only its tasks.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldloom.llm.common import named, packed

#: Fixed value: the pattern that splits text before byte-level merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's cache holds beside the broadcast table before it is emptied.
CACHE_ENTRIES = 400_000
#: Characters whose pre-tokens are held at once.
CHUNK_CHARS = 1_000_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _worker_table(path: str) -> dict:
    """This worker's lengths: the broadcast tier and, over it, the cache."""
    return {}


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths, as the library gives them, of the vocabulary's whole pre-tokens."""
    tok, pat = _tokenizer(path), regex.compile(PRE_TOKEN)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    found = (tok.decode([i], skip_special_tokens=False) for w, i in tok.get_vocab().items() if w not in special)
    whole = sorted({s for s in found if "�" not in s and (m := pat.match(s)) and m.end() == len(s)})
    return {s: len(e) for s, e in zip(whole, tok.encode_batch(whole, add_special_tokens=False), strict=True)}


def pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Consecutive parts of a long text, cut where no pre-token can reach across.

    A space between two characters that are no white space always starts a pre-token.
    Where there is no such space, the part grows until there is one.
    """
    start = 0
    while len(text) - start > size:
        at = start + size
        while (at := text.find(" ", at)) >= 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Counter:
    """Counts the tokens of texts in one worker, chunk by chunk."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tok, self.pat = _tokenizer(path), regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True))) or r"(?!)")
        self.frequent, self.lengths = frequent, _worker_table(path)
        # Characters that are newer than the pattern library's tables: the tokenizer may know them.
        self.newer, self.odd = regex.compile(r"\p{Cn}"), set()
        if not self.lengths:
            self.lengths.update(frequent)

    def _learn(self, lists: list[list[str]]) -> None:
        """Lengths of all pre-tokens of the lists; what has newer characters is only noted."""
        seen = set().union(*lists)
        self.odd = {t for t in seen if t not in self.lengths and self.newer.search(t)}
        seen -= self.odd
        misses = [t for t in seen if t not in self.lengths]
        if len(self.lengths) + len(misses) > len(self.frequent) + CACHE_ENTRIES:
            self.lengths.clear()
            self.lengths.update(self.frequent)
            misses = [t for t in seen if t not in self.lengths]
        self.lengths.update((t, len(e)) for t, e in zip(misses, self.tok.encode_batch_fast(misses, add_special_tokens=False), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, str, list[str]]] = []
        chars = 0

        def settle() -> None:
            self._learn([t for _, _, t in held])
            for k, part, tokens in held:
                if self.odd and not self.odd.isdisjoint(tokens):
                    out[k] += len(self.tok.encode(part, add_special_tokens=False))
                else:
                    out[k] += sum(map(self.lengths.__getitem__, tokens))
            held.clear()

        for k, text in enumerate(texts):
            parts = self.special.split(text)
            out[k] = len(parts) - 1
            for part in (p for whole in parts for p in pieces(whole)):
                held.append((k, part, self.pat.findall(part)))
                chars += len(part)
                if chars >= CHUNK_CHARS:
                    settle()
                    chars = 0
        settle()
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in place of the text.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows each keep their
    row; an empty table gives an empty one; every other column stays as it is, but for
    columns that bear one of the three result names, which the results replace.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer_path))
    kept = [f for f in docs.schema if f.name.lower() not in (text.lower(), "n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        counter = Counter(tokenizer_path, frequent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            columns = [*batch.column(0).flatten(), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(packed(docs, text, "n_bytes", "n_tokens", "over_limit"), named(text).alias("text"))
    return rows.mapInArrow(run, schema)
