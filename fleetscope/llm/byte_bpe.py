"""Byte-level BPE with the tiktoken library and a local rank file.

The rank file and the pre-split pattern are parameters; each Python worker loads the file
once. Long texts are cut where no match of the pattern can span, between a letter or digit
and a following blank or newline, so that the library never sees an unbounded string; ids
and bytes of the pieces are hashed as they come.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import tiktoken
from pyspark.sql import DataFrame

from fleetscope.llm.common import map_rows

#: Characters of a piece, about.
PIECE = 100_000
#: White space starts a match and never stands behind the letters of one.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The file holds lines of base64 bytes and rank."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _decimals(rank_file: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(rank_file, pattern).n_vocab)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive parts of text of about size characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, rank_file: str, pattern: str, size: int = PIECE) -> list[int]:
    own = encoding(rank_file, pattern)
    return [i for part in pieces(text or "", size) for i in own.encode_ordinary(part)]


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """Raw bytes: ids may end within a character."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def _encoded(rows: Iterable[tuple], rank_file: str, pattern: str) -> Iterator[tuple]:
    for doc_id, text in rows:
        ids = encode(text, rank_file, pattern)
        yield doc_id, ids


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of docs; null and empty texts have no ids."""
    return map_rows(
        docs.select("doc_id", "text"),
        partial(_encoded, rank_file=rank_file, pattern=pattern),
        "doc_id bigint, ids array<int>",
    )


def _decoded(rows: Iterable[tuple], rank_file: str, pattern: str) -> Iterator[tuple]:
    for doc_id, ids in rows:
        yield doc_id, decode(ids or [], rank_file, pattern).decode("utf-8", "replace")


def decoded(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    return map_rows(
        rows.select("doc_id", "ids"),
        partial(_decoded, rank_file=rank_file, pattern=pattern),
        "doc_id bigint, text string",
    )


def _digests(rows: Iterable[tuple], rank_file: str, pattern: str) -> Iterator[tuple]:
    own, names = encoding(rank_file, pattern), _decimals(rank_file, pattern)
    for doc_id, text in rows:
        of_ids, of_bytes, n = hashlib.sha256(), hashlib.sha256(), 0
        for part in pieces(text or ""):
            ids = own.encode_ordinary(part)
            if not ids:
                continue
            of_ids.update((" " * (n > 0) + " ".join([names[i] for i in ids])).encode())
            of_bytes.update(own.decode_bytes(ids))
            n += len(ids)
        yield doc_id, n, of_ids.hexdigest(), of_bytes.hexdigest()


def token_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs.

    Ids are those of encode(); the decoded bytes come from the ids. Null counts as the
    empty text. Repeated rows stay repeated; other columns are not read.
    """
    return map_rows(
        docs.select("doc_id", "text"),
        partial(_digests, rank_file=rank_file, pattern=pattern),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
