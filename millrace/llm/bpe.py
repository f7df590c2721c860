"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Each text is encoded whole. A long text is cut before an ASCII space or line
feed that follows a character which is no white space: no match of the usual
pre-splitting patterns holds white space after its first character unless it
is all white space, so a match never spans such a cut and the ids are those of
the uncut text. That bounds what one call to the library holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, target: int = 1 << 16) -> Iterator[str]:
    """Cuts ``text`` at safe boundaries into pieces of ``target`` characters or a little more."""
    begin = 0
    while len(text) - begin > target:
        at = begin + target
        while at < len(text) and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        yield text[begin:at]
        begin = at
    yield text[begin:]


def encode_text(enc, text: str) -> list[int]:
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def encode(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encodes ``text`` of every row and decodes the ids again.

    Returns doc_id, n_tokens, ids (array, null unless ``keep_ids``), ids_sha256
    and decoded_sha256. A null or empty text has no tokens. Null and repeated
    doc_ids pass through; other columns are not read; no rows give no rows.
    ``rank_file`` must be at the same path on every machine.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                counts, all_ids, id_hashes, byte_hashes = [], [], [], []
                for text in batch.column("text").to_pylist():
                    ids_hash, bytes_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                    for piece in safe_pieces(text or ""):
                        ids = enc.encode_ordinary(piece)
                        if ids:
                            ids_hash.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                        bytes_hash.update(enc.decode_bytes(ids))
                        n += len(ids)
                        if keep_ids:
                            kept += ids
                    counts.append(n)
                    all_ids.append(kept if keep_ids else None)
                    id_hashes.append(ids_hash.hexdigest())
                    byte_hashes.append(bytes_hash.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(all_ids, pa.list_(pa.int32())), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string())],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    )


def decode(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The bytes of each row's ids: doc_id and text_bytes (null ids: no bytes)."""
    id_type = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "text_bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text_bytes binary")
