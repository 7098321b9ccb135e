"""Byte-level BPE by rank file: encoding, offsets and decoding over Arrow batches.

The tokenizers library does the merges. Its vocabulary holds printable characters, so each byte has a character
of the usual byte table, and every pair of vocabulary entries that makes a third is a merge, ordered by rank and then
by the longer left part: together with ``ignore_merges`` that is the rule "merge the adjacent pair of lowest rank".

A white-space run that follows other characters always begins a new match of the pattern, and no alternative looks
behind. So a unit (white space and the characters after it) has the same ids wherever it stands. Texts are cut into units,
equal units of a task are encoded once, and a text of any length needs memory for its ids only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import one_thread, table, unused

#: The characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Units kept in a worker, longest kept unit in characters, and rows taken from a batch at a time.
CACHE_UNITS, CACHE_CHARS, SLICE = 300_000, 48, 64


def byte_table() -> dict[int, str]:
    """Each byte's character: itself where it is printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        one_thread()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        chars = byte_table()
        name = {b: "".join(chars[x] for x in b) for b in ranks}
        merges = [
            (name[b[:i]], name[b[i:]])
            for b in sorted(ranks, key=ranks.get)
            for i in range(len(b) - 1, 0, -1)
            if b[:i] in ranks and b[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[b]: r for b, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in chars.items()}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, rank in ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in name[b])
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, bytes] = {}  # ids of four bytes each

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        units = [UNIT.findall(t) for t in texts]
        known = self.known
        if len(known) > CACHE_UNITS:
            known.clear()
        fresh = list(set().union(*units).difference(known))
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            known.update(zip(part, [array("i", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), dtype=np.int32).tolist() for own in units]
        for u in fresh:
            if len(u) > CACHE_CHARS:
                del known[u]
        return out

    def decode(self, ids) -> bytes:
        """The bytes of the ids; a character split over ids becomes whole again, as only bytes are joined."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Start and end in code points of every id; the ids that share one split character all span it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[np.asarray(ids, dtype=np.int64)])
        starts = ends - self.lengths[np.asarray(ids, dtype=np.int64)]
        return (char[starts], char[ends - 1] + 1) if len(ends) else (ends, ends)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """A worker's only Codec of that file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


#: What encode() can return: name and type.
OUTPUTS = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def _encoder(path: str, pattern: str, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                keep = [part.column(i) for i in range(part.num_columns - 1)]
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                found: dict[str, list] = {name: [] for name in outputs}
                for text, ids in zip(texts, own.encode_batch(texts), strict=True):
                    raw = own.decode(ids) if "decoded" in found or "decoded_sha256" in found else b""
                    span = own.offsets(text, ids) if "starts" in found or "ends" in found else None
                    for name, column in found.items():
                        if name == "ids":
                            column.append(ids)
                        elif name == "n_tokens":
                            column.append(len(ids))
                        elif name == "ids_sha256":
                            column.append(hashlib.sha256(",".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
                        elif name == "decoded":
                            column.append(raw)
                        elif name == "decoded_sha256":
                            column.append(hashlib.sha256(raw).hexdigest())
                        else:
                            column.append(span[name == "ends"])
                kinds = {"array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
                made = [pa.array(found[n], type=kinds[OUTPUTS[n]]) for n in outputs]
                yield pa.RecordBatch.from_arrays(keep + made, names=[*part.schema.names[:-1], *outputs])

    return run


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "starts", "ends"), keep: list[str] | None = None) -> DataFrame:
    """Encode the whole text of every row and return the columns of ``keep`` (all of df's without it) and those of ``outputs``.

    path and pattern: the rank file (on every executor) and the expression that splits texts. Without special tokens: their
    strings are ordinary text. A null text counts as empty and gives no ids; rows that repeat stay; an empty table gives an
    empty one. A column of df with the name of an output is replaced by the output. No shuffle; a task holds 64 texts at a time.
    """
    names = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    (last,) = unused(df, "encoded_text")
    given = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(last))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), *(f"{n} {OUTPUTS[n]}" for n in outputs)])
    return given.mapInArrow(_encoder(path, pattern, tuple(outputs)), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for, as column ``out``; a null array gives a null.

    The bytes of a whole text are joined before anything reads them as characters, so split characters come back whole.
    """

    @F.arrow_udf("binary")
    def unpack(column: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([None if x is None else own.decode(x) for x in column.to_pylist()], type=pa.binary())

    return df.withColumn(out, unpack(F.col(f"`{ids}`")))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded; digests of ids and bytes."""
    import public_tokenizers

    return encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
        keep=["doc_id"],
    )
