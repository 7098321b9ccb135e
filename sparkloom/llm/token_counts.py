"""Token counts of texts of any size.

A text of up to ``chunk`` characters is counted by its units (runs without white space), of which equal ones are encoded
once: the vocabulary's normalizer and pattern drop white space and never look across it. A longer text is encoded in overlapping
chunks with offsets. In an overlap both encodings must agree on a boundary: a place where the pattern ends a match whatever stands around, a token starting there in
both, and equal ids and offsets around it. There the counts are spliced. An overlap without such a place is widened, twofold each time;
where the whole chunk has none, it is taken twice as long, so the work stays in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import WHITE
from sparkloom.llm.common import one_thread, table, unused

UNIT = re.compile(f"[^{WHITE}]+")
CACHE_UNITS, CACHE_CHARS, SLICE = 400_000, 48, 64
#: Characters of a chunk and of an overlap at first, and tokens that must agree on either side of a splice.
CHUNK, OVERLAP, AGREE = 32_768, 256, 3

#: Characters that no composition joins to what stands before them: neither marks nor later parts of a syllable.
_ALONE = r"[^\p{M}\u1160-\u11FF\uD7B0-\uD7FF]"
#: Places where the pattern (runs of letters, single numbers, runs of others, and endings behind an apostrophe) begins a match in every context: after white space, around a
#: number, and where letters and others meet, but for letters behind an apostrophe. A mark may belong to the letter before it, so nothing is said behind one, nor behind the one capital
#: whose small form ends with a mark.
BOUNDARY = regex.compile(rf"(?={_ALONE})(?:(?<=[{WHITE}\p{{N}}])[^{WHITE}]|\p{{N}}|(?<=\p{{L}})(?<!\u0130)[^{WHITE}\p{{L}}\p{{N}}]|(?<=[^{WHITE}\p{{L}}\p{{N}}\p{{M}}'])\p{{L}})")

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        one_thread()
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[path] = made, {}
    return _TOKENIZERS[path]


def boundaries(text: str, lo: int, hi: int, margin: int = 0) -> set[int]:
    """Places in text[lo:hi] where a match of the pattern begins whatever stands around, ``margin`` or more from either end."""
    return {m.start() for m in BOUNDARY.finditer(text, max(1, lo + margin), max(1, hi - margin), overlapped=True)}


def splice(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], lo: int, hi: int, proven: set[int]) -> tuple[int, int] | None:
    """Indexes in left and right of the same token, the first after a proven boundary in the overlap from lo to hi on which both agree.

    Tokens are (start, end, id) with starts in the whole text. The boundary nearest the middle of the overlap is taken.
    """
    at = {t[0]: i for i, t in enumerate(left) if t[0] in proven and (i == 0 or left[i - 1][1] <= t[0])}
    middle, best = (lo + hi) / 2, None
    for j, (start, _, _) in enumerate(right):
        if start >= hi:
            break
        i = at.get(start)
        if i is None or j and right[j - 1][1] > start:
            continue
        back = min(AGREE, i, j)  # at its first token, the right chunk has nothing before to compare
        if left[i - back : i + AGREE] == right[j - back : j + AGREE] and (best is None or abs(start - middle) < abs(best[0] - middle)):
            best = start, i, j
    return best and best[1:]


def count_long(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = 0) -> int:
    """Tokens of one text by spliced chunks. encode: gives (start, end, id) of each token of a string; margin: the length of the longest special string, which no boundary may be inside."""

    def tokens(a: int, b: int) -> list[tuple[int, int, int]]:
        return [(s + a, e + a, i) for s, e, i in encode(text[a:b])]

    begin, end = 0, min(len(text), chunk)
    left, first, total = tokens(begin, end), 0, 0  # first: the tokens of left before it are counted
    while end < len(text):
        width = overlap
        while (start := end - width) > begin:
            proven = boundaries(text, start, end, margin)
            if proven:
                stop = min(len(text), end + chunk)
                right = tokens(start, stop)
                found = splice(left, right, start, end, proven)
                if found and found[0] >= first:
                    total += found[0] - first
                    begin, end, left, first = start, stop, right, found[1]
                    break
            width *= 2
        else:  # nothing agrees in the whole chunk: take it twice as long
            taken = left[first][0] if 0 < first < len(left) else None
            end = min(len(text), begin + 2 * (end - begin))
            left = tokens(begin, end)
            if taken is not None:
                first = next(i for i, t in enumerate(left) if t[0] >= taken)
    return total + len(left) - first


def _counter(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = tokenizer(path)
        margin = max((len(t.content) for t in own.get_added_tokens_decoder().values()), default=0)

        def spans(part: str) -> list[tuple[int, int, int]]:
            found = own.encode(part, add_special_tokens=False)
            return [(a, b, i) for (a, b), i in zip(found.offsets, found.ids, strict=True)]

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                units = [UNIT.findall(t) if len(t) <= chunk else [] for t in texts]
                if len(known) > CACHE_UNITS:
                    known.clear()
                fresh = list(set().union(*units).difference(known))
                for j in range(0, len(fresh), 4096):
                    some = fresh[j : j + 4096]
                    known.update(zip(some, map(len, own.encode_batch_fast(some, add_special_tokens=False)), strict=True))
                counts = [sum(map(known.__getitem__, x)) if len(t) <= chunk else count_long(t, spans, chunk, overlap, margin) for t, x in zip(texts, units, strict=True)]
                for u in fresh:
                    if len(u) > CACHE_CHARS:
                        del known[u]
                keep = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(counts, type=pa.int64())], names=[*part.schema.names[:-1], "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``keep`` (all of df's without it) and n_tokens, the tokens of the whole text without added special ones.

    path: a file of the tokenizers library whose normalizer composes characters, lower-cases and joins white space at most, and whose pattern is that of BOUNDARY (on every executor).
    Special strings inside texts become their special tokens, as is the library's default. A null text counts as empty and has no
    tokens; repeated rows stay; an empty table gives an empty one; a column n_tokens of df is replaced; no other name clashes. No shuffle; a task holds 64 texts at a time.
    Only a run of letters without an end is held as one, as nothing proves a boundary inside it.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != "n_tokens"]
    (last,) = unused(df, "counted_text")
    given = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(last))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "n_tokens bigint"])
    return given.mapInArrow(_counter(path, chunk, overlap), schema)


#: Tokens of a context; a text with more is over the limit.
LIMIT = 2048


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents with their bytes and tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    counted = count_tokens(sized, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
