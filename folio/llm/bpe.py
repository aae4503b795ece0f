"""Byte-level BPE over whole corpora by a distinct-word table.

Texts are split into units whose encodings do not depend on their neighbours. Documents travel once, packed and compressed
by the task that reads them, to blocks of bounded size. A block lists its distinct units, sorted, one packed list per part
of the unit hashes; in each part every unit is encoded once, whatever number of blocks has it, and each block gets the ids
of its list in the same order. There every text is the concatenation of its units' ids, in order of position. So the
shuffles hold the texts once and one entry per (block, distinct unit), never one per occurrence, and a unit that occurs
everywhere is one entry per block.

Ids are binary: little-endian unsigned 32-bit integers. Null and empty texts have no ids. Special tokens that are spelled
out in a text become their ids, as the tokenizers library does. Repeated rows stay rows; other columns are carried along,
one named like the result is replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import give_back_memory, parts_for, text_bytes

#: Bytes of text that share one list of distinct units; bounds the memory of a task.
BLOCK_BYTES = 10_000_000
#: Bytes of text for each part of the unit hashes, and in each packed batch of documents.
PART_BYTES = 10_000_000
BATCH_BYTES = 1_000_000
#: The code points that the byte-level splitter takes as white space.
TOKENIZER_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{TOKENIZER_SPACE}]*[^{TOKENIZER_SPACE}]+|[{TOKENIZER_SPACE}]+")
#: Texts with none of these can be cut before each single space.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z|\0")
#: Units of code points below this are split alike by both engines.
MAX_FAST = "\u0250"


@cache
def tokenizer(path: str):
    """The tokenizer of this process, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def special_tokens(path: str) -> tuple[str, ...]:
    """Read from the file: a task that only splits texts has no use for the tokenizer itself."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@cache
def special_pattern(path: str) -> re.Pattern | None:
    names = sorted(special_tokens(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def units(text: str, path: str) -> list[str]:
    """Pieces of the text, in order, whose encodings joined are the encoding of the text."""
    special = special_pattern(path)
    if special and any(t in text for t in special_tokens(path)):
        out: list[str] = []
        for k, part in enumerate(special.split(text)):
            out += [part] if k % 2 else plain_units(part)
        return out
    return plain_units(text)


def plain_units(text: str) -> list[str]:
    if not text:
        return []
    if UNEVEN.search(text):
        return UNIT.findall(text)
    return text.replace(" ", "\0 ").split("\0")


@cache
def merger(path: str):
    """A faster engine for the same merges, where their order is the order of the ids; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(model["vocab"]) - len(merges)
    if any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(merges)):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {piece: i for i, piece in enumerate(pieces(path)[: len(model["vocab"])])}
    return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_units(names: list[str], path: str) -> list[bytes]:
    """Ids of units. Those with letters beyond the Latin blocks, and special tokens, go through the library itself."""
    fast, special = merger(path), set(special_tokens(path))
    found: list[bytes | None] = [None] * len(names)
    rest = []
    for k, name in enumerate(names):
        if fast is not None and (name.isascii() or max(name) < MAX_FAST) and name not in special:
            found[k] = array("I", fast.encode_ordinary(name)).tobytes()
        else:
            rest.append(k)
    for k, e in zip(rest, tokenizer(path).encode_batch([names[k] for k in rest], add_special_tokens=False)):
        found[k] = array("I", e.ids).tobytes()
    return found


def packed_strings(values: list[str]) -> bytes:
    """Strings as their lengths and one run of bytes, compressed."""
    return packed_bytes([v.encode() for v in values])


def packed_bytes(raw: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 3)


def unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], "<u4"), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _packed_documents(column: str, blocks: int):
    """Batches of whole rows as compressed Arrow streams, each dealt to a block by its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if last > first:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                        writer.write_batch(pa.record_batch(batch.slice(first, last - first).columns, schema=batch.schema))
                    raw = sink.getvalue().to_pybytes()
                    block = pa.array([xxhash.xxh3_64_intdigest(raw) % blocks], pa.int32())
                    yield pa.record_batch([block, pa.array([raw], pa.binary())], names=["block", "rows"])

    return run


def _opened(packs: pa.Table) -> Iterator[pa.Table]:
    for raw in packs.column("rows"):
        yield pa.ipc.open_stream(raw.as_buffer()).read_all()


def _lists(packs: pa.Table, column: str, parts: int, path: str) -> list[tuple[int, list[str]]]:
    """The distinct units of a block by part, sorted."""
    seen: set[str] = set()
    for rows in _opened(packs):
        for value in rows.column(column):
            seen.update(units(value.as_py() or "", path))
    by_part: dict[int, list[str]] = {}
    for name in seen:
        by_part.setdefault(zlib.crc32(name.encode()) % parts, []).append(name)
    return [(part, sorted(names)) for part, names in sorted(by_part.items())]


def _asked(column: str, parts: int, path: str):
    def run(key: tuple, packs: pa.Table) -> pa.Table:
        give_back_memory()
        lists = _lists(packs, column, parts, path)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(lists), pa.int32()),
                "part": pa.array([p for p, _ in lists], pa.int32()),
                "units": pa.array([packed_strings(names) for _, names in lists], pa.binary()),
            }
        )

    return run


def _answered(path: str):
    """Each unit of a part encoded once; every block's list answered in its order."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                names = unpacked(batch.column("units")[k].as_py())
                new = [n for n in names if n not in known]
                known.update(zip(new, encode_units([n.decode() for n in new], path)))
                ids = pa.array([packed_bytes([known[n] for n in names])], pa.binary())
                yield pa.record_batch([batch.column("block").slice(k, 1), batch.column("part").slice(k, 1), ids], names=["block", "part", "ids"])

    return run


def _numbered(packs: pa.Table, column: str, path: str) -> tuple[dict[str, int], list[list[array]]]:
    """The distinct units of a block with a number each, and the numbers of every row's units; each text is split once."""
    numbers: dict[str, int] = {}
    rows = []
    for opened in _opened(packs):
        found = []
        for value in opened.column(column):
            names = units(value.as_py() or "", path)
            for name in names:
                if name not in numbers:
                    numbers[name] = len(numbers)
            found.append(array("I", map(numbers.__getitem__, names)))
        rows.append(found)
    return numbers, rows


def _joined(column: str, out: str, parts: int, path: str):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        give_back_memory()
        numbers, rows_units = _numbered(packs, column, path)
        by_part: dict[int, list[str]] = {}
        for name in numbers:
            by_part.setdefault(zlib.crc32(name.encode()) % parts, []).append(name)
        known: list[bytes] = [b""] * len(numbers)
        for part, ids in zip(answers.column("part").to_pylist(), answers.column("ids").to_pylist()):
            for name, found in zip(sorted(by_part.pop(part)), unpacked(ids)):
                known[numbers[name]] = found
        del numbers
        done = []
        for rows, found in zip(_opened(packs), rows_units):
            done.append(rows.append_column(out, pa.array([b"".join(map(known.__getitem__, u)) for u in found], pa.binary())))
        return pa.concat_tables(done)

    return run


def encode(
    docs: DataFrame, path: str, text: str = "text", out: str = "ids", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`docs` with the binary column `out`: the ids of each whole text."""
    docs = docs.drop(out)
    size = text_bytes(docs, text)
    blocks, parts = parts_for(size, block_bytes), parts_for(size, min(PART_BYTES, block_bytes))
    packs = docs.mapInArrow(_packed_documents(text, blocks), "block int, rows binary").repartition(blocks, "block")
    asked = packs.groupBy("block").applyInArrow(_asked(text, parts, path), "block int, part int, units binary")
    answers = asked.groupBy("part").applyInArrow(_answered(path), "block int, part int, ids binary")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joined(text, out, parts, path), schema)


@cache
def pieces(path: str) -> list[bytes]:
    """Bytes of every id: the piece table that decoding joins to; its size is the vocabulary's."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: n for n, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def raw(name: str) -> bytes:
        if all(c in byte_of for c in name):
            return bytes(byte_of[c] for c in name)
        return name.encode()

    return [raw(names[i]) if i in names else b"" for i in range(max(names) + 1)]


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the string column `out`: the ids joined to their pieces; null ids are an empty text."""

    @F.arrow_udf("string")
    def joined(column: pa.Array) -> pa.Array:
        give_back_memory()
        table = pieces(path)
        texts = []
        for value in column:
            raw = value.as_py() or b""
            texts.append(b"".join(map(table.__getitem__, np.frombuffer(raw, "<u4").tolist())).decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    return df.withColumn(out, joined(F.col(ids)))
