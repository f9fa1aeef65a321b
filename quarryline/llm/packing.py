"""Bounded-space packing of tokenized documents into training sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut

#: Fixed value: the pre-tokenization pattern of the byte-level BPE vocabulary.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.binary()]
#: A space between white space and white space or the end: there, words can't be cut before spaces.
_LOOSE_SPACE = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)")


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the usual rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def added_pattern(tokens: list[dict]) -> re.Pattern | None:
    """Matches the added tokens of a tokenizers file in raw text, the longest first, each in a group of its own."""
    def one(t: dict) -> str:
        word = r"(?<!\w){}(?!\w)" if t.get("single_word") else "{}"
        return (r"\s*" if t.get("lstrip") else "") + "(" + word.format(re.escape(t["content"])) + ")" + (r"\s*" if t.get("rstrip") else "")

    return re.compile("|".join(map(one, tokens))) if tokens else None


class ByteEncoder:
    """Ids of a tokenizers byte-level BPE file, through a bounded memory of words.

    With added, strings of the file's added tokens get those tokens' ids, as in the library; else they are ordinary text.
    """

    def __init__(self, path: str, most_words: int = 400_000, *, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, letters = {t["content"] for t in spec["added_tokens"]}, byte_level_alphabet()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = sorted(spec["added_tokens"], key=lambda t: -len(t["content"])) if added else []
        self.added, self.added_ids = added_pattern(tokens), [np.array([t["id"]], "<u4").tobytes() for t in tokens]
        self.words: dict[str, bytes] = {}
        self.most_words = most_words

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self._plain(text[at : m.start()]), self.added_ids[m.lastindex - 1]
            at = m.end()
        return b"".join(out) + self._plain(text[at:])

    def _plain(self, text: str) -> bytes:
        """Ids of text without added tokens. Words are cut before single spaces, where no token crosses."""
        if not text:
            return b""
        if _LOOSE_SPACE.search(text):
            return self._ids(text)
        head, *rest = text.split(" ")
        words = self.words
        try:
            return self._ids(head) + b"".join(map(words.__getitem__, rest))
        except KeyError:
            if len(words) > self.most_words:
                words.clear()
            for w in rest:
                if w not in words:
                    words[w] = self._ids(" " + w)
            return self._ids(head) + b"".join(map(words.__getitem__, rest))


class _Rows:
    def __init__(self):
        self.columns = [[] for _ in _NAMES]

    def add(self, *values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, _TYPES, strict=True)], _NAMES)


def _pack(tokenizer_path: str, length: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, opened, count = ByteEncoder(tokenizer_path, added=True), TaskContext.get().partitionId(), [], 0
        end = np.array([0], "<u4").tobytes()

        def window() -> dict:
            nonlocal count
            count += 1
            return {"id": (part << 34) | (count - 1), "used": 0, "pieces": []}

        def put(w: dict, doc, start: int, data: bytes, total: int) -> None:
            w["pieces"].append((doc, start, data, total, w["used"]))
            w["used"] += len(data) // 4

        def emit(rows: _Rows, w: dict, last: bool = False) -> None:
            for doc, start, data, total, offset in w["pieces"]:
                rows.add(doc, start, len(data) // 4, zlib.crc32(data), total, w["id"], offset, data if last else None)

        for batch in batches:
            rows = _Rows()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = encode(text.as_py() or "") + end
                total, start = len(data) // 4, 0
                while total - start >= length:
                    put(w := window(), doc, start, data[4 * start : 4 * (start + length)], total)
                    emit(rows, w)
                    start += length
                while start < total:
                    rest = total - start
                    fits = [w for w in opened if length - w["used"] >= rest]
                    if fits:
                        w = min(fits, key=lambda w: length - w["used"])
                    elif len(opened) < windows:
                        opened.append(w := window())
                    else:  # none fits: the fullest is filled up and goes
                        w = max(opened, key=lambda w: w["used"])
                    take = min(rest, length - w["used"])
                    put(w, doc, start, data[4 * start : 4 * (start + take)], total)
                    start += take
                    if w["used"] == length:
                        emit(rows, w)
                        opened = [x for x in opened if x is not w]
            yield rows.batch()
        rows = _Rows()
        for w in opened:
            emit(rows, w, last=True)
        yield rows.batch()

    return run


def _merge_leftovers(length: int):
    """Rows sorted by group: their pieces fill windows one after another; a group's last window is cut at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, used, count = None, [], 0, 0
        last = 2**60

        def emit(rows: _Rows, bounds: list[int]) -> None:
            """Close the window: pieces between bounds make a sequence each."""
            nonlocal held, used, count
            at = 0
            cuts = iter(bounds)
            size, filled = next(cuts), 0
            for doc, start, data, total in held:
                while data:
                    take = min(len(data) // 4, size - filled)
                    rows.add(doc, start, take, zlib.crc32(data[: 4 * take]), total, last | (group << 24) | count, filled, None)
                    data, start, filled = data[4 * take :], start + take, filled + take
                    at += take
                    if filled == size:
                        count, filled, size = count + 1, 0, next(cuts, 0)
            held, used = [], 0

        def close(rows: _Rows) -> None:
            if used:
                emit(rows, [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1])

        for batch in batches:
            rows = _Rows()
            for g, doc, start, data, total in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "ids", "doc_tokens")), strict=True):
                if g != group:
                    close(rows)
                    group, count = g, 0
                while data:
                    take = min(len(data) // 4, length - used)
                    held.append((doc, start, data[: 4 * take], total))
                    used, start, data = used + take, start + take, data[4 * take :]
                    if used == length:
                        emit(rows, [length])
            yield rows.batch()
        rows = _Rows()
        close(rows)
        yield rows.batch()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, length: int = 1024, windows: int = 16, parts_per_group: int = 64) -> DataFrame:
    """Pieces of documents in sequences of length tokens (a power of two): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is tokenized (ids of the byte-level BPE file at tokenizer_path, read on the executors; its added tokens'
    strings get their own ids, as in the library) and ended by id 0. Full windows are cut off; what remains goes to the open window that it fits best. A partition keeps `windows`
    windows open; where none fits, the fullest is filled up with the head of the piece and emitted, so it has no
    padding. The windows still open at a partition's end are merged by groups of parts_per_group partitions, a bounded
    number of rows, and the last window of a group is cut at powers of two. Sequences are therefore as long as length
    or shorter powers of two, and no token is padding. Every id lies in exactly one piece.

    A null text counts as empty and gives one piece, its id 0. Null and repeated doc_ids keep their rows; an empty
    table gives an empty result; other columns are ignored. The first pass is cut in the checkpoint folder, as ids of
    sequences follow its partitions.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = cut(base.mapInArrow(_pack(tokenizer_path, length, windows), _SCHEMA))
    left = placed.filter("ids is not null").withColumn("group", F.floor(F.shiftright("sequence_id", 34) / parts_per_group).cast("long"))
    merged = left.repartition("group").sortWithinPartitions("group", "sequence_id", "offset").mapInArrow(_merge_leftovers(length), _SCHEMA)
    return placed.filter("ids is null").union(merged).drop("ids")
