"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = np.int64(2**62)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return x, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if kind == 5 else "<d", data[i : i + n])[0], i + n
        yield tag >> 3, value


class PieceModel:
    """A SentencePiece BPE model with byte fallback and identity normalisation; encodes and decodes as the library does."""

    def __init__(self, path: str, most_words: int = 300_000):
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    p = dict(_fields(value))
                    pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24):
            raise ValueError("only BPE models with byte fallback, without normalisation, are read")
        self.prefix = bool(normalizer.get(3, 1))
        self.kinds = np.array([t for _, _, t in pieces])
        self.begin, self.end = (next(i for i, (p, _, t) in enumerate(pieces) if t == CONTROL and p == s) for s in ("<s>", "</s>"))
        if any(t == NORMAL and SPACE in p.lstrip(SPACE) for p, _, t in pieces) or (self.kinds == USER).any() or (self.kinds == UNUSED).any():
            raise ValueError("pieces that cross a space, and pieces of users, are not read")
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        self._build_merges(pieces)
        self._build_decoding(pieces)
        long = "".join(p for p, _, t in pieces if t == NORMAL and len(p) > 1)
        alone = "".join(c for c in "\n\r\t" if c not in long)
        self.words: dict[str, bytes] = {}
        self.most_words = most_words
        words = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        self.split = re.compile(f"{SPACE}{{{n}}}(?={SPACE})|{words}" if (n := self._space_block()) else words)

    def _build_merges(self, pieces: list) -> None:
        ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.symbols = dict(ids)  # of strings; characters that are no piece follow the pieces
        for p in ids:
            for c in p:
                self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        self.first_unknown = 1 + max(self.symbols.values())
        self.longest = max(map(len, ids))
        self.no_piece = len(pieces)
        scores = sorted({s for _, s, t in pieces if t == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        found = []
        for p, i in ids.items():
            for at in range(1, len(p)):
                left, right = self.symbols.get(p[:at]), self.symbols.get(p[at:])
                if left is not None and right is not None:
                    found.append((left * 2**31 + right, rank[pieces[i][1]], i))
        found.sort()
        self.pairs, self.pair_rank, self.pair_to = (np.array(x, np.int64) for x in zip(*found, strict=True))
        # Merges of a rank may be made all at once if no pair with their result comes before or at that rank.
        least = np.full(self.first_unknown, _NEVER)
        for side in (self.pairs // 2**31, self.pairs % 2**31):
            np.minimum.at(least, side, self.pair_rank)
        own = {rank[pieces[i][1]]: [] for i in ids.values()}
        for i in ids.values():
            own[rank[pieces[i][1]]].append(i)
        self.at_once = np.array([len(own.get(r, ())) == 1 and least[own[r][0]] > r for r in range(len(scores))])

    def _space_block(self) -> int:
        """How many spaces of a long run are merged into a piece, from the left, whatever follows; 0 if they aren't.

        White space pieces may all have one rank, the last, so that a run is merged one pair after the other; as it
        falls into such blocks, it is cut into them beforehand.
        """
        n = max((len(p) for p in self.symbols if set(p) == {SPACE}), default=0)
        pair = self.symbols.get(SPACE, 0) * (2**31 + 1)
        if n < 2 or self.pair_rank[self.pairs == pair].tolist() != [self.pair_rank.max()]:
            return 0
        runs = [self._merge(np.full(k, self.symbols[SPACE], np.int64), np.zeros(k, np.int64))[0].tolist() for k in range(3 * n + 1)]
        whole = self.symbols[SPACE * n]
        return n if all(runs[k] == [whole] * (k // n) + runs[k % n] for k in range(3 * n + 1)) else 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * 2**31 + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.pair_rank[at], _NEVER), self.pair_to[at]

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge symbols (flat, each with its word's number) until no pair remains.

        A round finds each word's smallest pair rank and merges its leftmost pair of that rank in all words at once,
        or all its pairs of that rank, left to right, where that can't change the order of merges. In long words it
        also merges every pair that comes first among those within `longest` symbols on both sides (see _first_around).
        Words without a pair leave the arrays, until none is left.
        """
        done = []
        rank, to = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._rank(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = _NEVER
        while len(sym):
            starts = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            sizes = np.diff(np.r_[starts, len(sym)])
            best, size = np.repeat(np.minimum.reduceat(rank, starts), sizes), np.repeat(sizes, sizes)
            live = best < _NEVER
            if not live.all():
                done.append((sym[~live], word[~live]))
                sym, word, rank, to, best, size = (x[live] for x in (sym, word, rank, to, best, size))
                if not len(sym):
                    break
            at = np.nonzero(rank == best)[0]
            run_start = np.r_[True, (np.diff(at) != 1)]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            at = at[first | (self.at_once[rank[at]] & (nth % 2 == 0))]
            if (wide := size > 2 * self.longest).any():
                at = np.union1d(at, self._first_around(np.where(wide, rank, _NEVER)))
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            for again in (place, place[place > 0] - 1):
                ok = again[again + 1 < len(sym)]
                rank[again] = _NEVER
                r, t = self._rank(sym[ok], sym[ok + 1])
                rank[ok], to[ok] = np.where(word[ok] == word[ok + 1], r, _NEVER), t
        sym, word = (np.concatenate([x[c] for x in done]) if done else np.empty(0, np.int64) for c in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _first_around(self, rank: np.ndarray) -> np.ndarray:
        """Places of the pairs that come first (by rank, then from the left) among all pairs up to `longest` symbols away.

        Such a pair is merged before anything can reach it: until then all merges have smaller ranks, the first of them that
        touches the surroundings joins a symbol from outside with the outermost one, and whatever grows inwards from there
        is one symbol, which can't be longer than the longest piece.
        """
        n, reach = len(rank), self.longest
        key = np.full(n + 2 * reach, _NEVER)
        some = np.nonzero(rank < _NEVER)[0]
        key[some + reach] = rank[some] * n + some
        least, width = key, 1  # least[i] = min(key[i : i + width])
        while 2 * width <= 2 * reach + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        around = np.minimum(least[:n], least[2 * reach + 1 - width :][:n])
        return some[around[some] == key[some + reach]]

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before, a bounded number of symbols at a time."""
        i = 0
        while i < len(words):
            n, j = 0, i
            while j < len(words) and (j == i or n < 200_000):
                n += len(words[j])
                j += 1
            self._learn_some(words[i:j])
            i = j

    def _learn_some(self, words: list[str]) -> None:
        text, known = "".join(words), self.symbols
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        unique, at = np.unique(chars, return_inverse=True)
        table = np.array([known.get(chr(c), self.first_unknown + int(c)) for c in unique], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym, word = self._merge(table[at], word)
        whole = sym < self.no_piece
        if not whole.all():
            names = {v: k for k, v in known.items() if v >= self.no_piece}
            n, flat = np.ones(len(sym), np.int64), []
            for i in np.nonzero(~whole)[0]:
                s = int(sym[i])
                b = (names[s] if s in names else chr(s - self.first_unknown)).encode("utf-8", "surrogatepass")
                n[i] = len(b)
                flat.append(self.byte_ids[np.frombuffer(b, np.uint8)])
            split = np.repeat(~whole, n)
            word, sym = np.repeat(word, n), np.repeat(sym, n)
            sym[split] = np.concatenate(flat)
        data = sym.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        begin = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.words[w] = data[begin:end]
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        split = [self.split.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.words) > self.most_words:
            self.words.clear()
        new = {w for words in split for w in words if w not in self.words}
        if new:
            self._learn(sorted(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _build_decoding(self, pieces: list) -> None:
        shown = []
        for p, _, t in pieces:
            shown.append(b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode())
        self.leads = np.array([t == NORMAL and p.startswith(SPACE) for p, _, t in pieces])
        self.size = np.array([len(b) for b in shown], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that form no character become U+FFFD each."""
        ids = ids[self.kinds[ids] != CONTROL]
        if not len(ids):
            return b""
        out = []
        for i in range(0, len(ids), 100_000):
            part = ids[i : i + 100_000]
            n = self.size[part]
            at = np.arange(n.sum()) + np.repeat(self.place[part] - (np.cumsum(n) - n), n)
            out.append(self.shown[at].tobytes())
        data = b"".join(out)[int(self.prefix and self.leads[ids[0]]) :]
        try:
            data.decode()
        except UnicodeDecodeError:
            data = _replace_loose_bytes(data)
        return data


def _replace_loose_bytes(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        try:
            data[i:].decode()
            out.append(data[i:])
            break
        except UnicodeDecodeError as e:
            out += [data[i : i + e.start], "�".encode()]
            i += e.start + 1
    return b"".join(out)


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        for batch in batches:
            ids, texts, n, of_ids, of_text = batch.column("doc_id"), batch.column("text"), [], [], []
            for i in range(0, len(texts), 200):
                for body in model.encode([t or "" for t in texts.slice(i, 200).to_pylist()]):
                    data = begin + body + end
                    n.append(len(data) // 4)
                    of_ids.append(hashlib.sha256(data).hexdigest())
                    of_text.append(hashlib.sha256(model.decode(np.frombuffer(data, "<u4").astype(np.int64))).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 200):
                for body in model.encode([t or "" for t in batch.column("text").slice(i, 200).to_pylist()]):
                    out.append([model.begin, *np.frombuffer(body, "<u4").tolist(), model.end])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            out = [model.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs: doc_id, ids (array of int, with begin and end). A null text counts as empty: begin and end only."""
    return _texts(docs).mapInArrow(_encode_rows(model_path), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, text. Null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_rows(model_path), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, for ids with begin and end and their decoded text.

    The model file is read on the executors from model_path. Texts are cut into words that no merge crosses; each batch
    encodes the words it hasn't met (the memory of words is bounded) by vectorised merge rounds, and joins their ids.
    A null text counts as empty; null and repeated doc_ids keep their rows; an empty table gives an empty result; other
    columns are ignored. No row depends on another, so there is no shuffle.
    """
    return _texts(docs).mapInArrow(_digest(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
