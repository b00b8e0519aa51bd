"""Encoding and decoding with a SentencePiece BPE model by vectorised merge rounds.

The texts of a batch are cut where no piece can span, and the distinct segments become one flat
array of symbols. A round looks up the rank of each adjacent pair, takes the minimum of each
segment, merges it everywhere at once and compacts the array, until no pair is left. The
sentencepiece library only hands over the model's vocabulary here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import give_back, short_batches, slices

NONE = np.iinfo(np.int32).max
SPACE = "▁"
#: Bytes of segments and their ids (about) that are remembered between slices of a batch.
REMEMBERED_BYTES = 24 << 20
#: Characters (about) and segments that are worked on together.
CHUNK_CHARS = 1 << 18


class PieceModel:
    """Vocabulary, merge table and surfaces of a BPE model file with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        self.unk = lib.unk_id()
        self.byte_ids = np.full(256, self.unk, dtype=np.int32)
        surfaces = []
        for i, piece in enumerate(pieces):
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            else:
                surfaces.append(b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.starts_with_space = np.array([not s and p.startswith(SPACE) for s, p in zip(special, pieces, strict=True)])
        self.lengths = np.array([len(s) for s in surfaces], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(surfaces), dtype=np.uint8)

        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        by_score = sorted({lib.get_score(i) for p, i in self.ids.items()}, reverse=True)
        rank_of = {score: k for k, score in enumerate(by_score)}
        # Characters that only occur inside longer pieces are symbols as well, numbered after the pieces.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols) - len(self.ids))
        self.n_symbols = n + len(self.symbols) - len(self.ids)
        self.symbol_ids = np.arange(self.n_symbols, dtype=np.int32)
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (a := self.symbols.get(p[:k])) is not None and (b := self.symbols.get(p[k:])) is not None:
                    pairs[a * self.n_symbols + b] = (rank_of[lib.get_score(i)], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ranks = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], dtype=np.int32)
        self.pair_merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], dtype=np.int32)

        joining = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        joined = "".join(re.escape(c) for c in sorted(joining))
        # No piece has a space mark after another character, and characters outside of all longer pieces never merge.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{joined}{SPACE}]+")
        self.forget()
        top = 0x110000
        self.char_symbol = np.full(top, -1, dtype=np.int32)
        for c, s in self.symbols.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = s

    def forget(self) -> None:
        self.remembered: dict[str, bytes] = {}
        self.remembered_bytes = 0

    # -- encoding ---------------------------------------------------------------------------------------------------
    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes([text])[0], dtype=np.int32)

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n_held = 0
        for k, text in enumerate(texts):
            for part in self._parts(text):
                held.append((k, segments := self.cut.findall(part) if self.cuttable else [part]))
                n_held += len(segments)
                if n_held > CHUNK_CHARS:
                    self._resolve(held, out)
                    held, n_held = [], 0
        self._resolve(held, out)
        return [b"".join(x) for x in out]

    def _parts(self, text: str) -> Iterator[str]:
        """Pieces of the marked text of about CHUNK_CHARS, cut before a run of space marks."""
        if not text:
            return
        marked = SPACE + text.replace(" ", SPACE)
        begin = 0
        while self.cuttable and len(marked) - begin > 2 * CHUNK_CHARS:
            at = begin + CHUNK_CHARS
            while (at := marked.find(SPACE, at)) > 0 and marked[at - 1] == SPACE:
                at += 1
            if at < 0:
                break
            yield marked[begin:at]
            begin = at
        yield marked[begin:]

    def _resolve(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        known = self.remembered
        new = list(set().union(*[segments for _, segments in held]) - known.keys())
        if new:
            merged = self._merge(new)
            known.update(zip(new, merged, strict=True))
            self.remembered_bytes += 200 * len(new) + sum(map(len, merged)) + 2 * sum(map(len, new))
        for k, segments in held:
            out[k].append(b"".join(map(known.__getitem__, segments)))
        if self.remembered_bytes > REMEMBERED_BYTES:
            self.forget()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = (left >= 0) & (right >= 0)
        key = np.where(known, left.astype(np.int64) * self.n_symbols + right, -1)
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NONE).astype(np.int32), np.where(hit, self.pair_merged[at], -1).astype(np.int32)

    def _merge(self, segments: list[str]) -> list[bytes]:
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), size)
        sym = self.char_symbol[points]
        # Unknown characters are symbols below 0 that name the character: they never merge.
        sym = np.where(sym < 0, -2 - points.astype(np.int64), sym).astype(np.int32)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self._pairs_at(sym, owner, np.arange(len(sym)))
        while len(sym):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            shut = least == NONE
            if shut.any():
                open_ = np.repeat(~shut, size)
                finished.append((owner[~open_], sym[~open_]))
                sym, owner, rank, merged, size, least = sym[open_], owner[open_], rank[open_], merged[open_], size[~shut], least[~shut]
                if not len(sym):
                    break
            at = self._chosen(sym, rank, merged, np.repeat(least, size), owner)
            sym[at] = merged[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            size -= np.bincount(np.searchsorted(np.cumsum(size), at, side="right"), minlength=len(size))
            sym, owner, rank, merged = sym[keep], owner[keep], rank[keep], merged[keep]
            now = at - np.arange(len(at))  # each merge before removed one symbol
            near = np.zeros(len(sym), dtype=bool)
            near[now] = True
            near[now[now > 0] - 1] = True
            touched = np.flatnonzero(near)
            rank[touched], merged[touched] = self._pairs_at(sym, owner, touched)
        order_owner = np.concatenate([o for o, _ in finished]) if finished else np.zeros(0, dtype=np.int64)
        order = np.argsort(order_owner, kind="stable")
        final = np.concatenate([s for _, s in finished])[order] if finished else np.zeros(0, dtype=np.int32)
        return self._bytes(final, order_owner[order], len(segments))

    def _pairs_at(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, merged = self._rank(sym[at], sym[nxt])
        apart = (owner[at] != owner[nxt]) | (nxt == at)
        rank[apart], merged[apart] = NONE, -1
        return rank, merged

    def _chosen(self, sym: np.ndarray, rank: np.ndarray, merged: np.ndarray, least: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Positions of the pairs to merge: all of the least rank in a segment, leftmost first and without overlap.

        One after the other is what the model asks for, so where a merge makes a pair of no higher rank, only
        the first is merged in this round.
        """
        hit = np.flatnonzero(rank == least)
        follows = np.concatenate([[False], hit[1:] == hit[:-1] + 1])
        run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        new_owner = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])
        many = ~(new_owner & np.append(new_owner[1:], True))
        if not many.any():
            return hit
        at, own = hit[many], owner[hit[many]]
        made, r = merged[at], rank[at]
        last = len(sym) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        ok_before, ok_after = (at > 0) & (owner[before] == own), (at + 2 <= last) & (owner[after] == own)
        joined = np.concatenate([[False], at[1:] == at[:-1] + 2])
        worst = np.minimum.reduce([
            np.where(ok_before, self._rank(sym[before], made)[0], NONE),
            np.where(ok_after, self._rank(made, sym[after])[0], NONE),
            np.where(joined, self._rank(made, made)[0], NONE),
        ])
        unsafe = np.unique(own[worst <= r])
        first = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])
        return hit[first | ~np.isin(owner[hit], unsafe)]

    def _bytes(self, sym: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """Ids of each segment; symbols that are no pieces become byte pieces."""
        odd = (sym < 0) | (sym >= len(self.lengths))
        if odd.any():
            width = np.ones(len(sym), dtype=np.int64)
            spelt = {}
            chars = {s: c for c, s in self.symbols.items() if len(c) == 1 and s >= len(self.lengths)}
            for s in np.unique(sym[odd]).tolist():
                c = chr(-2 - s) if s < 0 else chars[s]
                spelt[s] = self.byte_ids[list(c.encode("utf-8", "surrogatepass"))]
            where = np.flatnonzero(odd)
            width[where] = [len(spelt[s]) for s in sym[where].tolist()]
            out = np.repeat(sym, width)
            start = np.cumsum(width) - width
            for k in where.tolist():
                out[start[k] : start[k] + width[k]] = spelt[int(sym[k])]
            sym, owner = out, np.repeat(owner, width)
        ends = np.cumsum(np.bincount(owner, minlength=n)) * 4
        raw = sym.astype("<i4").tobytes()
        begin = [0, *ends[:-1].tolist()]
        return [raw[a:b] for a, b in zip(begin, ends.tolist(), strict=True)]

    # -- decoding ---------------------------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        return self.decode_many(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0].decode()

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids between the offsets."""
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts = [self._surface(ids[k : min(k + CHUNK_CHARS, b)]) for k in range(a, b, CHUNK_CHARS)]
            raw = b"".join(parts)
            if self.is_byte[ids[a:b]].any() and (not self.lengths[ids[a:b]].all() or not _is_text(raw)):
                raw = self._repaired(ids[a:b])  # ids without a surface part bytes too
            if b > a and self.starts_with_space[ids[a]]:
                raw = raw[1:]
            out.append(raw)
        return out

    def _surface(self, ids: np.ndarray) -> bytes:
        width = self.lengths[ids]
        ends = np.cumsum(width)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - width), width)
        return self.bytes[at].tobytes()

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces that are no UTF-8: each byte without a place in a character becomes U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self._surface(np.array([i]))
                continue
            while run:
                width = next((w for w in (1, 2, 3, 4) if _is_char(bytes(run[:w]))), 0)
                out.append(bytes(run[:width]) if width else "�".encode())
                del run[: max(1, width)]
            if i >= 0:
                out.append(self._surface(np.array([i])))
        return b"".join(out)


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _is_char(raw: bytes) -> bool:
    return _is_text(raw) and len(raw.decode()) == 1


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of this process, read once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _schema(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in more] + [T.StructField(k, v) for k, v in more.items()])


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of each whole text, array<int>, without begin and end ids.

    A null text is encoded as an empty one: no ids. A column that is named like ids_col is replaced.
    Rows stay as they are, repeated ones too.
    """
    df = df.drop(ids_col)
    names = df.columns
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for part in slices(batches):
            raw = m.encode_bytes([t or "" for t in part.column(names.index(text_col)).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*names, ids_col])
        m.forget()
        give_back()

    return df.mapInArrow(run, _schema(df, **{ids_col: T.ArrayType(T.IntegerType())}))


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of each array of ids; null ids give an empty text."""
    df = df.drop(out_col)
    names = df.columns
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for part in slices(batches):
            column = part.column(names.index(ids_col))
            width = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
            text = m.decode_many(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(width)]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, type=pa.binary()).cast(pa.string())], [*names, out_col])

    return df.mapInArrow(run, _schema(df, **{out_col: T.StringType()}))


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again.

    One row per input row: null texts count as empty (no tokens, digests of empty strings), repeated rows get
    equal results, null doc_ids stay. Columns but the two named are not read. An empty table gives an
    empty result. One pass in one Python worker a task: only the digests leave it.
    """
    short_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        decimal = [b"%d" % i for i in range(len(m.lengths))]
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for part in slices(batches):
            n_tokens, of_ids, of_text = [], [], []
            for raw in m.encode_bytes([t or "" for t in part.column(1).to_pylist()]):
                ids = np.frombuffer(raw, dtype="<i4").astype(np.int64)
                n_tokens.append(len(ids))
                of_ids.append(sha(b",".join(map(decimal.__getitem__, ids.tolist()))))
                of_text.append(sha(m.decode_many(ids, np.array([0, len(ids)]))[0]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_tokens, type=pa.int64()), pa.array(of_ids, type=pa.string()), pa.array(of_text, type=pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        m.forget()
        give_back()

    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], *[T.StructField(k, v) for k, v in kinds.items()]]))
