"""SentencePiece encoding and decoding by backtracking.

A merge-type (BPE) encoding is the only tiling of the text in which each pair of neighbouring tokens is *compatible*:
re-merging the pair's joined characters gives the same two tokens back; only the merges at the seam can tell, so only
those are gone through. The encoder therefore walks the text with
the longest vocabulary match at each position (an Aho-Corasick automaton over the pieces), accepts a token if it is
compatible with the one before, and otherwise tries the next shorter piece or steps back, marking positions from
which no tiling can be finished in a bitfield so that none is tried twice.

A merge across two characters needs a piece that holds them side by side, so a text falls apart, without any change
of the result, wherever no piece does; white space always is such a place. The units are encoded alone and cached. Units with a run of several marks hold pieces of
equal score, for which the order of merges depends on position; these are merged outright.
"""

from __future__ import annotations

import functools
import heapq
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import append_columns, claim, read_documents

MARK = "▁"
CACHE, PAIRS = 300_000, 150_000  # units and token pairs kept by a worker; a cache is emptied when full, which changes speed only
SHORT = 64  # characters of a unit that is kept, and tiled as a whole
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Vocabulary of a sentencepiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(blob)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only BPE models with an identity normaliser are supported")
        if any(p.type in (USER, UNUSED) for p in m.pieces) or not m.trainer_spec.byte_fallback:
            raise ValueError("user-defined or unused pieces and models without byte fallback are not supported")
        self.prefix = n.add_dummy_prefix
        self.score, self.ids, self.byte_id, self.as_bytes, self.is_byte = {}, {}, {}, [], []
        self.eos = next(i for i, p in enumerate(m.pieces) if p.piece == m.trainer_spec.eos_piece)
        for i, p in enumerate(m.pieces):
            self.is_byte.append(p.type == BYTE)
            if p.type == NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.as_bytes.append(p.piece.replace(MARK, " ").encode())
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.as_bytes.append(bytes([value]))
            else:
                self.as_bytes.append(m.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"")
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if inner or any("\n" in p for p in self.ids):
            raise ValueError("pieces must not span white space")
        self.marked = {i for p, i in self.ids.items() if p[0] == MARK}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # A piece that its own merges don't give back can never be in an encoding.
        self.halves: dict[str, tuple[str, str]] = {}
        self.reachable = {p for p in self.ids if self.merge(p, self.halves) == [p]}
        self.ordered = all(max(self.rank(x), self.rank(y)) < self.rank(p) for p, (x, y) in self.halves.items() if not p.startswith(MARK * 2))
        # From here on pieces are their ids.
        n = len(m.pieces)
        self.width = [0] * n
        self.longest = ahocorasick.Automaton()
        for p in self.reachable:
            self.width[self.ids[p]] = len(p)
            self.longest.add_word(p[::-1], self.ids[p])
        self.longest.make_automaton()
        self.shorter = [-1] * n
        for p in self.reachable:
            self.shorter[self.ids[p]] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reachable), -1)
        #: The rank at which two neighbours merge, by left id * n + right id.
        self.stride = n
        self.joins = {self.ids[p[:k]] * n + self.ids[p[k:]]: self.rank(p) for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.name = [p.piece for p in m.pieces]
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+").findall
        single = "".join(re.escape(c) for c in sorted(p for p in self.ids if len(p) == 1))
        self.runs = re.compile(f"[{single}]+|.", re.S).findall

    def rank(self, piece: str) -> float:
        """When a piece is merged: the lower the earlier; single characters are there from the start."""
        return -self.score[piece] if len(piece) > 1 else float("-inf")

    def merge(self, unit: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The encoding by its definition: join the best-scored neighbours, leftmost first, until none can be joined.

        halves, if given, gets the two parts of a unit that ends as a single piece.
        """
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(x := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, x))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, x = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != x:
                continue
            if halves is not None and x == unit:
                halves[unit] = parts[i], parts[j]
            parts[i], parts[j] = x, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at one end of a token (0: its left, 1: its right) while it is merged, first the character: each with the rank at which it goes."""
        got = self.spines.get((token, side))
        if got is None:
            gone, piece = float("inf"), self.name[token]
            got = [(token, gone)]
            while len(piece) > 1:
                gone, piece = self.rank(piece), self.halves[piece][side]
                got.append((self.ids[piece], gone))
            self.spines[token, side] = got = got[::-1]
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined characters of tokens a and b merge into a and b again, seen from the merges at the seam.

        The pieces beside the seam change as the merges of a and of b go on; while two stand side by side, they must not
        merge with each other before one of them goes.
        """
        key = a * self.stride + b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            if self.ordered:
                x, y, i, j, ok = self.spine(a, 1), self.spine(b, 0), 0, 0, True
                while i < len(x) and j < len(y):
                    (p, p_gone), (q, q_gone) = x[i], y[j]
                    s = self.joins.get(p * self.stride + q)
                    if s is not None and s < p_gone and s <= q_gone:
                        ok = False
                        break
                    i += p_gone <= q_gone
                    j += q_gone <= p_gone
            else:
                x, y = self.name[a], self.name[b]
                ok = self.merge(x + y) == [x, y]
            self.fits[key] = ok
        return ok

    def heads(self, run: str) -> list[int]:
        """The longest piece that begins at each position, by one pass of the automaton over the reversed run."""
        last = len(run) - 1
        out = [-1] * len(run)
        for end, token in self.longest.iter(run[::-1]):  # matches at one end come longest first
            if out[last - end] < 0:
                out[last - end] = token
        return out

    def tile(self, run: str) -> list[int]:
        """Backtracking over a run of known characters."""
        heads, n = self.heads(run), len(run)
        width, shorter, fits, compatible, stride = self.width, self.shorter, self.fits, self.compatible, self.stride
        failed, tokens, at, token, last = 0, [], 0, heads[0], -1
        while True:
            while token >= 0 and (failed and failed >> (at + width[token]) & 1 or last >= 0 and not (fits.get(last * stride + token) or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                last = token
                at += width[token]
                if at == n:
                    return tokens
                token = heads[at]
            else:
                failed |= 1 << at
                if not tokens:
                    raise AssertionError(f"no tiling of {run!r}")
                token = tokens.pop()
                last = tokens[-1] if tokens else -1
                at -= width[token]
                token = shorter[token]

    def part(self, part: str) -> list[int]:
        """The ids of known characters without a place where the text falls apart, or of a short run of them."""
        return [self.ids[p] for p in self.merge(part)] if part.startswith(MARK * 2) else self.tile(part)

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """The ids of one unit; a long one is put together from its parts between characters that no piece holds side by side."""
        out: list[int] = []
        for run in self.runs(unit):
            if run[0] not in self.ids:
                out += [self.byte_id[b] for b in run.encode()]
            elif len(run) <= SHORT:
                out += self.part(run)
            else:
                at = 0
                for end in range(1, len(run) + 1):
                    if end == len(run) or run[end - 1 : end + 1] not in self.pairs:
                        out += self.units.get(run[at:end]) or self.keep(run[at:end], tuple(self.part(run[at:end])))
                        at = end
        return self.keep(unit, tuple(out))

    def keep(self, unit: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(unit) <= SHORT:
            if len(self.units) > CACHE:
                self.units.clear()
            self.units[unit] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids without an end id; equal to the library's encode(text)."""
        out: list[int] = []
        if text:
            get, extend = self.units.get, out.extend
            for unit in self.split((MARK if self.prefix else "") + text.replace(" ", MARK)):
                extend(get(unit) or self.encode_unit(unit))
        return out

    def decode(self, ids: list[int]) -> str:
        """Equal to the library's decode(ids)."""
        table = self.as_bytes
        raw = b"".join(map(table.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes that are no character: one replacement mark each
            text, run = "", b""
            for i in [*ids, None]:
                if i is not None and self.is_byte[i]:
                    run += table[i]
                    continue
                while run:
                    for k in (4, 3, 2, 1):
                        try:
                            c = run[:k].decode()
                            if len(c) == 1:
                                break
                        except UnicodeDecodeError:
                            continue
                    else:
                        c, k = "�", 1
                    text, run = text + c, run[k:]
                text += table[i].decode() if i is not None else ""
        first = next((i for i in ids if table[i]), None)
        return text[1:] if self.prefix and first in self.marked else text


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    """The place of the public 32k model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(2)
def loaded(blob: bytes) -> PieceModel:
    """A model and its caches, kept by each Python worker between tasks."""
    return PieceModel(blob)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", end_id: bool = True) -> DataFrame:
    """docs with the ids of each text (array of int) and the text that they decode to.

    The model file is read once, by the driver, and travels with the tasks. A null text counts as empty and has the
    end id alone; texts are never cut; repeated rows stay; an empty table gives an empty table with the new columns;
    existing columns of the same names are replaced.
    """
    blob = model_bytes(model_path)

    def make():
        claim("pieces", loaded.cache_clear)
        model = loaded(blob)
        tail = [model.eos] if end_id else []

        def fn(texts: list[str]) -> list[pa.Array]:
            flat, offsets, decoded = [], [0], []
            for t in texts:
                ids = model.encode(t) + tail
                decoded.append(model.decode(ids))
                flat.append(pa.array(ids, pa.int32()))
                offsets.append(offsets[-1] + len(ids))
            values = pa.concat_arrays(flat) if flat else pa.array([], pa.int32())
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(decoded, pa.string())]

        return fn

    return append_columns(docs, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())], make)


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """n_tokens and digests of ids and decoded text for every document."""
    coded = encode_decode(read_documents(spark, sf_dir).select("doc_id", "text"), model_path or default_model())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
