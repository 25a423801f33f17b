"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

A sequence of tokens is what the merges give if and only if each adjacent pair is (the merges of the pair's bytes give
the pair back). So the encoding of every prefix ends in exactly one token that fits the one before it, and reading a
byte needs no more than, for each place where a longer token may still begin, the tokens up to there that are not yet
certain. That is the transducer's state; states and arcs are made when first met. A token is emitted once all these
places agree on it, at the latest when the longest token's length has been read.

Null texts are empty: no tokens and the hash of nothing. Repeated rows each get a row; an empty table gives no row;
other columns are ignored. Long texts and long pieces without a space take memory in proportion to their length only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigframe.llm.common import pieces, read, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States of the transducer, and pieces of text with known tokens, that a worker keeps; beyond, it starts anew.
MOST_STATES = 300_000
MOST_PIECES = 250_000
#: Longer pieces are not kept.
LONGEST_KEPT = 48


def load(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes in, tokens out."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.most_states = most_states
        self.fits: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        # A state: the longest end of the input that begins some token, and for each place (its distance from here)
        # where a token may still begin, the last token before it and the tokens not yet emitted.
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, -1, ()),))]
        self.ids = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Tokens by merging the pair of lowest rank, again and again; for pairs of tokens, so data is short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(found)
            if low == 1 << 60:
                break
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2 * self.most_states:
                self.fits.clear()
            known = self.fits[key] = left < 0 or self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _arc(self, at: int, byte: int) -> tuple[int, tuple]:
        tail, places = self.states[at]
        tail += bytes((byte,))
        for d, last, pending in reversed(places):
            token = self.ranks.get(tail[len(tail) - d - 1 :])
            if token is not None and (last < 0 or self.fit(last, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        kept = [(0, token, pending + (token,))] + [(d + 1, last, p) for d, last, p in places if tail[len(tail) - d - 1 :] in self.prefixes]
        agreed = 0
        least = min(len(p) for _, _, p in kept)
        while agreed < least and all(p[agreed] == kept[0][2][agreed] for _, _, p in kept):
            agreed += 1
        out = kept[0][2][:agreed]
        state = (tail[len(tail) - kept[-1][0] :], tuple((d, last, p[agreed:]) for d, last, p in kept))
        to = self.ids.get(state)
        if to is None:
            to = self.ids[state] = len(self.states)
            self.states.append(state)
        self.arcs[at << 8 | byte] = made = (to, out)
        return made

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self._forget()
        at, tokens, arcs = 0, [], self.arcs
        for i, byte in enumerate(data):
            step = arcs.get(at << 8 | byte)
            if step is None:
                if len(self.states) > 2 * self.most_states:  # within one piece: go on from the same state in a new table
                    state = self.states[at]
                    self._forget()
                    arcs, at = self.arcs, len(self.states)
                    self.states.append(state)
                    self.ids[state] = at
                step = self._arc(at, byte)
            at = step[0]
            if step[1]:
                tokens += step[1]
        tokens += self.states[at][1][0][2]
        return tokens


class Utf8:
    """An incremental UTF-8 machine: feed() gives the text that is certain, finish() replaces what is left."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _needs(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self._needs(byte) > back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """Text to token ids and back, as the ranks and the splitting pattern give them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        table = [b""] * size
        for k, v in ranks.items():
            table[v] = k
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def _piece(self, piece: str) -> bytes:
        made = np.array(self.transducer.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self.known) >= MOST_PIECES:
                self.known.clear()
            self.known[piece] = made
        return made

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, piece = self.known.get, self._piece
        return b"".join([known(p) or piece(p) for p in self.pieces(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - lengths), lengths)
        return self.flat[at].tobytes()

    def decode_stream(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        machine = Utf8()
        for ids in parts:
            yield machine.feed(self.decode_bytes(np.asarray(ids, np.int64)))
        yield machine.finish()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load(path), pattern)


#: Ids decoded at a time.
STRETCH = 1 << 16


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens, ids_sha256, decoded_sha256 of each row; path is a rank file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for some in pieces(batches):
            packed, counts, first, second = [], [], [], []
            for text in some.column("text").to_pylist():
                ids = own.encode_packed(text)
                wide = np.frombuffer(ids, "<u4")
                decoded = hashlib.sha256()
                for part in own.decode_stream(wide[i : i + STRETCH] for i in range(0, len(wide), STRETCH)):
                    decoded.update(part.encode("utf-8"))
                packed.append(ids)
                counts.append(len(wide))
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(packed, pa.binary()), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("ids")


QUERIES = {"op7_bpe": op7_bpe}
