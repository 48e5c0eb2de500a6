"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by an incremental UTF-8 machine.

Encoding. A token sequence is the merge result of its bytes exactly when every neighbouring pair is the merge result of the
pair's bytes, so the merges compile into a nondeterministic transducer: it reads bytes along a trie of the tokens, guesses
where a token ends, and lets a token follow another only if the pair is stable. ``BpeTransducer`` determinises it as it
reads: a state is the set of open tokens; one guess at most can close at a byte, so one register a byte holds the token
that ends there. What all live guesses share is emitted every ``WINDOW`` bytes, so output lags input by a bounded lookahead and a
match of any length needs memory for a window only. States and moves are made when first needed and kept.

Decoding. ``Utf8Decoder`` takes ids one by one and runs their bytes through a state machine over UTF-8; what it keeps between
ids is the incomplete sequence at the end of what it has read. Ill-formed bytes become U+FFFD, one for each maximal subpart.

Defined cases: null text is empty, empty text has no ids and decodes to the empty string; very long texts are read whole, one
pattern match at a time; equal rows give equal rows; an empty table gives an empty table; columns of the input named like an
output column (in any case) are replaced, all others are kept.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm.common import map_batches, read_table, text_or_empty, worker_state
from aerolake.llm.units import Memo, cut

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Bounds on a worker's memory, not on results: bytes of a generation of the memo, entries of the tables of pairs and moves.
MEMO_BYTES, PAIRS = 72 << 20, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BpeTransducer:
    """Merge ranks as a transducer over bytes: a guess is an open token (a node of the tokens' trie), a state the set of live guesses."""

    #: Bytes after which a long match emits what all guesses share.
    WINDOW = 256

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = PAIRS):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.max_pairs = max_pairs
        self.stable: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # The trie: child of node n by byte b at n * 256 + b.
        self.child: dict[int, int] = {}
        self.depth = array("i", [0])
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self.inner = {key >> 8 for key in self.child}
        # Determinised as it reads: a set of nodes is fixed by its deepest one, so there are no more states than nodes.
        self.state_ids: dict[tuple[int, ...], int] = {(): 0}
        self.states: list[tuple[int, ...]] = [()]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]  # (length, token) of the guesses that may close, longest first
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}  # next state and its ends, by state * 256 + byte

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Merge result of a token's bytes, straight from the ranks, or its last ``stop`` parts; used to compile the merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two ids whose merge makes a token; None for a single byte and for tokens that merging never makes."""
        known = self.halves.get(token, 0)
        if known == 0:
            data, known = self.bytes_of[token], None
            if len(data) > 1:
                parts = self.merge(data, stop=2)
                known = tuple(parts) if len(parts) == 2 and self.merge(data) == [token] else None
            self.halves[token] = known
        return known

    def _made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._halves(token) is not None

    def _may_follow(self, last: int, token: int) -> bool:
        """Is (last, token) what merging its own bytes gives? Undo merges across the boundary, latest first. last < 0: the start."""
        if last < 0:
            return self._made(token)
        left, right = last, token
        if not self._made(left) or not self._made(right):
            return False
        ranks, bytes_of = self.ranks, self.bytes_of
        bound = len(bytes_of) + 1  # a merge across the boundary comes first if its rank is under this
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < bound:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:  # the later merge is undone first; on a tie the right one, as merging goes from the left
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        nodes = tuple(child for node in (*self.states[state], 0) if (child := self.child.get(node << 8 | byte)) is not None)
        target = self.state_ids.get(nodes)
        if target is None:
            target = self.state_ids[nodes] = len(self.states)
            self.states.append(nodes)
            self.ends.append(tuple((self.depth[n], self.token_at[n]) for n in nodes if n in self.token_at))
        move = self.moves[state << 8 | byte] = target, self.ends[target]
        return move

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pattern match. ``last[i]`` is the token that ends at byte i of the window, the same for all guesses that pass there."""
        moves, stable = self.moves, self.stable
        if len(stable) > self.max_pairs:
            stable.clear()
        out: list[int] = []
        last, state, at, look = [-1], 0, 0, self.WINDOW
        for byte in data:
            state, ends = moves.get(state << 8 | byte) or self._move(state, byte)
            at += 1
            for length, token in ends:
                before = last[at - length]
                key = before * 1_000_003 + token
                known = stable.get(key)
                if known is None:
                    known = stable[key] = self._may_follow(before, token)
                if known:
                    last.append(token)
                    break
            if at >= look:
                done = self._shared(last, state, at)
                out += self._path(last, done)
                last, at = last[done:], at - done
                look = max(self.WINDOW, 2 * at)  # what is still open is looked at again after as much again
        return out + self._path(last, at)

    def _path(self, last: list[int], at: int) -> list[int]:
        ids = []
        while at > 0:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def _shared(self, last: list[int], state: int, at: int) -> int:
        """The last token end that the paths of all live guesses pass."""
        shared = None
        for start in {at, *(at - self.depth[n] for n in self.states[state] if n in self.inner)}:
            passed = {start}
            while start > 0:
                start -= len(self.bytes_of[last[start]])
                passed.add(start)
            shared = passed if shared is None else shared & passed
        return max(shared)


class BpeEncoder:
    """Whole texts to ids: each match of the pattern on its own; a match that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.transducer = BpeTransducer(ranks)
        self.memo = Memo(MEMO_BYTES)

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.transducer.encode(data)

    def _units(self, units: list[str]) -> list[bytes]:
        return [array("i", chain.from_iterable(map(self._piece, self.find(u)))).tobytes() for u in units]

    def encode(self, text: str) -> np.ndarray:
        units = cut(text)
        return np.frombuffer(b"".join(self.memo.many(self.find(text) if units is None else units, self._units)), np.int32)


def _utf8_table() -> list[int]:
    """Next state by state * 256 + byte: 0 between sequences, -1 ill-formed. States 1 to 3 wait for as many bytes; 4 to 7 are those after
    E0, ED, F0 and F4, which allow fewer second bytes."""
    table = [-1] * (8 * 256)
    starts = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEF, 2), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF1, 0xF3, 3), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)]
    inside = [(1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)]
    for state, low, high, target in [(0, *x) for x in starts] + inside:
        for byte in range(low, high + 1):
            table[state << 8 | byte] = target
    return table


class Utf8Decoder:
    """Ids to text, incrementally; ``decode`` may be called for one chunk after another, ``finish`` ends the text."""

    TABLE = _utf8_table()

    #: Ids that are tried as one run of moves from the empty state back to it.
    RUN = 128

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        # Moves from the empty state back to it, one a token at most.
        self.plain = {token: text for token, data in bytes_of.items() for text, rest in (self._run(data),) if not rest}
        self.rest = b""

    def _run(self, data: bytes) -> tuple[str, bytes]:
        """The machine from its start over ``data``: text of all complete and ill-formed sequences, and the incomplete one at the end."""
        table, state, good, pending = self.TABLE, 0, bytearray(), bytearray()
        for byte in data:
            target = table[state << 8 | byte]
            if target < 0 and state:  # the sequence so far is a maximal subpart; the byte begins anew
                good += b"\xef\xbf\xbd"
                pending.clear()
                target = table[byte]
            if target < 0:
                good += b"\xef\xbf\xbd"
                target = 0
            else:
                pending.append(byte)
                if not target:
                    good += pending
                    pending.clear()
            state = target
        return good.decode(), bytes(pending)

    def _move(self, rest: bytes, token: int) -> tuple[str, bytes]:
        known = self.moves.get((rest, token))
        if known is None:
            if len(self.moves) >= PAIRS:
                self.moves.clear()
            known = self.moves[rest, token] = self._run(rest + self.bytes_of[token])
        return known

    def decode(self, ids: Sequence[int]) -> str:
        out, plain, rest = [], self.plain, self.rest
        for i in range(0, len(ids), self.RUN):
            run = ids[i : i + self.RUN]
            if not rest:
                try:
                    out.append("".join(map(plain.__getitem__, run)))
                    continue
                except KeyError:  # some token ends within a sequence
                    pass
            for token in run:
                if not rest and (text := plain.get(token)) is not None:
                    out.append(text)
                else:
                    text, rest = self._move(rest, token)
                    out.append(text)
        self.rest = rest
        return "".join(out)

    def finish(self) -> str:
        text, self.rest = "\ufffd" if self.rest else "", b""
        return text


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        self.encoder = BpeEncoder(load_ranks(ranks_path), pattern)
        self.decoder = Utf8Decoder(self.encoder.transducer.bytes_of)

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Ids and their numbers; a null text has none."""
        flat = [self.encoder.encode(t.as_py()) if t.is_valid else np.empty(0, np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate(flat) if flat else np.empty(0, np.int32)), np.diff(ends)

    def decode(self, ids: pa.ListArray) -> list[str]:
        return [self.decoder.decode(x.values.to_numpy().tolist() if x.is_valid else ()) + self.decoder.finish() for x in ids]


def _coder(ranks_path: str | None, pattern: str | None) -> Coder:
    ranks_path, pattern = ranks_path or default_ranks_path(), pattern or default_pattern()
    return worker_state(("bpe", ranks_path, pattern), lambda: Coder(ranks_path, pattern))


IDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
DECODED = [T.StructField("decoded", T.StringType())]


def encode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, keep_text: bool = False) -> DataFrame:
    """Append ``ids`` array<int> and ``n_tokens`` long. The rank file is read in each task; its path must exist on every machine."""

    def task():
        coder = _coder(ranks_path, pattern)
        return lambda batch: dict(zip(("ids", "n_tokens"), coder.encode(batch.column(batch.schema.get_field_index(text_col))), strict=True))

    return map_batches(docs, task, IDS, () if keep_text else (text_col,))


def decode(tokens: DataFrame, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """Append ``decoded`` string, the text of the ids; null ids decode to the empty string."""

    def task():
        coder = _coder(ranks_path, None)
        return lambda batch: {"decoded": coder.decode(batch.column(batch.schema.get_field_index(ids_col)))}

    return map_batches(tokens, task, DECODED)


def round_trip(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that one Python worker a task holds the vocabulary; the text is dropped."""

    def task():
        coder = _coder(ranks_path, pattern)

        def call(batch: pa.RecordBatch) -> dict:
            ids, n = coder.encode(batch.column(batch.schema.get_field_index(text_col)))
            return {"ids": ids, "n_tokens": n, "decoded": coder.decode(ids)}

        return call

    return map_batches(docs, task, IDS + DECODED, (text_col,))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded text, from ``encode`` and ``decode`` or ``round_trip``."""
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return digest(round_trip(docs))


QUERIES = {"op1_bpe": op1_bpe}
