"""Byte-level BPE by backtracking over longest matches, exact merges in linear time."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import whole_text

#: Pieces up to this length are remembered, so many of them in each of two generations, and so many token pairs.
MEMO_CHARS, MEMO_PIECES, MEMO_PAIRS = 48, 300_000, 400_000
#: A rank file larger than this is not sent to the executors.
MAX_FILE_BYTES = 64 << 20
NONE = -1
IDS, SAID = itemgetter(0), itemgetter(1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The parts left after joining the neighbours of lowest rank again and again; quadratic, for short pieces.

    Only joins whose rank is smaller than ``below`` count.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        rank = ranks.get(parts[best] + parts[best + 1])
        if rank is None or below is not None and rank >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Pieces(dict):
    """Ids of each match of the pattern, and the same as decimals joined by commas; short ones are remembered."""

    def __init__(self, coder: Encoder):
        self.coder, self.older = coder, {}

    def __missing__(self, text: str) -> tuple[tuple[int, ...], str]:
        found = self.older.get(text)
        if found is None:
            ids = self.coder._piece(text.encode("utf-8"))
            found = tuple(ids), ",".join(map(self.coder.decimals.__getitem__, ids))
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Encodes pieces of text.

    An encoding is the one that merging gives exactly if each two neighbours in it are, that
    is if merging their joined bytes gives the two back. So the encoder walks to the right
    with the longest token that fits its left neighbour, and steps back to shorter ones where
    none leads on. A byte position at which nothing fits is never entered again, which bounds
    the walk by the positions times the shorter tokens there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimals = {rank: str(rank) for rank in self.tokens}
        # Bytes as Latin-1 make the automaton's letters. Tokens that merging never makes are left out.
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = merge(token, ranks, rank)
                if len(halves) != 2:
                    continue
                self.parts[rank] = (ranks[halves[0]], ranks[halves[1]])
            self.reachable[token] = rank
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self.automaton = automaton
        self.longest = max((len(t) for t in self.reachable), default=0)
        self.shorter = {rank: self._prefix(token) for token, rank in self.reachable.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def _prefix(self, token: bytes) -> int:
        return next((self.reachable[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.reachable), NONE)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes leaves just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges from the latest on. At each time the parts that touch in the middle must not
        # have had a join of their own that came before the merge which hides it.
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        a, b = left, right
        hidden_a = hidden_b = 1 << 60  # rank of the merge that took the part on each side in
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            # The join comes before the merges that hide a part from it; of equal ranks merging takes
            # the one further to the left first, which is the left part's own.
            if joined is not None and joined < hidden_a and joined <= hidden_b:
                return False
            split_a, split_b = parts.get(a), parts.get(b)
            if split_a is None and split_b is None:
                return True
            # The part with the higher rank was made last; of twice the same token, the right one.
            if split_b is None or split_a is not None and a > b:
                hidden_a, a = a, split_a[1]
            else:
                hidden_b, b = b, split_b[0]

    def _piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.walk(data)

    def longest_from(self, data: bytes) -> list[tuple[int, int]]:
        """At each position the longest token that starts there, and its length."""
        best = [(NONE, 0)] * len(data)
        for end, found in self.automaton.iter(data.decode("latin-1")):
            start = end - found[1] + 1
            if found[1] > best[start][1]:
                best[start] = found
        return best

    def walk(self, data: bytes) -> list[int]:
        best, n = self.longest_from(data), len(data)
        tokens, shorter, pairs, fits = self.tokens, self.shorter, self.pairs, self.fits
        closed = bytearray(n + 1)
        ids: list[int] = []
        last, at = NONE, 0
        token, size = best[0] if n else (NONE, 0)
        while at < n:
            while token != NONE:
                if not closed[at + size]:
                    if last == NONE:
                        break
                    known = pairs.get((last, token))
                    if known or known is None and fits(last, token):
                        break
                token = shorter[token]
                size = len(tokens[token]) if token != NONE else 0
            if token == NONE:
                if not ids:
                    raise ValueError("the vocabulary has no token for some byte")
                closed[at] = 1
                gone = ids.pop()
                at -= len(tokens[gone])
                last = ids[-1] if ids else NONE
                token = shorter[gone]
                size = len(tokens[token]) if token != NONE else 0
            else:
                ids.append(token)
                last, at = token, at + size
                token, size = best[at] if at < n else (NONE, 0)
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(IDS, map(self.pieces.__getitem__, self.pattern.findall(text)))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: Broadcast, key: str, pattern: str) -> Encoder:
    """The encoder of this Python worker, made once and kept for the tasks to come."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(file.value), pattern)
    return _ENCODERS[key]


def _shared(docs: DataFrame, ranks_file: str, pattern: str) -> tuple[Broadcast, str]:
    with open(ranks_file, "rb") as f:  # the driver's own copy of a public file
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{ranks_file} has over {MAX_FILE_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data + pattern.encode()).hexdigest()


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; no shuffle.

    Null texts count as empty and give no ids. Texts of any length are encoded whole; the
    walk needs memory in proportion to the longest match of the pattern. Repeated rows are
    encoded each, ids may be null, an empty table gives no row, other columns are not read.
    """
    file, key = _shared(docs, ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, key, pattern)
        for batch in batches:
            ids = pa.array([coder.encode(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([batch["doc_id"], ids], ["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, data) with the bytes of ``ids``; null ids give none."""
    file, key = _shared(encoded, ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, key, pattern)
        for batch in batches:
            data = pa.array([coder.decode(i or ()) for i in batch["ids"].to_pylist()], pa.binary())
            yield pa.record_batch([batch["doc_id"], data], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, the ids decoded again in the same task."""
    file, key = _shared(docs, ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, key, pattern)
        for batch in batches:
            sizes, id_digests, digests = [], [], []
            for text in batch["text"]:
                pieces = list(map(coder.pieces.__getitem__, coder.pattern.findall(text.as_py())))
                ids = list(chain.from_iterable(map(IDS, pieces)))
                sizes.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(SAID, pieces)).encode()).hexdigest())
                digests.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids``, and as ``text`` what the ids decode to; no shuffle.

    A null text stays null and has no tokens. Columns of the new names are replaced; all others
    are handed on.
    """
    file, key = _shared(docs, ranks_file, pattern)
    docs = docs.drop("n_tokens", "token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, key, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            ids = [coder.encode(t or "") for t in batch["text"].to_pylist()]
            texts = [coder.decode(i).decode("utf-8") if known else None for i, known in zip(ids, batch["text"].is_valid().to_pylist())]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.append_column("n_tokens", pa.array(list(map(len, ids)), pa.int64())).append_column("token_ids", pa.array(ids, pa.list_(pa.int32())))

    schema = docs.withColumn("n_tokens", F.lit(None).cast("long")).withColumn("token_ids", F.lit(None).cast("array<int>")).schema
    return docs.mapInArrow(run, schema)
