"""SentencePiece BPE encoding by backtracking, and decoding.

Merge-type encoding picks, again and again, the adjacent pair whose joined piece has
the best score. The same result is found from left to right: at each place the longest
piece that an Aho-Corasick automaton matches is tried first, then shorter ones. A piece may
follow another only if merging their joined text anew gives these two pieces, and a field
of bits, a byte each so that it is set in place, remembers places from which no continuation was found, so that each is given
up once. Only pieces that merging their own text yields take part.

Characters without a piece split a text; they become byte pieces. Stretches are cut
before runs of spaces, which pieces hold in front only, and each distinct one is
encoded once by a worker. Models with a normaliser of their own, or with pieces that hold spaces
elsewhere, are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import tables
from .subwords import Stretches, cut_blanks, one_by_one

SPACE = "▁"
#: Pairs of pieces whose check a worker remembers.
PAIRS = 1 << 21


class PieceEncoder:
    """Exact encoding of stretches that the model would not merge with what stands around them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i)):
                self.id[piece], self.score[piece] = i, m.get_score(i)
        probe = "  A\tﬁ½é \n"
        if m.normalize(probe) != SPACE + probe.replace(" ", SPACE) or any(SPACE in p.lstrip(SPACE) for p in self.id) or len(self.byte) != 256:
            raise ValueError("only byte-fallback models without a normaliser, whose pieces hold spaces in front, are supported")
        self.machine = ahocorasick.Automaton()
        self.text: dict[int, str] = {}
        for piece, i in self.id.items():
            if self.merge(piece) == [piece]:
                self.machine.add_word(piece, (len(piece), i))
                self.text[i] = piece
        self.machine.make_automaton()
        self.known = {p for p in self.id if len(p) == 1}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: best score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives the two."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            found = self.pairs[key] = self.merge(x + y) == [x, y]
        return found

    def known_text(self, text: str) -> list[int]:
        """Ids of a text all of whose characters have pieces."""
        n = len(text)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, hit in self.machine.iter(text):
            matches[end - hit[0] + 1].append(hit)  # shorter ones first
        if matches[0][-1][0] == n:
            return [matches[0][-1][1]]
        free = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        back: list[int] = []  # how many of its place's matches each piece leaves untried
        at, left = 0, len(matches[0])
        while at < n:
            here = matches[at]
            last = out[-1] if out else -1
            while left:
                left -= 1
                size, i = here[left]
                if free[at + size] and (last < 0 or self.follows(last, i)):
                    out.append(i)
                    back.append(left)
                    at += size
                    left = len(matches[at]) if at < n else 0
                    break
            else:
                free[at] = 0
                i = out.pop()
                at -= len(self.text[i])
                left = back.pop()
        return out

    def encode(self, text: str) -> list[int]:
        known = self.known
        if all(c in known for c in text):
            return self.known_text(text) if text else []
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in known:
                if k > start:
                    out += self.known_text(text[start:k])
                out += [self.byte[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            out += self.known_text(text[start:])
        return out


@lru_cache(2)
def _worker(path: str) -> tuple[PieceEncoder, Stretches]:
    made = PieceEncoder(path)
    return made, Stretches(one_by_one(lambda texts: [made.encode(t.replace(" ", SPACE)) for t in texts]), cut_blanks)


def spaced(arr: pa.Array) -> pa.Array:
    """Texts as the model sees them, with plain spaces: one in front of each text that is not empty."""
    arr = pc.replace_substring(pc.fill_null(arr.cast(pa.large_string()), ""), SPACE, " ")
    return pc.if_else(pc.equal(arr, ""), arr, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), arr, pa.scalar(" ", pa.large_string())))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document. A null text is empty and has no ids.

    Rows are worked on alone; ties in score go to the left. An empty table gives no rows.
    """
    return tables.texts(docs).mapInArrow(_rows(path, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def _rows(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, stretches = _worker(path)
        decode = made.model.decode
        names = [str(i) for i in range(made.model.vocab_size())]
        for b in batches:
            for i, ids, at in stretches.batches(spaced(b["text"])):
                own = [ids[x:y].tolist() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                text = [decode(x) if x else "" for x in own]
                doc, n = b["doc_id"].slice(i, len(own)), pa.array([len(x) for x in own], pa.int64())
                if digest:
                    two = [[hashlib.sha256(",".join([names[k] for k in x]).encode()).hexdigest() for x in own], [hashlib.sha256(t.encode()).hexdigest() for t in text]]
                    yield pa.RecordBatch.from_arrays([doc, n, *[pa.array(x, pa.string()) for x in two]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([doc, n, pa.array(own, pa.list_(pa.int32())), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def op10_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables.texts(tables.table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_rows(public_tokenizers.path("piece_bpe_32k.model"), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
