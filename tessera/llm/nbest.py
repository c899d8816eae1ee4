"""N-best SentencePiece segmentation and decoding.

The lattice of a text has an edge for every vocabulary piece found in it, scored with the
piece's score, and byte edges (one for each UTF-8 byte) for characters that are no piece,
scored `BYTE_PENALTY` below the lowest piece score for each character. A segmentation is
a path, its score the sum of its edges' scores. Scores are kept as integers over the least
common denominator of the model's (binary) fractions, so sums and comparisons are exact. Of
equal scores the first that the forward pass meets is the best; the others' order is fixed,
but has no meaning.

Forward Viterbi scores give the best score from the start to every place. The search then
goes backward from the end: a hypothesis' priority is its own score plus the forward score
of the place it has reached. That estimate is exact, so A-star completes segmentations in
order of score and expands little beside the N best paths.

Where no piece of the vocabulary continues from another character to a space mark or
across a newline, every path passes the places before runs of space marks and beside
newlines; the lattice is then searched segment by segment (with any other vocabulary, the
text is one segment). The N best of the text are the N best sums of the segments': only
the N - 1 segments (first places win ties) whose second-best path costs least can differ
from their best path there, and those go through A-star. Short segments recur, so what is
found for one is remembered, up to a bounded number. Of equal priorities the hypothesis
nearest to the start goes first, and hypotheses share their tails, so a segment of any
length costs time and memory in proportion to it.

Texts are encoded whole: null counts as empty; an empty text has one empty segmentation;
spaces become U+2581 with one put in front, as the model's normaliser does; every list
decodes to the text, but for U+2581 in it, which comes back as a space (decoded is false).
Repeated rows are encoded alike; other columns pass through, and a result column whose name
one of them has gets an underscore in front.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import free_name, table

N, CACHE, WAYS, REMEMBERED, BYTE_PENALTY = 4, 1_000_000, 50_000, 64, 10.0
MARK, NONE = "▁", float("-inf")


class Pieces:
    """A SentencePiece model's pieces and scores, and the segments' memory."""

    own: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        usable = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = [model.id_to_piece(i) for i in every]
        # user-defined pieces (runs of marks) have a nominal score far below all others
        low = min(model.get_score(i) for i in usable if model.get_score(i) > -1e8)
        scores = {i: Fraction(max(float(model.get_score(i)), low)) for i in usable}
        self.unit = max(math.lcm(*(x.denominator for x in scores.values())), 1)
        self.penalty = int((Fraction(low) - BYTE_PENALTY) * self.unit)
        self.ids = {self.names[i]: (i, int(x * self.unit)) for i, x in scores.items()}
        self.bytes = {int(self.names[i][1:-1], 16): i for i in every if model.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.known = dict.fromkeys(self.prefixes) | {p: (i.to_bytes(4, "little"), s) for p, (i, s) in self.ids.items()}
        self.raw = [self.byte_of.get(i, x.encode()) for i, x in enumerate(self.names)]
        self.memory: dict[str, tuple[bytes, float, float]] = {}
        self.ways: dict[tuple[str, int], tuple[list[tuple[float, bytes]], bool]] = {}
        self.cuttable = not any(MARK in x.lstrip(MARK) or ("\n" in x and len(x) > 1) for x in self.ids)

    @classmethod
    def at(cls, path: str) -> Pieces:
        if path not in cls.own:
            cls.own[path] = cls(path)
        return cls.own[path]

    @property
    def known(self) -> dict[str, list]:
        """Pieces by character: what follows it, ids and score of the piece that ends here (no ids: only begins one).

        Set from piece -> (ids, score), other beginnings -> None. Scores become doubles
        where sums over any text of under 2**31 characters stay exact.
        """
        return self.trie

    @known.setter
    def known(self, pieces: dict[str, tuple[bytes, int] | None]) -> None:
        ends = {piece: x for piece, x in pieces.items() if x is not None}
        number = float if max(abs(self.penalty), *(abs(score) for _, score in ends.values())) < 1 << 22 else int
        self.miss, self.trie = number(self.penalty), {}
        for piece, (ids, score) in ends.items():
            node = self.trie
            for character in piece[:-1]:
                node = node.setdefault(character, [{}, None, 0])[0]
            node.setdefault(piece[-1], [{}, None, 0])[1:] = [ids, number(score)]

    def edges(self, text: str, start: int) -> list[tuple[int, int, bytes]]:
        """(end, score, ids) of the edges that begin at start."""
        ids, prefixes, found = self.ids, self.prefixes, []
        for end in range(start + 1, len(text) + 1):
            part = text[start:end]
            if part in ids:
                i, score = ids[part]
                found.append((end, score, i.to_bytes(4, "little")))
            elif part not in prefixes:
                break
        if not found or found[0][0] != start + 1:
            found.append((start + 1, self.penalty, self.as_bytes(text[start])))
        return found

    def first(self, text: str) -> tuple[bytes, float, float]:
        """The best ids (little-endian int32), their score in units, and what the second-best path costs more (inf: none)."""
        size, trie, none = len(text), self.trie, [None, None, 0]
        best, second, back = [NONE] * (size + 1), [NONE] * (size + 1), [None] * (size + 1)
        best[0] = 0 * self.miss
        for at in range(size):
            here, behind, node, end = best[at], second[at], trie, at
            while end < size:
                step = node.get(text[end])
                if step is None:
                    break
                node, ids, score = step
                end += 1
                if ids is None:  # begins a piece, but is none
                    continue
                value = here + score
                if value > (old := best[end]):
                    other = behind + score
                    second[end] = old if old > other else other
                    best[end], back[end] = value, (at, ids)
                elif value > second[end]:
                    second[end] = value
            if trie.get(text[at], none)[1] is None:  # no piece of its own
                value, end = here + self.miss, at + 1
                if value > best[end]:
                    second[end] = max(best[end], behind + self.miss)
                    best[end], back[end] = value, (at, self.as_bytes(text[at]))
                elif value > second[end]:
                    second[end] = value
        ids, at = [], size
        while at:
            at, own = back[at]
            ids.append(own)
        return b"".join(ids[::-1]), best[size], best[size] - second[size]

    def as_bytes(self, character: str) -> bytes:
        return np.array([self.bytes[b] for b in character.encode("utf-8", "surrogatepass")], "<i4").tobytes()

    def n_best(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of one segment, scores in units: forward Viterbi, then A-star from the end."""
        size = len(text)
        forward, into = [0] + [NONE] * size, [[] for _ in range(size + 1)]
        for at in range(size):
            for end, score, ids in self.edges(text, at):
                into[end].append((at, score, ids))
                forward[end] = max(forward[end], forward[at] + score)
        agenda, out, made = [(-forward[size], size, 0, 0, None)], [], 0
        while agenda and len(out) < n:
            _, at, _, own, tail = heapq.heappop(agenda)
            if not at:
                ids = []
                while tail:
                    some, tail = tail
                    ids.append(some)
                out.append((own, b"".join(ids)))
                continue
            for before, score, ids in into[at]:
                made += 1
                heapq.heappush(agenda, (-(own + score + forward[before]), before, made, own + score, (ids, tail)))
        return out

    def alternatives(self, text: str, best: bytes, n: int) -> tuple[list[tuple[float, bytes]], bool]:
        """(cost, ids) of a segment's n best segmentations, the one given first, and whether all decode to it; short ones are remembered."""
        found = self.ways.get((text, n))
        if found is None:
            own = self.n_best(text, n)
            ways = [(0, best), *((own[0][0] - score, raw) for score, raw in own if raw != best)][:n]
            plain = text.encode("utf-8", "surrogatepass")
            found = ways, all(self.joined(raw) == plain for _, raw in own)
            if len(text) <= REMEMBERED:
                if len(self.ways) > WAYS:
                    self.ways.clear()
                self.ways[text, n] = found
        return found

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return SEGMENT.findall(marked) if self.cuttable else [marked]

    def encode(self, text: str | None, n: int = N) -> list[tuple[float, bytes]]:
        """(score, ids as little-endian int32) of the n best segmentations, best first."""
        return self.searched(text, n)[0]

    def searched(self, text: str | None, n: int) -> tuple[list[tuple[float, bytes]], bool, list[list[tuple[int, int, bytes]]]]:
        """encode(); whether all of it decodes to the text: the best as a whole, the others
        where they differ from it, as decoding joins the pieces' bytes; and how each but the
        best differs: (place in the best's ids, ids replaced, ids put there), in order."""
        parts, memory = self.segments(text or ""), self.memory
        if not parts:
            return [(0.0, b"")], True, []
        if len(memory) > CACHE:
            memory.clear()
        found = list(map(memory.get, parts))
        for k in [k for k, x in enumerate(found) if x is None] if None in found else []:
            x = parts[k]
            got = found[k] = memory.get(x) or self.first(x)
            if len(x) <= REMEMBERED:
                memory[x] = got
        whole, scores, more = zip(*found, strict=True)
        if type(self.miss) is float:
            open_at = sorted(np.argsort(np.array(more), kind="stable")[: n - 1].tolist())
        else:
            open_at = sorted(heapq.nsmallest(n - 1, range(len(more)), key=more.__getitem__))
        total, best, ranked, ways, sound = sum(scores), b"".join(whole), [(0, ())], {}, True
        for k in open_at:
            if more[k] < math.inf:
                ways[k], decodes = self.alternatives(parts[k], whole[k], n)
                sound = sound and decodes
                ranked = sorted(((c + d, (*chosen, (k, j))) for c, chosen in ranked for j, (d, _) in enumerate(ways[k])), key=lambda x: x)[:n]
        out, patches = [], []
        starts = {k: sum(map(len, whole[:k])) for k in ways}
        for cost, chosen in ranked:
            changes = [(starts[k], len(whole[k]), ways[k][j][1]) for k, j in chosen if j]
            own, done = [], 0
            for at, gone, put in changes:
                own += [best[done:at], put]
                done = at + gone
            patches.append([(at // 4, gone // 4, put) for at, gone, put in changes])
            out.append(((total - cost) / self.unit, b"".join([*own, best[done:]]) if changes else best))
        sound = sound and MARK not in text and self.joined(best) == (MARK + text.replace(" ", MARK)).encode("utf-8", "surrogatepass")
        return out, sound, patches[1:]

    def joined(self, ids: bytes) -> bytes:
        """The bytes of the pieces of little-endian int32 ids, space marks kept."""
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<i4").tolist()])

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


#: Newlines alone; space marks with what follows them up to the next mark or newline.
SEGMENT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def offsets(lists: list, size: int = 1) -> np.ndarray:
    return np.cumsum([0, *(len(x) // size for x in lists)]).astype(np.int32)


def listed(raws: list[bytes]) -> pa.Array:
    """Little-endian int32 ids as an Arrow list each."""
    return pa.ListArray.from_arrays(offsets(raws, 4), pa.array(np.frombuffer(b"".join(raws), "<i4")))


def patched(ids: Column, patch: Column) -> Column:
    """The ids of another segmentation: those of the best with one element of `others` applied."""
    apply = lambda now, p: F.concat(F.slice(now, F.lit(1), p["at"]), p["put"], F.slice(now, p["at"] + p["gone"] + 1, F.size(now)))
    return F.aggregate(F.reverse(patch), ids, apply)


def encoded(docs: DataFrame, model: str, text: str = "text", n: int = N, keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns but the text) with ids and n_pieces of the best segmentation; others, how each of the
    next n - 1 differs from it (`patched` gives their ids); scores and crcs (checksums of the ids) of all n; decoded,
    whether all decode to the text."""
    rest = [c for c in docs.columns if c != text] if keep is None else keep
    fields = {"ids": "array<int>", "n_pieces": "bigint", "others": "array<array<struct<at: int, gone: int, put: array<int>>>>", "scores": "array<double>", "crcs": "array<bigint>", "decoded": "boolean"}
    names = [*rest, *(free_name(c, rest) for c in fields)]
    added = StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in zip(names[len(rest) :], fields.values(), strict=True)))
    schema = StructType([*(docs.schema[c] for c in rest), *added])
    at = [f"c{k}" for k in range(len(rest))]

    def run(batches):
        pieces = Pieces.at(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                found, sound, patches = zip(*(pieces.searched(x, n) for x in some.column(0).to_pylist()), strict=True)
                best = [f[0][1] for f in found]
                each = [x for p in patches for x in p]
                flat = [x for p in each for x in p]
                change = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), listed([x[2] for x in flat])], ["at", "gone", "put"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *some.columns[1:],
                        listed(best),
                        pa.array([len(x) // 4 for x in best], pa.int64()),
                        pa.ListArray.from_arrays(offsets(patches), pa.ListArray.from_arrays(offsets(each), change)),
                        pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                        pa.array([[zlib.crc32(raw) for _, raw in f] for f in found], pa.list_(pa.int64())),
                        pa.array(sound, pa.bool_()),
                    ],
                    names=names,
                )

    given = docs.select(F.col(text).alias("text"), *(F.col(c).alias(a) for c, a in zip(rest, at, strict=True)))
    return given.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


QUERIES = {"op10_sentencepiece_nbest": op10}
