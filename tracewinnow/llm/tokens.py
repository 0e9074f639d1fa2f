"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled once from the model file, three transducers:

* ``Normaliser``: rewrites characters (the model's character map, longest match
  first), maps a space to the word mark, and puts one before the text;
* ``Pieces``: a trie whose arcs read a character and whose leaves write a piece;
* byte fallback: reads a character that no piece is, and writes its UTF-8 bytes.

Their composition with an input has a state for each position and last piece.
Weights are of the tropical semiring.  A piece of a unigram model weighs its
negative log probability.  A piece of a merge model (BPE) weighs 1, and
``BORDER`` more after a piece with which it can't stand: merging the characters
of the two by the model's order must give back just these two.  The pieces that
the merges give are the only path without such a border, for a text and for
each beginning of it, so the shortest path is the encoding, and the shortest
path to a position always goes on from the shortest one to a position before.

No piece holds a word mark after another character, so the composition falls
apart at the words (and at line ends, which no piece holds).  The words of a
batch are told apart, those not met before are solved side by side, relaxing
the arcs of all of them at once, and their ids are gathered in Arrow.

A literal word mark in the text is normalised to a symbol that only byte
fallback reads, so decoding gives every text back exactly, as long as the model
has no character map and keeps white space; else it gives the normalised text.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

MARK = "▁"
#: What a literal word mark is normalised to; no text holds a surrogate.
LITERAL = "\udc81"
INF = float("inf")
#: Weight of a border that the merges don't leave, and of a character that is no piece.
BORDER, UNKNOWN = 1e9, 10.0
#: Bytes of words and paths that a task remembers in each of two generations, and the longest word among them.
REMEMBERED, LONGEST = 48 << 20, 64
#: Slots of a worker's table of borders.
BORDERS = 1 << 21
#: Words that are solved side by side, the fewest for which that pays, and the longest of them.
BLOCK, FEWEST, WIDEST = 16_384, 32, 40
#: Characters with own columns in the trie's table; the others' arcs are searched.
COLUMNS = 128
NORMAL, USER_DEFINED, BYTE, UNIGRAM = 1, 4, 6, 1


def default_model() -> str:
    """The vocabulary that is installed beside the libraries; any other is a parameter."""
    return "/opt/tokenizers/piece_bpe_32k.model"


def character_map(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled character map: a double-array trie of byte strings, then the replacements, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64)
    replacements = blob[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, labels = units & ((1 << 31) | 255), np.arange(1, 256)
    rules: dict[str, str] = {}
    stack = [(int(offset[0]), b"")]
    while stack:
        base, key = stack.pop()
        at = base ^ labels
        at = at[at < len(units)]
        for child, letter in zip(at.tolist(), (base ^ at).tolist()):
            if label[child] == letter:
                own = child ^ int(offset[child])
                if units[child] >> 8 & 1:
                    start = int(units[own] & 0x7FFFFFFF)
                    rules[(key + bytes([letter])).decode()] = replacements[start : replacements.index(b"\0", start)].decode()
                stack.append((own, key + bytes([letter])))
    return rules


class Normaliser:
    """The first transducer: character rules, white space, the mark before the text."""

    def __init__(self, spec, fixed: list[str]):
        self.prefix, self.collapse = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        rules = character_map(spec.precompiled_charsmap)
        self.single = {ord(k): v for k, v in rules.items() if len(k) == 1}
        self.longer = {k: v for k, v in rules.items() if len(k) > 1}
        self.depth = max(map(len, rules), default=0)
        self.starts = re.compile(f"[{re.escape(''.join(sorted({k[0] for k in self.longer})))}]") if self.longer else None
        self.fixed = re.compile("(" + "|".join(map(re.escape, sorted(fixed, key=len, reverse=True))) + ")") if fixed else None

    def rewritten(self, text: str) -> str:
        if not self.depth:
            return text
        if self.starts is None or not self.starts.search(text):
            return text.translate(self.single)
        out, i = [], 0
        while i < len(text):
            n = next((n for n in range(min(self.depth, len(text) - i), 1, -1) if text[i : i + n] in self.longer), 1)
            out.append(self.longer[text[i : i + n]] if n > 1 else self.single.get(ord(text[i]), text[i]))
            i += n
        return "".join(out)

    def parts(self, text: str) -> list[str]:
        """The normalised text; every second part is a user-defined piece, which is never rewritten."""
        parts = self.fixed.split(text) if self.fixed else [text]
        parts = [p if i % 2 else self.rewritten(p).replace(MARK, LITERAL) for i, p in enumerate(parts)]
        if self.collapse:
            parts = [p if i % 2 else re.sub(" +", " ", p) for i, p in enumerate(parts)]
            parts[0] = parts[0].lstrip(" ")
            parts[-1] = parts[-1].rstrip(" ")
        if not any(parts):
            return []
        parts = [p.replace(" ", MARK) for p in parts]
        return [MARK + parts[0], *parts[1:]] if self.prefix else parts


class Pieces:
    """The second transducer as tables: ``step`` goes from nodes over characters, ``piece`` is what a node writes, or -1."""

    def __init__(self, piece: dict[str, int]):
        used: dict[str, int] = {}
        nodes: dict[str, int] = {"": 0}
        for p in piece:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    used[p[n - 1]] = used.get(p[n - 1], 0) + 1
        order = sorted(used, key=lambda c: (-used[c], c))
        self.column = np.zeros(0x110000, dtype=np.int32)  # of a character; 0: no piece holds it
        for k, c in enumerate(order):
            self.column[ord(c)] = k + 1
        self.n_columns = len(order) + 1
        self.piece = np.full(len(nodes), -1, dtype=np.int32)
        self.dense = np.zeros((len(nodes), COLUMNS), dtype=np.int32)
        rare = {}
        for p, node in nodes.items():
            self.piece[node] = piece.get(p, -1)
            if p:
                c = int(self.column[ord(p[-1])])
                if c < COLUMNS:
                    self.dense[nodes[p[:-1]], c] = node
                else:
                    rare[nodes[p[:-1]] * self.n_columns + c] = node
        self.rare = np.array([*sorted(rare), 1 << 62], dtype=np.int64)
        self.rare_to = np.array([*(rare[k] for k in sorted(rare)), 0], dtype=np.int32)
        self.alone = np.zeros(self.n_columns, dtype=bool)  # characters that are pieces themselves
        for c in order:
            self.alone[self.column[ord(c)]] = c in piece
        self.nodes = {p: piece.get(p, -1) for p in nodes if p}

    def step(self, node: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The nodes reached; 0 where there is no arc."""
        out = self.dense[node, np.minimum(column, COLUMNS - 1)]
        odd = np.flatnonzero(column >= COLUMNS)
        out[column == COLUMNS - 1] = self.dense[node[column == COLUMNS - 1], COLUMNS - 1]
        if len(odd):
            key = node[odd].astype(np.int64) * self.n_columns + column[odd]
            at = np.searchsorted(self.rare, key)
            out[odd] = np.where(self.rare[at] == key, self.rare_to[at], 0)
        return out


class Transducer:
    """The three transducers of one model, their composition with texts, and the shortest paths found so far."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that write a space as a word mark before a word are supported")
        self.merges = proto.trainer_spec.model_type != UNIGRAM
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.weight = np.array([1.0 if self.merges else -s for s in self.score])
        self.piece = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.fixed = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == USER_DEFINED}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte fallback, so it can't encode every text")
        if self.fixed and not self.merges:
            raise ValueError("user-defined pieces are supported in models of merges only")
        self.normaliser = Normaliser(spec, [p.replace(MARK, " ") for p in self.fixed])
        self.prefix = self.normaliser.prefix
        self.pieces = Pieces(self.piece)
        written = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_of = [written.get(i, p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"") for i, p in enumerate(proto.pieces)]
        self.written = pa.array(self.bytes_of, pa.large_binary())
        #: What the composition falls apart into: words, if no piece holds a mark after another character or a line end, and runs of characters that no piece holds.
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.piece)
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
        inside = re.escape("".join(sorted(set("".join(self.piece)))))
        self.runs = re.compile(f"[{inside}]+|[^{inside}]+")
        self.ends: dict[int, tuple[list, list] | None] = {}
        self.borders = np.full(BORDERS, -1, dtype=np.int64)  # by a hash of two pieces: the pieces, and whether they can stand so
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    # --- borders of pieces in a model of merges ---

    def edges(self, p: int) -> tuple[list, list] | None:
        """How the merges build piece ``p`` from its characters, seen from its two ends.

        For either end the symbols that stand there one after another, each with
        the score of the merge that consumes it.  None if the merges give
        something else than ``p``.
        """
        if p in self.ends:
            return self.ends[p]
        symbols = list(self.text[p])
        left, right = [[symbols[0], -INF]], [[symbols[-1], -INF]]
        while len(symbols) > 1:
            best, at = -INF, -1
            for i in range(len(symbols) - 1):
                k = self.piece.get(symbols[i] + symbols[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if at == 0:
                left[-1][1] = best
                left.append([symbols[0], -INF])
            if at == len(symbols) - 1:
                right[-1][1] = best
                right.append([symbols[-1], -INF])
        self.ends[p] = (left, right) if len(symbols) == 1 else None
        return self.ends[p]

    def allowed(self, a: int, b: int) -> bool:
        """Whether piece ``b`` can stand after piece ``a``: no merge across their border comes before those that build them.

        The symbols on the two sides of the border change in the order of the
        scores of their merges, the left side first among equals.  Bytes, as
        piece -1, stand beside anything.
        """
        x, y = self.edges(a) if a >= 0 else ((), ()), self.edges(b)
        if x is None or y is None:
            return False
        if a < 0:
            return True
        x, y, i, j = x[1], y[0], 0, 0
        while True:
            (s, before), (t, after) = x[i], y[j]
            k = self.piece.get(s + t)
            if k is not None and self.score[k] > before and self.score[k] >= after:
                return False
            if before == after == -INF:
                return True
            if before >= after:
                i += 1
            else:
                j += 1

    def border(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:func:`allowed` of many pairs, remembered in a table of fixed size."""
        pair = (a.astype(np.int64) + 1) * len(self.text) + b
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64) & (BORDERS - 1)
        found = self.borders[slot]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            distinct, back = np.unique(pair[new], return_inverse=True)
            known = np.array([p << 1 | self.allowed(p // len(self.text) - 1, p % len(self.text)) for p in distinct.tolist()], dtype=np.int64)
            found[new] = known[back]
            self.borders[slot[new]] = found[new]
        return (found & 1).astype(bool)

    def one_border(self, a: int, b: int) -> bool:
        pair = (a + 1) * len(self.text) + b
        slot = pair * 0x9E3779B97F4A7C15 >> 43 & BORDERS - 1
        found = int(self.borders[slot])
        if found >> 1 != pair:
            self.borders[slot] = found = pair << 1 | self.allowed(a, b)
        return bool(found & 1)

    # --- shortest paths ---

    def shortest(self, word: str) -> list[int]:
        """The shortest path through the composition with one word."""
        n = len(word)
        weight, piece, before = [INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        node, of = self.pieces.nodes.get, self.weight
        for i in range(n):
            here, a = weight[i], piece[i]
            if word[i] not in self.piece and here + UNKNOWN < weight[i + 1]:
                weight[i + 1], piece[i + 1], before[i + 1] = here + UNKNOWN, -1, i
            for j in range(i + 1, n + 1):
                b = node(word[i:j])
                if b is None:
                    break
                if b >= 0 and here + of[b] < weight[j]:
                    cost = here + of[b]
                    if self.merges and not self.one_border(a, b):
                        cost += BORDER
                    if cost < weight[j]:
                        weight[j], piece[j], before[j] = cost, b, i
        out: list[int] = []
        at = n
        while at:
            if piece[at] < 0:
                c = word[before[at]]
                out += [self.byte[x] for x in reversed((MARK if c == LITERAL else c).encode())]
            else:
                out.append(piece[at])
            at = before[at]
        out.reverse()
        return out

    def side_by_side(self, columns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of words whose characters are all pieces, one word a row, shorter ones first: their ids, one after another, and how many each has."""
        rows, width = columns.shape
        weight = np.full((rows, width + 1), INF)
        piece = np.full((rows, width + 1), -1, dtype=np.int32)
        before = np.zeros((rows, width + 1), dtype=np.int16)
        weight[:, 0] = 0
        for i in range(width):
            at = np.arange(np.searchsorted(size, i, "right"), rows)  # words that go on
            node = np.zeros(len(at), dtype=np.int32)
            for j in range(i, width):
                node = self.pieces.step(node, columns[at, j])
                alive = node > 0  # rows are filled up with column 0, from which no arc goes
                at, node = at[alive], node[alive]
                if not len(at):
                    break
                b = self.pieces.piece[node]
                hit = b >= 0
                r, b = at[hit], b[hit]
                cost = weight[r, i] + self.weight[b]
                less = cost < weight[r, j + 1]
                r, b, cost = r[less], b[less], cost[less]
                if self.merges and len(r):
                    cost += BORDER * ~self.border(piece[r, i], b)
                    less = cost < weight[r, j + 1]
                    r, b, cost = r[less], b[less], cost[less]
                weight[r, j + 1], piece[r, j + 1], before[r, j + 1] = cost, b, i
        taken = []
        at, row = size.astype(np.int64), np.arange(rows)
        count = np.zeros(rows, dtype=np.int64)
        while len(row):
            taken.append((row, piece[row, at]))
            count[row] += 1
            at = before[row, at]
            row, at = row[at > 0], at[at > 0]
        ids = np.empty(int(count.sum()), dtype=np.int32)
        end = np.cumsum(count) - 1
        for k, (row, own) in enumerate(taken):  # from the last piece of each
            ids[end[row] - k] = own
        return ids, count

    def solve(self, words: list[str]) -> list[bytes]:
        """The ids of each word's path as 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= WIDEST].tolist()
        alone = order[size[order] > WIDEST].tolist()
        for k in range(0, len(short), BLOCK):
            block = short[k : k + BLOCK]
            if len(block) < FEWEST:
                alone += block
                continue
            n = size[block]
            flat = np.frombuffer("".join([words[i] for i in block]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            column = self.pieces.column[flat]
            start = np.concatenate(([0], np.cumsum(n)[:-1]))
            good = np.logical_and.reduceat(self.pieces.alone[column], start)
            table = np.zeros((len(block), int(n[-1])), dtype=np.int32)
            table[np.repeat(np.arange(len(block)), n), np.arange(len(flat)) - np.repeat(start, n)] = column
            alone += [i for i, g in zip(block, good.tolist()) if not g]
            if good.any():
                own = [i for i, g in zip(block, good.tolist()) if g]
                ids, count = self.side_by_side(table[good], n[good])
                data, ends = ids.tobytes(), (np.cumsum(count) * 4).tolist()
                for i, a, b in zip(own, [0, *ends], ends):
                    out[i] = data[a:b]
        runs = [self.runs.findall(words[i]) for i in alone]
        known = {w: array("i", self.shortest(w)).tobytes() for own in runs if len(own) == 1 for w in own}
        more = sorted({w for own in runs if len(own) > 1 for w in own} - known.keys())
        if more:  # a run has no other runs in it, so this goes one level deep
            known |= zip(more, self.solve(more))
        for i, own in zip(alone, runs):
            out[i] = b"".join([known[w] for w in own])
        return out

    def paths(self, words: list[str]) -> list[bytes]:
        """:func:`solve`, of words that are remembered or else solved together."""
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        new = []
        for i, p in enumerate(out):
            if p is None:
                out[i] = found = old.get(words[i])
                if found is None:
                    new.append(i)
                else:
                    self.remember(words[i], found)
        for i, p in zip(new, self.solve([words[i] for i in new])):
            out[i] = p
            self.remember(words[i], p)
        return out

    def remember(self, word: str, path: bytes) -> None:
        if len(word) > LONGEST:
            return
        self.young[word] = path
        self.held += 160 + 2 * len(word) + len(path)
        if self.held > REMEMBERED:
            self.old, self.young, self.held = self.young, {}, 0

    def forget(self) -> None:
        self.young, self.old, self.held = {}, {}, 0
        gc.collect()

    def words(self, text: str) -> list[str]:
        """The pieces of the normalised text at whose borders the paths fall apart."""
        out: list[str] = []
        for i, part in enumerate(self.normaliser.parts(text) if text else ()):
            if part:
                out += [part] if i % 2 or not self.by_word else self.cut.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end; none for the empty text."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        codes: list[int] = []
        ends = [0]
        for text in texts:
            codes += map(number.__getitem__, self.words(text))
            ends.append(len(codes))
        distinct = list(number)
        known = {w: array("i", [i]).tobytes() for w, i in self.fixed.items()}
        free = [w for w in distinct if w not in known] if known else distinct
        known |= zip(free, self.paths(free))
        ids = pa.array([known[w] for w in distinct], pa.large_binary()).take(pa.array(codes, pa.int64()))
        if not len(ids):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        _, offsets, data = ids.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return np.frombuffer(data, dtype=np.int32, count=int(offsets[-1]) // 4), offsets[ends] // 4

    def encode(self, text: str) -> bytes:
        """The ids of one text as 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    # --- the inverse transducer ---

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts that ids stand for."""
        written = self.written.take(pa.array(ids))
        if not len(written):
            return pa.array([""] * (len(offsets) - 1), pa.large_string())
        _, ends, data = written.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[written.offset : written.offset + len(written) + 1]
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(ends[offsets])), data)
        return pc.utf8_slice_codeunits(texts, 1) if self.prefix else texts

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for."""
        return self.decode_all(np.array(ids, dtype=np.int32), np.array([0, len(ids)]))[0].as_py()


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer for each worker and model; a task forgets its words when it ends."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, and the text decoded from the ids.

    A null text counts as empty, which has no tokens.  Texts are encoded whole,
    however long; a word of over ``LONGEST`` characters is solved each time.
    Between paths of equal weight the one whose last piece begins first is
    taken.  Repeated rows give repeated results, rows without an id keep a null
    id, an empty table gives an empty result, and other columns are ignored,
    whatever their names.  The model file is read on the driver (half a
    megabyte) and sent with the tasks.
    """
    with open(model_path or default_model(), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model)
        for batch in slices(batches):
            flat, offsets = t.encode_all([x or "" for x in batch.column("text").to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), ids, t.decode_all(flat, offsets).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
        t.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_batches, run, SCHEMA)


def token_digest(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Counts and digests of :func:`encode`; ids as comma-joined decimals, the decoded text in UTF-8."""
    return encode(docs, model_path).select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))
