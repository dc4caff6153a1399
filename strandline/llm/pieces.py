"""SentencePiece segmentations sampled by forward filtering and backward sampling.

The lattice of a word (with the space before it) has an arc for each vocabulary piece
and, for each character, an arc for its UTF-8 bytes as byte pieces. A piece that ranks r-th in
the vocabulary weighs ``-alpha * log(r + 2)``, a character spelled in bytes ``-alpha *
log(size + 2)`` for each byte. Forward filtering sums the weights of all paths to
each place of a word, once for each distinct word of a batch; backward sampling then draws
arcs from the end of each occurrence, for all words of a batch of texts at once. The draws are
hashes of the row key, the word's place and the step, so a row's segmentation depends
on nothing but its key, its text, ``alpha`` and ``seed``. Pieces never span words, and newlines
stand alone. A word may be of any length (a text without spaces is one); its lattice takes about 100 bytes a character.

Decoding joins the pieces; since a literal U+2581 is always spelled in bytes, it gives back every text.
Defined cases: a null text has null pieces and decodes to null; an empty text has no pieces;
texts of any length are taken whole; rows of equal key and text sample alike; a null key
is a key of its own; other columns are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import MIX_A, MIX_C, map_arrow, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 2.0, 17
SPACE = "▁"
SHORT_WORD = 64
CHUNK = re.compile(r"\n| ?[^ \n]+| ")
WORDS_AT_ONCE = 100_000
ADD_AT_ONCE = 5_000  # new words filtered together; both bound a worker's memory and change no result
TOP = np.uint32(0xFFFFFFFF)


class Vocabulary:
    def __init__(self, model: bytes):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = s.get_piece_size()
        self.text, self.byte, self.ids = [None] * self.size, [None] * self.size, {}
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(self.size):
            if s.is_byte(i):
                b = int(s.id_to_piece(i)[1:-1], 16)
                self.byte[i], self.byte_id[b] = b, i
            elif not (s.is_control(i) or s.is_unknown(i) or s.is_unused(i)):
                self.text[i] = s.id_to_piece(i)
                self.ids[self.text[i]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so not every text can be spelled")
        self.longest = max(map(len, self.ids), default=1)
        # bytes of each piece when decoded; a space marker is a space
        self.bytes = [bytes([b]) if b is not None else (t or "").replace(SPACE, " ").encode() for t, b in zip(self.text, self.byte, strict=True)]

    def decode(self, pieces) -> str:
        text = b"".join([self.bytes[i] for i in pieces]).decode("utf-8")
        return text[1:] if text else text


class Lattices:
    """Arcs of the words met so far, in flat arrays; emptied at ``limit`` nodes, which changes no result.

    A node is a place in a word after its start. The arcs into a node are a run of
    ``cdf`` (cumulative probabilities, likeliest first), ``before`` (node it comes
    from, -1: the start) and ``code`` (piece, or size + n for the n-th character spelled in several bytes).
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float = ALPHA, limit: int = 1_000_000):
        self.v, self.limit = vocabulary, limit
        ids = np.array(list(vocabulary.ids.values()), np.int64)
        keys = np.zeros(len(ids), np.uint64)
        texts = [np.array(list(map(ord, t)), np.uint64) + np.uint64(1) for t in vocabulary.ids]
        for n in range(1, vocabulary.longest + 1):  # hash of the first n characters of each piece
            own = np.array([i for i, t in enumerate(texts) if len(t) >= n])
            letter = np.array([texts[i][n - 1] for i in own])
            keys[own] = mixed(letter) if n == 1 else mixed(keys[own] * MIX_A + letter)
        keys += np.array([len(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        self.bits = np.zeros(1 << 19, bool)  # rules most windows out
        self.bits[(self.keys >> np.uint64(45)).astype(np.int64)] = True
        self.weights = -alpha * np.log(np.arange(vocabulary.size) + 2.0)
        self.byte_weight = -alpha * np.log(vocabulary.size + 2.0)
        self.wide: dict[int, int] = {}
        self.wide_pieces: list[np.ndarray] = []
        self.reset()

    def reset(self) -> None:
        self.end: dict[str, int] = {}
        self.nodes = self.arcs = 0
        self.new: list[tuple] = []  # arrays still to be appended
        self.start = np.zeros(1, np.int32)
        self.cdf, self.before, self.code = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _spelled(self, char: int) -> int:
        b = chr(char).encode()
        if len(b) == 1:
            return int(self.v.byte_id[b[0]])
        k = self.wide.get(char)
        if k is None:
            k = self.wide[char] = len(self.wide_pieces)
            self.wide_pieces.append(self.v.byte_id[list(b)])
        return self.v.size + k

    def _add(self, words: list[str]) -> None:
        """Forward filtering of new words, all at once, place by place."""
        lengths = np.array(list(map(len, words)), np.int64)
        joined = "".join(words)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = np.frombuffer(joined.replace(SPACE, "\0").replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)  # in its word
        longest = min(self.v.longest, int(lengths.max()))
        letters, which = np.unique(chars, return_inverse=True)
        spelled = np.array([self._spelled(int(c)) for c in letters], np.int32)
        width = np.array([len(chr(int(c)).encode()) for c in letters])
        arcs = [(np.arange(len(codes)), np.ones(len(codes), np.int64), self.byte_weight * width[which], spelled[which])]  # the rest comes before: long pieces are likelier
        h, ends, wide = np.zeros(len(codes), np.uint64), np.arange(len(codes)), codes.astype(np.uint64) + np.uint64(1)
        for n in range(1, longest + 1):
            if n > 1:
                ends = ends[place[ends] >= n - 1]
                h[ends] = mixed(h[ends - 1] * MIX_A + wide[ends])
            else:
                h = mixed(wide)
            key = h[ends] + np.uint64(n)
            may = np.flatnonzero(self.bits[(key >> np.uint64(45)).astype(np.int64)])
            key, hit = key[may], ends[may]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            hit, ids = hit[good], self.key_ids[at[good]]
            arcs.insert(0, (hit, np.full(len(hit), n), self.weights[ids], ids.astype(np.int32)))
        node, span, weight, code = (np.concatenate(x) for x in zip(*arcs, strict=True))
        order = np.argsort(node, kind="stable")
        node, span, weight, code = node[order], span[order], weight[order], code[order]
        at_place = place[node].astype(np.uint8 if int(lengths.max()) < 256 else np.int32)
        came = np.where(span > at_place, -1, node - span)
        total = np.zeros(len(codes) + 1)  # the last stands for the start
        by_place = np.argsort(at_place, kind="stable")
        for rows in np.split(by_place, np.cumsum(np.bincount(at_place))[:-1]):
            x, own = weight[rows] + total[came[rows]], node[rows]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            many = np.diff(np.concatenate([first, [len(rows)]]))
            top = np.maximum.reduceat(x, first)
            sums = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), first))
            total[own[first]] = sums
            weight[rows] = np.exp(x - np.repeat(sums, many))
        n_arcs = np.bincount(node, minlength=len(codes))
        last = np.cumsum(n_arcs)
        q = np.rint(weight * 2.0**32).astype(np.int64)  # integers add up alike wherever a word stands
        run = np.cumsum(q)
        cdf = np.minimum(run - np.repeat(run[last - n_arcs] - q[last - n_arcs], n_arcs), TOP).astype(np.uint32)
        cdf[last - 1] = TOP
        self.new.append((cdf, np.where(came < 0, -1, came + self.nodes).astype(np.int32), code, (self.arcs + last).astype(np.int32)))
        self.arcs += int(last[-1])
        for w, e in zip(words, (starts + lengths - 1 + self.nodes).tolist(), strict=True):
            self.end[w] = e
        self.nodes += len(codes)

    def ends(self, words: list[str]) -> np.ndarray:
        """The end node of each word."""
        if self.nodes > self.limit:
            self.reset()
        new = list({w: None for w in words if w not in self.end})
        short = [w for w in new if len(w) <= SHORT_WORD]
        for at in range(0, len(short), ADD_AT_ONCE):
            self._add(short[at : at + ADD_AT_ONCE])
        if len(short) < len(new):  # filtered by themselves, since filtering goes place by place
            self._add([w for w in new if len(w) > SHORT_WORD])
        if self.new:
            have = self.cdf, self.before, self.code, self.start
            self.cdf, self.before, self.code, self.start = (np.concatenate([a, *b]) for a, b in zip(have, zip(*self.new, strict=True), strict=True))
            self.new = []
        return np.fromiter(map(self.end.__getitem__, words), np.int64, len(words))

    def sample(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words in order, number of codes of each word); ``keys`` seed the draws of each word."""
        node = self.ends(words)
        alive, steps = np.arange(len(words)), []
        counts = np.zeros(len(words), np.int64)
        while len(alive):
            u = (mixed(keys[alive] + np.uint64((int(MIX_A) * (len(steps) + 1)) & (2**64 - 1))) >> np.uint64(32)).astype(np.uint32)
            u = np.minimum(u, TOP - np.uint32(1))
            arc = self.start[node].astype(np.int64)
            late = np.flatnonzero(self.cdf[arc] <= u)
            while len(late):
                arc[late] += 1
                late = late[self.cdf[arc[late]] <= u[late]]
            steps.append((alive, self.code[arc]))
            counts[alive] += 1
            node = self.before[arc].astype(np.int64)
            go = node >= 0
            alive, node = alive[go], node[go]
        left = np.cumsum(counts)
        out = np.zeros(int(left[-1]) if len(left) else 0, np.int64)
        for at, codes in steps:  # from the end of each word
            left[at] -= 1
            out[left[at]] = codes
        return out, counts

    def segment(self, texts: list[str | None], keys: list) -> list[np.ndarray | None]:
        """Sampled pieces of each text."""
        words, sizes, seeds = [], [], []
        for text, key in zip(texts, keys, strict=True):
            found = CHUNK.findall(" " + text) if text else []
            words += found
            sizes.append(len(found))
            seeds.append(key)
        n = np.array(sizes, np.int64)
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        codes, counts = self.sample(words, mixed(np.repeat(np.array(seeds, np.uint64), n) + place.astype(np.uint64) * MIX_C))
        per_text = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(n)])]
        out: list[np.ndarray | None] = []
        for i, text in enumerate(texts):
            part = codes[per_text[i] : per_text[i + 1]]
            if len(part) and part.max() >= self.v.size:
                part = np.concatenate([self.wide_pieces[c - self.v.size] if c >= self.v.size else [c] for c in part.tolist()])
            out.append(None if text is None else part.astype(np.int32))
        return out


def _key(value, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(str(value), seed=seed)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoder(packed, at_text: int, at_key: int, names: list[str], alpha: float, seed: int):
    def run(batches):
        lattices = Lattices(Vocabulary(packed.value), alpha)
        for batch in batches:
            texts, keys = batch.column(at_text), batch.column(at_key)
            held, seeds, size = [], [], 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                held.append(t)
                seeds.append(_key(keys[i].as_py(), seed))
                size += len(t or "")
                if size >= 6 * WORDS_AT_ONCE or i == len(texts) - 1:
                    rows = batch.slice(i + 1 - len(held), len(held))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lattices.segment(held, seeds), pa.list_(pa.int32()))], names=names)
                    held, seeds, size = [], [], 0

    return run


def _decoder(packed, at: int, names: list[str]):
    def run(batches):
        table = Vocabulary(packed.value).bytes
        for batch in batches:
            lists, out = batch.column(at), []
            for i in range(len(lists)):
                value = lists[i].values
                if value is None:
                    out.append(None)
                    continue
                text = b"".join(map(table.__getitem__, value.to_numpy(zero_copy_only=False).tolist())).decode()
                out.append(text[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=names)

    return run


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", to: str = "pieces", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``df`` with the sampled pieces of ``text`` in column ``to`` (one of that name is replaced)."""
    df = df.drop(to)
    packed = df.sparkSession.sparkContext.broadcast(_model_bytes(model))  # half a MB
    schema = _with(df.schema, to, T.ArrayType(T.IntegerType(), False))
    return map_arrow(df, _encoder(packed, df.columns.index(text), df.columns.index(key), schema.names, alpha, seed), schema)


def decode(df: DataFrame, pieces: str = "pieces", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of ``pieces`` in column ``to`` (one of that name is replaced)."""
    df = df.drop(to)
    packed = df.sparkSession.sparkContext.broadcast(_model_bytes(model))
    schema = _with(df.schema, to, T.StringType())
    return map_arrow(df, _decoder(packed, df.columns.index(pieces), schema.names), schema)


def sentencepiece(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``df`` with ``pieces`` and ``decoded``, by one worker a task."""
    df = df.drop("pieces", "decoded")
    packed = df.sparkSession.sparkContext.broadcast(_model_bytes(model))
    middle = _with(df.schema, "pieces", T.ArrayType(T.IntegerType(), False))
    schema = _with(middle, "decoded", T.StringType())
    encoded = _encoder(packed, df.columns.index(text), df.columns.index(key), middle.names, alpha, seed)
    decoded = _decoder(packed, len(middle) - 1, schema.names)
    return map_arrow(df, lambda batches: decoded(encoded(batches)), schema)
