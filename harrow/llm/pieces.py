"""SentencePiece encoding and decoding by weighted transducers over the tropical semiring.

A model file is compiled into four machines. The normaliser rewrites characters (blanks become U+2581, with one more in front; the
rules of a character map, longest first; runs of blanks as one, if the model says so). The lexicon, a tree of the pieces'
characters, accepts a piece's text and puts out its id. The fallback accepts one character that is no piece and puts out the pieces of its bytes, or the
unknown piece. The grammar accepts sequences of pieces: its states are the last piece. The composition of all four with a text is never written out:
its states are a position, a state of the lexicon and the last piece, and arcs are made when a state is reached. The path of least weight is the encoding.

With a unigram model a piece weighs its negated log-probability and the grammar has one state. Byte-pair encoding is not a sum of weights, but
its segmentation is the only one in which every two neighbouring pieces are also what the merges make of the two alone. So in
its grammar a piece weighs 0 after one it can follow and infinity after any other, the weight being worked out by the merges when first asked for.
Decoding runs the lexicon and the fallback the other way.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import parts, table

BLANK = "\u2581"
# Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
START = -1
INFINITY = float("inf")
#: By how much an unknown character weighs more than the worst piece.
PENALTY = 10.0


def tree_of(entries: Iterator[tuple[str, object]]) -> dict:
    """A tree of the entries' characters: for each character what follows it and what is put out there (None: nothing)."""
    root: dict = {}
    for text, output in entries:
        node = root
        for c in text[:-1]:
            node = node.setdefault(c, ({}, None))[0]
        if text:
            node[text[-1]] = (node.get(text[-1], ({}, None))[0], output)
    return root


def character_rules(charsmap: bytes) -> Iterator[tuple[str, str]]:
    """(text, replacement) of a precompiled character map: the size of a double-array tree, its units, and the replacements, each with a 0 at its end."""
    size = int.from_bytes(charsmap[:4], "little")
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4), charsmap[4 + size :]

    def below(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    every = np.arange(1, 256)
    work = [(below(0, int(units[0])), b"")]
    while work:
        base, key = work.pop()
        places = base ^ every
        places, letters = places[places < len(units)], every[places < len(units)]
        there = units[places] & 0x800000FF == letters
        for place, letter in zip(places[there].tolist(), letters[there].tolist(), strict=True):
            unit = int(units[place])
            child, text = below(place, unit), key + bytes([letter])
            if unit >> 8 & 1:
                at = int(units[child]) & 0x7FFFFFFF
                yield text.decode(errors="replace"), texts[at : texts.index(0, at)].decode()
            work.append((child, text))


class Normaliser:
    """Rewrites a text, character by character. Without a character map one state is enough, with one arc that doesn't put out what it reads."""

    def __init__(self, spec):
        self.front, self.single = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.blank = BLANK if spec.escape_whitespaces else " "
        self.rules = tree_of(character_rules(spec.precompiled_charsmap)) if spec.precompiled_charsmap else None

    def rewritten(self, text: str) -> str:
        """The text under the rules, the longest that fits first at each place."""
        out, at, size = [], 0, len(text)
        while at < size:
            node, place, found = self.rules, at, None
            while place < size and (arc := node.get(text[place])) is not None:
                node, place = arc[0], place + 1
                if arc[1] is not None:
                    found = arc[1], place
            piece, at = found or (text[at], at + 1)
            out.append(piece)
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.rules is not None:
            text = self.rewritten(text)
        if self.single:  # two states: after a blank, as at the start, further ones put out nothing
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (self.blank if self.front else "") + text.replace(" ", self.blank)


class Transducer:
    KEPT, PAIRS = 300_000, 1_000_000  # entries that are kept of what has been worked out

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER for p in model.pieces):
            raise ValueError("only unigram and BPE models without pieces of the user's own and with blanks in front are compiled")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.text, self.score = [p.piece for p in model.pieces], [p.score for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.ids = {self.text[i]: i for i in normal}
        self.lexicon = tree_of((self.text[i], i) for i in normal)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_pieces = [byte[b] for b in range(256)] if len(byte) == 256 else None
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0)
        self.worst = -min((self.score[i] for i in normal), default=0.0) + PENALTY
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode() if p.type == NORMAL else b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" for p in model.pieces]
        joined = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}  # characters that stand together in some piece
        self.cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+") if not any(b == BLANK != a for a, b in joined) else None
        self.written = [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.joined = joined if self.kind == BPE else None
        self.within = {c for pair in joined for c in pair if c not in self.ids}  # characters that are no piece, but in some
        self.follows: dict[int, dict[int, float]] = {}  # the grammar's arcs, as far as they have been made
        self.made = 0
        self.split: dict[int, tuple[int, int]] = {}
        order = sorted((i for i in normal if len(self.text[i]) > 1), key=lambda i: -self.score[i])
        self.rank = {piece: at for at, piece in enumerate(order)}  # of merges, by what they make
        several = {a for a, n in Counter(self.score[i] for i in order).items() if n > 1}
        self.tied = {i for i in order if self.score[i] in several or self.merged(self.text[i]) != [i]} if self.kind == BPE else set()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int]:
        """Byte-pair encoding step by step: the pair with the best score first, the leftmost of equals. Characters that are no piece are START - 1 - code point."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (t := self.ids.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-self.score[t], i, j, symbols[i] + symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j], after[i] = both, None, after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ids[s] if s in self.ids else START - 1 - ord(s) for s in symbols if s is not None]

    def parts_of(self, piece: int) -> tuple[int, int]:
        """The two pieces (or characters that are none) whose merge makes a piece, last of the merges of its text; the piece itself twice if it is one character."""
        if piece < 0 or len(self.text[piece]) == 1:
            return piece, piece
        if piece not in self.split:
            text, score = self.text[piece], self.score
            symbols = [self.symbol(c) for c in text]
            while len(symbols) > 2:
                both = [self.ids.get(self.text_of(a) + self.text_of(b)) for a, b in zip(symbols, symbols[1:], strict=False)]
                able = [i for i, t in enumerate(both) if t is not None]
                if not able:
                    break
                i = max(able, key=lambda i: (score[both[i]], -i))
                symbols[i : i + 2] = [both[i]]
            self.split[piece] = (symbols[0], symbols[1]) if len(symbols) == 2 else None
        return self.split[piece]

    def symbol(self, c: str) -> int:
        return self.ids.get(c, START - 1 - ord(c))

    def text_of(self, piece: int) -> str:
        return self.text[piece] if piece >= 0 else chr(START - 1 - piece)

    def apart(self, last: int, piece: int) -> bool:
        """Whether the merges of the two pieces' text make just these two: taken apart again, latest merge first, no merge across the border comes earlier.

        Only for pieces whose scores no other piece has.
        """
        limit, rank = INFINITY, self.rank
        while True:
            across = self.ids.get(self.text_of(last) + self.text_of(piece))
            if across is not None and rank[across] < limit:
                return False
            left, right = rank.get(last, -1), rank.get(piece, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, last = left, self.parts_of(last)[1]
            else:  # of two equal merges the left one comes first
                limit, piece = right + 1, self.parts_of(piece)[0]

    def arc(self, last: int, piece: int) -> float:
        """The grammar's weight of piece after last, made by the merges; START - 1 - code point stands for a character that is no piece."""
        if self.made >= self.PAIRS:
            self.follows.clear()
            self.made = 0
        if last == START:
            fits = piece < 0 or len(self.text[piece]) == 1 or self.merged(self.text[piece]) == [piece]
        elif last in self.tied or piece in self.tied:
            fits = self.merged(self.text_of(last) + self.text_of(piece)) == [last, piece]
        else:
            fits = self.apart(last, piece)
        weight = 0.0 if fits else INFINITY
        self.follows.setdefault(last, {})[piece] = weight
        self.made += 1
        return weight

    def lightest(self, text: str) -> list[int]:
        """The path of least weight through the composition with text, as pieces; START - 1 - code point is the fallback's for a character.

        The weights of a unigram model add up, so positions are settled from left to right.
        """
        size, score, worst = len(text), self.score, self.worst
        cost, arc = [0.0] + [INFINITY] * size, [None] * (size + 1)
        for begin in range(size):
            so_far, node, alone = cost[begin], self.lexicon, True
            for end in range(begin + 1, size + 1):
                if (hit := node.get(text[end - 1])) is None:
                    break
                node, piece = hit
                if piece is not None:
                    alone = alone and end > begin + 1
                    if (total := so_far - score[piece]) < cost[end]:
                        cost[end], arc[end] = total, (begin, piece)
            if alone and (total := so_far + worst) < cost[begin + 1]:
                cost[begin + 1], arc[begin + 1] = total, (begin, START - 1 - ord(text[begin]))
        out, at = [], size
        while at:
            at, piece = arc[at]
            out.append(piece)
        return out[::-1]

    def only(self, text: str) -> list[int]:
        """The same for byte-pair encoding, where a path weighs 0 or infinity.

        All paths that are left weigh the same, so the search goes on from the furthest position reached, by the longest piece first, and
        goes back where no arc of finite weight is left. Only one such path leads to any position, so none is entered twice.
        """
        size, follows, lexicon, ids, within = len(text), self.follows, self.lexicon, self.ids, self.within
        path: list[int] = []
        stack, seen, at, last = [], set(), 0, START
        while at < size:
            node, found = lexicon, []
            for end in range(at, size):
                if (arc := node.get(text[end])) is None:
                    break
                node, piece = arc
                if piece is not None:
                    found.append((end + 1, piece))
            if text[at] not in ids:
                found.insert(0, (at + 1, START - 1 - ord(text[at])))
            while True:
                known = follows.get(last)
                while found:
                    end, piece = found.pop()
                    if end not in seen:
                        weight = None if known is None else known.get(piece)
                        if (self.arc(last, piece) if weight is None else weight) == 0.0:
                            break
                else:  # the merges' own segmentation is a path, so one is left further back
                    last, found = stack.pop()
                    path.pop()
                    continue
                break
            stack.append((last, found))
            seen.add(end)
            path.append(piece)
            # nothing merges with a character that is in no piece
            at, last = end, START if piece < 0 and text[end - 1] not in within else piece
        return path

    def put_out(self, path: list[int]) -> bytes:
        """Ids on a path as little-endian uint32, the fallback's for characters that are no piece."""
        if not path or min(path) >= 0:
            return b"".join(map(self.written.__getitem__, path))
        out: list[bytes] = []
        for piece in path:
            if piece >= 0:
                out.append(self.written[piece])
            elif self.byte_pieces:
                out += [self.written[self.byte_pieces[b]] for b in chr(START - 1 - piece).encode()]
            elif not out or out[-1] != self.written[self.unknown]:  # unknown characters in a row are one piece
                out.append(self.written[self.unknown])
        return b"".join(out)

    def chunk(self, text: str) -> bytes:
        """Ids of a part of a normalised text that no piece crosses the ends of. It is cut further where no piece has the two characters together."""
        if self.kind == UNIGRAM or not self.byte_pieces:
            return self.put_out(self.lightest(text) if self.kind == UNIGRAM else self.only(text))
        out, begin, joined, words = [], 0, self.joined, self.words
        ends = [i for i, pair in enumerate(zip(text, text[1:], strict=False), 1) if pair not in joined]
        for end in (*ends, len(text)):
            word, begin = text[begin:end], end
            if (ids := words.get(word)) is None:
                if len(words) >= self.KEPT:
                    words.clear()
                ids = words[word] = self.put_out(self.only(word))
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of text as little-endian uint32. An empty text, also one that is empty when normalised, has none."""
        text = self.normaliser(text)
        if not self.cut or not self.byte_pieces:
            return self.chunk(text) if text else b""
        chunks = self.cut.findall(text)
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            if len(self.chunks) > self.KEPT:
                self.chunks.clear()
            for i, c in enumerate(chunks):
                if ids[i] is None:
                    if (found := self.chunks.get(c)) is None:
                        found = self.chunks[c] = self.chunk(c)
                    ids[i] = found
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian uint32), U+2581 as a blank; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace").replace(BLANK, " ")
        return text[1:] if self.normaliser.front and text[:1] == " " else text


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs without the text, with ids (binary, little-endian uint32; null for a null text, empty for an empty one).

    Repeated rows get equal ids. Other columns are carried along and never read; a column ids of docs is replaced. An empty table gives no rows.
    """
    return _mapped(docs, model_path, text_col, "ids", T.BinaryType(), lambda t, x: t.encode(x), "string")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """rows without the ids, with text (null for null ids); a column text of rows is replaced. The rest is as in encode()."""
    return _mapped(rows, model_path, ids_col, "text", T.StringType(), lambda t, x: t.decode(x), "binary")


def _mapped(rows: DataFrame, path: str, source: str, target: str, kind: T.DataType, function, cast: str) -> DataFrame:
    kept = [c for c in rows.columns if c not in (source, target)]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, arrow = compiled(path), pa.binary() if isinstance(kind, T.BinaryType) else pa.string()
        for batch in batches:
            for part in parts(batch):
                found = [None if x is None else function(transducer, x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, arrow)], [*kept, target])

    return rows.select(*kept, F.col(source).cast(cast).alias("\x00source")).mapInArrow(run, schema)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as a number and a checksum, and whether they decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("before"))
    ids = encode(docs, path).select("doc_id", "before", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"))
    back = decode(ids, path)
    return back.select("doc_id", "n_ids", "ids_crc32", (F.sha2("text", 256) == F.col("before")).alias("round_trip"))
