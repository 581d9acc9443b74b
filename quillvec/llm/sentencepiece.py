"""SentencePiece encoding and decoding: Viterbi over a lattice of one path, along shared prefixes.

The vocabulary file is read directly (pieces, scores and kinds of a SentencePiece BPE model with byte fallback). A text is
marked ("▁" for each blank and one before the text) and cut where no piece of the vocabulary could cross; equal segments
are encoded once. The distinct segments are sorted, which makes them a trie, and the trie is traversed depth first: the
forward state of each prefix is kept on a stack and reused by all segments that share the prefix.

The model is a BPE one, for which the best sum of scores is not the library's answer. The lattice is therefore restricted
to steps that BPE allows: a piece may follow another only if merging their joined text gives just those two pieces. Each
prefix then has exactly one path, which is the BPE encoding of that prefix. With one path there is nothing to choose: a
prefix's forward state is its last piece alone, no scores are summed or compared along the path, and going back through the
last pieces gives the library's ids. (Scores of the vocabulary are used where it is decided which steps BPE allows.)
Characters outside the vocabulary become the pieces of their UTF-8 bytes.

Defined cases: a null text has null ids, and an empty one none; there is no normalisation and no added control piece. The
mark itself ("▁" in a text) is decoded as a blank, as the library does; all other texts come back unchanged. Repeated rows
are encoded alike. An empty table gives an empty result; ``encode`` carries the columns of its input whatever their names, and
where the input has a column of an added column's name, the added one gets underscores behind its name; texts of any length
are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillvec.llm.columns import free, place

MARK = "▁"
MODEL = os.path.join(os.environ.get("QUILLVEC_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
#: Words remembered by one Python worker; older ones are dropped, and encoded again where they come back.
REMEMBERED, BATCH_CHARS = 500_000, 2_000_000
RUNS = re.compile(rf"{MARK}+[^{MARK}]*")


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind == 5:
            value, i = data[i : i + 4], i + 4
        else:
            value, i = data[i : i + 8], i + 8
        yield key >> 3, value


class Vocabulary:
    """Pieces of a BPE model, how texts are cut, and the encoder's memory."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, path: str):
        pieces = []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    text, score, kind = "", 0.0, self.NORMAL
                    for k, v in _fields(value):
                        if k == 1:
                            text = v.decode()
                        elif k == 2:
                            score = float(np.frombuffer(v, "<f4")[0])
                        elif k == 3:
                            kind = v
                    pieces.append((text, score, kind))
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k == self.NORMAL}
        self.scores = {t: s for t, s, k in pieces if k == self.NORMAL}
        self.bytes = [0] * 256
        self.text = [t for t, _, _ in pieces]
        self.byte_of: dict[int, int] = {}
        for i, (t, _, k) in enumerate(pieces):
            if k == self.BYTE:
                self.bytes[int(t[3:5], 16)] = i
                self.byte_of[i] = int(t[3:5], 16)
        self.special = {i for i, (_, _, k) in enumerate(pieces) if k not in (self.NORMAL, self.BYTE)}
        blob = [bytes([self.byte_of[i]]) if i in self.byte_of else ("" if i in self.special else t.replace(MARK, " ")).encode() for i, t in enumerate(self.text)]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.blob_length = np.array([len(x) for x in blob], np.int64)
        self.blob_start = np.concatenate(([0], np.cumsum(self.blob_length)[:-1]))
        self.width = [len(t) for t in self.text]
        # pieces by their letters from the last to the first: {letter: [deeper, id or -1]}
        self.backward: dict = {}
        for t, i in self.ids.items():
            level = self.backward
            for c in reversed(t):
                node = level.setdefault(c, [{}, -1])
                level = node[0]
            node[1] = i
        self.allowed: dict[int, bool] = {}
        self.forget()
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Segments between which no piece lies: classes of characters that no piece joins are cut apart."""
        odd = "".join(sorted({c for t in self.ids for c in t if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letter, digit, rest = rf"[^\W\d_{odd}]", r"\d", rf"(?:(?!{MARK})[\W_{odd}])"
        of = lambda c: 0 if c == MARK else next(k for k, p in enumerate((letter, digit, rest), 1) if re.match(p, c))
        joins = {(of(a), of(b)) for t in self.ids for a, b in zip(t, t[1:])}
        if any((k, 0) in joins for k in (1, 2, 3)):
            return re.compile(r"(?s).+")
        if any(a != b for a, b in joins if a):
            return re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
        return re.compile(rf"{MARK}*{letter}+|{MARK}*{digit}{'+' if (2, 2) in joins else ''}|{MARK}*{rest}+|{MARK}+")

    def forget(self) -> None:
        """Empty the memory of encoded words: numbers of words, and the ids of each number."""
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def merged(self, text: str) -> list[str]:
        """BPE itself, by repeatedly merging the best pair (the leftmost of equals); for short strings."""
        parts, get, none = list(text), self.scores.get, -1e30
        gains = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            parts[i] += parts.pop(i + 1)
            del gains[i]
            if i:
                gains[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE allows piece b after piece a; with a = -1, whether it makes b at all."""
        if len(self.allowed) > 1_500_000:
            self.allowed.clear()
        left = [] if a < 0 else [self.text[a]]
        self.allowed[a << 20 | b] = ok = self.merged("".join(left) + self.text[b]) == [*left, self.text[b]]
        return ok

    def encode_sorted(self, segments: list[str]):
        """(segment, ids) of distinct segments in sorted order: a depth-first walk over their trie."""
        backward, allowed, follows, width = self.backward, self.allowed.get, self.follows, self.width
        # the stack: for each length of the current prefix, the last piece of its path; below -1, a character without a piece
        last = [-1]
        before = ""
        for w in segments:
            same = 0
            for a, b in zip(before, w):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(w) + 1):
                start, level = end, backward
                while start:
                    start -= 1
                    node = level.get(w[start])
                    if node is None:
                        start = 0
                        break
                    level, i = node
                    if i >= 0:
                        prior = last[start] if last[start] > -1 else -1
                        ok = allowed(prior << 20 | i)
                        if ok or ok is None and follows(prior, i):
                            last.append(i)
                            break
                if len(last) == end:
                    last.append(-2 - ord(w[end - 1]))
            ids, end = [], len(w)
            while end:
                i = last[end]
                if i >= 0:
                    ids.append(i)
                    end -= width[i]
                else:
                    ids += [self.bytes[b] for b in reversed(chr(-2 - i).encode("utf-8", "surrogatepass"))]
                    end -= 1
            ids.reverse()
            yield w, ids
            before = w

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def numbers(self, words: list[list[str]]) -> None:
        """Encode what is new among the words (each a piece of marked text without its first mark)."""
        number = self.number
        new = list({w for ws in words for w in ws if w not in number})
        parts = [self.cut.findall(MARK + w) for w in new]
        known = dict(self.encode_sorted(sorted({s for p in parts for s in p})))
        flat, ends = self.flat, self.ends
        for w, p in zip(new, parts):
            number[w] = len(ends) - 1
            for s in p:
                flat.extend(known[s])
            ends.append(len(flat))

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, borders between the texts); null counts as empty."""
        words = []
        for t in texts:
            if not t:
                words.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or MARK in t:
                # several marks in a row belong together: cut by the pattern, the first mark left out where there is one
                words.append(self._runs(t))
            else:
                words.append(t.split(" "))
        if len(self.number) > REMEMBERED:
            self.forget()
        self.numbers(words)
        counts = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        ends, flat = np.array(self.ends), np.array(self.flat)
        ids, sizes = gather(flat, ends[at], ends[at + 1] - ends[at])
        per_word = np.concatenate(([0], np.cumsum(sizes)))
        return ids, per_word[np.concatenate(([0], np.cumsum(counts)))]

    def _runs(self, text: str) -> list[str]:
        """Pieces of marked text that begin with a run of marks, each without its first mark."""
        return [x[1:] for x in RUNS.findall(MARK + text.replace(" ", MARK))]

    def decode_bytes(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of the decoded texts, each with the blank of its first mark, borders between the texts)."""
        data, sizes = gather(self.blob, self.blob_start[ids], self.blob_length[ids])
        return data, np.concatenate(([0], np.cumsum(sizes)))[borders]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; control pieces have none, broken UTF-8 becomes replacement characters."""
        if not self.byte_of.keys().isdisjoint(ids):
            out, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append("" if i in self.special else self.text[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join("" if i in self.special else self.text[i] for i in ids)
        text = text.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after another, and their sizes."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)], sizes


@cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


def _groups(texts: list[str | None]):
    """Ranges of texts of about BATCH_CHARS characters."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _encoded(path: str, names: list[str], at: int, check: bool):
    """Arrow function: the batch's columns, then ids (and, with check, whether decoding gives the text back)."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, j in _groups(texts):
                part = batch.slice(i, j - i)
                ids, borders = v.encode_texts(texts[i:j])
                null = pa.array([t is None for t in texts[i:j]], pa.bool_())
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)]
                if check:
                    data, cut = v.decode_bytes(ids, borders)
                    raw = data.tobytes()
                    same = [None if t is None else raw[a:b] == (b" " + t.replace(MARK, " ").encode() if t else b"") for t, a, b in zip(texts[i:j], cut.tolist(), cut[1:].tolist())]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, path: str = MODEL, column: str = "text", ids: str = "token_ids", check: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of a text column (and, in ``check``, whether decoding them restores the text)."""
    ids = free(ids, docs.columns)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if check:
        added.append(T.StructField(free(check, [*docs.columns, ids]), T.BooleanType()))
    schema = T.StructType([*docs.schema.fields, *added])
    # positional names inside the Arrow batch: names of the input may clash or repeat
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = inner.mapInArrow(_encoded(path, [f.name for f in plain.fields], place(docs.columns, column), bool(check)), plain)
    return out.toDF(*(f.name for f in schema.fields))


def decode(tokens: DataFrame, path: str = MODEL, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text that its ids stand for, under a free name; null ids give a null text."""

    @F.pandas_udf("string")
    def back(x):
        v = vocabulary(path)
        return x.map(lambda a: None if a is None else v.decode(list(a)))

    names = tokens.columns
    inner = tokens.toDF(*(f"c{i}" for i in range(len(names))))
    return inner.select("*", back(F.col(f"c{place(names, ids)}")).alias("decoded")).toDF(*names, free(text, names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, check="round_trip")
    return out.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "round_trip")
