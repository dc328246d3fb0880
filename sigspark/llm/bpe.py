"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@lru_cache(maxsize=1)
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A tokenizers BPE model that merges as the ranks order it: every split of a token in two tokens is a merge."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    t = Tokenizer(models.BPE({n: ranks[k] for k, n in name.items()}, merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t


#: Marks that follow a word; a run of them at its end is one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text to encode at a time.
BLOCK = 1 << 22
#: White space in the wide sense: what any of the regular expression engines counts as such.
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


class PieceEncoder:
    """Encodes texts piece by piece; a piece is a match of ``pattern``, and each piece goes to the tokenizer once.

    A space with other signs on both sides always begins a piece, so texts are first cut there, which is cheaper than to
    match; only new words are matched. Words seen lately are kept: a store of up to
    ``keep`` and the one before it, so memory has a bound. Ids come as little-endian unsigned 32-bit integers.
    """

    def __init__(self, tokenizer, pattern: str, keep: int = 450_000) -> None:
        self.tokenizer, self.pattern, self.keep = tokenizer, regex.compile(pattern), keep
        #: Strings that the tokenizer takes out of a text before it splits words; such texts go to the library as they are.
        self.added = [] if tokenizer.encode_special_tokens else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        #: Words without the space before them, which they all have: the ids of space and word.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Pieces that are no words of letters alone.
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _lines(text: str) -> list[str] | None:
        """The lines of a text of which each space and line feed stands between other signs than white space; if only the
        spaces do, the text in a list; else None."""
        if text[0] == " " or text[-1] == " " or "  " in text:
            return None
        found = [c for c in SPACES if c in text]
        if any(c + " " in text or " " + c in text for c in found if c != " "):
            return None
        if set(found) <= {" ", "\n"}:
            lines = text.split("\n")
            if all(lines):
                return lines
        return [text]

    def _run(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are a space and letters: laid end to end they are the same pieces again."""
        out = []
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            chunks = ["".join(part[j : j + 500]) for j in range(0, len(part), 500)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)), "<u4")
            raw = "\n".join(part).encode()
            breaks = np.r_[np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), len(raw)]
            at = np.searchsorted(np.cumsum(self._widths()[ids]), breaks - np.arange(len(part)), "left") + 1
            whole, at = ids.tobytes(), (at * 4).tolist()
            out += [whole[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]
        return out

    def _widths(self) -> np.ndarray:
        """The bytes of each id."""
        if not hasattr(self, "_w"):
            vocab = self.tokenizer.get_vocab()
            self._w = np.zeros(max(vocab.values()) + 1, np.int64)
            for name, i in vocab.items():
                self._w[i] = len(name)
        return self._w

    def _learn_pieces(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        self.pieces.update(zip(plain, self._run(plain), strict=True))
        pieces = [p for p in pieces if not (p[0] == " " and p[1:].isalpha())]
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, words = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            ends = np.searchsorted(words, np.arange(len(part)), "right") * 4
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist(), strict=True):
                self.pieces[p] = raw[at:end]
                at = end

    def _learn(self, words: list[str]) -> None:
        known = self.words
        old = list(map(self.older.get, words))
        known.update(compress(zip(words, old, strict=True), old))
        new = list(compress(words, map(not_, old)))
        letters = list(map(str.isalpha, new))
        plain = list(compress(new, letters))
        rest = list(compress(new, map(not_, letters)))
        stems = [w.rstrip(MARKS) for w in rest]
        whole = [w for w, s in zip(rest, stems, strict=True) if not s.isalpha()]
        marked = [(w, s, w[len(s) :]) for w, s in zip(rest, stems, strict=True) if s.isalpha()]  # marks are a piece of their own
        todo = list({*plain, *(s for _, s, _ in marked if s not in known)})
        known.update(zip(todo, self._run([" " + w for w in todo]), strict=True))
        tails = list({t for _, _, t in marked})
        tail = dict(zip(tails, self._match(tails), strict=True))
        known.update([(w, known[s] + tail[t]) for w, s, t in marked])
        known.update(zip(whole, self._match([" " + w for w in whole]), strict=True))

    def _match(self, texts: list[str]) -> list[bytes]:
        found = self.pattern.findall
        pieces = [found(t) for t in texts]
        missing = list(dict.fromkeys(x for p in pieces for x in p if x not in self.pieces))
        if missing:
            self._learn_pieces(missing)
        return [b"".join(map(self.pieces.__getitem__, p)) for p in pieces]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is an empty text. Call it with a few MB at a time."""
        if len(self.words) > self.keep:
            self.words, self.older = {}, self.words
        if len(self.pieces) > self.keep:
            self.pieces = {}
        out = [np.zeros(0, "<u4")] * len(texts)
        if self.added:
            for i, t in enumerate(texts):
                if t and any(a in t for a in self.added):
                    out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            texts = [None if len(o) else t for o, t in zip(out, texts, strict=True)]
        split = [self._lines(t) if t else [] for t in texts]
        cut = [i for i, x in enumerate(split) if x]
        whole = [i for i, x in enumerate(split) if x is None]
        for i, raw in zip(whole, self._match([texts[i] for i in whole]), strict=True):
            out[i] = np.frombuffer(raw, "<u4")
        if not cut:
            return out
        split = [split[i] for i in cut]
        lines = np.array([len(x) for x in split])
        last = np.cumsum(lines) - 1
        # words as numbers: Arrow splits the lines and tells equal words together
        parts = pc.split_pattern(pa.array(list(chain.from_iterable(split))), " ")
        ends = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        first = parts.values.take(pa.array(ends[:-1])).dictionary_encode()
        place[ends[:-1]] = len(names) + first.indices.to_numpy()  # the first word of a line has no space before it
        ids = self._look_up(names) + self._match(first.dictionary.to_pylist()) + self._match(["\n"])
        feeds = np.delete(np.arange(len(ends) - 1), last)
        place = np.insert(place, ends[feeds + 1], len(ids) - 1)
        ends = ends[last + 1] + np.cumsum(lines - 1)
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        at = np.cumsum(size, dtype=np.int32) - size
        n = size[place]
        total = np.cumsum(n, dtype=np.int32)
        where = np.repeat(at[place] - (total - n), n)
        where += np.arange(total[-1], dtype=np.int32)
        got = flat[where]
        bounds = [0, *total[ends - 1].tolist()]
        for i, a, b in zip(cut, bounds, bounds[1:], strict=False):
            out[i] = got[a:b]
        return out

    def _look_up(self, names: list[str]) -> list[bytes]:
        got = list(map(self.words.get, names))
        missing = list(compress(names, map(not_, got)))  # ids of a word are never empty
        if missing:
            self._learn(missing)
            at = self.words
            got = [g or at[w] for g, w in zip(got, names, strict=True)]
        return got

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The span of characters of each id; a character that several ids share is in the span of each."""
        out = []
        for m in self.pattern.finditer(text):
            e = self.tokenizer.encode([m[0]], is_pretokenized=True, add_special_tokens=False)
            out += [(m.start() + a, m.start() + b) for a, b in e.offsets]
        return out


def encoder_of_json(path: str, pattern: str) -> PieceEncoder:
    """As the library encodes by this file: a text that holds the string of an added token gives that token's id there."""
    return _encoder("json", path, pattern)


def encoder_of_ranks(path: str, pattern: str) -> PieceEncoder:
    return _encoder("ranks", path, pattern)


@lru_cache(maxsize=4)
def _encoder(kind: str, path: str, pattern: str) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if kind == "json":
        from tokenizers import Tokenizer

        return PieceEncoder(Tokenizer.from_file(path), pattern)
    # workers live on through later stages of a pipeline, and their stores with them
    return PieceEncoder(tokenizer_of_ranks(read_ranks(path)), pattern, keep=120_000)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of each id, by the byte table reversed."""
    ranks, back, chars = read_ranks(path), character_bytes(), byte_characters()
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = bytes(back[c] for c in "".join(chars[b] for b in token))
    return tuple(table)


def decode_bytes(ids: list[int], table: tuple[bytes, ...]) -> bytes:
    return b"".join([table[i] for i in ids])


def decode_pieces(ids: list[int], table: tuple[bytes, ...]) -> list[str]:
    """The text that each id adds; the bytes of a split character come with the id that completes it."""
    import codecs

    d = codecs.getincrementaldecoder("utf-8")("replace")
    out = [d.decode(table[i]) for i in ids]
    if out:
        out[-1] += d.decode(b"", True)
    return out


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None, offsets: bool = False, prove: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int) and, if asked for, ``offsets`` (array of start and end characters) to every row.

    ``prove`` decodes the ids where they are made and adds ``round_trip``: whether they give the text's bytes back.

    A null or empty text has no ids. Repeated rows are encoded each; no shuffle. Columns with these names give way.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields += [T.StructField("offsets", T.ArrayType(span))] * offsets + [T.StructField("round_trip", T.BooleanType())] * prove

    def kernel(texts: list[str | None]) -> list:
        enc = encoder_of_ranks(ranks, pattern)
        made = enc.encode(texts)
        out: list = [_lists(made)]
        if offsets:
            out.append([[{"start": a, "end": b} for a, b in enc.offsets(t or "")] for t in texts])
        if prove:
            table = token_bytes(ranks)
            out.append([decode_bytes(x.tolist(), table) == (t or "").encode() for x, t in zip(made, texts, strict=True)])
        return out

    return map_text(df, text, fields, kernel, keep, block=BLOCK)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, "<u4")]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode(df: DataFrame, ranks: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids in order. Null and empty arrays give no bytes; an unknown id fails.

    Bytes, since an id may end within a character; ``decode_pieces`` gives the text id by id.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != "decoded"]
    wide = df.select(ids, *(c for c in kept if c != ids))
    out = [c for c in kept]
    schema = T.StructType([*(wide.schema[c] for c in out), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = token_bytes(ranks)
        for batch in batches:
            made = [decode_bytes(x or [], table) for x in (batch.column(0)[i].as_py() for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in out), pa.array(made, pa.binary())], names=[*out, "decoded"])

    return wide.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes, decodes the ids and adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: what a check of whole corpora
    needs, without the ids leaving the worker. The id string is the decimal ids joined by a space."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def kernel(texts: list[str | None]) -> list[list]:
        enc, table = encoder_of_ranks(ranks, pattern), token_bytes(ranks)
        n, a, b = [], [], []
        for ids in map(np.ndarray.tolist, enc.encode(texts)):
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(decode_bytes(ids, table)).hexdigest())
        return [n, a, b]

    return map_text(df, text, fields, kernel, keep, block=BLOCK)


__all__ = ["decode", "decode_pieces", "encode", "encoder_of_json", "encoder_of_ranks", "round_trip"]
