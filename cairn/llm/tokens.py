"""Whole texts to token ids, in Arrow batches.

Both kinds of vocabulary end their tokens at blanks and where a letter meets a mark like a full stop. Texts
are cut there, and a piece that was encoded before is looked up. New pieces of letters only are encoded
many to a call, joined by what is a token of its own. Texts in which such places needn't be ends (other
white space before blanks, strings like special tokens), and texts for other vocabularies, are
encoded as they are. Null is an empty text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.texts import slices

#: Letters of which it is certain that they are letters, to every vocabulary.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII marks but for the apostrophe, and where a letter meets one.
MARKS = r"!-&(-/:-@\[-`{-~"
STOP = re.compile(rf"[{MARKS}](?<=[{LETTERS}].)")
#: Pieces of texts in which blanks come in a row.
BYTE_PIECE = re.compile(rf" ?[{LETTERS}]+(?![^ \n{MARKS}])|\n(?=[{LETTERS}])|[ \n]*[^ \n]+|[ \n]+")
MARK = "\x1f"
PURE = re.compile(rf" ?[{LETTERS}]+")
#: White space but for blanks and line ends.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1e\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPECIAL = "<|"
#: Pieces that a worker remembers (some 50 bytes each), the longest of them, and how many are joined.
REMEMBERED, LONGEST, JOINED = 1_000_000, 64, 200
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 4 << 20
#: How byte-level vocabularies write line end, blank and the letters.
BYTE_LETTERS = {10: "\u010a", 32: "\u0120"} | {
    c: "".join(chr(b) if 0xA1 <= b <= 0xAC or b >= 0xAE else chr(0x100 + 33 + b - 0x7F) if b < 0xA1 else chr(0x143) for b in chr(c).encode())
    for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))
}


def _is_latin(text: str) -> bool:
    """Whether lower case and normal form are letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Encodes texts to arrays of little-endian ids."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in name:
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known, self.flat, self.ends = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)
        with open(name) as f:
            settings = json.load(f)
        before = settings.get("pre_tokenizer") or {}
        self.kind = None
        if not (ending := settings["model"].get("end_of_word_suffix")) and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not settings.get("normalizer"):
            self.kind, self.between = "byte", BYTE_LETTERS[10]
        elif ending and before.get("type") == "Sequence":
            self.kind, self.between = "word", MARK
        if self.kind:
            # the same vocabulary, for pieces that are words already
            from tokenizers.pre_tokenizers import CharDelimiterSplit, Split

            self.words = Tokenizer.from_file(name)
            self.words.normalizer = None
            self.words.pre_tokenizer = Split(self.between, "isolated") if self.kind == "byte" else CharDelimiterSplit(MARK)
            model = self.words.model
            model._resize_cache(0)
            self.words.model = model
            self.stops = np.zeros(self.size, bool)
            self.stops[[i for w, i in self.tokenizer.get_vocab().items() if (w == self.between if self.kind == "byte" else w.endswith(ending))]] = True

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), self.dtype), np.array([len(ids) for ids in found], np.int64)

    def _encode_joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces of letters only, which need neither normal form nor a search for words."""
        joined = [self.between.join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        if self.kind == "word":
            joined = [x.lower() for x in joined]
        joined = [x.replace(" ", BYTE_LETTERS[32]) if x.isascii() else x.translate(BYTE_LETTERS) for x in joined]
        found = [np.array(x.ids, self.dtype) for x in self.words.encode_batch_fast(joined, add_special_tokens=False)]
        between = np.flatnonzero(self.stops)[:1].astype(self.dtype)
        ids = np.concatenate([x for own in found for x in (own, between[: self.kind == "byte"])] or [between[:0]])
        stop = np.flatnonzero(self.stops[ids]) + (self.kind == "word")
        if len(stop) != len(pieces):
            raise ValueError("a piece has no token at its end")
        if self.kind == "word":
            return ids, np.diff(stop, prepend=0)
        return np.delete(ids, stop), np.diff(stop, prepend=-1) - 1

    def _cut(self, text: str | None) -> str:
        """The text with a mark at every cut."""
        if not text:
            return ""
        if self.kind == "word" and SPECIAL not in text:
            low = text.lower() if _is_latin(text) else text
            return STOP.sub(rf"{MARK}\g<0>", low).replace("\n", MARK).replace(" ", MARK)
        if self.kind == "byte" and SPECIAL not in text and not OTHER_SPACE.search(text):
            if any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[-1] in " \n":
                return MARK.join(BYTE_PIECE.findall(text))
            return STOP.sub(rf"{MARK}\g<0>", text).replace("\n", f"{MARK}\n{MARK}").replace(" ", f"{MARK} ")
        return text

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, int]:
        """Where distinct pieces stand among those known, after new ones are encoded; how many of all are short."""
        found = pc.index_in(pieces, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at, base = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), len(self.known)
        if not len(new):
            return at, base
        texts = pieces.take(pa.array(new)).to_pylist()
        ways: list[list[int]] = [[], [], [], []]  # few pieces need their letters rewritten one by one; long ones come last
        for i, p in enumerate(texts):
            ways[3 if len(p) > LONGEST else 2 if not (self.kind and PURE.fullmatch(p)) else 0 if p.isascii() else 1].append(i)
        ids, sizes = zip(*(f([texts[i] for i in own]) for own, f in zip(ways, (self._encode_joined, self._encode_joined, self._encode, self._encode)) if own))
        order = new[np.concatenate([np.array(own, np.int64) for own in ways])]
        at[order] = base + np.arange(len(order))
        self.known = pa.concat_arrays([self.known, pieces.take(pa.array(order))])
        self.flat = np.concatenate([self.flat, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        return at, len(self.known) - len(ways[3])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces in a row, and where each piece's end."""
        size = self.ends[at + 1] - self.ends[at]
        # a call holds few MB of texts; one long text alone may need wide positions
        kind = np.int32 if max(len(self.flat), int(size.sum())) < 1 << 31 else np.int64
        own = size.astype(kind)
        ends = np.cumsum(own, dtype=kind)
        return self.flat[np.arange(ends[-1] if len(ends) else 0, dtype=kind) + np.repeat(self.ends[at].astype(kind) - ends + own, own)], ends

    def _forget(self, at: np.ndarray, short: int) -> None:
        """Drops long pieces and, when there are too many, those that this call didn't need."""
        keep = np.sort(at[at < short]) if short > REMEMBERED else np.arange(short)
        if len(keep) < len(self.known):
            whole = len(keep) == short
            flat, ends = (self.flat[: self.ends[short]].copy(), self.ends[1 : short + 1]) if whole else self._gather(keep)
            self.known = pa.concat_arrays([self.known.slice(0, short)]) if whole else self.known.take(pa.array(keep))
            self.flat, self.ends = flat, np.concatenate([np.zeros(1, np.int64), ends])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        marked = {i for i, t in enumerate(texts) if t and MARK in t}
        cut = pa.array(["" if i in marked else self._cut(t) for i, t in enumerate(texts)], pa.large_string())
        pieces = pc.split_pattern(cut, MARK)
        coded = pieces.values.dictionary_encode()
        at, short = self._look_up(coded.dictionary)
        ids, ends = self._gather(at[coded.indices.to_numpy()])
        bounds = np.concatenate([[0], ends])[pieces.offsets.to_numpy()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        self._forget(at, short)
        for i in marked:
            out[i] = self._encode([texts[i]])[0].tobytes()
        return out


@cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def tokenize(docs: DataFrame, name: str, end: int, id_col: str = "doc_id", text_col: str = "text", queue_col: str | None = None) -> DataFrame:
    """(doc_id, queue, part, row, n, run, ids) per row, ids ending in `end`, two or four bytes each.

    part and row say where the row stood in the scan; run is the number of ids before it in its
    queue within the part, so that running totals need only one more sum over the parts.
    """
    queue = F.coalesce(F.concat(F.lit("="), F.col(queue_col).cast("string")), F.lit("")) if queue_col else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, before = encoder(name), TaskContext.get().partitionId(), 0, {}
        tail = np.array([end], encode.dtype).tobytes()
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = [x + tail for x in encode(batch.column("text").to_pylist())]
            sizes = [len(x) // encode.dtype.itemsize for x in ids]
            runs = []
            for q, n in zip(batch.column("queue").to_pylist(), sizes):
                runs.append(before.get(q, 0))
                before[q] = runs[-1] + n
            rows = np.arange(row, row := row + len(ids), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), pa.array(np.full(len(ids), part, np.int32)), pa.array(rows), pa.array(sizes, pa.int64()), pa.array(runs, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "row", "n", "run", "ids"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, queue string, part int, row long, n long, run long, ids binary")


def id_type(name: str) -> np.dtype:
    """The type in which `tokenize` stores ids of this vocabulary."""
    return encoder(name).dtype
