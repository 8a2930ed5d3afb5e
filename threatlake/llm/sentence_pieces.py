"""Encoding with a SentencePiece vocabulary of the merge type, and decoding.

The text is normalised by the library and cut into symbols of one character.  An agenda holds all
pairs of adjacent symbols that together are a piece, best score first and leftmost among equals; the
first pair is merged, and its new neighbours' pairs enter the agenda, until it is empty.  Entries
whose symbols have been merged away meanwhile are passed over.  Characters outside the vocabulary
become their bytes' pieces, or the unknown piece where the vocabulary has none; of neighbouring
unknown ones the first stands for all, as in the library.

No merge crosses two characters that no piece has side by side.  So a text is cut between them, and
the segments are encoded by themselves and remembered, and so are words between marks.  The segments that are new in a slice of an
Arrow batch are encoded together and checked against the library in one call; a difference ends the
job.  Vocabularies without byte pieces, or without a mark before the text, are encoded and checked
text by text.  Pieces that the vocabulary lists as unused are split again.

``ids`` ends with the end id, for every text, and null texts are empty ones.  ``decoded`` is what the
library decodes from ``ids``.  A text is encoded whole, in memory in proportion to it.  Repeated rows
get equal results; an empty table gives no rows.  Columns named ids or decoded are replaced, all
others stay.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from threatlake.llm.common import kept

MARK = "▁"
MEMO_SEGMENTS = 600_000
_SHORT = 24
_LONG = 48
_NEVER = 1 << 30
_ROWS = 256


class Vocabulary:
    """Pieces with their ids and ranks, and the library's processor to normalise, check and decode."""

    def __init__(self, path: str, memo_segments: int = MEMO_SEGMENTS):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        every = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        named = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in named}
        scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        # Ranks order pieces as their scores do, equal ones alike.
        place = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: place[score] for piece, score in scores.items()}
        self.unused = {sp.id_to_piece(i) for i in named if sp.is_unused(i)}
        self.in_segments = bool(self.bytes) and sp.normalize("a") == MARK + "a"
        pairs = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        letters = sorted({c for pair in pairs for c in pair})
        # Class 0 is every character that no piece has beside another.
        self._class = np.zeros(0x110000, np.uint16)
        self._class[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self._beside = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in pairs:
            self._beside[self._class[ord(a)], self._class[ord(b)]] = True
        self._guard = next(c for c in map(chr, range(10, 0xD800)) if not self._class[ord(c)] and sp.normalize(c) == MARK + c)
        mark = self._class[ord(MARK)]
        self.mark_starts = bool(mark) and not np.delete(self._beside[:, mark], mark).any()
        self._memo = memo_segments
        self._words: dict[str, bytes] = {}
        self._seen: dict[str, bytes] = {}

    def segments(self, texts: list[str]) -> list[list[str]]:
        """Each text cut between characters that no piece has side by side."""
        whole = "".join(texts)
        kinds = self._class[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = ~self._beside[kinds[:-1], kinds[1:]]
        ends = np.cumsum([0, *map(len, texts)])
        cut[ends] = True
        places = np.flatnonzero(cut)
        where = np.searchsorted(places, ends).tolist()
        at = places.tolist()
        parts = [whole[a:b] for a, b in zip(at, at[1:], strict=False)]
        return [parts[a:b] for a, b in zip(where, where[1:], strict=False)]

    def merged(self, text: str) -> list[str]:
        """The symbols left when no two neighbours are a piece together."""
        out = self._merged_short(text) if len(text) <= _SHORT else self._merged_long(text)
        return [part for s in out for part in self._used(s)] if self.unused else out

    def _merged_short(self, text: str) -> list[str]:
        """The agenda of a few symbols is a list beside theirs; the first of its least is next."""
        rank_of, symbols = self.ranks.get, list(text)
        agenda = [rank_of(pair, _NEVER) for pair in map(add, symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            del agenda[i]
            symbols[i] = own = symbols[i] + symbols.pop(i + 1)
            if i < len(agenda):
                agenda[i] = rank_of(own + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = rank_of(symbols[i - 1] + own, _NEVER)
        return symbols

    def _merged_long(self, text: str) -> list[str]:
        """The agenda of many symbols is a heap; the cost is near linear in the text."""
        rank_of, n = self.ranks.get, len(text)
        # A symbol is known by its start: end[i] is where it ends, 0 once it is merged away.
        end, before = list(range(1, n + 1)), list(range(-1, n))
        agenda = []
        for i in range(n - 1):
            rank = rank_of(text[i : i + 2])
            if rank is not None:
                agenda.append((rank, i, i + 1, i + 2))
        heapify(agenda)
        while agenda:
            _, i, m, e = heappop(agenda)
            if end[i] != m or end[m] != e:
                continue
            end[i], end[m], before[e] = e, 0, i
            if e < n:
                rank = rank_of(text[i : end[e]])
                if rank is not None:
                    heappush(agenda, (rank, i, e, end[e]))
            if i:
                h = before[i]
                rank = rank_of(text[h:e])
                if rank is not None:
                    heappush(agenda, (rank, h, i, e))
        out, i = [], 0
        while i < n:
            out.append(text[i : end[i]])
            i = end[i]
        return out

    def _used(self, symbol: str) -> list[str]:
        """A symbol, or what stood before the merges that made it, where it is listed as unused."""
        if symbol not in self.unused or len(symbol) < 2:
            return [symbol]
        # The last merge made the symbol, so without it two symbols are left.
        rank = self.ranks.pop(symbol)
        halves = self.merged(symbol)
        self.ranks[symbol] = rank
        return halves

    def encoded(self, segment: str) -> list[int]:
        id_of, unknown, out = self.ids.get, self.library.unk_id(), []
        for symbol in self.merged(segment):
            found = id_of(symbol)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            elif not out or out[-1] != unknown:
                out.append(unknown)
        return out

    def _checked(self, asked: list[str], given: list[str], skip: int) -> list[list[int]]:
        """Ids of each text, which must be those that the library has after its first ``skip``."""
        found = [self.encoded(text) for text in asked]
        for text, ids, theirs in zip(asked, found, self.library.encode(given, num_threads=1), strict=True):
            if ids != theirs[skip:]:
                raise ValueError(f"not what the library gives for {text[:100]!r}")
        return found

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        marked = [s for s in new if s[0] == MARK and len(s) > 1]
        # The library puts a mark before every text.  A segment without one is asked for behind a
        # character that merges with nothing, and so is a mark alone.
        loose = [s for s in new if s[0] != MARK or len(s) == 1]
        behind = len(self.library.encode(self._guard, num_threads=1))
        ids = self._checked(marked, [s[1:] for s in marked], 0)
        ids += self._checked(loose, [self._guard + s for s in loose], behind)
        return {s: array("i", own).tobytes() for s, own in zip([*marked, *loose], ids, strict=True)}

    def _segmented(self, normal: list[str]) -> list[bytes]:
        """Packed ids of normalised texts, by their segments."""
        cut, seen = self.segments(normal), self._seen
        new = self._learn(list({s for text in cut for s in text if s not in seen}))
        if len(seen) + len(new) > self._memo:
            seen = self._seen = {s: seen[s] for text in cut for s in text if s in seen}
        out = [b"".join([seen[s] if s in seen else new[s] for s in text]) for text in cut]
        seen.update((s, ids) for s, ids in new.items() if len(s) <= _LONG)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        normal = self.library.normalize(texts)
        if not self.in_segments:
            return [np.array(ids, np.int32) for ids in self._checked(normal, texts, 0)]
        # Words behind single marks are remembered whole; most have been met before.
        plain = [self.mark_starts and text[:1] == MARK and MARK * 2 not in text for text in normal]
        words = [text[1:].split(MARK) for text, p in zip(normal, plain, strict=True) if p]
        known = self._words
        if len(known) > self._memo:
            known.clear()
        new = list(set().union(*words).difference(known))
        others = [text for text, p in zip(normal, plain, strict=True) if not p]
        packed = self._segmented([MARK + w for w in new] + others)
        known.update(zip(new, packed, strict=False))
        own, rest = iter(words), iter(packed[len(new) :])
        out = [b"".join(map(known.__getitem__, next(own))) if p else next(rest) for p in plain]
        for word in new:
            if len(word) > _LONG:
                del known[word]
        return [np.frombuffer(ids, np.int32) for ids in out]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; a worker process keeps it, so that segments are remembered over tasks."""
    return kept(("pieces", path), lambda: Vocabulary(path))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns with ``ids`` (the end id last) and ``decoded``."""
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = StructType([docs.schema[c] for c in kept])
    schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        end = np.array([vocab.library.eos_id()], np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = [t or "" for t in part.column(place).to_pylist()]
                ids = [np.concatenate([found, end]) for found in vocab.encode(texts)]
                decoded = vocab.decode([own.tolist() for own in ids])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.record_batch([*part.columns, lists, pa.array(decoded, pa.string())], schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, and the digests of ids and decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        id_col,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
