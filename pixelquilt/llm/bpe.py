"""Byte-pair encoding as a streaming transducer with bounded lookahead, and a byte-to-text state machine for decoding.

Lookahead. Whether a merge (a, b) happens depends on text to its right only if b, or a piece at the right edge of b,
is taken first by an earlier rule (s, z); that in turn depends on z and on what lies right of z. Ranks fall strictly
along such a chain, so one pass over the rules in rank order gives, for every rule, how many symbols beyond its end
can matter; the maximum over all tokens is the lookahead of the merge list. A token that ends at least that many
symbols before the end of what has been read is stable: it is emitted, its symbols are dropped, and the rest is a
fresh start, because no merge crosses the boundary of a final token. The buffer holds the lookahead plus one block,
however long the word is.

Texts run through in blocks cut at white space, so memory does not grow with a text beyond the text itself.

Defined results: NULL and empty texts have no ids and decode to the empty text; strings of special tokens in a text
are these tokens, as the library reads them; symbols without a vocabulary entry are dropped.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame

from .text import documents, slices

BLOCK = 1 << 16         # characters of a text taken at once
STEP = 256              # symbols read beyond the lookahead before stable tokens are emitted
CACHED = 1 << 18        # most words whose ids are remembered
SPACE = "\t-\r \x85\xa0  -     　"
# the pre-tokenizer pattern of the vocabulary file; white space spelled out
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
BLANK = regex.compile(rf"[{SPACE}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and the sufficient lookahead of a BPE file with word-end suffixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.plain = [self.ids.get(s) for s in symbols]
        self.last = [self.ids.get(s + self.end) for s in symbols]
        width = {i: len(s) - len(self.end) * (bool(self.end) and s.endswith(self.end)) for s, i in self.ids.items()}
        self.lookahead = sufficient_lookahead(self.ranks, width)
        self._words: dict[str, array] = {}
        self._pieces: dict[int, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of a short run of symbols: lowest rank first, leftmost first."""
        if len(symbols) > 64:
            return self._merged_heap(symbols)
        get, none = self.ranks.get, (1 << 62, 0)
        found = [get(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            symbols[i] = best[1]
            del symbols[i + 1], found[i]
            if i:
                found[i - 1] = get((symbols[i - 1], best[1]), none)
            if i < len(found):
                found[i] = get((best[1], symbols[i + 1]), none)
        return symbols

    def _merged_heap(self, symbols: list[int]) -> list[int]:
        n, ranks = len(symbols), self.ranks
        sym, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f[0], i, symbols[i], symbols[i + 1], f[1]) for i in range(n - 1) if (f := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (f := ranks.get((sym[left], sym[right]))):
                    heapq.heappush(heap, (f[0], left, sym[left], sym[right], f[1]))
        return [s for s in sym if s is not None]

    def stream(self, raw: Iterable[int]) -> Iterator[int]:
        """Ids of one word from its bytes, each as soon as it is stable."""
        widths = self._width
        buffer: list[int] = []
        held = None
        for byte in raw:
            if held is not None and (s := self.plain[held]) is not None:
                buffer.append(s)
            held = byte
            if len(buffer) >= self.lookahead + STEP:
                done = 0
                for token in self.merged(buffer):
                    if done + widths(token) > len(buffer) - self.lookahead:
                        break
                    done += widths(token)
                    yield token
                del buffer[:done]
        if held is not None and (s := self.last[held]) is not None:
            buffer.append(s)
        yield from self.merged(buffer)

    def whole(self, raw: bytes) -> array:
        """Ids of one word that fits the buffer."""
        plain, last = self.plain, self.last[raw[-1]]
        symbols = [s for b in raw[:-1] if (s := plain[b]) is not None]
        return array("I", self.merged(symbols if last is None else [*symbols, last]))

    def _width(self, token: int) -> int:
        return len(self.names[token].removesuffix(self.end))

    def __getitem__(self, piece: str) -> array:
        """Ids of one piece; short ones are remembered."""
        ids = self._words.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = self.whole(raw) if len(raw) <= STEP else array("I", self.stream(raw))
            if len(piece) <= 64:
                if len(self._words) >= CACHED:
                    self._words.clear()
                self._words[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[array]:
        """Ids of a text in blocks."""
        for segment, special in self._segments(text):
            if special is not None:
                yield array("I", [special])
            for block in blocks(segment):
                yield array("I", chain.from_iterable(map(self.__getitem__, PIECES.findall(normal(block)))))

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        if not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        for m in regex.finditer("|".join(map(regex.escape, self.special)), text):
            yield text[at:m.start()], None
            yield "", self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def decode(self, ids: Iterable[int], first: bool = True) -> str:
        """The library's text of a run of ids: the vocabulary strings, separated by single spaces; first: whether
        nothing was decoded before this run."""
        names = [n for n in map(self.names.get, ids) if n is not None]
        return (" " if names and not first else "") + " ".join(names)

    def text(self, runs: Iterable[Iterable[int]]) -> Iterator[str]:
        """Readable text of runs of ids: the bytes of the tokens through the state machine, a space at each word end."""
        if not self._pieces:
            back = {c: b for b, c in enumerate(byte_symbols())}
            self._pieces = {i: bytes(back[c] for c in s.removesuffix(self.end)) + b" " * (bool(self.end) and s.endswith(self.end))
                            for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        machine = ByteText()
        for run in runs:
            yield machine.feed(b"".join([self._pieces.get(i, b"") for i in run]))
        yield machine.finish()


def sufficient_lookahead(ranks: dict[tuple[int, int], tuple[int, int]], width: dict[int, int]) -> int:
    """Most symbols beyond the end of a token that can still change it (see the module text)."""
    beyond: dict[int, int] = {}              # token -> symbols beyond it that matter for its being made
    starting: dict[int, int] = {}            # left part -> most of width + beyond over its rules so far
    for (a, b), (_, made) in sorted(ranks.items(), key=lambda x: x[1][0]):
        reach = max(beyond.get(b, 0), starting.get(b, 0))
        beyond[made] = max(beyond.get(made, 0), reach)
        starting[a] = max(starting.get(a, 0), width[b] + reach)
    return max((max(beyond.get(t, 0), starting.get(t, 0)) for t in width), default=0)


class ByteText:
    """UTF-8 bytes to text, fed in any pieces: the state is the unfinished character. Bytes that cannot continue a
    character give U+FFFD, one for each longest valid beginning."""

    def __init__(self):
        self.pending = b""

    def feed(self, piece: bytes) -> str:
        data = self.pending + piece
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if back < need and self._open(data[-back:]) else 0
                break
            if byte < 0x80:
                break
        self.pending = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _open(tail: bytes) -> bool:
        """Whether the bytes begin a character that more bytes could finish."""
        try:
            tail.decode("utf-8")
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data"
        return False

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def normal(text: str) -> str:
    """NFC, then each character lower-cased by itself (no rule for a final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def blocks(text: str) -> Iterator[str]:
    """Stretches of about BLOCK characters that end before white space, so no piece is cut."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _summary(v: Vocabulary, text: str | None) -> tuple[int, str, str]:
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in v.encode(text or ""):
        text_hash.update(v.decode(ids, n == 0).encode())
        ids_hash.update(ids.tobytes())
        n += len(ids)
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; path: the vocabulary file, on every executor."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches):
            n, a, b = zip(*(_summary(v, t) for t in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return documents(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the readable decoded text of every document."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, rows=256, mb=2):
            runs = [list(v.encode(t or "")) for t in batch.column("text").to_pylist()]
            ids = [array("i", chain.from_iterable(r)).tolist() for r in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(["".join(v.text(r)) for r in runs], pa.string())],
                ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return documents(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
