"""BPE as a bounded-lookahead streaming transducer, and decoding as a state machine.

Merges happen in rank order, so whether two neighbours end in one token depends on the text
to the right only through chains of earlier merges. The longest such chain of a merge list is
its sufficient lookahead: a token that ends at least so far before the end of what has been
read is final. The bytes at hand mostly settle a boundary much sooner: no merge of the list joins
the token to anything that begins with the symbol after it. The transducer emits whatever is
settled and keeps a window of a few lookaheads at most, whatever a word's length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from furrow.llm.common import short_batches, whole_text

PIECE_CHARS = 1 << 16
READ = 16  # bytes read before tokens are looked for that are final
SETTLE = 512  # bytes up to which they are looked for symbol by symbol; a longer window waits for the list's own lookahead
CACHE = 400_000
MARKS = ",.;:!?*%$&#|-"
SHIFT = 20
ID = (1 << SHIFT) - 1
NEVER = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


ALPHABET = byte_alphabet()
BYTE = {c: b for b, c in enumerate(ALPHABET)}
UTF8 = codecs.getincrementaldecoder("utf-8")


class Bpe:
    """A word-level BPE vocabulary with an end-of-word mark, read from a tokenizer file.

    The file's normaliser (NFC, white space to one space, lower case), its splitting pattern
    and its whole-text special tokens are honoured.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V1)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        chars = ALPHABET
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.end] for c in chars]
        #: pair of neighbours -> rank and merged id in one number, so the least is the next merge
        self.merges: dict[int, int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[left << SHIFT | right] = rank << SHIFT | whole
            self.parts.append((left, right, whole))
        self.id_text = {i: b"%d" % i for i in self.token}
        self.lookahead = self._sufficient_lookahead()
        self.reach, self.reach_to = self._reach()

    def _length(self, i: int) -> int:
        t = self.token[i]
        return len(t.removesuffix(self.end)) if self.end and t.endswith(self.end) else len(t)

    def _sufficient_lookahead(self) -> int:
        """Bytes to the right of a boundary after which nothing can change it.

        A merge (u, v) needs v to stay as it is, so it waits for every earlier merge whose left
        side may be the tail of v in some step of v's own making, and those wait in turn.
        """
        tail = {whole: right for _, right, whole in self.parts}
        waits: dict[int, int] = {}
        most = 1
        for left, right, _ in self.parts:
            longest, x = 0, right
            while x is not None:
                longest = max(longest, waits.get(x, 0))
                x = tail.get(x)
            d = self._length(right) + longest
            waits[left] = max(waits.get(left, 0), d)
            most = max(most, d)
        return most

    def _reach(self) -> tuple[dict[int, int], dict[int, int]]:
        """The first merge in which a symbol is the left side: with anything, and with a right side that begins with a given symbol."""
        head = {whole: left for left, _, whole in self.parts}
        anything: dict[int, int] = {}
        given: dict[int, int] = {}
        for left, right, whole in self.parts:
            m, x = self.merges[left << SHIFT | right], right
            anything.setdefault(left, m)
            while x is not None:
                given.setdefault(left << SHIFT | x, m)
                x = head.get(x)
        return anything, given

    def settled(self, ids: list[int]) -> list[int]:
        """The first tokens of a symbol list, as far as they are the same whatever follows the list.

        Merges run in rank order over the certain symbols. Before each, the last certain symbol
        becomes uncertain if an earlier merge could join it to what follows; a boundary that no
        merge of the list can close is final.
        """
        get, ids = self.merges.get, list(ids)
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        after = None
        while ids:
            m = min(ranks, default=NEVER)
            first = self.reach.get(ids[-1]) if after is None else self.reach_to.get(ids[-1] << SHIFT | after)
            if first is not None and first <= m:
                after = ids.pop()
                del ranks[-1:]
                continue
            if m == NEVER:
                break
            i = ranks.index(m)
            whole = ids[i] = m & ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | whole, NEVER)
            if i < len(ranks):
                ranks[i] = get(whole << SHIFT | ids[i + 1], NEVER)
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a symbol list: lowest rank first, leftmost of equals first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (m := min(ranks)) != NEVER:
            i = ranks.index(m)
            whole = ids[i] = m & ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | whole, NEVER)
            if i < len(ranks):
                ranks[i] = get(whole << SHIFT | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidate pairs over a linked list: n log n."""
        get, ids, n = self.merges.get, list(ids), len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << SHIFT | ids[j]) != m:
                continue
            whole = ids[i] = m & ID
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (x := get(whole << SHIFT | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := get(ids[h] << SHIFT | whole)) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word given as byte chunks, emitted once they are final; memory does not grow with the word."""
        window: list[int] = []  # bytes not yet emitted
        most = max(4 * self.lookahead, 256)
        due = READ
        for chunk in chunks:
            for at in range(0, len(chunk), READ):
                window.extend(chunk[at : at + READ])
                if len(window) <= due:
                    continue
                if len(window) <= SETTLE:
                    done = 0
                    for t in self.settled([self.inner[b] for b in window[:-1]]):  # the last byte read may be the word's last
                        yield t
                        done += self._length(t)
                    del window[:done]
                if len(window) > 2 * most:
                    done = 0
                    for t in self.merge([self.inner[b] for b in window]):
                        end = done + self._length(t)
                        if end + self.lookahead >= len(window):
                            break
                        yield t
                        done = end
                    del window[:done]
                due = min(len(window) + max(len(window), READ), 2 * most) if window else READ
        if window:
            yield from self.merge([*(self.inner[b] for b in window[:-1]), self.last[window[-1]]])

    def word(self, word: str) -> Iterator[int]:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= READ:  # the word ends with the first read: its only step is the last
            return iter(self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]))
        return self.transduce((raw,))

    def words(self, piece: str) -> Iterator[str]:
        """The words of a normalised piece of text, lazily."""
        return iter((piece,)) if piece.isalpha() else (m.group() for m in self.pattern.finditer(piece))

    def stretches(self, text: str) -> Iterator[list[str] | int]:
        """White-space-free pieces of the normalised text, a stretch at a time; special tokens as their ids."""
        if self.at_special is None:
            yield from normalised(text)
            return
        for i, part in enumerate(self.at_special.split(text)):
            if i % 2:
                yield self.special[part]
            elif part:
                yield from normalised(part)

    def encode(self, text: str) -> Iterator[int]:
        for s in self.stretches(text):
            if isinstance(s, int):
                yield s
            else:
                for p in s:
                    for w in self.words(p):
                        yield from self.word(w)


def lowered(s: str) -> str:
    """Lower case letter by letter: no form depends on its neighbours."""
    return (s.replace("Σ", "σ") if "Σ" in s else s).lower()


_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_WHITE = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")


def normalised(text: str) -> Iterator[list[str]]:
    """NFC and lower case, cut at white space, a stretch of the text at a time.

    Nothing composes across white space, so stretches end there; a run without white space is
    taken whole.
    """
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + PIECE_CHARS)
        while end < n and not text[end].isspace():
            end += 1
        part = text[at:end]
        at = end
        if not part.isascii() and not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        part = lowered(part)
        # str.split() also cuts at the four separators, which are no white space here
        yield _WHITE.findall(part) if _SEPARATORS.search(part) else part.split()


class Decoder:
    """Incremental decoding: feed ids, get text as soon as it is whole.

    ``joined`` gives what a file without a decoder does: tokens joined by one space. Otherwise
    bytes gather until they form whole UTF-8 characters, and an end-of-word mark is a space.
    """

    def __init__(self, bpe: Bpe, joined: bool = True):
        self.bpe, self.joined, self.first = bpe, joined, True
        self.state = None if joined else UTF8("replace")

    def feed(self, i: int) -> str:
        t = self.bpe.token[i]
        if self.joined:
            out = t if self.first else " " + t
            self.first = False
            return out
        if i in self.bpe.special.values():
            return self.state.decode(b"", True) + t
        end = self.bpe.end and t.endswith(self.bpe.end)
        out = self.state.decode(bytes(BYTE[c] for c in (t.removesuffix(self.bpe.end) if end else t)))
        return out + " " if end else out

    def finish(self) -> str:
        return "" if self.joined else self.state.decode(b"", True)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


Piece = tuple[int, bytes, bytes]


class Digester:
    """text -> (number of ids, SHA-256 of the ids, SHA-256 of the decoded text), both as streams.

    Every word's ids come from the transducer and its text from the decoder, fed id by id. What
    they gave for short words is kept in a bounded cache; longer words always run through them, a
    thousand ids at a time. The joined decoding puts one space between pieces as between ids.
    """

    def __init__(self, bpe: Bpe):
        self.bpe, self.seen = bpe, {}

    def of(self, ids: list[int]) -> Piece:
        decoder = Decoder(self.bpe)
        back = "".join([decoder.feed(i) for i in ids]) + decoder.finish()
        return len(ids), b" ".join([self.bpe.id_text[i] for i in ids]), back.encode()

    def miss(self, p: str) -> Piece:
        if len(self.seen) >= CACHE:
            self.seen.clear()
        stem = p.rstrip(MARKS)
        if p.isalpha():
            got = self.of(list(self.bpe.word(p)))
        elif stem.isalpha() and stem != p:  # a word and one run of marks: the pattern cuts between them
            a, b = (self.seen.get(x) or self.miss(x) for x in (stem, p[len(stem) :]))
            got = a[0] + b[0], a[1] + b" " + b[1], a[2] + b" " + b[2]
        else:
            got = self.of([i for w in self.bpe.words(p) for i in self.bpe.word(w)])
        self.seen[p] = got
        return got

    def long(self, p: str) -> Iterator[Piece]:
        for w in self.bpe.words(p):
            ids = iter(self.bpe.word(w))
            while some := list(islice(ids, 1024)):
                yield self.of(some)

    def parts(self, stretch: list[str] | int) -> Iterator[list[Piece]]:
        if isinstance(stretch, int):
            yield [self.of([stretch])]
            return
        known = list(map(self.seen.get, stretch))
        begin = 0
        if None in known:
            for i, p in enumerate(stretch):
                if known[i] is None:
                    if len(p) <= 64:
                        known[i] = self.seen.get(p) or self.miss(p)
                    else:
                        yield known[begin:i]
                        for piece in self.long(p):
                            yield [piece]
                        begin = i + 1
        yield known[begin:] if begin else known

    def __call__(self, text: str) -> tuple[int, str, str]:
        n, ids, back, between = 0, hashlib.sha256(), hashlib.sha256(), b""
        for stretch in self.bpe.stretches(text):
            for parts in self.parts(stretch):
                if parts:
                    counts, own, decoded = zip(*parts)
                    n += sum(counts)
                    ids.update(between + b" ".join(own))
                    back.update(between + b" ".join(decoded))
                    between = b" "
        return n, ids.hexdigest(), back.hexdigest()


_DIGESTERS: dict[str, Digester] = {}


def digester(path: str) -> Digester:
    """The worker's own digester: its cache serves all tasks that the worker runs."""
    if path not in _DIGESTERS:
        _DIGESTERS[path] = Digester(load(path))
    return _DIGESTERS[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    NULL is the empty text: no tokens, the digests of empty strings. Repeated rows give equal
    results; other columns are ignored. The vocabulary file's path is the same on all workers.
    """
    short_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = digester(path)
        for b in batches:
            got = [digest(t) for t in b.column(1).to_pylist()]
            n, ids, back = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids themselves."""
    short_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [list(bpe.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, joined: bool = False) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            out = []
            for ids in b.column(1).to_pylist():
                d = Decoder(bpe, joined)
                out.append("".join(map(d.feed, ids or [])) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
