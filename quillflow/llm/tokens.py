"""Operator 2: token counts by a compiled finite-state tokenizer.

The tokenizer file (BPE with word ends, lower case) becomes two deterministic transducers. The first, over code
point classes, marks where pre-tokens start (`scan.run_transducer`: chunk state maps, parallel prefix scan). The
second, over bytes, annotates every transition with the change in the number of emitted tokens: reading one more
byte of a word changes the count of the word's encoding, and the last byte of a word leads back to the start.

Why that is finite-state: the encoding of a word's prefix is the encoding of a shorter prefix plus one token, and the
pair of last tokens decides whether the split is the one that the merges give. So a state need only hold, for each
suffix of the prefix that some token starts with, the last token before that suffix and the count there. States are
compiled when first met and kept within a bound. Chunks of a batch run side by side. Those that begin at word starts have
constant state maps, as the start of every word is a known state. Chunks within a long word have maps over the few states
that reach them: guessed from the bytes before, closed under what the chunk before may end in, composed by prefix scan.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers

from . import scan
from .batches import small_batches

STATES = 150_000  # compiled states kept between batches; a batch that meets more adds them and the next starts anew
LANE_BYTES = 512
WARM_BYTES = 64  # read before a chunk within a word to guess the state there
PIECE = 1 << 20  # characters; longer texts are counted in pieces that end at white space
_models: dict[str, "Transducer"] = {}
_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
_library_classes: bytes | None = None


def library_classes() -> bytes:
    """Classes of all code points (packed) as the library's regular expressions see them; its Unicode version is its own."""
    global _library_classes
    if _library_classes is None:
        every, table = scan.every_code_point(), np.full(0x110000, scan.OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", scan.LETTER), (r"\p{N}", scan.NUMBER), (r"\s", scan.WHITE)):
            table[scan.code_points(normalizers.Replace(Regex(f"[^{pattern}]+"), "").normalize_str(every))] = kind
        table[0xD800:0xE000] = scan.SEP
        _library_classes = zlib.compress(table.tobytes())
    return _library_classes


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Counts tokens of byte words; symbol 256 + b is byte b as the last of its word."""

    def __init__(self, spec: dict, classes: bytes | None = None):
        self.classes = np.frombuffer(zlib.decompress(classes or library_classes()), np.uint8)
        model = spec["model"]
        end, of = model["end_of_word_suffix"], byte_symbols()
        self.specials = [t["content"] for t in spec["added_tokens"]]

        def seq(token: str) -> tuple[int, ...]:
            word = token.endswith(end) and token != end
            body = [of[c] for c in (token[: -len(end)] if word else token)]
            return (*body[:-1], body[-1] + 256) if word else tuple(body)

        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        self.seq = {i: seq(t) for t, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pair = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.base = {s[0]: i for i, s in self.seq.items() if len(s) == 1}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, s in self.seq.items():
            at = 0
            for c in s:
                nxt = self.trie[at].get(c)
                if nxt is None:
                    nxt = self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                at = nxt
            self.token_at[at] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self):
        self.states, self.keys = {((0, -1, 0),): 0}, [((0, -1, 0),)]
        self.column, self.columns = np.full(512, -1, np.int64), 0
        self.nxt = np.full((1024, 64), -1, np.int32)
        self.gain = np.zeros((1024, 64), np.int16)

    def bpe(self, ids: list[int]) -> list[int]:
        while len(ids) > 1:
            found = [(x[0], k, x[1]) for k in range(len(ids) - 1) if (x := self.pair.get((ids[k], ids[k + 1])))]
            if not found:
                break
            _, k, to = min(found)
            ids = [*ids[:k], to, *ids[k + 2 :]]
        return ids

    def _fits(self, before: int, token: int) -> bool:
        """Whether the merges leave `token` after the token `before` (-1: at the start of a word) as it is."""
        if (known := self.fits.get((before, token))) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            ids = [self.base[c] for t in (before, token) if t >= 0 for c in self.seq[t]]
            known = self.fits[before, token] = self.bpe(ids) == [t for t in (before, token) if t >= 0]
        return known

    def step(self, key: tuple, symbol: int) -> tuple[tuple, int]:
        """Next state and change of the token count. A state: (trie node of a suffix, last token before it, count)."""
        last, gain, grown = -1, 0, []
        for node, before, count in key:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if last < 0 and token >= 0 and self._fits(before, token):
                last, gain = token, count + 1
            if self.trie[child]:
                grown.append((child, before, count))
        if last < 0:
            raise ValueError(f"no token ends with symbol {symbol}")
        if symbol >= 256:
            return ((0, -1, 0),), gain
        return tuple([(n, b, c - gain) for n, b, c in grown] + [(0, last, 0)]), gain

    def _compile(self, state: int, symbol: int) -> None:
        to, gain = self.step(self.keys[state], symbol)
        if (k := self.states.get(to)) is None:
            k = self.states[to] = len(self.keys)
            self.keys.append(to)
            if k >= len(self.nxt):
                self.nxt = np.vstack([self.nxt, np.full_like(self.nxt, -1)])
                self.gain = np.vstack([self.gain, np.zeros_like(self.gain)])
        col = self.column[symbol]
        self.nxt[state, col], self.gain[state, col] = k, gain

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(symbols, minlength=512) * (self.column < 0))
        if len(new):
            self.column[new] = np.arange(self.columns, self.columns + len(new))
            self.columns += len(new)
            if self.columns > self.nxt.shape[1]:
                more = (512 if self.columns > 128 else 128) - self.nxt.shape[1]
                self.nxt = np.hstack([self.nxt, np.full((len(self.nxt), more), -1, np.int32)])
                self.gain = np.hstack([self.gain, np.zeros((len(self.gain), more), np.int16)])
        return self.column[symbols]

    def _run(self, symbols: np.ndarray, cols: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Runs chunks side by side from the given states; returns their last states and fills `out` with the gains."""
        order = np.argsort(-length, kind="stable")
        at, length, state = at[order], length[order], state[order].copy()
        ends = np.searchsorted(-length, -np.arange(length[0] + 1 if len(length) else 0), side="left")  # chunks longer than t
        for t in range(length[0] if len(length) else 0):
            live = ends[t]
            s, k = state[:live], at[:live] + t
            c = cols[k]
            to = self.nxt[s, c]
            if (lacking := np.flatnonzero(to < 0)).size:
                for a, b in {(int(s[i]), int(symbols[k[i]])) for i in lacking}:
                    self._compile(a, b)
                to = self.nxt[s, c]
            if out is not None:
                out[k] = self.gain[s, c]
            state[:live] = to
        last = np.empty_like(state)
        last[order] = state
        return last

    def gains(self, symbols: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
        """Change of the token count at each symbol. word_starts: sorted positions of first symbols, 0 among them."""
        n = len(symbols)
        out = np.zeros(n, np.int16)
        if not n:
            return out
        if len(self.keys) > STATES:
            self.reset()
        cols = self._columns(symbols)
        cuts = np.searchsorted(word_starts, np.arange(0, n, LANE_BYTES))
        at = np.unique(word_starts[np.append(0, cuts[cuts < len(word_starts)])])
        length = np.diff(np.append(at, n))
        inner = []
        for k in np.flatnonzero(length > 3 * LANE_BYTES):  # the last word of such a chunk is long
            word, end = int(word_starts[np.searchsorted(word_starts, at[k] + length[k]) - 1]), int(at[k] + length[k])
            inner.append(np.arange(word, end, LANE_BYTES))
            length[k] = word - at[k]
        self._run(symbols, cols, at, length, np.zeros(len(at), np.int64), out)
        if inner:
            at = np.concatenate(inner)
            first = np.isin(at, [x[0] for x in inner])
            length = np.minimum(LANE_BYTES, np.append(at[1:], n) - at)
            for x in inner:  # the last chunk of a word ends with it
                k = np.searchsorted(at, x[-1])
                end = np.searchsorted(word_starts, x[-1], side="right")
                length[k] = (word_starts[end] if end < len(word_starts) else n) - x[-1]
            self._run(symbols, cols, at, length, self._starts(symbols, cols, at, length, first), out)
        return out

    def _starts(self, symbols, cols, at, length, first) -> np.ndarray:
        """State at the start of each chunk of long words; `first` marks those that begin a word (state 0)."""
        n = len(at)
        warm = np.where(first, 0, np.minimum(WARM_BYTES, LANE_BYTES))
        guess = self._run(symbols, cols, at - warm, warm, np.zeros(n, np.int64), None)
        domain = [{int(g): 0} for g in guess]  # state -> its number among those that may reach the chunk
        ends: list[dict[int, int]] = [{} for _ in range(n)]
        todo = [(k, int(g)) for k, g in enumerate(guess)]
        while todo:
            k, s = (np.array(x, np.int64) for x in zip(*todo))
            todo = []
            for i, a, e in zip(k.tolist(), s.tolist(), self._run(symbols, cols, at[k], length[k], s, None).tolist()):
                ends[i][a] = e
                if i + 1 < n and not first[i + 1] and e not in domain[i + 1]:
                    domain[i + 1][e] = len(domain[i + 1])
                    todo.append((i + 1, e))
        maps = np.zeros((n, max(map(len, domain))), np.int64)
        for i in range(n - 1):
            for s, k in domain[i].items():
                maps[i, k] = 0 if first[i + 1] else domain[i + 1][ends[i][s]]
        before = np.append(0, scan.compose_prefix(maps)[:-1, 0])  # the first chunk begins a word: its state is number 0
        return np.array([list(d)[k] for d, k in zip(domain, before.tolist())], np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as the library counts them without added tokens."""
        plain, owner, total = [], [], np.zeros(len(texts), np.int64)
        for k, x in enumerate(texts):
            for special in self.specials:
                if special in x:
                    total[k] += x.count(special)
                    x = x.replace(special, " ")
            for piece in pieces(x):
                plain.append(normalised(piece)), owner.append(k)
        for a, b in scan.slabs(plain, PIECE):
            np.add.at(total, owner[a:b], self._count_slab(plain[a:b]))
        return total

    def _count_slab(self, texts: list[str]) -> np.ndarray:
        joined = scan.MARK.join(texts) + scan.MARK
        cps = scan.code_points(joined)
        kind = scan.symbols_of(cps, self.classes)
        starts = scan.run_transducer(kind, *scan.pattern_tables(False, False)).view(bool)
        keep = (kind != scan.SEP) & (kind < scan.SPACE_LAST)
        width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        text_of = np.cumsum(~keep & (kind == scan.SEP))  # texts ended so far
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        symbols = data[np.repeat(keep, width)].astype(np.int64)
        width, starts, text_of = width[keep], starts[keep], text_of[keep]
        ends = np.cumsum(width, dtype=np.int64)
        if not len(ends):
            return np.zeros(len(texts), np.int64)
        final = np.append(starts[1:], True)
        symbols[ends[final] - 1] += 256
        gains = self.gains(symbols, (ends - width)[starts])
        total = np.concatenate([[0], np.cumsum(gains, dtype=np.int64)])
        before = np.concatenate([[0], ends])[np.searchsorted(text_of, np.arange(len(texts) + 1))]
        return np.diff(total[before])


def pieces(text: str):
    """A text in pieces of about PIECE characters; white space, where they end, belongs to no token."""
    at = 0
    while len(text) - at > PIECE and (m := _WHITE.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_WHITE = re.compile(r"[ \t-\r]")


def normalised(text: str) -> str:
    """The library's normal form (NFC, then lower case letter by letter)."""
    return text.lower() if text.isascii() else _normal.normalize_str(text)


def transducer_of(spec: bytes, classes: bytes) -> Transducer:
    key = hashlib.md5(spec).hexdigest()
    if key not in _models:
        _models[key] = Transducer(json.loads(spec), classes)
    return _models[key]


def count_tokens(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows and null ids stay; other columns are not read. One
    narrow pass without a shuffle.
    """
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    classes = library_classes()
    df = small_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def go(batches):
        model = transducer_of(spec, classes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = model.count(texts)
            size = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.mapInArrow(go, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
