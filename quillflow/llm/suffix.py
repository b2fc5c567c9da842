"""Operator 9: substring dedup by suffix arrays, built with two-stage sorting.

Which suffixes can share a long prefix is found first. Every string of `length` bytes has a least hash among its shorter
grams; equal strings have equal ones. Runs of strings with the same least hash are segments, and only segments that meet
another with the same hash (or hold it twice) can repeat anything. Equal segments are counted as one; the distinct ones
of a hash go to one task, where a suffix array over them finds what they share: suffixes smaller than their successors are
sorted directly, the rest follow by scanning the buckets from left to right, and the common prefixes of neighbours tell
which strings occur twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bundles as B

LENGTH = 200
GRAM = 100  # bytes of the grams whose least hash names a string of LENGTH bytes
FINE_GRAM = 180  # the same for segments of a hash with very many different segments, which are cut finer
HOT = 512  # different segments of one hash beyond which they are cut finer
HOTTEST = 40 * HOT  # and beyond which every string stands by itself
RUN = 2048  # strings of a segment at most (a periodic text has long runs of one hash)
SHARD_SEGMENTS = 1 << 19
PACK = 256 << 10  # bytes of one suffix array, but that segments of one hash stay together
END = 0xFF  # between segments; no byte of UTF-8
_BYTE = np.random.default_rng(43).integers(0, 1 << 63, 256, np.uint64)
_grams = B.Rolling(0x9E3779B97F4A7C15)  # a chance agreement of grams only brings more segments together


# --- suffix array ---------------------------------------------------------------------------------------------


def _words(data: bytes, more: int) -> np.ndarray:
    """Eight bytes from every position as one number that orders like them; `more` positions past the end hold 0."""
    n = len(data) + more
    padded = np.frombuffer(data + bytes(more + 8), np.uint8)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words <<= np.uint64(8)
        words |= padded[k : k + n]
    return words


def _sorted_directly(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes from there: eight bytes at a time, only ties go on."""
    order = starts[np.argsort(words[starts], kind="stable")]
    key = words[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(new)
    for at in range(8, depth, 8):
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        own, g = order[open_], group[open_]
        key = words[np.minimum(own + at, len(words) - 1)]
        by = np.lexsort((key, g))
        order[open_], key = own[by], key[by]
        split = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        new[open_] = split
        group[open_] = np.cumsum(split)
        # groups keep apart: an open one begins where its first row does, whatever its number
    return order


def suffix_array(data: bytes, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Positions of data in the order of their suffixes; beyond `depth` bytes the order of equal ones is arbitrary."""
    text, n = np.frombuffer(data, np.uint8), len(data)
    words = _words(data, depth) if words is None else words
    rise = np.empty(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rise[-1] = -1
    upto = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(upto[::-1])[::-1]] > 0  # suffixes smaller than their successors
    direct = _sorted_directly(words, np.flatnonzero(small), depth)
    of = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets[text[-1]].append(np.array([n - 1]))  # the empty suffix comes first and induces the last one
    out = []
    for c in range(256):
        large = buckets[c]
        k = 0
        while k < len(large):  # what a bucket induces in itself lines up behind
            before = large[k] - 1
            before = before[before >= 0]
            before = before[(text[before] == c) & ~small[before]]
            if len(before):
                large.append(before)
            k += 1
        whole = np.concatenate([*large, direct[of[c] : of[c + 1]]])
        out.append(whole)
        before = whole - 1
        before = before[before >= 0]
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cut):
                buckets[text[part[0]]].append(part)
    return np.concatenate(out)


def repeated_starts(data: bytes, length: int) -> np.ndarray:
    """For each position whether the `length` bytes from there, free of END, also start elsewhere in data."""
    n = len(data)
    words = _words(data, length)
    order = suffix_array(data, length, words)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == END), n)
    whole = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) >= length
    live = np.flatnonzero(whole[order[:-1]] & whole[order[1:]])
    for at in (*range(0, length - 7, 8), *([length - 8] if length % 8 else [])):  # common prefixes, eight bytes at a time
        a, b = order[live] + at, order[live + 1] + at
        live = live[words[a] == words[b]]
    twice = np.zeros(n, bool)
    twice[order[live]] = True
    twice[order[live + 1]] = True
    return twice


# --- segments -------------------------------------------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if width > have else out


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int, run: int):
    """Runs of strings of `length` bytes within texts that end at `ends`: (hash, first string, strings, holds it twice)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none.astype(bool)
    at = np.arange(n - gram + 1)
    g = B.mix(_grams.spans(_BYTE[data], at, at + gram))
    width = length - gram + 1
    low = _least(g, width)
    start = np.arange(len(low))
    text = np.searchsorted(ends, start, side="right")
    sound = np.flatnonzero(start + length <= ends[text])
    if not len(sound):
        return none.astype(np.uint64), none, none, none.astype(bool)
    v = low[sound]
    new = np.ones(len(sound), bool)
    new[1:] = (v[1:] != v[:-1]) | (sound[1:] != sound[:-1] + 1)
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(sound)))
    if (number > run).any():
        pieces = -(-number // run)
        which = np.repeat(np.arange(len(first)), pieces)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, number = first[which] + inner * run, np.minimum(number[which] - inner * run, run)
    value, a = v[first], sound[first]
    twice = np.empty(len(a), bool)
    for k in range(0, len(a), 4096):
        x, m, y = a[k : k + 4096], number[k : k + 4096], value[k : k + 4096, None]
        left = (g[x[:, None] + np.arange(width)] == y).argmax(1) + x
        right = x + m - 1 + width - 1 - (g[(x + m - 1)[:, None] + np.arange(width)[::-1]] == y).argmax(1)
        twice[k : k + 4096] = left != right
    return value, a, number, twice


def _contents(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each segment's bytes. Segments are equal if this and their least gram's hash agree, 128 bits of two kinds."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


class Segments:
    """Distinct segments of a bundle, sorted by shard and hash, and where each occurs."""

    def __init__(self, texts: list[bytes], length: int, gram: int, run: int, shards: int):
        found, before = [], 0
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        for a, b in B.slabs(texts, 1 << 19):
            data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
            ends = np.cumsum([len(x) for x in texts[a:b]])
            value, at, number, twice = segments(data, ends, length, gram, run)
            value = B.mix(value)  # least hashes crowd near zero; shards are ranges
            content = _contents(data, at, at + number + length - 1)
            found.append((value, content, at + before, number, twice))
            before += len(data)
        value, content, at, number, twice = map(np.concatenate, zip(*found)) if found else [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool)]
        order = np.lexsort((content, value))  # shards are ranges of hashes
        v, c = value[order], content[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])]) if len(v) else np.zeros(0, bool)
        one = np.flatnonzero(new)
        self.value, self.content, self.twice = v[one], c[one], twice[order][one]
        self.several = np.diff(np.append(one, len(v))) > 1
        self.first, self.number = at[order][one], number[order][one]
        self.at, self.which = at[order], np.cumsum(new) - 1  # every occurrence and its segment
        shard = ((self.value >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        self.cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


REPEATED, SEND, FINE, FINEST = 1, 2, 4, 8


def repeated_bytes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, fine_gram: int = FINE_GRAM,
    hot: int = HOT, hottest: int = HOTTEST, run: int = RUN, keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (and kept: the bytes that stay).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another;
    occurrences may overlap and are judged on the input, so all of them go. Null texts are empty; shorter texts stay whole.
    Rows that repeat a text repeat all its strings. Matches never cross texts.
    """
    texts, n, size = B.bundled(df, id_col, text_col)
    shards = size // ((length - gram + 2) // 2 * SHARD_SEGMENTS) + 1
    sort_shards = 4 * shards
    binary, i32 = pa.binary(), pa.int32()

    def read(table):
        bundle, ids, data = B.in_order(table)
        return bundle, ids, data, Segments(data, length, gram, run, shards)

    def offer(table):
        bundle, _, _, s = read(table)
        some = [k for k in range(shards) if s.cut[k] < s.cut[k + 1]]
        part = lambda x, f: pa.array([f(x[s.cut[k] : s.cut[k + 1]]) for k in some], binary)
        return pa.table({
            "shard": pa.array(some, i32), "bundle": pa.array([bundle] * len(some), i32), "value": part(s.value, B.pack),
            "content": part(s.content, B.pack), "flags": part(s.several + 2 * s.twice.astype(np.uint8), lambda x: x.astype(np.uint8).tobytes()),
        })

    def meet(table):
        value, content = ([B.unpack(x.as_buffer(), np.uint64) for x in table.column(c)] for c in ("value", "content"))
        flags = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("flags")])
        sizes = np.cumsum([0, *map(len, value)])
        value, content = np.concatenate(value), np.concatenate(content)
        order = np.lexsort((content, value))
        v, c = value[order], content[order]
        new_v = np.concatenate([[True], v[1:] != v[:-1]])
        new_c = new_v | np.concatenate([[True], c[1:] != c[:-1]])
        at = np.flatnonzero(new_c)
        which, group = np.cumsum(new_c) - 1, np.cumsum(new_v) - 1
        times = np.add.reduceat((1 + (flags[order] & 1)).astype(np.int64), at)
        different = np.bincount(group[at])
        code = np.zeros(len(v), np.uint8)
        code[times[which] > 1] |= REPEATED
        code[new_c & ((different[group] > 1) | (flags[order] & 2 > 0))] |= SEND
        code[different[group] > hot] |= FINE
        code[different[group] > hottest] |= FINEST
        back = np.empty_like(code)
        back[order] = code
        return pa.table({
            "bundle": table.column("bundle").cast(i32), "shard": table.column("shard").cast(i32), "kind": pa.array([0] * table.num_rows, i32),
            "data": pa.array([back[a:b].tobytes() for a, b in zip(sizes, sizes[1:])], binary),
        })

    def codes(s, right):
        out = np.zeros(len(s.value), np.uint8)
        for kind, shard, data in zip(*(right.column(c) for c in ("kind", "shard", "data"))):
            if kind.as_py() == 0:
                k = shard.as_py()
                out[s.cut[k] : s.cut[k + 1]] = np.frombuffer(data.as_buffer(), np.uint8)
        return out

    empty_send = {c: pa.array([], t) for c, t in (("shard", i32), ("bundle", i32), ("items", binary), ("data", binary))}

    def send(left, right):
        """Distinct segments that must be compared: (key, segment, first string in it, strings, may be alone) and bytes."""
        if not left.num_rows:
            return pa.table(empty_send)
        bundle, _, _, s = read(left)
        code, items, parts = codes(s, right), [], []
        pick = np.flatnonzero(code & SEND)
        for e in pick[(code[pick] & FINE) == 0].tolist():
            a = s.first[e]
            items.append((int(s.value[e]), e, 0, int(s.number[e]), code[e] & REPEATED))
            parts.append(s.data[a : a + s.number[e] + length - 1])
        for e in pick[(code[pick] & FINE) > 0].tolist():
            a = s.first[e]
            own = s.data[a : a + s.number[e] + length - 1]
            value, at, number, _ = segments(own, np.array([len(own)]), length, length if code[e] & FINEST else fine_gram, run)
            for v, b, m in zip(value.tolist(), at.tolist(), number.tolist()):
                key = int(B.mix(np.array([v], np.uint64) ^ s.value[e])[0])
                items.append((key, e, b, m, code[e] & REPEATED))
                parts.append(own[b : b + m + length - 1])
        if not items:
            return pa.table(empty_send)
        key = np.array([x[0] for x in items], np.uint64)
        rest = np.array([x[1:] for x in items], np.int32)
        shard = (B.mix(key) % np.uint64(sort_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            body = np.concatenate([parts[k] for k in part]).tobytes()
            rows.append((int(shard[part[0]]), bundle, key[part].tobytes() + rest[part].tobytes(), body))
        return pa.table({c: pa.array([r[k] for r in rows], t.type) for k, (c, t) in enumerate(empty_send.items())})

    def sort(table):
        """Suffix arrays over the segments of a shard; the strings that occur twice, back to the bundles."""
        keys, rest, owner, bodies = [], [], [], []
        for k, (items, data) in enumerate(zip(table.column("items"), table.column("data"))):
            items, body = items.as_buffer().to_pybytes(), data.as_buffer().to_pybytes()
            m = len(items) // 24
            keys.append(np.frombuffer(items, np.uint64, m))
            rest.append(np.frombuffer(items, np.int32, 4 * m, 8 * m).reshape(m, 4))
            owner.append(np.full(m, k))
            ends = np.cumsum(rest[-1][:, 2] + length - 1).tolist()
            bodies += [body[a:b] for a, b in zip([0, *ends], ends)]
        keys, rest, owner = map(np.concatenate, (keys, rest, owner))
        order = np.argsort(keys, kind="stable")
        of_key = np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)
        answers: list[list[tuple]] = [[] for _ in range(table.num_rows)]

        def settle(pack):
            data = bytes([END]).join([bodies[k] for k in pack])
            twice, at = repeated_starts(data, length), 0
            for k in pack:
                if not rest[k, 3]:
                    hit = twice[at : at + rest[k, 2]]
                    if hit.any():
                        answers[owner[k]].append((rest[k, 0], rest[k, 1], rest[k, 2], B.bits(hit)))
                at += len(bodies[k]) + 1

        pack, held = [], 0
        for own in of_key:
            if rest[own, 3].all():
                continue  # all of them are repeated as a whole
            size = sum(len(bodies[k]) + 1 for k in own)
            if pack and held + size > PACK:
                settle(pack)
                pack, held = [], 0
            pack, held = [*pack, *own.tolist()], held + size
        if pack:
            settle(pack)
        some = [k for k, a in enumerate(answers) if a]
        data = [np.array([x[:3] for x in answers[k]], np.int32).tobytes() + b"".join(x[3] for x in answers[k]) for k in some]
        return pa.table({
            "bundle": table.column("bundle").cast(i32).take(pa.array(some, pa.int64())), "shard": pa.array([len(answers[k]) for k in some], i32),
            "kind": pa.array([1] * len(some), i32), "data": pa.array(data, binary),
        })

    def remove(left, right):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), binary]
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds)})
        _, ids, data, s = read(left)
        whole = codes(s, right) & REPEATED > 0
        cover = np.zeros(len(s.data) + 1, np.int32)
        hit = np.flatnonzero(whole[s.which])
        np.add.at(cover, s.at[hit], 1)
        np.add.at(cover, s.at[hit] + s.number[s.which[hit]] + length - 1, -1)
        for kind, m, body in zip(*(right.column(c) for c in ("kind", "shard", "data"))):
            if kind.as_py() == 1:
                m, body = m.as_py(), body.as_buffer().to_pybytes()
                place = 12 * m
                for e, b, k in np.frombuffer(body, np.int32, 3 * m).reshape(m, 3).tolist():
                    flags = B.unbits(body[place : place + (k + 7) // 8], k)
                    place += (k + 7) // 8
                    starts = s.first[e] + b + np.flatnonzero(flags)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + length, -1)
        gone = np.cumsum(cover)[:-1] > 0
        rows, at = [], 0
        for i, x in zip(ids, data):
            own = gone[at : at + len(x)]
            edge = np.diff(own.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept = b"".join([x[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(x)])]) if len(starts) else x
            rows.append((i, len(x), len(x) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            at += len(x)
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, kinds))})

    answer = "bundle int, shard int, kind int, data binary"
    by_bundle = texts.groupBy("bundle")
    offered = by_bundle.applyInArrow(offer, "shard int, bundle int, value binary, content binary, flags binary")
    met = offered.groupBy("shard").applyInArrow(meet, answer)
    sent = by_bundle.cogroup(met.groupBy("bundle")).applyInArrow(send, "shard int, bundle int, items binary, data binary")
    found = sent.groupBy("shard").applyInArrow(sort, answer)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return by_bundle.cogroup(met.unionByName(found).groupBy("bundle")).applyInArrow(remove, out)
